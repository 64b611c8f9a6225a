"""Models and whole plans built from the operators."""
