"""Relational operators on gridded series."""
