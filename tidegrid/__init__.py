"""Uniform-grid analytics for irregular time series, as DataFrame plans."""
