"""Readers and writers: CDF files, JSON feeds, synthetic series, tables and reports."""
