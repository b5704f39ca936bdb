"""Readers and writers of graph formats and source files."""
