"""Keeping the graph current from a change stream."""
