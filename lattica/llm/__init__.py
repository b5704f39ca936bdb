"""Corpus operators for training-data pipelines.

Nothing else in the package imports from here.  Every operator takes a
DataFrame, names the columns it reads and returns a DataFrame; the thin
``opN_`` queries live in :mod:`lattica.llm.queries`.
"""
