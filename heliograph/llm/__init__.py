"""Operators for preparing language-model training data.

Thirteen numbered operators, each in a module of its own, with a general interface
(`DataFrame` in, `DataFrame` out).  `queries.py` holds the thin queries that
bind them to the tables of this repository.  Nothing outside this subpackage
and `corpus_pipeline.py` imports it.
"""
