"""Operators of a training-data pipeline: ten numbered operators over documents, embeddings and pages.

Nothing outside this folder imports it.  Each operator lives in a module of its own; ``queries`` holds the thin
``opN_*`` queries that apply an operator to its whole table.
"""
