"""Training-data operators: text quality, deduplication, tokenisation, mixing and search.

Every module works on DataFrames with at least ``doc_id`` and ``text`` (or ``vec_id`` and
``embedding``); nothing else in the package imports from here.
"""
