"""Training-data operators: quality, deduplication, tokenisation, scoring, extraction and packing.

Nothing outside this package imports it.  Every module holds one operator with a
general interface; ``queries`` holds the thin registered queries.
"""
