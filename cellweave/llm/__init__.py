"""Training-data operators: deduplication, sharding, search, scoring, extraction and scans.

Each module holds one operator with its own interface; ``queries.py`` holds the thin
registered queries. Nothing outside this subpackage imports it.
"""
