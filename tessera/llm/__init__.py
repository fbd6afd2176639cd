"""Training-data operators: deduplication, mixing, filtering, extraction and formatting.

Nothing outside this subpackage imports it.  Every module exposes one operator
with a general interface; ``queries`` binds them to the benchmark tables.
"""
