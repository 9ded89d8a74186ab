"""Training-data operators: scoring, filtering, near-duplicate joins, mixing and tokenising of document corpora.

Nothing outside this subpackage imports it; `__spark_entry__.py` adds its queries only if it can be imported.
"""
