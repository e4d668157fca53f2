"""Training-data operators: deduplication, filtering, tokenizing, sharding.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it is present.
"""
