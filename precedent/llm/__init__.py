"""Training-data operators: dedup, scoring, mixing, packing and token output.

Nothing outside this subpackage imports it; its queries are registered by
``__spark_entry__`` only when it can be imported.
"""
