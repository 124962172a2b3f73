import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text) or whole rows."""
    def build(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 0) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)
    return build


@pytest.fixture
def odd(make):
    """Nulls, empty and long texts, repeated rows."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
    return make([(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "a b"), (5, "a b"), (None, "null id text"),
                 (6, "é😀 " * 300, None, None), (7, None, None, None)])
