"""What goes to Python workers at once is bounded in bytes, whatever the texts' lengths."""

from kgspark import session


def test_batches_of_long_texts_are_bounded(spark):
    session.workers_import_this(spark)

    def size(batches):
        import os

        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"n": [len(b)], "bytes": [int(b["text"].str.len().sum())], "arenas": [os.environ.get("MALLOC_ARENA_MAX")]})

    docs = spark.range(60, numPartitions=1).selectExpr("id as doc_id", "repeat('x', 1048576) as text")
    got = docs.mapInPandas(size, "n int, bytes long, arenas string").collect()
    assert sum(r.n for r in got) == 60
    assert max(r.bytes for r in got) <= session.BATCH_BYTES + 2 * 1048576
    assert {r.arenas for r in got} == {"1"}
