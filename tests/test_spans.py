"""The cover fold against a plain greedy loop, and small cases of co-occurrence."""

import random

from pyspark.sql import functions as F

from weftline.operators import joins, spans


def greedy(items):
    kept, end = [], None
    for s, e, p, i in sorted(items, key=lambda x: (x[0], -x[1], x[2], x[3])):
        if end is None or s >= end:
            kept.append((s, e, p, i))
            end = e
    return kept


def test_cover(spark):
    rng = random.Random(1)
    groups = [[(s := rng.randrange(30), s + rng.randrange(1, 9), rng.randrange(3), k) for k in range(rng.randrange(12))] for _ in range(60)]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "i int, spans array<struct<start:long,end:long,priority:int,id:long>>")
    got = {r.i: [tuple(x) for x in r.c] for r in df.select("i", spans.cover(F.col("spans")).alias("c")).collect()}
    assert got == {i: greedy(g) for i, g in enumerate(groups)}


def test_cooccurrence(spark):
    rows = [(o, p) for o in range(4) for p in ("a", "b")] + [(1, "a"), (1, "c"), (None, "a")]
    out = joins.cooccurrence(spark.createDataFrame(rows, "o int, p string"), "o", "p").collect()
    assert [tuple(r) for r in out] == [("a", "b", 4, 0.4)]
    assert joins.cooccurrence(spark.createDataFrame([], "o int, p string"), "o", "p").collect() == []
