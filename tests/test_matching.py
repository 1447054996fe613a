"""Phrase matches, free tokens and covers against plain Python, and what their plans leave unmade."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from weftline.operators import matching, spans


def _docs(spark, rows):
    return spark.createDataFrame(rows, "id long, ws array<string>")


def test_phrase_matches_are_all_places(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice("abc") for _ in range(rng.randrange(12))]) for i in range(60)] + [(60, None), (None, ["a", "b"]), (61, ["b", "a b", ""])]
    phrases = ["a", "a b", "b c a", "c c", "zz z", "", None, "a b"]
    got = Counter(map(tuple, matching.phrase_matches(_docs(spark, rows), "id", F.col("ws"), spark.createDataFrame([(p,) for p in phrases], "p string"), "p", 3).collect()))
    want = Counter((i, s, s + k, " ".join(ws[s : s + k])) for i, ws in rows for k in (1, 2, 3) for s in range(len(ws or []) - k + 1) if " ".join(ws[s : s + k]) in phrases)
    assert got == want


def test_only_words_that_start_a_phrase_make_grams(spark):
    plan = matching.phrase_matches(_docs(spark, [(1, ["a"])]), "id", F.col("ws"), spark.createDataFrame([("a b",)], "p string"), "p", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "lambda" not in plan


def test_free_tokens_are_counted_without_a_row_a_token(spark):
    rows = [(1, list("abcd")), (1, list("ab")), (2, ["a"]), (None, ["a", "b"]), (3, [])]
    held = spark.createDataFrame([(1, 1, 3), (1, 2, 4), (2, 0, 1), (None, 0, 1), (9, 0, 5)], "id long, start int, end int")
    docs = _docs(spark, rows)
    out = matching.count_uncovered(docs, "id", F.col("ws"), held)
    want = matching.uncovered(matching.token_table(docs, "id", F.col("ws")), held).groupBy("id").count()
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, map(tuple, want.collect()))) == ["(1, 2)", "(None, 2)"]
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_cover_of_very_many_spans(spark):
    n = 60_000
    s = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.cast("long").alias("start"), (i + 1).cast("long").alias("end"), F.lit(0).alias("priority"), i.alias("id")))
    began = time.perf_counter()
    c = spark.range(1).select(spans.cover(s).alias("c")).select(F.size("c").alias("n"), F.element_at("c", -1).alias("last")).first()
    assert (c.n, c.last.start, c.last.end) == (n, n - 1, n) and time.perf_counter() - began < 15
