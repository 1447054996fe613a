"""Resampling against plain Python, and how its plans are spread."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.operators import stats


def _digest(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def _share(counts):
    t = sum(counts)
    return -sum(c / t * math.log2(c / t) for c in counts) / (math.log2(len(counts)) if len(counts) > 1 else 1)


def test_blocks_that_overlap_weigh_their_words(spark):
    rng = random.Random(8)
    texts = [[rng.choice("abcdefgh") for _ in range(rng.choice((0, 1, 7, 90)))] for _ in range(30)]
    rows, at = [], 0
    for ws in texts:
        rows.append(("g", ws, at))
        at += len(ws)
    rows += [("one", ["x"], 0), ("two", ["x", "y"], 0)]
    each, point = stats.block_bootstrap(spark.createDataFrame(rows, "g string, ws array<string>, before long"), "g", "ws", "before", 4)
    whole = [w for ws in texts for w in ws]
    n, b = at, max(2, round(math.sqrt(at)))
    want = {}
    for rep in range(4):
        starts = [int(_digest("boot", "g", rep, k)[:7], 16) % (n - b + 1) for k in range(max(1, n // b))]
        want[rep] = _share(list(Counter(w for s in starts for w in whole[s : s + b]).values()))
    got = {r.rep: r.e for r in each.where("g = 'g'").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    assert math.isclose(point.where("g = 'g'").first().point, _share(list(Counter(whole).values())))
    assert {r.g for r in each.collect()} == {"g", "two"}


@pytest.mark.parametrize("words", [1, 40, 9000])
def test_sets_dealt_out_anew(spark, words):
    rows = [(g, f"w{i}") for i in range(words) for g in (("en", "de") if i % 5 == 0 else ("en",) if i % 3 else ("de",))] + [("fr", "x")]
    out = stats.jaccard_null(spark.createDataFrame(rows, "lang string, w string"), "lang", "w", "en", "de", 3)
    en, de = ({w for g, w in rows if g == lang} for lang in ("en", "de"))
    want = {-1: len(en & de) / len(en | de)}
    for rep in range(3):
        first = lambda k, n: set(sorted(en | de, key=lambda w: (_digest(f"perm{k}", rep, w), w))[:n])  # noqa: B023, E731
        x, y = first("a", len(en)), first("b", len(de))
        want[rep] = len(x & y) / len(x | y)
    got = {r.rep: r.jaccard for r in out.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_no_window_has_all_types_of_a_replicate(spark):
    rows = spark.range(50).select(F.lit("en").alias("lang"), F.col("id").cast("string").alias("w"))
    plan = stats.jaccard_null(rows, "lang", "w", "en", "de", 3)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window" in x and "row_number" in x]
    assert all("Filter" in below or "Join" in below for x in windows for below in [plan.split(x, 1)[1].split("Window", 1)[0]]) and "substring" in plan


def test_places_move_texts_not_words(spark):
    from weftline.plans import statistics

    plan = statistics._placed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" in plan.split("Window", 1)[0].splitlines()[0] or "split(coalesce(text" in plan.split("Window", 1)[0]
