"""Joins within groups against plain Python, and how their plans are spread."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weftline import catalog
from weftline.operators import joins

DIR = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_group_need_no_table_of_all_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.randrange(3), i) for i in range(40)] + [("a", 1, 5), ("b", 1, 5), ("b", 1, 6), ("a", 1, 6), ("a", 1, 5), (None, 1, 7), ("a", 1, None)]
    out = joins.same_group(spark.createDataFrame(rows, "x string, y int, i int"), ["x", "y"], "i", "src", "dst")
    of = defaultdict(set)
    for x, y, i in rows:
        if None not in (x, i):
            of[x, y].add(i)
    want = {(a, b) for s in of.values() for a in s for b in s if a != b}
    got = Counter(map(tuple, out.collect()))
    assert set(got) == want and set(got.values()) == {1}
    # the pairs of single items leave the join as they are
    plan = catalog.QUERIES["substitutes_for"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union")


@pytest.mark.parametrize("most", [7, 1_000_000])
def test_cooccurrence_spreads_its_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "PAIRS", most)
    rng = random.Random(5)
    rows = [(g, rng.randrange(12)) for g in range(60) for _ in range(rng.randrange(6))] + [(None, 1), (1, None)]
    out = joins.cooccurrence(spark.createDataFrame(rows, "g int, i int"), "g", "i", 2, None)
    of = defaultdict(set)
    for g, i in rows:
        if None not in (g, i):
            of[g].add(i)
    want = {p: n for p, n in Counter((a, b) for s in of.values() for a in s for b in s if a < b).items() if n >= 2}
    assert {(r.a, r.b): r.n for r in out.collect()} == want
    assert bool(re.search(r"hashpartitioning\(a#\d+, b#\d+, \d+\), REPARTITION_BY_NUM", _plan(out))) == (most == 7)


def test_rollup_shuffles_lines_once(spark, tmp_path):
    plan = _plan(catalog.QUERIES["type_counts_rollup"](spark, DIR))
    assert "Expand" not in plan and "hashpartitioning(l_orderkey" in plan
    for t in ("lineitem", "part"):
        spark.read.parquet(f"{DIR}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    rows = catalog.QUERIES["type_counts_rollup"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [(None, None, 0, 0)]  # SQL's rollup of nothing is its grand total
