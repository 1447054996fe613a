"""Co-occurrence edges: the flagship plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import joins


def cooccurrence_topn(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    edges = joins.cooccurrence(lines, "l_orderkey", "l_partkey", min_count=3, top=200)
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "n", "confidence")


QUERIES = {"cooccurrence_topn": cooccurrence_topn}
SQL = {
    "cooccurrence_topn": """
WITH d AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)
SELECT a.p AS src, b.p AS dst, count(*) AS n, least(1e0, count(*) / 10e0) AS confidence
FROM d a JOIN d b ON a.o = b.o AND a.p < b.p GROUP BY a.p, b.p HAVING count(*) >= 3 ORDER BY n DESC, src, dst LIMIT 200
"""
}
