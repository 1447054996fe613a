"""Joins by key, candidate and overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most pairs, and rows, of one task, if they are spread evenly.
PAIRS, ROWS = 1_000_000, 500_000


def tasks(spark: SparkSession, n: int, most: int = ROWS) -> int:
    """Partitions of which each has at most so many of n things; no fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // most))


def cooccurrence(rows: DataFrame, group: str, item: str, min_count: int = 3, top: int | None = 200, full: float = 10.0) -> DataFrame:
    """Pairs of distinct items that share a group: (a, b, n, confidence), a < b, at least min_count, the top by count.

    Each group must be small (its square is made); confidence reaches 1 at `full` groups. Nulls form no pair. How many
    pairs there may be is reckoned first, from the sizes of groups and the number of items, and they are spread over as
    many tasks as that needs, so the memory of one does not grow with the table.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(group).alias("g"), F.col(item).alias("i")).dropna()
    sizes = own.groupBy("g").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum(F.expr("k * (k - 1) div 2")), F.lit(0))).first()
    items = own.agg(F.approx_count_distinct("i", 0.02)).first()[0]
    many = min(sizes[1], items * items)  # different pairs at most
    pairs = own.repartition(max(tasks(spark, sizes[0]), tasks(spark, sizes[1], PAIRS)), "g").distinct()
    x, y = pairs.alias("x"), pairs.alias("y")
    both = x.join(y, F.expr("x.g = y.g AND x.i < y.i")).select(F.col("x.i").alias("a"), F.col("y.i").alias("b"))
    if tasks(spark, many, PAIRS) > tasks(spark, 0):  # else few are different: they are combined before the shuffle
        both = both.repartition(tasks(spark, many, PAIRS), "a", "b")
    out = both.groupBy("a", "b").agg(F.count("*").alias("n"))
    out = out.where(F.col("n") >= min_count).withColumn("confidence", F.least(F.lit(1.0), F.col("n") / F.lit(full)))
    return out.orderBy(F.desc("n"), "a", "b").limit(top) if top else out


def same_group(rows: DataFrame, keys: list[str], item: str, a: str, b: str) -> DataFrame:
    """(a, b): each item with each other one that shares all keys with it, both ways, each pair once. Nulls form no pair.

    Only items of several groups can meet twice, so only their pairs are made distinct; all others leave the join as they
    are, and no task holds more than a group.
    """
    own = rows.select(*keys, F.col(item).alias("_w_i")).dropna().distinct()
    several = own.groupBy("_w_i").agg(F.count("*").alias("_w_k")).where("_w_k > 1").select("_w_i", F.lit(True).alias("_w_m"))
    own = own.join(several, "_w_i", "left").withColumn("_w_m", F.coalesce("_w_m", F.lit(False)))

    def pairs(own: DataFrame, which: str) -> DataFrame:
        y = own.select(*keys, F.col("_w_i").alias("_w_j"), F.col("_w_m").alias("_w_n"))
        return own.join(y.hint("merge"), keys).where(f"_w_i <> _w_j AND {which}").select(F.col("_w_i").alias(a), F.col("_w_j").alias(b))

    return pairs(own, "NOT (_w_m AND _w_n)").unionByName(pairs(own.where("_w_m"), "true").distinct())
