"""Mixing sources to target weights: a time-varying curriculum over token positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, table

#: Weight of the sources in code-point order, repeating, and the slope of each one's schedule over training time:
#: at time t in [0, 1] a source is drawn at the rate target * (1 + slope * (2 t - 1)).
WEIGHTS, SLOPES = (5, 2, 1), (-0.5, 0.0, 0.5)
#: Hex digits of a document's hash that name its bucket: 4096 buckets split each source, however hot.
BUCKET_DIGITS = 3


def _pick(values: tuple, rank: Column) -> Column:
    out = F.lit(float(values[-1]))
    for i, v in enumerate(values[:-1]):
        out = F.when(F.pmod(rank, F.lit(len(values))) == i, F.lit(float(v))).otherwise(out)
    return out


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS, slopes: tuple = SLOPES) -> DataFrame:
    """(source, source_size, target, slope) from (source, size): weights by rank share the budget, none above its cap.

    Sharing the excess of capped sources again and again ends in one level L: a source gets min(cap * size, L * weight).
    Sorted by cap / weight, L is that of the first source which it doesn't cap. The windows run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    per = per.select("source", "source_size", rank.alias("k"))
    per = per.select("source", "source_size", "k", _pick(weights, F.col("k")).alias("w"), _pick(slopes, F.col("k")).alias("slope"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), "k")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select(
        "*",
        ((share * F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(after)).alias("level"),
    )
    fits = F.when(cap * F.col("source_size") / F.col("w") >= F.col("level"), F.col("level"))
    per = per.select("*", fits.alias("_fits"))
    level = F.first("_fits", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.select("source", "source_size", F.least(cap * F.col("source_size"), F.coalesce(level, F.lit(0.0)) * F.col("w")).alias("target"), "slope")


def _position(tokens: Column, target: Column, slope: Column) -> Column:
    """The time at which a source's cumulative demand, the integral of its schedule, reaches so many tokens."""
    u = tokens / target
    curved = (F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u) - (1 - slope)) / F.when(slope != 0, 2 * slope)
    return F.when(slope == 0, u).otherwise(curved)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, **targets) -> DataFrame:
    """Adds to each document its part in the mix: size, source_size, target, taken, first_position, second_position.

    A source's documents stand in a fixed order (md5 of the id) and are read round and round until its target is
    reached: `taken` is the overlap of a document's words with what is read, so a source takes floor(target) words and
    no document more than twice its own. The position of each reading is the training time at which the source's
    cumulative demand comes to it; `training_order` sorts by it. Running sums go bucket by bucket: sums of up to 4096
    hash buckets a source first, then within a bucket, so no source is one task.

    Null text has size 0; a null source is a source of its own, last in order; null ids come first in their bucket;
    repeated rows stand next to each other, each with its own words. Added names start with no clash: columns of the
    input that bear an added name are replaced. An empty table gives an empty one.
    """
    added = ["size", "source_size", "target", "taken", "first_position", "second_position"]
    own = [c for c in docs.columns if c not in added]
    rows = docs.select(
        *(F.col(f"`{c}`") for c in own),
        F.col(source_col).alias("_w_source"),
        F.col(id_col).alias("_w_id"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_w_hash"),
    ).withColumn("_w_bucket", F.substring("_w_hash", 1, BUCKET_DIGITS))
    # one row a bucket; the text is not read for it, only counted
    buckets = rows.groupBy(F.col("_w_source").alias("source"), F.col("_w_bucket").alias("bucket")).agg(F.sum("size").alias("size"))
    sources = source_targets(buckets, share=share, **targets)
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("source", "bucket", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("_w_start"))
    starts = starts.alias("b").join(sources.alias("s"), F.expr("b.source <=> s.source")).select(
        F.col("b.source").alias("_b_source"), F.col("b.bucket").alias("_b_bucket"), "_w_start", "source_size", "target", "slope"
    )
    joined = rows.join(starts, F.col("_w_source").eqNullSafe(F.col("_b_source")) & (F.col("_w_bucket") == F.col("_b_bucket")))
    within = Window.partitionBy("_w_source", "_w_bucket").orderBy("_w_hash", F.col("_w_id").asc_nulls_first(), "size")
    c = F.col("_w_start") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = joined.withColumn("_w_at", c).withColumn("_w_top", F.floor("target").cast("long"))
    at, top, size, whole = (F.col(x) for x in ("_w_at", "_w_top", "size", "source_size"))
    part = lambda goal: F.greatest(F.lit(0), F.least(at + size, goal) - at)
    where = lambda tokens: F.when((size > 0) & (tokens < top), _position(tokens, F.col("target"), F.col("slope")))
    return placed.select(
        *(F.col(f"`{x}`") for x in own), "size", "source_size", "target",
        (part(top) + part(top - whole)).alias("taken"),
        where(at).alias("first_position"), where(at + whole).alias("second_position"),
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """One row a reading, range-sorted by position: the order in which training meets the documents."""
    readings = mixed.withColumn("position", F.explode(F.array("first_position", "second_position"))).where("position IS NOT NULL")
    return readings.drop("first_position", "second_position").orderBy("position")


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    """mix over all documents, sorted by the first reading; nulls, ties and empty tables as there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    return mix(docs).select(*cols, F.round("first_position", 9).alias("first_position"), F.round("second_position", 9).alias("second_position")).repartitionByRange(F.col("first_position"), F.col("doc_id")).sortWithinPartitions("first_position", "doc_id")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM p),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS w, CASE k % 3 WHEN 0 THEN -0.5e0 WHEN 1 THEN 0e0 ELSE 0.5e0 END AS slope FROM r),
l AS (SELECT *, (1.5e0 * CAST(sum(source_size) OVER () AS DOUBLE) - 2e0 * CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
             / sum(w) OVER (ORDER BY source_size / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
v AS (SELECT coalesce((SELECT level FROM l WHERE 2e0 * source_size / w >= level ORDER BY source_size / w, k LIMIT 1), 0) AS level),
t AS (SELECT source, source_size, slope, least(2e0 * source_size, v.level * w) AS target FROM l, v),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, CAST(floor(t.target) AS BIGINT) AS top,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS pos
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       greatest(0, least(pos + size, top) - pos) + greatest(0, least(pos + size, top - source_size) - pos) AS taken,
       round(CASE WHEN size > 0 AND pos < top THEN CASE WHEN slope = 0 THEN pos / target ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * (pos / target)) - (1 - slope)) / (2 * slope) END END, 9) AS first_position,
       round(CASE WHEN size > 0 AND pos + source_size < top THEN CASE WHEN slope = 0 THEN (pos + source_size) / target ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * ((pos + source_size) / target)) - (1 - slope)) / (2 * slope) END END, 9) AS second_position
FROM c
"""
