"""Quality rules: cutoffs chosen on labelled holdouts so that good documents are rarely rejected. Native."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, cut, small_enough, table

#: Of the documents of a stratum that are good, at most this share may be rejected by all rules together, with this
#: probability of error over all rules and strata together.
ALPHA, DELTA = 0.05, 0.05
_RATIO = (1000, 900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 100, 80, 60, 50, 40, 30, 20, 15, 10, 8, 6, 5, 4, 3, 2, 1, 0)
#: Rule -> cutoffs, from lenient to strict, for a metric in thousandths; a document above the cutoff is rejected.
GRIDS = {
    "symbols": _RATIO,
    "dup_lines": _RATIO,
    "repeats": _RATIO,
    "shouts": _RATIO,
    "word_length": (40000, 30000, 20000, 15000, 12000, 10000, 9000, 8500, 8000, 7500, 7250, 7000, 6750, 6500, 6250, 6000, 5750, 5500),
}
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """Evaluates a value once and gives it to the body: a lambda's argument is bound, a repeated expression is not."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(ws: Column) -> Column:
    """Words covered by 8-word windows that occur twice or more. Sorts the windows' hashes, never compares all pairs.

    Most texts repeat no window: sorting their hashes alone shows that. In the others equal hashes stand together once
    sorted with their places; the places of those are sorted again, and each covers 8 words or up to the next place.
    """
    n = F.size(ws)
    hashes = F.when(n >= 9, F.transform(F.sequence(F.lit(1), F.greatest(n - 7, F.lit(1))), lambda i: F.xxhash64(F.slice(ws, i, F.lit(8)))))
    return F.coalesce(_let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(F.lit(0))), F.lit(0))


def _covered(hashes: Column) -> Column:
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = lambda p: F.filter(
        p, lambda x, k: ((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False))
    )
    state = lambda last, total: F.struct(last.alias("last"), total.alias("total"))
    return F.aggregate(
        F.sort_array(F.transform(_let(pairs, again), lambda x: x["i"])),
        state(F.lit(-8), F.lit(0)),
        lambda a, p: state(p, a["total"] + F.least(F.lit(8), p - a["last"])),
        lambda a: a["total"],
    )


def measures(text: Column) -> dict[str, Column]:
    """Counts of one text, all as expressions inside the JVM: the five base counts, lines with a word, and `!`."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_like(x, F.lit(WORD)))
    space = F.coalesce(F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]")), F.lit(0))
    return {
        "_w_words": F.filter(F.split(text, SPACE, -1), lambda x: x != ""),
        "_w_lines": lines,
        "word_chars": (F.length(text) - space).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_shouts": F.regexp_count(text, F.lit("!")).cast("long"),
    }


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and one m_<rule> a rule.

    Null and empty texts have no words and fail the base. No shuffle: each text is measured where it is read.
    """
    m = measures(F.col(text_col))
    out = docs.select("*", *(v.alias(k) for k, v in m.items()))
    out = out.withColumns({"n_words": F.size("_w_words").cast("long"), "n_lines": F.size("_w_lines").cast("long")})
    out = out.withColumns({
        "n_dup_lines": (F.col("n_lines") - F.size(F.array_distinct("_w_lines"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_w_words")).cast("long"),
    }).drop("_w_words", "_w_lines")
    per = lambda a, b: F.coalesce(F.expr(f"try_divide({a} * 1000, {b})"), F.lit(0)).cast("long")
    return out.withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "m_symbols": per("n_symbols", "word_chars"), "m_dup_lines": per("n_dup_lines", "n_lines"),
        "m_repeats": per("n_repeat_words", "n_words"), "m_shouts": per("n_shouts", "n_words"),
        "m_word_length": per("word_chars", "n_words"),
    }).drop("n_lines", "n_shouts")


def _tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), the exact lower tail, summed in logarithms."""
    import math

    odds, first = math.log(p) - math.log1p(-p), math.log1p(-p)
    state = lambda t, s: F.struct(t.alias("t"), s.alias("s"))
    start = n * F.lit(first)
    return F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")),
        state(start, F.exp(start)),
        lambda a, j: state(a["t"] + F.log((n - j + 1) / j) + F.lit(odds), a["s"] + F.exp(a["t"] + F.log((n - j + 1) / j) + F.lit(odds))),
        lambda a: a["s"],
    )


def cutoffs(holdout: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, one column a rule) of the chosen cutoffs, from labelled good documents (stratum, m_<rule>...).

    Each of the R rules may wrongly reject alpha / R of a stratum's good documents. For every cutoff, the hypothesis
    "it rejects more" has as its p-value the exact binomial tail P(Bin(n, alpha / R) <= k), k being the good documents
    of the holdout above the cutoff. Along a grid, lenient to strict, hypotheses are rejected while p <= delta / (R * S)
    for S strata (a fixed sequence needs no further correction); the last cutoff so proven is taken, or none: a rule
    without proof rejects nothing there. A null stratum is one of its own. Counts cover the whole holdout.
    """
    rules = len(GRIDS)
    counts = holdout.groupBy("stratum").agg(
        F.count("*").alias("n"),
        *(F.count_if(F.col(f"m_{r}") > c).alias(f"{r}_{i}") for r, grid in GRIDS.items() for i, c in enumerate(grid)),
    )
    counts = counts.withColumn("strata", F.count("*").over(Window.partitionBy()))
    level = F.lit(delta) / (rules * F.col("strata"))
    chosen = []
    for r, grid in GRIDS.items():
        proven = F.array(*(
            F.struct(F.lit(c).alias("c"), F.lit(i).alias("i"), F.when(F.col(f"{r}_{i}") > F.col("n") * (alpha / rules), F.lit(1.0)).otherwise(_tail(F.col(f"{r}_{i}"), F.col("n"), alpha / rules)).alias("p"))
            for i, c in enumerate(grid)
        ))
        held = F.aggregate(
            proven, F.struct(F.lit(None).cast("int").alias("c"), F.lit(True).alias("going")),
            lambda a, x: F.struct(F.when(a["going"] & (x["p"] <= level), x["c"]).otherwise(a["c"]).alias("c"), (a["going"] & (x["p"] <= level)).alias("going")),
            lambda a: a["c"],
        )
        chosen.append(held.alias(f"cut_{r}"))
    return counts.select("stratum", *chosen)


def judge(docs: DataFrame, limits: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """Adds `kept` to measured documents: false if the base failed or a rule of the stratum rejects.

    `limits` has one row for each stratum of the labelled holdout with enough good documents to prove a cutoff at all
    (some 600), so it is broadcast only behind a count of at most 10000 rows; beyond, it is joined by shuffle.
    """
    limits = limits.withColumnRenamed("stratum", "_w_stratum").where(reduce(lambda a, b: a | b, (F.col(f"cut_{r}").isNotNull() for r in GRIDS)))
    limits = F.broadcast(limits) if limits.limit(10_001).count() <= 10_000 else limits
    out = docs.join(limits, F.col(stratum_col).eqNullSafe(F.col("_w_stratum")), "left")
    rejected = reduce(lambda a, b: a | b, (F.coalesce(F.col(f"m_{r}") > F.col(f"cut_{r}"), F.lit(False)) for r in GRIDS))
    return out.withColumn("kept", ~(F.col("base_failed") | rejected)).drop("_w_stratum", *(f"cut_{r}" for r in GRIDS))


def learn(metrics: DataFrame, labels: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """Cutoffs from measured documents (doc_id, stratum, m_*) and labels (doc_id, quality): the good ones are the holdout.

    Repeated rows and labels count as often as they pair; rows without an id or a label take no part.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_w_id"))
    held = metrics.join(good, F.col("doc_id") == F.col("_w_id"))
    return cutoffs(held.select(F.col(stratum_col).alias("stratum"), *(f"m_{r}" for r in GRIDS)))


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Measures, cutoffs and verdicts of all documents; nulls, repeated rows and empty tables as in measured and judge."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    metrics = cut(measured(docs).drop("text"))
    limits = cut(learn(metrics, table(spark, sf_dir, "labels")))
    return judge(metrics, limits).select("doc_id", *_COUNTS, "base_failed", "kept")


def filter_documents(docs: DataFrame, labels: DataFrame, broadcast: int = 1_000_000) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    Measured once, into a narrow written table; rejected rows are told by a 64-bit hash of id, stratum and text, so rows
    that share an id are judged each by its own text. Their hashes are broadcast behind a count, else joined by shuffle.
    """
    mark = F.xxhash64("doc_id", "lang", "text")
    metrics = cut(measured(docs.select("doc_id", "lang", "text", mark.alias("_w_mark"))).drop("text"))
    limits = cut(learn(metrics, labels))
    gone = cut(judge(metrics, limits).where("NOT kept").select("_w_mark").distinct())
    gone = F.broadcast(gone) if small_enough(gone, broadcast) else gone
    return docs.withColumn("_w_own", mark).join(gone, F.col("_w_own") == F.col("_w_mark"), "left_anti").drop("_w_own")


def _rule_sql() -> str:
    import math

    p = ALPHA / len(GRIDS)
    grid = ", ".join(f"('{r}', {i}, {c})" for r, g in GRIDS.items() for i, c in enumerate(g))
    metric = "CASE g.rule " + " ".join(f"WHEN '{r}' THEN m_{r}" for r in GRIDS) + " END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, list_slice(ws, i, i + 7) AS x FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least(8, coalesce(i - prev, 8))) AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS prev FROM rep) GROUP BY rid),
m AS (SELECT w.rid, doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_shouts
      FROM w LEFT JOIN cov ON w.rid = cov.rid),
x AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             coalesce(n_symbols * 1000 // nullif(word_chars, 0), 0) AS m_symbols, coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0) AS m_dup_lines,
             coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0) AS m_repeats, coalesce(n_shouts * 1000 // nullif(n_words, 0), 0) AS m_shouts,
             coalesce(word_chars * 1000 // nullif(n_words, 0), 0) AS m_word_length FROM m),
g(rule, i, c) AS (VALUES {grid}),
h AS (SELECT x.* FROM x JOIN labels l ON x.doc_id = l.doc_id WHERE l.quality = 1),
k AS (SELECT lang, rule, i, c, count(*) AS n, count_if({metric} > c) AS k FROM h, g GROUP BY ALL),
s AS (SELECT *, (SELECT count(*) FROM (SELECT DISTINCT lang FROM h)) AS strata FROM k),
e AS (SELECT s.*, CASE WHEN k > n * {p!r} THEN 1 ELSE (SELECT sum(exp(lgamma(s.n + 1) - lgamma(j + 1) - lgamma(s.n - j + 1) + j * {math.log(p)!r} + (s.n - j) * {math.log1p(-p)!r})) FROM range(CAST(0 AS BIGINT), CAST(s.k + 1 AS BIGINT)) AS q(j)) END AS p FROM s),
f AS (SELECT *, bool_and(p <= {DELTA!r} / ({len(GRIDS)} * strata)) OVER (PARTITION BY lang, rule ORDER BY i) AS going FROM e),
z AS (SELECT lang, rule, min(c) AS c FROM f WHERE going GROUP BY lang, rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM z WHERE z.lang IS NOT DISTINCT FROM x.lang AND {metric.replace('g.rule', 'z.rule')} > z.c) AS kept FROM x
"""


OP6_SQL = _rule_sql()
