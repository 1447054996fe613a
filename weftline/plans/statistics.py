"""Corpus statistics over documents by language, and rank correlation over order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import segment, text
from weftline.operators import stats

from .base import Catalogue

_c = Catalogue()
_W = r"[^\x20\x09-\x0D]+"
_FREQ = f"w AS (SELECT lang, unnest(regexp_extract_all(coalesce(text, ''), '{_W}')) AS w FROM documents), f AS (SELECT lang, w, count(*) AS n FROM w GROUP BY ALL)"
_LN = "ln(CAST({} AS DOUBLE))"


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _freq(spark, sf_dir):
    return stats.counts(_docs(spark, sf_dir).select("lang", F.explode(text.tokens(F.col("text"))).alias("w")), "lang", "w")


def _rounded(df, *cols):
    return df.select(*(F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns))


@_c.frame("vocab_stats", f"WITH {_FREQ} SELECT lang, CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS n_types, count_if(n = 1) AS hapax, count_if(n = 2) AS dis, round(count(*) / CAST(sum(n) AS DOUBLE), 6) AS ttr, round(count_if(n = 1) / CAST(count(*) AS DOUBLE), 6) AS hapax_share, round(count_if(n = 2) / CAST(count(*) AS DOUBLE), 6) AS dis_share FROM f GROUP BY lang")
def vocab_stats(spark, sf_dir):
    return _rounded(stats.vocabulary(_freq(spark, sf_dir), "lang"), "ttr", "hapax_share", "dis_share")


@_c.frame("corpus_counts", f"""
SELECT lang, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(t, '{_W}'))) AS BIGINT) AS n_tokens, CAST(sum(length(t)) AS BIGINT) AS codepoints,
  CAST(sum(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))) AS BIGINT) AS inked, CAST(sum(strlen(t)) AS BIGINT) AS bytes, min(doc_id) AS first_id, max(doc_id) AS last_id,
  round(sum(strlen(t)) / CAST(sum(length(t)) AS DOUBLE), 6) AS bytes_per_char FROM (SELECT *, coalesce(text, '') AS t FROM documents) GROUP BY lang
""")
def corpus_counts(spark, sf_dir):
    """Sizes of the corpus by language, in tokens, code points and bytes."""
    t = F.coalesce("text", F.lit(""))
    return _docs(spark, sf_dir).select("lang", "doc_id", t.alias("t")).groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum(F.regexp_count("t", F.lit(_W)).cast("long")).alias("n_tokens"), F.sum(F.length("t").cast("long")).alias("codepoints"),
        F.sum((F.length("t") - F.regexp_count("t", F.lit(r"[\x20\x09-\x0D]"))).cast("long")).alias("inked"), F.sum(F.octet_length("t").cast("long")).alias("bytes"),
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.round(F.sum(F.octet_length("t")) / F.sum(F.length("t")), 6).alias("bytes_per_char"),
    )


@_c.frame("zipf_slope", f"WITH {_FREQ}, r AS (SELECT lang, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC) AS k FROM f) SELECT lang, round(regr_slope({_LN.format('n')}, {_LN.format('k')}), 6) AS slope FROM r GROUP BY lang HAVING count(*) >= 5")
def zipf_slope(spark, sf_dir):
    return _rounded(stats.zipf_slope(_freq(spark, sf_dir), "lang"), "slope")


@_c.frame("topk_coverage", f"WITH {_FREQ}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC) AS k FROM f) SELECT lang, round(sum(CASE WHEN k <= 100 THEN n END) / CAST(sum(n) AS DOUBLE), 6) AS coverage FROM r GROUP BY lang")
def topk_coverage(spark, sf_dir):
    return _rounded(stats.topk_coverage(_freq(spark, sf_dir), "lang"), "coverage")


_ENTROPY = "p AS (SELECT lang, n / CAST(sum(n) OVER (PARTITION BY lang) AS DOUBLE) AS p FROM f)"


@_c.frame("norm_entropy", f"WITH {_FREQ}, {_ENTROPY} SELECT lang, round(-sum(p * log2(p)), 6) AS entropy, round(-sum(p * log2(p)) / log2(count(*)), 6) AS normalised FROM p GROUP BY lang")
def norm_entropy(spark, sf_dir):
    return _rounded(stats.entropy(_freq(spark, sf_dir), "lang"), "entropy", "normalised")


@_c.frame("renyi_efficiency", f"WITH {_FREQ}, {_ENTROPY}, a(alpha) AS (VALUES (0.5e0), (1e0), (2e0), (2.5e0)) SELECT lang, alpha, round(CASE WHEN alpha = 1 THEN -sum(p * log2(p)) ELSE log2(sum(pow(p, alpha))) / (1 - alpha) END / log2(count(*)), 6) AS efficiency FROM p, a GROUP BY lang, alpha")
def renyi_efficiency(spark, sf_dir):
    return _rounded(stats.renyi_efficiency(_freq(spark, sf_dir), "lang"), "efficiency")


def _lengths(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("lang").agg(F.sum(F.size(text.tokens(F.col("text"))).cast("long")).alias("n"))


def _placed(spark, sf_dir):
    """(lang, ws, before): texts as words with the number of words before them in their language; texts are shuffled, not words."""
    n = F.size(text.tokens(F.col("text")))
    docs = stats.places(_docs(spark, sf_dir).select("doc_id", "lang", "text"), "lang", "doc_id", n)
    return docs.select("lang", "before", text.tokens(F.col("text")).alias("ws"))


_PLACED = f"x AS (SELECT lang, doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS ws FROM documents), u AS (SELECT lang, doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM x), t AS (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY doc_id, i) AS pos FROM u)"


@_c.frame("heaps_beta", f"""
WITH {_PLACED}, z AS (SELECT lang, max(pos) AS n FROM t GROUP BY lang), s AS (SELECT lang, n, greatest(20, n // 100) AS low FROM z WHERE n >= 50),
g AS (SELECT DISTINCT lang, CASE WHEN i = 24 THEN n ELSE CAST(floor(low * pow(n / CAST(low AS DOUBLE), i / 24e0)) AS BIGINT) END AS upto FROM s, range(25) q(i)),
f AS (SELECT lang, w, min(pos) AS first FROM t GROUP BY ALL), v AS (SELECT g.lang, g.upto, count(*) AS v FROM g JOIN f ON f.lang = g.lang AND f.first <= g.upto GROUP BY ALL)
SELECT lang, round(regr_slope({_LN.format('v')}, {_LN.format('upto')}), 6) AS beta FROM v GROUP BY lang
""")
def heaps_beta(spark, sf_dir):
    placed = _placed(spark, sf_dir).select("lang", "before", F.posexplode("ws").alias("i", "w")).select("lang", "w", (F.col("before") + F.col("i") + 1).alias("at"))
    return _rounded(stats.heaps_beta(placed, "lang", "w", "at", size=_lengths(spark, sf_dir)), "beta")


@_c.frame("block_bootstrap_ci", f"""
WITH {_PLACED}, z AS (SELECT lang, n, greatest(2, CAST(round(sqrt(n)) AS BIGINT)) AS b FROM (SELECT lang, max(pos) AS n FROM t GROUP BY lang) WHERE n >= 2),
r AS (SELECT lang, n, b, rep, unnest(range(greatest(1, n // b))) AS block FROM z, range(5) q(rep)),
s AS (SELECT lang, rep, b, CAST(('0x' || substr(md5('boot|' || lang || '|' || rep || '|' || block), 1, 7)) AS BIGINT) % (n - b + 1) + 1 AS start FROM r),
h AS (SELECT s.lang, rep, w, count(*) AS n FROM s JOIN t ON t.lang = s.lang AND t.pos >= start AND t.pos < start + b GROUP BY ALL),
e AS (SELECT lang, rep, -sum(p * log2(p)) / log2(count(*)) AS e FROM (SELECT lang, rep, n / CAST(sum(n) OVER (PARTITION BY lang, rep) AS DOUBLE) AS p FROM h) GROUP BY ALL),
o AS (SELECT lang, -sum(p * log2(p)) / log2(count(*)) AS point FROM (SELECT lang, n / CAST(sum(n) OVER (PARTITION BY lang) AS DOUBLE) AS p FROM (SELECT lang, w, count(*) AS n FROM t GROUP BY ALL)) GROUP BY lang)
SELECT o.lang, round(point, 6) AS point, round(point - 1.96e0 * se, 6) AS low, round(point + 1.96e0 * se, 6) AS high FROM o JOIN (SELECT lang, stddev_samp(e) AS se FROM e GROUP BY lang) y ON y.lang = o.lang
""")
def block_bootstrap_ci(spark, sf_dir):
    """Normalised entropy by language with an interval from five resamplings of blocks."""
    each, point = stats.block_bootstrap(_placed(spark, sf_dir).where("lang IS NOT NULL"), "lang", "ws", "before", 5, size=_lengths(spark, sf_dir).where("lang IS NOT NULL"))
    return _rounded(stats.interval(each, "lang", "e", point), "point", "low", "high")


@_c.frame("permutation_jaccard", f"""
WITH {_FREQ}, t AS (SELECT w, bool_or(lang = 'en') AS a, bool_or(lang = 'de') AS b FROM f WHERE lang IN ('en', 'de') GROUP BY w),
c AS (SELECT count_if(a) AS na, count_if(b) AS nb FROM t),
d AS (SELECT rep, row_number() OVER (PARTITION BY rep ORDER BY md5('perma|' || rep || '|' || w), w) <= na AS a, row_number() OVER (PARTITION BY rep ORDER BY md5('permb|' || rep || '|' || w), w) <= nb AS b FROM t, c, range(3) q(rep))
SELECT rep, round(count_if(a AND b) / CAST(count_if(a OR b) AS DOUBLE), 6) AS jaccard FROM d GROUP BY rep UNION ALL SELECT -1, round(count_if(a AND b) / CAST(count(*) AS DOUBLE), 6) FROM t
""")
def permutation_jaccard(spark, sf_dir):
    out = stats.jaccard_null(_freq(spark, sf_dir), "lang", "w", "en", "de", 3)
    return _rounded(out.withColumn("rep", F.col("rep").cast("long")), "jaccard")


@_c.frame("jaccard_lang_pairs", f"WITH {_FREQ} SELECT x.lang AS a, y.lang AS b, count(*) AS shared, round(count(*) / CAST(any_value(p.v) + any_value(q.v) - count(*) AS DOUBLE), 6) AS jaccard FROM f x JOIN f y ON x.w = y.w AND x.lang < y.lang JOIN (SELECT lang, count(*) AS v FROM f GROUP BY lang) p ON p.lang = x.lang JOIN (SELECT lang, count(*) AS v FROM f GROUP BY lang) q ON q.lang = y.lang GROUP BY x.lang, y.lang")
def jaccard_lang_pairs(spark, sf_dir):
    """Shared words of each two languages: a word lists its few languages, pairs of these are counted."""
    f = _freq(spark, sf_dir).where("lang IS NOT NULL").select("lang", "w")
    v = f.groupBy("lang").agg(F.count("*").alias("v"))
    sets = f.groupBy("w").agg(F.array_sort(F.collect_set("lang")).alias("ls")).where(F.size("ls") > 1)
    pair = F.flatten(F.transform("ls", lambda x: F.transform(F.filter("ls", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    n = sets.select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))
    out = n.join(F.broadcast(v.select(F.col("lang").alias("a"), F.col("v").alias("va"))), "a").join(F.broadcast(v.select(F.col("lang").alias("b"), F.col("v").alias("vb"))), "b")
    return out.select("a", "b", "shared", F.round(F.col("shared") / (F.col("va") + F.col("vb") - F.col("shared")), 6).alias("jaccard"))


_SPLIT = "CAST(('0x' || substr(md5(CAST(item_id AS VARCHAR)), 1, 7)) AS BIGINT) % 5"
_KN = f"""
d AS (SELECT item_id, {_SPLIT} = 0 AS test, list_concat(list_concat(['<s>', '<s>'], regexp_extract_all(coalesce(text, ''), '{_W}')), ['</s>']) AS p FROM benchmark),
g AS (SELECT k, array_to_string(list_slice(p, i, i + k - 1), ' ') AS gram, count(*) AS n FROM (SELECT p, k, unnest(range(1, len(p) - k + 2)) AS i FROM d, range(1, 4) q(k) WHERE NOT test) GROUP BY ALL)"""


def _items(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", text.tokens(F.col("text")).alias("ws"))
    fold = F.pmod(F.conv(F.substring(F.md5(F.col("item_id").cast("string")), 1, 7), 16, 10).cast("long"), F.lit(5))
    return items.where(fold != 0), items.where(fold == 0)


@_c.frame("kn_ngrams", f"WITH {_KN} SELECT CAST(k AS INT) AS k, gram, n FROM g")
def kn_ngrams(spark, sf_dir):
    return stats.ngrams(_items(spark, sf_dir)[0], "ws", 3)


@_c.frame("kn_bits", f"""
WITH {_KN}, h AS (SELECT k, gram, n, array_to_string(string_split(gram, ' ')[:-2], ' ') AS head, string_split(gram, ' ')[-1] AS tail FROM g),
fo AS (SELECT k, head, count(*) AS l FROM h WHERE k > 1 GROUP BY ALL), pre AS (SELECT tail, count(*) AS n FROM h WHERE k = 2 GROUP BY ALL),
sc AS (SELECT greatest(1, count_if(k = 2)) AS types, count_if(k = 1 AND gram NOT IN ('<s>', '</s>')) AS v FROM g),
x AS (SELECT item_id, p[i] AS w, p[i - 1] AS c2, p[i - 2] || ' ' || p[i - 1] AS c3 FROM (SELECT item_id, p, unnest(range(3, len(p) + 1)) AS i FROM d WHERE test)),
p1 AS (SELECT x.*, CASE WHEN pre.n IS NULL THEN 1e0 / (v + 1) ELSE pre.n / CAST(types AS DOUBLE) END AS p FROM x CROSS JOIN sc LEFT JOIN pre ON pre.tail = w),
p2 AS (SELECT p1.* EXCLUDE p, CASE WHEN c.n IS NULL THEN p ELSE greatest(coalesce(f.n, 0) - 0.75e0, 0) / c.n + 0.75e0 * coalesce(fo.l, 0) / c.n * p END AS p FROM p1 LEFT JOIN g c ON c.k = 1 AND c.gram = c2 LEFT JOIN g f ON f.k = 2 AND f.gram = c2 || ' ' || w LEFT JOIN fo ON fo.k = 2 AND fo.head = c2),
p3 AS (SELECT item_id, CASE WHEN c.n IS NULL THEN p ELSE greatest(coalesce(f.n, 0) - 0.75e0, 0) / c.n + 0.75e0 * coalesce(fo.l, 0) / c.n * p END AS p FROM p2 LEFT JOIN g c ON c.k = 2 AND c.gram = c3 LEFT JOIN g f ON f.k = 3 AND f.gram = c3 || ' ' || w LEFT JOIN fo ON fo.k = 3 AND fo.head = c3)
SELECT item_id, count(*) AS n_units, round(sum(-log2(least(greatest(p, 1e-12), 1e0))), 6) AS bits FROM p3 GROUP BY item_id
""")
def kn_bits(spark, sf_dir):
    train, test = _items(spark, sf_dir)
    from weftline.operators.shared import keep

    grams = keep(stats.ngrams(train, "ws", 3))
    return _rounded(stats.kn_bits(grams, test, "ws", "item_id"), "bits")


@_c.frame("partial_spearman", """
WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2e0 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2e0 AS y, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2e0 AS z FROM lineitem),
c AS (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM r)
SELECT round(xy, 6) AS rho, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM c
""")
def partial_spearman(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("p"), F.col("l_discount").cast("double").alias("d"))
    for c, out in (("q", "x"), ("p", "y"), ("d", "z")):
        rows = stats.average_rank(rows, c, out)
    return _rounded(stats.spearman(rows, "x", "y", "z"), "rho", "partial")


@_c.frame("equivalence_verdicts", """
SELECT l_returnflag AS flag, n, CASE WHEN (low > 0 OR high < 0) AND abs(point) >= 0.01e0 THEN 'effect present' WHEN low > -0.01e0 AND high < 0.01e0 THEN 'equivalent-to-null' ELSE 'underpowered' END AS verdict
FROM (SELECT l_returnflag, n, r AS point, tanh(atanh(r) - 1.96e0 / sqrt(n - 3)) AS low, tanh(atanh(r) + 1.96e0 / sqrt(n - 3)) AS high FROM (SELECT l_returnflag, count(*) AS n, corr(CAST(l_quantity AS DOUBLE), CAST(l_discount AS DOUBLE)) AS r FROM lineitem GROUP BY l_returnflag))
""")
def equivalence_verdicts(spark, sf_dir):
    """Whether quantity and discount are tied, by return flag, against the least correlation that matters."""
    r = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.corr(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")).alias("r"))
    ci = r.withColumn("ci", stats.fisher_interval(F.col("r"), F.col("n")))
    return ci.select("flag", "n", stats.verdict(F.col("r"), F.col("ci.low"), F.col("ci.high"), 0.01).alias("verdict"))


@_c.frame("hapax_not_listed", f"WITH {_FREQ}, b AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), '{_W}')) AS w FROM benchmark) SELECT lang, count(*) AS hapax, count_if(w NOT IN (SELECT w FROM b)) AS unlisted FROM f WHERE n = 1 GROUP BY lang")
def hapax_not_listed(spark, sf_dir):
    """Words seen once in a language, and those that no benchmark item has."""
    listed = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(text.tokens(F.col("text"))).alias("w")).distinct().withColumn("listed", F.lit(True))
    once = _freq(spark, sf_dir).where("n = 1").join(listed, "w", "left")
    return once.groupBy("lang").agg(F.count("*").alias("hapax"), F.count_if(F.col("listed").isNull()).alias("unlisted"))


@_c.frame("malformed_clusters", r"SELECT lang, CAST(sum(length_grapheme(coalesce(text, ''))) AS BIGINT) AS n, CAST(0 AS BIGINT) AS malformed FROM documents GROUP BY lang")
def malformed_clusters(spark, sf_dir):
    """Clusters that begin with a combining mark; these texts have none, tests/test_functions.py plants some."""
    g = segment.graphemes(F.col("text"))
    return _docs(spark, sf_dir).select("lang", F.size(g).cast("long").alias("n"), F.size(F.filter(g, segment.malformed)).cast("long").alias("m")).groupBy("lang").agg(F.sum("n").alias("n"), F.sum("m").alias("malformed"))


@_c.frame("noise_injection", r"""
WITH c AS (SELECT item_id, t, length(t) AS n FROM (SELECT item_id, coalesce(text, '') AS t FROM benchmark)),
u AS (SELECT item_id, i, substr(t, CAST(i + 1 AS BIGINT), 1) AS c, CAST(('0x' || substr(md5('n|' || i || '|' || substr(t, CAST(i + 1 AS BIGINT), 1)), 1, 10)) AS BIGINT) AS h FROM (SELECT item_id, t, unnest(range(n)) AS i FROM c)),
o AS (SELECT item_id, i, CASE WHEN h % 1048576 >= 104857 THEN c WHEN (h >> 20) % 3 = 0 THEN x WHEN (h >> 20) % 3 = 1 THEN '' ELSE c || x END AS y FROM (SELECT *, substr('abcdefghijklmnopqrstuvwxyz', (h >> 22) % 26 + 1, 1) AS x FROM u))
SELECT item_id, md5(string_agg(y, '' ORDER BY i)) AS digest FROM o GROUP BY item_id
""")
def noise_injection(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where(F.length("text") > 0)
    return items.select("item_id", F.md5(stats.noise(F.col("text"), 0.1, "n")).alias("digest"))


QUERIES, SQL = _c.QUERIES, _c.SQL
