"""Zones, row kinds, gutters, markers, tables of numbers and unit tables over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from weftline.functions import segment, text
from weftline.operators import layout, matching, stats
from weftline.sources import readers

from .base import Catalogue

_c = Catalogue()
_W = r"[^\x20\x09-\x0D]+"


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_c.frame("layout_zones", "SELECT p_partkey, array_to_string(list_slice(ws, 1, 1), ' ') AS entry, array_to_string(list_slice(ws, 2, 99), ' ') AS content FROM (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part)")
def layout_zones(spark, sf_dir):
    """Texts of two bands of a row."""
    w = F.transform(text.tokens(F.col("p_name")), lambda t, i: F.struct((i * 0.2).alias("x"), F.lit(0).alias("block"), t.alias("text")))
    return layout.zones(_t(spark, sf_dir, "part").select("p_partkey", w.alias("w")), {"entry": (0.0, 0.15), "content": (0.15, 9.0)}).drop("w")


@_c.frame("row_kinds", "SELECT CASE p_partkey % 4 WHEN 0 THEN 'entry' WHEN 1 THEN 'label' WHEN 2 THEN 'content' ELSE 'blank' END AS kind, CASE WHEN p_partkey % 4 = 1 THEN 'dose' END AS field, count(*) AS n FROM part GROUP BY ALL")
def row_kinds(spark, sf_dir):
    k = F.col("p_partkey") % 4
    kind = layout.row_kind(F.when(k == 0, F.concat(F.col("p_partkey").cast("string"), F.lit(". "))), F.when(k == 1, "Dose :-").otherwise(""), F.when(k == 2, F.col("p_name")), {"Dose": "dose", "Use": "use"})
    return _t(spark, sf_dir, "part").select(kind.alias("k")).groupBy("k.kind", "k.field").agg(F.count("*").alias("n"))


@_c.frame("page_gutters", "SELECT p_partkey % 8 AS page, round(61 / 120e0, 6) AS gutter, count_if(p_partkey % 16 >= 8) AS n_right, count(*) AS n FROM part GROUP BY 1")
def page_gutters(spark, sf_dir):
    """The gutter of pages in two columns, and how many words stand right of it."""
    x = F.when(F.col("p_partkey") % 16 < 8, 0.1).otherwise(0.7) + (F.col("p_size") % 10) / 50
    w = _t(spark, sf_dir, "part").select((F.col("p_partkey") % 8).alias("page"), x.alias("x"))
    g = layout.gutter(w, ["page"])
    return layout.reading_order(w, g, ["page"]).join(g, "page").groupBy("page").agg(F.round(F.min("gutter"), 6).alias("gutter"), F.count_if(F.col("column") == 1).alias("n_right"), F.count("*").alias("n"))


@_c.frame("section_carry", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events")
def section_carry(spark, sf_dir):
    mark = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return layout.carry_section(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], mark).select("event_id", "section")


@_c.frame("monotone_markers", """
SELECT o_custkey, count(*) AS n, count_if(k >= coalesce(top, 0) - 100) AS n_accepted FROM (SELECT o_custkey, o_orderkey % 300 AS k, max(o_orderkey % 300) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM orders) GROUP BY o_custkey
""")
def monotone_markers(spark, sf_dir):
    """Which of a customer's numbers keep the count."""
    per = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ks"))
    marks = F.transform("ks", lambda k: F.struct((k % 300).alias("n"), F.lit(False).alias("embedded")))
    return per.select("o_custkey", F.size("ks").cast("long").alias("n"), F.size(F.filter(layout.monotone_marks(marks), lambda x: x)).cast("long").alias("n_accepted"))


@_c.frame("numbered_table", """
WITH r AS (SELECT p_partkey % 5 AS book, p_partkey, p_name, p_type, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS INT) END AS m FROM part), l AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY book ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS n FROM r)
SELECT book, n, string_agg(p_name, ' ' ORDER BY p_partkey) AS left, string_agg(p_type, ' ' ORDER BY p_partkey) AS right FROM l WHERE n IS NOT NULL GROUP BY book, n
""".replace(" AS left", ' AS "left"').replace(" AS right", ' AS "right"'))
def numbered_table(spark, sf_dir):
    """A table of two sides whose rows a number opens."""
    left = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_partkey").cast("string"), F.lit(". "), F.col("p_name"))).otherwise(F.col("p_name"))
    rows = _t(spark, sf_dir, "part").select((F.col("p_partkey") % 5).alias("book"), "p_partkey", left.alias("l"), F.col("p_type").alias("r"))
    return layout.numbered_rows(rows, ["book"], ["p_partkey"], "l", "r")


@_c.frame("continuation_merge", """
WITH l AS (SELECT conv_id, turn, coalesce(text, '') AS text, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM conversations)
SELECT conv_id, g AS "group", md5(string_agg(text, ' ' ORDER BY turn, text)) AS digest FROM l GROUP BY conv_id, g
""")
def continuation_merge(spark, sf_dir):
    """Turns that start no new entry joined to the entry before."""
    t = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return layout.continuations(t, ["conv_id"], "turn", F.col("role") == "user", "text").select("conv_id", "group", F.md5("text").alias("digest"))


@_c.frame("stranded_words", "SELECT l_orderkey, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o_orderstatus = 'F') GROUP BY l_orderkey")
def stranded_words(spark, sf_dir):
    """Lines that no finished order claims."""
    claimed = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return layout.stranded(_t(spark, sf_dir, "lineitem"), claimed, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@_c.frame("better_readings", """
WITH a AS (SELECT user_id AS page, min(value) AS confidence, 'first' AS reading FROM events GROUP BY user_id), b AS (SELECT user_id AS page, CAST(user_id % 7 AS DOUBLE) AS confidence, 'second' AS reading FROM events GROUP BY user_id)
SELECT a.page, CASE WHEN b.confidence > a.confidence THEN b.confidence ELSE a.confidence END AS confidence, CASE WHEN b.confidence > a.confidence THEN b.reading ELSE a.reading END AS reading FROM a JOIN b ON a.page = b.page
""")
def better_readings(spark, sf_dir):
    """Of two readings of a page the surer one, the first where they are equal."""
    e = _t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("page")).agg(F.min("value").alias("confidence"))
    second = e.select("page", (F.col("page") % 7).cast("double").alias("confidence"), F.lit("second").alias("reading"))
    return readers.keep_better(e.withColumn("reading", F.lit("first")), second)


@_c.frame("clause_final_concentration", rf"""
WITH c AS (SELECT lang, unnest(regexp_split_to_array(text, '[.।॥]')) AS c FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, list_filter(list_transform(regexp_extract_all(c, '{_W}'), lambda w: regexp_replace(regexp_replace(w, '^[^\p{{L}}\p{{M}}]+', ''), '[^\p{{L}}\p{{M}}]+$', '')), lambda w: w <> '')[-1] AS w FROM c),
f AS (SELECT lang, w, count(*) AS n FROM w WHERE w IS NOT NULL GROUP BY ALL), p AS (SELECT lang, n / CAST(sum(n) OVER (PARTITION BY lang) AS DOUBLE) AS p FROM f)
SELECT lang, round(-sum(p * log2(p)), 6) AS entropy, round(-sum(p * log2(p)) / log2(count(*)), 6) AS normalised FROM p GROUP BY lang
""")
def clause_final_concentration(spark, sf_dir):
    """How concentrated the words are that end clauses."""
    c = _t(spark, sf_dir, "documents").select("lang", F.explode(text.clauses(F.col("text"))).alias("c")).select("lang", text.last_word(F.col("c")).alias("w"))
    return stats.entropy(stats.counts(c, "lang", "w"), "lang").select("lang", F.round("entropy", 6).alias("entropy"), F.round("normalised", 6).alias("normalised"))


@_c.frame("unit_table", rf"""
WITH t AS (SELECT coalesce(text, '') AS t FROM documents), u AS (SELECT 'word' AS kind, unnest(regexp_extract_all(t, '{_W}')) AS u FROM t UNION ALL SELECT 'codepoint', unnest(regexp_extract_all(t, '(?s).')) FROM t),
f AS (SELECT kind, u, count(*) AS n FROM u GROUP BY ALL), p AS (SELECT kind, n, n / CAST(sum(n) OVER (PARTITION BY kind) AS DOUBLE) AS p FROM f)
SELECT kind, CAST(sum(n) AS BIGINT) AS n_units, count(*) AS vocabulary, round(-sum(p * log2(p)) / log2(count(*)), 6) AS efficiency FROM p GROUP BY kind
""")
def unit_table(spark, sf_dir):
    """Units, vocabulary and efficiency of each way to cut the corpus."""
    docs = _t(spark, sf_dir, "documents")
    rows = reduce(lambda a, b: a.unionByName(b), (docs.select(F.lit(k).alias("kind"), F.explode(segment.units(F.col("text"), k)).alias("u")) for k in ("word", "codepoint")))
    freq = stats.counts(rows, "kind", "u")
    v = stats.vocabulary(freq, "kind").select("kind", F.col("n_tokens").alias("n_units"), F.col("n_types").alias("vocabulary"))
    return v.join(stats.entropy(freq, "kind"), "kind").select("kind", "n_units", "vocabulary", F.round("normalised", 6).alias("efficiency"))


@_c.frame("term_resolution", """
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), q AS (SELECT w AS q, 'direct' AS method FROM w UNION ALL SELECT 'q' || w, NULL FROM w UNION ALL SELECT w || max(w) OVER () , 'compound' FROM w)
SELECT method, count(*) AS n FROM q GROUP BY method
""")
def term_resolution(spark, sf_dir):
    """Terms found as they stand, as compounds of known words, or not at all."""
    w = _t(spark, sf_dir, "part").select(F.explode(text.tokens(F.col("p_name"))).alias("w")).distinct()
    last = w.agg(F.max("w").alias("m"))  # one row
    asked = w.select(F.col("w").alias("q")).unionByName(w.select(F.concat(F.lit("q"), "w").alias("q"))).unionByName(w.crossJoin(F.broadcast(last)).select(F.concat("w", "m").alias("q")))
    direct = matching.lookup(asked, "q", F.array("q"), w.withColumn("v", F.col("w")), "w", "v")
    split = matching.compounds(direct.where("found IS NULL"), "q", w, "w")
    method = F.when(F.col("found").isNotNull(), "direct").when(F.col("parts").isNotNull(), "compound")
    return direct.join(split, "q", "left").groupBy(method.alias("method")).agg(F.count("*").alias("n"))


@_c.frame("name_unions", "SELECT p_type, string_agg(DISTINCT w, ',' ORDER BY w) AS names, count(DISTINCT w) AS n FROM (SELECT p_type, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY p_type")
def name_unions(spark, sf_dir):
    """Arrays of names of one key as one array without repeats."""
    rows = _t(spark, sf_dir, "part").select("p_type", F.explode(text.tokens(F.col("p_name"))).alias("w")).distinct()
    return rows.groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_list("w")), ",").alias("names"), F.count("*").alias("n"))


@_c.frame("content_tokens", rf"""
WITH w AS (SELECT lang, trim(unnest(regexp_extract_all(coalesce(text, ''), '{_W}')), ' .,;:-–()[]"''|') AS w FROM documents)
SELECT lang, count_if(length(w) >= 2 AND regexp_matches(w, '\p{{L}}') AND lower(w) NOT IN ('the', 'der', 'la')) AS n_content, count(*) AS n FROM w GROUP BY lang
""")
def content_tokens(spark, sf_dir):
    w = _t(spark, sf_dir, "documents").select("lang", F.explode(text.tokens(F.col("text"))).alias("w"))
    return w.groupBy("lang").agg(F.count_if(text.content_token(F.col("w"), ("the", "der", "la"))).alias("n_content"), F.count("*").alias("n"))


@_c.frame("plausible_names", "SELECT count_if(regexp_matches(c_name, '^[A-Z][a-z]{2,} [a-z][a-z-]{2,}$')) AS n_names, count_if(p_ok) AS n_parts FROM (SELECT c_name, FALSE AS p_ok FROM customer UNION ALL SELECT '', regexp_matches(upper(left(p_name, 1)) || substr(p_name, 2), '^[A-Z][a-z]{2,} [a-z][a-z-]{2,}$') FROM part)")
def plausible_names(spark, sf_dir):
    names = _t(spark, sf_dir, "customer").select(F.lit("c").alias("k"), F.col("c_name").alias("s"))
    parts = _t(spark, sf_dir, "part").select(F.lit("p").alias("k"), F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring("p_name", 2, 99)).alias("s"))
    ok = text.plausible_binomial(F.col("s"))
    return names.unionByName(parts).agg(F.count_if(ok & (F.col("k") == "c")).alias("n_names"), F.count_if(ok & (F.col("k") == "p")).alias("n_parts"))


QUERIES, SQL = _c.QUERIES, _c.SQL
