"""Phrases, spans, compounds and tiers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import matching

from .base import Catalogue

_c = Catalogue()
_W = r"[^\x20\x09-\x0D]+"
_ITEMS = f"i AS (SELECT DISTINCT array_to_string(list_slice(ws, 1, 3), ' ') AS p FROM (SELECT regexp_extract_all(coalesce(text, ''), '{_W}') AS ws FROM benchmark) WHERE len(ws) >= 3), one AS (SELECT DISTINCT ws[4] AS p FROM (SELECT regexp_extract_all(coalesce(text, ''), '{_W}') AS ws FROM benchmark) WHERE len(ws) >= 4)"
_DOCS = f"d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS ws FROM documents)"
_TOKENS = "t AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM d)"


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _phrases(spark, sf_dir):
    ws = _t(spark, sf_dir, "benchmark").select(text.tokens(F.col("text")).alias("ws"))
    three = ws.where(F.size("ws") >= 3).select(F.array_join(F.slice("ws", 1, 3), " ").alias("p"))
    return three.unionByName(ws.where(F.size("ws") >= 4).select(F.get("ws", F.lit(3)).alias("p"))).distinct()


def _matches(spark, sf_dir):
    return matching.phrase_matches(_t(spark, sf_dir, "documents"), "doc_id", text.tokens(F.col("text")), _phrases(spark, sf_dir), "p", 3)


@_c.frame("phrase_all_matches", f"""
WITH {_ITEMS}, {_DOCS}, g AS (SELECT doc_id, array_to_string(list_slice(ws, k, k + 2), ' ') AS p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS k FROM d) UNION ALL SELECT doc_id, unnest(ws) FROM d)
SELECT p AS phrase, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM g WHERE p IN (SELECT p FROM i) OR p IN (SELECT p FROM one) GROUP BY p
""")
def phrase_all_matches(spark, sf_dir):
    """Every occurrence of a listed phrase in a document, overlaps included."""
    return _matches(spark, sf_dir).groupBy("phrase").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_docs"))


@_c.frame("phrase_longest_match", f"""
WITH RECURSIVE {_ITEMS}, {_DOCS},
m AS (SELECT doc_id, k - 1 AS s, k + 2 AS e, array_to_string(list_slice(ws, k, k + 2), ' ') AS p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS k FROM d) UNION ALL SELECT doc_id, unnest(range(len(ws))), unnest(range(1, len(ws) + 1)), unnest(ws) FROM d),
h AS (SELECT doc_id, s, max(e) AS e FROM m WHERE p IN (SELECT p FROM i) OR p IN (SELECT p FROM one) GROUP BY ALL),
n AS (SELECT h.doc_id, h.s, h.e, (SELECT min(x.s) FROM h x WHERE x.doc_id = h.doc_id AND x.s >= h.e) AS nxt FROM h),
r AS (SELECT doc_id, s, e, nxt FROM n WHERE s = (SELECT min(x.s) FROM h x WHERE x.doc_id = n.doc_id) UNION ALL SELECT n.doc_id, n.s, n.e, n.nxt FROM r JOIN n ON n.doc_id = r.doc_id AND n.s = r.nxt)
SELECT doc_id, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS covered, CAST(sum(s) AS BIGINT) AS starts FROM r GROUP BY doc_id
""")
def phrase_longest_match(spark, sf_dir):
    """The cover of each document by listed phrases: leftmost, then longest."""
    kept = matching.longest_matches(_matches(spark, sf_dir))
    return kept.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("covered"), F.sum("start").alias("starts"))


@_c.frame("anti_unmatched_tokens", f"""
WITH {_ITEMS}, {_DOCS}, {_TOKENS},
m AS (SELECT doc_id, k - 1 AS s, k + 2 AS e, array_to_string(list_slice(ws, k, k + 2), ' ') AS p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS k FROM d) UNION ALL SELECT doc_id, unnest(range(len(ws))), unnest(range(1, len(ws) + 1)), unnest(ws) FROM d),
c AS (SELECT DISTINCT doc_id, unnest(range(s, e)) AS pos FROM m WHERE p IN (SELECT p FROM i) OR p IN (SELECT p FROM one))
SELECT t.doc_id, count(*) AS n_free FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.pos = t.pos WHERE c.pos IS NULL GROUP BY t.doc_id
""")
def anti_unmatched_tokens(spark, sf_dir):
    """Tokens of each document that no listed phrase covers."""
    free = matching.count_uncovered(_t(spark, sf_dir, "documents"), "doc_id", text.tokens(F.col("text")), _matches(spark, sf_dir))
    return free.select(F.col("id").alias("doc_id"), F.col("n").alias("n_free"))


@_c.frame("nil_triage", f"""
WITH {_DOCS}, {_TOKENS}, b AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), '{_W}')) AS w FROM benchmark)
SELECT w AS nil, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc, CASE WHEN count(*) >= 10 THEN 'frequent' WHEN count(*) > 1 THEN 'rare' ELSE 'once' END AS triage FROM t WHERE w NOT IN (SELECT w FROM b) GROUP BY w
""")
def nil_triage(spark, sf_dir):
    """Tokens that the list lacks, by how often they are met."""
    toks = matching.token_table(_t(spark, sf_dir, "documents"), "doc_id", text.tokens(F.col("text")))
    listed = _t(spark, sf_dir, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("token")).distinct()
    n = F.count("*")
    return toks.join(listed, "token", "left_anti").groupBy(F.col("token").alias("nil")).agg(n.alias("n"), F.count_distinct("id").alias("n_docs"), F.min("id").alias("first_doc"), F.when(n >= 10, "frequent").when(n > 1, "rare").otherwise("once").alias("triage"))


@_c.frame("span_labels", """
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part), t AS (SELECT p_partkey, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM w),
l AS (SELECT p_partkey, pos, w, CASE WHEN w IN ('red', 'blue', 'green') THEN 'colour' WHEN pos = 0 THEN 'head' END AS type, CASE WHEN w IN ('red', 'blue', 'green') THEN 0 ELSE 1 END AS source FROM t)
SELECT type, source, count(*) AS n, count(DISTINCT p_partkey) AS n_parts FROM l WHERE type IS NOT NULL GROUP BY ALL
""")
def span_labels(spark, sf_dir):
    """Labels from a list of colours, and from a second source where the list leaves a place free."""
    part = _t(spark, sf_dir, "part")
    colours = spark.sql("SELECT * FROM VALUES ('red', 'colour'), ('blue', 'colour'), ('green', 'colour') AS t(surface, type)")
    heads = part.select(F.col("p_partkey").alias("id"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.substring_index("p_name", " ", 1).alias("surface"), F.lit("head").alias("type"))
    out = matching.label(part, "p_partkey", text.tokens(F.col("p_name")), colours, heads, 2)
    return out.groupBy("type", "source").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_parts"))


@_c.frame("quantity_spans", "SELECT l_linenumber, count(*) AS n, CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n_units, CAST(sum(CAST(l_quantity AS INT) + CASE WHEN l_linenumber % 2 = 0 THEN 7 ELSE 0 END) AS BIGINT) AS total FROM lineitem GROUP BY l_linenumber")
def quantity_spans(spark, sf_dir):
    """Units with their numbers out of running text, the number on either side."""
    q = F.col("l_quantity").cast("int").cast("string")
    prose = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("take tola "), q, F.lit(" and of the root 7 pala at dawn"))).otherwise(F.concat(q, F.lit(" tola, then rest")))
    rows = _t(spark, sf_dir, "lineitem").select("l_linenumber", matching.quantities(prose, ["tola", "pala"]).alias("u"))
    total = F.aggregate(F.transform("u", lambda x: x["number"].cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum(F.size("u")).alias("n_units"), F.sum(total).alias("total"))


@_c.frame("candidate_lookup", """
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), q AS (SELECT w || 's' AS q, w FROM w WHERE length(w) > 4 UNION SELECT 'un' || w, NULL FROM w)
SELECT q, w AS found FROM q
""")
def candidate_lookup(spark, sf_dir):
    """Inflected words, found by the first of their stems that the dictionary has."""
    w = _t(spark, sf_dir, "part").select(F.explode(text.tokens(F.col("p_name"))).alias("w")).distinct()
    asked = w.where(F.length("w") > 4).select(F.concat("w", F.lit("s")).alias("q")).unionByName(w.select(F.concat(F.lit("un"), "w").alias("q")))
    return matching.lookup(asked, "q", F.slice(matching.stems(F.col("q"), ("s",)), 2, 9), w.withColumn("v", F.col("w")), "w", "v").select("q", "found")


@_c.frame("compound_split", """
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), d AS (SELECT w FROM w WHERE length(w) >= 3),
q AS (SELECT DISTINCT a.w || b.w AS q FROM w a, w b WHERE length(a.w || b.w) BETWEEN 6 AND 22),
s AS (SELECT q, [a.w, b.w] AS p FROM q JOIN d a ON starts_with(q, a.w) JOIN d b ON q = a.w || b.w UNION SELECT q, [a.w, b.w, c.w] FROM q JOIN d a ON starts_with(q, a.w) JOIN d b ON starts_with(q, a.w || b.w) JOIN d c ON q = a.w || b.w || c.w)
SELECT q, array_to_string(arg_min(p, list_transform(p, lambda x: -length(x))), '+') AS parts FROM s GROUP BY q
""")
def compound_split(spark, sf_dir):
    """Words put together from two names, taken apart again by the dictionary of names."""
    w = _t(spark, sf_dir, "part").select(F.explode(text.tokens(F.col("p_name"))).alias("w")).distinct()
    asked = w.crossJoin(w.withColumnRenamed("w", "v")).select(F.concat("w", "v").alias("q"))  # a few dozen names each side
    return matching.compounds(asked, "q", w, "w")


@_c.frame("tier_match", """
WITH q AS (SELECT DISTINCT CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) || '.' WHEN 2 THEN lower(n_name) || 'm' ELSE left(n_name, length(n_name) - 1) || '#' END AS q FROM nation),
e AS (SELECT q, min(m.n_nationkey) AS target, 0 AS tier FROM q JOIN nation m ON m.n_name = q GROUP BY q),
d AS (SELECT q, min(m.n_nationkey) AS target, 1 AS tier FROM q JOIN nation m ON trim(regexp_replace(lower(q), '[.,;:()\\[\\]]', ' ', 'g')) = lower(m.n_name) WHERE q NOT IN (SELECT q FROM e) GROUP BY q),
s AS (SELECT q, min(m.n_nationkey) AS target, 2 AS tier FROM q JOIN nation m ON regexp_replace(trim(regexp_replace(lower(q), '[.,;:()\\[\\]]', ' ', 'g')), '[hmn]+$', '') = regexp_replace(lower(m.n_name), '[hmn]+$', '') WHERE q NOT IN (SELECT q FROM e UNION SELECT q FROM d) GROUP BY q),
l AS (SELECT q, min(m.n_nationkey) AS target, 3 AS tier FROM q JOIN nation m ON left(lower(m.n_name), 1) = left(lower(q), 1) AND abs(length(q) - length(m.n_name)) <= 1 AND levenshtein(lower(q), lower(m.n_name)) <= 1 WHERE q NOT IN (SELECT q FROM e UNION SELECT q FROM d UNION SELECT q FROM s) GROUP BY q)
SELECT q.q, x.target, x.tier FROM q LEFT JOIN (SELECT * FROM e UNION ALL SELECT * FROM d UNION ALL SELECT * FROM s UNION ALL SELECT * FROM l) x ON x.q = q.q
""")
def tier_match(spark, sf_dir):
    """Names spelt exactly, loosely, with a changed ending or an edit apart, each found in its tier."""
    n = _t(spark, sf_dir, "nation")
    name, k = F.col("n_name"), F.col("n_nationkey") % 4
    q = F.when(k == 0, name).when(k == 1, F.concat(F.lower(name), F.lit("."))).when(k == 2, F.concat(F.lower(name), F.lit("m"))).otherwise(F.concat(F.substring(name, F.lit(1), F.length(name) - 1), F.lit("#")))
    keys = (lambda c: c, text.deburr, lambda c: text.sandhi_strip(text.deburr(c)))
    return matching.tiers(n.select(q.alias("q")), "q", n.select("n_name", F.col("n_nationkey").alias("target")), "n_name", "target", keys)


@_c.frame("exclusive_nearest")
def exclusive_nearest(spark, sf_dir):
    """Clicks and purchases of a user paired one to one, the closest first, within an hour on either side."""
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    side = lambda kind, out: e.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(out), "at")
    return matching.greedy_pairs(side("click", "click_id"), side("purchase", "purchase_id"), "user_id", "at", ("click_id", "purchase_id"), 3600.0)


@_c.frame("lcs_ratios")
def lcs_ratios(spark, sf_dir):
    """Edit ratio with insertions and deletions only, between nations of one region."""
    n = _t(spark, sf_dir, "nation")
    pairs = n.select("n_regionkey", F.col("n_name").alias("a")).join(n.select("n_regionkey", F.col("n_name").alias("b")), "n_regionkey").where("a < b")
    return pairs.select("a", "b", F.round(text.lcs_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


QUERIES, SQL = _c.QUERIES, _c.SQL
