"""Streams, learning, layout and the graph builder over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import kg, layout, learn, stats
from weftline.streaming import streams

from . import ordered
from .base import Catalogue
from .textual import REGISTRY

_c = Catalogue()
_W = r"[^\x20\x09-\x0D]+"


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_c.frame("session_stream", ordered.SQL["session_windows"])
def session_stream(spark, sf_dir):
    """Sessions of users out of a stream of events; the batch form is `session_windows`."""
    found = streams.sessions(streams.follow(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "30 minutes", "1 day")
    out = streams.drain(found, "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start_ts"), "n")


@_c.frame("tumbling_stream", ordered.SQL["tumbling_windows"])
def tumbling_stream(spark, sf_dir):
    rows = streams.follow(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.drain(streams.windows(rows, "ts", "event_type", "1 hour", None, "1 day"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start_ts"), "event_type", "n")


@_c.frame("sliding_stream", """
SELECT start_ts, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS start_ts FROM events, range(4) q(k)) GROUP BY ALL
""")
def sliding_stream(spark, sf_dir):
    """Windows of an hour every quarter of an hour."""
    rows = streams.follow(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.drain(streams.windows(rows, "ts", "event_type", "1 hour", "15 minutes", "1 day"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start_ts"), "event_type", "n")


@_c.frame("resume_dedupe_stream", "SELECT event_id, min(event_type) AS event_type FROM events GROUP BY event_id")
def resume_dedupe_stream(spark, sf_dir):
    """Each event once, of a stream that brings all of them twice."""
    one = streams.follow(spark, f"{sf_dir}/events.parquet").select("event_id", "event_type")
    return streams.drain(streams.unseen(one.unionByName(one), ["event_id"]))


@_c.frame("carried_records_stream", """
WITH c AS (SELECT conv_id, turn, text, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS record FROM conversations),
l AS (SELECT conv_id, max(record) AS last FROM c GROUP BY conv_id)
SELECT c.conv_id, CAST(count(DISTINCT record) AS BIGINT) AS n_closed FROM c JOIN l ON l.conv_id = c.conv_id AND c.record < l.last WHERE record > 0 GROUP BY c.conv_id
""")
def carried_records_stream(spark, sf_dir):
    """Records that a user's turn opens, closed by the next one; what is open at the end stays in the stream's state."""
    rows = streams.follow(spark, f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(F.col("role") == "user", "user").alias("mark"), "text")
    out = streams.drain(streams.carried(rows, "conv_id", "turn", "mark", "text"))
    return out.where("record > 0").groupBy("conv_id").agg(F.count_distinct("record").alias("n_closed"))


@_c.frame("kfold_logreg")
def kfold_logreg(spark, sf_dir):
    """Quality of documents predicted over three folds by hashed words; precision, recall and F of each class."""
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels").where("quality IS NOT NULL"), "doc_id").select("doc_id", F.col("quality").alias("label"), text.tokens(F.lower("text")).alias("x"))
    return learn.report(learn.cross_validate(rows, "doc_id", "x", "label", 3, 20), "label", "prediction")


@_c.frame("token_feature_counts", r"""
WITH t AS (SELECT p_partkey, lower(unnest(ws)) AS w, unnest(range(len(ws))) AS pos FROM (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part)),
n AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY p_partkey ORDER BY pos), '<s>') AS b FROM t)
SELECT 'p2=' || left(w, 2) AS feature, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'bs3=' || right(b, 3), count(*) FROM n GROUP BY ALL
""")
def token_feature_counts(spark, sf_dir):
    """How often two of the feature kinds take each value."""
    toks = _t(spark, sf_dir, "part").select("p_partkey", F.posexplode(text.tokens(F.col("p_name"))).alias("at", "w"))
    f = learn.token_features(toks, "p_partkey", "at", "w").select(F.explode("features").alias("feature"))
    return f.where("feature LIKE 'p2=%' OR feature LIKE 'bs3=%'").groupBy("feature").agg(F.count("*").alias("n"))


@_c.frame("distant_labels", """
SELECT count(*) AS n, round(avg(CASE WHEN length(text) < 40 OR length(text) > 400 THEN 1e0 ELSE 0e0 END), 6) AS coverage,
  round(avg(CASE WHEN quality IS NOT NULL AND length(text) < 40 THEN CASE WHEN quality = 0 THEN 1e0 ELSE 0e0 END WHEN quality IS NOT NULL AND length(text) > 400 THEN CASE WHEN quality = 1 THEN 1e0 ELSE 0e0 END END), 6) AS agreement
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
def distant_labels(spark, sf_dir):
    """Labels from length alone: how many documents they reach, and how often they are right."""
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left").withColumn("guess", F.when(F.length("text") < 40, 0).when(F.length("text") > 400, 1))
    return learn.distant_quality(rows, "quality", "guess").select("n", F.round("coverage", 6).alias("coverage"), F.round("agreement", 6).alias("agreement"))


@_c.frame("class_report", """
WITH p AS (SELECT quality AS l, CASE WHEN length(text) < 100 THEN 0 ELSE 1 END AS p FROM documents d JOIN labels b ON b.doc_id = d.doc_id WHERE quality IS NOT NULL), k(class) AS (VALUES (0), (1))
SELECT class, count(*) FILTER (WHERE l = class) AS support, round(coalesce(count(*) FILTER (WHERE l = class AND p = class) / nullif(CAST(count(*) FILTER (WHERE p = class) AS DOUBLE), 0), 0), 6) AS precision,
  round(coalesce(count(*) FILTER (WHERE l = class AND p = class) / nullif(CAST(count(*) FILTER (WHERE l = class) AS DOUBLE), 0), 0), 6) AS recall,
  round(coalesce(2e0 * count(*) FILTER (WHERE l = class AND p = class) / nullif(CAST(count(*) FILTER (WHERE l = class) + count(*) FILTER (WHERE p = class) AS DOUBLE), 0), 0), 6) AS f1 FROM p, k GROUP BY class
""")
def class_report(spark, sf_dir):
    """Support, precision, recall and F of a rule by length."""
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels").where("quality IS NOT NULL"), "doc_id").select(F.col("quality").cast("int").alias("l"), F.when(F.length("text") < 100, 0).otherwise(1).alias("p"))
    r = learn.report(rows, "l", "p")
    return r.select("class", F.col("support").cast("long").alias("support"), *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@_c.frame("layout_records", """
SELECT c_custkey, c_mktsegment AS name, 'n' || c_nationkey || ' more' AS label_a, c_name AS label_b FROM customer
""")
def layout_records(spark, sf_dir):
    """Records read back from rows laid out as entries, labels and content, over pages."""
    c = _t(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    line = lambda at, kind, field, t: F.struct(F.lit(at).alias("at"), F.lit(kind).alias("kind"), F.lit(field).cast("string").alias("field"), t.alias("t"))
    blank = F.lit("")
    rows = c.select((key % 16).alias("book"), key.alias("c_custkey"), F.explode(F.array(
        line(0, "entry", None, F.col("c_mktsegment")), line(1, "label", "a", F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))), line(2, "content", None, F.lit("more")), line(3, "blank", None, blank), line(4, "label", "b", F.col("c_name")),
    )).alias("x")).select("book", "c_custkey", "x.*")
    laid = layout.records(rows, ["book"], ["c_custkey", "at"], "kind", "field", "t")
    first = c.select((key % 16).alias("book"), key.alias("c_custkey")).select("*", F.row_number().over(Window.partitionBy("book").orderBy("c_custkey")).alias("record"))
    return first.join(laid, ["book", "record"]).select("c_custkey", F.col("fields")["name"].alias("name"), F.col("fields")["a"].alias("label_a"), F.col("fields")["b"].alias("label_b"))


@_c.frame("visual_rows", """
SELECT CAST(user_id AS BIGINT) AS user_id, count(*) AS n_rows FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR epoch(ts) - epoch(p) > 3600 GROUP BY user_id
""")
def visual_rows(spark, sf_dir):
    """Words of a page (events of a user, time as height) joined to rows by their gaps."""
    w = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("double").alias("x"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("y"), F.col("event_type").alias("text"))
    return layout.visual_rows(w, ["user_id"], 3600.0).groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.count_distinct("row").alias("n_rows"))


@_c.frame("ingredient_parts", "SELECT p_partkey, p_name AS name, 'tola' AS unit, p_size || ' dry' AS amount FROM part")
def ingredient_parts(spark, sf_dir):
    words = text.tokens(F.concat(F.col("p_name"), F.lit(" tea spoon tola "), F.col("p_size").cast("string"), F.lit(" dry")))
    merged = F.filter(layout.merge_units(words, {("tea", "spoon"): "teaspoon"}), lambda t: t != "teaspoon")
    return _t(spark, sf_dir, "part").select("p_partkey", layout.parse_ingredient(merged, ["tola"]).alias("i")).select("p_partkey", "i.name", "i.unit", "i.amount")


@_c.frame("verse_markers")
def verse_markers(spark, sf_dir):
    """Numbered entries of each conversation's text, by marks that keep the count."""
    turns = _t(spark, sf_dir, "conversations").select("conv_id", F.concat(F.col("turn").cast("string"), F.lit(". "), F.coalesce("text", F.lit(""))).alias("line"), "turn")
    whole = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("t"))
    return whole.select("conv_id", F.explode(layout.verses(F.col("t"))).alias("v")).select("conv_id", "v.n", F.length("v.body").cast("long").alias("chars"))


def _graph(spark, sf_dir):
    lines, orders, part = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "part")
    named = lines.join(part.select("p_partkey", F.substring_index("p_name", " ", 1).alias("w")), F.col("l_partkey") == F.col("p_partkey"))
    items = named.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("w").alias("name"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" tola")).alias("quantity"))).alias("ingredients"))
    entries = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(F.lit("o").alias("doc"), F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("name"), "ingredients", F.lower("o_orderstatus").alias("indications"), F.lit("with warm milk").alias("vehicle"))
    lexicon = part.select(F.substring_index("p_name", " ", 1).alias("surface")).distinct().select("surface", F.upper("surface").alias("lemma"), F.lit("plant").alias("kind"))
    ills = spark.sql("SELECT * FROM VALUES ('f', 'D1', 'exact'), ('o', 'D2', 'exact'), ('p', 'D3', NULL) AS t(surface, code, matched_via)")
    props = lexicon.where("surface < 'c'").select("lemma", F.lit("taste").alias("property"), F.array(F.lit("sweet"), F.lit("sour")).alias("value"))
    subs = lexicon.select("surface", F.concat(F.col("surface"), F.lit(", zzz = note")).alias("with"))
    return kg.build(kg.Inputs(entries, lexicon, ills, props, subs), REGISTRY, (("T", "urgent"), ("M", "medium")), (("milk", "milk"), ("warm milk", "warm milk")))


_KG = """w AS (SELECT l_orderkey AS o, split_part(p_name, ' ', 1) AS w FROM lineitem JOIN part ON p_partkey = l_partkey), l AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part), f AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT o FROM w)), d AS (SELECT DISTINCT o, w FROM w)"""


@_c.frame("graph_counts", f"""
WITH {_KG}
SELECT 'CONTAINS' AS type, count(*) AS n FROM d UNION ALL SELECT 'IS_TYPE', count_if(o_orderpriority LIKE '%T' OR o_orderpriority LIKE '%M') FROM f UNION ALL SELECT 'DOSED_WITH', count(*) FROM f
UNION ALL SELECT 'TREATS', count_if(lower(o_orderstatus) IN ('f', 'o')) FROM f UNION ALL SELECT 'HAS_PROPERTY', 2 * count(*) FROM l WHERE w < 'c' UNION ALL SELECT 'SUBSTITUTES_FOR', count(*) FROM l
UNION ALL SELECT 'CO_OCCURS', least(200, count(*)) FROM (SELECT a.w, b.w FROM d a JOIN d b ON a.o = b.o AND a.w < b.w GROUP BY a.w, b.w HAVING count(*) >= 3)
""")
def graph_counts(spark, sf_dir):
    """The whole graph built from orders as formulas; how many edges of each type it has."""
    return _graph(spark, sf_dir)[1].groupBy("type").agg(F.count("*").alias("n"))


@_c.frame("graph_ends", "SELECT CAST(0 AS BIGINT) AS n_missing, CAST(count(*) AS BIGINT) AS n_domain FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part)")
def graph_ends(spark, sf_dir):
    """Edges that a schema with one wrong domain forbids, and edges without an end: none."""
    nodes, edges = _graph(spark, sf_dir)
    allowed = [("CONTAINS", "Formula", "Ingredient"), ("IS_TYPE", "Formula", "PreparationType"), ("DOSED_WITH", "Formula", "Vehicle"), ("TREATS", "Formula", "Disease"), ("HAS_PROPERTY", "Ingredient", "Property"), ("SUBSTITUTES_FOR", "Formula", "Ingredient"), ("CO_OCCURS", "Ingredient", "Ingredient")]
    bad = kg.ends(nodes, edges, allowed)
    return bad.agg(F.count_if(F.col("why").isin("source missing", "target missing")).alias("n_missing"), F.count_if(F.col("why") == "domain").alias("n_domain"))


@_c.frame("average_rank_buckets", "SELECT l_quantity AS q, min(r) AS r FROM (SELECT l_quantity, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2e0 AS r FROM lineitem) GROUP BY l_quantity")
def average_rank_buckets(spark, sf_dir):
    """Ranks with ties over distinct values in buckets; no task holds the table."""
    q = _t(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q"))
    return stats.average_rank(q, "q", "r").groupBy("q").agg(F.min("r").alias("r"))


QUERIES, SQL = _c.QUERIES, _c.SQL
