"""Index blocks, splits, gaps, levels and graph exports as callables over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import kg, learn, stats
from weftline.sources import readers, writers

from .base import Catalogue

_c = Catalogue()


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_c.frame("inverted_index", """
SELECT w AS word, CAST(p_partkey // 512 AS BIGINT) AS block, count(*) AS n, string_agg(p_partkey, ',' ORDER BY p_partkey) AS parts FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY ALL
""")
def inverted_index(spark, sf_dir):
    """Postings of each word in blocks of ids, so that no word is one row however frequent it is."""
    rows = _t(spark, sf_dir, "part").select("p_partkey", F.explode(text.tokens(F.col("p_name"))).alias("word")).distinct()
    block = F.floor(F.col("p_partkey") / 512).cast("long")
    return rows.groupBy("word", block.alias("block")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("p_partkey")), ",").alias("parts"))


@_c.frame("average_rank", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2e0 AS avg_rank FROM part")
def average_rank(spark, sf_dir):
    return stats.average_rank(_t(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", "avg_rank").select("p_partkey", "avg_rank")


@_c.frame("train_test_split", "SELECT doc_id, CASE WHEN CAST(('0x' || substr(md5('3|' || doc_id), 1, 7)) AS BIGINT) % 100 < 85 THEN 'train' ELSE 'test' END AS part FROM documents")
def train_test_split(spark, sf_dir):
    """85 of 100 hash classes of ids train; no row is moved for it."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.when(learn.fold(F.col("doc_id"), 100, "3") < 85, "train").otherwise("test").alias("part"))


@_c.frame("kfold_assign", "SELECT doc_id, CAST(('0x' || substr(md5('5|' || doc_id), 1, 7)) AS BIGINT) % 5 AS fold FROM labels")
def kfold_assign(spark, sf_dir):
    return _t(spark, sf_dir, "labels").select("doc_id", learn.fold(F.col("doc_id"), 5, "5").alias("fold"))


@_c.frame("numbering_gaps", "SELECT * FROM (SELECT o_custkey, o_orderkey AS after, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - o_orderkey - 1 AS missing FROM orders) WHERE missing > 0")
def numbering_gaps(spark, sf_dir):
    """Where a customer's order numbers leap, and by how many."""
    leap = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - F.col("o_orderkey") - 1
    return _t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("after"), leap.alias("missing")).where("missing > 0")


def _tree(spark, sf_dir):
    n, c = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "customer")
    key = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))
    down = n.select(key("region", "n_regionkey").alias("parent"), key("nation", "n_nationkey").alias("child"))
    below = c.select(key("nation", "c_nationkey").alias("parent"), key("customer", "c_custkey").alias("child"))
    back = c.select(key("customer", "c_custkey").alias("parent"), F.lit("region:0").alias("child"))
    return down.unionByName(below).unionByName(back)


@_c.frame("graph_levels", """
SELECT level, count(*) AS n FROM (SELECT 0 AS level, 'region:1' AS node UNION ALL SELECT 1, 'nation:' || n_nationkey FROM nation WHERE n_regionkey = 1
UNION ALL SELECT 2, 'customer:' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 3, 'region:0'
UNION ALL SELECT 4, 'nation:' || n_nationkey FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 5, 'customer:' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 0) GROUP BY level
""")
def graph_levels(spark, sf_dir):
    """A crawl from one region over nations and customers, who all lead back to another region: levels, each node once."""
    roots = spark.sql("SELECT 'region:1' AS node")
    return readers.tree_levels(_tree(spark, sf_dir), roots).groupBy("level").agg(F.count("*").alias("n"))


def _small_graph(spark, sf_dir):
    """Nations and regions; names hold quotes and backslashes, as real ones may."""
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    props = lambda c: F.create_map(F.lit("name"), F.concat(F.lit('O\'"\\'), F.col(c)), F.lit("none"), F.lit(None).cast("string"))
    key = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))
    nodes = n.select(key("nation", "n_nationkey").alias("id"), F.lit("Nation").alias("type"), props("n_name").alias("props")).unionByName(r.select(key("region", "r_regionkey").alias("id"), F.lit("Region").alias("type"), props("r_name").alias("props")))
    edges = n.select(key("nation", "n_nationkey").alias("src"), key("region", "n_regionkey").alias("dst"), F.lit("IN").alias("type"), F.create_map().cast("map<string,string>").alias("props"))
    return nodes, edges


_BOTH = "n AS (SELECT 'nation:' || n_nationkey AS id, 'Nation' AS type, n_name AS name FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'Region', r_name FROM region), e AS (SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst FROM nation)"


@_c.frame("edges_jsonld", f"""WITH {_BOTH} SELECT '{{"@id":"' || id || '","@type":"' || type || '","name":"O''\\"\\\\' || name || '"}}' AS value FROM n UNION ALL SELECT '{{"@type":"IN","from":"' || src || '","to":"' || dst || '"}}' FROM e""")
def edges_jsonld(spark, sf_dir):
    """The lines of the graph as one document's items."""
    return writers.graph_lines(*_small_graph(spark, sf_dir), "{}")[0]


@_c.frame("cypher_merge", f"""WITH {_BOTH} SELECT 0 AS part, 'CREATE CONSTRAINT IF NOT EXISTS FOR (n:`' || type || '`) REQUIRE n.id IS UNIQUE;' AS value FROM (SELECT DISTINCT type FROM n)
UNION ALL SELECT 1, 'MERGE (n:`' || type || '` {{id: ''' || id || '''}}) SET n += {{`name`: ''O\\''"\\\\' || name || '''}};' FROM n
UNION ALL SELECT 2, 'MATCH (a {{id: ''' || src || '''}}), (b {{id: ''' || dst || '''}}) MERGE (a)-[r:`IN`]->(b);' FROM e""")
def cypher_merge(spark, sf_dir):
    return writers.cypher(*_small_graph(spark, sf_dir))


@_c.frame("triples_turtle", f"""WITH {_BOTH} SELECT '<http://weft/' || replace(id, ':', '%3A') || '> <http://weft/type> "' || type || '" .' AS value FROM n
UNION ALL SELECT '<http://weft/' || replace(id, ':', '%3A') || '> <http://weft/name> "O''\\"\\\\' || name || '" .' FROM n
UNION ALL SELECT '<http://weft/' || replace(src, ':', '%3A') || '> <http://weft/IN> <http://weft/' || replace(dst, ':', '%3A') || '> .' FROM e""")
def triples_turtle(spark, sf_dir):
    return writers.turtle(writers.triples(*_small_graph(spark, sf_dir)), "http://weft/")


@_c.frame("report_lines", f"""WITH {_BOTH}, c AS (SELECT type, count(*) AS n FROM n GROUP BY type)
SELECT '<h2>edges</h2><table><tr><td>IN</td><td>' || (SELECT count(*) FROM e) || '.0</td></tr></table>' AS value UNION ALL SELECT '<h2>nodes</h2><table>' || string_agg('<tr><td>' || type || '</td><td>' || n || '.0</td></tr>', '' ORDER BY type) || '</table>' FROM c""")
def report_lines(spark, sf_dir):
    """Counts of the graph as a report of tables."""
    return writers.html(kg.summary(*_small_graph(spark, sf_dir)).where("section <> 'dosage'"))


@_c.frame("corpus_terms", "SELECT 'name' AS field, w AS term, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w UNION ALL SELECT 'type', p_type, count(*) FROM part GROUP BY p_type")
def corpus_terms(spark, sf_dir):
    return readers.terms(_t(spark, sf_dir, "part"), {"name": text.tokens(F.col("p_name")), "type": F.array("p_type")})


@_c.frame("entry_prose", "SELECT p_partkey, 'name :- ' || p_name || CASE WHEN p_size % 2 = 0 THEN '. type :- ' || p_type ELSE '' END AS prose FROM part")
def entry_prose(spark, sf_dir):
    """Records as running text, empty fields left out."""
    return readers.prose(_t(spark, sf_dir, "part"), {"name": F.col("p_name"), "type": F.when(F.col("p_size") % 2 == 0, F.col("p_type"))}).select("p_partkey", "prose")


QUERIES, SQL = _c.QUERIES, _c.SQL
