"""Counts, presence, dedupe families, first-wins merges, set operations, ordering, joins and rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import joins

from .base import Catalogue

_c = Catalogue()
_b = _c.both
# a total order of the lines: the key and line number alone repeat
_SEQ = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice"


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_c.frame("type_counts_rollup", "SELECT p_type, l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders FROM lineitem l JOIN part p ON l_partkey = p_partkey GROUP BY ROLLUP (p_type, l_returnflag)")
def type_counts_rollup(spark, sf_dir):
    """Lines and orders by type and flag, by type, and in all.

    One shuffle, by order: orders are told apart within it at each level, so that nothing is made once a level and once a
    count before it moves, as ROLLUP with DISTINCT does.
    """
    lines = _t(spark, sf_dir, "lineitem")
    rows = lines.join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_type", "l_returnflag")
    each = rows.repartition(joins.tasks(spark, lines.count()), "l_orderkey").groupBy("l_orderkey", "p_type", "l_returnflag").agg(F.count("*").alias("n"))
    levels = []
    for keys in (["p_type", "l_returnflag"], ["p_type"], []):
        orders = each.groupBy("l_orderkey", *keys).agg(F.sum("n").alias("n")) if len(keys) < 2 else each
        own = [F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in ("p_type", "l_returnflag")]
        levels.append(orders.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("l_orderkey").alias("n_orders")).select(*own, F.coalesce("n", F.lit(0)).alias("n"), "n_orders"))
    return reduce(DataFrame.unionByName, levels)


_b("type_counts_cube", "SELECT c_mktsegment, n_name, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY CUBE (c_mktsegment, n_name)")
_b("conditional_counts", "SELECT l_returnflag, count(*) AS n, count_if(l_discount > 0.05) AS n_discounted, round(100e0 * count_if(l_discount > 0.05) / count(*), 6) AS pct FROM {lineitem} GROUP BY l_returnflag")
_b("distinct_counts", "SELECT lang, count(DISTINCT source) AS n_sources, count(DISTINCT doc_id) AS n_docs FROM {documents} GROUP BY lang")
_b("presence_rates", "SELECT d.lang, round(avg(CASE WHEN trim(d.text) <> '' THEN 1e0 ELSE 0e0 END), 6) AS text_rate, round(avg(CASE WHEN l.quality IS NOT NULL THEN 1e0 ELSE 0e0 END), 6) AS quality_rate, round(avg(CASE WHEN l.toxic = 1 THEN 1e0 ELSE 0e0 END), 6) AS toxic_rate FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY d.lang")
_b("length_stats", "SELECT lang, count(*) AS n, round(avg(length(text)), 6) AS mean, median(length(text)) AS median, round(stddev_samp(length(text)), 6) AS sd, min(length(text)) AS least, max(length(text)) AS most FROM {documents} GROUP BY lang")
_b("positive_mean", "SELECT event_type, round(avg(CASE WHEN value > 0 THEN value END), 6) AS mean_positive, round(median(value), 6) AS median_value FROM {events} GROUP BY event_type")
_b("dedupe_prefer_nonnull", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, ts, event_id) AS k FROM {events}) WHERE k = 1")
_b("dedupe_first_by_key", f"SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {_SEQ}) AS k FROM {{lineitem}}) WHERE k = 1")
_b("dedupe_counts", "SELECT l_returnflag, count(*) - count(DISTINCT l_partkey) AS n_repeats FROM {lineitem} GROUP BY l_returnflag")
_b("formula_dedupe", "SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS k FROM {orders} WHERE o_orderpriority IS NOT NULL) WHERE k = 1")
_b("merge_duplicate_edges",
   f"WITH s AS (SELECT l_orderkey, l_partkey, l_quantity, l_shipmode_seq FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY {_SEQ}) AS l_shipmode_seq FROM {{lineitem}})) SELECT l_orderkey AS src, l_partkey AS dst, count(*) AS mention_count, min_by(l_quantity, l_shipmode_seq) AS quantity, listagg(CASE WHEN l_shipmode_seq > 1 THEN cast(l_quantity AS INT) END, ',') WITHIN GROUP (ORDER BY l_shipmode_seq) AS others FROM s GROUP BY l_orderkey, l_partkey",
   f"WITH s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY {_SEQ}) AS k FROM lineitem) SELECT l_orderkey AS src, l_partkey AS dst, count(*) AS mention_count, arg_min(l_quantity, k) AS quantity, string_agg(CASE WHEN k > 1 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) END, ',' ORDER BY k) AS others FROM s GROUP BY l_orderkey, l_partkey")
_b("nest_groups",
   "SELECT p_type, count(*) AS n_brands, array_join(transform(array_sort(collect_list(struct(p_brand, n))), x -> concat(x.p_brand, ':', x.n)), ',') AS brands FROM (SELECT p_type, p_brand, count(*) AS n FROM {part} GROUP BY p_type, p_brand) GROUP BY p_type",
   "SELECT p_type, count(*) AS n_brands, string_agg(p_brand || ':' || n, ',' ORDER BY p_brand) AS brands FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY p_type, p_brand) GROUP BY p_type")
_b("last_wins_index", "SELECT o_custkey, max_by(o_orderkey, named_struct('d', o_orderdate, 'k', o_orderkey)) AS last_order FROM {orders} GROUP BY o_custkey",
   "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey")
_b("term_frequency_sum", "SELECT p_name AS term, sum(f) AS freq, min(p_partkey) AS first_seen FROM {part} JOIN (SELECT l_partkey, count(*) AS f FROM {lineitem} GROUP BY l_partkey) ON l_partkey = p_partkey GROUP BY p_name",
   "SELECT p_name AS term, CAST(sum(f) AS BIGINT) AS freq, min(p_partkey) AS first_seen FROM part JOIN (SELECT l_partkey, count(*) AS f FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey GROUP BY p_name")
_b("vote_mode", "SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM (SELECT user_id, event_type, count(*) AS n FROM {events} GROUP BY user_id, event_type)) WHERE k = 1")
_b("nodes_first_wins",
   "WITH p AS (SELECT concat('part:', l_partkey) AS id, 'Ingredient' AS type, concat(l_orderkey, '/', l_linenumber) AS prop, 1 AS src, l_orderkey AS a, l_linenumber AS b FROM {lineitem} UNION ALL SELECT concat('part:', p_partkey), p_type, nullif(p_brand, ''), 2, p_partkey, 0 FROM {part}) SELECT id, min_by(type, named_struct('s', src, 'a', a, 'b', b)) AS type, min_by(prop, CASE WHEN prop IS NOT NULL THEN named_struct('s', src, 'a', a, 'b', b) END) AS prop, count(*) AS n FROM p GROUP BY id",
   "WITH p AS (SELECT 'part:' || l_partkey AS id, 'Ingredient' AS type, l_orderkey || '/' || l_linenumber AS prop, 1 AS src, l_orderkey AS a, l_linenumber AS b FROM lineitem UNION ALL SELECT 'part:' || p_partkey, p_type, nullif(p_brand, ''), 2, p_partkey, 0 FROM part) SELECT id, arg_min(type, (src, a, b)) AS type, arg_min(prop, (src, a, b)) AS prop, count(*) AS n FROM p GROUP BY id")
_b("contains_edges", "SELECT concat('order:', o_orderkey) AS src, concat('part:', l_partkey) AS dst, l_quantity AS quantity, CASE WHEN l_quantity >= 40 THEN 'gram' WHEN l_quantity >= 20 THEN 'unit' WHEN l_quantity > 0 THEN 'parts' ELSE 'text_only' END AS quantity_kind FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey")
_b("gazetteer_build",
   "WITH s AS (SELECT lower(w) AS surface, 'Part' AS type, 3 AS rank FROM (SELECT explode(split(p_name, ' ')) AS w FROM {part}) UNION ALL SELECT lower(n_name), 'Nation', 2 FROM {nation} UNION ALL SELECT lower(w), 'Benchmark', 1 FROM (SELECT explode(regexp_extract_all(text, '[A-Za-z]+', 0)) AS w FROM {benchmark})) SELECT surface, count(*) AS n, array_join(array_sort(collect_set(type)), ',') AS types, max_by(type, rank) AS main_type FROM s GROUP BY surface",
   "WITH s AS (SELECT lower(w) AS surface, 'Part' AS type, 3 AS rank FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) UNION ALL SELECT lower(n_name), 'Nation', 2 FROM nation UNION ALL SELECT lower(w), 'Benchmark', 1 FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark)) SELECT surface, count(*) AS n, string_agg(DISTINCT type, ',' ORDER BY type) AS types, arg_max(type, rank) AS main_type FROM s GROUP BY surface")
_b("lexicon_left_join", "SELECT l.l_returnflag, coalesce(p.p_type, 'unresolved') AS type, count(*) AS n FROM {lineitem} l LEFT JOIN (SELECT * FROM {part} WHERE p_size > 10) p ON l.l_partkey = p.p_partkey GROUP BY l.l_returnflag, coalesce(p.p_type, 'unresolved')")
_b("authority_override", "SELECT p_partkey, CASE WHEN s_name IS NULL THEN 'not_listed' WHEN s_nationkey % 2 = 0 THEN 'confirmed' ELSE 'override' END AS status, CASE WHEN s_nationkey % 2 = 1 THEN concat('auth:', s_suppkey) ELSE concat('part:', p_partkey) END AS node_id FROM {part} LEFT JOIN {supplier} ON p_partkey = s_suppkey")
_b("substance_class", "SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'mineral' WHEN p_name LIKE '%n' THEN 'animal' WHEN regexp_like(p_name, '(green|blue|red)') THEN 'plant' ELSE 'other' END AS class FROM {part}",
   "SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'mineral' WHEN p_name LIKE '%n' THEN 'animal' WHEN regexp_matches(p_name, '(green|blue|red)') THEN 'plant' ELSE 'other' END AS class FROM part")
_b("substring_hints", "SELECT p_partkey, phrase, ord FROM {part} JOIN (SELECT * FROM VALUES (1, 'red'), (2, 'blue'), (3, 'en'), (4, 'ro') AS h(ord, phrase)) ON contains(p_name, phrase)",
   "SELECT p_partkey, phrase, ord FROM part JOIN (VALUES (1, 'red'), (2, 'blue'), (3, 'en'), (4, 'ro')) h(ord, phrase) ON contains(p_name, phrase)")
_b("treats_semi_exists",
   "SELECT d.doc_id, count(DISTINCT d.w) AS n FROM (SELECT doc_id, explode(split(lower(text), '[ \\n\\t\\r]+')) AS w FROM {documents}) d WHERE d.w <> '' AND EXISTS (SELECT 1 FROM (SELECT explode(split(lower(text), '[ \\n\\t\\r]+')) AS w FROM {benchmark}) b WHERE b.w = d.w) GROUP BY d.doc_id".replace("\\n", "\\\\n").replace("\\t", "\\\\t").replace("\\r", "\\\\r"),
   r"SELECT d.doc_id, count(DISTINCT d.w) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \n\t\r]+')) AS w FROM documents) d WHERE d.w <> '' AND d.w IN (SELECT unnest(regexp_split_to_array(lower(text), '[ \n\t\r]+')) FROM benchmark) GROUP BY d.doc_id")
_b("resume_anti_join", "SELECT o_orderkey FROM {orders} LEFT ANTI JOIN {lineitem} ON o_orderkey = l_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
_b("semi_membership", "SELECT c_custkey FROM {customer} LEFT SEMI JOIN {orders} ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
_b("nearest_row_match", "SELECT c.event_id AS click_id, min_by(p.event_id, named_struct('d', abs(unix_micros(cast(p.ts AS TIMESTAMP)) - unix_micros(cast(c.ts AS TIMESTAMP))), 'k', p.event_id)) AS purchase_id FROM {events} c JOIN {events} p ON c.user_id = p.user_id AND p.ts >= c.ts - INTERVAL 1 HOUR AND p.ts <= c.ts + INTERVAL 1 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase' GROUP BY c.event_id",
   "SELECT c.event_id AS click_id, arg_min(p.event_id, (abs(epoch_us(p.ts) - epoch_us(c.ts)), p.event_id)) AS purchase_id FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts >= c.ts - INTERVAL 1 HOUR AND p.ts <= c.ts + INTERVAL 1 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase' GROUP BY c.event_id")
_b("first_candidate_lookup", "SELECT o_orderkey, min_by(c, pos) AS hit FROM (SELECT o_orderkey, pos, c FROM {orders} LATERAL VIEW posexplode(array(o_orderkey % 1000 + 5000, o_custkey % 700, o_orderkey % 50)) AS pos, c) JOIN {supplier} ON s_suppkey = c GROUP BY o_orderkey",
   "SELECT o_orderkey, arg_min(c, pos) AS hit FROM (SELECT o_orderkey, unnest([0, 1, 2]) AS pos, unnest([o_orderkey % 1000 + 5000, o_custkey % 700, o_orderkey % 50]) AS c FROM orders) JOIN supplier ON s_suppkey = c GROUP BY o_orderkey")
_b("union_corpora", "SELECT 'doc' AS kind, doc_id AS id, length(text) AS n FROM {documents} UNION ALL SELECT 'item', item_id, length(text) FROM {benchmark} UNION ALL SELECT 'turn', conv_id, length(text) FROM {conversations}")
_b("set_difference", "SELECT p_partkey AS k FROM {part} EXCEPT SELECT l_partkey FROM {lineitem} WHERE l_quantity >= 50")
_b("set_intersection", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
_b("multiset_difference", "SELECT o_orderpriority, o_orderstatus FROM {orders} WHERE o_totalprice > 200000 EXCEPT ALL SELECT o_orderpriority, o_orderstatus FROM {orders} WHERE o_totalprice > 300000")
_b("top_k_terms", "SELECT w, n FROM (SELECT w, count(*) AS n FROM (SELECT explode(split(p_name, ' ')) AS w FROM {part}) GROUP BY w) ORDER BY n DESC, w LIMIT 12", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w ORDER BY n DESC, w LIMIT 12")
_b("longest_first", "SELECT n_name, row_number() OVER (ORDER BY length(n_name) DESC, n_name) AS rank FROM {nation}")
_b("arg_extremes", "SELECT c_mktsegment, max_by(c_custkey, named_struct('a', c_acctbal, 'k', c_custkey)) AS best, min_by(c_custkey, named_struct('a', c_acctbal, 'k', c_custkey)) AS worst FROM {customer} GROUP BY c_mktsegment",
   "SELECT c_mktsegment, arg_max(c_custkey, (c_acctbal, c_custkey)) AS best, arg_min(c_custkey, (c_acctbal, c_custkey)) AS worst FROM customer GROUP BY c_mktsegment")
# quality rules as data
_b("id_format", "SELECT count(*) AS n, count_if(NOT regexp_like(concat('order:', o_orderkey), '^[a-z][a-z_]*:[^ ]+$')) AS bad_orders, count_if(NOT regexp_like(c_name, '^[a-z][a-z_]*:[^ ]+$')) AS bad_names FROM {orders} JOIN {customer} ON o_custkey = c_custkey",
   "SELECT count(*) AS n, count_if(NOT regexp_matches('order:' || o_orderkey, '^[a-z][a-z_]*:[^ ]+$')) AS bad_orders, count_if(NOT regexp_matches(c_name, '^[a-z][a-z_]*:[^ ]+$')) AS bad_names FROM orders JOIN customer ON o_custkey = c_custkey")
_b("required_fields", "SELECT d.doc_id, concat_ws(',', CASE WHEN nullif(trim(d.text), '') IS NULL THEN 'text' END, CASE WHEN nullif(d.source, '') IS NULL THEN 'source' END, CASE WHEN l.quality IS NULL THEN 'quality' END) AS missing FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id")
_b("domain_range", "SELECT e.type, count(*) AS n, count_if(r.edge IS NULL) AS violations FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'CONTAINS' ELSE 'TREATS' END AS type, c_mktsegment AS st, o_orderpriority AS dt FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey) e LEFT JOIN (SELECT * FROM VALUES ('CONTAINS', 'BUILDING', '1-URGENT'), ('CONTAINS', 'MACHINERY', '2-HIGH'), ('TREATS', 'BUILDING', '5-LOW') AS r(edge, st, dt)) r ON e.type = r.edge AND e.st = r.st AND e.dt = r.dt GROUP BY e.type",
   "SELECT e.type, count(*) AS n, count_if(r.edge IS NULL) AS violations FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'CONTAINS' ELSE 'TREATS' END AS type, c_mktsegment AS st, o_orderpriority AS dt FROM orders LEFT JOIN customer ON o_custkey = c_custkey) e LEFT JOIN (VALUES ('CONTAINS', 'BUILDING', '1-URGENT'), ('CONTAINS', 'MACHINERY', '2-HIGH'), ('TREATS', 'BUILDING', '5-LOW')) r(edge, st, dt) ON e.type = r.edge AND e.st = r.st AND e.dt = r.dt GROUP BY e.type")
_b("cardinality", "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey HAVING count(o_orderkey) NOT BETWEEN 8 AND 12")
_b("anchor_probe", "SELECT count(*) AS n, count_if(a.expected = n.n_name) AS passed, round(avg(CASE WHEN a.expected = n.n_name THEN 1e0 ELSE 0e0 END), 6) AS rate FROM (SELECT * FROM VALUES (0, 'ALGERIA'), (1, 'ARGENTINA'), (2, 'BRAZIL'), (99, 'NOWHERE') AS a(k, expected)) a LEFT JOIN {nation} n ON a.k = n.n_nationkey",
   "SELECT count(*) AS n, count_if(a.expected = n.n_name) AS passed, round(avg(CASE WHEN a.expected = n.n_name THEN 1e0 ELSE 0e0 END), 6) AS rate FROM (VALUES (0, 'ALGERIA'), (1, 'ARGENTINA'), (2, 'BRAZIL'), (99, 'NOWHERE')) a(k, expected) LEFT JOIN nation n ON a.k = n.n_nationkey")
_b("shacl_report", "SELECT o_orderkey AS focus, 'status' AS shape, 'value not in the list' AS message FROM {orders} WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT o_orderkey, 'price', 'less than the minimum' FROM {orders} WHERE NOT coalesce(o_totalprice >= 1000, false) UNION ALL SELECT o.o_orderkey, 'lines', 'fewer than one' FROM {orders} o LEFT JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o.o_orderkey HAVING count(l_orderkey) < 1")
_b("reconcile_claims", "SELECT claim, expected, actual, abs(actual - expected) <= 5 OR abs(actual - expected) <= 0.02 * greatest(abs(expected), 1) AS matches FROM (SELECT 'nations' AS claim, 25 AS expected, count(*) AS actual FROM {nation} UNION ALL SELECT 'regions', 9, count(*) FROM {region} UNION ALL SELECT 'items', 41, count(*) FROM {benchmark})")
_b("prf_confusion", "SELECT lang, count_if(p AND g) AS tp, count_if(p AND NOT g) AS fp, count_if(NOT p AND g) AS fn, round(coalesce(count_if(p AND g) / nullif(count_if(p), 0), 0), 6) AS prec, round(coalesce(count_if(p AND g) / nullif(count_if(g), 0), 0), 6) AS rec FROM (SELECT lang, n_chars > 1500 AS p, quality = 1 AS g FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id) GROUP BY lang")
_b("dict_baseline", "SELECT CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'scum') THEN 1 ELSE 0 END AS predicted, toxic, count(*) AS n FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY 1, 2")
_b("stratified_sample", "SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat('7|', c_custkey)), c_custkey) AS k FROM {customer}) WHERE k <= 8")
_b("rdf_unpivot", "SELECT concat('c:', c_custkey) AS s, p, o FROM {customer} LATERAL VIEW stack(3, 'name', c_name, 'segment', c_mktsegment, 'nation', cast(c_nationkey AS STRING)) AS p, o",
   "SELECT 'c:' || c_custkey AS s, unnest(['name', 'segment', 'nation']) AS p, unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS o FROM customer")
_b("json_props_extract", "SELECT event_type, get_json_object(props, '$.page') AS page, count(*) AS n FROM {events} GROUP BY 1, 2", "SELECT event_type, json_extract_string(props, '$.page') AS page, count(*) AS n FROM events GROUP BY 1, 2")
_b("quantity_label", "SELECT CASE WHEN l_quantity > 45 THEN 'gram' WHEN l_quantity > 30 THEN 'unit' WHEN l_tax > 0.04 THEN 'text_only' ELSE 'parts' END AS label, count(*) AS n FROM {lineitem} GROUP BY 1")
_b("closed_enum_nodes", "SELECT concat('region:', lower(replace(r_name, ' ', '_'))) AS id, 'Region' AS type FROM {region} UNION ALL SELECT concat('nation:', lower(replace(n_name, ' ', '_'))), 'Nation' FROM {nation}")


@_c.frame("substitutes_for", "SELECT DISTINCT a.p_partkey AS src, b.p_partkey AS dst FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_size = b.p_size AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey")
def substitutes_for(spark, sf_dir):
    """Parts of one name, size and type, each with each other one. The result itself grows as the square of such a group."""
    return joins.same_group(_t(spark, sf_dir, "part"), ["p_name", "p_size", "p_type"], "p_partkey", "src", "dst")



QUERIES, SQL = _c.QUERIES, _c.SQL
