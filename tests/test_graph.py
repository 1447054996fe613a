"""The graph builder's plans: what they make, and how often."""

from pyspark.sql import functions as F

from weftline.operators import kg
from weftline.plans import flows

DIR = "/root/testdata/sf0.001"


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ends_do_not_gather_edges_by_the_node_they_end_in(spark):
    """All formulas end in one vehicle: such a node must not be one task's."""
    edges = spark.range(2000).select(F.concat(F.lit("f:"), "id").alias("src"), F.lit("DOSED_WITH").alias("type"), F.lit("v:milk").alias("dst"))
    nodes = edges.select(F.col("src").alias("id"), F.lit("Formula").alias("type")).unionByName(spark.createDataFrame([("v:milk", "Vehicle"), ("v:more", "Vehicle")], "id string, type string"))
    bad = kg.ends(nodes, edges, [("DOSED_WITH", "Formula", "Disease")])
    assert {tuple(r) for r in bad.groupBy("why").count().collect()} == {("range", 2000)}
    plan = _physical(bad)
    assert "hashpartitioning(dst" not in plan and "LeftOuter, BuildRight" in plan


def test_counts_of_edges_make_no_properties(spark):
    """Ids and grams come of the different names and quantities; no place of a text goes to Python for them."""
    plan = _physical(flows._graph(spark, DIR)[1].where("type = 'CONTAINS'").groupBy("type").count())
    assert "Python" not in plan and "regexp_extract_all" not in plan


def test_builder_makes_the_properties_it_made(spark):
    nodes, edges = flows._graph(spark, DIR)
    n, e = {r.id: r for r in nodes.collect()}, {(r.src, r.type, r.dst): r for r in edges.collect()}
    assert (len(n), len(e)) == (1489, 7802)  # as counted when nodes and edges were merged by merge_nodes and merge_edges
    hot = e["formula:o/0", "CONTAINS", "ingredient:HOT"]
    assert hot.n == 1 and hot.props == {"grams": "48.0", "quantity": "4 tola", "quantity_kind": "gram", "unit": "tola"}
    assert n["ingredient:HOT"].type == "Ingredient" and n["ingredient:HOT"].props == {"kind": "plant", "name": "HOT"}


def test_equal_quantities_are_read_once(spark):
    """Grams are made of different texts: lines are counted by text before any goes to Python."""
    from weftline import catalog

    above, below = _physical(catalog.QUERIES["dosage_to_grams"](spark, DIR)).split("ArrowEvalPython", 1)
    assert "Aggregate" in below and "Exchange" in below and "regexp_extract_all" not in below
