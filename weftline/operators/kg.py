"""The graph: nodes and edges out of entries, a lexicon and closed lists, merged and checked."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as scalars
from weftline.functions.dosage import Units, to_grams

from .joins import cooccurrence
from .shared import keep

#: Most nodes that are broadcast to the edges that end in them.
BROADCAST = 200_000
#: Properties of the builder's nodes.
PROPERTIES = ("kind", "name", "property")


@dataclass
class Inputs:
    """Tables of the graph builder. Entries: doc, at, name, ingredients (array of name, quantity), indications, vehicle text.
    Lexicon: surface, lemma, kind. Diseases: surface, code, matched_via. Properties: lemma, property, value (arrays).
    Substitutes: surface, with (text of alternatives)."""

    entries: DataFrame
    lexicon: DataFrame
    diseases: DataFrame
    properties: DataFrame | None = None
    substitutes: DataFrame | None = None


def node_id(kind: str, name: Column) -> Column:
    return F.when(name.isNotNull(), F.concat(F.lit(f"{kind}:"), scalars.slug(name)))


def fixed_id(kind: str, name: str) -> str:
    """The node_id of a name that is known beforehand."""
    return f"{kind}:" + unicodedata.normalize("NFC", name).translate({32: "_", 47: "_", 58: None})


def _map(columns) -> Column:
    """A map of the columns that are not null, by name."""
    if not columns:
        return F.create_map().cast("map<string,string>")
    pairs = F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in sorted(columns)))
    return F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))


def _node(df: DataFrame, ident: Column, type_: str, seq: int, **props: Column) -> DataFrame:
    """The different rows (id, type, seq, and PROPERTIES as columns) of one producer."""
    own = (props.get(k, F.lit(None)).cast("string").alias(k) for k in PROPERTIES)
    return df.select(ident.alias("id"), F.lit(type_).alias("type"), F.lit(seq).alias("seq"), *own).where("id IS NOT NULL").distinct()


def _one_node(nodes: DataFrame) -> DataFrame:
    """merge_nodes for PROPERTIES in columns: one aggregate, of which a plan that asks for types only makes no more."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(c)
    return nodes.groupBy("id").agg(*(first(c) for c in ("type", *PROPERTIES))).select("id", "type", _map(PROPERTIES).alias("props"))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One node an id: its first type, and of each property the first value that is there, in order of producers.

    Ties within a producer go to the least value, so the result does not depend on the order of rows.
    """
    kinds = nodes.groupBy("id").agg(F.min_by("type", F.struct("seq", "type")).alias("type"))
    props = nodes.select("id", "seq", F.explode("props").alias("k", "v")).where("v IS NOT NULL").groupBy("id", "k").agg(F.min_by("v", F.struct("seq", "v")).alias("v"))
    maps = props.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    return kinds.join(maps, "id", "left").select("id", "type", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge a (src, type, dst): how often it is stated, and of each property the least value."""
    keys = ["src", "type", "dst"]
    n = edges.groupBy(*keys).agg(F.count("*").alias("n"))
    props = edges.select(*keys, F.explode("props").alias("k", "v")).where("v IS NOT NULL").groupBy(*keys, "k").agg(F.min("v").alias("v"))
    maps = props.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    return n.join(maps, keys, "left").select(*keys, "n", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"))


def _edge(df: DataFrame, src: Column, type_: str, dst: Column, **props: Column) -> DataFrame:
    """The edges of one producer, merged as merge_edges does it: no other producer has the type, so that is all of it.

    One aggregate that combines before the shuffle; properties that a plan does not ask for are never made.
    """
    rows = df.select(src.alias("src"), dst.alias("dst"), *(v.cast("string").alias(f"_w_{k}") for k, v in props.items())).where("src IS NOT NULL AND dst IS NOT NULL")
    one = rows.groupBy("src", "dst").agg(F.count("*").alias("_n"), *(F.min(f"_w_{k}").alias(k) for k in props))
    return one.select("src", F.lit(type_).alias("type"), "dst", F.col("_n").alias("n"), _map(props).alias("props"))


def build(inputs: Inputs, units: Units, kinds, vehicles, max_co: int = 200, min_co: int = 3) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all producers: formulas with their type by ending, ingredients with quantities, vehicles,
    diseases treated, properties, substitutes and co-occurrence.

    kinds: (ending, type) in order of precedence; vehicles: (phrase, name). Each producer is a plan of joins by equality
    on surfaces; nodes and edges are merged by aggregates that combine before the shuffle. Entries are written once;
    names become ids, and quantities grams, once for each different text, not for each place where it stands.
    """
    e = keep(inputs.entries.select("doc", "at", "name", "ingredients", "indications", "vehicle")).withColumn("src", F.concat(F.lit("formula:"), F.col("doc").cast("string"), F.lit("/"), F.col("at").cast("string")))
    lex = inputs.lexicon.groupBy("surface").agg(F.min_by(F.struct("lemma", "kind"), F.struct("lemma", "kind")).alias("l")).select("surface", "l.lemma", "l.kind")
    nodes = [_node(e, F.col("src"), "Formula", 0, name=F.col("name"))]
    edges = []
    kind, kind_id = scalars.first_suffix(F.col("name"), kinds), scalars.first_suffix(F.col("name"), [(s, fixed_id("type", k)) for s, k in kinds])
    nodes.append(_node(e.where(kind.isNotNull()), kind_id, "PreparationType", 1, name=kind))
    edges.append(_edge(e, F.col("src"), "IS_TYPE", kind_id))

    part = e.select("src", F.explode("ingredients").alias("i")).select("src", F.trim("i.name").alias("surface"), F.col("i.quantity").alias("quantity")).where("surface <> ''")
    named = part.select("surface").distinct().join(lex, "surface", "left").withColumn("name", F.coalesce("lemma", "surface"))
    named = keep(named.select("surface", "name", F.coalesce("kind", F.lit("unresolved")).alias("kind"), node_id("ingredient", F.col("name")).alias("ident")))
    weighed = keep(part.where("quantity IS NOT NULL").select("quantity").distinct().select("quantity", to_grams(F.col("quantity"), units).alias("w")).select("quantity", "w.grams", "w.unit"))
    known = part.join(named.select("surface", "ident"), "surface")
    nodes.append(_node(named, F.col("ident"), "Ingredient", 2, name=F.col("name"), kind=F.col("kind")))
    amount = F.when(F.col("grams").isNotNull(), "gram").when(F.col("unit").isNotNull(), "relative").when(F.coalesce("quantity", F.lit("")) != "", "text")
    edges.append(_edge(known.join(weighed, "quantity", "left"), F.col("src"), "CONTAINS", F.col("ident"), quantity=F.nullif(F.col("quantity"), F.lit("")), grams=F.col("grams"), unit=F.col("unit"), quantity_kind=amount))

    found = found_id = F.lit(None).cast("string")
    for phrase, name in sorted(vehicles, key=lambda v: len(v[0])):
        there = F.contains(F.coalesce("vehicle", F.lit("")), F.lit(phrase))
        found, found_id = F.when(there, F.lit(name)).otherwise(found), F.when(there, F.lit(fixed_id("vehicle", name))).otherwise(found_id)
    nodes.append(_node(e.where(found.isNotNull()), found_id, "Vehicle", 1, name=found))
    edges.append(_edge(e, F.col("src"), "DOSED_WITH", found_id))

    ills = inputs.diseases.where("matched_via IS NOT NULL").groupBy("surface").agg(F.min("code").alias("code"))
    ills = keep(ills.select("surface", node_id("disease", F.col("code")).alias("ident")))
    said = e.select("src", F.explode(scalars.tokens(F.col("indications"))).alias("w")).select("src", scalars.strip(F.col("w"), " .,;:-()").alias("surface")).join(ills, "surface")
    nodes.append(_node(ills, F.col("ident"), "Disease", 1, name=F.col("surface")))
    edges.append(_edge(said, F.col("src"), "TREATS", F.col("ident"), surface=F.col("surface")))

    if inputs.properties is not None:
        p = inputs.properties.select(node_id("ingredient", F.col("lemma")).alias("src"), "property", F.explode("value").alias("v"))
        ident = F.concat(F.lit("property:"), scalars.slug(F.col("property")), F.lit("/"), scalars.slug(F.col("v")))
        nodes.append(_node(p, ident, "Property", 3, name=F.col("v"), property=F.col("property")))
        nodes.append(_node(inputs.properties, node_id("ingredient", F.col("lemma")), "Ingredient", 4, name=F.col("lemma")))
        edges.append(_edge(p, F.col("src"), "HAS_PROPERTY", ident))
    if inputs.substitutes is not None:
        s = inputs.substitutes.select("surface", F.explode(F.split("with", ",|\\bහෝ\\b|\\bor\\b")).alias("w")).select("surface", F.trim(F.substring_index("w", "=", 1)).alias("w")).where("w <> ''")
        joined = lambda df, c: df.join(lex.select(F.col("surface").alias(c), F.col("lemma").alias(f"{c}_lemma")), c, "left").withColumn(f"{c}_id", node_id("ingredient", F.coalesce(f"{c}_lemma", c)))
        s = joined(joined(s, "surface"), "w").where("surface_id <> w_id")
        for c in ("surface", "w"):
            nodes.append(_node(s, F.col(f"{c}_id"), "Ingredient", 5, name=F.coalesce(f"{c}_lemma", c)))
        edges.append(_edge(s, F.col("w_id"), "SUBSTITUTES_FOR", F.col("surface_id")))
    co = cooccurrence(known.select("src", F.col("ident").alias("i")), "src", "i", min_co, max_co)
    edges.append(_edge(co, F.col("a"), "CO_OCCURS", F.col("b"), n=F.col("n"), confidence=F.col("confidence")))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return _one_node(union(nodes)), union(edges)


def ends(nodes: DataFrame, edges: DataFrame, allowed) -> DataFrame:
    """Edges whose ends are missing or of types that the schema (type, domain, range) forbids, with the reason.

    Edges are written once, without properties. Many may end in one node (a vehicle, a type): the nodes that edges end in
    are looked up first and, while they are few, sent to all edges, so that no task has all edges of a node.
    """
    n, laid = keep(nodes.select("id", "type")), keep(edges.select("src", "type", "dst"))
    rule = edges.sparkSession.createDataFrame(list(allowed), "type string, domain string, range string")
    side = lambda n, s: n.select(F.col("id").alias(s), F.col("type").alias(f"{s}_type"))
    far = keep(side(n, "dst").join(laid.select("dst").distinct(), "dst", "left_semi"))
    far = F.broadcast(far) if far.count() <= BROADCAST else far
    laid = laid.join(side(n, "src"), "src", "left").join(far, "dst", "left").join(F.broadcast(rule), "type", "left")
    why = F.when(F.col("domain").isNull(), "unknown edge type").when(F.col("src_type").isNull(), "source missing").when(F.col("dst_type").isNull(), "target missing").when(F.col("src_type") != F.col("domain"), "domain").when(F.col("dst_type") != F.col("range"), "range")
    return laid.withColumn("why", why).where("why IS NOT NULL").select("src", "type", "dst", "why")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, name, value): counts of nodes and edges by type, and the share of quantities in grams."""
    n = nodes.groupBy("type").count().select(F.lit("nodes").alias("section"), F.col("type").alias("name"), F.col("count").cast("double").alias("value"))
    e = edges.groupBy("type").count().select(F.lit("edges").alias("section"), F.col("type").alias("name"), F.col("count").cast("double").alias("value"))
    q = edges.where("type = 'CONTAINS'").agg(F.avg(F.try_element_at("props", F.lit("grams")).isNotNull().cast("double")).alias("value")).select(F.lit("dosage").alias("section"), F.lit("share_in_grams").alias("name"), "value")
    return n.unionByName(e).unionByName(q)
