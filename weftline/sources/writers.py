"""Sinks: graph documents, statements, triples, reports, logs, and writes that skip, force or only tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .readers import exists


def sorted_json(row: Column, names: list[str]) -> Column:
    """A row as JSON with its keys sorted and its nulls left out: equal rows give equal text."""
    return F.to_json(F.struct(*(row[n].alias(n) for n in sorted(names))))


def graph_lines(nodes: DataFrame, edges: DataFrame, context: str) -> DataFrame:
    """(value): the lines of one graph document, nodes before edges, in order of ids; to be written by `one_file`.

    nodes: id, type, props (a map). edges: src, dst, type, props. Props with null values are left out by to_json.
    """
    props = lambda: F.map_filter("props", lambda _, v: v.isNotNull())
    n = nodes.select(F.lit(1).alias("part"), F.struct(F.col("id").alias("a"), F.lit("").alias("b"), F.col("type").alias("c")).alias("key"), F.to_json(F.map_concat(F.create_map(F.lit("@id"), F.col("id"), F.lit("@type"), F.col("type")), props())).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("type").alias("c")).alias("key"), F.to_json(F.map_concat(F.create_map(F.lit("@type"), F.col("type"), F.lit("from"), F.col("src"), F.lit("to"), F.col("dst")), props())).alias("value"))
    body = n.unionByName(e).orderBy("part", "key")
    return body.select("value"), f'{{"@context": {context}, "@graph": [', "]}"


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, value): constraint lines, node merges and edge merges, names quoted and values escaped, in this order."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n")), F.lit("'"))
    name = lambda c: F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`"))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(F.map_filter("props", lambda _, v: v.isNotNull()))), lambda p: F.concat(name(p["key"]), F.lit(": "), quoted(p["value"]))), ", ")
    own = F.when(F.size("props") > 0, F.concat(F.lit(" += {"), listed, F.lit("}")))
    kinds = nodes.select("type").distinct().select(F.lit(0).alias("part"), F.concat(F.lit("CREATE CONSTRAINT IF NOT EXISTS FOR (n:"), name(F.col("type")), F.lit(") REQUIRE n.id IS UNIQUE;")).alias("value"))
    put = nodes.select(F.lit(1).alias("part"), F.concat(F.lit("MERGE (n:"), name(F.col("type")), F.lit(" {id: "), quoted(F.col("id")), F.lit("})"), F.coalesce(F.concat(F.lit(" SET n"), own), F.lit("")), F.lit(";")).alias("value"))
    tie = edges.select(F.lit(2).alias("part"), F.concat(F.lit("MATCH (a {id: "), quoted(F.col("src")), F.lit("}), (b {id: "), quoted(F.col("dst")), F.lit("}) MERGE (a)-[r:"), name(F.col("type")), F.lit("]->(b)"), F.coalesce(F.concat(F.lit(" SET r"), own), F.lit("")), F.lit(";")).alias("value"))
    return kinds.unionByName(put).unionByName(tie)


def iri(c: Column, base: str) -> Column:
    """An IRI of a base and an id, with what an IRI cannot hold percent-encoded."""
    return F.concat(F.lit(f"<{base}"), F.url_encode(c), F.lit(">"))


def literal(c: Column) -> Column:
    """A Turtle string, escaped."""
    out = c
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), out, F.lit('"'))


def triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(s, p, o, is_node): type, each property, list values one by one, and each edge as a statement."""
    kinds = nodes.select(F.col("id").alias("s"), F.lit("type").alias("p"), F.col("type").alias("o"), F.lit(False).alias("is_node"))
    props = nodes.select(F.col("id").alias("s"), F.explode("props").alias("p", "v")).where("v IS NOT NULL")
    values = props.select("s", "p", F.explode(F.when(F.col("v").startswith("["), F.coalesce(F.from_json("v", "array<string>"), F.array("v"))).otherwise(F.array("v"))).alias("o"), F.lit(False).alias("is_node"))
    links = edges.select(F.col("src").alias("s"), F.col("type").alias("p"), F.col("dst").alias("o"), F.lit(True).alias("is_node"))
    return kinds.unionByName(values).unionByName(links)


def flat_properties(nodes: DataFrame, nested: str) -> DataFrame:
    """Nested properties as `outer__inner` beside the others: the map `nested` of maps joined into `props`."""
    inner = F.map_from_entries(F.flatten(F.transform(F.map_entries(nested), lambda o: F.transform(F.map_entries(o["value"]), lambda i: F.struct(F.concat(o["key"], F.lit("__"), i["key"]).alias("key"), i["value"].alias("value"))))))
    return nodes.withColumn("props", F.map_concat("props", F.coalesce(inner, F.create_map().cast("map<string,string>")))).drop(nested)


def turtle(statements: DataFrame, base: str) -> DataFrame:
    """(value): one line a statement of (s, p, o, is_node)."""
    obj = F.when(F.col("is_node"), iri(F.col("o"), base)).otherwise(literal(F.col("o")))
    return statements.select(F.concat(iri(F.col("s"), base), F.lit(" "), iri(F.col("p"), base), F.lit(" "), obj, F.lit(" .")).alias("value"))


def write(df: DataFrame, path: str, form: str = "json", skip: bool = True, force: bool = False, dry: bool = False, **options: str) -> str:
    """Writes a table and tells what it did: `skipped` where it is there, unless forced; `would write` on a dry run."""
    there = exists(df.sparkSession, path)
    if there and skip and not force:
        return "skipped"
    if dry:
        return "would write"
    df.write.mode("overwrite" if force or not skip else "errorifexists").options(**options).format(form).save(path)
    return "written"


def append_lines(df: DataFrame, path: str) -> None:
    """Adds rows to a table of JSON lines; what is there stays as it is."""
    df.write.mode("append").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to a log of tabs."""
    df.write.mode("append").option("sep", "\t").csv(path)


def sample(df: DataFrame, order: Column, n: int, path: str) -> str:
    """A fixed sample, the n rows that come first by a hash, as tabs with a header."""
    return write(df.orderBy(order).limit(n).coalesce(1), path, "csv", force=True, sep="\t", header="true")


def markdown(metrics: DataFrame, title: str) -> DataFrame:
    """(value): a report of (section, name, value): a heading, and one table a section."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    per = metrics.groupBy("section").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("| "), cell("name"), F.lit(" | "), cell("value"), F.lit(" |")))), "\n").alias("rows"))
    return per.orderBy("section").select(F.concat(F.lit(f"# {title}: "), "section", F.lit("\n\n| name | value |\n|-|-|\n"), "rows", F.lit("\n")).alias("value"))


def html(metrics: DataFrame) -> DataFrame:
    """(value): the same as tables of HTML, escaped."""
    from weftline.functions.text import html_escape

    cell = lambda c: html_escape(F.coalesce(F.col(c).cast("string"), F.lit("")))
    per = metrics.groupBy("section").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<tr><td>"), cell("name"), F.lit("</td><td>"), cell("value"), F.lit("</td></tr>")))), "").alias("rows"))
    return per.orderBy("section").select(F.concat(F.lit("<h2>"), html_escape(F.col("section")), F.lit("</h2><table>"), "rows", F.lit("</table>")).alias("value"))
