"""Sources: entry files, page trees, logs, plain text, graphs and rule files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_VERTEX = "array<struct<x:double,y:double>>"
#: The tree of a recognised page: blocks, paragraphs, words, symbols, with boxes.
PAGE = (
    "responses array<struct<context:struct<pageNumber:int,uri:string>,fullTextAnnotation:struct<text:string,pages:array<struct<width:int,height:int,"
    f"blocks:array<struct<paragraphs:array<struct<words:array<struct<boundingBox:struct<normalizedVertices:{_VERTEX},vertices:{_VERTEX}>,confidence:double,symbols:array<struct<text:string>>>>>>>>>>>>>"
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a pattern, names anything."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def optional(spark: SparkSession, path: str, schema: str, form: str = "json", **options: str) -> DataFrame:
    """A file's rows, or an empty table of the schema where the file is missing."""
    return spark.read.schema(schema).options(**options).format(form).load(path) if exists(spark, path) else spark.createDataFrame([], schema)


def entries(spark: SparkSession, pattern: str, schema: str, field: str = "entries") -> DataFrame:
    """One row an entry of JSON documents: the entry's fields, source_doc, batch (a field, else the file's stem) and at."""
    raw = spark.read.schema(f"batch string, {field} array<struct<{schema}>>").option("multiLine", True).json(pattern)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:_structured)?\.json$", 1)
    rows = raw.select(F.col("batch"), name.alias("source_doc"), F.posexplode(field).alias("at", "e"))
    return rows.select("source_doc", F.coalesce("batch", "source_doc").alias("batch"), "at", "e.*")


def guarded(spark: SparkSession, paths: list[str], schema: str, forbidden: str, field: str = "entries") -> DataFrame:
    """The entries of several files as one table; a row from a path that holds `forbidden` stops the job."""
    raw = spark.read.schema(f"{field} array<struct<{schema}>>").option("multiLine", True).json(paths)
    leak = F.input_file_name().contains(forbidden)
    rows = raw.select(F.input_file_name().alias("path"), F.when(leak, F.raise_error(F.concat(F.lit("excluded source: "), F.input_file_name()))).otherwise(F.col(field)).alias("es"))
    return rows.select("path", F.explode("es").alias("e")).select("path", "e.*")


def pages(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, page, tree): the pages of recognised batches; the number from the context, else from the file's name."""
    raw = spark.read.schema(PAGE).option("multiLine", True).json(pattern)
    rows = raw.select(F.input_file_name().alias("path"), F.explode("responses").alias("r"))
    named = F.regexp_extract("path", r"(\d+)\D*\.json$", 1).try_cast("int")
    return rows.select("path", F.coalesce("r.context.pageNumber", named).alias("page"), F.col("r.fullTextAnnotation").alias("tree"))


def page(batch: DataFrame, number: int) -> DataFrame:
    return batch.where(F.col("page") == number)


def boxes(vertices: Column, width: Column, height: Column) -> Column:
    """Pixel corners as shares of the page's width and height."""
    return F.transform(vertices, lambda v: F.struct((v["x"] / width).alias("x"), (v["y"] / height).alias("y")))


def words(batch: DataFrame) -> DataFrame:
    """(path, page, block, para, at, x, y, confidence, text): one row a word of (path, page, tree), at its box's middle.

    Boxes in pixels are made shares of the page. Words without symbols are empty and left out.
    """
    down = batch.select("path", "page", F.explode("tree.pages").alias("p"))
    down = down.select("path", "page", F.col("p.width").alias("w"), F.col("p.height").alias("h"), F.posexplode("p.blocks").alias("block", "b"))
    down = down.select("path", "page", "w", "h", "block", F.posexplode("b.paragraphs").alias("para", "q"))
    down = down.select("path", "page", "w", "h", "block", "para", F.posexplode("q.words").alias("at", "word"))
    corner = F.coalesce(F.col("word.boundingBox.normalizedVertices"), boxes(F.col("word.boundingBox.vertices"), F.col("w"), F.col("h")))
    mean = lambda axis: F.aggregate(F.transform("corner", lambda v: F.coalesce(v[axis], F.lit(0.0))), F.lit(0.0), lambda a, x: a + x) / F.size("corner")
    text = F.array_join(F.transform("word.symbols", lambda s: s["text"]), "")
    out = down.withColumn("corner", corner).select("path", "page", "block", "para", "at", mean("x").alias("x"), mean("y").alias("y"), F.col("word.confidence").alias("confidence"), text.alias("text"))
    return out.where("text <> ''")


def keep_better(first: DataFrame, second: DataFrame, key: str = "page", score: str = "confidence") -> DataFrame:
    """Of two readings of each page, the one with the higher score; the first where they are equal."""
    own = lambda df, n: df.select(key, F.struct(F.col(score), F.lit(-n).alias("turn"), F.struct("*").alias("row")).alias("x"))
    return own(first, 0).unionByName(own(second, 1)).groupBy(key).agg(F.max_by("x.row", F.struct(F.col(f"x.{score}"), F.col("x.turn"))).alias("row")).select("row.*")


def plain_tokens(spark: SparkSession, path: str) -> DataFrame | None:
    """(path, at, token) of plain texts, or None where there are none; only the first field of a line with tabs counts."""
    if not exists(spark, path):
        return None
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.filter(F.split("value", r"\s+"), lambda x: x != "")).alias("at", "token"))
    return text


def first_fields(spark: SparkSession, path: str) -> DataFrame:
    """(value): the first field of each line that has one."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("value")).where("value <> ''")


def graph_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, node) and edges (from, to, type, edge) of a document with one `@graph` array.

    Items with `@id` are nodes, the last of an id winning; items with both ends are edges; others are neither.
    """
    raw = spark.read.schema("`@graph` array<string>").option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("@graph").alias("at", "x"))
    field = lambda k: F.get_json_object("x", f"$['{k}']")
    nodes = rows.where(field("@id").isNotNull()).groupBy(field("@id").alias("id")).agg(F.max_by("x", "at").alias("node"))
    nodes = nodes.select("id", F.get_json_object("node", "$['@type']").alias("type"), "node")
    edges = rows.where(field("from").isNotNull() & field("to").isNotNull() & field("@id").isNull()).select(field("from").alias("from"), field("to").alias("to"), field("@type").alias("type"), F.col("x").alias("edge"))
    return nodes, edges


def rules(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The rows of one list of a small YAML rule file."""
    import yaml

    with open(path, "rb") as source:
        listed = (yaml.safe_load(source) or {}).get(field) or []
    names = [c.split()[0] for c in schema.split(",")]
    return spark.createDataFrame([tuple(x.get(n) for n in names) for x in listed], schema)


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an append-only log of tabs; an empty table where there is none yet."""
    return optional(spark, path, schema, "csv", sep="\t", header="false")


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; those that cannot be read, such as a half-written last one, are left out."""
    return optional(spark, path, schema, "json", mode="DROPMALFORMED")


def tree_levels(edges: DataFrame, roots: DataFrame, most: int = 50) -> DataFrame:
    """(node, level): breadth first from the roots (node) along (parent, child); a node is met once, at its least level.

    Each level is one join, its new nodes written before the next; loops end where nothing new is met.
    """
    from weftline.operators.shared import keep

    found = keep(roots.select("node").distinct().withColumn("level", F.lit(0)))
    edge = last = None
    for level in range(1, most + 1):
        edge = last if last is not None else found
        new = edges.join(edge, F.col("parent") == F.col("node"), "left_semi").select(F.col("child").alias("node")).distinct().join(found, "node", "left_anti")
        last = keep(new.withColumn("level", F.lit(level)))
        if last.isEmpty():
            break
        found = found.unionByName(last)
    return found


def terms(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, term, n): how often each term stands in each field; a field is an array of terms a row."""
    def tagged(name: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda t: F.struct(F.lit(name).alias("field"), t.alias("term")))

    every = F.explode(F.flatten(F.array(*(tagged(k, v) for k, v in fields.items()))))
    return rows.select(every.alias("x")).where("x.term <> ''").groupBy("x.field", "x.term").agg(F.count("*").alias("n"))


def prose(rows: DataFrame, labels: dict[str, Column], out: str = "prose") -> DataFrame:
    """Adds a running text of labelled fields, in order, those that are empty left out: the inverse of extraction."""
    parts = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(k + " :- "), v)) for k, v in labels.items()]
    return rows.withColumn(out, F.concat_ws(". ", *parts))
