"""Page layout: rows out of words, zones, columns, row kinds, records; the extractors as ordered folds and windows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visual_rows(words: DataFrame, page: list[str], gap: float, x: str = "x", y: str = "y") -> DataFrame:
    """Adds row: words in order of y join the row above while they are within `gap` of the word before (running)."""
    order = Window.partitionBy(*page).orderBy(y, x, "text")
    new = (F.col(y) - F.lag(y).over(order) > gap).cast("int")
    return words.withColumn("row", F.coalesce(F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))


def row_table(words: DataFrame, page: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """One row a visual row: y (median), words in order of x, and text."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col("block").alias("block"), F.col("text").alias("text"))))
    out = words.groupBy(*page, "row").agg(F.median(y).alias("y"), listed.alias("w"))
    return out.withColumn("text", F.array_join(F.transform("w", lambda a: a["text"]), " "))


def zone(words: Column, low: float, high: float) -> Column:
    """Text of the words of a row whose x lies in [low, high), joined by blanks."""
    return F.array_join(F.transform(F.filter(words, lambda a: (a["x"] >= low) & (a["x"] < high)), lambda a: a["text"]), " ")


def zones(rows: DataFrame, bands: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Adds one text column a band."""
    return rows.select("*", *(zone(F.col("w"), *b).alias(k) for k, b in bands.items()))


def gutter(words: DataFrame, page: list[str], low: float = 0.35, high: float = 0.65, cells: int = 60, x: str = "x") -> DataFrame:
    """(page..., gutter): the middle of the widest run of empty cells between low and high; null where none is empty."""
    cell = F.floor(F.col(x) * cells).cast("int")
    held = words.groupBy(*page).agg(F.array_sort(F.collect_set(cell)).alias("held"))
    every = F.filter(F.sequence(F.lit(int(low * cells)), F.lit(int(high * cells))), lambda c: ~F.array_contains("held", c))
    # runs of neighbours share cell minus place
    keyed = held.select(*page, F.posexplode_outer(every).alias("i", "c"))
    runs = keyed.groupBy(*page, (F.col("c") - F.col("i")).alias("k")).agg(F.min("c").alias("a"), F.max("c").alias("b"))
    best = runs.groupBy(*page).agg(F.max(F.struct((F.col("b") - F.col("a")).alias("width"), (-F.col("a")).alias("first"), F.col("a"), F.col("b"))).alias("r"))
    return best.select(*page, ((F.col("r.a") + F.col("r.b") + 1) / (2.0 * cells)).alias("gutter"))


def reading_order(words: DataFrame, gutters: DataFrame, page: list[str], x: str = "x") -> DataFrame:
    """Adds column (0 left of the gutter or without one, 1 right of it): sort by page, column, y, x to read."""
    return words.join(gutters, page, "left").withColumn("column", F.when(F.col(x) > F.col("gutter"), 1).otherwise(0)).drop("gutter")


def row_kind(entry: Column, label: Column, content: Column, labels: Mapping[str, str]) -> Column:
    """(kind, field): `entry` for a number with a dot, `label` for a known label, `content`, or `blank`."""
    field = F.try_element_at(F.create_map(*(F.lit(x) for p in labels.items() for x in p)), F.regexp_replace(F.trim(label), r"\s*:-?\s*$", "")) if labels else F.lit(None).cast("string")
    kind = F.when(F.regexp_like(F.coalesce(entry, F.lit("")), F.lit(r"^\s*\d+\s*[.)]")), "entry").when(field.isNotNull(), "label").when(F.coalesce(content, F.lit("")) != "", "content").otherwise("blank")
    return F.struct(kind.alias("kind"), F.when(kind == "label", field).alias("field"))


def carry_section(rows: DataFrame, book: list[str], order: list[str], mark: Column, out: str = "section") -> DataFrame:
    """Adds the last section mark at or before each row, carried over page ends."""
    w = Window.partitionBy(*book).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(mark, ignorenulls=True).over(w))


def records(rows: DataFrame, book: list[str], order: list[str], kind: str, field: str, text: str, first: str = "name") -> DataFrame:
    """(book..., record, fields): entries of a labelled table as maps from field to text.

    A row of kind `entry` opens a record, whose text goes to the field `first`; a label names the field of what follows;
    content goes to the field that is open. Rows before the first entry belong to the record before them on the last
    page, so pages may be given together: the order carries the state. Blank rows are left out.
    """
    w = Window.partitionBy(*book).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col(kind) == "entry", F.lit(first)).when(F.col(kind) == "label", F.col(field))
    laid = rows.withColumn("record", F.count_if(F.col(kind) == "entry").over(w)).withColumn("_w_field", F.last(mark, ignorenulls=True).over(w))
    laid = laid.where((F.col("record") > 0) & (F.coalesce(F.col(text), F.lit("")) != ""))
    seq = F.struct(*order)
    joined = laid.groupBy(*book, "record", "_w_field").agg(F.min(seq).alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq.alias("o"), F.col(text).alias("t")))), lambda a: a["t"]), " ").alias("t"))
    return joined.groupBy(*book, "record").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("_w_field").alias("k"), F.col("t").alias("v")))), lambda a: F.struct(a["k"].alias("k"), a["v"].alias("v")))).alias("fields"))


def continuations(entries: DataFrame, book: list[str], order: str, starts: Column, text: str) -> DataFrame:
    """Entries that do not start a new one are joined to the one before: (book..., group, text)."""
    w = Window.partitionBy(*book).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    grouped = entries.withColumn("group", F.count_if(starts).over(w))
    return grouped.groupBy(*book, "group").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda a: a["t"]), " ").alias(text))


def merge_units(tokens: Column, pairs: Mapping[tuple[str, str], str]) -> Column:
    """Neighbouring words that form one unit made one, from left to right."""
    none = F.slice(tokens, 1, 0)

    def step(acc: Column, t: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))
        out = F.concat(acc, F.array(t))
        for (a, b), whole in pairs.items():
            out = F.when((last == a) & (t == b), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.lit(whole)))).otherwise(out)
        return out

    return F.aggregate(tokens, none, step)


def parse_ingredient(tokens: Column, units: list[str]) -> Column:
    """(name, unit, amount) of an ingredient's words: the first unit parts the name from the amount after it."""
    at = F.array_position(F.transform(tokens, lambda t: t.isin(*units)), True).cast("int")
    join = lambda a: F.array_join(a, " ")
    name = F.when(at > 0, join(F.slice(tokens, 1, F.greatest(at - 1, F.lit(0))))).otherwise(join(tokens))
    rest = F.when(at > 0, join(F.slice(tokens, at + 1, F.size(tokens))))
    return F.struct(name.alias("name"), F.when(at > 0, F.get(tokens, at - 1)).alias("unit"), F.nullif(rest, F.lit("")).alias("amount"))


def name_columns(words: Column, gap: float = 0.15) -> Column:
    """The words of a row as several texts, parted where x leaps by more than `gap` or the block changes."""
    empty = F.slice(F.array(F.lit("")), 1, 0)
    state = lambda out, text, x, block: F.struct(out.alias("out"), text.alias("text"), x.cast("double").alias("x"), block.cast("long").alias("block"))

    def step(acc: Column, a: Column) -> Column:
        parts = acc["x"].isNotNull() & ((a["x"] - acc["x"] > gap) | (a["block"] != acc["block"]))
        return F.when(parts, state(F.concat(acc["out"], F.array(acc["text"])), a["text"], a["x"], a["block"])).otherwise(state(acc["out"], F.concat_ws(" ", F.nullif(acc["text"], F.lit("")), a["text"]), a["x"], a["block"]))

    return F.aggregate(words, state(empty, F.lit(""), F.lit(None), F.lit(None)), step, lambda acc: F.when(acc["text"] != "", F.concat(acc["out"], F.array(acc["text"]))).otherwise(acc["out"]))


def monotone_marks(numbers: Column, back: int = 100, ahead: int = 5) -> Column:
    """Which of a sequence of (n, embedded) are accepted as entry numbers: n not over `back` below the largest so far;
    an embedded one only if it is the next few. The largest moves on with each; a fold over one document."""
    state = lambda out, top: F.struct(out.alias("out"), top.cast("long").alias("top"))

    def step(acc: Column, x: Column) -> Column:
        fits = F.when(x["embedded"], (x["n"] > acc["top"]) & (x["n"] <= acc["top"] + ahead)).otherwise(x["n"] >= acc["top"] - back)
        return state(F.concat(acc["out"], F.array(fits)), F.when(fits, F.greatest(acc["top"], x["n"])).otherwise(acc["top"]))

    none = F.slice(F.array(F.lit(True)), 1, 0)
    return F.aggregate(numbers, state(none, F.lit(0)), step, lambda acc: acc["out"])


def verses(text: Column, back: int = 100, ahead: int = 5) -> Column:
    """Array of (n, body) of a numbered text: a number that starts a line and keeps the count opens an entry."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    mark = r"^(\d{1,4})\s*[.)]\s*"
    n = lambda x: F.regexp_extract(x, mark, 1).try_cast("long")
    numbered = F.transform(lines, lambda x: F.struct(F.coalesce(n(x), F.lit(-1_000_000)).alias("n"), F.lit(False).alias("embedded")))
    accepted = monotone_marks(numbered, back, ahead)
    zipped = F.arrays_zip(lines.alias("line"), accepted.alias("ok"))
    empty = F.slice(F.array(F.struct(F.lit(0).cast("long").alias("n"), F.lit("").alias("body"))), 1, 0)

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        more = F.struct(last["n"].alias("n"), F.trim(F.concat_ws(" ", last["body"], x["line"])).alias("body"))
        new = F.struct(n(x["line"]).alias("n"), F.regexp_replace(x["line"], mark, "").alias("body"))
        return F.when(x["ok"] & n(x["line"]).isNotNull(), F.concat(acc, F.array(new))).when(F.size(acc) > 0, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(more))).otherwise(acc)

    return F.aggregate(zipped, empty, step)


def numbered_rows(rows: DataFrame, book: list[str], order: list[str], left: str, right: str) -> DataFrame:
    """(book..., n, left, right): a two-sided table whose rows a number opens; text of unnumbered rows joins the last."""
    w = Window.partitionBy(*book).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.regexp_extract(F.col(left), r"^\s*(\d+)\s*[.)]?\s", 1).try_cast("int")
    laid = rows.withColumn("n", F.last(n, ignorenulls=True).over(w)).where("n IS NOT NULL")
    seq = F.struct(*order)
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seq.alias("o"), F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s*\d+\s*[.)]?\s", "")).alias("t")))), lambda a: a["t"]), " ")
    return laid.groupBy(*book, "n").agg(F.trim(text(left)).alias("left"), F.trim(text(right)).alias("right"))


def stranded(words: DataFrame, claimed: DataFrame, keys: list[str]) -> DataFrame:
    """Words that no record claims, to be put back to the row they stand in."""
    return words.join(claimed.select(*keys).distinct(), keys, "left_anti")
