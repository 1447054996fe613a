"""Spans: greedy cover as a fold over sorted structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.segment import let


def cover(spans: Column) -> Column:
    """Non-overlapping spans, leftmost first, then longest, then by priority and id; of structs (start, end, priority, id)."""
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("far"), x["priority"].alias("priority"), x["id"].alias("id")))
    ordered = F.array_sort(keyed)
    # the fold carries one character a span: a fold copies its state at each step, and spans kept in it would make a square
    state = lambda marks, end: F.struct(marks.alias("marks"), end.cast("long").alias("end"))
    free = lambda s, x: s["end"].isNull() | (x["start"] >= s["end"])
    step = lambda s, x: F.when(free(s, x), state(F.concat(s["marks"], F.lit("1")), -x["far"])).otherwise(state(F.concat(s["marks"], F.lit("0")), s["end"]))
    marks = lambda spans: F.split(F.aggregate(spans, state(F.lit(""), F.lit(None)), step, lambda s: s["marks"]), "")
    whole = lambda x: F.struct(x["start"].alias("start"), (-x["far"]).alias("end"), x["priority"].alias("priority"), x["id"].alias("id"))
    chosen = lambda spans: F.filter(F.zip_with(spans, marks(spans), lambda x, m: F.when(m == "1", x)), lambda x: x.isNotNull())
    return let(ordered, lambda spans: F.transform(chosen(spans), whole))
