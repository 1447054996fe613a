"""How a catalogue of SQL plans is made: one text for Spark, one for the oracle, differing only in dialect."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def tables(spark: SparkSession, sf_dir: str, text: str) -> dict[str, DataFrame]:
    """The tables that a plan names, as arguments of a parameterised query: no global views are left behind."""
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\{{{t}\}}", text)}


def sql_plan(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.sql(text, **tables(spark, sf_dir, text))


class Catalogue:
    """Collects plans by name. `both` takes one text with {tables}; a pair of texts where dialects part."""

    def __init__(self):
        self.QUERIES: dict[str, Callable] = {}
        self.SQL: dict[str, str] = {}

    def both(self, name: str, text: str, duck: str | None = None) -> None:
        self.QUERIES[name] = sql_plan(text)
        self.SQL[name] = re.sub(rf"\{{({'|'.join(TABLES)})\}}", r"\1", duck if duck is not None else text)

    def frame(self, name: str, duck: str | None = None):
        def add(f):
            self.QUERIES[name] = f
            if duck is not None:
                self.SQL[name] = duck
            return f

        return add
