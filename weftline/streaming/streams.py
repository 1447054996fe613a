"""Structured Streaming forms of the windowed, deduplicating and state-carrying operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from weftline.operators.shared import folder


def sessions(rows: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n) of sessions that a silence of `gap` ends; rows later than `late` are left out of a stream."""
    return rows.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windows(rows: DataFrame, at: str, key: str, size: str, slide: str | None, late: str) -> DataFrame:
    """(key, start, end, n) of tumbling windows, or of sliding ones if `slide` is given, behind a watermark."""
    return rows.withWatermark(at, late).groupBy(F.window(at, size, slide).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unseen(rows: DataFrame, ids: list[str], at: str | None = None, late: str | None = None) -> DataFrame:
    """Each id once, also across restarts: the state is in the stream's checkpoint, bounded by the watermark if given."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(ids) if at and late else rows.dropDuplicates(ids)


def carried(rows: DataFrame, key: str, order: str, mark: str, text: str) -> DataFrame:
    """(key, record, mark, text): records that a mark opens, carried from batch to batch of a stream.

    The state of a key is its open record. A row with a mark closes the open record and opens the next; other rows add
    their text to it; texts before the first mark have record 0. What is open at the end stays in the state.
    """
    out = T.StructType([rows.schema[key], T.StructField("record", T.LongType()), T.StructField("mark", T.StringType()), T.StructField("text", T.StringType())])

    def run(k, frames, state):
        import pandas as pd

        n, open_, parts = state.get if state.exists else (0, None, "")
        done = []
        for frame in frames:
            for m, t in frame.sort_values(order)[[mark, text]].itertuples(index=False):
                if m is not None and m == m and m != "":
                    if n or parts:
                        done.append((k[0], n, open_, parts))
                    n, open_, parts = n + 1, m, t or ""
                else:
                    parts = f"{parts} {t}".strip() if t else parts
        state.update((n, open_, parts))
        yield pd.DataFrame(done, columns=out.names)

    return rows.groupBy(key).applyInPandasWithState(run, out, "n long, mark string, text string", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str = "append", change: Callable[[DataFrame], DataFrame] | None = None, where: str | None = None) -> DataFrame:
    """Runs a stream over all that is there, and gives what it wrote; its files and checkpoint lie in the shared folder.

    With `where`, a folder of an earlier call, the stream resumes: only what is new is read, and results are added.
    """
    spark = stream.sparkSession
    base = where or f"{folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        done = change(batch) if change else batch
        done.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    schema = (change(spark.createDataFrame([], stream.schema)) if change else stream).schema
    out = spark.read.schema(schema).parquet(f"{base}/out")
    return out.select(*schema.names)


def follow(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files under a path, with the schema of those there now; a single file is a stream of one."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    folder_, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder_) if single else reader.parquet(path)
