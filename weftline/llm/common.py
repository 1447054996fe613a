"""Shared folder, lineage cuts and worker shipping for the training-data operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import weftline

# Functions of this package travel to the workers by value: no executor needs it installed.
cloudpickle.register_pickle_by_value(weftline)

#: White space of every word rule here, and its complement, as regular expressions.
SPACE, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"

_written: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes a table in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of cut() that no later plan reads."""
    for df in tables:
        path = getattr(df, "_weft_path", None)
        if path and _written.pop(path, None):
            _delete(df.sparkSession, path)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_written.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone; the folder is the cluster's to clean
            return


def drop_shuffles(df: DataFrame) -> None:
    """Has the driver collect its garbage, so that the shuffle files of plans that are over leave the disk.

    Twice: right after a plan its end is still being told to listeners, and the first collection frees nothing.
    """
    for _ in range(2):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a written table has at most so many rows: the check before a broadcast."""
    return df.limit(rows + 1).count() <= rows


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keeps Arrow batches of texts small in workers, unless the session has its own setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") in (None, "10000"):
        spark.conf.set(name, str(rows))
