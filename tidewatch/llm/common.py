"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch, at most: texts are long, and a worker holds a batch in several forms.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session sends batches of BATCH_ROWS rows at most to Python workers from now on."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def documents(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that further columns of any name can't clash."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors can reach, below ``spark.checkpoint.dir``.

    Without that setting a local session (tests, one machine) takes the system's temporary folder; on a cluster it fails.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master or "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tidewatch-shared")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    folder = folder or shared_dir(df.sparkSession)
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out.__dict__["folder"] = folder
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made; nothing may read them any more."""
    for df in tables:
        spark, folder = df.sparkSession, df.__dict__["folder"]
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more rows than this is hot; with so many rows in all that over HOT_KEYS keys are, only those with more still.
HOT_ROWS = 2000
HOT_KEYS = 100_000


def hot_keys(rows: DataFrame, key: str, most: int | None = None, counts: DataFrame | None = None) -> DataFrame | None:
    """The hot keys of rows with the number of parts (``__parts``) that their rows are dealt to; None if there are none.

    At most HOT_KEYS keys, fit to be broadcast. Counts combine before they are shuffled; those that are known already can be
    given (key, ``__n``).
    """
    limit = most or HOT_ROWS
    counts = (counts if counts is not None else rows.groupBy(key).agg(F.count("*").alias("__n"))).where(F.col("__n") > limit)
    hot = written(counts)
    while (n := hot.count()) > HOT_KEYS:
        limit *= 2
        hot = hot.where(F.col("__n") > limit)
    return hot.select(key, F.ceil(F.col("__n") / limit).cast("int").alias("__parts")) if n else None


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counted: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """left joined with right, which has a row for each key at most: rows of a hot key of left go to several tasks.

    counted: a written table with the keys of left, where left is dearer to read; counts: see ``hot_keys``.
    """
    hot = hot_keys(left if counted is None else counted, key, counts=counts)
    if hot is None:
        return left.join(right, key, how)
    parts = F.coalesce("__parts", F.lit(1))
    dealt = F.pmod(F.xxhash64(*left.columns), parts).cast("int")
    a = left.join(F.broadcast(hot), key, "left").withColumn("__part", dealt).drop("__parts")
    b = right.join(F.broadcast(hot), key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return a.join(b, [key, "__part"], how).drop("__part")


def released(values: Iterable) -> Iterable:
    """Hands values on; at the end of the task, memory that is kept for later goes back to the system."""
    try:
        yield from values
    finally:
        give_back()


def give_back() -> None:
    """Free memory of Arrow's pool and of the C library, which idle workers would keep beside those at work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def column_list(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
