"""Stored tables that are merged by key: only the buckets that a batch touches are read and written again.

A table lies in folders by a hash of its key. A merge reads the touched buckets (their folders alone), joins them with the
batch, and replaces these folders by dynamic partition overwrite, which takes place when all tasks are done. Rows carry the
number of the batch that changed them last: a batch that comes again finds its rows changed already and leaves them alone,
so sums and counts are safe from replays, and a merge that was cut off between two folders is finished by running it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import written

Merge = Callable[[Column, Column], Column]

#: Ways to bring an old and a new value together.
latest: Merge = lambda old, new: new
first: Merge = lambda old, new: old
known: Merge = lambda old, new: F.coalesce(new, old)
largest: Merge = lambda old, new: F.greatest(old, new)
added: Merge = lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))


def bucket(keys: tuple[str, ...], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The table with its bucket and batch columns; None if there is none yet."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(conf).exists(place):
        return None
    return spark.read.schema(schema.add("__batch", "long").add("__bucket", "integer")).parquet(path)


def rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table's rows; none if there is no table yet."""
    found = read(spark, path, StructType(list(schema)))
    return spark.createDataFrame([], schema) if found is None else found.drop("__batch", "__bucket")


def merge(df: DataFrame, path: str, keys: tuple[str, ...], batch: int, how: dict[str, Merge] | None = None, order: tuple[Column | str, ...] = (), buckets: int = 64) -> list[int]:
    """Merges df into the table at path; the buckets that were written.

    df has a row for each key, or else an order by which the last row of a key counts (nulls first). Rows without a part of
    the key are left out, as nothing could be merged with them. how: what becomes of a column of keys that both have; others
    take the new value. A row that a batch of this number or a later one has changed already stays. An empty df touches
    nothing. Batches must come one after the other; ``buckets`` belongs to the table and must not change.
    """
    spark, how = df.sparkSession, how or {}
    others = [c for c in df.columns if c not in keys]
    df = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    if order:
        best = df.groupBy(*keys).agg(F.max(F.struct(F.struct(*order).alias("o"), F.struct(*others).alias("v"))).alias("__m"))
        df = best.select(*keys, *(F.col(f"__m.v.{c}").alias(c) for c in others))
    new = written(df.withColumn("__bucket", bucket(keys, buckets)))
    touched = sorted(r[0] for r in new.select("__bucket").distinct().collect())
    if not touched:
        return []
    schema = StructType([f for f in df.schema])
    old = read(spark, path, StructType(list(schema)))
    fresh = new.withColumn("__batch", F.lit(batch).cast("long"))
    if old is None:
        out = fresh
    else:
        old = old.where(F.col("__bucket").isin(touched))
        o, n = old.alias("o"), fresh.alias("n")
        both = o.join(n, ["__bucket", *keys], "full")
        has_old, has_new = F.col("o.__batch").isNotNull(), F.col("n.__batch").isNotNull()
        stays = ~has_new | (has_old & (F.col("o.__batch") >= batch))

        def value(c: str) -> Column:
            together = how.get(c, latest)(F.col(f"o.{c}"), F.col(f"n.{c}")).cast(schema[c].dataType)
            return F.when(stays, F.col(f"o.{c}")).when(has_old, together).otherwise(F.col(f"n.{c}")).alias(c)

        number = F.when(stays, F.col("o.__batch")).otherwise(F.lit(batch).cast("long")).alias("__batch")
        out = both.select(*keys, *(value(c) for c in others), number, "__bucket")
    out = out.select(*schema.names, "__batch", "__bucket").repartition(len(touched), "__bucket")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(path)
    return touched
