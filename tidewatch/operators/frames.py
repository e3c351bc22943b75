"""Frames for training: what was known of each decision at its time, its label, and its holdouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Evaluation
from ..functions import scalars as S
from . import evaluation as E
from . import joins as J

#: A key's rows are taken in slices of so many seconds, so that a hot key has many tasks.
SLICE_S = 86_400


def as_of_streams(rows: DataFrame, streams: dict[str, DataFrame], key: str, tie: dict[str, str] | None = None, within_s: dict[str, int] | None = None, slice_s: int = SLICE_S) -> DataFrame:
    """rows with a struct for each stream, named after it: its latest row of the key at or before ts, ties by ``tie``.

    All streams are put in one order by key and time with the rows, a struct column each, so that there is one shuffle and
    one sort, however many streams there are. Keys are cut into slices of time; what the slices before end with, a row for
    each key and slice, is carried over. within_s: how old a stream's row may be. Rows without a key or a time, and those
    without a match, have nulls; rows of streams without them match nothing.
    """
    ties, far, names = tie or {}, within_s or {}, list(streams)
    kinds = {n: df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType for n, df in streams.items()}
    row_kind = rows.select(F.struct(*rows.columns).alias("s")).schema["s"].dataType

    def part(df: DataFrame, name: str | None, order: Column) -> DataFrame:
        values = [(F.struct(*df.columns) if n == name else F.lit(None).cast(kinds[n])).alias(f"__s_{n}") for n in names]
        own = (F.struct(*df.columns) if name is None else F.lit(None).cast(row_kind)).alias("__row")
        place = F.floor(F.unix_micros("ts") / F.lit(slice_s * 1_000_000)).alias("__slice")
        return df.select(F.col(key).alias("__k"), F.col("ts").alias("__t"), place, order.alias("__order"), own, *values)

    known = F.col(key).isNotNull() & F.col("ts").isNotNull()
    last = F.struct(F.lit(1).alias("after"), F.lit(None).cast("string").alias("tie"))
    every = part(rows.where(known), None, last)
    for n, df in streams.items():
        own = F.col(ties[n]).cast("long") if n in ties else F.lit(None).cast("long")
        # ties are numbers; as text they keep their order
        text = F.when(own.isNotNull(), F.lpad((own.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0"))
        every = every.unionByName(part(df.where(known), n, F.struct(F.lit(0).alias("after"), text.alias("tie"))))
    w = Window.partitionBy("__k", "__slice").orderBy("__t", "__order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = every.where("__row is null").groupBy("__k", "__slice").agg(*(F.max_by(f"__s_{n}", F.when(F.col(f"__s_{n}").isNotNull(), F.struct("__t", "__order"))).alias(f"__e_{n}") for n in names))
    over = Window.partitionBy("__k").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    wanted = every.where("__row is not null").select("__k", "__slice").distinct()
    slices = ends.unionByName(wanted.join(ends.select("__k", "__slice"), ["__k", "__slice"], "left_anti"), allowMissingColumns=True)
    before = slices.select("__k", "__slice", *(F.last(f"__e_{n}", ignorenulls=True).over(over).alias(f"__b_{n}") for n in names))
    inside = every.select("__k", "__slice", "__t", "__row", *(F.last(f"__s_{n}", ignorenulls=True).over(w).alias(f"__s_{n}") for n in names)).where("__row is not null")
    joined = inside.join(before, ["__k", "__slice"], "left")

    def value(n: str) -> Column:
        found = F.coalesce(f"__s_{n}", f"__b_{n}")
        if n in far:
            found = F.when(F.unix_micros("__t") - F.unix_micros(found["ts"]) <= far[n] * 1_000_000, found)
        return found.alias(n)

    out = joined.select("__row.*", *(value(n) for n in names))
    return out.unionByName(rows.where(~known), allowMissingColumns=True)


def training_frame(rows: DataFrame, streams: dict[str, DataFrame], quotes: DataFrame, c: Evaluation = Evaluation(), tie: dict[str, str] | None = None, within_s: dict[str, int] | None = None, liquid_s: int = 1800) -> DataFrame:
    """rows with features as of their time, label, liquidity bucket, and the holdouts by family, category and time.

    rows: id, market_id, event_family_id, category, ts, velocity, acceleration, label (null: not known yet). streams: see
    ``as_of_streams``. quotes: market_id, ts, id, spread; the first one within ``liquid_s`` after the decision tells how liquid
    the market is. Missing holdouts have a name of their own, so no row is lost.
    """
    frame = as_of_streams(rows, streams, "market_id", tie, within_s)
    frame = J.as_of(frame, quotes.select("market_id", "ts", "id", "spread"), "market_id", "__q", forward=True, within_s=liquid_s, tie="id")
    frame = E.family_folds(frame, "event_family_id", c).withColumnRenamed("fold", "event_family_holdout")
    unknown = lambda column, name: F.coalesce(column, F.lit(name))
    frame = frame.withColumns({
        "direction": unknown(S.direction(F.col("velocity")), "unknown"),
        "label_success": F.col("label").cast("double"),
        "label_available": F.col("label").isNotNull(),
        "liquidity_bucket": S.liquidity(F.col("__q.spread")),
        "event_family_holdout": unknown(F.col("event_family_holdout"), "fold_unknown"),
        "category_holdout": unknown(F.lower(F.trim(S.blank_to_null(F.col("category")))), "unknown"),
        "time_holdout": unknown(S.time_block(F.col("ts"), c), "time_block:unknown"),
        "velocity_abs": F.abs("velocity"),
        "acceleration_abs": F.abs("acceleration"),
    })
    return E.time_split(frame.drop("__q"), "time_holdout").withColumnRenamed("partition", "dataset_partition")
