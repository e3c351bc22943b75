"""Periodic passes over streams: alerts that go out once, and scores of a trailing window.

Both are functions for ``foreachBatch``. What they have done is in tables keyed by alert or by model and candidate
(``sources.store``), so that a batch that comes again after a crash does nothing twice.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import written
from ..sources import store

LEDGER = StructType().add("alert_id", "string").add("channel", "string").add("ts", "timestamp").add("status", "string")
SCORES = StructType().add("model", "string").add("candidate_id", "string").add("score", "double").add("scored_at", "timestamp")

Clock = Callable[[], dt.datetime]


def clock() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def alert_pass(channels: dict[str, Callable[[DataFrame, int], None]], ledger: str, fresh_s: int = 7200, now: Clock = clock, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Sends each fresh alert to its channel once: at most once, whatever breaks down.

    Rows have alert_id, channel, ts. Alerts older than ``fresh_s`` seconds at the time of the pass are entered as stale and
    never sent, nor are those that the ledger has. The others are claimed in the ledger, then sent, then entered as sent:
    what a pass that broke down had claimed stays claimed, and isn't sent again, as nobody knows whether it went out
    (``unsure`` lists it). Rows of a channel that isn't known are an error before anything is claimed. Of rows with equal
    alert and channel the newest counts; rows without a time are stale, those without an alert_id or a channel are left out.
    """

    def run(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        own = df.where("alert_id is not null and channel is not null").select("alert_id", "channel", "ts").groupBy("alert_id", "channel").agg(F.max("ts").alias("ts"))
        lost = own.where(~F.col("channel").isin(list(channels))).select("channel").first()
        if lost is not None:
            raise ValueError(f"no channel {lost[0]!r} for a row of batch {batch}")
        have = store.rows(spark, ledger, LEDGER).select("alert_id", "channel")
        oldest = F.lit(now() - dt.timedelta(seconds=fresh_s))
        new = own.join(have, ["alert_id", "channel"], "left_anti")
        new = written(new.withColumn("status", F.when(F.col("ts") >= oldest, "claimed").otherwise("stale")))
        # Claims of this batch and their outcome are two changes, so they have two numbers.
        store.merge(new, ledger, ("alert_id", "channel"), 2 * batch, {"status": store.first, "ts": store.first}, buckets=buckets)
        due = df.join(new.where("status = 'claimed'").select("alert_id", "channel"), ["alert_id", "channel"], "left_semi")
        due = written(due.withColumn("__r", F.monotonically_increasing_id()))
        one = due.groupBy("alert_id", "channel").agg(F.max_by("__r", F.struct("ts", "__r")).alias("__r")).select("__r")
        due = due.join(one, "__r", "left_semi").drop("__r")
        for name, send in channels.items():
            send(due.where(F.col("channel") == name), batch)
        sent = new.where("status = 'claimed'").withColumn("status", F.lit("sent"))
        store.merge(sent, ledger, ("alert_id", "channel"), 2 * batch + 1, buckets=buckets)

    return run


def unsure(spark, ledger: str) -> DataFrame:  # noqa: ANN001
    """Alerts that were claimed by a pass that didn't end: whether they went out must be looked up at the channel."""
    return store.rows(spark, ledger, LEDGER).where("status = 'claimed'")


def scoring_pass(score: Callable[[DataFrame], DataFrame], model: str, candidates: str, scores: str, trailing_s: int = 1800, now: Clock = clock, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """Stores the batch's candidates, then scores all of the trailing window that the model hasn't scored.

    Rows have candidate_id and ts, and what score (from rows to rows with a score) takes. ``candidates`` and ``scores`` are
    paths. A candidate that comes again with other values is replaced but not scored again. Rows without an id are left out;
    those without a time are never in the window.
    """

    def run(df: DataFrame, batch: int) -> None:
        spark, at = df.sparkSession, now()
        store.merge(df, candidates, ("candidate_id",), batch, order=("ts",), buckets=buckets)
        held = store.rows(spark, candidates, StructType(list(df.schema)))
        window = held.where(F.col("ts").between(F.lit(at - dt.timedelta(seconds=trailing_s)), F.lit(at)))
        done = store.rows(spark, scores, SCORES).where(F.col("model") == model).select("candidate_id")
        due = window.join(done, "candidate_id", "left_anti")
        made = score(due).select(F.lit(model).alias("model"), F.col("candidate_id").cast("string"), F.col("score").cast("double"), F.lit(at).cast("timestamp").alias("scored_at"))
        keep = dict.fromkeys(("score", "scored_at"), store.first)
        store.merge(made, scores, ("model", "candidate_id"), batch, keep, buckets=buckets)

    return run
