"""The detector over trades, as a batch: window features, severity, rules, probability filter, cooldown.

The features of a trade look back over its market: the current window and the one before, as of its arrival. A market's
order of arrival is cut into epochs, a window's length of the newest time so far each. What an epoch's trades can see
arrived in it or in the few epochs that the history reaches back to, so points are sent to these epochs too, and an epoch,
not a market, is a task's unit: it takes the points in order of arrival, as the stream does (``windows.MarketWindow``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Detector
from ..functions import scalars as S
from .folds import BLOCK_ROWS, Step, blocks, folded
from .windows import MarketWindow

_COUNTS = ("fresh_count", "n_wallets", "n_trades", "n_prices")
_TIMES = ("episode_start", "episode_end")
FEATURES = {
    "fresh_count": "int", "fresh_share": "double", "imbalance": "double", "concentration": "double", "velocity": "double", "acceleration": "double",
    "volume_acceleration": "double", "notional": "double", "previous_notional": "double", "buy_notional": "double", "sell_notional": "double",
    "yes_notional": "double", "no_notional": "double", "active_side": "string", "active_notional": "double", "n_wallets": "int", "n_trades": "int",
    "n_prices": "int", "episode_start": "timestamp", "episode_end": "timestamp",
}
_ROUNDED = tuple(n for n, kind in FEATURES.items() if kind == "double")
_POINT = ("wallet", "side", "outcome_side", "notional", "price", "first_seen")


def _epochs(trades: DataFrame, c: Detector, block_rows: int) -> DataFrame:
    """The points with first_seen (of their wallet, by arrival), time in microseconds and epoch.

    The newest time so far is a running maximum in the order of arrival: within blocks of the order, and over the blocks
    before.
    """
    rows = trades.where("market_id is not null and ts is not null").select("seq", "market_id", F.unix_micros("ts").alias("__t"), *_POINT[:-1])
    placed = blocks(rows, "market_id", "seq", block_rows=block_rows)
    inside = F.max("__t").over(Window.partitionBy("__block", "market_id").orderBy("__place"))
    tops = placed.groupBy("market_id", "__block").agg(F.max("__t").alias("top"))
    before = F.max("top").over(Window.partitionBy("market_id").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    carried = tops.select("market_id", "__block", before.alias("__before")).where("__before is not null")
    first = placed.where("wallet is not null and notional is not null").groupBy("wallet").agg(F.min_by("__t", "seq").alias("first_seen"))
    rows = placed.withColumn("__inside", inside).join(carried, ["market_id", "__block"], "left").join(first, "wallet", "left")
    newest = F.greatest("__inside", F.coalesce("__before", "__inside"))
    return rows.withColumn("__epoch", F.floor(newest / F.lit(c.window_s * 1_000_000)))


def _judged(c: Detector):
    """Features at the trades of an epoch; points are grouped by market and epoch, and in order of arrival within."""
    schema = pa.schema([("seq", pa.int64()), ("market_id", pa.string()), ("ts", pa.int64())] + [(n, pa.int64() if k in ("int", "timestamp") else pa.string() if k == "string" else pa.float64()) for n, k in FEATURES.items()])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, window = None, MarketWindow(c)
        for batch in batches:
            out: list[dict] = []
            columns = batch.to_pydict()
            for market, group, epoch, seq, t, *point in zip(*(columns[n] for n in ("market_id", "__group", "__epoch", "seq", "__t", *_POINT)), strict=True):
                if (market, group) != key:
                    key, window = (market, group), MarketWindow(c)
                wallet, side, outcome, notional, price, first_seen = point
                if notional is None:
                    window.quote(t, price)
                    continue
                window.trade(t, wallet, side, outcome, notional, price, first_seen)
                if epoch == group and (found := window.features(t)):
                    out.append({"seq": seq, "market_id": market, "ts": t} | found)
            yield pa.RecordBatch.from_pylist(out, schema)

    return of


def _raw_features(trades: DataFrame, c: Detector, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row of window features, not rounded, for each trade whose window holds enough notional.

    trades: seq (order of arrival), market_id, ts, wallet, side, outcome_side, notional, price. Times may be equal or out of
    order: a trade is judged at its own time against all points that arrived before and are still held. Fresh wallets have
    their first trade of all in the window. Quotes may be among the rows: they have a price and no notional; trades without
    a price leave the price as it is. Rows without a market or a time are left out; an empty table gives no rows.
    """
    reach = -(-max(c.history_s, 2 * c.window_s) // c.window_s)
    rows = _epochs(trades, c, block_rows)
    sent = rows.select("*", F.explode(F.sequence(F.col("__epoch"), F.col("__epoch") + reach)).alias("__group"))
    sent = sent.select("market_id", "__group", "__epoch", "seq", "__t", *_POINT).repartition("market_id", "__group").sortWithinPartitions("market_id", "__group", "seq")
    kinds = ", ".join(f"{n} {'long' if k in ('int', 'timestamp') else k}" for n, k in FEATURES.items())
    out = sent.mapInArrow(_judged(c), f"seq long, market_id string, ts long, {kinds}")
    casts = {n: F.col(n).cast("int") for n in _COUNTS} | {n: F.timestamp_micros(n) for n in ("ts", *_TIMES)}
    return out.withColumns(casts)


def features(trades: DataFrame, c: Detector = Detector(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The window features of each trade (see ``FEATURES``), rounded to six places."""
    return _raw_features(trades, c, block_rows).withColumns({n: F.round(n, 6) for n in _ROUNDED})


#: The least threshold that a feature is divided by.
_LEAST = {"fresh_count": 1, "fresh_share": 0.01, "imbalance": 0.01, "concentration": 0.01, "velocity": 1e-4, "acceleration": 1e-4, "volume_acceleration": 0.01}


def limits(c: Detector) -> dict[str, float]:
    """What each feature is divided by in the severity."""
    own = {"fresh_count": c.fresh_wallets, "fresh_share": c.fresh_share, "imbalance": c.imbalance, "concentration": c.concentration}
    own |= {"velocity": c.velocity, "acceleration": c.acceleration, "volume_acceleration": c.volume_acceleration}
    return {n: float(max(x, _LEAST[n])) for n, x in own.items()}


def severity(c: Detector = Detector()) -> Column:
    """Sum of the features' ratios to their thresholds."""
    out = F.lit(0.0)
    for name, limit in limits(c).items():
        out = out + F.abs(F.col(name)) / F.lit(limit)
    return out


def rules(c: Detector = Detector()) -> Column:
    """Names of the rule families that fire. Fresh wallets count while the price moves."""
    fresh = (F.col("fresh_count") >= c.fresh_wallets) & (F.col("fresh_share") >= c.fresh_share) & (F.abs("velocity") >= c.velocity)
    flow = (F.col("concentration") >= c.concentration) & (F.col("imbalance") >= c.imbalance)
    moving = (F.abs("velocity") >= c.velocity) & (F.abs("acceleration") >= c.acceleration) & (F.col("volume_acceleration") >= c.volume_acceleration)
    support = (F.col("fresh_count") > 0) | (F.col("concentration") >= c.concentration)
    return F.array_compact(F.array(F.when(fresh, "fresh_wallet_burst"), F.when(flow, "concentrated_directional_flow"), F.when(moving & support, "fast_repricing_with_wallet_support")))


def candidates(trades: DataFrame, c: Detector = Detector(), probabilities: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Trades at which a rule fires, with features, severity (of features as they are) and rules (of rounded ones).

    probabilities: market_id and yes_probability, a row for each market. Candidates of markets outside the band go, those of
    markets without a probability stay; what goes neither cools down nor suppresses.
    """
    judged = _raw_features(trades, c, block_rows).withColumn("severity", F.round(severity(c), 6)).withColumns({n: F.round(n, 6) for n in _ROUNDED})
    found = judged.withColumn("rules", rules(c)).where(F.size("rules") > 0)
    if probabilities is None:
        return found
    known = probabilities.select("market_id", F.col("yes_probability").alias("__p"))
    return found.join(known, "market_id", "left").where(S.in_probability_band(F.col("__p"), c.band_low, c.band_high)).drop("__p")


def cooldown(c: Detector = Detector()) -> Step:
    """Takes a market's last emitted candidate and the next one; the one that is remembered, and whether the next goes out.

    A candidate has ts (microseconds), severity and rules.
    """
    reach, growth = c.cooldown_s * 1_000_000, c.escalation

    def step(last, x):  # noqa: ANN001, ANN202
        known = last is not None and None not in (last["ts"], x["ts"], last["severity"], x["severity"])
        near = known and x["ts"] - last["ts"] < reach and x["severity"] < growth * last["severity"]
        held = near and any(r is not None and r in (last["rules"] or ()) for r in x["rules"] or ())
        return (last, False) if held else (x, True)

    return step


def cooled(found: DataFrame, c: Detector = Detector(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """found with ``emitted``: false within the cooldown of the last emitted one of the market, if the rules overlap and the
    severity hasn't grown enough.

    The state of a market is its last emitted candidate; markets are folded in blocks of time (``folds.folded``). Without a
    time or a severity on either side, nothing is held back.
    """
    needs = {"ts": F.unix_micros("ts"), "severity": F.col("severity").cast("double"), "rules": F.col("rules")}
    return folded(found, ("market_id",), ("seq",), needs, cooldown(c), "emitted", block_rows)


def melted(found: DataFrame, names: tuple[str, ...] = ("fresh_count", "fresh_share", "imbalance", "concentration", "velocity", "acceleration", "volume_acceleration")) -> DataFrame:
    """A row for each numeric feature."""
    wide = found.select("seq", *(F.col(n).cast("double") for n in names))
    return wide.unpivot("seq", list(names), "feature_name", "feature_value")


def recorded(found: DataFrame, version: str, known: DataFrame | None = None) -> DataFrame:
    """Candidates that aren't known yet, one for each detector version, market and time, with candidate_id and episode_id.

    Of several with the same natural key the first to arrive (smallest seq) counts. known: detector_version, market_id and
    ts of candidates already stored. Null markets and times are keys like others. Ids are digests of the key, so a run
    repeated gives the same rows, and none once they are stored.
    """
    keys = ("detector_version", "market_id", "ts")
    rest = [c for c in found.columns if c not in keys and c != "seq"]
    rows = found.withColumn("detector_version", F.lit(version))
    rows = rows.groupBy(*keys).agg(F.min_by(F.struct("seq", *rest), "seq").alias("__c")).select(*keys, "__c.*")
    if known is not None:
        same = [F.col(f"r.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
        rows = rows.alias("r").join(known.select(*keys).alias("k"), same, "left_anti")
    text = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in (F.col("detector_version"), F.col("market_id"), F.unix_micros("ts"))))
    return rows.withColumns({"candidate_id": F.substring(F.sha1(text), 1, 16), "episode_id": F.substring(F.sha1(F.concat(F.lit("episode|"), text)), 1, 16)})
