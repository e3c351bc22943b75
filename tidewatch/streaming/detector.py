"""The detector over a stream of trades and quotes, event by event, in any order of arrival.

Two stateful steps: ``with_first_seen`` is keyed by wallet (the first trade of all that is processed counts), ``detect`` by
market. They are separate queries joined by a landing folder, so that each has one key and its own checkpoint. Within a
micro-batch, events of a key are taken in order of ``seq``. Late events are never dropped: an event is judged at its own
time against the points that are still held, as in the batch form, which shares the windows and the cooldown.

State is kept in RocksDB by ``transformWithState``: a wallet's first time as a value, a market's points as lists, its last
candidate as a value. Points older than the history go with the next event. A market that falls silent keeps its points for
``idle_s`` seconds of the clock, if that is given; a timer frees them then. ``session.streaming`` sets the store.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Detector
from ..operators.detector import FEATURES, cooldown, limits
from ..operators.windows import MarketWindow

EVENT = "seq long, kind string, market_id string, ts timestamp, wallet string, side string, outcome_side string, notional double, price double"
SEEN = f"{EVENT}, first_seen timestamp"
CANDIDATE = "seq long, market_id string, ts timestamp, " + ", ".join(f"{n} {k}" for n, k in FEATURES.items()) + ", severity double, rules array<string>, emitted boolean"
_NAMES = [x.split()[0] for x in CANDIDATE.split(", ")]
_TRADE = "ts long, wallet string, side string, outcome_side string, notional double, first_seen long"


def _none(x: Any) -> Any:
    return None if pd.isna(x) else x


def _micros(x: Any) -> int | None:
    return None if pd.isna(x) else pd.Timestamp(x).value // 1000


class _Wallet(StatefulProcessor):
    """The time of a wallet's first trade."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "micros long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq")
        if _none(key[0]) in (None, ""):
            yield events.assign(first_seen=pd.NaT)
            return
        if not self.first.exists():
            timed = events["ts"].dropna()
            if timed.empty:
                yield events.assign(first_seen=pd.NaT)
                return
            self.first.update((_micros(timed.iloc[0]),))
        yield events.assign(first_seen=pd.Timestamp(self.first.get()[0], unit="us"))

    def close(self) -> None:
        pass


def with_first_seen(events: DataFrame) -> DataFrame:
    """Adds first_seen, the time of the wallet's first processed trade; null for quotes and trades without a wallet.

    A trade without a time or a market makes no wallet known. Quotes have no wallet.
    """
    known = events.withColumn("wallet", F.when((F.col("kind") != "quote") & F.col("market_id").isNotNull(), F.col("wallet")))
    return known.groupBy("wallet").transformWithStateInPandas(_Wallet(), SEEN, "Append", "None")


def judged(features: dict[str, Any], c: Detector) -> dict[str, Any] | None:
    """Features as they are told, with severity and rules; None if no rule fires."""
    severity = round(sum(abs(features[n]) / limit for n, limit in limits(c).items()), 6)
    f = {n: round(x, 6) if FEATURES[n] == "double" else x for n, x in features.items()}
    moving = abs(f["velocity"]) >= c.velocity
    rules = []
    if moving and f["fresh_count"] >= c.fresh_wallets and f["fresh_share"] >= c.fresh_share:
        rules.append("fresh_wallet_burst")
    if f["concentration"] >= c.concentration and f["imbalance"] >= c.imbalance:
        rules.append("concentrated_directional_flow")
    faster = moving and abs(f["acceleration"]) >= c.acceleration and f["volume_acceleration"] >= c.volume_acceleration
    if faster and (f["fresh_count"] > 0 or f["concentration"] >= c.concentration):
        rules.append("fast_repricing_with_wallet_support")
    return f | {"severity": severity, "rules": rules} if rules else None


class _Market(StatefulProcessor):
    """The held points of a market and its last candidate."""

    def __init__(self, settings: Detector, idle_s: int | None) -> None:
        self.c, self.idle_s = settings, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trades = handle.getListState("trades", _TRADE)
        self.prices = handle.getListState("prices", "ts long, price double")
        self.last = handle.getValueState("last", "ts long, severity double, rules array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        c, step = self.c, cooldown(self.c)
        trades = [tuple(x) for x in self.trades.get()] if self.trades.exists() else []
        prices = [tuple(x) for x in self.prices.get()] if self.prices.exists() else []
        window = MarketWindow.restored(c, trades, prices)
        last = dict(zip(("ts", "severity", "rules"), self.last.get(), strict=True)) if self.last.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            ts, price = _micros(r.ts), _none(r.price)
            if r.kind == "quote":
                window.quote(ts, price)
                continue
            window.trade(ts, _none(r.wallet), _none(r.side), _none(r.outcome_side), _none(r.notional), price, _micros(r.first_seen))
            found = window.features(ts)
            found = judged(found, c) if found else None
            p = _none(r.yes_probability)
            if not found or not (p is None or c.band_low <= p <= c.band_high):
                continue
            last, emitted = step(last, {"ts": ts, "severity": found["severity"], "rules": found["rules"]})
            times = {n: pd.Timestamp(found[n], unit="us") for n in ("episode_start", "episode_end")}
            out.append({"seq": r.seq, "market_id": key[0], "ts": r.ts, "emitted": emitted} | found | times)
        trades, prices = window.held()
        for state, points in ((self.trades, trades), (self.prices, prices)):
            if points:
                state.put(points)
            else:
                state.clear()
        if last is not None:
            self.last.update((last["ts"], last["severity"], list(last["rules"])))
        if self.idle_s is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.idle_s)
        yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        for state in (self.trades, self.prices, self.last):
            state.clear()
        yield pd.DataFrame([], columns=_NAMES)

    def close(self) -> None:
        pass


def detect(events: DataFrame, settings: Detector = Detector(), probabilities: DataFrame | None = None, idle_s: int | None = None) -> DataFrame:
    """Candidates of a stream of events with first_seen. Events without a market or a time are left out.

    probabilities: market_id and yes_probability, a static table that is read anew by each micro-batch; candidates of
    markets outside the band neither go out nor cool down. idle_s: after so many seconds of the clock without an event a
    market's state is freed; give at least the history and the cooldown, and none at all in a replay, whose clock runs
    otherwise than its events.
    """
    rows = events.where("market_id is not null and ts is not null")
    if probabilities is None:
        rows = rows.withColumn("yes_probability", F.lit(None).cast("double"))
    else:
        rows = rows.join(probabilities.select("market_id", F.col("yes_probability").cast("double")), "market_id", "left")
    mode = "None" if idle_s is None else "ProcessingTime"
    return rows.groupBy("market_id").transformWithStateInPandas(_Market(settings, idle_s), CANDIDATE, "Append", mode)
