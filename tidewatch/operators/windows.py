"""The points of one market that the detector still holds, and what its windows say at a trade.

Batch and stream share this class. Sums are of whole units of 1e-12, so that adding and taking away leaves no trace, and no
result depends on an order of addition; they are told to nine decimals. Times are whole microseconds.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections import Counter
from typing import Any

from ..config import Detector

UNIT = 10**12


def amount_of(units: int) -> float:
    return round(units / UNIT, 9)


class Line:
    """Points in order of their key; those from the mark on are in the window. What was let go lies before ``low`` for a while."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.points: list[tuple] = []
        self.low = self.mark = 0

    def at(self, key: int) -> int:
        """The place of the first point from a key on."""
        return bisect_left(self.keys, key, self.low)

    def add(self, key: int, point: tuple) -> bool:
        """Adds after all points of the same key; whether it fell into the window."""
        at = bisect_right(self.keys, key, self.low)
        self.keys.insert(at, key)
        self.points.insert(at, point)
        if at < self.mark:
            self.mark += 1
            return False
        return True

    def moved(self, start: int) -> tuple[list[tuple], list[tuple]]:
        """Puts the mark at the first key from start on: points that came in, points that went out."""
        at, before = self.at(start), self.mark
        self.mark = at
        return self.points[at:before], self.points[before:at]

    def cut(self, low: int) -> None:
        """Lets all points before a place go."""
        self.low, self.mark = low, max(low, self.mark)
        if low > 1000 and 2 * low > len(self.keys):
            del self.keys[:low], self.points[:low]
            self.low, self.mark = 0, self.mark - low

    def drop(self, key: int, point: tuple) -> bool:
        """Takes a point away; whether it was in the window."""
        at = self.at(key)
        while self.points[at] is not point:
            at += 1
        del self.keys[at], self.points[at]
        if at < self.mark:
            self.mark -= 1
            return False
        return True


class Largest:
    """Sums by wallet, with the largest at hand: a heap in which outdated entries are passed over."""

    def __init__(self) -> None:
        self.sums: dict[str, int] = {}
        self.counts: Counter[str] = Counter()
        self.heap: list[tuple[int, str]] = []

    def change(self, wallet: str, amount: int, sign: int) -> None:
        self.counts[wallet] += sign
        if not self.counts[wallet]:
            del self.counts[wallet], self.sums[wallet]
            return
        self.sums[wallet] = now = self.sums.get(wallet, 0) + sign * amount
        heapq.heappush(self.heap, (-now, wallet))
        if len(self.heap) > 4 * len(self.sums) + 64:
            self.heap = [(-x, w) for w, x in self.sums.items()]
            heapq.heapify(self.heap)

    def top(self) -> int:
        while self.heap:
            least, wallet = self.heap[0]
            if self.sums.get(wallet) == -least:
                return -least
            heapq.heappop(self.heap)
        return 0


class MarketWindow:
    """Points of a market, in any order of arrival. Each point has a time; late ones are taken at their own.

    A trade's window holds all held trades from its start on, newer ones too if they arrived before. What is older than the
    history of the last point is let go. Costs of a point are logarithmic, and as many steps as points lie between its time
    and the last one's.
    """

    def __init__(self, settings: Detector) -> None:
        self.c = settings
        self.window, self.history = settings.window_s * 1_000_000, max(settings.history_s, 2 * settings.window_s) * 1_000_000
        self.trades, self.earlier, self.fresh, self.prices = Line(), Line(), Line(), Line()
        self.total = self.past = self.fresh_total = self.arrived = 0
        self.sides: Counter[str] = Counter()
        self.outcomes: Counter[str] = Counter()
        self.outcome_trades: Counter[str] = Counter()
        self.wallets, self.fresh_wallets = Largest(), Counter()

    def quote(self, ts: int, price: float | None) -> None:
        if price is not None:
            self.prices.add(ts, (ts, float(price)))
        self._prune(ts)

    def trade(self, ts: int, wallet: str | None, side: str | None, outcome: str | None, notional: float | None, price: float | None, first_seen: int | None) -> None:
        self._add(ts, wallet or None, side, outcome, notional or 0.0, first_seen)
        self.quote(ts, price)

    def held(self) -> tuple[list[tuple], list[tuple]]:
        """Trades, in order of arrival, and prices, in order of time: what ``restored`` takes."""
        trades = sorted(self.trades.points[self.trades.low :], key=lambda p: p[5])
        return [(ts, wallet, side, outcome, amount / UNIT, seen) for ts, wallet, side, outcome, amount, _, seen in trades], self.prices.points[self.prices.low :]

    @classmethod
    def restored(cls, settings: Detector, trades: list[tuple], prices: list[tuple]) -> MarketWindow:
        out = cls(settings)
        for p in trades:
            out._add(*p)
        for ts, price in prices:
            out.prices.add(ts, (ts, price))
        return out

    def _add(self, ts: int, wallet: str | None, side: str | None, outcome: str | None, notional: float, first_seen: int | None) -> None:
        amount = round(notional * UNIT)
        point = (ts, wallet, side, outcome, amount, self.arrived, first_seen)
        self.arrived += 1
        if self.trades.add(ts, point):
            self._count(point, 1)
        if self.earlier.add(ts, point):
            self.past += amount
        if wallet is not None and first_seen is not None and self.fresh.add(min(ts, first_seen), point):
            self._count_fresh(point, 1)

    def _count(self, p: tuple, sign: int) -> None:
        _, wallet, side, outcome, amount, _, _ = p
        self.total += sign * amount
        if side is not None:
            self.sides[side] += sign * amount
        if outcome is not None:
            self.outcomes[outcome] += sign * amount
            self.outcome_trades[outcome] += sign
        if wallet is not None:
            self.wallets.change(wallet, amount, sign)

    def _count_fresh(self, p: tuple, sign: int) -> None:
        self.fresh_total += sign * p[4]
        self.fresh_wallets[p[1]] += sign
        if not self.fresh_wallets[p[1]]:
            del self.fresh_wallets[p[1]]

    def _prune(self, now: int) -> None:
        oldest = now - self.history
        trades, earlier, prices = self.trades, self.earlier, self.prices
        n = trades.at(oldest)
        if n > trades.low:
            for p in trades.points[trades.mark : n]:
                self._count(p, -1)
            for p in earlier.points[earlier.mark : n]:
                self.past -= p[4]
            for p in trades.points[trades.low : n]:
                if p[1] is not None and p[6] is not None and self.fresh.drop(min(p[0], p[6]), p):
                    self._count_fresh(p, -1)
            trades.cut(n)
            earlier.cut(n)
        prices.cut(prices.at(oldest))

    def _velocity(self, low: int, high: int | None) -> float:
        a = self.prices.at(low)
        b = len(self.prices.points) if high is None else self.prices.at(high)
        if b - a < 2:
            return 0.0
        first, last = self.prices.points[a], self.prices.points[b - 1]
        return (last[1] - first[1]) / ((last[0] - first[0]) / 60e6) if last[0] > first[0] else 0.0

    def _active(self) -> str | None:
        """The outcome with the largest sum; of equal ones, that of the trade that arrived first."""
        present = [o for o, n in self.outcome_trades.items() if n]
        if not present:
            return None
        most = max(self.outcomes[o] for o in present)
        best = [o for o in present if self.outcomes[o] == most]
        if len(best) == 1:
            return best[0]
        own = [p for p in self.trades.points[self.trades.mark :] if p[3] in best]
        return min(own, key=lambda p: p[5])[3]

    def features(self, now: int) -> dict[str, Any] | None:
        """Of the window at a time, not rounded; None if too little was traded in it."""
        c, start = self.c, now - self.window
        for line, count in ((self.trades, self._count), (self.fresh, self._count_fresh)):
            came, went = line.moved(start)
            for p in came:
                count(p, 1)
            for p in went:
                count(p, -1)
        came, went = self.earlier.moved(start - self.window)
        self.past += sum(p[4] for p in came) - sum(p[4] for p in went)
        total = amount_of(self.total)
        n_trades = len(self.trades.points) - self.trades.mark
        if not n_trades or total < c.min_notional or not total:
            return None
        past = amount_of(self.past - self.total)
        buy, sell = amount_of(self.sides["BUY"]), amount_of(self.sides["SELL"])
        velocity = self._velocity(start, None)
        prices = self.prices.at(start)
        n_prices = len(self.prices.points) - prices
        times = [self.trades.keys[self.trades.mark], self.trades.keys[-1], *((self.prices.keys[prices], self.prices.keys[-1]) if n_prices else ())]
        active = self._active()
        return {
            "fresh_count": len(self.fresh_wallets),
            "fresh_share": amount_of(self.fresh_total) / total,
            "imbalance": abs(buy - sell) / total,
            "concentration": amount_of(self.wallets.top()) / total,
            "velocity": velocity,
            "acceleration": velocity - self._velocity(start - self.window, start),
            "volume_acceleration": total / past if past > 0 else 2.0,
            "notional": total,
            "previous_notional": past,
            "buy_notional": buy,
            "sell_notional": sell,
            "yes_notional": amount_of(self.outcomes["YES"]),
            "no_notional": amount_of(self.outcomes["NO"]),
            "active_side": active,
            "active_notional": amount_of(self.outcomes[active]) if active is not None else 0.0,
            "n_wallets": len(self.wallets.sums),
            "n_trades": n_trades,
            "n_prices": n_prices,
            "episode_start": min(times),
            "episode_end": max(times),
        }
