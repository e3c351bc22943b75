"""Thresholds of the surveillance operators, as typed settings that callers may override."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Detector:
    window_s: int = 300
    history_s: int = 600
    cooldown_s: int = 900
    fresh_wallets: int = 3
    fresh_share: float = 0.35
    imbalance: float = 0.65
    concentration: float = 0.45
    velocity: float = 0.02
    acceleration: float = 0.005
    volume_acceleration: float = 1.25
    min_notional: float = 250.0
    #: A candidate within the cooldown goes out if its severity is this many times the last one's.
    escalation: float = 1.25
    band_low: float = 0.10
    band_high: float = 0.95


@dataclass(frozen=True)
class Alerts:
    watch: float = 0.5
    actionable: float = 0.8
    per_pass: int = 1
    per_hour: int = 6
    event_window_s: int = 3600
    market_window_s: int = 1800
    rank_above: int = 5
    keep_top: int = 7
    #: Order of the severities.
    ranks: dict[str, int] = field(default_factory=lambda: {"INFO": 0, "WATCH": 1, "ACTIONABLE": 2, "CRITICAL": 3})


@dataclass(frozen=True)
class Evaluation:
    folds: int = 5
    block_days: int = 30
    min_rows: int = 30
    tick: float = 0.01
    fee: float = 0.02
    notional: float = 100.0
    hold_hours: int = 24
    stop: float = 0.20
    per_family: int = 1
    open_positions: int = 5
    short_lead_s: int = 3600
    #: Least numbers of a split that counts as scored: eligible rows by unit, resolved rows, families, categories, coverage.
    candidate_rows: int = 30
    alert_rows: int = 20
    trade_rows: int = 10
    resolved_rows: int = 15
    families: int = 5
    categories: int = 3
    coverage: float = 0.80


@dataclass(frozen=True)
class Storage:
    hot_days: int = 30
    warm_days: int = 120
    cold_days: int = 365
    compact_below: int = 50 << 20
    stale_hours: int = 24


@dataclass(frozen=True)
class Graph:
    lookback_days: int = 90
    persistent_days: int = 2
