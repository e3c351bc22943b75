"""Which markets are watched, and why: rules of inclusion and exclusion, tiers, and a list of events for review."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


@dataclass(frozen=True)
class Rules:
    """Slugs, tags and keywords in lower case; a keyword counts anywhere in a market's text, also inside words."""

    event_slugs: tuple[str, ...] = ()
    market_slugs: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    event_liquidity: float = 0.0
    market_liquidity: float = 0.0


@dataclass(frozen=True)
class Policy:
    include: Rules = field(default_factory=Rules)
    exclude: Rules = field(default_factory=Rules)
    review_keywords: tuple[str, ...] = ()
    review_liquidity: float = 50_000.0
    review_most: int = 100
    reviewing: bool = True
    band_low: float = 0.10
    band_high: float = 0.95
    shown_keywords: int = 5


TEXTS = ("event_title", "event_description", "event_slug", "market_slug", "question", "market_description")


def text_context(tags: str = "event_tags") -> Column:
    """All texts and tags of a market in lower case, blanks between; null and empty ones are left out."""
    parts = F.concat(F.array(*TEXTS), F.coalesce(F.col(tags), F.array().cast("array<string>")))
    return F.lower(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " "))


def _in(slug: str, wanted: Iterable[str]) -> Column:
    return F.coalesce(F.lower(slug).isin(*wanted), F.lit(False))


def _tags(wanted: Iterable[str]) -> Column:
    """The market's tags that are wanted, in their order, repeats kept."""
    wanted = tuple(wanted)
    return F.coalesce(F.filter("event_tag_ids", lambda t: F.coalesce(t.isin(*wanted), F.lit(False))), F.array().cast("array<string>"))


def named(r: Rules) -> Column:
    return _in("event_slug", r.event_slugs) | _in("market_slug", r.market_slugs)


def excluded(r: Rules, context: Column) -> Column:
    """Named by slug, tagged, or with a keyword in its text."""
    return named(r) | (F.size(_tags(r.tags)) > 0) | (F.size(S.keyword_hits(context, r.keywords)) > 0)


def include_reasons(r: Rules, context: Column, shown: int = 5) -> Column:
    """Why a market is included, as an array: its wanted tags, the first few keywords, both sorted, and its names."""
    tags, words = F.array_sort(_tags(r.tags)), S.keyword_hits(context, r.keywords)
    return F.array_compact(F.array(
        F.when(F.size(tags) > 0, F.concat(F.lit("tag_ids="), F.array_join(tags, ","))),
        F.when(F.size(words) > 0, F.concat(F.lit("keywords="), F.array_join(F.slice(words, 1, shown), ","))),
        F.when(_in("event_slug", r.event_slugs), "manual_event_slug"),
        F.when(_in("market_slug", r.market_slugs), "manual_market_slug"),
    ))


def review_reasons(p: Policy, context: Column) -> Column:
    """Why an event that isn't included is worth a look, as an array; empty if neither keyword nor liquidity says so."""
    keyword = F.size(S.keyword_hits(context, p.review_keywords)) > 0
    liquid = F.coalesce(F.col("event_liquidity"), F.lit(0.0)) >= p.review_liquidity
    tagged = F.size(_tags(p.include.tags)) > 0
    reasons = F.array(F.when(keyword, "secondary_keyword_match"), F.when(liquid, "high_event_liquidity"), F.when(tagged, "include_tag_but_below_threshold"))
    return F.when(keyword | liquid, F.array_compact(reasons)).otherwise(F.array().cast("array<string>"))


def classified(markets: DataFrame, p: Policy) -> DataFrame:
    """markets with ``verdict`` and ``reasons``; the first verdict that holds: named, outside_band, excluded, included, review, none.

    markets: market_id, event_id, event_slug, market_slug, the TEXTS, event_tags, event_tag_ids (arrays), yes_probability,
    event_liquidity, market_liquidity. Null slugs, tags and texts match nothing, null liquidity is 0, a null probability is in
    the band. One projection: nothing is shuffled.
    """
    liquid = (F.coalesce("event_liquidity", F.lit(0.0)) >= p.include.event_liquidity) & (F.coalesce("market_liquidity", F.lit(0.0)) >= p.include.market_liquidity)
    context = F.col("__context")
    out = markets.withColumn("__context", text_context())
    out = out.withColumn("__in", include_reasons(p.include, context, p.shown_keywords))
    out = out.withColumn("__re", review_reasons(p, context) if p.reviewing else F.array().cast("array<string>"))
    verdict = (
        F.when(named(p.include), "named").when(~S.in_probability_band(F.col("yes_probability"), p.band_low, p.band_high), "outside_band")
        .when(excluded(p.exclude, context), "excluded").when((F.size("__in") > 0) & liquid, "included").when(F.size("__re") > 0, "review").otherwise("none")
    )
    out = out.withColumn("verdict", verdict)
    reasons = F.when(F.col("verdict").isin("named", "included"), F.col("__in")).when(F.col("verdict") == "review", F.col("__re")).otherwise(F.array().cast("array<string>"))
    return out.withColumn("reasons", reasons).drop("__context", "__in", "__re")


def tiers(markets: DataFrame, most_tokens: int) -> DataFrame:
    """The markets named or included, with ``role``: tier0 for as many of tier 1 as half of most_tokens, largest volume first.

    markets: those of ``classified``, with tier and volume. Of equal volumes the smaller market_id comes first; null volume is
    0, a null tier is 3. Tier 0 is a top-k: tasks keep k rows each, and the k ids are broadcast; k is a setting.
    """
    approved = markets.where(F.col("verdict").isin("named", "included"))
    room = max(1, most_tokens // 2) if most_tokens else 0
    volume = F.coalesce("volume", F.lit(0.0))
    tier = F.coalesce(F.nullif(F.col("tier").cast("int"), F.lit(0)), F.lit(3))
    first = approved.where("tier = 1").select("market_id", volume.alias("__v")).orderBy(F.desc("__v"), "market_id").limit(room)
    met = approved.join(F.broadcast(first.select("market_id", F.lit(True).alias("__first"))), "market_id", "left")
    role = F.when(F.col("__first"), "tier0").otherwise(F.concat(F.lit("tier"), tier.cast("string")))
    return met.withColumn("role", role).drop("__first").select(*approved.columns, "role")


def review_list(markets: DataFrame, p: Policy) -> DataFrame:
    """The review_most events of largest liquidity that have a market to review: event_id, event_liquidity, market_id, reason, place.

    Of an event's markets the one with the largest event liquidity speaks, of equal ones that of larger volume, then of the
    smaller market_id. Events of equal liquidity stand in order of their id. A list of a fixed length is the feature here.
    """
    amount = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = markets.where("verdict = 'review'").withColumns({"__l": amount("event_liquidity"), "__v": amount("volume"), "__r": F.array_join("reasons", ",")})
    best = rows.groupBy("event_id").agg(F.min(F.struct((-F.col("__l")).alias("l"), (-F.col("__v")).alias("v"), "market_id", "__r")).alias("b"))
    flat = best.select("event_id", (-F.col("b.l")).alias("event_liquidity"), F.col("b.market_id").alias("market_id"), F.col("b.__r").alias("reason"))
    kept = flat.orderBy(F.desc("event_liquidity"), "event_id").limit(p.review_most)
    return kept.withColumn("place", F.row_number().over(Window.orderBy(F.desc("event_liquidity"), "event_id")))
