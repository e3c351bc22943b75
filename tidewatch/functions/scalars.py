"""Scalar helpers: presence, tolerant parsing, normal forms, buckets and identifiers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Alerts, Evaluation, Storage


def is_present(c: Column) -> Column:
    """Neither null nor blank."""
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def safe_ratio(n: Column, d: Column) -> Column:
    """0 where the denominator is 0 or null."""
    return F.when(d != 0, n / d).otherwise(F.lit(0.0))


def money(c: Column) -> Column:
    """A sum of amounts, exact to ten decimals and free of rounding order."""
    return F.sum(c.cast("decimal(28,10)")).cast("double")


_DIGITS = r"^[+-]?[0-9]+(\.[0-9]*)?$"


def iso_timestamp(c: Column) -> Column:
    """ISO text with Z, offset or neither (then UTC)."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(c), "Z$", "+00:00"))


def _epoch(c: Column, millis: Column) -> Column:
    x = c.try_cast("double")
    return F.timestamp_micros(F.when(millis, x * 1000).otherwise(x * 1000000).cast("long"))


def detector_timestamp(c: Column) -> Column:
    """ISO text, or digits: milliseconds if there is a point or from 1e12 on, else seconds; others are null."""
    x = c.try_cast("double")
    return F.when(F.trim(c).rlike(_DIGITS), _epoch(c, c.contains(".") | (x >= 1e12))).otherwise(iso_timestamp(c))


def trade_timestamp(c: Column) -> Column:
    """As of trades with numeric times: only the size tells milliseconds from seconds."""
    x = c.try_cast("double")
    return F.when(F.trim(c).rlike(_DIGITS), _epoch(c, x >= 1e12)).otherwise(iso_timestamp(c))


def push_timestamp(c: Column) -> Column:
    """As of pushed frames: any number is milliseconds."""
    return F.when(F.trim(c).rlike(_DIGITS), _epoch(c, F.lit(True))).otherwise(iso_timestamp(c))


def job_timestamp(c: Column) -> Column:
    """ISO text, or date and time with a space between."""
    return F.coalesce(iso_timestamp(c), F.try_to_timestamp(F.trim(c), F.lit("yyyy-MM-dd HH:mm:ss")))


def json_strings(c: Column) -> Column:
    """A JSON list of strings without null and empty ones; anything else is an empty list."""
    got = F.from_json(c, "array<string>")
    return F.coalesce(F.filter(got, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def json_doubles(c: Column) -> Column:
    """A JSON list of numbers or numeric strings; what isn't one is NaN. Anything else than a list is null."""
    return F.transform(F.from_json(c, "array<string>"), lambda x: F.coalesce(x.try_cast("double"), F.lit(float("nan"))))


def yes_probability(outcomes: Column, prices: Column) -> Column:
    """The price at the first outcome 'yes' (the first one if there is none); null where out of range."""
    at = F.array_position(F.transform(outcomes, lambda x: F.lower(x)), "yes")
    return F.get(prices, (F.greatest(F.coalesce(at, F.lit(0)), F.lit(1)) - 1).cast("int"))


def outcome_probability(outcomes: Column, prices: Column, side: Column) -> Column:
    """The price at the first outcome of that name, whatever its case (the first price if there is none); null where there is none."""
    at = F.array_position(F.transform(outcomes, lambda x: F.lower(F.trim(x))), F.lower(F.trim(side)))
    return F.get(prices, (F.greatest(F.coalesce(at, F.lit(0)), F.lit(1)) - 1).cast("int")).try_cast("double")


def in_probability_band(p: Column, low: float = 0.10, high: float = 0.95) -> Column:
    """Null passes."""
    return F.coalesce((p >= low) & (p <= high), F.lit(True))


def volume_tier(volume: Column) -> Column:
    return F.when(volume > 500, 1).when(volume > 50, 2).otherwise(3)


def category_key(category: Column, tags: Column) -> Column:
    """The category, else the first tag that isn't blank, else 'unknown'; lower case."""
    tag = F.get(F.filter(tags, lambda x: F.trim(x) != ""), F.lit(0))
    return F.lower(F.trim(F.coalesce(blank_to_null(category), tag, F.lit("unknown"))))


def dedupe_key(tx_hash: Column, condition: Column, asset: Column, side: Column, price: Column, size: Column, time: Column) -> Column:
    """The transaction's hash in lower case, else a text of the trade's own fields."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    number = lambda c: F.when(c.isNotNull(), F.format_string("%.12f", c)).otherwise("")
    own = F.concat_ws("|", text(condition), text(asset), text(side), number(price), number(size), text(time))
    return F.coalesce(F.lower(blank_to_null(tx_hash)), own)


def keyword_hits(text: Column, keywords: Iterable[str]) -> Column:
    """Keywords found anywhere in the text, also inside words, sorted."""
    hay = F.lower(text)
    return F.array_compact(F.array(*(F.when(F.contains(hay, F.lit(k)), F.lit(k)) for k in sorted(keywords))))


def severity(score: Column, modifier: Column, c: Alerts = Alerts()) -> Column:
    total = score + modifier
    return F.when(total >= c.actionable, "ACTIONABLE").when(total >= c.watch, "WATCH").otherwise("INFO")


def severity_rank(name: Column, c: Alerts = Alerts()) -> Column:
    out = F.lit(-1)
    for k, v in c.ranks.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def suppression_key(family: Column, event: Column, slug: Column, market: Column, market_slug: Column) -> Column:
    """By event where one is known, else by market."""
    by_event = F.coalesce(blank_to_null(family), blank_to_null(event), blank_to_null(slug))
    return F.when(by_event.isNotNull(), F.concat(F.lit("event:"), by_event)).otherwise(F.concat(F.lit("market:"), F.coalesce(blank_to_null(market), blank_to_null(market_slug))))


def evidence_state(results: Column, any_ok: Column) -> Column:
    return F.when(results >= 5, "already_public").when((results > 0) | any_ok, "weakly_public").otherwise("not_publicly_explained")


def evidence_modifier(state: Column) -> Column:
    return F.when(state == "already_public", -0.25).when(state == "weakly_public", -0.10).otherwise(0.15)


def movement(velocity: Column, acceleration: Column) -> Column:
    return F.abs(F.coalesce(velocity, F.lit(0.0))) + F.abs(F.coalesce(acceleration, F.lit(0.0)))


def redacted(c: Column) -> Column:
    """Long hexadecimal numbers masked."""
    return F.regexp_replace(c, "0x[0-9a-fA-F]{8,}", "[redacted]")


def eastern(ts: Column) -> Column:
    """A time as people in New York read it, summer time included, like Jul 4, 2024 9:05 AM ET; '' for null."""
    return F.coalesce(F.concat(F.date_format(F.from_utc_timestamp(ts, "America/New_York"), "MMM d, yyyy h:mm a"), F.lit(" ET")), F.lit(""))


def slug_url(base: str, slug: Column) -> Column:
    """base and the slug, without slashes around it, in percent encoding (letters, digits and -._~ stay); null where it is empty."""
    bare = F.regexp_replace(F.trim(slug), "^/+|/+$", "")
    coded = F.replace(F.replace(F.replace(F.url_encode(bare), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.when(bare != "", F.concat(F.lit(f"{base}/"), coded))


def direction(velocity: Column) -> Column:
    return F.when(velocity > 0, "YES").when(velocity.isNotNull(), "NO")


def clamped(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def short_id(c: Column, size: int = 16) -> Column:
    return F.substring(F.sha1(c), 1, size)


def time_block(ts: Column, c: Evaluation = Evaluation()) -> Column:
    """The block of days since the epoch, as its first day and the day after its last."""
    n = F.floor(F.unix_seconds(ts) / (86400 * c.block_days)) * c.block_days
    day = lambda d: F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), d.cast("int")), "yyyy-MM-dd")
    return F.concat(F.lit("time_block:"), day(n), F.lit(":"), day(n + c.block_days))


def liquidity(spread: Column) -> Column:
    return F.when(spread.isNull() | (spread < 0), "unknown").when(spread <= 0.02, "tight").when(spread <= 0.05, "mid").otherwise("wide")


def storage_tier(age_days: Column, c: Storage = Storage()) -> Column:
    return F.when(age_days.isNull(), "unknown").when(age_days <= c.hot_days, "hot").when(age_days <= c.warm_days, "warm").when(age_days <= c.cold_days, "cold").otherwise("archive_only")


def wallet_valid(c: Column) -> Column:
    return F.coalesce(c.rlike("^0x[0-9a-fA-F]{40}$"), F.lit(False))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.least(F.lit(50.0), F.greatest(F.lit(-50.0), x))))


def partition_hour(path: Column) -> Column:
    """The hour that a partition's path names."""
    part = lambda k: F.regexp_extract(path, rf"{k}=([0-9]+)", 1).try_cast("int")
    return F.try_make_timestamp(part("year"), part("month"), part("day"), part("hour"), F.lit(0), F.lit(0)) if hasattr(F, "try_make_timestamp") else F.make_timestamp(part("year"), part("month"), part("day"), part("hour"), F.lit(0), F.lit(0))


def source_name(c: Column) -> Column:
    """Safe in paths."""
    return F.translate(F.lower(F.trim(c)), " /\\:", "____")
