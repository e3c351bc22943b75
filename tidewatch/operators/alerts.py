"""Alerts: suppression, movement ranking, delivery budgets, lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Alerts
from ..functions import scalars as S
from . import nested
from .folds import BLOCK_ROWS, folded


def suppressed(alerts: DataFrame, c: Alerts = Alerts()) -> DataFrame:
    """Marks alerts whose forerunner of the same suppression key is near in time and at least as severe.

    alerts: id, ts, suppression_key, rank. Forerunners count whether they were suppressed or not.
    """
    w = Window.partitionBy("suppression_key").orderBy("ts", "id")
    window = F.when(F.col("suppression_key").startswith("event:"), c.event_window_s).otherwise(c.market_window_s)
    near = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) <= window.cast("long") * 1_000_000
    return alerts.withColumn("suppressed", F.coalesce(near & (F.col("rank") <= F.lag("rank").over(w)), F.lit(False)))


def movers(candidates: DataFrame, group: str, c: Alerts = Alerts()) -> DataFrame:
    """Of groups with more than rank_above candidates, only the keep_top of largest movement, then severity."""
    sizes = candidates.groupBy(group).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(group).orderBy(F.desc("movement"), F.desc("severity"), "id")
    out = candidates.join(sizes, group).withColumn("__r", F.row_number().over(w))
    return out.where((F.col("__n") <= c.rank_above) | (F.col("__r") <= c.keep_top)).drop("__n", "__r")


def delivered(alerts: DataFrame, pass_s: int = 60, c: Alerts = Alerts(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Marks delivered alerts: per_pass in each pass of pass_s seconds, per_hour in any trailing hour, by channel.

    alerts: id, ts, channel, eligible. The state of a channel is the last hour's deliveries, per_hour at most; channels are
    folded in blocks of time (``folds.folded``). Alerts without a time aren't delivered.
    """
    hour, most = 3600 * 1_000_000, c.per_hour
    turn = F.floor(F.unix_micros("ts") / (pass_s * 1_000_000)).cast("long")
    place = F.row_number().over(Window.partitionBy("channel", "__may", "__turn").orderBy("ts", "id"))
    may = F.coalesce("eligible", F.lit(False)) & F.col("ts").isNotNull()
    first = alerts.withColumn("__may", may).withColumn("__turn", turn).withColumn("__may", F.col("__may") & (place <= c.per_pass)).drop("__turn")

    def step(state, x):
        if not x["may"]:
            return state, False
        last = [t for t in state or [] if t > x["t"] - hour]
        room = len(last) < most
        return (last + [x["t"]] if room else last), room

    return folded(first, ("channel",), ("ts", "id"), {"t": F.unix_micros("ts"), "may": F.col("__may")}, step, "delivered", block_rows).drop("__may")


def lifecycle(rows: DataFrame) -> DataFrame:
    """Status of each candidate from its filters, an existing alert, suppression and delivery.

    rows: domain_ok, probability_ok, existing_rank, rank, reason, existing_reason, suppressed, delivered.
    """
    exists = F.col("existing_rank").isNotNull()
    resend = (F.col("rank") > F.col("existing_rank")) | ~F.col("reason").eqNullSafe(F.col("existing_reason"))
    status = (
        F.when(~F.col("domain_ok"), "filtered_domain").when(~F.col("probability_ok"), "filtered_probability")
        .when(exists & resend & F.col("delivered"), "updated_resend").when(exists & resend, "updated_resend_silent").when(exists, "updated")
        .when(F.col("suppressed"), "suppressed").when(F.col("delivered"), "created").otherwise("created_silent")
    )
    return rows.withColumn("status", status)


def gated(requests: DataFrame, day_cap: int, month_cap: int) -> DataFrame:
    """Marks requests that are called, not served from the cache, within day and month caps of their provider.

    requests: id, ts, provider, cached.
    """
    day, month = F.date_trunc("day", "ts"), F.date_trunc("month", "ts")
    need = requests.where(~F.col("cached"))
    daily = need.withColumn("__d", F.row_number().over(Window.partitionBy("provider", day).orderBy("ts", "id"))).where(F.col("__d") <= day_cap)
    called = daily.withColumn("__m", F.row_number().over(Window.partitionBy("provider", month).orderBy("ts", "id"))).where(F.col("__m") <= month_cap).select("id").withColumn("called", F.lit(True))
    return requests.join(called, "id", "left").withColumn("called", F.coalesce("called", F.lit(False)))


#: The last lines of a payload that are the same for all alerts.
INVALIDATES = "Material contrary public evidence or a weaker replay-reconciled interpretation."


def _json(text: str) -> Column:
    """A JSON text as a variant; a text that is none as its string; null as an empty object."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(nested.quoted(F.col(text))), F.parse_json(F.lit("{}")))


def _listed(names: Column) -> Column:
    inside = F.array_join(names, "', '")
    return F.when(F.size(names) > 0, F.concat(F.lit("['"), inside, F.lit("']"))).when(names.isNotNull(), "[]")


def active_side(features: str) -> Column:
    """The side that a candidate's features (JSON) name, else NO if the probability falls, else YES."""
    at = lambda k: F.get_json_object(features, f"$.{k}")
    told = F.upper(at("active_outcome_side"))
    return F.when(told.isin("YES", "NO"), told).when(at("probability_velocity").try_cast("double") < 0, "NO").otherwise("YES")


def rendered(rows: DataFrame, base_url: str) -> DataFrame:
    """candidate_id and ``payload``: the alert as JSON with keys in order, wallets redacted at any depth, condition ids kept.

    rows: candidate_id, market_id, event_id, condition_id, event_title, question, event_slug, market_slug, trigger_time, rules,
    severity, severity_score, features and provider_summary (JSON), outcomes, outcome_prices, evidence_state,
    model_version, score_label, score_value, scored_at (all null if the shadow model has no score), detector_version,
    feature_schema_version. candidate_id tells the rows apart.

    Features that are no JSON are shown as text. Of rows with a score, a value that is no number is null. Nulls are kept.
    What is a column is redacted as one; only features and provider_summary are walked.
    """
    side, scored = active_side("features"), F.coalesce(*(F.col(c).cast("string") for c in ("model_version", "score_label", "score_value", "scored_at"))).isNotNull()
    filled = lambda c: F.nullif(c, F.lit(""))
    named = lambda **fields: F.struct(*(x.alias(k) for k, x in sorted(fields.items())))
    said = lambda **fields: {k: nested.plainly_redacted(F.col(x) if isinstance(x, str) else x) for k, x in fields.items()}
    event, market, shown = S.slug_url(base_url, F.col("event_slug")), S.slug_url(base_url, F.col("market_slug")), S.eastern(F.col("trigger_time"))
    links = said(market_url=F.coalesce(event, market), event_url=event, market_slug_url=market, market_slug="market_slug", event_slug="event_slug") | {"condition_id": F.col("condition_id")}
    score = named(**said(state=F.when(scored, "scored").otherwise("pending"), model_version="model_version", score_label="score_label", scored_at="scored_at"), score_value=nested.number(F.round(F.col("score_value").try_cast("double"), 6)))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    free = lambda k: F.expr(f"variant_get(__free, '$.{k}', 'variant')")
    payload = named(
        **said(
            title=F.coalesce(filled("event_title"), filled("question"), filled("event_slug"), F.concat(F.lit("Market "), text("market_id"))), severity="severity", trigger_time_display=shown,
            what_changed=F.concat(F.lit("Candidate "), text("candidate_id"), F.lit(" triggered at "), shown),
            why_it_looks_informed=F.concat(F.lit("Rules="), F.coalesce(_listed(F.col("rules")), F.lit("None")), F.lit(" severity_score="), text("severity_score")),
            active_outcome_side=side, public_evidence_state=F.coalesce(filled("evidence_state"), F.lit("pending_evidence")), invalidates_it=F.lit(INVALIDATES), detector_version="detector_version", feature_schema_version="feature_schema_version"),
        **links, market_evidence=named(**said(market_id="market_id", event_id="event_id"), **links, feature_snapshot=free("feature_snapshot")),
        active_outcome_probability=nested.number(S.outcome_probability(F.col("outcomes"), F.col("outcome_prices"), side)), provider_summary=free("provider_summary"), ml_shadow_score=score)
    both = F.to_json(F.struct(_json("features").alias("feature_snapshot"), _json("provider_summary").alias("provider_summary")))
    known = nested.redacted(rows.withColumn("__free", both), "__free").withColumn("__free", F.parse_json("__free"))
    return known.select("candidate_id", F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))
