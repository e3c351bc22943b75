"""Review of live alerts beside the shadow model's scores: each alert with what is known of it, and whether the model is ready."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


@dataclass(frozen=True)
class Review:
    coverage: float = 0.9
    scored: int = 25
    #: With as many different scores, or fewer, the model doesn't tell alerts apart.
    flat: int = 2
    decimals: int = 6
    shown_values: int = 25


TIMES = ("updated_at", "created_at", "first_delivery_at", "last_delivery_at", "trigger_time")
#: The four counts of a review and the field of an alert that each goes by.
COUNTS = {"severity": ("severity", "unknown"), "evidence_state": ("public_evidence_state", "unknown"), "ml_label": ("score_label", "missing"), "ml_model": ("model_version", "missing")}


def latest(rows: DataFrame, key: str, times: tuple[str, ...], id: str) -> DataFrame:
    """The last row of each key by the first of its times that isn't null; of equal times the larger id. No time comes first.

    Rows without a key are left out. A grouped maximum: tasks send one row for each key.
    """
    other = [c for c in rows.columns if c != key]
    at = F.coalesce(*(F.col(t).cast("timestamp") for t in times))
    row = F.max_by(F.struct(*other), F.struct(at.isNotNull(), at, F.col(id))).alias("__row")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(row).select(key, *(F.col(f"__row.{c}").alias(c) for c in other))


def attempts_by_alert(attempts: DataFrame) -> DataFrame:
    """Numbers of attempts, sent ones and errors of each alert, and its channels in order."""
    status = F.col("delivery_status")
    return attempts.where("alert_id is not null").groupBy("alert_id").agg(
        F.count("*").alias("attempt_count"), F.count_if(status == "sent").alias("sent_count"), F.count_if(status == "error").alias("error_count"),
        F.array_sort(F.collect_set(F.nullif("delivery_channel", F.lit("")))).alias("channels"))


def reviewed(alerts: DataFrame, candidates: DataFrame, scores: DataFrame, evidence: DataFrame, attempts: DataFrame, since: Column) -> DataFrame:
    """One row for each alert since a time, with its candidate, last score, last evidence and deliveries.

    alerts: alert_id, candidate_id, title, severity, alert_status and the TIMES but the last. candidates: candidate_id,
    market_id, event_title, question, event_slug, market_slug, trigger_time, rules, severity_score, features (a map).
    scores: candidate_id, score_id, scored_at, created_at, model_version, score_label, score_value. evidence: candidate_id,
    snapshot_id, snapshot_time, created_at, evidence_state, confidence_modifier. attempts: alert_id, delivery_status,
    delivery_channel.

    An alert's time is the first of TIMES that isn't null; alerts without any are kept. Alerts without a candidate, a score,
    evidence or attempts have nulls, and 0 attempts. Attempts, scores and evidence meet only the alerts of the window: both
    sides are cut down by a semi-join before they are grouped, so their whole history isn't shuffled for a few hours' review.
    """
    whose = candidates.withColumnsRenamed({"severity_score": "candidate_score"})
    near = alerts.join(whose, "candidate_id", "left").withColumn("alert_time", F.coalesce(*(F.col(t).cast("timestamp") for t in TIMES)))
    near = near.where(F.col("alert_time").isNull() | (F.col("alert_time") >= since))
    wanted, sent = near.select("candidate_id").where("candidate_id is not null").distinct(), near.select("alert_id").distinct()
    score = latest(scores.join(wanted, "candidate_id", "left_semi"), "candidate_id", ("scored_at", "created_at"), "score_id")
    score = score.select("candidate_id", F.lit("scored").alias("ml_state"), "model_version", "score_label", F.col("score_value").try_cast("double").alias("score_value"), "scored_at")
    proof = latest(evidence.join(wanted, "candidate_id", "left_semi"), "candidate_id", ("snapshot_time", "created_at"), "snapshot_id")
    proof = proof.select("candidate_id", F.col("evidence_state").alias("public_evidence_state"), "confidence_modifier")
    tries = attempts_by_alert(attempts.join(sent, "alert_id", "left_semi"))
    out = near.join(score, "candidate_id", "left").join(proof, "candidate_id", "left").join(tries, "alert_id", "left")
    filled = lambda c: F.nullif(c, F.lit(""))
    slug = F.coalesce(filled("event_slug"), filled("market_slug"))
    none = F.lit(0).cast("long")
    return out.select(
        "alert_id", "candidate_id", F.coalesce(filled("title"), filled("event_title"), F.col("question")).alias("title"),
        "market_id", slug.alias("slug"), "severity", "alert_status", "trigger_time", "alert_time", "rules", F.col("candidate_score").alias("severity_score"),
        "public_evidence_state", "confidence_modifier", F.coalesce("attempt_count", none).alias("attempt_count"), F.coalesce("sent_count", none).alias("sent_count"),
        F.coalesce("error_count", none).alias("error_count"), F.coalesce("channels", F.array().cast("array<string>")).alias("channels"),
        F.coalesce("ml_state", F.lit("missing")).alias("ml_state"), "model_version", "score_label", "score_value", "scored_at",
        F.slice(F.array_sort(F.coalesce(F.map_keys("features"), F.array().cast("array<string>"))), 1, 20).alias("feature_keys"))


def counts(rows: DataFrame) -> DataFrame:
    """Numbers of reviewed alerts by severity, state of evidence, label and model: kind, value, n."""
    each = F.array(*(F.struct(F.lit(kind).alias("kind"), F.coalesce(S.blank_to_null(F.col(c)), F.lit(none)).alias("value")) for kind, (c, none) in COUNTS.items()))
    return rows.select(F.explode(each).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def readiness(rows: DataFrame, c: Review = Review()) -> DataFrame:
    """One row: how many alerts were reviewed, scored and delivered, the scores' spread, and what stands against promotion.

    ``gates`` names what isn't met, ``promotion_readiness`` is review_for_priority_only if nothing is left. Without any alert
    there is still a row. distinct_values has the smallest shown_values scores; all are counted.
    """
    is_scored, sent = F.col("ml_state") == "scored", F.col("sent_count") > 0
    rounded = F.round("score_value", c.decimals)
    sums = rows.agg(
        F.count("*").alias("alerts_reviewed"), F.count_if(is_scored).alias("alerts_scored"), F.count_if(sent).alias("delivered"), F.count_if(sent & is_scored).alias("delivered_scored"),
        F.count(F.when(is_scored, F.col("score_value"))).alias("n_scores"), F.min(F.when(is_scored, F.col("score_value"))).alias("least_score"), F.max(F.when(is_scored, F.col("score_value"))).alias("largest_score"),
        F.countDistinct(F.when(is_scored, rounded)).alias("distinct_scores"))
    values = rows.where(is_scored & F.col("score_value").isNotNull()).select(rounded.alias("v")).distinct().orderBy("v").limit(c.shown_values)
    shown = values.agg(F.array_sort(F.collect_list("v")).alias("distinct_values"))
    coverage = S.safe_ratio(F.col("alerts_scored"), F.col("alerts_reviewed"))
    gates = F.array_compact(F.array(
        F.when(F.col("alerts_reviewed") == 0, "no_alerts"), F.when(coverage < c.coverage, "coverage"), F.when(F.col("n_scores") < c.scored, "few_scores"),
        F.when(F.col("distinct_scores") <= c.flat, "flat_scores"), F.when(F.col("delivered_scored") < F.col("delivered"), "delivered_without_score")))
    out = sums.crossJoin(shown).withColumn("gates", gates)  # one row each
    return out.withColumn("coverage", F.round(coverage, 4)).withColumn("promotion_readiness", F.when(F.size("gates") == 0, "review_for_priority_only").otherwise("not_ready"))


def examples(rows: DataFrame, most: int) -> DataFrame:
    """The first alerts of each list (top_scored, delivered, missing_score) by score, then the last change: list, place, alert_id.

    Alerts without a score come last, of equal ones the smaller alert_id first. Three top-k lists of a report.
    """
    parts = []
    order = (F.desc("scored"), F.desc("value"), F.desc_nulls_last("alert_time"), F.col("alert_id"))
    kept = rows.select("alert_id", "alert_time", "ml_state", "sent_count", F.col("score_value").isNotNull().alias("scored"), F.coalesce(F.col("score_value"), F.lit(-1.0)).alias("value"))
    for name, which in (("top_scored", F.lit(True)), ("delivered", F.col("sent_count") > 0), ("missing_score", F.col("ml_state") != "scored")):
        first = kept.where(which).orderBy(*order).limit(most)
        ids = first.agg(F.array_sort(F.collect_list(F.struct((~F.col("scored")).alias("a"), (-F.col("value")).alias("b"), F.col("alert_time").isNull().alias("c"), (-F.unix_micros("alert_time")).alias("d"), "alert_id"))).alias("x"))
        parts.append(ids.select(F.lit(name).alias("list"), F.posexplode("x").alias("place", "y")).select("list", (F.col("place") + 1).alias("place"), "y.alert_id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
