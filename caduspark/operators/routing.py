"""Routing: a score, an action and a policy make a decision; one broadcast join and one CASE chain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caduspark.functions import fixed


def _channel(tier: Column, band: str, place: int, default: str) -> Column:
    out = F.lit(default)
    for (t, b), row in fixed.CHANNELS.items():
        if b == band:
            out = F.when(tier == t, F.lit(row[place])).otherwise(out)
    return out


def decide(df: DataFrame, actions: DataFrame, action: str, score: str, thresholds: dict[str, float] | None = None, unregistered: str = "advisory") -> DataFrame:
    """df plus action_taken, tier, reason, channel, reviewer_role.

    actions (name, tier) is the registry of actions, broadcast where its size allows; an action it lacks is
    advisory, and escalates if `unregistered` is "escalate".
    """
    limits = fixed.THRESHOLDS | (thresholds or {})
    known = actions.select(F.col("name").alias("__name"), F.col("tier").alias("__tier"))
    out = df.join(known, df[action] == F.col("__name"), "left")
    tier = F.coalesce(F.col("__tier"), F.lit("advisory"))
    missing = F.col("__name").isNull() & F.lit(unregistered == "escalate")
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[tier]
    below = F.col(score) < limit
    blocked = tier == "interventional"
    advisory = tier == "advisory"
    shown = F.format_string("%.2f", F.col(score))
    reason = (
        F.when(missing, F.concat(F.lit("Action '"), F.col(action), F.lit("' is not registered; unregistered actions escalate by default")))
        .when(blocked, F.lit(fixed.BLOCK_MESSAGE))
        .when(below, F.concat(F.lit("Confidence "), shown, F.lit(" below "), tier, F.lit(" threshold "), F.format_string("%.2f", limit)))
        .when(advisory, F.concat(F.lit("AI-generated recommendation, confidence: "), shown))
        .otherwise(F.lit(""))
    )
    return out.select(
        *[df[c] for c in df.columns],
        tier.alias("tier"),
        F.when(missing, "escalate").when(blocked, "block").when(below, "escalate").otherwise("proceed").alias("action_taken"),
        reason.alias("reason"),
        F.when(missing, _channel(tier, "low", 0, "human_review_queue"))
        .when(blocked, _channel(tier, "any", 0, "block_with_error"))
        .when(below, _channel(tier, "low", 0, "human_review_queue"))
        .when(advisory, _channel(tier, "medium", 0, "proceed_with_annotation"))
        .otherwise("proceed")
        .alias("channel"),
        F.when(missing, _channel(tier, "low", 1, ""))
        .when(blocked, _channel(tier, "any", 1, ""))
        .when(below, _channel(tier, "low", 1, ""))
        .when(advisory, _channel(tier, "medium", 1, ""))
        .otherwise("")
        .alias("reviewer_role"),
    )


def dispatch(decisions: DataFrame, channels: dict[str, Callable[[DataFrame], None]]) -> None:
    """Each channel's handler gets that channel's decisions; also a foreachBatch step.  The first error surfaces; channels without a handler get nothing."""
    decisions.persist()
    try:
        for channel, handler in channels.items():
            handler(decisions.where(F.col("channel") == channel))
    finally:
        decisions.unpersist()


def decision_events(decisions: DataFrame, session: str, action: str) -> DataFrame:
    """Audit events of decisions: escalation_triggered unless it proceeds, else agent_llm_response."""
    return decisions.select(
        F.col(session).alias("session_id"),
        F.when(F.col("action_taken") == "proceed", "agent_llm_response").otherwise("escalation_triggered").alias("event_type"),
        F.col(action).alias("agent_id"),
        F.col("tier").alias("risk_tier"),
    )
