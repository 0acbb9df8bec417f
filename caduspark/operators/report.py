"""Session reports: one aggregate by session for all sections."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caduspark.functions import fixed
from caduspark.operators import rules as attest


def summary(events: DataFrame) -> DataFrame:
    """Per session: duration by sequence, totals, counts by type, agents, confidences, gaps, gating, recommendations."""
    kind = lambda k: F.col("event_type") == k
    gap = F.col("sequence_number") - F.lag("sequence_number").over(Window.partitionBy("session_id").orderBy("sequence_number")) != 1
    rows = events.withColumn("__gap", gap)
    agents = F.array_sort(F.collect_set(F.when(~F.col("agent_id").isin("", "unknown"), F.col("agent_id"))))
    out = rows.groupBy("session_id").agg(
        ((F.max_by("ts_us", "sequence_number") - F.min_by("ts_us", "sequence_number")) / 1e6).alias("duration_seconds"),
        F.count("*").alias("total_events"),
        *[F.count_if(kind(k)).alias(f"n_{k}") for k in fixed.EVENT_TYPES],
        F.array_join(agents, ",").alias("agents_involved"),
        F.count("confidence_score").alias("n_confidences"),
        F.avg("confidence_score").alias("mean_confidence"),
        F.count_if("__gap").alias("gaps"),
        F.count_if(kind("escalation_triggered") & (F.col("risk_tier") == "interventional")).alias("interventional_escalations"),
        F.count_if(F.col("risk_tier") == "interventional").alias("interventional_events"),
    )
    anomalies = F.col("n_module_error") + F.when(F.col("gaps") > 0, 1).otherwise(0)
    advice = F.array_compact(
        F.array(
            F.when(F.col("mean_confidence") < 0.7, F.lit("Mean session confidence below 0.70 — review prompt design and grounding sources.")),
            F.when(anomalies > 0, F.lit("Investigate flagged anomalies before next deployment.")),
        )
    )
    return out.select(
        "*",
        anomalies.alias("n_anomalies"),
        ((F.col("interventional_escalations") > 0) | (F.col("interventional_events") == 0)).alias("interventional_blocked_when_required"),
        F.array_join(advice, " | ").alias("recommendations"),
    )


def type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id", "event_type").agg(F.count("*").alias("n"))


def phi_summary(tags: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, phi_type, n): detected equals redacted equals the number of tags."""
    return tags.groupBy(session, "phi_type").agg(F.count("*").alias("n"))


def listed(events: DataFrame, event_type: str) -> DataFrame:
    """Ordered rows of one kind of event: actions, escalations, reviews or errors of the report.

    Actions name their tool where the events hold the redacted input.
    """
    tool = [F.get_json_object("redacted_input", "$.tool_name").alias("tool")] if "redacted_input" in events.columns else []
    return events.where(F.col("event_type") == event_type).select("session_id", "sequence_number", "event_id", "agent_id", "risk_tier", "confidence_score", "ts_us", *tool)


def confidences(events: DataFrame) -> DataFrame:
    """(session_id, confidence_scores): the scores that are not null, zeros included, in order."""
    scored = F.when(F.col("confidence_score").isNotNull(), F.struct("sequence_number", "event_id", "confidence_score"))
    return events.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(scored)), lambda x: x["confidence_score"]).alias("confidence_scores"))


def rule_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("session_id").agg(
        F.count("*").alias("rules_evaluated"),
        F.count_if("satisfied").alias("rules_satisfied"),
        F.count_if(~F.col("satisfied") & (F.col("severity") == "blocker")).alias("rules_failed_blocker"),
    )


def by_framework(results: DataFrame) -> DataFrame:
    return results.groupBy("framework").agg(
        F.count_if("satisfied").alias("passed"),
        F.count("*").alias("total"),
        F.count_if(~F.col("satisfied") & (F.col("severity") == "blocker")).alias("failed_blockers"),
    )


def build(events: DataFrame, verified: DataFrame | None = None, rules: list[attest.Rule] | None = None, traced: bool = False) -> DataFrame:
    """The whole report, a row a session: the summary's columns and the rule summary's."""
    results = rule_summary(attest.evaluate(events, rules, verified, traced))
    return summary(events).join(results, "session_id")


def session_overview(events: DataFrame, limit: int = 50) -> DataFrame:
    """The first sessions in order with their number of events (a page of a dashboard)."""
    return events.groupBy("session_id").agg(F.count("*").alias("events")).orderBy("session_id").limit(limit)


def propagation_view(events: DataFrame) -> DataFrame:
    """Edges between agents from messages; `target` comes from the message's payload."""
    return events.where(F.col("event_type").isin("inter_agent_message", "a2a_message") & F.col("target").isNotNull()).select(F.col("agent_id").alias("src"), F.col("target").alias("dst")).distinct()


def _table(title: str, head: list[str], rows: list[list]) -> str:
    cells = lambda row, tag: "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in row)
    body = "".join(f"<tr>{cells(row, 'td')}</tr>" for row in rows)
    return f"<h2>{html.escape(title)}</h2><table><tr>{cells(head, 'th')}</tr>{body}</table>"


def to_html(row: dict, rules: list[dict] = (), identifiers: list[dict] = (), counts: list[dict] = ()) -> str:
    """One session's report as a page of four tables: the report's row, rules with PASS or FAIL, identifiers by type, events by type.

    The rows are those of build(), rules.evaluate(), phi_summary() and type_counts() for the session.
    """
    name = html.escape(str(row.get("session_id", "")))
    tables = [
        _table("Summary", ["Field", "Value"], [[k, "" if v is None else v] for k, v in row.items()]),
        _table("Rules", ["Framework", "Rule", "Severity", "Result", "Reason"], [[r["framework"], r["rule_id"], r["severity"], "PASS" if r["satisfied"] else "FAIL", r["reason"]] for r in rules]),
        _table("Identifiers", ["Type", "Found"], [[r["phi_type"], r["n"]] for r in identifiers]),
        _table("Events", ["Type", "Events"], [[r["event_type"], r["n"]] for r in counts]),
    ]
    return f"<html><body><h1>Session {name}</h1>{''.join(tables)}</body></html>"


def to_json(report: DataFrame) -> Column:
    return F.to_json(F.struct(*report.columns))
