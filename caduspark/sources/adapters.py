"""Events derived from agent traffic: model calls, tools, messages between agents, JSON-RPC tool calls.

Payloads are scanned before they are kept: an event holds the hash of the raw payload, the redacted payload and one tag id a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caduspark.functions.hashing import payload_hash
from caduspark.operators.scan import scan_json

_RPC = "method string, id string, params struct<name:string, arguments:string>"


def conversation_events(turns: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> audit events; a user turn calls, an assistant turn answers."""
    kind = F.when(F.col("role") == "system", "session_start").when(F.col("role") == "user", "agent_llm_call").otherwise("agent_llm_response")
    session = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    return turns.select(
        session.alias("session_id"),
        (F.col("turn") + 1).alias("sequence_number"),
        F.concat(session, F.lit("-"), (F.col("turn") + 1).cast("string")).alias("event_id"),
        kind.alias("event_type"),
        F.when(F.col("role") == "system", "unknown").otherwise(F.col("role")).alias("agent_id"),
        payload_hash(F.coalesce("text", F.lit(""))).alias("input_hash"),
        F.lit(None).cast("string").alias("risk_tier"),
        F.lit(None).cast("double").alias("confidence_score"),
        ((F.lit(1_704_067_200) + F.col("conv_id") * 3600 + F.col("turn")) * 1_000_000).alias("ts_us"),
    )


def rpc_events(messages: DataFrame, column: str, agent: str) -> DataFrame:
    """Two mcp_tool_call events (in, out) for each tools/call message; other and malformed messages give none."""
    rows = messages.withColumn("__m", F.from_json(column, _RPC)).where(F.col("__m.method") == "tools/call")
    return rows.select(
        agent,
        F.col("__m.id").alias("call_id"),
        F.col("__m.params.name").alias("tool"),
        F.explode(F.array(F.lit("in"), F.lit("out"))).alias("direction"),
        F.lit("mcp_tool_call").alias("event_type"),
        payload_hash(F.coalesce("__m.params.arguments", F.lit("{}"))).alias("input_hash"),
    )


def message_edges(messages: DataFrame) -> DataFrame:
    """Edges of agent messages (tag_id, sender, receiver, ord)."""
    return messages.where("receiver is not null").select("tag_id", "ord", F.col("sender").alias("src"), F.col("receiver").alias("dst"))


def _quoted(value: Column) -> Column:
    """A string, or null, as JSON."""
    shown = F.to_json(F.array(value))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(shown, 2, F.length(shown) - 2))


def _events(rows: DataFrame, event_type: str, payload: str, agent: str, framework: str, shell: list[Column], output: bool) -> DataFrame:
    """One event a row: shell holds the JSON text around the redacted payload; tag ids are hashes of event, place and type."""
    out = scan_json(rows, payload, "__redacted", found="__found")
    kept = F.concat(shell[0], F.coalesce("__redacted", F.lit("null")), shell[1])
    hashed, none = payload_hash(F.coalesce(F.col(payload), F.lit("null"))), F.lit("")
    place = lambda h, i: F.sha2(F.concat_ws("|", F.lit(event_type), F.col("session_id"), F.col("ord").cast("string"), i.cast("string"), h["phi_type"]), 256)
    return out.select(
        "session_id",
        "ord",
        F.lit(event_type).alias("event_type"),
        F.col(agent).alias("agent_id"),
        F.lit(framework).alias("agent_framework"),
        (none if output else hashed).alias("input_hash"),
        (hashed if output else none).alias("output_hash"),
        (F.lit("{}") if output else kept).alias("redacted_input"),
        (kept if output else F.lit("{}")).alias("redacted_output"),
        F.transform("__found", place).alias("phi_tags_detected"),
    )


def tool_events(calls: DataFrame, framework: str = "generic") -> DataFrame:
    """calls (session_id, ord, tool, arguments, result: JSON) -> a tool_call event and, where there is a result, a tool_result event."""

    def shell(name: str) -> list[Column]:
        return [F.concat(F.lit('{"tool_name":'), _quoted(F.col("tool")), F.lit(f',"{name}":')), F.lit("}")]

    asked = _events(calls, "tool_call", "arguments", "tool", framework, shell("arguments"), False)
    return asked.unionByName(_events(calls.where("result is not null"), "tool_result", "result", "tool", framework, shell("result"), True))


def message_events(messages: DataFrame, framework: str = "generic") -> DataFrame:
    """messages (session_id, ord, sender, receiver, message: JSON[, correlation_id]) -> inter_agent_message events, or a2a_message for framework a2a."""
    head = F.concat(F.lit('{"to":'), _quoted(F.col("receiver")), F.lit(',"message":'))
    if framework != "a2a":
        return _events(messages, "inter_agent_message", "message", "sender", framework, [head, F.lit("}")], True)
    correlation = F.col("correlation_id") if "correlation_id" in messages.columns else F.lit(None).cast("string")
    events = _events(messages, "a2a_message", "message", "sender", framework, [head, F.concat(F.lit(',"correlation_id":'), _quoted(correlation), F.lit("}"))], True)
    return events.withColumn("output_hash", F.lit(""))  # the protocol's events hold no hash
