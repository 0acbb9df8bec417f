"""Attestation rules: a small predicate language compiled to aggregates; all rules share one aggregate by session.

Shapes: a bare name, every_event.has(field), event_count <op> N.  Anything else is unsatisfied, with a reason.
"Some later event" predicates compare with the last such event of the session, so no self-join is needed.
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caduspark.functions import fixed

_COMPARE: dict[type, Callable] = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    predicate: str
    severity: str = "blocker"
    references: tuple[str, ...] = ()
    framework: str = ""


@dataclass
class Plan:
    """Aggregates that the predicates need, by name."""

    schema: dict[str, str]
    secret: bool = False
    traced: bool = False
    aggregates: dict[str, Column] = field(default_factory=dict)

    def agg(self, name: str, column: Column) -> Column:
        self.aggregates[name] = column
        return F.col(name)


def bundled() -> list[Rule]:
    return [Rule(i, title, predicate, severity, (ref,), framework) for framework, i, title, predicate, severity, ref in fixed.RULES]


def load_rules(source: str | Path) -> list[Rule]:
    """Rules of a YAML file or text: name (or the file's), rules with id, predicate, title, severity, references; bad shapes raise ValueError."""
    import yaml

    at = source if isinstance(source, Path) else Path(source) if "\n" not in source and source.endswith((".yaml", ".yml")) else None
    raw = yaml.safe_load(source if at is None else at.read_text())
    listed = (raw.get("rules") or []) if isinstance(raw, dict) else None
    if not isinstance(listed, list):
        raise ValueError("a ruleset must be a mapping with a list of rules")
    if any(not isinstance(r, dict) or not {"id", "predicate"} <= set(r) for r in listed):
        raise ValueError("a rule needs an id and a predicate")
    name = str(raw.get("name") or (at.stem if at else ""))
    return [Rule(str(r["id"]), str(r.get("title", "")), str(r["predicate"]), str(r.get("severity", "info")), tuple(map(str, r.get("references") or ())), name) for r in listed]


def load_folder(folder: str | Path) -> list[Rule]:
    """Rules of all YAML files of a folder, by file name."""
    return [rule for path in sorted(Path(folder).glob("*.yaml")) for rule in load_rules(path)]


def missing(name: str, kind: str) -> Column:
    """Null, zero, empty or "unknown"."""
    c = F.col(name)
    if kind.startswith(("array", "map")):
        return c.isNull() | (F.size(c) == 0)
    if kind == "boolean":
        return ~F.coalesce(c, F.lit(False))
    if kind == "string":
        return c.isNull() | c.isin("", "unknown")
    if kind in ("timestamp", "date", "timestamp_ntz") or kind.startswith("struct"):
        return c.isNull()
    return c.isNull() | (c == 0)


def _kind(name: str) -> Column:
    return F.col("event_type") == name


def _has(plan: Plan, name: str) -> tuple[Column, Column]:
    if name not in plan.schema:
        n = plan.agg("n", F.count("*"))
        return n == 0, F.concat(n.cast("string"), F.lit(f" event(s) missing {name}"))
    gone = plan.agg(f"missing_{name}", F.count_if(missing(name, plan.schema[name])))
    return gone == 0, F.when(gone == 0, F.lit(f"all events have {name}")).otherwise(F.concat(gone.cast("string"), F.lit(f" event(s) missing {name}")))


def _no_gaps(plan: Plan) -> tuple[Column, Column]:
    n, gaps = plan.agg("n", F.count("*")), plan.agg("gaps", F.count_if(F.col("__step") != 1))
    return gaps == 0, F.when(gaps == 0, F.concat(F.lit("sequence intact ("), n.cast("string"), F.lit(" events)"))).otherwise(F.lit("sequence gap"))


def _redacted(plan: Plan) -> tuple[Column, Column]:
    seen = plan.agg("detected", F.count_if(_kind("phi_detected")))
    open_ = plan.agg("unredacted", F.count_if(_kind("phi_detected") & (F.col("sequence_number") >= F.coalesce(F.col("__last_redacted"), F.lit(-(2**62))))))
    reason = F.when(seen == 0, F.lit("no PHI detected")).when(open_ > 0, F.concat(open_.cast("string"), F.lit(" PHI detection(s) without redaction")))
    return open_ == 0, reason.otherwise(F.lit("every PHI detection has matching redaction"))


def _reviewed(plan: Plan) -> tuple[Column, Column]:
    mine = _kind("escalation_triggered") & (F.col("risk_tier") == "advisory")
    seen = plan.agg("advisory", F.count_if(mine))
    open_ = plan.agg("unreviewed", F.count_if(mine & (F.col("sequence_number") >= F.coalesce(F.col("__last_review"), F.lit(-(2**62))))))
    reason = F.when(seen == 0, F.lit("no advisory escalations")).when(open_ > 0, F.concat(open_.cast("string"), F.lit(" advisory escalation(s) without review")))
    return open_ == 0, reason.otherwise(F.lit("all advisory escalations reviewed"))


def _escalated(plan: Plan) -> tuple[Column, Column]:
    calls = plan.agg("interventional_calls", F.count_if(_kind("tool_call") & (F.col("risk_tier") == "interventional")))
    raised = plan.agg("escalations", F.count_if(_kind("escalation_triggered")))
    reason = F.when(calls == 0, F.lit("no interventional tool calls")).when(raised == 0, F.concat(calls.cast("string"), F.lit(" interventional call(s) without escalation")))
    return (calls == 0) | (raised > 0), reason.otherwise(F.lit("interventional calls escalated"))


def _bounded(plan: Plan) -> tuple[Column, Column]:
    start, end = plan.agg("starts", F.count_if(_kind("session_start"))), plan.agg("ends", F.count_if(_kind("session_end")))
    lacks = F.concat_ws(", ", F.when(start == 0, F.lit("SESSION_START")), F.when(end == 0, F.lit("SESSION_END")))
    ok = (start > 0) & (end > 0)
    return ok, F.when(ok, F.lit("session bounded")).otherwise(F.concat(F.lit("missing "), lacks))


def _verifies(plan: Plan) -> tuple[Column, Column]:
    if not plan.secret:
        return F.lit(False), F.lit("secret_key not provided")
    error = plan.agg("chain_error", F.max("__chain_error"))
    return error.isNull(), F.coalesce(error, F.lit("chain verified"))


def _traced(plan: Plan) -> tuple[Column, Column]:
    return F.lit(plan.traced), F.lit("iec62304 metadata captured" if plan.traced else "iec62304 metadata absent")


PREDICATES: dict[str, Callable[[Plan], tuple[Column, Column]]] = {
    "chain_verifies": _verifies,
    "signature_present": lambda plan: _has(plan, "signature"),
    "no_gaps_in_sequence": _no_gaps,
    "phi_redacted_when_detected": _redacted,
    "escalation_triggered_for_interventional": _escalated,
    "session_has_start_and_end": _bounded,
    "iec62304_traceability_present": _traced,
    "human_review_for_advisory": _reviewed,
}


def compile_predicate(text: str, plan: Plan) -> tuple[Column, Column]:
    """(satisfied, reason) over the aggregates that it adds to the plan."""
    try:
        node = ast.parse(text.strip(), mode="eval").body
    except SyntaxError:
        return F.lit(False), F.lit(f"predicate parse error: {text!r}")
    match node:
        case ast.Name(id=name):
            if name not in PREDICATES:
                return F.lit(False), F.lit(f"unknown predicate: {name!r}")
            return PREDICATES[name](plan)
        case ast.Call(func=ast.Attribute(value=ast.Name(id="every_event"), attr="has"), args=[ast.Name(id=name)]):
            return _has(plan, name)
        case ast.Compare(left=ast.Name(id="event_count"), ops=[op], comparators=[ast.Constant(value=int(limit))]):
            if type(op) not in _COMPARE:
                return F.lit(False), F.lit(f"unsupported comparator: {type(op).__name__}")
            n = plan.agg("n", F.count("*"))
            return _COMPARE[type(op)](n, F.lit(int(limit))), F.concat(F.lit("event_count="), n.cast("string"), F.lit(f" vs threshold={int(limit)}"))
    return F.lit(False), F.lit(f"unsupported predicate shape: {text!r}")


def _prepared(events: DataFrame) -> DataFrame:
    """Events with what predicates need of their session: step from the event before, last redaction, last review."""
    ordered = Window.partitionBy("session_id").orderBy("sequence_number")
    whole = Window.partitionBy("session_id")
    last = lambda kind: F.max(F.when(_kind(kind), F.col("sequence_number"))).over(whole)
    return events.withColumns(
        {
            "__step": F.col("sequence_number") - F.lag("sequence_number").over(ordered),
            "__last_redacted": last("phi_redacted"),
            "__last_review": last("human_review_response"),
        }
    )


def evaluate(events: DataFrame, rules: list[Rule] | None = None, verified: DataFrame | None = None, traced: bool = False, extra: dict[str, Column] | None = None) -> DataFrame:
    """(session_id, rule_id, framework, title, severity, satisfied, reason[, extra aggregates]) of every session and rule.

    verified is chain.verify()'s result where the secret is known.  One shuffle by session serves the windows and the aggregate.
    """
    rules = bundled() if rules is None else rules
    plan = Plan({f.name: f.dataType.simpleString() for f in events.schema.fields}, verified is not None, traced)
    rows = _prepared(events)
    if verified is not None:
        rows = rows.join(verified.select("session_id", F.col("error").alias("__chain_error")), "session_id", "left")
    results = []
    for place, rule in enumerate(rules):
        ok, reason = compile_predicate(rule.predicate, plan)
        results.append(
            F.struct(
                F.lit(place).alias("place"), F.lit(rule.id).alias("rule_id"), F.lit(rule.framework).alias("framework"), F.lit(rule.title).alias("title"), F.lit(rule.severity).alias("severity"),
                ok.alias("satisfied"), reason.alias("reason"),
            )
        )
    aggregates = plan.aggregates | (extra or {}) or {"n": F.count("*")}
    grouped = rows.groupBy("session_id").agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.select("session_id", *(extra or {}), F.inline(F.array(*results)))


def evidence(events: DataFrame, predicate: str) -> DataFrame:
    """(session_id, event_id) rows that speak for or against a predicate; rows, not lists, so no session is collected."""
    rows = _prepared(events)
    late = F.lit(-(2**62))
    if predicate == "phi_redacted_when_detected":
        mine = _kind("phi_detected")
        bad = mine & (F.col("sequence_number") >= F.coalesce(F.col("__last_redacted"), late))
        good = mine | _kind("phi_redacted")
    elif predicate == "human_review_for_advisory":
        mine = _kind("escalation_triggered") & (F.col("risk_tier") == "advisory")
        bad = mine & (F.col("sequence_number") >= F.coalesce(F.col("__last_review"), late))
        good = mine | (_kind("human_review_response") & (F.max(F.when(mine, 1)).over(Window.partitionBy("session_id")) == 1))
    elif predicate == "escalation_triggered_for_interventional":
        call = _kind("tool_call") & (F.col("risk_tier") == "interventional")
        any_call = F.max(F.when(call, 1)).over(Window.partitionBy("session_id")) == 1
        bad, good = F.lit(False), call | (_kind("escalation_triggered") & any_call)
    elif predicate == "session_has_start_and_end":
        first = lambda kind: F.min(F.when(_kind(kind), F.col("sequence_number"))).over(Window.partitionBy("session_id"))
        rows = rows.withColumns({"__start": first("session_start"), "__end": first("session_end")})
        mine = (_kind("session_start") & (F.col("sequence_number") == F.col("__start"))) | (_kind("session_end") & (F.col("sequence_number") == F.col("__end")))
        bad, good = F.lit(False), mine & F.col("__start").isNotNull() & F.col("__end").isNotNull()
    elif predicate.startswith("every_event.has(") or predicate == "signature_present":
        name = "signature" if predicate == "signature_present" else predicate[len("every_event.has(") : -1]
        bad, good = missing(name, events.schema[name].dataType.simpleString()), F.lit(True)
    else:
        bad, good = F.lit(False), F.lit(True)
    some_bad = F.max(F.when(bad, 1)).over(Window.partitionBy("session_id")) == 1
    rows = rows.withColumn("__bad", bad).withColumn("__good", good).withColumn("__some", F.coalesce(some_bad, F.lit(False)))
    return rows.where((F.col("__some") & F.col("__bad")) | (~F.col("__some") & F.col("__good"))).select("session_id", "event_id")
