"""Device-mode checks: dose ranges, rolling change limit, class gating, tokens, snapshots."""

from __future__ import annotations

import base64
import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caduspark.functions import ed25519, fixed
from caduspark.functions.hashing import hmac_by_pads, hmac_pads

HOUR_US = 3_600_000_000


def validate_dose(df: DataFrame, ranges: DataFrame, parameter: str, value: str, strict: bool = True, name: str = "dose_ok") -> DataFrame:
    """ranges (parameter, min, max, place): the first range of a parameter holds, bounds included; a dimension table."""
    first = ranges.groupBy("parameter").agg(F.min(F.struct("place", "min", "max")).alias("r"))
    any_range = ranges.limit(1).agg((F.count("*") > 0).alias("__any"))
    out = df.join(first.select(F.col("parameter").alias("__p"), F.col("r.min").alias("__min"), F.col("r.max").alias("__max")), df[parameter] == F.col("__p"), "left")
    out = out.join(F.broadcast(any_range), how="left") if strict else out.withColumn("__any", F.lit(False))
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    ok = F.when(~finite, False).when(F.col("__p").isNotNull(), (v >= F.col("__min")) & (v <= F.col("__max"))).otherwise(~F.col("__any"))
    return out.withColumn(name, ok).drop("__p", "__min", "__max", "__any")


def rate_limit(changes: DataFrame, limit: int | None, session: str = "session_id", ts_us: str = "ts_us", event: str = "event_id") -> DataFrame:
    """Changes of the hour up to each one (an hour old counts) and whether they keep within the limit.

    RANGE counts changes of the same microsecond that come later by id; their number is taken off again.
    """
    hour = Window.partitionBy(session).orderBy(ts_us).rangeBetween(-HOUR_US, 0)
    same = Window.partitionBy(session, ts_us).orderBy(F.desc(event))
    seen = F.count("*").over(hour) - F.row_number().over(same) + 1
    return changes.withColumn("changes_in_hour", seen).withColumn("within_limit", F.lit(True) if limit is None else F.col("changes_in_hour") <= limit)


def emergency_gate(events: DataFrame) -> DataFrame:
    """events (session_id, ts_us, event_id, kind) plus `running`: whether no emergency_stop stands that a later reset has not cleared."""
    before = Window.partitionBy("session_id").orderBy("ts_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    control = F.last(F.when(F.col("kind").isin("emergency_stop", "reset"), F.col("kind")), ignorenulls=True).over(before)
    return events.withColumn("running", ~F.coalesce(control == "emergency_stop", F.lit(False)))


def report_section(events: DataFrame, config: dict) -> DataFrame:
    """A row a session: the device's configuration, changes since the last reset, and whether the stop stands; no rows where device mode is off.

    events (session_id, ts_us, event_id, kind) with kinds device_change, emergency_stop and reset.
    """
    rows = emergency_gate(events) if config.get("enabled") else emergency_gate(events).limit(0)
    order = F.struct("ts_us", "event_id")
    reset = F.max(F.when(F.col("kind") == "reset", order)).over(Window.partitionBy("session_id"))
    counted = (F.col("kind") == "device_change") & (F.col("__reset").isNull() | (order > F.col("__reset")))
    out = rows.withColumn("__reset", reset).groupBy("session_id").agg(F.count_if(counted).alias("device_changes_this_session"), (~F.max_by("running", order)).alias("emergency_stop_engaged"))
    shown = ("software_safety_class", "device_type", "intended_use", "manufacturer", "udi", "rate_limit_per_hour")
    return out.select("session_id", *[F.lit(config.get(c)).cast("long" if c == "rate_limit_per_hour" else "string").alias(c) for c in shown], "device_changes_this_session", "emergency_stop_engaged")


def class_violations(actions: DataFrame, safety_class: str) -> DataFrame:
    """Actions (name, tier) that a safety class forbids."""
    bad = {"A": F.col("tier") != "informational", "B": F.col("tier") == "interventional", "C": F.lit(False)}[safety_class]
    return actions.where(bad)


def authorize(requests: DataFrame, keys: dict[str, bytes], name: str = "authorized") -> DataFrame:
    """requests (action_name, clinician_id, signature): HMAC of the action under the clinician's key; clinicians without a key may nothing.

    The keys are a table of pads joined by clinician: one HMAC a row however many clinicians there are.
    """
    pads = [(clinician, *hmac_pads(key)) for clinician, key in keys.items()]
    known = requests.sparkSession.createDataFrame(pads, "__clinician string, __inner string, __outer string")
    out = requests.join(known, requests["clinician_id"] == F.col("__clinician"), "left")
    ok = hmac_by_pads(F.col("action_name"), F.col("__inner"), F.col("__outer")) == F.col("signature")
    return out.withColumn(name, F.coalesce(ok, F.lit(False))).drop("__clinician", "__inner", "__outer")


def token_verdicts(tokens: DataFrame, known: DataFrame, now: int, max_age: int = 120, signed: str | None = None) -> DataFrame:
    """tokens (session_id, nonce, clinician_id, issued_at, arrival): unknown clinician, expired, replay, invalid signature or ok, in that order.

    A nonce counts as used by the first token of a session that is otherwise good.  signed names a column that tells whether
    the signature fits; without it signatures are taken as good.
    """
    fits = F.lit(True) if signed is None else F.coalesce(F.col(signed), F.lit(False))
    people = known.select(F.col("clinician_id").alias("__c")).distinct()
    rows = tokens.join(people, tokens["clinician_id"] == F.col("__c"), "left")
    rows = rows.withColumn("__good", F.col("__c").isNotNull() & (F.lit(now) - F.col("issued_at") <= max_age) & fits)
    before = Window.partitionBy("session_id", "nonce").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.max(F.col("__good").cast("int")).over(before), F.lit(0)) > 0
    verdict = F.when(F.col("__c").isNull(), "unknown clinician").when(F.lit(now) - F.col("issued_at") > max_age, "token expired").when(used, "token replay detected").when(~fits, "invalid signature").otherwise("ok")
    return rows.withColumn("verdict", verdict).drop("__c", "__good")


_TOKEN = ("action_name", "clinician_id", "issued_at", "nonce", "session_id")


def token_message(token: dict) -> bytes:
    """What a clinician signs: the token's fields as JSON with sorted keys."""
    return json.dumps({k: token[k] for k in _TOKEN}, sort_keys=True).encode()


def signed_token_verdicts(tokens: DataFrame, public_keys: dict[str, bytes], now: int, max_age: int = 120) -> DataFrame:
    """tokens (blob: base64 JSON, signature: binary, arrival) plus the token's fields and its verdict; keys are PEM Ed25519 by clinician.

    Signatures of unknown clinicians and of expired tokens are not looked at: their verdict stands without.

    Blobs that are no JSON object are `malformed token`, those that lack a field `missing required token fields`; neither uses up a nonce.
    """
    raw = {who: ed25519.from_pem(pem) for who, pem in public_keys.items()}
    kind = pa.struct([(c, pa.int64() if c == "issued_at" else pa.string()) for c in _TOKEN] + [("problem", pa.string()), ("signed", pa.bool_())])

    def read(blob: str | None, signature: bytes | None) -> dict:
        try:
            given = json.loads(base64.b64decode(blob or ""))
        except ValueError:
            return {"problem": "malformed token"}
        try:
            token = {c: int(given[c]) if c == "issued_at" else str(given[c]) for c in _TOKEN}
        except (KeyError, TypeError, ValueError):
            return {"problem": "missing required token fields"}
        key = raw.get(token["clinician_id"])
        fits = key is not None and now - token["issued_at"] <= max_age and ed25519.verify(key, token_message(token), signature or b"")
        return token | {"signed": fits}

    @F.arrow_udf("struct<action_name:string,clinician_id:string,issued_at:bigint,nonce:string,session_id:string,problem:string,signed:boolean>")
    def run(blobs: pa.Array, signatures: pa.Array) -> pa.Array:
        return pa.array([read(*x) for x in zip(blobs.to_pylist(), signatures.to_pylist())], kind)

    rows = tokens.withColumn("__token", run("blob", "signature")).select("*", "__token.*").drop("__token")
    known = tokens.sparkSession.createDataFrame([(who,) for who in raw], "clinician_id string")
    out = token_verdicts(rows, known, now, max_age, "signed")
    return out.withColumn("verdict", F.coalesce("problem", "verdict")).drop("problem", "signed")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """(key, attribute, old, new) of every attribute that changed."""
    a = old.select(F.col(key).alias("__k"), *[F.col(c).cast("string").alias(f"o_{c}") for c in attributes])
    b = new.select(F.col(key).alias("__n"), *[F.col(c).cast("string").alias(f"n_{c}") for c in attributes])
    both = a.join(b, F.col("__k") == F.col("__n"), "full_outer")
    rows = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(f"o_{c}").alias("old"), F.col(f"n_{c}").alias("new")) for c in attributes])
    return both.select(F.coalesce("__k", "__n").alias(key), F.inline(rows)).where(~F.col("old").eqNullSafe(F.col("new")))


def impact_flags(old: DataFrame, new: DataFrame) -> DataFrame:
    """Flags between two deployments, rows of (deployment, safety_class, model, rate_limit, parameter, max) per dose range."""
    rank = lambda c: F.when(c == "A", 0).when(c == "B", 1).when(c == "C", 2)
    a = old.select("deployment", "parameter", F.col("max").alias("old_max"), F.col("safety_class").alias("old_class"), F.col("model").alias("old_model"), F.col("rate_limit").alias("old_limit"), F.lit(True).alias("had"))
    b = new.select("deployment", "parameter", F.col("max").alias("new_max"), F.col("safety_class").alias("new_class"), F.col("model").alias("new_model"), F.col("rate_limit").alias("new_limit"), F.lit(True).alias("has"))
    both = a.join(b, ["deployment", "parameter"], "full_outer")
    wider = F.col("has") & (F.col("had").isNull() | (F.col("new_max") > F.col("old_max")))
    return both.groupBy("deployment").agg(
        F.max(rank(F.col("new_class"))).alias("nc"),
        F.max(rank(F.col("old_class"))).alias("oc"),
        F.max("old_model").alias("om"),
        F.max("new_model").alias("nm"),
        F.max("old_limit").alias("ol"),
        F.max("new_limit").alias("nl"),
        F.array_sort(F.collect_set(F.when(wider, F.concat(F.lit("dose_range_expansion:"), F.col("parameter"))))).alias("w"),
    ).select(
        "deployment",
        F.array_join(
            F.concat(
                F.array_compact(F.array(F.when(F.col("nc") > F.col("oc"), F.lit("safety_class_upgrade")), F.when(~F.col("om").eqNullSafe(F.col("nm")), F.lit("model_version_change")))),
                "w",
                F.array_compact(F.array(F.when(F.col("ol").isNotNull() & (F.col("nl").isNull() | (F.col("nl") > F.col("ol"))), F.lit("rate_limit_relaxation")))),
            ),
            ",",
        ).alias("flags"),
    )


def rigor(df: DataFrame, safety_class: str) -> DataFrame:
    """df plus the rigor level and required documents of its safety class."""
    code, documents = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (level, papers) in fixed.RIGOR.items():
        code = F.when(F.col(safety_class) == name, level).otherwise(code)
        documents = F.when(F.col(safety_class) == name, "; ".join(papers)).otherwise(documents)
    return df.withColumn("rigor", code).withColumn("documents", documents)
