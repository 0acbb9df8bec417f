"""The scan: text -> hits -> redacted text -> tags; and its forms for arrays, maps, bytes, JSON and FHIR."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caduspark.functions import batch, detect, fixed, redact


def scan(df: DataFrame, text: str, mode: str = "REDACT", overrides: dict[str, str] | None = None, salt: str = "session", encoded: bool = True, hits: str = "hits", redacted: str = "redacted", detectors: tuple[detect.Detector, ...] = ()) -> DataFrame:
    """df with the merged hits of a text column and the redacted text; a narrow projection, no shuffle.  detectors are one's own, beside the patterns."""
    t = F.col(f"`{text}`")
    special = F.lit(True) if detectors else F.coalesce(detect.is_hl7(t), F.lit(False))  # texts with hits of other kinds too
    parts = [batch.scanned_column(F.when(special, t), encoded, merge=False), detect.hl7_hits(t), *[F.coalesce(d(t), detect.no_hits()) for d in detectors]]
    out = df.withColumn("__special", F.when(special, F.coalesce(detect.merge(F.concat(*parts)), detect.no_hits())))
    mixed = redact.redact(t, F.col("__special"), mode, overrides, salt)
    if detectors:
        return out.withColumns({hits: F.col("__special"), redacted: mixed}).drop("__special")
    plain = F.when(~special, t)
    found = F.when(special, F.col("__special")).otherwise(batch.scanned_column(plain, encoded))
    return out.withColumns({hits: found, redacted: F.when(special, mixed).otherwise(batch.redacted_column(plain, mode, overrides, salt, encoded))}).drop("__special")


def plain_scan(text: Column, mode: str = "REDACT") -> Column:
    """Redacted text by patterns alone; for elements of arrays and maps."""
    return redact.redact(text, detect.regex_hits(text), mode)


def scan_array(values: Column) -> Column:
    """Element by element; the shape stays."""
    return F.transform(values, lambda v: plain_scan(v))


def scan_map(values: Column) -> Column:
    """Keys and values; a key that meets an earlier one after redaction gets underscores until it is new."""
    pairs = F.transform(F.map_entries(values), lambda e: F.struct(plain_scan(e["key"]).alias("key"), plain_scan(e["value"]).alias("value")))
    empty = F.array().cast("array<struct<key:string,value:string>>")

    def step(out: Column, e: Column) -> Column:
        taken = F.size(F.filter(out, lambda o: F.regexp_replace(o["key"], "_+$", "") == F.regexp_replace(e["key"], "_+$", "")))
        clash = F.exists(out, lambda o: o["key"] == e["key"])
        key = F.when(clash, F.concat(e["key"], F.repeat(F.lit("_"), taken))).otherwise(e["key"])
        return F.concat(out, F.array(F.struct(key.alias("key"), e["value"].alias("value"))))

    return F.map_from_entries(F.aggregate(pairs, empty, step))


def scan_bytes(payload: Column) -> Column:
    """UTF-8 bytes are scanned as text; other bytes, and bytes without hits, stay as they are."""
    text = payload.cast("string")
    return F.when(F.is_valid_utf8(text) & (F.size(detect.regex_hits(text)) > 0), F.encode(plain_scan(text), "UTF-8")).otherwise(payload)


def tags(scanned: DataFrame, key: str, origin: Column, hits: str = "hits") -> DataFrame:
    """One row a hit; tag_id is a hash of document, place and type, so repeated runs agree."""
    # a bare column would be tested for emptiness below, by computing the hits again
    rows = scanned.select(F.col(key), origin.alias("origin_agent"), F.explode(F.coalesce(F.col(f"`{hits}`"), detect.no_hits())).alias("h"))
    ident = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col("h.start").cast("string"), F.col("h.end").cast("string"), F.col("h.phi_type")), 256)
    return rows.select(
        ident.alias("tag_id"),
        key,
        F.col("h.phi_type").alias("phi_type"),
        F.col("h.source").alias("source"),
        F.col("h.confidence").alias("confidence"),
        F.concat(F.lit("["), F.col("h.phi_type"), F.lit("]")).alias("redacted_value"),
        "origin_agent",
    )


def fhir_redact(df: DataFrame, column: str, name: str = "redacted") -> DataFrame:
    """FHIR JSON: identifying top-level fields of the resource, and of resources in it, become [REDACTED:<field>]; all else keeps its type."""
    return scan_json(df, column, name)


_TOO_DEEP = "[REDACTED:MAX_DEPTH_EXCEEDED]"


def _walk(value, depth: int, most: int, redact_text, found: list):
    """The redacted value; found gets (type, source, confidence) of every hit."""
    if value is None or isinstance(value, (bool, int, float)):
        return value
    if depth >= most:
        found.append(("SCAN_DEPTH_EXCEEDED", f"max_depth={most}", 1.0))
        return _TOO_DEEP
    if isinstance(value, str):
        return redact_text(value, found)
    if isinstance(value, list):
        return [_walk(v, depth + 1, most, redact_text, found) for v in value]
    kind = value.get("resourceType")
    fields = fixed.FHIR_FIELDS.get(kind, []) if isinstance(kind, str) else []
    out: dict = {}
    for key, v in value.items():
        name = redact_text(key, found)
        while name in out:
            name += "_"
        if key in fields and v is not None:
            found.append((f"FHIR_{key.upper()}", f"fhir:{kind}.{key}", 0.99))
            out[name] = f"[REDACTED:{key}]"
        else:
            out[name] = _walk(v, depth + 1, most, redact_text, found)
    return out


def scan_json(df: DataFrame, column: str, name: str = "redacted", most: int = 64, found: str | None = None) -> DataFrame:
    """JSON of any shape, to a depth of `most`; keys are scanned as well.  Text that is no JSON is scanned as text.

    found names a column for the hits, array<struct<phi_type, source, confidence>>; what lies too deep, or is nested
    beyond what a JSON reader takes, gives a SCAN_DEPTH_EXCEEDED there.
    """
    from caduspark.functions.pure import redact_with, scanned

    def redact_text(text: str, hits: list) -> str:
        mine = scanned(text)
        hits += [(h[0], h[5], h[4]) for h in mine]
        return redact_with(text, mine)

    @F.arrow_udf("struct<redacted:string,found:array<struct<phi_type:string,source:string,confidence:double>>>")
    def run(values: pa.Array) -> pa.Array:
        names = ("phi_type", "source", "confidence")
        out = []
        for value in values.to_pylist():
            hits: list = []
            try:
                text = None if value is None else json.dumps(_walk(json.loads(value), 0, most, redact_text, hits), ensure_ascii=False, separators=(",", ":"))
            except RecursionError:
                text, hits = json.dumps(_TOO_DEEP), [("SCAN_DEPTH_EXCEEDED", f"max_depth={most}", 1.0)]
            except ValueError:
                text = redact_text(value, hits)
            out.append({"redacted": text, "found": [dict(zip(names, h)) for h in hits]})
        kind = pa.struct([("redacted", pa.string()), ("found", pa.list_(pa.struct(list(zip(names, (pa.string(), pa.string(), pa.float64()))))))])
        return pa.array(out, kind)

    out = df.withColumn("__scanned", run(F.col(f"`{column}`"))).withColumn(name, F.col("__scanned.redacted"))
    if found:
        out = out.withColumn(found, F.col("__scanned.found"))
    return out.drop("__scanned")


def minimum_necessary(resource: Column, paths: list[str]) -> Column:
    """JSON with only the listed dotted paths; values keep their types, paths that are missing are left out."""
    whole = F.try_parse_json(resource)
    tree: dict = {}
    for path in sorted({p.lstrip(".") for p in paths}, key=lambda p: (p.count("."), p)):
        *parents, last = path.split(".")
        at = tree
        for part in parents:
            at = at.setdefault(part, {}) if at is not None else None
        if at is not None:
            at[last] = None  # a whole value; paths into it add nothing

    def build(node: dict, prefix: str) -> Column:
        parts = []
        for name, inner in sorted(node.items()):
            where = f"{prefix}.{name}"
            raw = F.try_variant_get(whole, where, "variant")
            key = F.lit(json.dumps(name, ensure_ascii=False) + ":")
            if inner is None:
                parts.append(F.when(raw.isNotNull(), F.concat(key, F.to_json(raw))))
            else:
                shown = build(inner, where)
                parts.append(F.when(raw.isNotNull() & (shown != "{}"), F.concat(key, shown)))
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))

    return build(tree, "$")


def minimal(column: str, paths: list[str], purpose: str = "") -> Callable[[DataFrame], DataFrame]:
    """minimum_necessary() as a step for DataFrame.transform, which carries its fields and purpose for the audit."""

    def step(df: DataFrame) -> DataFrame:
        return df.withColumn(column, minimum_necessary(F.col(f"`{column}`"), paths))

    step.allowed_fields, step.purpose = tuple(paths), purpose
    return step
