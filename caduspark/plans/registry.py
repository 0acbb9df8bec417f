"""All queries of the library proper and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caduspark.functions import batch, detect, ed25519, fixed, signals
from caduspark.operators import calibrate, chain, device, grounding, metrics, propagation, report, routing, rules, scan
from caduspark.plans import duck, views
from caduspark.sources import adapters, dicom, keys, store
from caduspark.streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
KEY = b"an audit key for tests only, 32+"
DRUGS, CODES = ["amoxicillin", "lisinopril", "metformin"], ["e11.9", "i10"]
NAMES = r"(?U)\b\p{Lu}\p{Ll}+\s+\p{Lu}\p{Ll}+\b"
NOW_US = 1_704_100_000_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query by its function's name, with its SQL twin."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return views.spark_view(spark, sf_dir, sql)


NOTES, AUDIT, ACTIONS, ALL = (views.duck(v) for v in (views.NOTES, views.AUDIT, views.ACTIONS, views.ALL))
DOCS = "SELECT doc_id, text FROM documents"
ASCII_TYPES = ["SSN", "EMAIL", "PHONE", "IP_ADDRESS", "URL", "DATE", "NPI", "DEA", "ZIP"]


def _dealt(spark: SparkSession, sf_dir: str, sql: str, task_bytes: int = 2 << 20) -> DataFrame:
    return views.spark_view(spark, sf_dir, sql, lambda df: store.spread(df, task_bytes))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dealt(spark, sf_dir, views.NOTES)


# --- detection ------------------------------------------------------------------------------------------


def _spans(df: DataFrame, key: str, types: list[str] | None = None) -> DataFrame:
    return _shown(df.select(key, F.explode(detect.raw_hits(F.col("text"), types)).alias("h")), key)


def _shown(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.col("h.phi_type").alias("phi_type"), F.col("h.start").alias("start"), F.col("h.end").alias("stop"), F.col("h.value").alias("value"), F.col("h.confidence").alias("confidence"))


@query(f"SELECT note_id, phi_type, start, stop, value, confidence FROM ({duck.spans(NOTES, 'note_id')})")
def phi_spans_notes(spark, sf_dir):
    """Every pattern hit of the synthesized notes."""
    return _shown(notes(spark, sf_dir).select("note_id", F.explode(batch.raw_column(F.col("text"))).alias("h")), "note_id")


@query(f"SELECT phi_type, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM ({duck.spans(DOCS, 'doc_id', types=['EMAIL', 'PHONE', 'IP_ADDRESS', 'URL'])}) GROUP BY phi_type")
def phi_hits_by_type(spark, sf_dir):
    """X1 on real documents, for the types whose patterns agree in both engines."""
    rows = _spans(store.spread(read(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", ["EMAIL", "PHONE", "IP_ADDRESS", "URL"])
    return rows.groupBy("phi_type").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("docs"))


@query(f"SELECT doc_id, count(*) AS n_hits, min(start) AS first_start, max(stop) AS last_stop FROM ({duck.spans(DOCS, 'doc_id', types=['EMAIL', 'PHONE', 'IP_ADDRESS', 'URL'])}) GROUP BY doc_id")
def phi_doc_summary(spark, sf_dir):
    rows = _spans(store.spread(read(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", ["EMAIL", "PHONE", "IP_ADDRESS", "URL"])
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_hits"), F.min("start").alias("first_start"), F.max("stop").alias("last_stop"))


@query()
def phi_hits_by_type_all(spark, sf_dir):
    """phi_hits_by_type for all ten types (no SQL: six patterns differ in DuckDB; tested against plain Python)."""
    rows = _spans(store.spread(read(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")
    return rows.groupBy("phi_type").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("docs"))


@query()
def phi_doc_summary_all(spark, sf_dir):
    """phi_doc_summary for all ten types (tested against plain Python)."""
    rows = _spans(store.spread(read(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_hits"), F.min("start").alias("first_start"), F.max("stop").alias("last_stop"))


def _merged(df: DataFrame, key: str) -> DataFrame:
    rows = df.select(key, F.explode(batch.merged_column(F.col("text"))).alias("h"))
    return rows.select(key, F.col("h.start").alias("start"), F.col("h.end").alias("stop"), F.col("h.phi_type").alias("phi_type"), F.col("h.value").alias("value"), F.col("h.confidence").alias("confidence"))


@query(f"SELECT note_id, start, stop, phi_type, value, confidence FROM ({duck.merged(NOTES, 'note_id')})")
def phi_overlap_merge(spark, sf_dir):
    """Overlapping hits folded into the union of their spans."""
    return _merged(notes(spark, sf_dir), "note_id")


_CONTEXT = "SELECT o_orderkey AS note_id, CASE o_orderkey % 3 WHEN 0 THEN 'Resting BP 123-45-6789 seen' WHEN 1 THEN 'in the year of 2024-01-0' || cast(1 + o_orderkey % 9 AS string) ELSE 'ssn is 123-45-6789 ok' END AS text FROM {orders}"


@query(
    f"SELECT note_id, phi_type, start FROM ({duck.merged(views.duck(_CONTEXT), 'note_id')}) JOIN ({views.duck(_CONTEXT)}) USING (note_id) "
    "WHERE NOT (phi_type = 'SSN' AND regexp_matches(lower(substr(text, cast(greatest(start - 24, 0) + 1 AS BIGINT), cast(least(start, 24) AS BIGINT))), ' pulse| bp| rate ')) "
    "AND NOT (phi_type = 'DATE' AND contains(lower(substr(text, cast(greatest(start - 24, 0) + 1 AS BIGINT), cast(least(start, 24) AS BIGINT))), ' year '))"
)
def phi_pipeline_context_filter(spark, sf_dir):
    """A pipeline of detectors with the clinical context filter."""
    t = F.col("text")
    rows = view(spark, sf_dir, _CONTEXT).select("note_id", F.explode(detect.keep_by_context(t, detect.regex_hits(t))).alias("h"))
    return rows.select("note_id", F.col("h.phi_type").alias("phi_type"), F.col("h.start").alias("start"))


@query(
    "SELECT doc_id, lang, count(*) FILTER (contains(w, 'con') OR contains(w, 'patient') OR contains(w, 'paciente') OR contains(w, 'nacimiento')) * 0 + count(*) FILTER ("
    "(lang = 'es' AND (contains(w, 'paciente') OR contains(w, 'señor') OR contains(w, 'señora') OR contains(w, 'doctor'))) OR (lang = 'fr' AND (contains(w, 'patient') OR contains(w, 'monsieur') OR contains(w, 'madame') OR contains(w, 'docteur')))) AS kept "
    "FROM (SELECT doc_id, lang, lower(substr('paciente ' || text, 1, 45)) AS w FROM documents) GROUP BY doc_id, lang"
)
def phi_multilingual_filter(spark, sf_dir):
    """a weak NAME hit survives only with a cue of the document's language near it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.lit("paciente "), "text").alias("t"))
    weak = F.array(detect.hit(F.lit("NAME"), F.lit(9), F.lit(13), F.substring("t", 10, 4), F.lit(0.4), F.lit("test")))
    return docs.select("doc_id", "lang", F.size(detect.keep_by_language(F.col("t"), weak, F.col("lang"))).cast("long").alias("kept"))


@query()
def phi_multilingual_filter_all(spark, sf_dir):
    """F6 over whole documents: each pair of capitalised words is a weak NAME hit (tested against plain Python)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t"))
    weak = F.transform(detect.spans(F.col("t"), NAMES), lambda s: detect.hit(F.lit("NAME"), s["start"], s["end"], s["value"], F.lit(0.4), F.lit("test")))
    rows = docs.select("doc_id", "lang", "t", weak.alias("weak"))
    kept = F.coalesce(F.size(detect.keep_by_language(F.col("t"), F.col("weak"), F.coalesce("lang", F.lit("")))), F.lit(0))
    return rows.select("doc_id", "lang", F.size("weak").cast("long").alias("weak"), kept.cast("long").alias("kept"))


_ADVERSARIAL = f"""SELECT note_id, CASE note_id % 4 WHEN 0 THEN replace(text, 'SSN ', 'SSN' || chr(8203) || ' ') WHEN 1 THEN replace(text, '@', '%40') WHEN 2 THEN replace(text, 'example', 'ex' || chr(1072) || 'mple') ELSE replace(text, '-555-', '-' || chr(65301) || '55-') END AS text FROM ({views.NOTES})"""


@query()
def phi_normalize(spark, sf_dir):
    """Canonical text and the span of the original behind each character (tested against plain Python)."""
    rows = read(spark, sf_dir, "documents").select("doc_id", detect.normalize(F.col("text")).alias("n"))
    return rows.select("doc_id", F.col("n.text").alias("text"), F.size("n.starts").alias("n_chars"), F.aggregate("n.starts", F.lit(0).cast("long"), lambda a, x: a + x).alias("starts"))


@query()
def phi_adversarial_scan(spark, sf_dir):
    """Hits of disguised notes, mapped back to the original text (tested against plain Python)."""
    rows = scan.scan(_dealt(spark, sf_dir, _ADVERSARIAL), "text").select("note_id", F.explode(F.coalesce("hits", detect.no_hits())).alias("h"))
    return rows.select("note_id", F.col("h.phi_type").alias("phi_type"), F.col("h.start").alias("start"), F.col("h.end").alias("stop"), F.col("h.value").alias("value"), F.col("h.source").alias("source"))


@query("SELECT o_orderkey AS note_id, 'SSN' AS phi_type, 6 AS start, 22 AS stop, to_base64(encode(lpad(cast(1 + o_orderkey % 665 AS VARCHAR), 3, '0') || '-45-6789 ')) AS value, 0.95::DOUBLE AS confidence, 'regex+base64' AS source FROM orders")
def phi_base64_scan(spark, sf_dir):
    """base64 tokens that hide an identifier are hits as a whole."""
    plain = F.concat(F.lpad((1 + F.col("o_orderkey") % 665).cast("string"), 3, "0"), F.lit("-45-6789 "))
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note_id"), F.concat(F.lit("token "), F.base64(F.encode(plain, "UTF-8")), F.lit(" end")).alias("text"))
    rows = rows.select("note_id", F.explode(detect.base64_hits(F.col("text"))).alias("h"))
    return rows.select("note_id", F.col("h.phi_type").alias("phi_type"), F.col("h.start").alias("start"), F.col("h.end").alias("stop"), F.col("h.value").alias("value"), F.col("h.confidence").alias("confidence"), F.col("h.source").alias("source"))


@query(f"SELECT phi_type, count(*) AS expected, count(*) FILTER (found) AS found FROM (SELECT t.phi_type, list_contains(h.types, t.phi_type) AS found FROM (SELECT note_id, unnest(['SSN', 'EMAIL', 'PHONE', 'IP_ADDRESS', 'URL', 'DATE', 'MRN', 'NPI', 'DEA', 'ZIP']) AS phi_type FROM ({NOTES})) t JOIN (SELECT note_id, list(phi_type) AS types FROM ({duck.merged(NOTES, 'note_id')}) GROUP BY note_id) h USING (note_id)) GROUP BY phi_type")
def detector_recall(spark, sf_dir):
    """Recall by type over notes in which every type is planted."""
    rows = notes(spark, sf_dir).select(batch.merged_column(F.col("text")).alias("hits"))
    rows = rows.select(F.col("hits.phi_type").alias("types"), F.explode(F.array(*[F.lit(p[0]) for p in fixed.PATTERNS])).alias("phi_type"))
    return rows.groupBy("phi_type").agg(F.count("*").alias("expected"), F.count_if(F.array_contains("types", F.col("phi_type"))).alias("found"))


# --- redaction ------------------------------------------------------------------------------------------


def _redacted(spark, sf_dir, mode, overrides=None):
    t = F.col("text")
    return notes(spark, sf_dir).select("note_id", batch.redacted_column(t, mode, overrides).alias("redacted"))


@query(duck.redacted(NOTES, "note_id", "'[REDACTED:' || phi_type || ']'"))
def redact_replace(spark, sf_dir):
    return _redacted(spark, sf_dir, "REDACT")


@query(duck.redacted(NOTES, "note_id", duck.PSEUDONYM))
def redact_pseudonymize(spark, sf_dir):
    return _redacted(spark, sf_dir, "PSEUDONYMIZE")


@query(duck.redacted(NOTES, "note_id", duck.GENERALIZED))
def redact_generalize(spark, sf_dir):
    return _redacted(spark, sf_dir, "GENERALIZE")


@query(duck.redacted(NOTES, "note_id", "''"))
def redact_suppress(spark, sf_dir):
    return _redacted(spark, sf_dir, "SUPPRESS")


@query(duck.redacted(NOTES, "note_id", f"CASE phi_type WHEN 'EMAIL' THEN {duck.PSEUDONYM} WHEN 'DATE' THEN {duck.GENERALIZED} WHEN 'URL' THEN '' ELSE '[REDACTED:' || phi_type || ']' END"))
def redact_overrides(spark, sf_dir):
    return _redacted(spark, sf_dir, "REDACT", {"EMAIL": "PSEUDONYMIZE", "DATE": "GENERALIZE", "URL": "SUPPRESS"})


@query(duck.redacted(DOCS, "doc_id", "'[REDACTED:' || phi_type || ']'", types=["EMAIL", "PHONE", "IP_ADDRESS"]))
def redact_documents(spark, sf_dir):
    """The whole scan over documents; other types do not occur there."""
    return scan.scan(store.spread(read(spark, sf_dir, "documents").select("doc_id", "text")), "text", encoded=False).select("doc_id", "redacted")


@query(f"SELECT sha256(concat_ws('|', note_id, start, stop, phi_type)) AS tag_id, note_id, phi_type, 'regex' AS source, confidence, '[' || phi_type || ']' AS redacted_value, 'intake' AS origin_agent FROM ({duck.merged(NOTES, 'note_id')})")
def tags(spark, sf_dir):
    """One tag a hit."""
    rows = notes(spark, sf_dir).select("note_id", batch.merged_column(F.col("text")).alias("hits"))
    return scan.tags(rows, "note_id", F.lit("intake"))


_FHIR = """SELECT c_custkey, '{{"resourceType":"Patient","id":"p' || cast(c_custkey AS string) || '","name":"' || c_name || '","birthDate":"1980-01-01","note":"call 617-555-' || lpad(cast(c_custkey % 10000 AS string), 4, '0') || '","active":"yes"}}' AS resource FROM {customer}"""


@query("""SELECT c_custkey, '{"resourceType":"Patient","id":"p' || c_custkey || '","name":"[REDACTED:name]","birthDate":"[REDACTED:birthDate]","note":"call [REDACTED:PHONE]","active":"yes"}' AS redacted FROM customer""")
def fhir_redact(spark, sf_dir):
    """Identifying fields of FHIR resources, and hits in the others."""
    return scan.fhir_redact(_dealt(spark, sf_dir, _FHIR, 1 << 18), "resource").select("c_custkey", "redacted")


_TYPED = """SELECT c_custkey, '{{"resourceType":"Patient","id":"00' || cast(c_custkey AS string) || '","active":true,"weight":' || cast(c_custkey % 90 AS string) || ',"tag":"true","name":[{{"family":"x"}}],"link":{{"mail":"c' || cast(c_custkey AS string) || '@example.com","list":[1,null,"[y"]}}}}' AS resource FROM {customer}"""


@query("""SELECT c_custkey, '{"resourceType":"Patient","id":"00' || c_custkey || '","active":true,"weight":' || (c_custkey % 90) || ',"tag":"true","name":"[REDACTED:name]","link":{"mail":"[REDACTED:EMAIL]","list":[1,null,"[y"]}}' AS redacted FROM customer""")
def fhir_redact_typed(spark, sf_dir):
    """Nested values, numbers, booleans and nulls of a resource keep their types."""
    return scan.fhir_redact(_dealt(spark, sf_dir, _TYPED, 1 << 18), "resource").select("c_custkey", "redacted")


@query("""SELECT c_custkey, '{"active":true,"id":"00' || c_custkey || '","link":{"list":[1,null,"[y"]},"tag":"true","weight":' || (c_custkey % 90) || '}' AS kept FROM customer""")
def minimum_necessary_typed(spark, sf_dir):
    """strings that look like numbers, booleans or lists stay strings; nested paths stay nested."""
    rows = view(spark, sf_dir, _TYPED)
    return rows.select("c_custkey", scan.minimum_necessary(F.col("resource"), ["id", "active", "weight", "tag", "link.list", "link.none", "absent"]).alias("kept"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'call [REDACTED:PHONE] {' WHEN 1 THEN '{\"a\":[REDACTED' ELSE '[\"[REDACTED:EMAIL]\",[[\"[REDACTED:MAX_DEPTH_EXCEEDED]\"]]]' END AS redacted, CASE o_orderkey % 3 WHEN 0 THEN 'PHONE' WHEN 1 THEN '' ELSE 'EMAIL,SCAN_DEPTH_EXCEEDED' END AS types FROM orders")
def scan_json_fallback(spark, sf_dir):
    """Text that is no JSON is scanned as text; what lies too deep is tagged."""
    text = F.when(F.col("o_orderkey") % 3 == 0, "call 617-555-0123 {").when(F.col("o_orderkey") % 3 == 1, '{"a":[REDACTED').otherwise('["a@example.com",[["deep"]]]')
    out = scan.scan_json(read(spark, sf_dir, "orders").select("o_orderkey", text.alias("j")), "j", most=3, found="found")
    return out.select("o_orderkey", "redacted", F.array_join("found.phi_type", ",").alias("types"))


@query("SELECT o_orderkey AS note_id, 'VISIT' AS phi_type, 0 AS start, 15 AS stop FROM orders")
def phi_custom_detector(spark, sf_dir):
    """A detector of one's own beside the patterns; its surer hit takes the date it overlaps."""
    own = ("VISIT", r"Seen [0-9]{4}-[0-9]{2}-[0-9]{2}", 0.99)
    rows = notes(spark, sf_dir).select("note_id", F.explode(batch.merged_column(F.col("text"), (own,))).alias("h"))
    return rows.where("h.phi_type = 'VISIT'").select("note_id", F.col("h.phi_type").alias("phi_type"), F.col("h.start").alias("start"), F.col("h.end").alias("stop"))


@query(f"SELECT note_id, phi_type, start, stop FROM ({duck.merged(NOTES, 'note_id')}) WHERE phi_type <> 'URL' AND NOT (phi_type = 'EMAIL' AND note_id % 2 = 0 AND value LIKE 'c%')")
def phi_custom_filter(spark, sf_dir):
    """Filters of one's own over hits and their text."""
    rows = notes(spark, sf_dir).withColumn("h", batch.merged_column(F.col("text")))
    even = F.col("note_id") % 2 == 0
    kept = detect.keep_where(F.col("text"), F.col("h"), lambda text, h: (h["phi_type"] != "URL") & ~((h["phi_type"] == "EMAIL") & even & F.substring(text, h["start"] + 1, F.lit(1)).isin("c")))
    return rows.select("note_id", F.explode(kept).alias("x")).select("note_id", F.col("x.phi_type").alias("phi_type"), F.col("x.start").alias("start"), F.col("x.end").alias("stop"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '[REDACTED:DICOM_DATASET]' END AS redacted, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'PATIENTNAME' ELSE 'INSTITUTIONNAME,PATIENTNAME' END AS types FROM customer")
def dicom_scan(spark, sf_dir):
    """DICOM files by their identifying elements; a third hold none, a third two."""

    def element(tag: str, kind: str, value):
        padded = F.when(F.length(value) % 2 == 1, F.concat(value, F.lit(" "))).otherwise(value)
        size = F.unhex(F.lpad(F.hex(F.length(padded)), 2, "0"))
        return F.concat(F.unhex(F.lit(tag)), F.encode(F.lit(kind), "UTF-8"), size, F.unhex(F.lit("00")), F.encode(padded, "UTF-8"))

    k, none = F.col("c_custkey"), F.unhex(F.lit(""))
    person = F.when(k % 3 > 0, element("10001000", "PN", F.col("c_name"))).otherwise(none)
    place = F.when(k % 3 == 2, element("08008000", "LO", F.lit("City Clinic"))).otherwise(none)
    file = F.concat(F.unhex(F.repeat(F.lit("00"), 128)), F.encode(F.lit("DICM"), "UTF-8"), element("02001000", "UI", F.lit("1.2.840.10008.1.2.1 ")), element("08006000", "CS", F.lit("CT")), place, person, element("20001300", "IS", F.lit("1")))
    out = dicom.scan_dicom(read(spark, sf_dir, "customer").select("c_custkey", "c_name", file.alias("file")), "file")
    return out.select("c_custkey", "redacted", F.array_join(F.transform("found", lambda h: h["phi_type"]), ",").alias("types"))


def _plain(sql: str) -> str:
    """A view's SQL for DuckDB, where braces in literals are not doubled."""
    return views.duck(sql).replace("{{", "{").replace("}}", "}")


_CALLS = """SELECT 'c' || cast(c_custkey AS string) AS session_id, c_custkey AS ord, 'look "up"' AS tool, '{{"mail":"c' || cast(c_custkey AS string) || '@example.com","n":3}}' AS arguments,
  CASE WHEN c_custkey % 2 = 0 THEN '{{"ok":true,"call":"617-555-0123"}}' END AS result FROM {customer}"""


@query(
    f"""WITH k AS ({_plain(_CALLS)}) SELECT session_id, 'tool_call' AS event_type, sha256(arguments) AS hash, '{{"tool_name":"look \\"up\\"","arguments":{{"mail":"[REDACTED:EMAIL]","n":3}}}}' AS payload, 1 AS n_tags FROM k
    UNION ALL SELECT session_id, 'tool_result', sha256(result), '{{"tool_name":"look \\"up\\"","result":{{"ok":true,"call":"[REDACTED:PHONE]"}}}}', 1 FROM k WHERE result IS NOT NULL"""
)
def tool_events(spark, sf_dir):
    """Tool calls and results as events, with the raw payload's hash, the redacted payload and a tag a hit."""
    out = adapters.tool_events(_dealt(spark, sf_dir, _CALLS, 1 << 18))
    called = F.col("event_type") == "tool_call"
    return out.select("session_id", "event_type", F.when(called, F.col("input_hash")).otherwise(F.col("output_hash")).alias("hash"), F.when(called, F.col("redacted_input")).otherwise(F.col("redacted_output")).alias("payload"), F.size("phi_tags_detected").alias("n_tags"))


_SENT = """SELECT 'c' || cast(conv_id AS string) AS session_id, turn AS ord, role AS sender, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS receiver, '{{"body":"write a' || cast(turn AS string) || '@example.com"}}' AS message, 'k' || cast(conv_id AS string) AS correlation_id FROM {conversations}"""


@query(f"""SELECT session_id, ord, 'inter_agent_message' AS event_type, sender AS agent_id, sha256(message) AS output_hash, '{{"to":' || coalesce('"' || receiver || '"', 'null') || ',"message":{{"body":"write [REDACTED:EMAIL]"}}}}' AS payload, 1 AS n_tags FROM ({_plain(_SENT)})""")
def message_events(spark, sf_dir):
    """I4: messages between agents as events."""
    out = adapters.message_events(view(spark, sf_dir, _SENT))
    return out.select("session_id", "ord", "event_type", "agent_id", "output_hash", F.col("redacted_output").alias("payload"), F.size("phi_tags_detected").alias("n_tags"))


@query(f"""SELECT session_id, ord, 'a2a_message' AS event_type, '' AS output_hash, '{{"to":' || coalesce('"' || receiver || '"', 'null') || ',"message":{{"body":"write [REDACTED:EMAIL]"}},"correlation_id":"' || correlation_id || '"}}' AS payload FROM ({_plain(_SENT)})""")
def a2a_events(spark, sf_dir):
    """Messages of the agent-to-agent protocol, with their correlation id."""
    return adapters.message_events(view(spark, sf_dir, _SENT), "a2a").select("session_id", "ord", "event_type", "output_hash", F.col("redacted_output").alias("payload"))


_HL7 = "SELECT c_custkey, 'MSH|^~&|SYS' || chr(13) || 'PID|1||' || cast(100000 + c_custkey AS string) || '||' || c_name || '||1980|F' || chr(13) || 'PV1|1|I|W||||' || 'DR' || cast(c_custkey % 7 AS string) || chr(13) AS text FROM {customer}"


@query("SELECT c_custkey, unnest(['PID-3', 'PID-5', 'PID-7', 'PID-8', 'PV1-7']) AS ref, unnest([cast(100000 + c_custkey AS VARCHAR), c_name, '1980', 'F', 'DR' || (c_custkey % 7)]) AS value FROM customer")
def hl7_fields(spark, sf_dir):
    """Filled identifying fields of HL7 messages."""
    return view(spark, sf_dir, _HL7).select("c_custkey", F.inline(detect.hl7_fields(F.col("text"))))


@query()
def hl7_redact(spark, sf_dir):
    """Every occurrence of every field value, anywhere in the message (tested on cases)."""
    return scan.scan(view(spark, sf_dir, _HL7), "text", encoded=False).select("c_custkey", "redacted", F.size("hits").alias("n_hits"))


@query()
def scan_nested_json(spark, sf_dir):
    """JSON of any shape, keys included (tested on cases)."""
    body = F.to_json(F.struct(F.col("event_id"), F.col("props"), F.array(F.concat(F.lit("mail u"), F.col("user_id").cast("string"), F.lit("@example.com")), F.lit(None)).alias("list"), F.create_map(F.lit("10.0.0.1"), F.col("value")).alias("by_ip")))
    return scan.scan_json(read(spark, sf_dir, "events").select("event_id", body.alias("payload")), "payload").select("event_id", "redacted")


@query("SELECT o_orderkey, cast(o_orderkey % 2 = 0 AS INT) AS valid, CASE WHEN o_orderkey % 2 = 0 THEN 'mail [REDACTED:EMAIL]' ELSE NULL END AS out_text FROM orders")
def scan_bytes(spark, sf_dir):
    """UTF-8 bytes are scanned, other bytes pass."""
    text = F.encode(F.concat(F.lit("mail c"), F.col("o_custkey").cast("string"), F.lit("@example.com")), "UTF-8")
    raw = F.when(F.col("o_orderkey") % 2 == 0, text).otherwise(F.unhex(F.lit("FFFE00")))
    out = scan.scan_bytes(raw)
    ok = F.is_valid_utf8(out.cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", ok.cast("int").alias("valid"), F.when(ok, F.decode(out, "UTF-8")).alias("out_text"))


@query("SELECT o_orderkey, '[REDACTED:EMAIL]=v;[REDACTED:EMAIL]_=[REDACTED:PHONE];k=w' AS entries FROM orders")
def scan_map_keys(spark, sf_dir):
    """Keys are scanned; keys that clash get underscores."""
    key = F.col("o_custkey").cast("string")
    m = F.map_from_arrays(F.array(F.concat(F.lit("a"), key, F.lit("@example.com")), F.concat(F.lit("b"), key, F.lit("@example.com")), F.lit("k")), F.array(F.lit("v"), F.lit("617-555-0123"), F.lit("w")))
    entries = F.transform(F.map_entries(scan.scan_map(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(entries, ";").alias("entries"))


@query("SELECT o_orderkey, 'call [REDACTED:PHONE]|nothing|[REDACTED:EMAIL]' AS elements FROM orders")
def scan_array(spark, sf_dir):
    """Arrays keep their shape."""
    values = F.array(F.concat(F.lit("call 617-555-"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0")), F.lit("nothing"), F.lit("c@example.com"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(scan.scan_array(values), "|").alias("elements"))


@query("""SELECT c_custkey, '{"id":"p' || c_custkey || '","name":"' || c_name || '"}' AS kept FROM customer""")
def minimum_necessary(spark, sf_dir):
    """only the listed paths."""
    return view(spark, sf_dir, _FHIR).select("c_custkey", scan.minimum_necessary(F.col("resource"), ["id", ".name", "absent.path"]).alias("kept"))


# --- propagation ----------------------------------------------------------------------------------------

_EDGES = "SELECT conv_id AS tag_id, turn AS ord, role AS src, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM {conversations}"


@query(f"SELECT tag_id, ord, src, dst FROM ({views.duck(_EDGES)}) WHERE dst IS NOT NULL AND tag_id % 3 <> 0")
def propagation_edges(spark, sf_dir):
    """Edges of registered tags only."""
    edges = view(spark, sf_dir, _EDGES).where("dst is not null")
    known = read(spark, sf_dir, "conversations").where("conv_id % 3 <> 0").select(F.col("conv_id").alias("tag_id"))
    return propagation.known_edges(edges, known).select("tag_id", "ord", "src", "dst")


@query(
    "WITH RECURSIVE e AS (SELECT conv_id AS tag_id, role AS src, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS dst, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations), "
    "k AS (SELECT * FROM e WHERE dst IS NOT NULL), p AS (SELECT tag_id, 0::BIGINT AS i, ['system'] AS path FROM (SELECT DISTINCT tag_id FROM e) UNION ALL "
    "SELECT p.tag_id, k.i, CASE WHEN p.path[-1] = k.src THEN p.path ELSE list_append(p.path, k.src) END || [k.dst] FROM p JOIN k ON k.tag_id = p.tag_id AND k.i = p.i + 1) "
    "SELECT tag_id, array_to_string(arg_max(path, i), '>') AS path, max(i) AS hops FROM p GROUP BY tag_id"
)
def propagation_paths(spark, sf_dir):
    """The path of each tag from its origin."""
    edges = view(spark, sf_dir, _EDGES)
    known = edges.select("tag_id", F.lit("system").alias("origin_agent"))
    out = propagation.paths(edges.where("dst is not null"), known)
    return out.select("tag_id", F.array_join("path", ">").alias("path"), F.col("hops").cast("long").alias("hops"))


@query("SELECT conv_id AS tag_id, arg_max(role, turn) AS origin_agent, max(turn) AS turn FROM conversations GROUP BY conv_id")
def propagation_register(spark, sf_dir):
    """The last registration of each tag holds."""
    tags = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tag_id"), F.col("role").alias("origin_agent"), "turn")
    return propagation.register(tags, "turn")


@query(f"SELECT DISTINCT src, dst FROM ({views.duck(_EDGES)}) WHERE dst IS NOT NULL")
def propagation_view(spark, sf_dir):
    """Distinct edges between agents."""
    rows = view(spark, sf_dir, _EDGES).select(F.lit("inter_agent_message").alias("event_type"), F.col("src").alias("agent_id"), F.col("dst").alias("target"))
    return report.propagation_view(rows)


# --- signals --------------------------------------------------------------------------------------------

_SELF = "list_filter(list_transform(list_concat(regexp_extract_all(reasoning, '(?i)confidence[:\\s]+(\\d{1,3})\\s*%', 1), regexp_extract_all(reasoning, '(?i)(\\d{1,3})\\s*%\\s*confiden', 1)), lambda x: cast(x AS DOUBLE)), lambda x: x <= 100)"
_ICD = "regexp_extract_all(output, '" + fixed.ICD_PATTERN + "', 1)"
_DRUG = "regexp_extract_all(output, '" + fixed.DRUG_PATTERN + "', 1)"
_S1 = f"CASE WHEN len({_SELF}) > 0 THEN round(list_sum(list_transform({_SELF}, lambda x: x / 100)) / len({_SELF}), 9) ELSE -1.0 END"
_S2 = f"CASE WHEN len({_ICD}) > 0 THEN len(list_filter({_ICD}, lambda t: lower(t) IN ('e11.9', 'i10'))) / len({_ICD}) ELSE -1.0 END"
_S3 = f"CASE WHEN len({_DRUG}) > 0 THEN len(list_filter({_DRUG}, lambda t: lower(t) IN ('amoxicillin', 'lisinopril', 'metformin'))) / len({_DRUG}) ELSE -1.0 END"
_S4 = "CASE WHEN provided = 0 THEN 0.0 WHEN provided = 1 THEN 0.5 ELSE 1.0 END"
REASONS = views.duck(views.REASONS)


def _signals(spark, sf_dir):
    provided = F.slice(F.array(F.lit("dose"), F.lit("route")), 1, F.col("provided").cast("int"))
    return view(spark, sf_dir, views.REASONS).select(
        "event_id",
        F.round(signals.self_reported(F.col("reasoning")), 9).alias("self_reported"),
        signals.grounding(F.col("output"), CODES).alias("grounding"),
        signals.hallucination(F.col("output"), DRUGS).alias("hallucination"),
        signals.completeness(provided, F.array(F.lit("dose"), F.lit("route"), F.lit("dose"))).alias("completeness"),
    )


@query(f"SELECT event_id, {_S1} AS self_reported, {_S2} AS grounding, {_S3} AS hallucination, {_S4}::DOUBLE AS completeness FROM ({REASONS})")
def confidence_signals(spark, sf_dir):
    """C1-C5."""
    return _signals(spark, sf_dir)


@query(f"SELECT event_id, {_S2} AS grounding, {_S3} AS hallucination FROM ({REASONS})")
def grounding_by_join(spark, sf_dir):
    """C2, C3, C5 against vocabularies that are tables."""
    rows = view(spark, sf_dir, views.REASONS).select("event_id", "output")
    for name, pattern, words in (("grounding", fixed.ICD_PATTERN, CODES), ("hallucination", fixed.DRUG_PATTERN, DRUGS)):
        rows = grounding.vocabulary_share(rows, "event_id", "output", pattern, spark.createDataFrame([(w.upper(),) for w in words], "term string"), name)
    return rows.select("event_id", "grounding", "hallucination")


@query(
    f"SELECT event_id, round(CASE WHEN w = 0 THEN 0.7 ELSE t / w END, 9) AS score FROM (SELECT event_id, "
    "(CASE WHEN a >= 0 THEN a * 0.25 ELSE 0 END) + (CASE WHEN b >= 0 THEN b * 0.3 ELSE 0 END) + (CASE WHEN c >= 0 THEN c * 0.3 ELSE 0 END) + (CASE WHEN d >= 0 THEN d * 0.15 ELSE 0 END) AS t, "
    "(CASE WHEN a >= 0 THEN 0.25::DOUBLE ELSE 0 END) + (CASE WHEN b >= 0 THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN c >= 0 THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN d >= 0 THEN 0.15::DOUBLE ELSE 0 END) AS w "
    f"FROM (SELECT event_id, ({_S1})::DOUBLE AS a, ({_S2})::DOUBLE AS b, ({_S3})::DOUBLE AS c, ({_S4})::DOUBLE AS d FROM ({REASONS})))"
)
def confidence_composite(spark, sf_dir):
    """C6."""
    s = _signals(spark, sf_dir)
    return s.select("event_id", F.round(signals.composite({c: F.col(c) for c in fixed.SIGNAL_WEIGHTS}), 9).alias("score"))


@query(
    "SELECT a.vec_id, round(coalesce(avg(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), -1.0), 6) AS consistency "
    "FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings) a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings) b ON a.label = b.label AND b.i BETWEEN a.i - 8 AND a.i - 1 GROUP BY a.vec_id"
)
def signal_history_cosine(spark, sf_dir):
    """Mean cosine to the eight vectors before."""
    w = Window.partitionBy("label").orderBy("vec_id").rowsBetween(-8, -1)
    rows = read(spark, sf_dir, "embeddings").withColumn("before", F.collect_list("embedding").over(w))
    total = F.aggregate("before", F.lit(0.0), lambda a, v: a + signals.cosine(F.col("embedding"), v))
    return rows.select("vec_id", F.round(F.when(F.size("before") > 0, total / F.size("before")).otherwise(F.lit(-1.0)), 6).alias("consistency"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1.0 ELSE round(greatest(0, least(1, pow(exp(-value / 100), 1.5))), 9) END AS calibrated FROM events")
def signal_uncertainty(spark, sf_dir):
    """C9."""
    p = F.when(F.col("event_id") % 5 != 0, -F.col("value") / 100)
    return read(spark, sf_dir, "events").select("event_id", F.round(signals.uncertainty(p), 9).alias("calibrated"))


@query("SELECT doc_id, ((len(text) > 100)::INT + contains(text, 'the')::INT + (NOT contains(text, '|'))::INT) / 3 AS adherence, concat_ws(',', CASE WHEN len(text) <= 100 THEN 'long' END, CASE WHEN NOT contains(text, 'the') THEN 'article' END, CASE WHEN contains(text, '|') THEN 'no_pipes' END) AS violations FROM documents")
def signal_guideline(spark, sf_dir):
    """C10."""
    t = F.col("text")
    share, broken = signals.guideline_adherence({"long": F.length(t) > 100, "article": F.contains(t, F.lit("the")), "no_pipes": ~F.contains(t, F.lit("|"))})
    return read(spark, sf_dir, "documents").select("doc_id", share.alias("adherence"), F.array_join(broken, ",").alias("violations"))


@query("SELECT event_id, round(1 - 1 / (1 + exp(-(0.2 + 0.01 * value - 0.3 * (event_id % 3)))), 9) AS trust FROM events")
def signal_override(spark, sf_dir):
    """C11."""
    z = signals.override_prediction({"value": F.col("value"), "kind": (F.col("event_id") % 3).cast("double")}, {"value": 0.01, "kind": -0.3}, 0.2)
    return read(spark, sf_dir, "events").select("event_id", F.round(z, 9).alias("trust"))


CALIBRATION = views.duck(views.CALIBRATION)


@query(
    f"WITH s AS ({CALIBRATION}), g AS (SELECT round(0.05 * i, 2) AS t FROM range(2, 19) r(i)), c AS (SELECT t, count(*) FILTER (confidence >= t AND correct) AS tp, count(*) FILTER (confidence >= t) AS said, count(*) FILTER (correct) AS pos FROM s, g GROUP BY t), "
    "f AS (SELECT t, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS p, CASE WHEN pos > 0 THEN tp / pos ELSE 0 END AS r FROM c), k AS (SELECT t, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM f) "
    "SELECT t::DOUBLE AS threshold, round(f1, 9) AS f1, round(p, 9) AS precision, round(r, 9) AS recall FROM k ORDER BY f1 DESC, t LIMIT 1"
)
def calibrate_threshold(spark, sf_dir):
    """C12."""
    best = calibrate.calibrate_threshold(view(spark, sf_dir, views.CALIBRATION), "confidence", "correct")
    return best.select("threshold", *[F.round(c, 9).alias(c) for c in ("f1", "precision", "recall")])


_TEMPER = "1 / (1 + exp(-ln(greatest(1e-15, least(1 - 1e-15, confidence)) / (1 - greatest(1e-15, least(1 - 1e-15, confidence)))) / {t}))"


@query(f"SELECT doc_id, round({_TEMPER.format(t=1.5)}, 9) AS tempered FROM ({CALIBRATION})")
def temperature_transform(spark, sf_dir):
    """C13."""
    return view(spark, sf_dir, views.CALIBRATION).select("doc_id", F.round(signals.temper(F.col("confidence"), 1.5), 9).alias("tempered"))


@query(" UNION ALL ".join(f"SELECT {t}::DOUBLE AS temperature, round(avg(-ln(greatest(CASE WHEN correct THEN s ELSE 1 - s END, 1e-15))), 6) AS nll FROM (SELECT correct, {_TEMPER.format(t=t)} AS s FROM ({CALIBRATION}))" for t in (0.5, 1.0, 2.0, 5.0)))
def temperature_nll_grid(spark, sf_dir):
    """C14."""
    rows = view(spark, sf_dir, views.CALIBRATION)
    out = None
    for t in (0.5, 1.0, 2.0, 5.0):
        one = calibrate.nll(rows, "confidence", "correct", t).select(F.lit(t).alias("temperature"), F.round("nll", 6).alias("nll"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def temperature_fit(spark, sf_dir):
    """C15 (tested against a fine grid)."""
    t = calibrate.fit_temperature(view(spark, sf_dir, views.CALIBRATION), "confidence", "correct")
    return spark.createDataFrame([(round(t, 4),)], "temperature double")


# --- routing --------------------------------------------------------------------------------------------

_ROUTE = "SELECT event_id, 'act' || cast(event_id % 4 AS string) AS action_name, event_id % 101 / 100.0 AS score0, cast(event_id % 101 AS double) / 100 AS score FROM {events}"
_TIER = "CASE event_id % 4 WHEN 0 THEN 'informational' WHEN 1 THEN 'advisory' WHEN 2 THEN 'interventional' ELSE 'advisory' END"


def _decided(spark, sf_dir):
    actions = spark.createDataFrame([("act0", "informational"), ("act1", "advisory"), ("act2", "interventional")], "name string, tier string")
    return routing.decide(view(spark, sf_dir, _ROUTE).select("event_id", "action_name", "score"), actions, "action_name", "score", unregistered="escalate")


_DECIDED = (
    f"SELECT event_id, action_name, score, tier, CASE WHEN m THEN 'escalate' WHEN tier = 'interventional' THEN 'block' WHEN below THEN 'escalate' ELSE 'proceed' END AS action_taken, "
    "CASE WHEN m THEN 'Action ''' || action_name || ''' is not registered; unregistered actions escalate by default' WHEN tier = 'interventional' THEN 'Interventional action requires explicit human authorization' "
    "WHEN below THEN 'Confidence ' || printf('%.2f', score) || ' below ' || tier || ' threshold ' || printf('%.2f', lim) WHEN tier = 'advisory' THEN 'AI-generated recommendation, confidence: ' || printf('%.2f', score) ELSE '' END AS reason, "
    "CASE WHEN m THEN 'clinician_alert' WHEN tier = 'interventional' THEN 'block_with_error' WHEN below THEN CASE tier WHEN 'informational' THEN 'human_review_queue' ELSE 'clinician_alert' END WHEN tier = 'advisory' THEN 'proceed_with_annotation' ELSE 'proceed' END AS channel, "
    "CASE WHEN m OR tier = 'interventional' THEN 'attending_physician' WHEN below THEN CASE tier WHEN 'informational' THEN 'clinical_reviewer' ELSE 'attending_physician' END WHEN tier = 'advisory' THEN 'attending_physician' ELSE '' END AS reviewer_role "
    f"FROM (SELECT *, event_id % 4 = 3 AS m, score < lim AS below FROM (SELECT *, CASE tier WHEN 'informational' THEN 0.6::DOUBLE WHEN 'advisory' THEN 0.8::DOUBLE ELSE 1.01::DOUBLE END AS lim FROM (SELECT event_id, action_name, score, {_TIER} AS tier FROM ({views.duck(_ROUTE)}))))"
)


@query(_DECIDED)
def route_decisions(spark, sf_dir):
    """E1-E5."""
    return _decided(spark, sf_dir)


@query(f"SELECT tier, action_taken, channel, count(*) AS n FROM ({_DECIDED}) GROUP BY ALL")
def route_summary(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy("tier", "action_taken", "channel").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, channel FROM ({_DECIDED}) WHERE channel IN ('human_review_queue', 'clinician_alert', 'block_with_error')")
def route_dispatch(spark, sf_dir):
    """Decisions handed to a handler a channel, here one table each."""
    where = f"{sessions.shared_dir(spark)}/dispatch-{__import__('uuid').uuid4().hex}"
    save = lambda channel: lambda rows: rows.select("event_id", "channel").write.mode("append").parquet(f"{where}/{channel}")
    names = ("human_review_queue", "clinician_alert", "block_with_error")
    routing.dispatch(_decided(spark, sf_dir), {n: save(n) for n in names})
    return spark.read.schema("event_id long, channel string").parquet(*[f"{where}/{n}" for n in names])


@query(f"SELECT 's' || (event_id % 9) AS session_id, CASE action_taken WHEN 'proceed' THEN 'agent_llm_response' ELSE 'escalation_triggered' END AS event_type, action_name AS agent_id, tier AS risk_tier FROM ({_DECIDED})")
def route_events(spark, sf_dir):
    """Decisions as audit events."""
    rows = _decided(spark, sf_dir).withColumn("session", F.concat(F.lit("s"), (F.col("event_id") % 9).cast("string")))
    return routing.decision_events(rows, "session", "action_name")


# --- chain ----------------------------------------------------------------------------------------------


def _chain(spark, sf_dir):
    return chain.emit(view(spark, sf_dir, views.AUDIT), KEY)


_CHAIN = duck.chain(AUDIT, KEY)


@query(f"{_CHAIN} SELECT session_id, sequence_number, event_id, prev_event_hash, event_hash, signature FROM chain")
def chain_emit(spark, sf_dir):
    """A1-A4: numbers, links, hashes and signatures."""
    return _chain(spark, sf_dir).select("session_id", "sequence_number", "event_id", "prev_event_hash", "event_hash", "signature")


@query(f"SELECT conv_id, turn, {duck.hmac('text', KEY)} AS mac, sha256(text) AS payload_hash FROM conversations")
def chain_hmac(spark, sf_dir):
    """A3, A8."""
    from caduspark.functions.hashing import hmac_sha256, payload_hash

    return read(spark, sf_dir, "conversations").select("conv_id", "turn", hmac_sha256(F.col("text"), KEY).alias("mac"), payload_hash(F.col("text")).alias("payload_hash"))


@query(f"{_CHAIN}{duck.verify('chain', KEY)} SELECT session_id, ok, error FROM verified")
def chain_verify(spark, sf_dir):
    """All sessions in one job."""
    return chain.verify(_chain(spark, sf_dir), KEY)


def _tampered(df: DataFrame) -> DataFrame:
    n = F.regexp_extract("session_id", "[0-9]+", 0).cast("long")
    df = df.where(~((n % 7 == 1) & (F.col("sequence_number") == 2)))
    df = df.withColumn("agent_id", F.when((n % 7 == 2) & (F.col("sequence_number") == 2), "mallory").otherwise(F.col("agent_id")))
    return df.withColumn("signature", F.when((n % 7 == 3) & (F.col("sequence_number") == 1), "00").otherwise(F.col("signature")))


_BAD = (
    ", bad AS (SELECT * REPLACE (CASE WHEN n % 7 = 2 AND sequence_number = 2 THEN 'mallory' ELSE agent_id END AS agent_id, CASE WHEN n % 7 = 3 AND sequence_number = 1 THEN '00' ELSE signature END AS signature) "
    "FROM (SELECT *, cast(regexp_extract(session_id, '[0-9]+') AS BIGINT) AS n FROM chain) WHERE NOT (n % 7 = 1 AND sequence_number = 2))"
)


@query(f"{_CHAIN}{_BAD}{duck.verify('bad', KEY)} SELECT session_id, ok, error FROM verified")
def chain_verify_tampered(spark, sf_dir):
    """A5 on deleted, edited and badly signed events."""
    return chain.verify(_tampered(_chain(spark, sf_dir)), KEY)


@query(
    f"{_CHAIN}, cut AS (SELECT c.* FROM chain c JOIN (SELECT session_id, max(sequence_number) AS z, cast(regexp_extract(session_id, '[0-9]+') AS BIGINT) AS n FROM chain GROUP BY session_id) m USING (session_id) WHERE NOT (m.n % 5 = 0 AND c.sequence_number = m.z))"
    f"{duck.verify('cut', KEY)} SELECT h.session_id, coalesce(v.error, CASE WHEN h.n <> v.n THEN 'chain truncated: backend holds ' || v.n || ' events, ' || h.n || ' were emitted' END) IS NULL AS ok, "
    "coalesce(v.error, CASE WHEN h.n <> v.n THEN 'chain truncated: backend holds ' || v.n || ' events, ' || h.n || ' were emitted' END) AS error FROM (SELECT session_id, count(*) AS n FROM chain GROUP BY session_id) h JOIN verified v USING (session_id)"
)
def chain_heads(spark, sf_dir):
    """A cut-off tail shows against the recorded heads."""
    full = _chain(spark, sf_dir)
    last = F.max("sequence_number").over(Window.partitionBy("session_id"))
    cut = full.withColumn("z", last).where(~((F.regexp_extract("session_id", "[0-9]+", 0).cast("long") % 5 == 0) & (F.col("sequence_number") == F.col("z")))).drop("z")
    return chain.verify(cut, KEY, chain.heads(full))


@query(f"{_CHAIN}{duck.verify('chain', KEY)} SELECT session_id, ok, error FROM verified WHERE session_id = (SELECT max(session_id) FROM chain)")
def chain_health(spark, sf_dir):
    """The last session in order."""
    rows = _chain(spark, sf_dir)
    last = rows.agg(F.max("session_id").alias("session_id"))
    return chain.verify(rows.join(F.broadcast(last), "session_id", "left_semi"), KEY)


# --- rules and reports ----------------------------------------------------------------------------------


def _all(spark, sf_dir):
    return view(spark, sf_dir, views.ALL)


_RULED = f"""
WITH ev AS ({ALL}), st AS (SELECT *, sequence_number - lag(sequence_number) OVER (PARTITION BY session_id ORDER BY sequence_number) AS step,
  max(CASE WHEN event_type = 'phi_redacted' THEN sequence_number END) OVER (PARTITION BY session_id) AS lr, max(CASE WHEN event_type = 'human_review_response' THEN sequence_number END) OVER (PARTITION BY session_id) AS lh FROM ev),
ag AS (SELECT session_id, count(*) AS n, count(*) FILTER (step <> 1) AS gaps, count(*) FILTER (agent_id IS NULL OR agent_id IN ('', 'unknown')) AS noagent,
  count(*) FILTER (event_type = 'phi_detected') AS det, count(*) FILTER (event_type = 'phi_detected' AND sequence_number >= coalesce(lr, -1)) AS unred,
  count(*) FILTER (event_type = 'escalation_triggered' AND risk_tier = 'advisory') AS adv, count(*) FILTER (event_type = 'escalation_triggered' AND risk_tier = 'advisory' AND sequence_number >= coalesce(lh, -1)) AS unrev,
  count(*) FILTER (event_type = 'tool_call' AND risk_tier = 'interventional') AS calls, count(*) FILTER (event_type = 'escalation_triggered') AS esc,
  count(*) FILTER (event_type = 'session_start') AS st, count(*) FILTER (event_type = 'session_end') AS en FROM st GROUP BY session_id),
rs AS (SELECT session_id, unnest([
  {{id: 'EU-AI-ACT-Art-9-2', fw: 'eu_ai_act', sev: 'blocker', ok: n >= 1, why: 'event_count=' || n || ' vs threshold=1'}},
  {{id: 'EU-AI-ACT-Art-12-1', fw: 'eu_ai_act', sev: 'blocker', ok: gaps = 0, why: CASE WHEN gaps = 0 THEN 'sequence intact (' || n || ' events)' ELSE 'sequence gap' END}},
  {{id: 'EU-AI-ACT-Art-14-1', fw: 'eu_ai_act', sev: 'warning', ok: unrev = 0, why: CASE WHEN adv = 0 THEN 'no advisory escalations' WHEN unrev > 0 THEN unrev || ' advisory escalation(s) without review' ELSE 'all advisory escalations reviewed' END}},
  {{id: 'FDA-TPLC-III-B-1', fw: 'fda_tplc', sev: 'blocker', ok: n >= 1, why: 'event_count=' || n || ' vs threshold=1'}},
  {{id: 'FDA-TPLC-III-B-2', fw: 'fda_tplc', sev: 'warning', ok: st > 0 AND en > 0, why: CASE WHEN st > 0 AND en > 0 THEN 'session bounded' ELSE 'missing ' || concat_ws(', ', CASE WHEN st = 0 THEN 'SESSION_START' END, CASE WHEN en = 0 THEN 'SESSION_END' END) END}},
  {{id: 'FDA-TPLC-III-B-3', fw: 'fda_tplc', sev: 'blocker', ok: gaps = 0, why: CASE WHEN gaps = 0 THEN 'sequence intact (' || n || ' events)' ELSE 'sequence gap' END}},
  {{id: 'HIPAA-164.312-a-1', fw: 'hipaa', sev: 'blocker', ok: noagent = 0, why: CASE WHEN noagent = 0 THEN 'all events have agent_id' ELSE noagent || ' event(s) missing agent_id' END}},
  {{id: 'HIPAA-164.312-b', fw: 'hipaa', sev: 'blocker', ok: n >= 1, why: 'event_count=' || n || ' vs threshold=1'}},
  {{id: 'HIPAA-164.312-c-1', fw: 'hipaa', sev: 'blocker', ok: false, why: n || ' event(s) missing signature'}},
  {{id: 'HIPAA-164.312-e-2', fw: 'hipaa', sev: 'blocker', ok: false, why: 'secret_key not provided'}},
  {{id: 'HIPAA-164.502-b', fw: 'hipaa', sev: 'blocker', ok: unred = 0, why: CASE WHEN det = 0 THEN 'no PHI detected' WHEN unred > 0 THEN unred || ' PHI detection(s) without redaction' ELSE 'every PHI detection has matching redaction' END}},
  {{id: 'IEC-62304-5.1', fw: 'iec62304', sev: 'blocker', ok: noagent = 0, why: CASE WHEN noagent = 0 THEN 'all events have agent_id' ELSE noagent || ' event(s) missing agent_id' END}},
  {{id: 'IEC-62304-8', fw: 'iec62304', sev: 'blocker', ok: false, why: 'secret_key not provided'}},
  {{id: 'IEC-62304-9', fw: 'iec62304', sev: 'blocker', ok: calls = 0 OR esc > 0, why: CASE WHEN calls = 0 THEN 'no interventional tool calls' WHEN esc = 0 THEN calls || ' interventional call(s) without escalation' ELSE 'interventional calls escalated' END}}
], recursive := true) FROM ag)
"""


@query(_RULED + " SELECT session_id, id AS rule_id, fw AS framework, sev AS severity, ok AS satisfied, why AS reason FROM rs")
def rule_results(spark, sf_dir):
    """Every bundled rule for every session, from one aggregate."""
    return rules.evaluate(_all(spark, sf_dir)).select("session_id", "rule_id", "framework", "severity", "satisfied", "reason")


@query(_RULED + " SELECT session_id, count(*) AS rules_evaluated, count(*) FILTER (ok) AS rules_satisfied, count(*) FILTER (NOT ok AND sev = 'blocker') AS rules_failed_blocker FROM rs GROUP BY session_id")
def rule_summary(spark, sf_dir):
    """G9."""
    return report.rule_summary(rules.evaluate(_all(spark, sf_dir)))


@query(_RULED + " SELECT fw AS framework, count(*) FILTER (ok) AS passed, count(*) AS total, count(*) FILTER (NOT ok AND sev = 'blocker') AS failed_blockers FROM rs GROUP BY fw")
def rule_by_framework(spark, sf_dir):
    """G13."""
    return report.by_framework(rules.evaluate(_all(spark, sf_dir)))


@query(f"{_CHAIN}{_BAD}{duck.verify('bad', KEY)} SELECT session_id, 'X1' AS rule_id, ok AS satisfied, coalesce(error, 'chain verified') AS reason FROM verified UNION ALL SELECT session_id, 'X2', n <> 5, 'event_count=' || n || ' vs threshold=5' FROM verified UNION ALL SELECT session_id, 'X3', false, 'unknown predicate: ''nonsense''' FROM verified UNION ALL SELECT session_id, 'X4', true, 'iec62304 metadata captured' FROM verified")
def rule_chain_verifies(spark, sf_dir):
    """Rules of one's own, with a known secret."""
    events = _tampered(_chain(spark, sf_dir))
    mine = [rules.Rule("X1", "", "chain_verifies"), rules.Rule("X2", "", "event_count != 5"), rules.Rule("X3", "", "nonsense"), rules.Rule("X4", "", "iec62304_traceability_present")]
    return rules.evaluate(events, mine, chain.verify(events, KEY), traced=True).select("session_id", "rule_id", "satisfied", "reason")


@query(
    f"WITH ev AS ({ALL}), w AS (SELECT *, coalesce(max(CASE WHEN event_type = 'phi_redacted' THEN sequence_number END) OVER (PARTITION BY session_id), -1) AS lr FROM ev), b AS (SELECT *, event_type = 'phi_detected' AND sequence_number >= lr AS bad FROM w), "
    "s AS (SELECT *, bool_or(bad) OVER (PARTITION BY session_id) AS anybad FROM b) SELECT session_id, event_id FROM s WHERE (anybad AND bad) OR (NOT anybad AND event_type IN ('phi_detected', 'phi_redacted') AND session_id IN (SELECT session_id FROM ev WHERE event_type = 'phi_detected' OR event_type = 'phi_redacted'))"
)
def rule_evidence(spark, sf_dir):
    """V5's evidence as rows."""
    return rules.evidence(_all(spark, sf_dir), "phi_redacted_when_detected")


_ENDED = f"SELECT session_id, event_id, sequence_number, risk_tier, CASE WHEN sequence_number = max(sequence_number) OVER (PARTITION BY session_id) AND sequence_number % 2 = 0 THEN 'session_end' ELSE event_type END AS event_type FROM ({views.AUDIT})"


@query(
    f"WITH e AS ({views.duck(_ENDED)}), f AS (SELECT session_id, min(CASE WHEN event_type = 'session_start' THEN sequence_number END) AS a, min(CASE WHEN event_type = 'session_end' THEN sequence_number END) AS b FROM e GROUP BY session_id) "
    "SELECT session_id, event_id FROM e JOIN f USING (session_id) WHERE a IS NOT NULL AND b IS NOT NULL AND ((event_type = 'session_start' AND sequence_number = a) OR (event_type = 'session_end' AND sequence_number = b))"
)
def rule_evidence_bounds(spark, sf_dir):
    """V7's evidence: the first start and the first end, where a session has both."""
    return rules.evidence(view(spark, sf_dir, _ENDED), "session_has_start_and_end")


_YAML = """
name: house
rules:
  - {id: H1, predicate: "event_count >= 3", severity: warning}
  - {id: H2, predicate: "every_event.has(input_hash)"}
"""


@query(
    f"WITH ev AS ({ALL}), g AS (SELECT session_id, count(*) AS n FROM ev GROUP BY session_id) SELECT session_id, 'H1' AS rule_id, 'house' AS framework, 'warning' AS severity, n >= 3 AS satisfied, 'event_count=' || n || ' vs threshold=3' AS reason FROM g "
    "UNION ALL SELECT session_id, 'H2', 'house', 'info', true, 'all events have input_hash' FROM g"
)
def rules_from_yaml(spark, sf_dir):
    """Rules read from YAML."""
    return rules.evaluate(_all(spark, sf_dir), rules.load_rules(_YAML)).select("session_id", "rule_id", "framework", "severity", "satisfied", "reason")


_SUMMARY = f"""
WITH ev AS ({ALL}), st AS (SELECT *, sequence_number - lag(sequence_number) OVER (PARTITION BY session_id ORDER BY sequence_number) AS step FROM ev),
g AS (SELECT session_id, (arg_max(ts_us, sequence_number) - arg_min(ts_us, sequence_number)) / 1e6 AS duration_seconds, count(*) AS total_events, count(confidence_score) AS n_confidences, round(avg(confidence_score), 9) AS mean_confidence,
 coalesce(array_to_string(list_sort(list(DISTINCT agent_id) FILTER (agent_id NOT IN ('', 'unknown'))), ','), '') AS agents_involved, count(*) FILTER (step <> 1) AS gaps, count(*) FILTER (event_type = 'module_error') AS errs,
 count(*) FILTER (event_type = 'escalation_triggered' AND risk_tier = 'interventional') AS ie, count(*) FILTER (risk_tier = 'interventional') AS iv FROM st GROUP BY session_id)
"""


@query(_SUMMARY + " SELECT session_id, duration_seconds, total_events, n_confidences, mean_confidence, agents_involved, gaps, errs + (gaps > 0)::INT AS n_anomalies, ie > 0 OR iv = 0 AS interventional_blocked_when_required FROM g")
def session_report(spark, sf_dir):
    """G1-G8, G12."""
    return report.summary(_all(spark, sf_dir)).select(
        "session_id", "duration_seconds", "total_events", "n_confidences", F.round("mean_confidence", 9).alias("mean_confidence"), "agents_involved", "gaps", "n_anomalies", "interventional_blocked_when_required"
    )


@query(
    f"SELECT session_id, total_events, gaps, rules_evaluated, rules_satisfied, rules_failed_blocker FROM ({_SUMMARY} SELECT session_id, total_events, gaps FROM g) JOIN "
    f"({_RULED} SELECT session_id, count(*) AS rules_evaluated, count(*) FILTER (ok) AS rules_satisfied, count(*) FILTER (NOT ok AND sev = 'blocker') AS rules_failed_blocker FROM rs GROUP BY session_id) USING (session_id)"
)
def session_report_full(spark, sf_dir):
    """The whole report, a row a session."""
    return report.build(_all(spark, sf_dir)).select("session_id", "total_events", "gaps", "rules_evaluated", "rules_satisfied", "rules_failed_blocker")


@query(_SUMMARY + " SELECT session_id, concat_ws(' | ', CASE WHEN mean_confidence < 0.7 THEN 'Mean session confidence below 0.70 — review prompt design and grounding sources.' END, CASE WHEN errs > 0 OR gaps > 0 THEN 'Investigate flagged anomalies before next deployment.' END) AS recommendations FROM g")
def session_recommendations(spark, sf_dir):
    """G10."""
    return report.summary(_all(spark, sf_dir)).select("session_id", "recommendations")


@query(f"SELECT session_id, event_type, count(*) AS n FROM ({ALL}) GROUP BY ALL")
def session_type_counts(spark, sf_dir):
    """G2."""
    return report.type_counts(_all(spark, sf_dir))


@query(f"SELECT session_id, sequence_number, event_id, agent_id, risk_tier, confidence_score, ts_us FROM ({ALL}) WHERE event_type = 'tool_call'")
def session_actions(spark, sf_dir):
    """Actions taken."""
    return report.listed(_all(spark, sf_dir), "tool_call")


@query(f"SELECT session_id, count(*) AS events FROM ({ALL}) GROUP BY session_id ORDER BY session_id LIMIT 50")
def session_overview(spark, sf_dir):
    """A page of fifty sessions."""
    return report.session_overview(_all(spark, sf_dir))


@query(f"SELECT phi_type, (note_id % 20)::BIGINT AS session_id, count(*) AS n FROM ({duck.merged(NOTES, 'note_id')}) GROUP BY ALL")
def report_phi_summary(spark, sf_dir):
    """G4."""
    rows = scan.tags(notes(spark, sf_dir).select("note_id", batch.merged_column(F.col("text")).alias("hits")), "note_id", F.lit("a"))
    return report.phi_summary(rows.withColumn("session_id", F.col("note_id") % 20)).select("phi_type", "session_id", "n")



@query(f"SELECT event_type, session_id, sequence_number, event_id, agent_id FROM ({ALL}) WHERE event_type IN ('escalation_triggered', 'human_review_response', 'module_error')")
def session_lists(spark, sf_dir):
    """Escalations, reviews and errors."""
    events = _all(spark, sf_dir)
    out = None
    for kind in ("escalation_triggered", "human_review_response", "module_error"):
        one = report.listed(events, kind).select(F.lit(kind).alias("event_type"), "session_id", "sequence_number", "event_id", "agent_id")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT event_id, 'tool' || (sequence_number % 3) AS tool FROM ({ALL}) WHERE event_type = 'tool_call'")
def session_tools(spark, sf_dir):
    """the tool of each action, from the redacted input."""
    given = F.to_json(F.struct(F.concat(F.lit("tool"), (F.col("sequence_number") % 3).cast("string")).alias("tool_name")))
    return report.listed(_all(spark, sf_dir).withColumn("redacted_input", given), "tool_call").select("event_id", "tool")


@query(f"SELECT session_id, coalesce(string_agg(CAST(round(confidence_score * 100) AS BIGINT), ',' ORDER BY sequence_number) FILTER (confidence_score IS NOT NULL), '') AS scores FROM ({ALL}) GROUP BY session_id")
def session_confidences(spark, sf_dir):
    """The scores of a session in order, in hundredths."""
    shown = F.transform("confidence_scores", lambda c: F.round(c * 100).cast("bigint").cast("string"))
    return report.confidences(_all(spark, sf_dir)).select("session_id", F.array_join(shown, ",").alias("scores"))


# --- device mode ----------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN l_quantity BETWEEN 5 AND 30 WHEN 'N' THEN l_quantity BETWEEN 1 AND 45 ELSE false END AS dose_ok FROM lineitem")
def dose_validate(spark, sf_dir):
    """M1: inclusive bounds, first range of a parameter, undeclared parameters fail."""
    ranges = spark.createDataFrame([("A", 5.0, 30.0, 0), ("N", 1.0, 45.0, 1), ("A", 0.0, 99.0, 2)], "parameter string, min double, max double, place int")
    return device.validate_dose(read(spark, sf_dir, "lineitem"), ranges, "l_returnflag", "l_quantity").select("l_orderkey", "l_linenumber", "dose_ok")


_CHANGES = "SELECT event_id, 'u' || cast(user_id % 40 AS string) AS session_id, cast({micros}(ts) AS bigint) AS ts_us FROM {events}"


_CONTROL = """SELECT 'u' || cast(user_id % 50 AS string) AS session_id, cast({micros}(ts) AS bigint) AS ts_us, event_id, CASE event_id % 17 WHEN 0 THEN 'emergency_stop' WHEN 5 THEN 'reset' WHEN 6 THEN 'device_change' ELSE 'tool_call' END AS kind FROM {events}"""


@query(f"SELECT event_id, coalesce(last_value(CASE WHEN kind IN ('emergency_stop', 'reset') THEN kind END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING), 'reset') = 'reset' AS running FROM ({views.duck(_CONTROL)})")
def emergency_stop(spark, sf_dir):
    """M5: what an emergency stop holds back until a reset."""
    return device.emergency_gate(view(spark, sf_dir, _CONTROL)).select("event_id", "running")


@query(
    f"WITH e AS ({views.duck(_CONTROL)}), r AS (SELECT session_id, max(CASE WHEN kind = 'reset' THEN (ts_us, event_id) END) AS at, max(CASE WHEN kind IN ('emergency_stop', 'reset') THEN (ts_us, event_id, kind) END) AS control FROM e GROUP BY session_id) "
    "SELECT e.session_id, 'C' AS software_safety_class, 'pump' AS device_type, CAST(NULL AS VARCHAR) AS udi, 5::BIGINT AS rate_limit_per_hour, count(*) FILTER (kind = 'device_change' AND (r.at IS NULL OR (ts_us, event_id) > r.at)) AS device_changes_this_session, "
    "coalesce(any_value(control[3]) = 'emergency_stop', false) AS emergency_stop_engaged FROM e JOIN r USING (session_id) GROUP BY e.session_id"
)
def device_report(spark, sf_dir):
    """M6: the report's device section."""
    config = {"enabled": True, "software_safety_class": "C", "device_type": "pump", "rate_limit_per_hour": 5}
    return device.report_section(view(spark, sf_dir, _CONTROL), config).select("session_id", "software_safety_class", "device_type", "udi", "rate_limit_per_hour", "device_changes_this_session", "emergency_stop_engaged")


@query(f"SELECT event_id, session_id, c AS changes_in_hour, c <= 2 AS within_limit FROM (SELECT a.event_id, a.session_id, count(*) AS c FROM ({views.duck(_CHANGES)}) a JOIN ({views.duck(_CHANGES)}) b ON a.session_id = b.session_id AND b.ts_us BETWEEN a.ts_us - 3600000000 AND a.ts_us AND (b.ts_us < a.ts_us OR b.event_id <= a.event_id) GROUP BY a.event_id, a.session_id)")
def rate_limit(spark, sf_dir):
    """M2: changes of the rolling hour."""
    return device.rate_limit(view(spark, sf_dir, _CHANGES), 2).select("event_id", "session_id", "changes_in_hour", "within_limit")


@query("SELECT c_custkey AS name, CASE c_custkey % 3 WHEN 0 THEN 'informational' WHEN 1 THEN 'advisory' ELSE 'interventional' END AS tier, cl AS safety_class FROM customer, (VALUES ('A'), ('B'), ('C')) t(cl) WHERE (cl = 'A' AND c_custkey % 3 <> 0) OR (cl = 'B' AND c_custkey % 3 = 2)")
def class_gate(spark, sf_dir):
    """M3."""
    actions = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("name"), F.when(F.col("c_custkey") % 3 == 0, "informational").when(F.col("c_custkey") % 3 == 1, "advisory").otherwise("interventional").alias("tier"))
    out = None
    for c in "ABC":
        one = device.class_violations(actions, c).withColumn("safety_class", F.lit(c))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN true ELSE false END AS authorized FROM customer")
def interventional_auth(spark, sf_dir):
    """M4: HMAC of the action under the clinician's key."""
    from caduspark.functions.hashing import hmac_sha256

    action = F.concat(F.lit("infuse"), F.col("c_custkey").cast("string"))
    who = F.when(F.col("c_custkey") % 3 == 0, "ann").when(F.col("c_custkey") % 3 == 1, "bob").otherwise("eve")
    rows = read(spark, sf_dir, "customer").select("c_custkey", action.alias("action_name"), who.alias("clinician_id"), hmac_sha256(action, b"ann's key").alias("signature"))
    return device.authorize(rows, {"ann": b"ann's key", "bob": b"bob's key"}).select("c_custkey", "authorized")


_TOKENS = "SELECT event_id AS arrival, 'u' || cast(user_id AS string) AS session_id, 'n' || cast(event_id % 97 AS string) AS nonce, 'c' || cast(event_id % 5 AS string) AS clinician_id, 1704100000 - event_id % 200 AS issued_at FROM {events}"


@query(
    f"WITH t AS (SELECT *, clinician_id <> 'c4' AS known, 1704100000 - issued_at <= 120 AS fresh FROM ({views.duck(_TOKENS)})) SELECT arrival, session_id, CASE WHEN NOT known THEN 'unknown clinician' WHEN NOT fresh THEN 'token expired' "
    "WHEN coalesce(bool_or(known AND fresh) OVER (PARTITION BY session_id, nonce ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'token replay detected' ELSE 'ok' END AS verdict FROM t"
)
def token_replay(spark, sf_dir):
    """M7: unknown, expired and replayed tokens."""
    known = spark.createDataFrame([(f"c{i}",) for i in range(4)], "clinician_id string")
    return device.token_verdicts(view(spark, sf_dir, _TOKENS), known, 1_704_100_000).select("arrival", "session_id", "verdict")


@query(
    "WITH t AS (SELECT c_custkey AS arrival, 's' || (c_custkey % 2) AS session_id, 'n' || (c_custkey % 50) AS nonce, c_custkey % 3 < 2 AS known, c_custkey % 200 <= 120 AS fresh, c_custkey % 7 <> 0 AS signed FROM customer) "
    "SELECT arrival, CASE WHEN arrival % 13 = 0 THEN 'malformed token' WHEN arrival % 13 = 1 THEN 'missing required token fields' WHEN NOT known THEN 'unknown clinician' WHEN NOT fresh THEN 'token expired' "
    "WHEN coalesce(bool_or(known AND fresh AND signed AND arrival % 13 > 1) OVER (PARTITION BY session_id, nonce ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'token replay detected' "
    "WHEN NOT signed THEN 'invalid signature' ELSE 'ok' END AS verdict FROM t"
)
def signed_tokens(spark, sf_dir):
    """M7: tokens under Ed25519 signatures."""
    now, secrets = 1_704_100_000, {f"c{i}": bytes([i]) * 32 for i in range(3)}

    @F.arrow_udf("struct<blob:string,signature:binary>")
    def issue(numbers: pa.Array) -> pa.Array:
        out = []
        for k in numbers.to_pylist():
            token = {"action_name": "infuse", "clinician_id": f"c{k % 3}", "issued_at": now - k % 200, "nonce": f"n{k % 50}", "session_id": f"s{k % 2}"}
            blob = b"no json" if k % 13 == 0 else json.dumps({k: v for k, v in token.items() if k != "nonce"} if k % 13 == 1 else token).encode()
            signature = ed25519.sign(secrets[token["clinician_id"]], device.token_message(token))
            out.append({"blob": base64.b64encode(blob).decode(), "signature": signature if k % 7 else signature[::-1]})
        return pa.array(out, pa.struct([("blob", pa.string()), ("signature", pa.binary())]))

    customers = store.spread(read(spark, sf_dir, "customer"), 1 << 18).select(F.col("c_custkey").alias("arrival"))
    rows = customers.withColumn("t", issue(F.col("arrival"))).select("arrival", "t.*")
    public = {who: ed25519.to_pem(ed25519.public_key(secrets[who])) for who in ("c0", "c1")}
    return device.signed_token_verdicts(rows, public, now).select("arrival", "verdict")


def _snapshots(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    old = part.where("p_partkey % 10 <> 9").select("p_partkey", F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))
    new = part.where("p_partkey % 10 <> 8").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("size"), F.col("p_brand").alias("brand"))
    return old, new


@query(
    "WITH o AS (SELECT p_partkey, p_size::VARCHAR AS size, p_brand AS brand FROM part WHERE p_partkey % 10 <> 9), n AS (SELECT p_partkey, (p_size + (p_partkey % 4 = 0)::INT)::VARCHAR AS size, p_brand AS brand FROM part WHERE p_partkey % 10 <> 8), "
    "j AS (SELECT p_partkey, o.size AS os, n.size AS ns, o.brand AS ob, n.brand AS nb FROM o FULL JOIN n USING (p_partkey)) "
    "SELECT p_partkey, 'size' AS attribute, os AS old, ns AS new FROM j WHERE os IS DISTINCT FROM ns UNION ALL SELECT p_partkey, 'brand', ob, nb FROM j WHERE ob IS DISTINCT FROM nb"
)
def snapshot_diff(spark, sf_dir):
    """M8."""
    return device.snapshot_diff(*_snapshots(spark, sf_dir), "p_partkey", ["size", "brand"])


def _deployments(spark, sf_dir, new: bool):
    part = read(spark, sf_dir, "part").where("p_partkey % 10 <> 9" if not new else "true")
    kind = F.pmod(F.crc32(F.encode("p_brand", "UTF-8")), F.lit(3))
    return part.select(
        F.col("p_brand").alias("deployment"),
        F.col("p_partkey").cast("string").alias("parameter"),
        (F.col("p_retailprice") + (F.when(F.col("p_partkey") % 5 == 0, 1.0).otherwise(0.0) if new else 0.0)).alias("max"),
        F.lit("B" if new else "A").alias("safety_class"),
        F.lit("m1").alias("model"),
        F.lit(10 if new else 5).alias("rate_limit"),
    ).where(kind >= 0)


@query(
    "SELECT p_brand AS deployment, array_to_string(['safety_class_upgrade'] || coalesce(list_sort(list('dose_range_expansion:' || p_partkey) FILTER (p_partkey % 10 = 9 OR p_partkey % 5 = 0)), []) || ['rate_limit_relaxation'], ',') AS flags FROM part GROUP BY p_brand HAVING count(*) FILTER (p_partkey % 10 <> 9) > 0"
)
def cia_flags(spark, sf_dir):
    """M9."""
    return device.impact_flags(_deployments(spark, sf_dir, False), _deployments(spark, sf_dir, True))


@query(f"SELECT conv_id, turn, {duck.hmac('text', KEY)} AS mac, 'env' AS key_id FROM conversations")
def signed_by_provider(spark, sf_dir):
    """Signatures under a key that a provider resolves."""
    provider = keys.EnvironmentKey("K", environment={"K": base64.b64encode(KEY).decode()})
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", keys.sign(F.col("text"), provider).alias("mac"), F.lit(provider.key_id).alias("key_id"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'II' ELSE 'III' END AS rigor, CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 5 ELSE 8 END::INT AS n_documents FROM customer")
def rigor_map(spark, sf_dir):
    """M10."""
    cls = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return device.rigor(read(spark, sf_dir, "customer").select("c_custkey", cls.alias("cls")), "cls").select("c_custkey", "rigor", F.size(F.split("documents", "; ")).alias("n_documents"))


# --- metrics --------------------------------------------------------------------------------------------

_SAMPLES = "SELECT event_id, 'u' || cast(user_id % 20 AS string) AS session_id, value, cast({micros}(ts) AS bigint) AS ts_us, event_type FROM {events}"
SAMPLES = views.duck(_SAMPLES)


@query(f"SELECT event_id, w[1 + (len(w) - 1) * 95 // 100] AS p95, w[1 + (len(w) - 1) * 95 // 100] <= 40 AS within_budget FROM (SELECT event_id, list_sort(list(value) OVER (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW)) AS w FROM ({SAMPLES}))")
def rolling_p95(spark, sf_dir):
    """O1."""
    return metrics.rolling_p95(view(spark, sf_dir, _SAMPLES), "session_id", "event_id", "value", 64, 40.0).select("event_id", "p95", "within_budget")


@query(f"SELECT event_type, le, count(*) AS n FROM (SELECT event_type, CASE WHEN value <= 1 THEN 1.0 WHEN value <= 5 THEN 5.0 WHEN value <= 10 THEN 10.0 WHEN value <= 50 THEN 50.0 END::DOUBLE AS le FROM ({SAMPLES})) GROUP BY ALL")
def latency_histogram(spark, sf_dir):
    """O4."""
    return metrics.histogram(view(spark, sf_dir, _SAMPLES), ["event_type"], "value", (1.0, 5.0, 10.0, 50.0))


@query(f"SELECT (ts_us // 60000000) * 60000000 AS window_us, event_type, count(*) AS n FROM ({ACTIONS}) WHERE event_type = 'phi_detected' GROUP BY ALL")
def detection_rate_1m(spark, sf_dir):
    """O5."""
    return metrics.rate(view(spark, sf_dir, views.ACTIONS).where("event_type = 'phi_detected'"), "ts_us", 1, ["event_type"])


@query(f"SELECT (ts_us // 3600000000) * 3600000000 AS window_us, risk_tier, count(*) AS n FROM ({ACTIONS}) WHERE event_type = 'escalation_triggered' GROUP BY ALL")
def escalations_by_tier_1h(spark, sf_dir):
    """O7."""
    return metrics.rate(view(spark, sf_dir, views.ACTIONS).where("event_type = 'escalation_triggered'"), "ts_us", 60, ["risk_tier"])


@query(f"SELECT (ts_us // 3600000000) * 3600000000 AS window_us, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM ({SAMPLES}) GROUP BY ALL")
def latency_quantiles(spark, sf_dir):
    """O6."""
    return metrics.latency_quantiles(view(spark, sf_dir, _SAMPLES), "ts_us", "value", 60).select("window_us", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@query(f"SELECT doc_id, length(redacted) AS n FROM ({duck.redacted(DOCS, 'doc_id', chr(39) + '[REDACTED:' + chr(39) + ' || phi_type || ' + chr(39) + ']' + chr(39), types=['EMAIL', 'PHONE', 'IP_ADDRESS'])})")
def scan_cache(spark, sf_dir):
    """O2: one scan for each distinct text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = metrics.scan_cached(docs, "text", lambda d: d.withColumn("r", scan.plain_scan(F.col("text"))))
    return out.select("doc_id", F.length("r").cast("long").alias("n"))


# --- sources and sinks ----------------------------------------------------------------------------------

QUEUE = views.duck(views.QUEUE)


@query(f"SELECT event_id, at_us + 14400000000 AS deadline_us FROM ({QUEUE}) WHERE event_id % 7 <> 0 AND at_us + 14400000000 < {NOW_US}")
def review_queue_overdue(spark, sf_dir):
    """Pending reviews past their deadline."""
    queue = store.enqueue(view(spark, sf_dir, views.QUEUE), F.col("at_us"))
    done = queue.where("event_id % 7 = 0").select("event_id", F.lit("resolved").alias("new_status"))
    return store.overdue(store.resolve(queue, done, "event_id"), NOW_US).select("event_id", "deadline_us")


@query(f"SELECT event_id, session_id FROM ({AUDIT})")
def sink_idempotent(spark, sf_dir):
    """K4: appending an overlapping, repeating batch adds each event once."""
    rows = view(spark, sf_dir, views.AUDIT).select("event_id", "session_id")
    known = rows.where("length(session_id) <= 2")
    return known.unionByName(store.idempotent_append(known, rows.unionByName(rows)))


@query(f"SELECT unnest(['sessions', 'table']) AS sink, event_id, session_id, event_type FROM ({AUDIT})")
def sink_fan_out(spark, sf_dir):
    """K7, K8: one batch to a folder a session and to a Parquet table."""
    schema = "event_id string, session_id string, event_type string"
    where = f"{sessions.shared_dir(spark)}/fan-{__import__('uuid').uuid4().hex}"
    batch = view(spark, sf_dir, views.AUDIT).select("event_id", "session_id", "event_type")
    store.fan_out(batch, [lambda b: store.append_by_session(b, f"{where}/sessions"), lambda b: b.write.mode("append").parquet(f"{where}/table.parquet")])
    first = spark.read.schema(schema).json(f"{where}/sessions").withColumn("sink", F.lit("sessions"))
    return first.unionByName(store.read_store(spark, f"{where}/table.parquet").withColumn("sink", F.lit("table")))


@query(f"SELECT session_id, sequence_number, event_id, event_type, agent_id FROM ({AUDIT})")
def jsonl_roundtrip(spark, sf_dir):
    """Events written as JSON lines and read back strictly."""
    rows = view(spark, sf_dir, views.AUDIT).select("session_id", "sequence_number", "event_id", "event_type", "agent_id")
    path = f"{sessions.shared_dir(spark)}/jsonl-{__import__('uuid').uuid4().hex}"
    store.append_jsonl(rows, path)
    return store.read_jsonl(spark, path, "session_id string, sequence_number long, event_id string, event_type string, agent_id string")


@query(f"SELECT session_id, event_id, CASE WHEN length(session_id) = 2 THEN 0 ELSE 1 END AS source FROM ({AUDIT}) WHERE length(session_id) <> 2 OR sequence_number <= 2")
def chained_read(spark, sf_dir):
    """Each session from the first store that has it."""
    rows = view(spark, sf_dir, views.AUDIT).select("session_id", "event_id", "sequence_number")
    first = rows.where("length(session_id) = 2 and sequence_number <= 2").withColumn("source", F.lit(0))
    return store.chained_read([first, rows.withColumn("source", F.lit(1))]).select("session_id", "event_id", "source")


@query(f"SELECT DISTINCT session_id FROM ({ALL})")
def list_sessions(spark, sf_dir):
    """S3, S5, S7, S11, S12."""
    return store.chained_sessions([view(spark, sf_dir, views.AUDIT), view(spark, sf_dir, views.ACTIONS)])


@query(f"SELECT event_id, sequence_number, event_type FROM ({AUDIT}) WHERE session_id = 'c7'")
def read_session(spark, sf_dir):
    """S1, S4, S6, F1."""
    return store.read_session(view(spark, sf_dir, views.AUDIT), "c7").select("event_id", "sequence_number", "event_type")


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 100")
def fifo_cap(spark, sf_dir):
    """K1: a store that keeps the last hundred events."""
    return store.keep_last(read(spark, sf_dir, "events"), 100, "event_id").select("event_id")


@query(f"SELECT session_id, event_id, agent_id, input_hash, '' AS signature FROM ({AUDIT})")
def rehydrate(spark, sf_dir):
    """Events from JSON payloads, with defaults."""
    rows = view(spark, sf_dir, views.AUDIT).select(F.to_json(F.struct("session_id", "event_id", "agent_id", "input_hash")).alias("payload"))
    return store.rehydrate(rows).select("session_id", "event_id", "agent_id", "input_hash", "signature")


@query(f"SELECT session_id, sequence_number, n FROM (SELECT session_id, sequence_number % 3 AS sequence_number, count(*) AS n FROM ({AUDIT}) GROUP BY ALL) WHERE n > 1")
def store_duplicates(spark, sf_dir):
    """K5: what a unique (session, sequence) would refuse."""
    return store.duplicates(view(spark, sf_dir, views.AUDIT).withColumn("sequence_number", F.col("sequence_number") % 3))


@query("SELECT 'c' || conv_id AS session_id, turn + 1 AS sequence_number, CASE role WHEN 'system' THEN 'session_start' WHEN 'user' THEN 'agent_llm_call' ELSE 'agent_llm_response' END AS event_type, sha256(coalesce(text, '')) AS input_hash FROM conversations")
def adapter_events(spark, sf_dir):
    """Conversations as audit events."""
    return adapters.conversation_events(read(spark, sf_dir, "conversations")).select("session_id", "sequence_number", "event_type", "input_hash")


@query("SELECT event_id, 'r' || event_id AS call_id, 'tool' || (event_id % 3) AS tool, unnest(['in', 'out']) AS direction, sha256('{\"k\":1}') AS input_hash FROM events WHERE event_id % 4 = 1")
def mcp_events(spark, sf_dir):
    """Tool calls of JSON-RPC traffic; malformed and other messages give none."""
    k = F.col("event_id")
    call = F.concat(F.lit('{"method":"tools/call","id":"r'), k.cast("string"), F.lit('","params":{"name":"tool'), (k % 3).cast("string"), F.lit('","arguments":{"k":1}}}'))
    body = F.when(k % 4 == 1, call).when(k % 4 == 2, F.lit('{"method":"ping"}')).otherwise(F.lit("{broken"))
    return adapters.rpc_events(read(spark, sf_dir, "events").select("event_id", body.alias("m")), "m", "event_id").select("event_id", "call_id", "tool", "direction", "input_hash")


@query(f"SELECT event_id, session_id, event_type, sequence_number, 0 AS phi_tags FROM ({AUDIT})")
def otel_spans(spark, sf_dir):
    """K9, F8: attributes of spans, counts instead of values."""
    rows = view(spark, sf_dir, views.AUDIT).withColumn("phi_tags_detected", F.array().cast("array<string>"))
    return store.span_attributes(rows).select("event_id", "session_id", "event_type", "sequence_number", "phi_tags")


# --- streaming ------------------------------------------------------------------------------------------


def _stream(spark, sf_dir, name):
    path = f"{sf_dir}/{name}.parquet"
    rows = spark.read.parquet(path)
    is_folder = rows.select("_metadata.file_path").limit(1).collect()[0][0].rstrip("/").split("/")[-1] != f"{name}.parquet"
    return spark.readStream.schema(rows.schema).parquet(path if is_folder else f"{sf_dir}/{name}.parque[t]")


def _audit_stream(spark, sf_dir):
    return adapters.conversation_events(_stream(spark, sf_dir, "conversations"))


@query()
def stream_chain(spark, sf_dir):
    """The chain as a stateful stream (tested against its batch twin)."""
    return sessions.run_available(sessions.chain_stream(_audit_stream(spark, sf_dir), KEY))


def _changes_stream(spark, sf_dir):
    rows = _stream(spark, sf_dir, "events")
    return rows.select("event_id", F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("session_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "value")


@query(_SQL["rate_limit"])
def stream_rate_limit(spark, sf_dir):
    """The rolling limit as a stateful stream."""
    return sessions.run_available(sessions.rate_limit_stream(_changes_stream(spark, sf_dir), 2)).select("event_id", "session_id", "changes_in_hour", "within_limit")


@query("SELECT event_id, w[1 + (len(w) - 1) * 95 // 100] AS p95 FROM (SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)) AS w FROM events)")
def stream_rolling_p95(spark, sf_dir):
    """Z8."""
    return sessions.run_available(sessions.rolling_p95_stream(_changes_stream(spark, sf_dir), 32)).select("event_id", "p95")


@query(_SQL["signal_history_cosine"])
def stream_consistency(spark, sf_dir):
    """Z3."""
    rows = _stream(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("session_id"), F.col("vec_id").alias("event_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return sessions.run_available(sessions.consistency_stream(rows)).select(F.col("event_id").alias("vec_id"), F.round("consistency", 6).alias("consistency"))


@query("SELECT DISTINCT 'u' || user_id AS session_id, 'n' || (event_id % 97) AS nonce FROM events")
def stream_token_dedup(spark, sf_dir):
    """Each nonce of a session once within the watermark; the table is one batch, within which nothing expires."""
    rows = _stream(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.concat(F.lit("n"), (F.col("event_id") % 97).cast("string")).alias("nonce"), F.col("ts").cast("timestamp").alias("issued_at"))
    return sessions.run_available(sessions.token_dedup_stream(rows)).select("session_id", "nonce")


@query("SELECT (epoch_us(ts) // 3600000000) * 3600000000 AS window_us, event_type, count(*) AS n FROM events GROUP BY ALL HAVING max(epoch_us(date_trunc('hour', ts)) + 3600000000) <= (SELECT max(epoch_us(ts)) FROM events)")
def stream_rates(spark, sf_dir):
    """Hourly counts in append mode: a window comes out once the watermark has passed it."""
    rows = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return sessions.run_available(sessions.rates_stream(rows, "ts", "1 hour", ["event_type"]))


_CLOSED = """
WITH e AS (SELECT user_id::VARCHAR AS session_id, epoch_us(ts) AS us, event_type = 'purchase' AS e FROM events),
b AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY session_id ORDER BY us) > 1800000000, true)::INT AS fresh FROM e),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY us RANGE UNBOUNDED PRECEDING) AS part FROM b),
closed AS (SELECT session_id, max(us) AS last_us, bool_or(e) AS ended FROM p GROUP BY session_id, part HAVING max(us) + 1800000000 + 600000000 <= (SELECT max(us) FROM e))
"""


def _closed(spark, sf_dir):
    rows = _stream(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "purchase", "session_end").otherwise("tool_call").alias("event_type"))
    return sessions.close_sessions_stream(rows)


@query(_CLOSED + "SELECT session_id, last_us, ended FROM closed")
def stream_sessions(spark, sf_dir):
    """Sessions closed by idle time, with or without an explicit end."""
    return sessions.run_available(_closed(spark, sf_dir)).select("session_id", F.unix_micros("last_ts").alias("last_us"), "ended")


@query(_CLOSED + "SELECT session_id, session_id || '-' || last_us || '-end' AS event_id, 'session_end' AS event_type, last_us AS ts_us FROM closed WHERE NOT ended")
def stream_session_ends(spark, sf_dir):
    """A made-up end for each session that closed without one."""
    return sessions.run_available(sessions.session_ends(_closed(spark, sf_dir))).select("session_id", "event_id", "event_type", "ts_us")


@query("SELECT event_id, epoch_us(ts) AS enqueued_us FROM events WHERE event_type = 'purchase' AND event_id % 7 <> 0 AND epoch_us(ts) + 14400000000 <= (SELECT max(epoch_us(ts) + 60000000 * (event_id % 7 = 0)::INT) FROM events WHERE event_type = 'purchase')")
def stream_overdue(spark, sf_dir):
    """Reviews whose deadline the watermark has passed; every seventh is resolved after a minute."""
    rows = _stream(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    turns = F.array(F.lit("pending"), F.when(F.col("event_id") % 7 == 0, F.lit("resolved")))
    queue = rows.select("event_id", "at", F.explode(F.array_compact(turns)).alias("status")).withColumn("at", F.when(F.col("status") == "pending", F.col("at")).otherwise(F.col("at") + F.expr("INTERVAL 1 MINUTE")))
    return sessions.run_available(sessions.overdue_stream(queue, "at")).select("event_id", F.unix_micros("enqueued").alias("enqueued_us"))


@query(f"SELECT event_id, session_id FROM ({AUDIT})")
def stream_idempotent_sink(spark, sf_dir):
    """Micro-batches appended so that a replay adds nothing."""
    where = f"{sessions.shared_dir(spark)}/sink-{__import__('uuid').uuid4().hex}"
    schema = "event_id string, session_id string"
    for turn in range(2):  # the second stream sends all events again
        sessions.append_batches(_audit_stream(spark, sf_dir).select("event_id", "session_id"), f"{where}/store", f"{where}/state{turn}", schema, "session_id")
    return sessions.read_appended(spark, f"{where}/store", schema)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan and redact documents, turn the findings into audit events, chain them, and hold all rules against the sessions."""
    found = scan.scan(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text")
    hits = found.select("doc_id", "source", F.size("hits").alias("n"))
    kinds = F.when(F.col("n") > 0, F.array(F.lit("user_input"), F.lit("phi_detected"), F.lit("phi_redacted"))).otherwise(F.array(F.lit("user_input")))
    events = hits.select("source", "doc_id", F.posexplode(kinds).alias("p", "event_type")).select(
        F.col("source").alias("session_id"),
        (F.col("doc_id") * 3 + F.col("p")).alias("sequence_number"),
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("p").cast("string")).alias("event_id"),
        "event_type",
        F.lit("scanner").alias("agent_id"),
        F.lit("").alias("input_hash"),
        F.lit(None).cast("string").alias("risk_tier"),
        F.lit(None).cast("double").alias("confidence_score"),
        (F.col("doc_id") * 1_000_000).alias("ts_us"),
    )
    signed = chain.emit(events, KEY)
    return report.by_framework(rules.evaluate(signed, verified=chain.verify(signed, KEY)))
