"""Detection in batches against plain Python, and what the plans of its queries must not hold."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caduspark.functions import batch, detect, ed25519, fixed, pure
from caduspark.plans import registry
from caduspark.sources import store

DIR = "/root/testdata/sf0.001"
CASES = [
    "", "<", "call 617-555-0123<617-555-0123", "a@b.com-c@d.org", "@@x@y", "x%y+@z.io", "httphttps://a<https://b", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.4",
    "1/2/34/56/78", "2024-01-02/03/04", "Jan 5,\n2024 Marching 3 1999", "a+1 (617) 555.0123", "1(617)555-0123 _(617) 555-0123", "+1-617-555-0123 16175550123",
    "000-12-3456 912-34-5678 123-45-6789 123 45 6789", "MRN#12AB medical Record number: A1B2C3 mrn 123", "NPı 5000003686 npi:5000003686", "dea AB1234567", "12345-6789 x12345-6789",
    "١٢٣-45-6789", "é617-555-0123 617-555-0123́", "tel\x1c617\x1c555\x1c0123", "\U0001d7e2 \U00010348 a@b.co", "-.a@b.co", "a-b-c-d@", ".-@x.yy",
]
ODD = ["exаmple@x.com %40 ​123-​45-6789", "%2525 a%40b.com", "ﬁ c%40d.org e@f.org", "㏂ 10.0.0.1", "617－555－0123 or 617-555-0123"]


def rows(lists):
    return [[tuple(h.values()) for h in hits] for hits in lists.to_pylist()]


def test_raw_hits_are_those_of_finditer():
    assert [kind for kind, *_ in fixed.PATTERNS] == batch.KINDS
    assert not any(p.search(batch._BETWEEN) for p in batch.COMPILED.values())
    want = [[(k, m.start(), m.end(), m[0], c, "regex") for k, p, c in pure._COMPILED for m in p.finditer(t)] for t in CASES]
    assert rows(batch.hits_of(pa.array(CASES), batch.raw)) == want
    for t, one in zip(CASES, want):
        assert rows(batch.hits_of(pa.array([t]), batch.raw)) == [one]


def test_merged_and_scanned_hits_are_those_of_plain_python():
    texts = pa.array([*CASES, None, *ODD])
    none = len(CASES)
    got = rows(batch.hits_of(texts, lambda t: batch.merged(batch.raw(t))))
    assert got == [pure.hits_of(t) if t else [] for t in texts.to_pylist()]
    assert rows(batch.hits_of(texts, lambda t: batch.scanned(t, False))) == [pure.scanned(t) if t else [] for t in texts.to_pylist()]
    out = batch.redacted(texts, lambda t: batch.scanned(t, False), "REDACT", None, "session").to_pylist()
    assert out == [pure.redact_text(t) if t is not None else None for t in texts.to_pylist()] and out[none] is None


def test_slices_and_masks_of_long_texts():
    texts = ["x" * batch._SLICE + " a@b.com", "", "1.2.3.4", "y" * (batch._SLICE // 2) + "é 617-555-0123"] * 2
    assert rows(batch.hits_of(pa.array(texts), lambda t: batch.merged(batch.raw(t)))) == [pure.hits_of(t) for t in texts]
    assert rows(batch.hits_of(pa.array([], pa.string()), batch.raw)) == []


@pytest.mark.parametrize("mode", ["REDACT", "PSEUDONYMIZE", "GENERALIZE", "SUPPRESS"])
def test_redactions_are_those_of_the_expressions(spark, mode):
    from caduspark.functions import redact

    texts = ["Seen 1998-02-06, 1/2/34, Jan 5, 2024 at 02139-1234 by a@b.com", "call 617-555-0123", "none", "", None]
    t, over = F.col("t"), {"EMAIL": "PSEUDONYMIZE", "URL": "SUPPRESS"}
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = df.select(batch.redacted_column(t, mode, over).alias("a"), redact.redact(t, detect.regex_hits(t), mode, over).alias("b")).collect()
    assert all(r.a == r.b for r in got) and len(got) == 5


def test_own_patterns_join_the_others(spark):
    own = [("VISIT", "Seen [0-9]{4}-[0-9]{2}-[0-9]{2}", 0.99), ("X", "^no", 0.1)]
    t = F.col("t")
    df = spark.createDataFrame([(x,) for x in ["Seen 2024-01-02 Seen 2024-01-03 a@b.com", "nothing", "no@b.com", "", None]], "t string")
    apart = detect.detect_with(t, [detect.raw_hits, *[detect.pattern_detector(*o) for o in own]])
    got = df.select(batch.merged_column(t, tuple(own)).alias("a"), apart.alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and [len(r.a) for r in got] == [3, 1, 1, 0, 0]


def test_base64_tokens_as_the_expressions_find_them(spark):
    tokens = ["x MDAxLTQ1LTY3ODkg y", "MDAxLTQ1LTY3ODkg=", "abcdefghijkl MDAxLTQ1LTY3ODkg/MDAxLTQ1LTY3ODkg", "MDAxLTQ1LTY3ODk", "YUBiLmNvbSBjQGQub3Jn", "<MDAxLTQ1LTY3ODkg<"]
    df = spark.createDataFrame([(x,) for x in tokens], "t string")
    want = [[tuple(h) for h in r.h] for r in df.select(detect.base64_hits(F.col("t")).alias("h")).collect()]
    got = rows(batch.hits_of(pa.array(tokens), lambda t: batch._encoded(t)))
    assert got == want and sum(map(len, got)) >= 4


SCANS = "phi_adversarial_scan report_phi_summary tags phi_custom_filter phi_spans_notes detector_recall redact_suppress redact_replace redact_overrides redact_generalize redact_pseudonymize phi_overlap_merge phi_custom_detector"


@pytest.mark.parametrize("name", SCANS.split())
def test_patterns_run_once_a_text_and_in_batches(spark, name):
    plan = registry.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"run\(", plan)) == (2 if name == "phi_adversarial_scan" else 1)  # HL7 messages apart
    assert not re.search(r"regexp_replace\(.*d\{3\}", plan) and "Repartition" in plan


def test_tasks_grow_in_number_with_what_is_read(spark):
    df = spark.read.parquet(f"{DIR}/orders.parquet")
    few, many = store.spread(df, 1 << 40), store.spread(df, 1 << 10)
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism < many.rdd.getNumPartitions()
    assert sorted(many.collect()) == sorted(df.collect())


def test_signatures_use_tables(monkeypatch):
    secret, message = bytes(range(32)), b"infuse"
    public, signature = ed25519.public_key(secret), ed25519.sign(secret, message)
    assert ed25519.verify(public, message, signature)
    monkeypatch.setattr(ed25519, "_add", None)  # sums of whole points are for making tables only
    assert ed25519.sign(secret, message) == signature and ed25519.verify(public, message, signature)
    assert not ed25519.verify(public, message + b"x", signature)


def test_tokens_are_issued_by_all_cores(spark):
    plan = registry.queries()["signed_tokens"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("issue(") < plan.index("Repartition")  # the plan's leaves come last


def test_plain_scan_skips_only_patterns_that_cannot_match():
    for t in [*CASES, *ODD, "MRN ABCD", "medical record none", "nothing", "https://x"]:
        assert pure.hits_of(t) == pure.merged([(k, m.start(), m.end(), m[0], c, "regex") for k, p, c in pure._COMPILED for m in p.finditer(t)])


def test_plain_scan_of_words_tries_no_pattern(monkeypatch):
    monkeypatch.setattr(pure, "_COMPILED", None)
    assert pure.hits_of("resourceType") == [] and pure.redact_text("no identifiers here") == "no identifiers here"


@pytest.mark.parametrize("name", ["fhir_redact_typed", "fhir_redact", "tool_events"])
def test_customers_are_dealt_out(spark, name):
    assert "Repartition" in registry.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()


def test_session_folders_are_written_by_all_cores(spark, tmp_path):
    cores, track = spark.sparkContext.defaultParallelism, spark.sparkContext.statusTracker()
    events = spark.range(300).selectExpr("cast(id as string) event_id", "concat('s', id % 150) session_id")
    spark.sparkContext.setJobGroup("fan", "fan")
    store.append_by_session(events, f"{tmp_path}/s")
    tasks = [track.getStageInfo(s).numTasks for j in track.getJobIdsForGroup("fan") for s in track.getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("", "")
    assert max(tasks) == 4 * cores
    found = spark.read.schema("event_id string, session_id string").json(f"{tmp_path}/s")
    assert sorted(map(tuple, found.select(*events.columns).collect())) == sorted(map(tuple, events.collect()))
