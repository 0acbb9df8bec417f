"""Cases that the tables do not hold."""

import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from caduspark.functions import detect, ed25519, fixed, pure, redact, signals
from caduspark.functions.hashing import hmac_sha256
from caduspark.operators import calibrate, chain, device, grounding, metrics, propagation, report, routing, rules, scan
from caduspark.plans import registry
from caduspark.sources import dicom, keys, policy, store
from caduspark.streaming import sessions


def hits(spark, texts, build):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", build(F.col("t")).alias("h")).orderBy("i").collect()
    return [[tuple(h) for h in r.h] for r in rows]


CASES = [
    "", "SSN 123-45-6789 and 123 45-6789, not 000-12-3456 or 666-12-3456", "a@b.co x@y.org.", "(617) 555-0123 +1 617 555 0123 2175550123", "10.0.0.1 and 256.1.1.1",
    "see https://x.org/a?b=c'd", "2024-01-02 1/2/2024 March 3, 2024", "MRN: AB-1234 Medical record shows", "NPI 1234567893 DEA: AB1234567", "02139-4307", "NPI: 5123456789 overlaps",
    "１２３-45-6789 é 123-45-6789", "call \x01 617-555-0127 or\x01 617-555-0128 a@b.co", "10.0.0.1\x0110.0.0.2", "\x01", "mRn#ABCD npı 1234567893 MEDICAL  RECORD: XY12",
    "\U0001f600 330-07-7333 \U0001f600 10.0.0.1 a.b@c.de", "٣٣٠-٠٧-٧٣٣٣ and 330-07-7333é",
]


def test_patterns_equal_plain_python(spark):
    got = hits(spark, CASES, detect.regex_hits)
    assert got == [pure.hits_of(t) for t in CASES]


def test_documents_are_counted_by_all_types(spark, tmp_path):
    spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [(i, kind, m.start(), m.end()) for i, text in enumerate(CASES) for kind, pattern, _, _ in fixed.PATTERNS for m in re.finditer(pattern, text)]
    kinds, docs = sorted({f[1] for f in found}), sorted({f[0] for f in found})
    assert len(kinds) == 10
    got = registry.queries()["phi_hits_by_type_all"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(k, sum(f[1] == k for f in found), len({f[0] for f in found if f[1] == k})) for k in kinds]
    got = registry.queries()["phi_doc_summary_all"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(d, sum(f[0] == d for f in found), min(f[2] for f in found if f[0] == d), max(f[3] for f in found if f[0] == d)) for d in docs]


def test_language_filter_reads_whole_documents(spark, tmp_path):
    far = "x " * 500
    docs = [("es", far + "la paciente Juana Pérez y " + far + "Otra Persona"), ("es", far + "Juana Pérez"), ("fr", "Madame Curie, " + far + "le Docteur Émile Roux"), ("en", far + "paciente Juana Pérez"), (None, "Ana Paz"), ("es", None), ("es", "")]
    rows = [(i, *d) for i, d in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    upper, lower = ("".join(filter(test, map(chr, range(0x250)))) for test in (str.isupper, lambda c: c.islower() and c not in "ªº"))
    want = []
    for i, lang, text in rows:
        found = [m.span() for m in re.finditer(rf"\b[{upper}][{lower}]+\s+[{upper}][{lower}]+\b", text or "")]
        cues = fixed.LANGUAGE_CUES.get(lang, {}).get("NAME", [])
        want.append((i, lang, len(found), sum(any(c in text[max(a - 32, 0) : b + 32].lower() for c in cues) for a, b in found)))
    assert [w[3] for w in want] == [1, 0, 2, 0, 0, 0, 0]
    assert sorted(map(tuple, registry.queries()["phi_multilingual_filter_all"](spark, str(tmp_path)).collect())) == want


def test_merge_keeps_union_and_winner(spark):
    rows = spark.range(1).select(
        detect.merge(
            F.array(detect.hit(F.lit("URL"), F.lit(0), F.lit(30), F.lit("u"), F.lit(0.95), F.lit("a")), detect.hit(F.lit("EMAIL"), F.lit(10), F.lit(35), F.lit("e"), F.lit(0.99), F.lit("b")))
        ).alias("h")
    )
    assert [tuple(h) for h in rows.first().h] == [("EMAIL", 0, 35, "e", 0.99, "b")]


def test_disguised_text(spark):
    rng = random.Random(4)
    letters = "123-4567890 ab@.c%40%2eа​é１﻿"
    texts = ["1​23-45-6789", "j%40x.org", "jо@x.org", "１２３-４５-６７８９", None] + ["".join(rng.choice(letters) for _ in range(40)) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r for r in scan.scan(df, "t", encoded=False).collect()}
    for i, t in enumerate(texts):
        want = pure.scanned(t) if t is not None else []
        assert [tuple(h) for h in got[i].hits] == want, t
        assert got[i].redacted == (pure.redact_text(t) if t is not None else None)


def test_base64(spark):
    import base64

    token = base64.b64encode(b"ssn 123-45-6789").decode()
    bad = base64.b64encode(b"\xff\xfe123-45-6789").decode()
    got = hits(spark, [f"x {token} y", f"x {bad} y", "AAAABBBBCCCC", "short"], detect.base64_hits)
    assert got == [[("SSN", 2, 2 + len(token), token, 0.95, "regex+base64")], [], [], []]


def test_hl7_every_occurrence(spark):
    message = "MSH|^~&|M\rPID|1||42||DOE|x|M\r"
    df = scan.scan(spark.createDataFrame([(message,)], "t string"), "t", encoded=False).first()
    assert "DOE" not in df.redacted and "[REDACTED:HL7_PID-5]" in df.redacted
    assert df.redacted.startswith("[REDACTED:HL7_PID-7]SH|")  # the M of MSH is a value as well


def test_json_depth_and_keys(spark):
    deep = "[" * 5 + '"a@b.co"' + "]" * 5
    rows = spark.createDataFrame([('{"a@b.co":1,"c@d.co":{"resourceType":"Patient","name":"x"}}',), (deep,), ("{bad",), (None,)], "j string")
    got = [r.redacted for r in scan.scan_json(rows, "j", most=4).collect()]
    assert got[0] == '{"[REDACTED:EMAIL]":1,"[REDACTED:EMAIL]_":{"resourceType":"Patient","name":"[REDACTED:name]"}}'
    assert "MAX_DEPTH" in got[1] and got[2] == "{bad" and got[3] is None  # text that is no JSON is scanned as text
    rows = spark.createDataFrame([(deep,), ("call 617-555-0123 {",), ("[" * 20_000,), ('{"resourceType":"Patient","name":[{"family":"x"}],"active":true,"n":7,"zip":"007"}',)], "j string")
    got = scan.scan_json(rows, "j", most=4, found="tags").collect()
    assert [t.phi_type for t in got[0].tags] == ["SCAN_DEPTH_EXCEEDED"] == [t.phi_type for t in got[2].tags]
    assert got[1].redacted == "call [REDACTED:PHONE] {" and [t.phi_type for t in got[1].tags] == ["PHONE"]
    assert got[3].redacted == '{"resourceType":"Patient","name":"[REDACTED:name]","active":true,"n":7,"zip":"007"}'


def test_minimum_necessary_keeps_types(spark):
    row = '{"id":"007","name":"true","note":"[x","n":7,"ok":false,"gone":null,"in":{"a":{"b":[1,"2"]},"c":1},"empty":{}}'
    df = spark.createDataFrame([(row,), ("no json",)], "j string")
    paths = ["id", ".name", "note", "n", "ok", "gone", "in.a.b", "empty.x", "absent"]
    got = [r[0] for r in df.select(scan.minimum_necessary(F.col("j"), paths)).collect()]
    assert got == ['{"gone":null,"id":"007","in":{"a":{"b":[1,"2"]}},"n":7,"name":"true","note":"[x","ok":false}', "{}"]


def test_rules_from_yaml(tmp_path):
    text = "name: mine\nversion: 2\nrules:\n  - {id: A, predicate: event_count >= 1, severity: blocker, references: [x]}\n  - {id: B, predicate: chain_verifies}\n"
    (tmp_path / "b.yaml").write_text(text)
    (tmp_path / "a.yaml").write_text("rules: []")
    got = rules.load_folder(tmp_path)
    assert [(r.id, r.framework, r.severity, r.references) for r in got] == [("A", "mine", "blocker", ("x",)), ("B", "mine", "info", ())]
    for bad in ("- a list", "rules: 3", "rules: [{id: A}]"):
        with pytest.raises(ValueError):
            rules.load_rules(bad)


def test_detectors_of_ones_own(spark):
    df = spark.createDataFrame([("case-12 of a@b.co",), (None,)], "t string")
    own = (detect.pattern_detector("CASE", r"case-\d+", 0.9), detect.udf_detector(lambda t: [("WORD", t.index(" of "), t.index(" of ") + 4, 0.5)], "model"))
    got = scan.scan(df, "t", detectors=own).collect()
    assert [(h.phi_type, h.start, h.end) for h in got[0].hits] == [("CASE", 0, 7), ("WORD", 7, 11), ("EMAIL", 11, 17)] and got[1].hits == []


def test_stores_by_policy(tmp_path):
    assert store.location(policy.load({"audit": {"backend": "sqlite", "path": "/x/e.db"}})) == "jdbc:sqlite:/x/e.db"
    assert store.location(policy.load({"audit": {"backend": "jsonl", "path": "/x/e.jsonl"}})) == "/x/e.jsonl"
    assert store.location(policy.load({})) is None and store.jdbc_url("/x/e.sqlite3") == "jdbc:sqlite:/x/e.sqlite3"
    with pytest.raises(ValueError):
        store.location(policy.load({"audit": {"backend": "tape"}}))


def test_key_providers(spark):
    import base64

    secret = bytes(range(32))
    env = keys.EnvironmentKey("K", environment={"K": base64.b64encode(secret).decode()})
    got = spark.range(1).select(keys.sign(F.lit("x"), env).alias("m")).first().m
    assert keys.verify(b"x", got, keys.GivenKey(secret)) and not keys.verify(b"y", got, env) and env.key_id == "env"
    assert len(keys.GivenKey().key()) == 32 and keys.GivenKey().key() != keys.GivenKey().key() and "secret" not in repr(keys.GivenKey())
    for bad in ({}, {"K": "abc"}, {"K": base64.b64encode(b"short").decode()}):
        with pytest.raises(ValueError):
            keys.EnvironmentKey("K", environment=bad)


def test_authorization_by_joined_keys(spark):
    sign = lambda key: hmac.new(key, b"go", hashlib.sha256).hexdigest()
    rows = [("go", "ann", sign(b"a")), ("go", "ann", sign(b"b")), ("go", "bob", sign(b"b")), ("go", "eve", sign(b"e")), ("go", None, sign(b"a")), (None, "ann", sign(b"a")), ("go", "ann", None)]
    df = spark.createDataFrame(rows, "action_name string, clinician_id string, signature string")
    got = device.authorize(df, {"ann": b"a", "bob": b"b"}).collect()
    assert sorted((r.clinician_id or "", r.authorized) for r in got) == [("", False), ("ann", False), ("ann", False), ("ann", False), ("ann", True), ("bob", True), ("eve", False)]
    assert not any(r.authorized for r in device.authorize(df, {}).collect())


def test_cached_scan_equals_plain(spark):
    df = spark.createDataFrame([(1, "a@b.co"), (2, "a@b.co"), (3, None), (4, "")], "i int, t string")
    got = metrics.scan_cached(df, "t", lambda d: d.withColumn("r", scan.plain_scan(F.col("t")))).orderBy("i").collect()
    assert [(r.i, r.t, r.r) for r in got] == [(1, "a@b.co", "[REDACTED:EMAIL]"), (2, "a@b.co", "[REDACTED:EMAIL]"), (3, None, None), (4, "", "")]


def test_rehydration_refuses_unknown_kinds(spark):
    def read(payload):
        return store.rehydrate(spark.createDataFrame([(payload,)], "payload string")).collect()

    assert read('{"event_id":"e","event_type":"tool_call","risk_tier":"advisory"}')[0].agent_id == "unknown"
    for bad in ('{"event_type":"nonsense"}', '{"risk_tier":"huge"}'):
        with pytest.raises(Exception, match="unknown (event_type|risk_tier)"):
            read(bad)


def test_report_page_and_lists(spark):
    row = {"session_id": "<s>", "gaps": 0, "mean_confidence": None}
    rule = {"framework": "f", "rule_id": "r", "severity": "info", "satisfied": False, "reason": "a < b"}
    page = report.to_html(row, [rule, rule | {"satisfied": True}], [{"phi_type": "SSN", "n": 2}], [{"event_type": "tool_call", "n": 3}])
    assert page.count("<table>") == 4 and "FAIL" in page and "PASS" in page and "a &lt; b" in page and "<s>" not in page and "None" not in page
    events = spark.createDataFrame([("s", 2, "b", 0.5), ("s", 1, "a", 0.0), ("s", 3, "c", None), ("t", 1, "d", None)], "session_id string, sequence_number long, event_id string, confidence_score double")
    assert {r.session_id: r.confidence_scores for r in report.confidences(events).collect()} == {"s": [0.0, 0.5], "t": []}


def _in_batches(spark, where, batches, schema):
    """A stream that takes the given rows batch by batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{where}/b{i}")
        for file in sorted((where / f"b{i}").glob("*.parquet")):
            (where / "in").mkdir(exist_ok=True)
            file.rename(where / "in" / f"{i}.parquet")
            import os

            os.utime(where / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(where / "in"))


def test_nonces_expire_after_the_watermark(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    batches = [[("s", "n", at(0))], [("s", "n", at(60))], [("s", "m", at(400))], [("s", "x", at(401))], [("s", "n", at(410))]]
    stream = _in_batches(spark, tmp_path, batches, "session_id string, nonce string, issued_at timestamp")
    got = sessions.run_available(sessions.token_dedup_stream(stream)).collect()
    assert sorted((r.nonce, (r.issued_at - at(0)).total_seconds()) for r in got) == [("m", 400.0), ("n", 0.0), ("n", 410.0), ("x", 401.0)]


def test_rolling_streams_keep_state_between_batches(spark, tmp_path):
    rng = random.Random(7)
    rows = [("s", i, i * 400_000_000, round(rng.random(), 3)) for i in range(60)]
    schema = "session_id string, event_id long, ts_us long, value double"
    stream = _in_batches(spark, tmp_path, [rows[:25], rows[25:31], rows[31:]], schema)
    got = {r.event_id: r.p95 for r in sessions.run_available(sessions.rolling_p95_stream(stream, 16)).collect()}
    assert got == {i: sorted(r[3] for r in rows[max(0, i - 15) : i + 1])[(min(i, 15)) * 95 // 100] for i in range(60)}
    got = {r.event_id: r.changes_in_hour for r in sessions.run_available(sessions.rate_limit_stream(stream, 2)).collect()}
    assert got == {i: min(i + 1, 10) for i in range(60)}


def test_replayed_batches_add_nothing(spark, tmp_path):
    schema = "event_id string, session_id string"
    batches = [[("a", "s"), ("b", "s"), ("a", "s")], [("b", "s"), ("c", "t")], [("c", "t"), ("d", "u")]]
    stream = _in_batches(spark, tmp_path, batches, schema)
    for within in (None, "session_id"):
        where = f"{tmp_path}/{within}"
        for turn in range(2):
            sessions.append_batches(stream, f"{where}/store", f"{where}/state{turn}", schema, within)
        assert sorted(map(tuple, sessions.read_appended(spark, f"{where}/store", schema).collect())) == [("a", "s"), ("b", "s"), ("c", "t"), ("d", "u")]


def test_reviews_fall_due_once(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    batches = [[(1, at(0), "pending"), (2, at(0), "pending")], [(2, at(1), "resolved"), (3, at(2), "pending")], [(4, at(5), "pending")], [(5, at(5.5), "pending")]]
    stream = _in_batches(spark, tmp_path, batches, "event_id long, at timestamp, status string")
    got = sessions.run_available(sessions.overdue_stream(stream, "at")).collect()
    assert [(r.event_id, r.enqueued) for r in got] == [(1, at(0))]


def _file(syntax, *elements):
    return bytes(128) + b"DICM" + _element(2, 16, b"UI", syntax.encode(), "<") + b"".join(elements)


def _element(group, number, kind, value, order="<", undefined=False):
    import struct

    head = struct.pack(order + "HH", group, number)
    size = 0xFFFFFFFF if undefined else len(value)
    if kind is None:
        return head + struct.pack(order + "I", size) + value
    if kind in (b"SQ", b"UN", b"OB"):
        return head + kind + bytes(2) + struct.pack(order + "I", size) + value
    return head + kind + struct.pack(order + "H", size) + value


def test_dicom_elements(spark):
    import zlib

    name = _element(0x10, 0x10, b"PN", b"DOE^J ")
    inner = _element(0xFFFE, 0xE000, None, name + _element(0xFFFE, 0xE00D, None, b""), undefined=True)
    nested = _element(8, 0x1140, b"SQ", inner + _element(0xFFFE, 0xE0DD, None, b""), undefined=True)
    closed = _element(8, 0x1140, b"SQ", _element(0xFFFE, 0xE000, None, name))
    pack = zlib.compressobj(9, zlib.DEFLATED, -15)
    deflated = pack.compress(name) + pack.flush()
    cases = [
        (None, []), (b"", []), (b"no dicom" * 40, []), (_file("1.2.840.10008.1.2.1"), []),
        (_file("1.2.840.10008.1.2.1", nested), []), (_file("1.2.840.10008.1.2.1", closed), []),
        (_file("1.2.840.10008.1.2.1", nested, name, _element(0x7FE0, 0x10, b"OB", bytes(100))), ["PatientName"]),
        (_file("1.2.840.10008.1.2", _element(8, 0x80, None, b"Clinic"), _element(0x10, 0x1010, None, b"044Y")), ["InstitutionName", "PatientAge"]),
        (_file("1.2.840.10008.1.2.2", _element(0x10, 0x20, b"LO", b"77", ">")), ["PatientID"]),
        (_file("1.2.840.10008.1.2.1.99", deflated), ["PatientName"]),
        (_file("1.2.840.10008.1.2.1", name, _element(0x10, 0x20, b"LO", b"77")[:5]), ["PatientName"]),
    ]
    got = dicom.scan_dicom(spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, (x, _) in enumerate(cases)], "i int, f binary"), "f").orderBy("i").collect()
    assert [[h.source for h in r.found] for r in got] == [[f"dicom:{k}" for k in want] for _, want in cases]
    assert [r.redacted for r in got] == ["[REDACTED:DICOM_DATASET]" if want else None for _, want in cases]


def test_vocabulary_table_equals_literal(spark):
    texts = ["Amoxicillin AMOXICILLIN Lisinopril Zzzpril", "none", "", None, "ZZZZ", "Metformin"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    words = ["amoxicillin", "METFORMIN", "metformin", None]
    table = spark.createDataFrame([(w,) for w in words], "term string")
    got = {r.i: r.s for r in grounding.vocabulary_share(df, "i", "t", fixed.DRUG_PATTERN, table, "s").collect()}
    want = {r.i: r.s for r in df.select("i", signals.hallucination(F.coalesce("t", F.lit("")), [w for w in words if w]).alias("s")).collect()}
    assert got == want == {0: 0.5, 1: -1.0, 2: -1.0, 3: -1.0, 4: 0.0, 5: 1.0}


def test_minimal_step(spark):
    step = scan.minimal("j", ["a"], "billing")
    got = spark.createDataFrame([('{"a":1,"b":2}',)], "j string").transform(step).first().j
    assert (got, step.allowed_fields, step.purpose) == ('{"a":1}', ("a",), "billing")


def test_ed25519_vectors():
    """The standard's first three vectors."""
    vectors = [
        ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
        ("c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7", "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
    ]
    for secret, public, message, signature in ([bytes.fromhex(x) for x in v] for v in vectors):
        assert ed25519.public_key(secret) == public and ed25519.sign(secret, message) == signature
        assert ed25519.verify(public, message, signature) and not ed25519.verify(public, message + b"x", signature)
        assert not ed25519.verify(public, message, signature[:63]) and not ed25519.verify(bytes(31), message, signature)
        assert not ed25519.verify(public, message, signature[:32] + (int.from_bytes(signature[32:], "little") + ed25519._L).to_bytes(32, "little"))
        assert ed25519.from_pem(ed25519.to_pem(public)) == public
    with pytest.raises(ValueError):
        ed25519.from_pem(b"-----BEGIN PUBLIC KEY-----\nAAAA\n-----END PUBLIC KEY-----")


def test_timed_keeps_a_budget():
    budget = metrics.Budget("scan", 1e9)
    assert metrics.timed(budget)(lambda x: x + 1)(1) == 2 and len(budget.samples) == 1 and budget.p95() < 1e9 and budget.holds()


def test_hostile_strings_are_linear(spark):
    import time

    texts = ["a." * 25_000, "%41" * 15_000, "1" * 50_000, "a" * 50_000, "(" * 50_000]
    begun = time.time()
    scan.scan(spark.createDataFrame([(t,) for t in texts], "t string"), "t").select("redacted").collect()
    assert time.time() - begun < 60


def test_redaction_modes(spark):
    t = F.lit("on March 3, 2024 and 2024-01-02 at 02139-4307")
    run = lambda mode: spark.range(1).select(redact.redact(t, detect.regex_hits(t), mode).alias("r")).first().r
    assert run("GENERALIZE") == "on [DATE_YEAR_UNKNOWN] and 2024 at 021**"
    assert run("SUPPRESS") == "on  and  at "
    digest = hashlib.sha256(b"session|ZIP|02139-4307").hexdigest()[:8]
    assert run("PSEUDONYMIZE").endswith(f"zip_{digest}")
    with pytest.raises(ValueError):
        run("HIDE")


def test_hmac(spark):
    for key in (b"k", b"x" * 100):
        got = spark.range(1).select(hmac_sha256(F.lit("mé"), key).alias("m")).first().m
        assert got == hmac.new(key, "mé".encode(), hashlib.sha256).hexdigest()


@pytest.mark.parametrize("text,want", [("confidence: 0%", 0.0), ("confidence: 100%", 1.0), ("Confidence 101%", -1.0), ("80% confident, confidence: 60 %", 0.7), ("none", -1.0)])
def test_self_reported(spark, text, want):
    assert spark.range(1).select(signals.self_reported(F.lit(text)).alias("v")).first().v == pytest.approx(want)


def test_composite_rules(spark):
    run = lambda **s: spark.range(1).select(signals.composite({k: F.lit(float(v)) for k, v in s.items()}).alias("v")).first().v
    assert run(self_reported=-1, grounding=-1) == 0.7
    assert run(self_reported=0, grounding=1) == pytest.approx(0.3 / 0.55)
    assert run(unknown=1) == 0.0
    with pytest.raises(ValueError):
        signals.composite({}, {"a": -1.0})
    with pytest.raises(ValueError):
        signals.composite({}, {"a": 0.0})


def test_temperature_fit_matches_a_grid(spark):
    rows = [(0.95, i % 2 == 0) for i in range(100)]
    df = spark.createDataFrame(rows, "p double, y boolean")
    t = calibrate.fit_temperature(df, "p", "y")
    losses = {g: calibrate.nll(df, "p", "y", g).first().nll for g in (t * 0.9, t, min(10.0, t * 1.1))}
    assert min(losses, key=losses.get) == t or t > 9.9
    with pytest.raises(ValueError):
        calibrate.fit_temperature(df.limit(0), "p", "y")


def test_calibration_of_nothing(spark):
    assert tuple(calibrate.calibrate_threshold(spark.createDataFrame([], "c double, y boolean"), "c", "y").first()) == (0.7, 0.0, 0.0, 0.0)


def test_unregistered_actions(spark):
    actions = spark.createDataFrame([("a", "informational")], "name string, tier string")
    df = spark.createDataFrame([("zz", 0.9), ("a", 0.59), ("a", 0.6)], "action string, score double")
    got = [(r.action, r.action_taken, r.channel) for r in routing.decide(df, actions, "action", "score").collect()]
    assert sorted(got) == [("a", "escalate", "human_review_queue"), ("a", "proceed", "proceed"), ("zz", "proceed", "proceed_with_annotation")]


def test_rule_language(spark):
    events = spark.createDataFrame([("s", 1, "e1", "x", "a", None, 0.0), ("s", 2, "e2", "x", "unknown", None, 0.5)], "session_id string, sequence_number long, event_id string, event_type string, agent_id string, risk_tier string, confidence_score double")
    texts = ["event_count == 2", "event_count in 2", "event_count >", "every_event.has(agent_id)", "every_event.has(confidence_score)", "every_event.has(nothing)", "no_such()", "1 + 1", "event_count != 2"]
    got = rules.evaluate(events, [rules.Rule(str(i), "", t) for i, t in enumerate(texts)]).collect()
    found = {int(r.rule_id): (r.satisfied, r.reason) for r in got}
    assert [found[i][0] for i in range(len(texts))] == [True, False, False, False, False, False, False, False, False]
    assert found[2][1].startswith("predicate parse error") and found[1][1].startswith("unsupported comparator") and found[7][1].startswith("unsupported predicate shape")
    assert found[3][1] == "1 event(s) missing agent_id"


def test_stream_chain_equals_batch(spark):
    from caduspark.plans import registry

    where = "/root/testdata/sf0.001"
    stream = registry.queries()["stream_chain"](spark, where).select("event_id", "sequence_number", "signature").collect()
    from caduspark.sources import adapters

    batch = chain.emit(adapters.conversation_events(spark.read.parquet(f"{where}/conversations.parquet")), registry.KEY)
    assert sorted(map(tuple, stream)) == sorted(map(tuple, batch.select("event_id", "sequence_number", "signature").collect()))


def test_long_sessions_are_linked_in_order(spark):
    fields = "session_id string, sequence_number long, event_id string, event_type string, agent_id string, input_hash string, risk_tier string, confidence_score double, ts_us long"
    rows = [(s, i, f"e{i % 30_000}", "tool_call", "a", "h", None, None, i) for s, n in (("s", 30_000), ("t", 3), (None, 2)) for i in range(n)]
    signed = chain.emit(spark.createDataFrame(rows, fields).repartition(7), b"k").persist()
    assert signed.count() == len(rows)
    assert all(r.ok for r in chain.verify(signed, b"k").where("session_id is not null").collect())
    first = signed.where("session_id = 't'").orderBy("sequence_number").collect()
    assert [r.prev_event_hash for r in first] == ["", first[0].event_hash, first[1].event_hash] and [r.sequence_number for r in first] == [1, 2, 3]
    assert chain.emit(spark.createDataFrame([], fields), b"k").count() == 0
    signed.unpersist()


def test_dose_edges(spark):
    ranges = spark.createDataFrame([("a", 1.0, 2.0, 0)], "parameter string, min double, max double, place int")
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.1), ("a", float("nan")), ("a", float("inf")), ("b", 1.0), ("a", None)], "p string, v double")
    assert [r.dose_ok for r in device.validate_dose(df, ranges, "p", "v").collect()] == [True, True, False, False, False, False, False]
    assert [r.dose_ok for r in device.validate_dose(df, ranges.limit(0), "p", "v").collect()] == [True, True, True, False, False, True, False]


def test_rate_limit_edge(spark):
    df = spark.createDataFrame([("s", 1, 0), ("s", 2, 3_600_000_000), ("s", 3, 3_600_000_001), ("s", 4, 3_600_000_001)], "session_id string, event_id long, ts_us long")
    got = {r.event_id: r.changes_in_hour for r in device.rate_limit(df, 2).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 3}


def test_p95_index(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(10)], "s string, i int, v double")
    assert metrics.rolling_p95(df, "s", "i", "v").orderBy(F.desc("i")).first().p95 == 8.0


def test_p95_equals_sorted_windows(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([None, float("nan"), float("inf"), 1.0, round(rng.random(), 2)])) for k in ("a", "b", None) for i in range(120)]
    df = spark.createDataFrame(rows, "s string, i int, v double")
    got = {(r.s, r.i): r.p95 for r in metrics.rolling_p95(df, "s", "i", "v", 16).collect()}
    for k, i, _ in rows:
        held = sorted((v for s, j, v in rows if s == k and i - 16 < j <= i and v is not None), key=lambda v: (v != v, v))
        want = held[(len(held) - 1) * 95 // 100] if held else 0.0
        assert got[k, i] == want or (want != want and got[k, i] != got[k, i])


def test_paths(spark):
    edges = spark.createDataFrame([("t", 1, "a", "b"), ("t", 2, "b", "c"), ("t", 3, "x", "y"), ("u", 1, "a", "b")], "tag_id string, ord int, src string, dst string")
    known = spark.createDataFrame([("t", "a"), ("w", "q")], "tag_id string, origin_agent string")
    assert {r.tag_id: r.path for r in propagation.paths(edges, known).collect()} == {"t": ["a", "b", "c", "x", "y"], "w": ["q"]}


def test_malformed_lines(spark, tmp_path):
    path = tmp_path / "e.jsonl"
    path.write_text('{"session_id":"s","sequence_number":1}\n\nnot json\n')
    assert [r.session_id for r in store.list_sessions(store.read_jsonl(spark, str(path), strict=False)).collect()] == ["s"]
    with pytest.raises(Exception):
        store.read_jsonl(spark, str(path)).collect()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "s1.jsonl").write_text("{}\n")
    assert [r.session_id for r in store.sessions_of_files(spark, str(tmp_path / "d")).collect()] == ["s1"]


def test_policy():
    assert policy.load({}).thresholds["advisory"] == 0.8
    p = policy.load("phi:\n  mode: SUPPRESS\nmeddevice:\n  dose_ranges:\n    - {parameter: a, min: 1, max: 2}\n", {"CADUSPARK_ESCALATION__THRESHOLDS__ADVISORY": "0.9"})
    assert (p.mode, p.thresholds["advisory"], p.dose_ranges) == ("SUPPRESS", 0.9, (("a", 1.0, 2.0),))
    for bad in ({"x": {}}, {"phi": {"mod": 1}}, {"phi": {"mode": "HIDE"}}, {"escalation": {"thresholds": {"advisory": 2}}}, {"meddevice": {"dose_ranges": [{"parameter": "a", "min": 2, "max": 1}]}}, {"phi": {"max_depth": 0}}):
        with pytest.raises(ValueError):
            policy.load(bad)


def test_library_without_llm():
    import pathlib

    for path in pathlib.Path(__file__).parent.parent.joinpath("caduspark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "caduspark.llm" not in path.read_text(), path
