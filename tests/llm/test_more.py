"""Cases beside test_llm.py: independent expectations, clashing columns, empty tables, long texts, the registered queries."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from caduspark.llm import bpe_ids, html_mincut, minhash_neardup, packing, quality, queries, shared, sp_codec, substring_dedup, textnum, toxicity

DIR = "/root/testdata/sf0.001"
LONG = [(1, "y" * 200_000), (2, "x " * 60_000), (3, "word " * 40 + "é" * 90_000), (3, "word " * 40 + "é" * 90_000), (None, "null id"), (4, None)]


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


# --- shared ---------------------------------------------------------------------------------------------


def test_skew_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 500), (2, 11), (3, 10), (4, 1), (5, 1)) for i in range(n)], "k long, i long")
    facts = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 5")
    got = shared.skew_join(rows, facts, ["k"], rows.count())
    assert sorted(map(tuple, got.select("k", "i", "n").collect())) == sorted(map(tuple, rows.join(facts, "k").select("k", "i", "n").collect()))


def test_hashes_do_not_depend_on_slabs():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(3000)).encode()
    data = np.frombuffer(text, np.uint8)
    start, end, _ = textnum.bounds(data, np.array([0, len(data)]))
    whole = textnum.spans(data, start, end)
    assert (textnum.spans(data, start, end, slab=64) == whole).all()
    seen = {}
    for a, b, h in zip(start.tolist(), end.tolist(), whole.tolist()):
        assert seen.setdefault(text[a:b], h) == h
    assert len(set(seen.values())) == len(seen)


def test_clashing_columns_keep_their_values(spark):
    df = spark.createDataFrame([(1, "some text", 7, "a", "b")], "doc_id long, text string, Score int, ids string, main_text string")
    blank = quality.Attention(0.5, np.zeros(0), np.zeros(0), None)
    got = quality.score(df, blank).collect()[0].asDict()
    assert got["Score_in"] == 7 and got["score"] == 0.5
    assert toxicity.score(df, toxicity.fit([])).collect()[0]["Score_in"] == 7
    assert sp_codec.encode(df, public_tokenizers.path("piece_bpe_32k.model")).collect()[0]["ids_in"] == "a"
    assert html_mincut.extract_text(df, "text").collect()[0]["main_text_in"] == "b"


# --- op2, op3, op7: long texts, repeated rows ------------------------------------------------------------


def test_long_texts(spark):
    df = frame(spark, LONG)
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()), key=repr)
    assert got == sorted([(1, 1, 0), (2, 60_000, 60_000), (3, 41, 41), (3, 41, 41), (None, 2, 0), (4, 0, 0)], key=repr)
    classes = {r.doc_id: r.component_id for r in minhash_neardup.near_duplicates(df).collect()}
    assert classes == {1: 1, 2: 2, 3: 3, 4: 4, None: None}
    pieces = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3, 4, None}


def test_one_id_with_two_texts_loses_neither(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = frame(spark, [(1, a), (1, b), (1, b), (2, a), (3, "c")])
    assert sorted((r.doc_id, r.text) for r in minhash_neardup.drop_duplicates(df).collect()) == [(1, a), (1, b), (3, "c")]


def test_near_duplicates_are_the_planted_groups(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(120, 300))]
        first = len(rows)
        for _ in range(rng.choice([1, 2, 2, 6])):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "other"  # at most 10 of 116 and more shingles differ between two copies
            want[len(rows)] = first
            rows.append((len(rows), " ".join(copy)))
    got = {r.doc_id: r.component_id for r in minhash_neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == want


# --- op6 ------------------------------------------------------------------------------------------------


def test_transitions_give_the_merges():
    pieces = sp_codec.codec(public_tokenizers.path("piece_bpe_32k.model")).pieces
    assert pieces.chained
    rng = random.Random(4)
    words = ["▁" + "".join(rng.choice("etaoinshrdlu▁é日x.,") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for some in by_length.values():
        codes = np.array([[ord(c) for c in w] for w in some], np.uint32)
        table, ends = pieces.segment(codes)
        assert (ends == pieces._merge(table)[0]).all()


def unigram_model(path, fallback):
    """A unigram model with the library's NFKC rules, made by hand."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    rng = random.Random(5)
    model = pb.ModelProto()
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    names = ["▁", *"abcdefgh"] + sorted({m + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for m in ("▁", "") for _ in range(300)})
    pieces += [(n, -rng.uniform(2, 12), 1) for n in names]
    for name, score, kind in pieces:
        model.pieces.add(piece=name, score=score, type=kind)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback, model.trainer_spec.unk_id = 1, fallback, 0
    rules = pb.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()).normalizer_spec
    model.normalizer_spec.CopyFrom(rules)
    model.normalizer_spec.add_dummy_prefix = model.normalizer_spec.remove_extra_whitespaces = model.normalizer_spec.escape_whitespaces = True
    path.write_bytes(model.SerializeToString())
    return str(path)


@pytest.mark.parametrize("fallback", [False, True])
def test_unigram_model_with_a_character_map(tmp_path, fallback):
    path = unigram_model(tmp_path / "u.model", fallback)
    codec = sp_codec.Codec(path)
    assert codec.own and not codec.plain and codec.pieces.unigram
    rng = random.Random(6)
    texts = ["", "  ", "ａｂｃ  ﬁ", "a▁b", "zz日本zz a", "\tab\n cd"] + ["".join(rng.choice("abcdefgh   zｈé") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    ids, sizes = codec.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    want = [codec.library.encode(t) for t in texts]
    assert [sorted(x) for x in got] == [sorted(x) for x in want]  # pieces that swap places tie but for rounding
    assert sum(a != b for a, b in zip(got, want)) <= 3
    assert codec.decode(ids.astype(np.int64), sizes) == [codec.library.decode(x) for x in got]


# --- op9 ------------------------------------------------------------------------------------------------


def test_passages_do_not_see_their_neighbours():
    text = "One line of words.\nAnd another one. " * 9
    alone = quality.passages(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[1]
    beside = ["\n\n ", text, " \n\n\n", "", "\n\nWords"]
    raw = [t.encode() for t in beside]
    counts, x = quality.passages(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert (x[1 : 1 + counts[1]] == alone).all() and counts.tolist() == [1, len(alone), 1, 1, 1]


def test_random_letters_are_no_prose(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, marks)
    good = [r.text for r in docs.join(marks.where("quality = 1"), "doc_id").where("length(text) > 400").orderBy("doc_id").limit(80).collect()]
    rng = random.Random(7)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c for c in t) for t in good]
    assert np.mean(model.score_array(pa.array(good)) >= 0.7) > 0.97
    assert np.mean(model.score_array(pa.array(noise)) >= 0.7) < 0.1


# --- op10 -----------------------------------------------------------------------------------------------

BODY = "<h1>Head line</h1>" + "".join(f"<p>This is sentence number {i} of the article, which tells the story well.</p>" for i in range(9))
WHOLE = "\n\n".join(["Head line", *(f"This is sentence number {i} of the article, which tells the story well." for i in range(9))])


@pytest.mark.parametrize(
    "page",
    [
        f'<html><body class="single-post no-sidebar"><article>{BODY}</article></body></html>',
        f'<body><div class="has-sidebar"><article>{BODY}</article></div></body>',
        f'<html><body class="logged-in menu-open"><article>{BODY}</article></body></html>',
        f'<body><form id="aspnetForm"><div><article>{BODY}</article></div><input></form></body>',
        f'<body><div id="page-content-bottom"><article>{BODY}</article></div></body>',
        f'<body><aside class="sidebar"><article><p>A teaser of another story that people like to read.</p></article></aside><main>{BODY}</main></body>',
    ],
)
def test_wrappers_are_no_boilerplate(page):
    assert html_mincut.extract(page, list(html_mincut.classifier())) == WHOLE


def test_inline_adverts_go_and_formulas_stay():
    page = '<article><p>Some text <span class="ad">Buy <b>now</b></span>goes on here, as it should in any article.</p><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be a number, and so the text goes on.</p></article>'
    want = "Some text goes on here, as it should in any article.\n\nLet x=2 be a number, and so the text goes on."
    assert html_mincut.extract(page, list(html_mincut.classifier())) == want


def test_deep_pages_are_linear():
    weights = list(html_mincut.classifier())
    assert html_mincut.extract("<div>" * 20_000 + "</p></span>x" * 20_000, weights) is not None


# --- queries and stages ----------------------------------------------------------------------------------

SHAPES = {
    "op1_exact_topk": ("embeddings", {"query_id", "rank", "vec_id", "score"}),
    "op2_substring_dedup": ("documents", {"doc_id", "n_words", "n_removed", "kept_sha256"}),
    "op3_packing": ("documents", {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}),
    "op4_embedding_neardup": ("embeddings", {"vec_id", "n_links", "component_id", "kept"}),
    "op5_toxicity": ("documents", {"doc_id", "held_out", "score", "predicted"}),
    "op6_sentencepiece": ("documents", {"doc_id", "n_tokens", "ids_crc32", "decoded_hash", "round_trip"}),
    "op7_minhash_neardup": ("documents", {"doc_id", "component_id", "kept"}),
    "op8_hilbert_sharding": ("documents", {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}),
    "op9_quality": ("documents", {"doc_id", "held_out", "score", "predicted"}),
    "op10_html_extraction": ("pages", {"page_id", "url", "text", "n_chars"}),
}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_registered_queries(spark, name):
    table, columns = SHAPES[name]
    got = queries.queries()[name](spark, DIR)
    assert columns <= set(got.columns)
    rows, n = got.count(), spark.read.parquet(f"{DIR}/{table}.parquet").count()
    assert rows == n if name not in ("op1_exact_topk", "op3_packing") else rows > 0


def test_stages_of_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0, name


def test_links_of_long_texts_in_many_pairs_stay_in_bounded_memory():
    rng = np.random.Generator(np.random.PCG64(5))
    common = rng.integers(0, 2**63, 12_000, dtype=np.uint64)
    sets = []
    for k in range(30):  # texts 0 and 1 share nearly all of their shingles, all others 60 % of them
        own = sets[0][0][:-9] if k == 1 else np.concatenate([common, rng.integers(0, 2**63, 8_000, dtype=np.uint64)])
        sets.append((np.unique(own), np.ones(len(np.unique(own)))))
    i, j = np.triu_indices(30, 1)
    tracemalloc.start()
    got = minhash_neardup.links_of(np.arange(30), sets, i, j, np.full(len(i), 20), 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(0, 1)]
    assert peak < 200e6, f"{peak / 1e6:.0f} MB"


def test_packing_needs_no_python_workers_for_its_places(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    out = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "LogicalRDD" not in plan
    assert out.count() == 2


def test_the_whole_tokenizer_is_read_only_where_a_text_needs_it():
    encoder = bpe_ids.Encoder(public_tokenizers.path("byte_bpe_50k.json"))

    def ids(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return encoder.encode(data, np.array([0, len(data)]))[0].tolist()

    plain, odd = "Some plain  words,\nand one more.", "one odd space"
    got = ids(plain)
    assert "whole" not in vars(encoder)
    assert got == encoder.whole.encode(plain, add_special_tokens=False).ids
    assert ids(odd) == encoder.whole.encode(odd, add_special_tokens=False).ids
