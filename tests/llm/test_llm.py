"""The training-data operators against brute force, exact round trips and held-out accuracy, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from caduspark.llm import bpe_ids, embed_neardup, hilbert_shard, html_mincut, labels, minhash_neardup, packing, quality, queries, shared, sp_codec, substring_dedup, textnum, topk_vafile, toxicity

DIR = "/root/testdata/sf0.001"
TEXTS = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two three four"), (6, "Ünï çödé 日本 text"), (7, "x " * 30_000), (8, "y" * 200_000)]


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- op1 ------------------------------------------------------------------------------------------------


def brute_topk(rows, k=5):
    fit = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fit[i] = min(fit.get(i, [math.floor(256 * x) for x in v]), [math.floor(256 * x) for x in v])
    out = []
    for q in fit:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(fit[q], v)), i) for i, v in fit.items() if i != q and len(v) == len(fit[q]))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_topk(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(160)]
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, rows[3][1]), (250, None), (300, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (350, [float("nan")] * 6), (400, [float("inf")] * 6), (None, rows[0][1])]
    rows += [(450, [1.0, 2.0]), (451, [3.0, 4.0]), (500, []), (550, [1e30] * 6), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, vector int")
    plain = [(i, v) for i, v in rows if i != 550]
    got = sorted(map(tuple, topk_vafile.top_k(df.where("vec_id is null or vec_id <> 550")).collect()))
    assert got == brute_topk(plain)
    assert topk_vafile.top_k(df).count() > 0  # beyond 53 bits
    assert topk_vafile.top_k(df.limit(0)).count() == 0


def test_topk_sql_twin_matches(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DIR}/embeddings.parquet'")
    want = sorted(con.execute(queries.oracle_sql()["op1_exact_topk"]).fetchall())
    got = sorted(map(tuple, queries.op1_exact_topk(spark, DIR).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == want


# --- op2 ------------------------------------------------------------------------------------------------


def brute_repeats(rows, window):
    seen = Counter()
    for _, t in rows:
        w = words(t)
        seen.update(tuple(w[j : j + window]) for j in range(len(w) - window + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup(spark):
    rng = random.Random(2)
    pool = ["a", "b", "c", "dd", "é", "the"] + [f"w{i}" for i in range(40)]
    passage = " ".join(rng.choice(pool) for _ in range(60))
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 120)))) for i in range(60)]
    rows += [(100 + i, f"{rows[i][1]} {passage}\n{rows[i + 1][1]}") for i in range(20)]
    rows += [(200, passage), (200, passage), (201, "r " * 100), (None, passage), (202, " ".join(passage.split()[5:45]))] + TEXTS[:7]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, runs int")
    got = sorted(map(tuple, substring_dedup.remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)
    assert got == brute_repeats(rows, 35)
    small = substring_dedup.remove_repeats(df, window=6, seed=3).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, small), key=repr) == brute_repeats(rows, 6)
    assert "kept_in" in substring_dedup.remove_repeats(df.limit(0)).columns
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


# --- op3 ------------------------------------------------------------------------------------------------

BPE = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BPE)
    whole.encode_special_tokens = True
    rng = random.Random(3)
    texts = [t for _, t in TEXTS[:7]] + ["it's  'x' don't\n  I'll", "a b  c", "<|endoftext|>", "日本 語\x1cb", " lead", "trail  ", "\n\na\t b"]
    texts += ["".join(rng.choice(" \n\tab1'.é  sll") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    got = []
    for lo, hi, ids, counts in bpe_ids.encode_array(BPE, pa.array(texts)):
        ends = np.concatenate([[0], np.cumsum(counts)])
        got += [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
    assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BPE)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").unionByName(frame(spark, [(10**6 + i, t) for i, t in TEXTS[:7]])).withColumn("length", F.lit(1))
    pieces = packing.pack(docs, BPE, with_ids=True).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        assert zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 and len(p.ids) == p.length
    assert set(by_doc) == set(texts)
    for i, some in by_doc.items():
        some.sort(key=lambda p: p.start)
        ids = [x for p in some for x in p.ids]
        assert ids == whole.encode(texts[i] or "", add_special_tokens=False).ids + [1]
        assert all(p.doc_tokens == len(ids) for p in some)
    for some in by_sequence.values():
        some.sort(key=lambda p: p.offset)
        assert [p.offset for p in some] == [sum(q.length for q in some[:k]) for k in range(len(some))]
        assert sum(p.length for p in some) <= 2048
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert sum(p.length for p in pieces) / (2048 * len(by_sequence)) > 0.99
    assert packing.pack(docs.limit(0), BPE).count() == 0


def test_packing_patterns_use_every_piece():
    rng = random.Random(4)
    for _ in range(20):
        histogram = {rng.choice([rng.randint(1, 63), 64 * rng.randint(1, 31), 2048]): rng.randint(1, 500) for _ in range(rng.randint(1, 40))}
        found = packing.patterns(histogram, 2048)
        used = Counter()
        for pattern, times in found:
            assert sum(s * k for s, k in pattern) <= 2048 and times > 0
            for s, k in pattern:
                used[s] += k * times
        assert used == Counter(histogram)


# --- op4 ------------------------------------------------------------------------------------------------


def brute_links(rows, threshold=0.93):
    n, parent = Counter(), {i: i for i, _, _ in rows}
    fit = [(i, v, lab) for i, v, lab in rows if v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, v, lab) in enumerate(fit):
        for j, w, lab2 in fit[:k]:
            if lab == lab2 and len(v) == len(w):
                a, b = np.array(v), np.array(w)
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold:
                    n[i] += 1
                    n[j] += 1
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    return sorted((i, n[i], root(i), root(i) == i) for i in parent)


@pytest.mark.parametrize("block", [1024, 16])
def test_embedding_neardup(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for lab in range(3):
        base = rng.normal(size=(30, 16))
        for b in base:
            for _ in range(rng.integers(1, 5)):
                rows.append((b + rng.normal(size=16) * rng.choice([0, 0.05, 0.25])).tolist() + [lab])
    hot = rng.normal(size=16)
    rows += [(hot + rng.normal(size=16) * 0.05).tolist() + [1] for _ in range(120)]  # larger than several blocks
    rows = [(i, r[:16], r[16]) for i, r in enumerate(rows)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, rows[0][1], None), (903, [float("nan")] * 16, 1), (904, [None] + [1.0] * 15, 1), (905, [1.0], 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, block int")
    got = sorted(map(tuple, embed_neardup.near_duplicates(df, block=block).collect()))
    want = brute_links(rows)
    wrong = sum(a != b for a, b in zip(got, want))
    assert len(got) == len(want) and wrong <= (0 if block == 1024 else 3)
    assert embed_neardup.near_duplicates(df.limit(0)).count() == 0
    assert [tuple(r) for r in embed_neardup.near_duplicates(df.limit(1).select(F.lit(None).cast("long").alias("vec_id"), "embedding", "label")).collect()] == [(None, 0, None, None)]


def test_large_noisy_groups_are_counted_in_full(spark):
    rng = np.random.default_rng(11)
    hot, side = rng.normal(size=16), rng.normal(size=16) * 3
    rows = [(hot + rng.normal(size=16) * 0.2).tolist() for _ in range(400)]  # a third of all rows
    rows += [(side + rng.normal(size=16)).tolist() for _ in range(400)]  # all lean to one side, few are linked
    rows += [rng.normal(size=16).tolist() for _ in range(400)]
    rows = [(i, v, 1) for i, v in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = np.array([v for _, v, _ in rows])
    x /= np.sqrt((x * x).sum(1))[:, None]
    links = x @ x.T >= 0.93
    root = np.arange(len(x))
    while (low := np.where(links, root[None, :], len(x)).min(1)).tolist() != root.tolist():
        root = low
    got = sorted(map(tuple, embed_neardup.near_duplicates(df, block=16).collect()))
    assert got == [(i, int(links[i].sum()) - 1, int(root[i]), bool(root[i] == i)) for i in range(len(x))]


@pytest.mark.parametrize("largest", [10**4, 10**6, 10**8, 10**9])
def test_passes_keep_the_miss_rate(largest):
    agree = (1 - math.acos(0.93) / math.pi) ** (math.ceil(math.log2(largest / 1024)) + 1)
    assert (1 - agree) ** embed_neardup.passes_for(largest, 0.93, 1024) <= embed_neardup.MISS


# --- op5, op9 -------------------------------------------------------------------------------------------


def test_toxicity_on_held_out(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, marks)
    held = docs.join(marks, "doc_id").where(labels.fold_of(F.col("doc_id"), 5) == 0)
    got = toxicity.score(held.select("doc_id", "text", "toxic"), model).collect()
    hit = [r.score >= 0.5 for r in got if r.toxic == 1]
    false = [r.score >= 0.5 for r in got if r.toxic == 0]
    assert np.mean(hit) > 0.85 and np.mean(false) < 0.01
    edge = toxicity.score(frame(spark, TEXTS), model).collect()
    assert all(0 <= r.score <= 1 for r in edge) and len({r.score for r in edge if r.doc_id in (1, 2, 3)}) == 1
    empty = toxicity.train(docs, marks.limit(0))
    assert toxicity.score(frame(spark, TEXTS), empty).where("score < 0.5").count() == len(TEXTS)


def test_factorization_machine_learns_a_pair():
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(600):
        a, b = rng.random(2) < 0.5
        rows.append((float(a and b), np.array(sorted({1} | ({100} if a else set()) | ({200} if b else set())))))
    m = toxicity.fit(rows, steps=400)
    place = {int(v): i for i, v in enumerate(m.buckets)}
    run = lambda *t: m.scores(np.zeros(len(t), int), np.array([place[x] for x in t], int), 1)[0]
    assert run(100, 200) > 0.5 > max(run(100), run(200))


def test_quality_on_held_out(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, marks)
    held = docs.join(marks, "doc_id").where(labels.fold_of(F.col("doc_id"), 4) == 2)
    got = quality.score(held.select("doc_id", "text", "quality"), model).collect()
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in got]) > 0.98
    edge = quality.score(frame(spark, TEXTS), model).collect()
    assert all(0 <= r.score <= 1 for r in edge) and len({r.score for r in edge if r.doc_id in (1, 2, 3)}) == 1
    assert quality.score(frame(spark, TEXTS), quality.train(docs, marks.limit(0))).count() == len(TEXTS)


# --- op6 ------------------------------------------------------------------------------------------------

SP = public_tokenizers.path("piece_bpe_32k.model")


def test_sentencepiece_equals_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=SP)
    rng = random.Random(7)
    texts = [t for _, t in TEXTS[:7]] + ["a;\r\n } \x0b b", "日本 語 😀 x", "\x00y", "foo ▁ bar", "a" * 300 + " " * 50 + "b" * 70, "<s> </s> <0x0A>", " z"]
    texts += ["".join(rng.choice("  \n\tabcdeé.s") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    df = frame(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in sp_codec.decode(sp_codec.encode(df, SP), SP).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == library.encode(t or ""), t
        assert got[i].decoded == library.decode(got[i].ids)
        if "▁" not in (t or ""):
            assert got[i].decoded == (t or "")
    assert sp_codec.encode(df.limit(0), SP).count() == 0


def test_viterbi_finds_the_best_sum():
    names = ["<unk>", "a", "b", "ab", "ba", "aba", "c"]
    scores = [0.0, -1.0, -1.2, -1.5, -2.9, -3.1, -4.0]
    pieces = sp_codec.Pieces(names, scores, [n != "<unk>" for n in names], None, 0, True)
    rng = random.Random(8)
    units = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(200)]

    def best(u):
        if not u:
            return 0.0
        return max((scores[names.index(u[:k])] if u[:k] in names[1:] else (float(pieces.missing) if k == 1 else -1e9)) + best(u[k:]) for k in range(1, min(3, len(u)) + 1))

    flat, sizes = pieces.encode(units)
    for u, ids in zip(units, np.split(flat, np.cumsum(sizes)[:-1])):
        assert sum(scores[i] if i else float(pieces.missing) for i in ids) == pytest.approx(best(u), abs=1e-4)


# --- op7 ------------------------------------------------------------------------------------------------


def brute_classes(rows, threshold=0.8):
    sets = []
    df = np.zeros(1 << minhash_neardup.FEATURE_BITS, int)
    for _, t in rows:
        data = (t or "").encode()
        _, h, c, _ = minhash_neardup.shingles(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        df[np.unique(minhash_neardup.feature(h))] += 1
        sets.append((h, c))
    idf = 1 + np.log((1 + len(rows)) / (1 + df))
    weights = [dict(zip(h.tolist(), (c * idf[minhash_neardup.feature(h)]).tolist())) for h, c in sets]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, _) in enumerate(rows):
        for m in range(k):
            a, b = weights[k], weights[m]
            both = sum(min(a[x], b[x]) for x in a.keys() & b.keys())
            if both and both / (sum(a.values()) + sum(b.values()) - both) >= threshold:
                x, y = root(i), root(rows[m][0])
                parent[max(x, y)] = min(x, y)
    return sorted((i, root(i), root(i) == i) for i in parent)


def test_minhash_neardup(spark, monkeypatch):
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(40):
        base = [rng.choice(pool) for _ in range(rng.randint(30, 150))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(pool)
            rows.append((len(rows), " ".join(copy)))
    base = [rng.choice(pool) for _ in range(200)]
    for _ in range(60):  # one group that fills several blocks
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(pool)
        rows.append((len(rows), " ".join(copy)))
    rows += [(900 + i, t) for i, t in TEXTS[:6]] + [(950, rows[0][1].upper()), (951, rows[0][1]), (952, "one two three four")]
    monkeypatch.setattr(minhash_neardup, "BLOCK", 16)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, band int")
    got = sorted(map(tuple, minhash_neardup.near_duplicates(df).collect()))
    assert got == brute_classes(rows)
    twice = df.unionByName(df.limit(3))
    kept = minhash_neardup.drop_duplicates(twice)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in minhash_neardup.near_duplicates(twice).where("kept").collect())
    assert kept.columns == df.columns
    assert minhash_neardup.near_duplicates(df.limit(0)).count() == 0


def test_consistent_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(10)
    h = rng.integers(1, 2**63, 400, dtype=np.uint64)
    a, b = rng.uniform(0.5, 3, 400), rng.uniform(0.5, 3, 400)
    drawn = [minhash_neardup.sample(np.zeros(400, int), h, w, 1, 200)[0] for w in (a, b)]
    assert np.mean(drawn[0] == drawn[1]) == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.12)


# --- op8 ------------------------------------------------------------------------------------------------


def test_hilbert_curve_steps_by_one(spark):
    points = spark.range(4096).select(*[(F.floor(F.col("id") / 8**k) % 8).cast("int").alias(f"x{k}") for k in range(4)])
    got = points.withColumn("h", hilbert_shard.hilbert_index([F.col(f"x{k}") for k in range(4)], 3)).orderBy("h").collect()
    assert [r.h for r in got] == list(range(4096))
    assert all(sum(abs(a[i] - b[i]) for i in range(4)) == 1 for a, b in zip(got, got[1:]))


def test_sharding(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    docs = docs.unionByName(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes[2:]]))
    docs = docs.unionByName(docs.limit(5)).withColumn("size", F.lit("x"))
    got = hilbert_shard.shard(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        raw = None if texts[r.doc_id] is None else texts[r.doc_id].encode()
        assert r.size == len(raw or b"") + 1 and r.text_crc32 == (None if raw is None else zlib.crc32(raw))
    total, most = sum(r.size for r in got), max(r.size for r in got)
    for s in range(16):
        some = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in some) == list(range(len(some)))
        assert abs(sum(r.size for r in some) - total / 16) <= most
    assert hilbert_shard.shard(docs.limit(0)).count() == 0


def test_sharding_tells_long_texts_apart(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    curves = lambda df: {int(str(r.doc_id)[-8:]): r.curve for r in hilbert_shard.shard(df).collect()}
    want = curves(docs)
    assert curves(docs.withColumn("source", F.concat(F.lit("https://www.example.org/"), "source"))) == want
    assert curves(docs.withColumn("doc_id", F.concat(F.lit("document-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")))) == want
    assert len(curves(docs.withColumn("source", F.lit(None).cast("string")))) == len(want)


# --- op10 -----------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site better.</div><article><h1>A &amp; B</h1><p>First   paragraph with <a href="/x">a link</a> inside it.<p>Second one.<br>Same block.</p>
<div class="ad">Buy now, it is cheap.</div><p>Be.</p></article><aside class="sidebar"><p>More stories that people like.</p></aside>
<section id="comments"><p>I think that this article is very good, thanks for it.</p></section><form><label>Mail</label><input></form><footer>&copy; 2024 Site</footer></body></html>"""


def test_html_extraction(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "plain words only, long enough to be a text of its own."), (5, "<p>a<!-- open"), (6, "<article><p>cut off in the mid"), (7, "<" * 5000), (8, "<div>" * 3000 + "deep")], "page_id long, html string")
    got = {r.page_id: r.main_text for r in html_mincut.extract_text(df).collect()}
    assert got[1] == "A & B\n\nFirst paragraph with a link inside it.\n\nSecond one. Same block.\n\nBe."
    assert got[2] == got[3] == "" and got[6] == "cut off in the mid"
    assert html_mincut.extract_text(df.limit(0)).count() == 0


def test_cut_is_minimal():
    rng = random.Random(11)
    for _ in range(200):
        n = rng.randint(1, 9)
        cost = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 2)) for _ in range(rng.randint(0, 14))]
        price = lambda lab: sum(-c if x else c for c, x in zip(cost, lab)) / 2 + sum(w for a, b, w in edges if lab[a] != lab[b])  # noqa: B023, E731
        best = min(price([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert price(html_mincut.minimum_cut(cost, edges)) == pytest.approx(best)


# --- shared, pipeline -----------------------------------------------------------------------------------


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (5, 6)], "a long, b long")
    got = dict(map(tuple, shared.connected_components(edges).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}}
    assert shared.connected_components(edges.limit(0)).count() == 0


def test_words_are_exact():
    texts = pa.array(["a b", None, "", "  x\ty ", "é\nz", "last"])
    got = []
    for lo, hi, data, offsets in textnum.pieces(texts, 4):
        w = textnum.Words(data, offsets)
        for i in range(hi - lo):
            got.append([data[w.start[k] : w.end[k]].tobytes().decode() for k in range(w.first[i], w.first[i + 1])])
    assert got == [words(t) for t in texts.to_pylist()]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = shared.write_table(stage(spark, docs, DIR), f"t_{name}")
        if name != "packing":
            assert out.columns == columns
            counts.append(out.count())
            docs = out
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4]
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, DIR).count() == out.count()
    odd = frame(spark, TEXTS).selectExpr("doc_id", "text", "'en' lang", "'s' source", "length(text) n_chars").limit(6)
    assert all(stage(spark, odd, DIR).count() >= 0 for _, stage in corpus_pipeline.STAGES)
