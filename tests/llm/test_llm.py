"""The training-data operators against brute force, round trips and odd inputs."""

import gzip
import hashlib
import io
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakweave.llm import bpe, chat, components, embed_dedup, exact_dedup, jaccard, licenses, mixing, quality, sharding, warc

DOCS = "doc_id long, text string, source string, lang string, n_chars long, id string, digest string, uid string, n long"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, s, "en", len(t or ""), "x", "y", "z", 7) for i, t, s in rows], DOCS)


def test_exact_dedup_nulls_ties_and_repeats(spark):
    df = docs(spark, [(1, "Ab", "a"), (5, "aB", "a"), (2, None, None), (9, "", "b"), (3, "É", "a"), (4, "é", "a"), (5, "aB", "a"), (None, "q", "a")])
    got = exact_dedup.exact_dedup(spark, df).collect()
    by = {}
    for r in got:
        by.setdefault(r.digest, []).append(r)
    group = by[hashlib.sha256(b"ab").hexdigest()]
    assert {r.keep_id for r in group} == {5} and {r.group_size for r in group} == {3} and sum(r.kept for r in group) == 1
    assert {r.keep_id for r in by[hashlib.sha256(b"").hexdigest()]} == {9}
    assert len(by) == 5 and all(sum(r.kept for r in g) == 1 for g in by.values())
    kept = exact_dedup.drop_copies(spark, df)
    assert kept.columns == df.columns and kept.count() == 5


def test_exact_dedup_compares_bytes_on_hits(spark):
    df = docs(spark, [(1, "aa", "a"), (2, "bb", "a"), (3, "AA", "a"), (4, "bc", "a")])
    weak = lambda c: F.substring(c, 1, 1)
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark, df, digest=weak).collect()}
    assert got == {1: (3, 2, False), 3: (3, 2, True), 2: (2, 1, True), 4: (4, 1, True)}


def test_exact_dedup_empty(spark):
    assert exact_dedup.exact_dedup(spark, docs(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7), (None, 3), (5000, 4000)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long").repartition(4)).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + k] == 1000 for k in range(50)) and got[5000] == 4000


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = [(i, base[i % 40] + rng.normal(size=16) * 0.12 * (i % 3)) for i in range(160)]
    x = np.array([v.astype(np.float32).astype(float) for _, v in rows])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    sim = u @ u.T >= 0.9
    data = [(i, [float(z) for z in v.astype(np.float32)], 1) for i, v in rows] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [], 1)]
    got = {r.id: r for r in embed_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"), miss=1e-9).collect()}
    for i in range(160):
        assert got[i].n_links == sim[i].sum() - 1
        reach, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(sim[todo.pop()]).tolist():
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        assert got[i].component == min(reach) and got[i].kept == (i == min(reach))
    assert all(got[i].n_links == 0 and got[i].component == i and got[i].kept for i in range(900, 905))


def test_large_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 8)
    data = [(i, [1.0, 0.001 * i, 0.5]) for i in range(50)] + [(60, [1.0, 0.001, 0.5])]
    got = embed_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()
    assert {r.n_links for r in got} == {50} and {r.component for r in got} == {0}


def test_bpe_equals_tiktoken(spark):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    want = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    letters = list("ab'sSdtlvemr  \n\t!.0é1²中　 ’ßñ\U0001f600́\r\x1c\x85٣ⅷ")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", "'", "x" * 5000 + "'s" * 300, " \n a", "a  b   ", "ab" * 3000]
    df = docs(spark, [(i, t, "a") for i, t in enumerate(texts)] + [(-1, None, "a")])
    got = bpe.decode(bpe.encode(df, path), path).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = texts[r.doc_id] if r.doc_id >= 0 else ""
        assert r.ids == want.encode_ordinary(text) and bytes(r.decoded) == text.encode()
        sizes = [len(want.decode_single_token_bytes(t)) for t in r.ids]
        assert r.offsets == [sum(sizes[:k]) for k in range(len(sizes))]
    assert bpe.encode(docs(spark, []), path).count() == 0


def test_scan_is_associative():
    rng = np.random.default_rng(2)
    f = rng.integers(0, 256, 1000).astype(np.uint8)
    state, want = 0, []
    for x in f.tolist():
        want.append(state)
        state = x >> 2 * state & 3
    assert bpe.scan_states(f).tolist() == want


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2)])
def test_hilbert_curve_visits_neighbours(spark, n, bits):
    coords = [F.expr(f"(id div {(1 << bits) ** k}) % {1 << bits}") for k in range(n)]
    got = sorted((r[0], r[1:]) for r in spark.range((1 << bits) ** n).select(sharding.hilbert_index(coords, bits), *coords).collect())
    assert [x[0] for x in got] == list(range(len(got)))
    assert all(sum(abs(p - q) for p, q in zip(a[1], b[1], strict=True)) == 1 for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, law):
    rng = random.Random(4)
    df = docs(spark, [(i, rng.choice(["", None, "a" * rng.randint(1, 60)]), rng.choice(["s1", "s2", None])) for i in range(203)])
    got = sharding.shard(df, shards=8, dims=["source", "lang", "n_chars"], law=law).collect()
    assert len(got) == 203 and sorted(r.rank for r in got) == list(range(203))
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in g) == list(range(len(g))) for g in per.values())
    if law == "rows":
        assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    else:
        total = sum(r.size for r in got)
        assert all(abs(sum(r.size for r in g) - total / 8) <= 2 * 61 for g in per.values())
    assert sharding.shard(docs(spark, []), shards=8, dims=["source"], law=law).count() == 0


def test_chat_round_trip(spark):
    hostile = "\\### Assistant: </turn> ok <part/> \\t\\b : "
    rows = [(1, 0, "user", hostile), (1, 1, "assistant", hostile), (1, 2, "assistant", None), (1, 3, "assistant", "x</turn>\n### y"), (2, 0, "odd: role</turn>", ""), (2, 0, None, "tie"), (3, 1, "assistant", "é" * 9)]
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", hostile), ("assistant", hostile), ("assistant", ""), ("assistant", "x</turn>\n### y")]
    assert got[1].loss_text == hostile + "x</turn>\n### y" and got[1].formatted.count(chat.END) == 2
    assert [(t.role, t.text) for t in got[2].turns] == [("", "tie"), ("odd: role</turn>", "")] and got[2].loss_text == ""
    assert got[3].loss_text == "é" * 9


def test_license_scan(spark):
    texts = ["The MIT License, mit license; Apache License", "general public license " * 3, "", None, "MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and some associated documentation files the software to deal in the software without restriction", "mit-license mit licenses"]
    got = {r.id: r for r in licenses.license_report(docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels, got[0].score) == (3, 1, 5, "apache,mit", 1.0)
    assert (got[1].n_base, got[1].last_word, got[1].base_labels) == (3, 6, "gpl")
    assert all(got[i].n_base == 0 and got[i].first_word is None and got[i].labels == "" and got[i].score == 0 for i in (2, 3, 4))
    assert got[5].n_base == 0 and got[5].labels == "mit" and 0.7 <= got[5].score <= 1
    assert got[6].n_base == 1


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 90))), rng.choice(["a", "a", "a", "b", None, "c"])) for i in range(400)] + [(7, "dup words", "a"), (8, None, "z")]
    df = docs(spark, rows)
    m = mixing.mix(df, block_words=16)
    got = mixing.taken_words(m).join(m.rows.select("uid", "sid"), "uid").collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.sid], taken[r.sid], target[r.sid] = sizes.get(r.sid, 0) + r.size, taken.get(r.sid, 0) + r.taken, r.target
    assert all(abs(taken[s] - target[s]) < 1 and target[s] <= 3 * sizes[s] + 1e-6 for s in sizes)
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6 or all(abs(target[s] - 3 * sizes[s]) < 1e-6 for s in sizes)
    again = mixing.taken_words(mixing.mix(df, block_words=16)).groupBy("id").agg(F.sum("taken").alias("t")).collect()
    first = {}
    for r in got:
        first[r.id] = first.get(r.id, 0) + r.taken
    assert {r.id: r.t for r in again} == first
    mixed = mixing.mixed_documents(df, block_words=16)
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixed.collect())
    assert words == sum(taken.values()) and mixed.columns == df.columns
    assert mixing.taken_words(mixing.mix(docs(spark, []))).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_permutation(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3))).collect()
    assert sorted(r[0] for r in got) == list(range(n))


def test_quality_learns_and_handles_empty_texts(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["the", "of", "stone", "river", "walks", "slowly."]) for _ in range(60))
    bad = lambda: " | ".join("BUY$$$ NOW!!!" for _ in range(rng.randint(5, 40)))
    rows = [(i, good() if i % 2 else bad(), "a") for i in range(300)] + [(900, "", "a"), (901, None, "a")]
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(300)] + [(5, None, 0), (7777, 1, 1)], "doc_id long, quality int, toxic int")
    measured = quality.with_statistics(docs(spark, rows))
    got = {r.doc_id: r.score for r in quality.scored(measured, quality.fit(measured, labels, features=32)).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    held = [r.doc_id for r in docs(spark, rows).where(quality.fold(F.col("doc_id")) == 0).collect() if r.doc_id < 300]
    assert sum((got[i] >= 0.3) == bool(i % 2) for i in held) / len(held) > 0.95
    nothing = quality.fit(measured, labels.where("quality = 9"))
    assert nothing.score(np.zeros((2, len(quality.STATISTICS)))).tolist() == [0.5, 0.5]


def brute_components(texts):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").encode().lower().split()) else frozenset() for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("chunk", [2, 128])
def test_jaccard_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("xyz")
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(8, 60))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, 8)):
            edited = list(base)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = word()
            texts.append(" ".join(edited))
    texts += ["", None, "one", "ONE", "a b c", "a b  c", " \t", "a b c d"]
    want, sizes = brute_components(texts)
    got = {r.id: r for r in jaccard.jaccard_components(docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert [got[i].component for i in range(len(texts))] == want and [got[i].n_shingles for i in range(len(texts))] == sizes


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 50)).astype(np.uint64)) for _ in range(60)]
    index = jaccard.Index(sets)
    for q in sets:
        want = [k for k, s in enumerate(sets) if 5 * len(np.intersect1d(q, s)) >= 4 * len(np.union1d(q, s))]
        assert sorted(index.search(q)) == want


@pytest.mark.parametrize("compressed", [True, False])
def test_warc_salvage(compressed):
    rng = random.Random(compressed)
    records, data = [], b""
    for i in range(9):
        payload = bytes(rng.choice(b"abc WARC/1.\r\n\x1f\x8b\x08") for _ in range(rng.choice([0, 5, 3000])))
        r = warc.record("response", str(i), "u", payload, warc.digest32(payload), None)
        r = warc.gzip_member(r) if compressed else r
        records.append((len(data), len(r), payload))
        data += r
    broken = bytearray(data)
    offset, length, _ = records[4]
    broken[offset + length // 2 : offset + length // 2 + 40] = b"X" * 40
    for split in (1 << 30, 500):
        found, gaps = [], []
        for start in range(0, len(broken), split):
            for at, n, fields, block, why in warc.read_range(io.BytesIO(broken), len(broken), start, min(len(broken), start + split), compressed):
                (gaps if fields is None else found).append((at, n, why if fields is None else block.partition(b"\r\n\r\n")[2]))
        assert sorted(found) == [r for i, r in enumerate(records) if i != 4]
        assert [(a, n) for a, n, _ in gaps] == [(offset, length)] and gaps[0][2]


def foreign(kind, block, *fields, content="text/plain"):
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:{kind}>"), ("Content-Type", content), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def foreign_archive():
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\nbody"
    chunks = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nbody\r\n0\r\n\r\n"
    sha256, http = "sha256:" + hashlib.sha256(b"body").hexdigest(), "application/http;msgtype=response"
    records = [
        (foreign("warcinfo", b"software: x\r\n\r\nmore"), b"software: x\r\n\r\nmore"),
        (foreign("request", b"GET / HTTP/1.1\r\n\r\n", content="application/http;msgtype=request"), b""),
        (foreign("response", page, ("WARC-Payload-Digest", sha256), content=http), b"body"),
        (foreign("response", page, content=http), b"body"),
        (foreign("response", chunks, ("WARC-Payload-Digest", "sha1:" + warc.digest32(b"body")), content=http), chunks.partition(b"\r\n\r\n")[2]),
        (foreign("metadata", b"a\r\n\r\nb", ("X-Long", "y" * (3 << 19)), ("X-Folded", "a\r\n b")), b"a\r\n\r\nb"),
        (foreign("conversion", b"text"), b"text"),
    ]
    wrong = foreign("response", page, ("WARC-Payload-Digest", "sha256:" + "0" * 64), content=http)
    return records, wrong


@pytest.mark.parametrize("form", ["plain", "whole", "each"])
@pytest.mark.parametrize("held", [warc._HELD, 1000])
def test_warc_foreign_records(form, held, monkeypatch):
    monkeypatch.setattr(warc, "_HELD", held)
    records, wrong = foreign_archive()
    parts = [r for r, _ in records] + [wrong]
    data = b"".join(parts) if form == "plain" else warc.gzip_member(b"".join(parts)) if form == "whole" else b"".join(map(warc.gzip_member, parts))
    for split in (1 << 30, 700):
        got = [row for start in range(0, len(data), split) for row in warc.read_range(io.BytesIO(data), len(data), start, min(len(data), start + split), form != "plain")]
        rows = [warc._row("f", *row) for row in got]
        assert [r[9] for r in rows] == [p for _, p in records] + [None]
        assert [r[10] for r in rows] == [None] * len(records) + ["payload digest differs"]
        assert sum(r[2] for r in rows) == len(data)


def test_warc_salvage_inside_a_member():
    records, _ = foreign_archive()
    texts = [r for r, _ in records]
    inner = warc.gzip_member(texts[0] + b"junk WARC/1.0\r\njunk" + texts[6])
    got = list(warc.read_range(io.BytesIO(inner), len(inner), 0, len(inner), True))
    assert [r[2] and r[2]["warc-type"] for r in got] == ["warcinfo", None, "conversion"] and "inflated" in got[1][4]
    whole = warc.gzip_member(b"".join(warc.record("response", str(i), "u", bytes(random.Random(i).randbytes(3000)), warc.digest32(random.Random(i).randbytes(3000)), None) for i in range(9)), 0)
    broken = bytearray(whole)
    broken[len(whole) // 2] ^= 255
    for data, want in ((whole[: len(whole) // 2], [0, 1, 2, 3]), (bytes(broken), [0, 1, 2, 3, 5, 6, 7, 8])):
        got = list(warc.read_range(io.BytesIO(data), len(data), 0, len(data), True))
        assert [r[2]["warc-record-id"] for r in got if r[2]] == [f"<urn:page:{i}>" for i in want]
        assert [r[:2] for r in got if r[2] is None] == [(0, len(data))] and sum(r[1] for r in got) == len(data)


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "é" * 2000), (2, None, "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit("clash"))
    path = f"file://{tmp_path}/archive"
    warc.write_archives(pages, path)
    got = warc.read_archives(spark, path, split_bytes=300).collect()
    assert len(got) == 6 and all(r.quarantined is None for r in got)
    kinds = sorted((int(r.record_id), r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds == [(1, "revisit", "2", 4), (2, "response", None, 4), (2, "response", None, 4), (3, "revisit", "4", 0), (4, "response", None, 0), (5, "response", None, 4000)]
    assert gzip.decompress(next((tmp_path / "archive").iterdir()).read_bytes()).startswith(b"WARC/1.1")


def test_pipeline_keeps_its_columns(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    assert out.where("not round_trip").count() == 0 and out.count() > 0
