"""The training-data queries and stages on whole small tables against brute force, and on empty and odd ones."""

import io
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from peakweave.llm import bpe, chat, embed_dedup, exact_dedup, jaccard, licenses, mixing, quality, sharding, trie, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
OPS = [n for n in entry.queries() if re.match(r"op\d+_|pipeline$", n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    for table in Path(SF).glob("*.parquet"):
        spark.read.parquet(str(table)).limit(0).write.parquet(f"{path}/{table.name}")
    return str(path)


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, empty_dir, name):
    got = entry.queries()[name](spark, empty_dir)
    assert got.where("conv_id <> -7" if name.startswith("op5_") else "true").count() == 0


def test_shards_of_the_query(spark):
    got = sorted(entry.queries()["op4_hilbert_shards"](spark, SF).collect(), key=lambda r: (r.shard, r.slot))
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in got)
    count = Counter(r.shard for r in got)
    assert set(count) == set(range(8)) and max(count.values()) - min(count.values()) <= 1
    assert [r.slot for r in got] == [k for s in range(8) for k in range(count[s])]
    assert [(r.hilbert, r.doc_id) for r in got] == sorted((r.hilbert, r.doc_id) for r in got)


def test_written_shards_keep_rows_and_prune(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([None, 7, i]), rng.choice([None, "", "x" * rng.randint(1, 9)]), f"s{rng.randint(0, 9)}", rng.randint(0, 999), i) for i in range(900)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, source string, n_chars long, shard long").withColumn("slot", F.lit("mine"))
    added = sharding.write_shards(docs, str(tmp_path / "out"), shards=6, dims=["source", "n_chars"], rows_per_file=20)
    assert added == ("shard_", "slot_", "hilbert")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, back.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
    files = list((tmp_path / "out").rglob("*.parquet"))

    def touched(column, value):
        hit = 0
        for f in files:
            meta = pq.ParquetFile(f).metadata
            k = meta.schema.to_arrow_schema().get_field_index(column)
            hit += any(meta.row_group(g).column(k).statistics.min <= value <= meta.row_group(g).column(k).statistics.max for g in range(meta.num_row_groups))
        return hit

    assert len(files) > 30 and touched("source", "s4") < len(files) / 2 and touched("n_chars", 500) < len(files) / 2


def test_license_query_against_brute_force(spark):
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in entry.queries()["op6_license_scan"](spark, SF).collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r.doc_id])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for label, p in phrases.items() for k in range(len(words)) if words[k : k + len(p)] == p]
        starts = [k for k, _ in places]
        base = ",".join(sorted({x for _, x in places}))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(places), min(starts, default=None), max(starts, default=None), base)
        assert set(base.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score == 1 or not places)


def test_license_odd_inputs(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    rows = [(1, mit, "a"), (1, mit, "a"), (None, mit, "a"), (2, "x " * 50_000 + mit + " y" * 50_000, "a"), (3, None, "a")]
    own = licenses.NOTICES + (licenses.Template("other", licenses.NOTICES[0].text),)
    got = licenses.license_report(frame(spark, rows), licenses.PHRASES + own).collect()
    assert len(got) == 5 and all(r.labels == "mit,other" for r in got if r.id != 3)
    assert [r.n_words for r in got if r.id == 2] == [100_000 + len(re.findall(r"\w+", mit))]


def test_mixture_sizes_and_targets(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW d AS SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS size FROM '{SF}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql("SELECT doc_id, size, sum(size) OVER (PARTITION BY source), source FROM d").fetchall()}
    sizes = dict(con.sql("SELECT source, sum(size) FROM d GROUP BY 1").fetchall())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        stop = {s for s in free if share[s] > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] for s in stop} if stop else share
        left -= sum(3.0 * sizes[s] for s in stop)
        free = free - stop if stop else set()
    got = entry.queries()["op7_mix_sources"](spark, SF).collect()
    taken = Counter()
    assert len(got) == len(want)
    for r in got:
        size, whole, source = want[r.doc_id]
        assert (r.size, r.source_size) == (size, whole) and math.isclose(r.target, target[source], rel_tol=1e-9) and 0 <= r.taken <= 3 * size
        taken[source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)


def test_draws_are_multinomial(spark):
    rng = random.Random(2)
    docs = frame(spark, [(i, "w " * rng.randint(100, 300), "abc"[i % 3]) for i in range(600)])
    m = mixing.mix(docs, block_words=8, slots_per_shard=64)
    counts = m.shard_counts().collect()
    quota = {r.sid: r.n_slots for r in m.sources.collect()}
    total = Counter()
    for r in counts:
        total[r.sid] += r.slots
    assert total == quota
    sid = max(quota, key=quota.get)
    p = quota[sid] / sum(quota.values())
    seen = [r.slots for r in counts if r.sid == sid][:-1]
    assert 0.5 < np.var(seen) / (64 * p * (1 - p)) < 1.7
    rows = m.slots.groupBy("sid", "epoch", "block").count().where("count > 1")
    assert rows.count() == 0


def test_quality_against_numpy(spark):
    got = {r.doc_id: r for r in entry.queries()["op8_quality"](spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    ids = [i for i in docs if i in labels and fold(i)]
    x, y = np.stack([quality.statistics(docs[i]) for i in ids]), np.array([labels[i] for i in ids], float)
    folds = np.array([fold(i) for i in ids])
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    draw = np.random.default_rng(8)
    projection, phase = draw.normal(0, 0.5 / np.sqrt(x.shape[1]), (x.shape[1], 256)), draw.uniform(0, 2 * np.pi, 256)
    features = lambda v: np.hstack([np.cos(np.clip((v - mean) / scale, -8, 8) @ projection + phase) * np.sqrt(2 / 256), np.ones((len(v), 1))])
    z = features(x[folds != 1])
    w = np.linalg.solve(z.T @ z + 1e-4 * len(z) * np.eye(257) / 257, z.T @ y[folds != 1])
    raw = features(x[folds == 1]) @ w
    rounded = np.array([math.floor(min(max(v, -0.5), 1.5) * 1000 + 0.5) / 1000 for v in raw])
    bins = sorted(set(rounded.tolist()))
    value = np.array([y[folds == 1][rounded == b].mean() for b in bins])
    count = np.array([(rounded == b).sum() for b in bins], float)
    block = [[b, v, c] for b, v, c in zip(bins, value, count, strict=True)]
    k = 0
    while k + 1 < len(block):  # pool by brute force until the values ascend
        if block[k][1] >= block[k + 1][1] - 1e-15:
            (a, u, c), (b, v, d) = block[k], block[k + 1]
            block[k : k + 2] = [[(a * c + b * d) / (c + d), (u * c + v * d) / (c + d), c + d]]
            k = max(0, k - 1)
        else:
            k += 1
    every = sorted(docs)
    want = np.clip(np.interp(features(np.stack([quality.statistics(docs[i]) for i in every])) @ w, [b[0] for b in block], [b[1] for b in block]), 0, 1)
    off = np.abs(want - np.array([got[i].score for i in every]))
    assert (off < 1e-6).mean() > 0.97  # a raw score at a bin's edge may round either way
    held = [i for i in every if got[i].held_out and i in labels]
    assert all(got[i].held_out == (fold(i) == 0) and got[i].predicted == (got[i].score >= 0.3) for i in every)
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.6


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in entry.queries()["op8_quality"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    good, bad = ([h for h in held if h[2] == k] for k in (1, 0))
    area = np.mean([(g[0] > b[0]) + 0.5 * (g[0] == b[0]) for g in good for b in bad])
    assert len(bad) >= 5 and area > 0.95
    assert np.mean([g[1] == 1 for g in good]) > 0.95 and np.mean([b[1] == 0 for b in bad]) > 0.7  # a constant fails one of them


def test_isotonic_pools_and_keeps_ties():
    x, y = quality.isotonic(np.arange(5.0), np.array([0.1, 0.5, 0.3, 0.3, 0.9]), np.array([1.0, 1, 1, 2, 1]))
    assert y.tolist() == sorted(y.tolist()) and len(x) == 3 and math.isclose(y[1], 1.4 / 4)
    rng = np.random.default_rng(0)
    v = rng.uniform(size=50)
    _, fitted = quality.isotonic(np.arange(50.0), v, np.ones(50))
    assert np.all(np.diff(fitted) > 0)


def test_quality_stage_odd_inputs(spark):
    rows = [(i, "good words of a plain text." if i % 2 else "$$$ | $$$", "a") for i in range(60)] + [(None, None, "a"), (5, "good words of a plain text.", "a"), (99, "", None)]
    docs = frame(spark, rows).withColumn("stats", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels, 0.3)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {i for i in range(60) if i % 2}
    assert kept.where("doc_id = 5").count() == 2
    assert quality.keep_good(docs, labels.limit(0), 0.3).count() == len(rows)  # without labels all score 0.5


def test_vectors_odd_inputs(spark):
    big, tiny = [1e200, 2e200, 0.0], [1e-200, 2e-200, 0.0]
    rows = [(1, big), (2, tiny), (None, [3.0, 6.0, 0.001]), (None, [1.0, 2.0, 0.0]), (5, [1.0, 2.01, 0.0]), (5, [1.0, 2.01, 0.0]), (7, [0.0, 0.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (9, None), (None, [0.0, 1.0, -3.0]), (None, [0.0, 1.0, -3.0])]
    table = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, id string, vec string")
    got = embed_dedup.near_duplicates(table).collect()
    assert len(got) == len(rows)
    near = [r for r in got if r.component == 1]
    assert sorted((r.id or -1, r.n_links) for r in near) == [(-1, 5), (-1, 5), (1, 5), (2, 5), (5, 5), (5, 5)] and all(r.kept == (r.id in (1, None)) for r in near)
    assert sorted((r.id, r.n_links, r.component) for r in got if r.id in (7, 8, 9)) == [(7, 0, 7), (8, 0, 8), (9, 0, 9)]
    assert [(r.n_links, r.component, r.kept) for r in got if r.id is None and r.component is None] == [(1, None, True)] * 2


def test_vectors_with_many_bits(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(900, 24))
    x = np.concatenate([base, base[:300] + rng.normal(size=(300, 24)) * 0.33]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = int(((u @ u.T >= 0.9).sum() - len(x)))
    plan = embed_dedup.plan_tables
    embed_dedup.plan_tables = lambda n, threshold, miss: plan(200_000, threshold, miss)
    try:
        got = embed_dedup.near_duplicates(spark.createDataFrame([(i, [float(z) for z in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    finally:
        embed_dedup.plan_tables = plan
    assert want > 100 and 0.99 * want <= sum(r.n_links for r in got) <= want


def test_bpe_long_and_repeated(spark):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.tiktoken")
    want = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    long = "Stone's river 1234 flows\n\n" * 60_000
    docs = frame(spark, [(1, long, "a"), (1, long, "a"), (2, None, "a"), (None, "é'll", "a")]).withColumn("decoded", F.lit(1))
    tokens = bpe.encode(docs, path, keep=("doc_id", "n_chars"))
    for r in bpe.decode(tokens.withColumn("decoded", F.lit("mine")), path).collect():
        text = {1: long, 2: "", None: "é'll"}[r.doc_id]
        assert r.ids == want.encode_ordinary(text) and bytes(r["decoded_"]) == text.encode() and r.decoded == "mine"
    both = bpe.encode(docs, path, decoded=True).collect()
    assert sorted(len(r.decoded) for r in both) == sorted([len(long), len(long), 0, 5])
    with pytest.raises(Exception, match="offsets"):
        bpe.decode(tokens.withColumn("offsets", F.transform("offsets", lambda x: x + 1)), path).collect()


def test_chat_odd_inputs(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, place int"
    rows = [(None, 1, "user", "a", "f", 1), (None, None, "user", "b", "f", 1), (1, 1, "assistant", "x", "f", 1), (1, 1, "assistant", "x", "f", 1)]
    rows += [(2, k, "assistant" if k % 3 else "user", f"turn {k} ### \\", "f", 1) for k in range(3000)]
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(spark.createDataFrame(rows, schema))).collect()}
    assert [t.text for t in got[None].turns] == ["b", "a"] and [t.text for t in got[1].turns] == ["x", "x"] and got[1].loss_text == "xx"
    assert [t.text for t in got[2].turns] == [r[3] for r in rows if r[0] == 2]
    assert got[2].loss_text == "".join(r[3] for r in rows if r[0] == 2 and r[2] == "assistant")
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


def near_copies(rng, n, base_words=40):
    base = [f"b{k}" for k in range(base_words)]
    out = []
    for _ in range(n):
        text = list(base)
        if rng.random() < 0.8:
            text[rng.randrange(base_words)] = f"e{rng.randrange(10**9)}"
        out.append(" ".join(text))
    return out


def test_jaccard_large_group_and_odd_ids(spark):
    rng = random.Random(12)
    texts = near_copies(rng, 700) + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) for _ in range(100)]
    sets = [jaccard.shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    member = {}
    for i, s in enumerate(sets):
        for t in s.tolist():
            member.setdefault(t, []).append(i)
    for i, s in enumerate(sets):
        meet = Counter(j for t in s.tolist() for j in member[t] if j < i)
        for j, k in meet.items():
            if 5 * k >= 4 * (len(s) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in jaccard.jaccard_components(frame(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    odd = frame(spark, [(None, texts[0], "a"), (3, texts[0], "a"), (3, texts[-1], "a"), (2, texts[0], "a"), (9, "w " * 200_000, "a"), (9, None, "a")]).withColumn("component", F.lit(0))
    rows = sorted(((r.id or -1, r.component) for r in jaccard.jaccard_components(odd).collect()), key=repr)
    assert rows == sorted([(-1, 2), (3, 2), (3, 3), (2, 2), (9, 9), (9, 9)], key=repr)
    assert sorted((r.doc_id or -1) for r in jaccard.drop_near_copies(odd).collect()) == [-1, 2, 3, 3, 9, 9]


def test_search_gives_pivots_all_links():
    import pandas as pd

    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 1, 2, 90)]
    rows = [(1, -1, 0, i, s.tobytes(), a) for a, picked in ((0, [0, 1]), (1, [0, 1, 2, 3])) for i, s in enumerate(sets) if i in picked]
    frames = list(jaccard._search(iter([pd.DataFrame(rows, columns=["grp", "chunk", "part", "id", "tokens", "asks"])])))
    assert sorted(map(tuple, pd.concat(frames).values.tolist())) == [(0, 1), (1, 0), (2, 0), (2, 1)]


def test_warc_quoted_records_and_long_headers(spark, tmp_path):
    quoted = warc.record("response", "99", "u", b"quoted", warc.digest32(b"quoted"), None)
    payloads = [quoted * 40, b"", b"x" * 5000, quoted]
    data = b"".join(warc.record("response", str(i), "u" * (3 << 20 if i == 2 else 3), p, warc.digest32(p), None) for i, p in enumerate(payloads))
    assert len(warc.record_starts(io.BytesIO(data), len(data), 1000)) == 3
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc").write_bytes(b"")
    got = warc.read_archives(spark, str(tmp_path), split_bytes=1000).collect()
    assert sorted((r.record_id, bytes(r.payload)) for r in got) == [(str(i), p) for i, p in enumerate(payloads)]
    assert warc.record_starts(io.BytesIO(data[:900] + data), len(data) + 900, 1000) == [0]  # the first record is cut


def test_warc_null_ids_and_rerun(spark, tmp_path):
    pages = spark.createDataFrame([(None, "u", "a"), (1, "u" * (2 << 20), "a"), (2, None, None)], "page_id long, url string, html string")
    for _ in range(2):
        warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == 3 and all(r.quarantined is None for r in got)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(120)]
    texts += [t.upper() for t in texts[:20]] + [t + " tail" for t in texts[20:50]] + ["", None, "one"]
    rows = [(i, t, rng.choice(["a", "b", None])) for i, t in enumerate(texts)] + [(None, texts[3], "a")]
    return frame(spark, rows), rows


def test_exact_stage(spark, corpus):
    docs, rows = corpus
    best = {}
    for i, t, _ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        best[low] = max(best.get(low, -1), -1 if i is None else i)
    got = corpus_pipeline.drop_exact_copies(spark, docs, SF)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(best.values())


def test_near_stage(spark, corpus):
    docs, rows = corpus
    sets = [set(jaccard.shingles(t).tolist()) for _, t, _ in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[root[k]] = min(least.get(root[k], 10**9), 10**9 if i is None else i)
    want = [(i if i is not None else -1) for k, (i, _, _) in enumerate(rows) if i is None or i == least[root[k]]]
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns and sorted((-1 if r.doc_id is None else r.doc_id) for r in got.collect()) == sorted(want)


def test_mixing_and_token_stages(spark, corpus):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    docs, rows = corpus
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    taken = {r.uid: r.taken for r in mixing.taken_words(mixing.mix(docs)).collect()}
    got = mixed.collect()
    assert mixed.columns == docs.columns and sum(len(r.text.split()) for r in got) == sum(taken.values())
    own = {}
    for i, t, _ in rows:
        own.setdefault(i, []).append(t or "")
    # Each row is a run of words of its own document, and a document gives at most what three epochs of it hold.
    assert all(any(f" {' '.join(r.text.split())} " in f" {' '.join(t.split())} " for t in own[r.doc_id]) for r in got) and all(r.n_chars == len(r.text) for r in got)
    given = Counter()
    for r in got:
        given[r.doc_id] += len(r.text.split())
    assert all(n <= 3 * sum(len(t.split()) for t in own[i]) for i, n in given.items())
    want = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(public.path("byte_bpe_50k.tiktoken")), special_tokens={})
    tokens = corpus_pipeline.tokenise(spark, docs, SF).collect()
    assert len(tokens) == len(rows) and all(r.round_trip for r in tokens)
    assert sorted(map(repr, ((r.doc_id, r.ids) for r in tokens))) == sorted(map(repr, ((i, want.encode_ordinary(t or "")) for i, t, _ in rows)))


def test_exact_dedup_of_a_salted_digest(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SALTED", 4)
    docs = frame(spark, [(i, "same" if i % 3 else f"own {i}", "a") for i in range(60)] + [(100, "SAME", "a")])
    got = {r.id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark, docs).collect()}
    assert got == {i: (100, 41) if i % 3 or i == 100 else (i, 1) for i in [*range(60), 100]}


def test_clashing_and_dotted_names(spark, tmp_path):
    rows = [(1, "A b c d e f", "m", "x", "g"), (2, "a b C d e f", "n", "y", "h"), (3, "other words stand in this text", None, None, "i"), (4, None, "", "", "")]
    table = spark.createDataFrame(rows, "`doc.id` long, `the.text` string, _metadata string, at string, __gone string")
    for source in (table, exact_dedup.materialise(table, "odd-names")):
        got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark, source, ident="doc.id", text="the.text").collect()}
        assert got == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (4, 1, True)}
        kept = exact_dedup.drop_copies(spark, source, ident="doc.id", text="the.text")
        assert kept.columns == table.columns and sorted(map(tuple, kept.collect())) == rows[1:]
        near = jaccard.drop_near_copies(source, ident="doc.id", text="the.text")
        assert near.columns == table.columns and sorted(map(tuple, near.collect())) == [rows[0], *rows[2:]]
    docs = table.toDF("doc_id", "text", "_metadata", "at", "__gone")
    assert corpus_pipeline.drop_near_duplicates(spark, corpus_pipeline.drop_exact_copies(spark, docs, SF), SF).count() == 3


def test_exact_dedup_goes_on_with_its_state(spark, tmp_path):
    rng = random.Random(8)
    texts = ["", "x" * 3_000_000, *[f"text {k}" for k in range(30)]]
    rows, home, path = [], str(tmp_path / "home"), str(tmp_path / "docs")
    for part in range(3):
        more = [(100 * part + k, rng.choice(texts)) for k in range(40)]
        rows += more
        spark.createDataFrame(more, "doc_id long, text string").repartition(2).write.mode("append").parquet(path)
        if part in (0, 2):  # files that came in between are added; one file a batch
            got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark, path, state_home=home, max_bytes_per_trigger=1).collect()}
            groups = {t: [i for i, x in rows if x == t] for t in texts}
            assert got == {i: (max(groups[x]), len(groups[x]), i == max(groups[x])) for i, x in rows}


def test_very_long_texts(spark, tmp_path):
    long = "Word mit license and more\n" * 150_000  # 750,000 words, 3.9 MB
    docs = frame(spark, [(1, long, "a"), (2, "short text", "a"), (3, None, "b")])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "u", long), (2, "v", "<p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda name: {r[0]: r for r in entry.queries()[name](spark, str(tmp_path)).collect()}
    assert run("op4_hilbert_shards")[1].size == len(long) + 1
    assert run("op5_chat_format")[1].loss_chars == len(long)
    found = run("op6_license_scan")[1]
    assert (found.n_words, found.n_base, found.base_labels) == (750_000, 150_000, "mit")
    assert run("op7_mix_sources")[1].size == 750_000
    scores = run("op8_quality")
    assert len(scores) == 3 and all(0 <= r.score <= 1 for r in scores.values())
    assert run("op10_warc_archives")[1].payload_bytes == len(long)
    assert trie.conversation_trie(spark.read.parquet(f"{tmp_path}/conversations.parquet")).count() == 3
    scored = run("op13_lm_scores")[1]
    assert scored.n_tokens == 750_001
