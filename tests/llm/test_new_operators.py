"""Hard negatives, prefix tries and suffix-tree scores against brute force, on odd inputs and with forced splits."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from peakweave.llm import negatives, suffix_tree, trie

SF = "/root/testdata/sf0.001"


def mined(rows, anchors, positives=5, negatives_=5, low=80, high=100):
    """Hard negatives of (id, vec, label) rows in plain integers; anchors: places of the rows."""
    ok = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = {i: [math.floor(Fraction(x) * 256) for x in rows[i][1]] for i in ok}
    out = []
    name = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    for a in (i for i in ok if i in anchors):
        score = {i: sum(x * y for x, y in zip(whole[a], whole[i], strict=True)) for i in ok if i != a and len(whole[i]) == len(whole[a])}
        score = {i: max(-(2**63 - 1), min(2**63 - 1, s)) for i, s in score.items()}
        order = sorted(score, key=lambda i: (-score[i], name(i)))
        for p in [i for i in order if rows[i][2] == rows[a][2]][:positives]:
            hard = [i for i in order if rows[i][2] != rows[a][2] and low * score[p] <= 100 * score[i] <= high * score[p]][:negatives_]
            out += [(rows[a][0], rows[p][0], k, rows[i][0], score[p], score[i]) for k, i in enumerate(hard, 1)]
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<double>, label int, id string, row string, score long"


@pytest.mark.parametrize("block_bytes", [900, 1 << 24])
def test_hard_negatives_by_brute_force(spark, block_bytes):
    rng = random.Random(block_bytes)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in base[rng.randrange(4)]], rng.randrange(3)) for i in range(300)]
    rows += [(rng.randrange(300), rows[3][1], 1) for _ in range(80)]  # repeated ids and a very common vector
    rows += [(None, base[0], 1), (None, base[1], None), (400, None, 1), (500, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (600, [math.nan] * 6, 1), (700, [math.inf] * 6, 1), (800, [], 1), (900, [], 2), (1000, [1.0, 2.0], 1), (1100, [1.0, 1.0], 2), (1200, [2.0, 2.0], 1)]
    table = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], VECTORS).repartition(5)
    got = negatives.hard_negatives(table, anchors=F.col("vec_id") % 10 == 0, block_bytes=block_bytes)
    assert sorted(map(tuple, got.collect()), key=repr) == mined(rows, {i for i, r in enumerate(rows) if r[0] is not None and r[0] % 10 == 0})


def test_hard_negatives_beyond_float64(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([1e15, 3e14 + i, -2e15, 1.0]) for _ in range(3)], i % 2) for i in range(40)] + [(50, [1e300, 1.0, 0.0], 0), (51, [5e12, 2.0**40 + 1, 1.0], 1)]
    table = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], VECTORS)
    got = negatives.hard_negatives(table, anchors=F.col("vec_id") % 10 == 0)
    want = mined([(i, [max(-1.7e308 / 256, min(1.7e308 / 256, x)) for x in v], lab) for i, v, lab in rows], {i for i, r in enumerate(rows) if r[0] % 10 == 0})
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_hard_negatives_of_the_query(spark):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = entry.queries()["op11_hard_negatives"](spark, SF)
    assert sorted(map(tuple, got.collect()), key=repr) == mined(rows, {i for i, r in enumerate(rows) if r[0] % 100 == 0})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def nodes_of(sequences):
    """The trie's rows of conv -> list of (role, text), in plain Python."""
    members = defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += own
    ends = {k: ",".join(map(str, sorted(c for c in m if len(sequences[c]) == len(k)))) for k, m in members.items()}
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha(ends[k])) for k, m in members.items()), key=repr)


TURNS = "conv_id long, turn long, role string, text string, k0 string, part string, words string"


def ordered(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        own[c].append(((t is not None, t or 0), r, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest(), x))
    return {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in own.items() if c is not None}


def chats(rng):
    said = ["", "a b c", "tab\tx y", "\U0001f600 fine", "long " * 3000]
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(said[:3])) for c in range(-45, 60) for t in range(rng.randrange(7)) if c % 9]
    rows += [(1000, t, "user", "a b c") for t in range(700)] + [(1001, t, "user", "a b c") for t in range(650)]  # most rows in two long ones
    rows += [(1002, 1, None, None), (1002, None, "user", said[3]), (1002, 1, "", ""), (1003, 5, "user", said[4]), (None, 1, "user", "lost")]
    return rows + rows[:40]


@pytest.mark.parametrize("seed", range(2))
def test_trie_by_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = chats(rng)
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS).repartition(3)
    assert sorted(map(tuple, trie.conversation_trie(table).collect()), key=repr) == nodes_of(ordered(rows))
    own = ordered(rows)
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - int(math.fmod(c, 20)), [])
        rebuilt[c] = base[:h] + turns[h:]
    got = trie.prefix_trie(*trie.with_shared_heads(trie.ordered_turns(table)))
    assert sorted(map(tuple, got.collect()), key=repr) == nodes_of(rebuilt)
    assert any(not s for s in rebuilt.values()) or seed  # turnless ones end at the root


def test_trie_lists_longer_than_a_piece(spark):
    rows = [(c, 0, "user", "same") for c in range(3000)]
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS).repartition(6)
    assert sorted(map(tuple, trie.conversation_trie(table).collect()), key=repr) == nodes_of(ordered(rows))


def scores_by_hand(docs, depth, frequent, least, divergence, weight):
    """(n_tokens, n_known, N, base, score, in_context) of each (train, text), by dictionaries of tuples."""
    toks = [re.findall(rb"[^\x20\x09-\x0D]+", (x or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))) + [None] for _, x in docs]
    learned = [t for t, (train, _) in zip(toks, docs, strict=True) if train]
    c = Counter(w for t in learned for w in t)
    n, v = sum(c.values()), len(c)
    base = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    often = {w for w, k in c.items() if k >= frequent}
    symbol = lambda w: w if w in often else "rare"
    p0 = {w: base(w) for w in often} | {"rare": 1 - sum(map(base, often))}
    grams = Counter(tuple(map(symbol, t[i - k : i + 1])) for t in learned for k in range(1, depth + 1) for i in range(k, len(t)))
    total = Counter({(w,): c[w] for w in often}) + Counter({s: k for s, k in grams.items()})
    usable = lambda s: "rare" not in s and all(total[s[:i]] >= (frequent if i == 1 else least) for i in range(1, len(s) + 1))
    kept = set()

    def p(s, x):
        out = p0[x]
        for k in range(1, len(s) + 1):
            if (u := s[len(s) - k :]) in kept:
                out = (grams[u + (x,)] + weight * out) / (total[u] + weight)
        return out

    for k in range(1, depth + 1):
        gain = Counter()
        for t in learned:
            for i in range(k, len(t)):
                s, x = tuple(map(symbol, t[i - k : i])), symbol(t[i])
                if usable(s):
                    gain[s] += math.log((grams[s + (x,)] - 1 + weight * (q := p(s[1:], x))) / (total[s] - 1 + weight) / q)
        kept |= {s for s, g in gain.items() if g >= divergence * total[s]}
    out = []
    for t in toks:
        ctx = [tuple(map(symbol, t[max(0, i - depth) : i])) for i in range(len(t))]
        score = sum(math.log10(base(w)) + math.log10(p(s, symbol(w)) / p0[symbol(w)]) for s, w in zip(ctx, t, strict=True))
        out.append((len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(base(w)) for w in t), score, sum(any(s[i:] in kept for i in range(len(s))) for s in ctx)))
    return out


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
def test_scores_by_brute_force(spark, depth):
    rng = random.Random(depth)
    words = ["The", "the", "cat", "sat", "on", "a", "mat", "Été", "x y", *[f"w{i}" for i in range(60)]]
    follow = {w: rng.sample(words, 3) for w in words}

    def text(k):
        out = [rng.choice(words)]
        while len(out) < k:
            out.append(rng.choice(follow[out[-1]]) if rng.random() < 0.8 else rng.choice(words))
        return rng.choice([" ", "\t", "\n ", "\x0b"]).join(out)

    docs = [(rng.random() < 0.8, text(rng.randrange(1, 60))) for _ in range(200)] + [(True, None), (False, ""), (False, " \x0c "), (True, text(4000))] + [(True, "the cat sat on a mat")] * 30
    rows = [(i if i % 50 else None, train, x, "a", "b", 7) for i, (train, x) in enumerate(docs)]
    table = spark.createDataFrame(rows, "doc_id long, train boolean, text string, block string, data string, bucket int").repartition(3)
    options = {"depth": depth, "frequent": 8, "least": 5, "divergence": 0.02, "weight": 4.0}
    got = suffix_tree.lm_scores(table, train=F.col("train"), block_tokens=500, **options).collect()
    want = scores_by_hand(docs, **options)
    order = lambda r: (repr(r[0]), *r[1:3], r[5] if isinstance(r[5], float) else 0)
    mine = sorted(((None if i % 50 == 0 else i, not train, *w) for i, ((train, _), w) in enumerate(zip(docs, want, strict=True))), key=order)
    have = sorted(((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.in_context) for r in got), key=order)
    assert len(have) == len(mine)
    for a, b in zip(have, mine, strict=True):
        assert a[:5] == b[:5] and a[7] == b[7]
        assert a[5:7] == pytest.approx(b[5:7], rel=1e-9)
    if depth:
        assert sum(a[7] for a in have) > 0.3 * sum(a[2] for a in have)
        assert sum(a[6] for a in have if a[1]) > sum(a[5] for a in have if a[1])  # held-out texts are likelier than by word frequencies


def test_scores_of_the_query(spark):
    got = {r.doc_id: r for r in entry.queries()["op13_lm_scores"](spark, SF).collect()}
    docs = [(r.doc_id, zlib.crc32(str(r.doc_id).encode()) % 5 != 1, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = scores_by_hand([d[1:] for d in docs], 2, 32, 32, 0.02, 16.0)
    for (i, train, _), w in zip(docs, want, strict=True):
        r = got.pop(i)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.in_context) == (not train, w[0], w[1], w[2], w[5])
        assert (r.base_score, r.score) == pytest.approx(w[3:5], rel=1e-9)
    assert not got


def test_no_training_texts(spark):
    table = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = suffix_tree.lm_scores(table, train=F.lit(False)).orderBy("id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
