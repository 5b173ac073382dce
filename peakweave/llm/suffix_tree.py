"""Language-model scores from a probabilistic suffix tree over the words of a corpus.

Symbols are the words seen at least `frequent` times in training texts, the end of a text among them, and one
class of all other words. A context is a sequence of up to `depth` frequent words seen at least `least` times;
it is retained where its next-symbol distribution diverges from that of its longest retained suffix:
the mean log-likelihood ratio of its training occurrences, each left out of its own count, is at least
`divergence` nats. A retained context adds its counts to `weight` pseudo-counts spread as its suffix predicts,
down to smoothed word frequencies, so all distributions are proper. A token is scored in the longest retained state.

How it runs: texts are cut into blocks of about `block_tokens` tokens. In each round a block asks for the corpus-wide
counts of its distinct n-grams of one length (and hands in its share of the log-likelihood ratios of
the contexts one shorter); requests meet in hash buckets of bounded size, are summed there, and the totals go back to the
blocks that asked, in the order of the request. So nothing is broadcast, nothing depends on the size of the model, every
count is exact, and all that moves is linear in the texts. Rounds are written to the shared folder.
"""

from __future__ import annotations

import pickle
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialise

BLOCK_TOKENS = 1 << 20
BUCKET_BYTES = 32 << 20  #: of requests that meet in one task
UNIT = 1 << 16  #: sums of log-likelihood ratios are whole multiples of 1 / UNIT in a block
HELD, NAMELESS = 1, 2  #: flags of a text: not learned from; without id
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ROWS = "block bigint, bucket int, data binary"


def _pack(**arrays: np.ndarray | bytes) -> bytes:
    """Named arrays as bytes, each by planes of its bytes, compressed."""
    codec = pa.Codec("zstd", 1)
    out = {}
    for name, a in arrays.items():
        kind = "" if isinstance(a, bytes) else a.dtype.str
        raw = a if isinstance(a, bytes) else np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
        out[name] = (kind, len(raw), codec.compress(raw, asbytes=True) if raw else b"")
    return pickle.dumps(out, 5)


def _unpack(data: bytes) -> dict:
    codec = pa.Codec("zstd", 1)
    out = {}
    for name, (kind, size, body) in pickle.loads(data).items():
        raw = codec.decompress(body, size, asbytes=True) if size else b""
        out[name] = raw if not kind else np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return out


def _small(a: np.ndarray) -> np.ndarray:
    """Non-negative integers (or -1) in as few bytes as they need."""
    top = int(a.max(initial=0))
    return a.astype(np.int8 if top < 128 else np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def _ranks(a: np.ndarray) -> dict[str, np.ndarray]:
    """Ranks of frequency in two streams: a byte for the first 255, and the others."""
    return {"low": np.minimum(a, 255).astype(np.uint8), "high": _small(a[a >= 255])}


def _unranked(state: dict) -> np.ndarray:
    out = state.pop("low").astype(np.int64)
    out[out == 255] = state.pop("high")
    return out


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes other than space, tab, line feed, vertical tab, form feed and return, A-Z in lower case."""
    return text.lower().split()


def _tokenised(block_tokens: int) -> Callable:
    """Blocks of texts: their tokens, and their words in the order of CRC-32; the empty word is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids: dict[bytes, int] = defaultdict(count().__next__)
        docs, flags, tokens, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            words = list(ids)
            crc = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
            order = np.argsort(crc, kind="stable")
            lens = np.array([len(t) for t in tokens], np.int64)
            flat = np.concatenate(tokens)
            train = np.repeat((np.array(flags) & HELD) == 0, lens)
            learned = np.bincount(flat[train], minlength=len(words))
            # Tokens are stored by rank of frequency, which packs well; place says where a rank's word stands in the request.
            ranked = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            rank, place = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
            rank[ranked], place[order] = np.arange(len(words)), np.arange(len(words))
            state = _pack(doc=np.array(docs, np.int64), flags=np.array(flags, np.uint8), lens=lens, **_ranks(rank[flat]), place=_small(place[ranked]))
            asked = _pack(words=b"\n".join(words[i] for i in order), crc=crc[order], n=_small(learned[order]))
            return pa.RecordBatch.from_pydict({"block": [block], "tokens": [len(flat)], "words": [asked], "data": [state]}, schema=pa.schema([("block", pa.int64()), ("tokens", pa.int64()), ("words", pa.binary()), ("data", pa.binary())]))

        for batch in batches:
            for doc, train, text in zip(batch["doc"], batch["train"], batch["text"], strict=True):
                name = doc.as_py()
                found = list(map(ids.__getitem__, words_of(text.as_py())))
                found.append(ids[b""])
                docs.append(name or 0)
                flags.append(HELD * (not train.as_py()) + NAMELESS * (name is None))
                tokens.append(np.array(found, np.int32))
                held += len(found)
                if held >= block_tokens:
                    yield close()
                    block += 1
                    ids.clear()
                    ids.default_factory = count().__next__
                    docs, flags, tokens, held = [], [], [], 0
        if docs:
            yield close()

    return run


def _word_requests(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch["block"].to_pylist(), batch["words"], strict=True):
                asked = _unpack(data.as_py())
                words, bucket = asked["words"].split(b"\n"), (asked["crc"] * buckets) >> 32
                cuts = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
                rows = [(b, _pack(words=b"\n".join(words[i:j]), n=asked["n"][i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j]
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(rows), pa.int64()), "bucket": pa.array([b for b, _ in rows], pa.int32()), "data": pa.array([d for _, d in rows], pa.binary())})

    return run


def _numbered(counts: np.ndarray, least: int, bucket: int, buckets: int, none: int, first: int) -> np.ndarray:
    """A number of its own for each entry with a count of `least`, different in all buckets and small for large counts; `none` for the others."""
    numbers = np.full(len(counts), none, np.int64)
    often = np.flatnonzero(counts >= least)
    numbers[often[np.argsort(-counts[often], kind="stable")]] = np.arange(len(often)) * buckets + bucket + first
    if numbers.max(initial=0) >= 1 << 31:
        raise OverflowError("2^31 words or contexts: raise frequent or least")
    return numbers


def _merge_words(buckets: int, frequent: int) -> Callable:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        bucket = int(frame["bucket"].iloc[0])
        total: dict[bytes, int] = {}
        for data in frame["data"]:
            asked = _unpack(data)
            for word, n in zip(asked["words"].split(b"\n"), asked["n"].tolist(), strict=True):
                total[word] = total.get(word, 0) + n
        counts = np.fromiter(total.values(), np.int64, len(total))
        number = dict(zip(total, _numbered(counts, frequent, bucket, buckets, 0, 1).tolist(), strict=True))
        rare = counts[(counts > 0) & (counts < frequent)]
        out = [(-1, bucket, _pack(sums=np.array([counts.sum(), (counts > 0).sum(), rare.sum(), len(rare)], np.int64)))]
        for block, data in zip(frame["block"], frame["data"], strict=True):
            words = _unpack(data)["words"].split(b"\n")
            got = np.fromiter(map(total.__getitem__, words), np.int64, len(words))
            out.append((block, bucket, _pack(n=_small(got), number=_small(np.fromiter(map(number.__getitem__, words), np.int64, len(words))))))
        return pd.DataFrame(out, columns=["block", "bucket", "data"])

    return run


def _merge_counts(buckets: int, least: int, divergence: float) -> Callable:
    """Sums what blocks ask for, the counts of n-grams and the ratios of contexts, and answers in their order: counts, numbers, and which contexts are kept."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        bucket = int(frame["bucket"].iloc[0])
        asked = [_unpack(d) for d in frame["data"]]
        keys, inverse = np.unique(np.concatenate([np.cumsum(a["step"]) for a in asked]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([a["n"] for a in asked]), len(keys)).astype(np.int64)
        number = _numbered(counts, least, bucket, buckets, -1, 0)
        contexts, which = np.unique(np.concatenate([np.cumsum(a["context"]) for a in asked]), return_inverse=True)
        gain, seen = (np.bincount(which, np.concatenate([a[k] for a in asked]), len(contexts)) for k in ("gain", "seen"))
        kept = (gain / UNIT >= divergence * seen).astype(np.uint8)
        out, i, j = [], 0, 0
        for block, a in zip(frame["block"], asked, strict=True):
            own, ctx = inverse[i : i + len(a["step"])], which[j : j + len(a["context"])]
            i, j = i + len(own), j + len(ctx)
            out.append((block, bucket, _pack(n=_small(counts[own]), number=_small(number[own]), kept=kept[ctx])))
        return pd.DataFrame(out, columns=["block", "bucket", "data"])

    return run


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * _MIX
    mixed ^= mixed >> np.uint64(29)
    return (((mixed * _MIX) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _by_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.argsort(_bucket(keys, buckets), kind="stable")


class _Grams(NamedTuple):
    at: np.ndarray  #: positions that have a context
    keys: np.ndarray  #: distinct n-grams: context and symbol
    inverse: np.ndarray  #: n-gram of each of the positions
    contexts: np.ndarray  #: distinct contexts
    owner: np.ndarray  #: context of each n-gram


class _Block:
    """A block's state of a round, with what its positions know by now. What is found per n-gram or context is stored so, in their order."""

    def __init__(self, block: int, state: bytes, answers: list[bytes], weight: float, buckets: int) -> None:
        self.block, self.state, self.answers = block, _unpack(state), [_unpack(d) for d in answers]
        self.state["sym"] = _unranked(self.state)
        self.weight, self.buckets = weight, buckets
        self.known: dict[int, _Grams] = {}

    def answer(self, name: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[a[name] for a in self.answers]])

    def within(self) -> np.ndarray:
        """Whether a position has a token before it in its text."""
        inner = np.ones(int(self.state["lens"].sum()), bool)
        inner[np.cumsum(self.state["lens"])[:-1]] = False
        inner[:1] = False
        return inner

    def alone(self) -> np.ndarray:
        """Probability of each position's symbol without a context."""
        rare, size = self.state["rest"]
        p = (self.state["count"] + 0.5) / size
        p[0] = rare
        return p[self.state["sym"]]

    def symbols(self) -> np.ndarray:
        return self.state["number"][self.state["sym"]].astype(np.int64)

    def grams(self, level: int) -> "_Grams":
        """The n-grams of `level` words and a symbol."""
        if level not in self.known:
            if level == 1:
                before = np.roll(self.symbols(), 1)
                ctx = np.where(self.within() & (before > 0), before, -1)
            else:
                below = self.grams(level - 1)
                longer = np.full(len(self.state["sym"]), -1, np.int64)
                longer[below.at] = np.where(self.symbols()[below.at] > 0, self.state[f"number{level - 1}"][below.inverse], -1)
                ctx = np.where(self.within(), np.roll(longer, 1), -1)
            at = np.flatnonzero(ctx >= 0)
            keys, inverse = np.unique((ctx[at] << 32) | self.symbols()[at], return_inverse=True)
            new = np.r_[True, np.diff(keys >> 32) > 0][: len(keys)]
            self.known[level] = _Grams(at, keys, inverse, (keys >> 32)[new], np.cumsum(new) - 1)
        return self.known[level]

    def counts(self, level: int) -> np.ndarray:
        """How often the training texts hold each position's n-gram of `level` words and a symbol; 0 where there is none."""
        g, out = self.grams(level), np.zeros(len(self.state["sym"]), np.int64)
        out[g.at] = self.state[f"n{level}"][g.inverse]
        return out

    def seen(self, level: int) -> np.ndarray:
        """How often the training texts hold the context of `level` words before each position."""
        return np.roll(self.state["count"][self.state["sym"]] if level == 1 else self.counts(level - 1), 1)

    def kept(self, level: int) -> np.ndarray:
        """Whether the context of `level` words before a position is retained."""
        g, out = self.grams(level), np.zeros(len(self.state["sym"]), bool)
        out[g.at] = self.state[f"kept{level}"].view(bool)[g.owner[g.inverse]]
        return out

    def probability(self, levels: int) -> np.ndarray:
        """Of each position's symbol in its longest retained context of up to `levels` words."""
        p = self.alone()
        for k in range(1, levels + 1):
            p = np.where(self.kept(k), (self.counts(k) + self.weight * p) / (self.seen(k) + self.weight), p)
        return p

    def train(self) -> np.ndarray:
        return np.repeat((self.state["flags"] & HELD) == 0, self.state["lens"])

    def take_counts(self, level: int) -> None:
        """Totals of the n-grams asked for in the last round, and the numbers of those that are contexts themselves."""
        order = _by_bucket(self.grams(level).keys, self.buckets)
        n, number = np.zeros(len(order), np.int64), np.full(len(order), -1, np.int64)
        n[order], number[order] = self.answer("n"), self.answer("number")
        self.state[f"n{level}"], self.state[f"number{level}"] = _small(n), _small(number)

    def take_kept(self, level: int) -> None:
        """Which contexts are retained, by the ratios handed in in the last round."""
        order = _by_bucket(self.grams(level).contexts, self.buckets)
        kept = np.zeros(len(order), np.uint8)
        kept[order] = self.answer("kept")
        self.state[f"kept{level}"] = kept

    def gains(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each context of the block, the summed log-likelihood ratios of its training occurrences, each left out of its count, and their number.

        Ratios are whole multiples of 1 / UNIT, so their sums don't depend on the order of blocks.
        """
        g = self.grams(level)
        below = self.probability(level - 1)[g.at]
        own = (self.counts(level)[g.at] - 1 + self.weight * below) / (self.seen(level)[g.at] - 1 + self.weight)
        learned = self.train()[g.at]
        owner = g.owner[g.inverse[learned]]
        ratio = np.bincount(owner, np.log(own[learned] / below[learned]), len(g.contexts))
        return np.round(ratio * UNIT).astype(np.int64), np.bincount(owner, minlength=len(g.contexts))

    def requests(self, counts: int, gains: int) -> list[tuple]:
        """Rows that ask for the totals of n-grams after contexts of `counts` words and hand in ratios of contexts of `gains` words (0: none)."""
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if counts:
            g = self.grams(counts)
            order = _by_bucket(g.keys, self.buckets)
            keys, n = g.keys[order], np.bincount(g.inverse[self.train()[g.at]], minlength=len(g.keys))[order]
        names = ratio = seen = np.zeros(0, np.int64)
        if gains:
            names = self.grams(gains).contexts
            order = _by_bucket(names, self.buckets)
            names, (ratio, seen) = names[order], (x[order] for x in self.gains(gains))
        edges = np.arange(self.buckets + 1)
        cut, cut2 = np.searchsorted(_bucket(keys, self.buckets), edges).tolist(), np.searchsorted(_bucket(names, self.buckets), edges).tolist()
        out = []
        for b in range(self.buckets):
            k, c = slice(cut[b], cut[b + 1]), slice(cut2[b], cut2[b + 1])
            if k.start < k.stop or c.start < c.stop:
                out.append((self.block, b, _pack(step=np.diff(keys[k], prepend=0), n=_small(n[k]), context=np.diff(names[c], prepend=0), gain=ratio[c], seen=_small(seen[c]))))
        return out

    def stored(self) -> pd.DataFrame:
        kept = {k: v for k, v in self.state.items() if k != "sym"} | _ranks(self.state["sym"])
        return pd.DataFrame([(self.block, -1, _pack(**kept))], columns=["block", "bucket", "data"])


def _met(frame: pd.DataFrame, *options) -> _Block:
    """A block's state with the answers of all buckets, in their order."""
    frame = frame.sort_values("bucket")
    data = frame["data"].to_list()
    return _Block(int(frame["block"].iloc[0]), data[0], data[1:], *options)


def _asked(level: int, depth: int, *options) -> Callable:
    """Requests of blocks that know n-grams of up to `level` words: totals of longer n-grams, and ratios of contexts of `level` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch["block"].to_pylist(), batch["data"], strict=True):
                rows = _Block(block, data.as_py(), [], *options).requests(level + 1 if level < depth else 0, level)
                yield pa.RecordBatch.from_pydict({"block": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _first_step(sums: tuple[int, int, int, int], *options) -> Callable:
    n_all, v_all, n_rare, v_rare = sums

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        b = _met(frame, *options)
        place, toks = b.state.pop("place"), b.state.pop("sym")
        c, number = b.answer("n")[place], b.answer("number")[place]
        size = n_all + 0.5 * (v_all + 1)
        starts = np.cumsum(b.state["lens"]) - b.state["lens"]
        b.state["base"] = np.add.reduceat(np.log10((c + 0.5) / size)[toks], starts)
        b.state["known"] = np.add.reduceat((c > 0)[toks].astype(np.int64), starts)
        # Symbols: 0 is the class of words that aren't frequent; it and each frequent word of the block have a place.
        often = np.flatnonzero(number > 0)
        place = np.zeros(len(c), np.int64)
        place[often] = np.arange(1, len(often) + 1)
        b.state |= {"sym": place[toks], "number": _small(np.concatenate([[0], number[often]])), "count": _small(np.concatenate([[0], c[often]]))}
        b.state["rest"] = np.array([(n_rare + 0.5 * v_rare + 0.5) / size, size])
        return b.stored()

    return run


def _step(level: int, *options) -> Callable:
    """Takes the answers on n-grams of `level` words and on the contexts one shorter."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        b = _met(frame, *options)
        if level > 1:
            b.take_kept(level - 1)
        b.take_counts(level)
        return b.stored()

    return run


_SCORES = "doc bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, in_context bigint"


def _last_step(depth: int, *options) -> Callable:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        b = _met(frame, *options)
        if depth:
            b.take_kept(depth)
        s = b.state
        starts = np.cumsum(s["lens"]) - s["lens"]
        ratio = np.log10(b.probability(depth) / b.alone())
        inside = np.zeros(len(s["sym"]), bool)
        for k in range(1, depth + 1):
            inside |= b.kept(k)
        return pd.DataFrame(
            {
                "doc": pd.arrays.IntegerArray(s["doc"].copy(), (s["flags"] & NAMELESS) > 0), "held_out": (s["flags"] & HELD) > 0, "n_tokens": s["lens"], "n_known": s["known"],
                "base_score": s["base"], "score": s["base"] + np.add.reduceat(ratio, starts), "in_context": np.add.reduceat(inside.astype(np.int64), starts),
            }
        )

    return run


def lm_scores(
    docs: DataFrame,
    *,
    train: Column,
    ident: str = "doc_id",
    text: str = "text",
    depth: int = 2,
    frequent: int = 32,
    least: int = 32,
    divergence: float = 0.02,
    weight: float = 16.0,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, in_context) of every row.

    The model learns from the rows where `train` holds (null doesn't hold); the others are held out. Tokens are the words of the text, A-Z
    in lower case, and one end. base_score sums log10((c + 0.5) / (N + 0.5 * (V + 1))) over the tokens, c being a token's count, N
    all tokens and V the distinct ones in the training texts; n_known counts tokens with c > 0. score is the log10
    probability of the text under the suffix tree, in_context the tokens scored in a context of a word or more.

    A null text counts as empty, and an empty one has its end only. Rows repeated with one id, or with a null id, are texts of
    their own. A text of any length stays whole; a block holds one text at least. Without training texts every token has the
    probability of an unseen word, 1. An empty table gives no rows; other columns are ignored. Counts are exact; equal contexts
    are found by number, not by hash. More than 2^31 frequent words or contexts of one length end in an error that says so.
    """
    spark = docs.sparkSession
    body = F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8")
    rows = docs.select(F.col(f"`{ident}`").cast("long").alias("doc"), F.coalesce(train, F.lit(False)).alias("train"), body.alias("text"))
    blocks = materialise(rows.mapInArrow(_tokenised(block_tokens), "block bigint, tokens bigint, words binary, data binary"), "lm-blocks")
    tokens = blocks.agg(F.sum("tokens")).first()[0]
    if not tokens:
        return spark.createDataFrame([], "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, in_context bigint")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-16 * tokens // BUCKET_BYTES))
    asked = blocks.select("block", "words").mapInArrow(_word_requests(buckets), _ROWS)
    answers = materialise(asked.groupBy("bucket").applyInPandas(_merge_words(buckets, frequent), _ROWS), "lm-answers")
    sums = np.sum([_unpack(bytes(r["data"]))["sums"] for r in answers.where("block < 0").select("data").toLocalIterator()], axis=0).tolist()  # a row for each bucket
    options = (weight, buckets)
    state, held = blocks.select("block", F.lit(-1).alias("bucket"), "data"), blocks
    for level, step in enumerate([_first_step(tuple(sums), *options), *[_step(k, *options) for k in range(1, depth + 1)]]):
        done = materialise(state.unionByName(answers.where("block >= 0")).groupBy("block").applyInPandas(step, _ROWS), f"lm-step{level}")
        discard(held, answers)
        state = held = done
        # Requests are made from the stored state where they are sent, and are not stored themselves.
        asked = done.select("block", "data").mapInArrow(_asked(level, depth, *options), _ROWS)
        answers = materialise(asked.groupBy("bucket").applyInPandas(_merge_counts(buckets, least, divergence), _ROWS), "lm-answers")
    scored = materialise(state.unionByName(answers).groupBy("block").applyInPandas(_last_step(depth, *options), _SCORES), "lm-scores")
    discard(held, answers)
    return scored.select(F.col("doc").alias("id"), "held_out", "n_tokens", "n_known", F.lit(int(sums[0])).cast("long").alias("train_tokens"), "base_score", "score", "in_context")
