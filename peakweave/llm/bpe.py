"""Byte-level BPE: codepoint classes and a transition-function scan find the pieces, cached merges encode them.

The pre-tokeniser is the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
written as arithmetic on arrays. Each code point has a class; all but one boundary rule look at a
fixed neighbourhood. The exception is the contraction ('s, 're, ...): whether an apostrophe opens one
depends on the run it stands in. That is a four-state automaton; each code point is a function from
states to states, packed into a byte, composing two functions is one table lookup, and because
composition is associative the states before all positions come from a blocked scan over the array.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import own_name, worker_table

CHUNK = 1 << 19  #: code points handled at once; longer texts are one chunk of their own
CACHE_ENTRIES = 100_000  #: distinct pieces kept encoded in a Python worker
_WIDTHS = (8, 12, 16, 24, 32, 64)  # pieces of up to so many bytes are merged together; longer ones alone
_NONE = 1 << 40  # rank of a pair that doesn't join

_LETTER, _NUMBER, _SPACE, _BLANK, _OTHER, _END = 0, 1, 2, 3, 4, 5  # _BLANK: U+0020; _END: between texts
#: Scan symbols beyond "any": X leaves runs of other characters, O is in one, A2/A3 an apostrophe before 1/2 contraction letters.
_SYM_X, _SYM_O, _SYM_A2, _SYM_A3 = 0, 1, 2, 3
_FREE, _RUN, _ONE, _TWO = 0, 1, 2, 3  # states: none; in a run of others (or after a blank); 1 or 2 contraction letters to come


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point: letters (L*), numbers (N*), white space, all else."""
    table = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = _LETTER
        elif kind == "N":
            table[c] = _NUMBER
    # White_Space of the Unicode Character Database
    for c in [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        table[c] = _SPACE
    table[0x20] = _BLANK
    return table


def _pack(f: list[int]) -> int:
    return f[0] | f[1] << 2 | f[2] << 4 | f[3] << 6


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    """Packed transition function of each symbol, and compose[f, g] = "f, then g"."""
    step = {
        _SYM_X: [_FREE, _FREE, _FREE, _ONE],
        _SYM_O: [_RUN, _RUN, _RUN, _RUN],
        _SYM_A2: [_ONE, _RUN, _ONE, _ONE],
        _SYM_A3: [_TWO, _RUN, _TWO, _TWO],
    }
    symbols = np.array([_pack(step[s]) for s in range(4)], np.uint8)
    f = np.arange(256)
    image = np.stack([(f >> (2 * s)) & 3 for s in range(4)], 1)
    compose = np.zeros((256, 256), np.uint8)
    for s in range(4):
        compose |= (image[:, image[:, s]].T << (2 * s)).astype(np.uint8)
    return symbols, compose


def scan_states(functions: np.ndarray) -> np.ndarray:
    """State before each position, from _FREE: an exclusive scan under composition.

    The array is laid out in columns of one block each; all blocks are scanned in step, the block
    totals give each block's entry state, and applying it to the blocks' prefixes gives the states.
    """
    _, compose = _functions()
    n = len(functions)
    width = max(1, int(np.sqrt(n)))
    blocks = -(-n // width)
    identity = _pack([0, 1, 2, 3])
    grid = np.full(blocks * width, identity, np.uint8)
    grid[:n] = functions
    grid = grid.reshape(blocks, width).T.copy()  # row i: the i-th function of each block
    prefix = np.empty_like(grid)
    acc = np.full(blocks, identity, np.uint8)
    for i in range(width):
        prefix[i] = acc
        acc = compose[acc, grid[i]]
    entry, state = np.empty(blocks, np.uint8), 0
    for k, total in enumerate(acc.tolist()):
        entry[k] = state
        state = total >> 2 * state & 3
    return ((prefix >> (2 * entry)[None, :]) & 3).T.reshape(-1)[:n]


def piece_starts(points: np.ndarray) -> np.ndarray:
    """True where a piece starts. points: code points of texts, each text followed by one 0x110000."""
    n = len(points)
    cls = np.full(n, _END, np.uint8)
    inside = points < 0x110000
    cls[inside] = class_table()[points[inside]]
    after = lambda a, k, fill: np.concatenate([a[k:], np.full(min(k, n), fill, a.dtype)])
    before = lambda a, fill: np.concatenate([np.full(1, fill, a.dtype), a[:-1]])
    nxt, prev = after(cls, 1, _END), before(cls, _END)
    symbol = np.where((cls == _OTHER) | (cls == _BLANK), _SYM_O, _SYM_X).astype(np.uint8)
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        one, two = after(points, 1, 0x110000)[marks], after(points, 2, 0x110000)[marks]
        symbol[marks[np.isin(one, [ord(c) for c in "stmd"])]] = _SYM_A2
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        symbol[marks[pair]] = _SYM_A3
        state = scan_states(_functions()[0][symbol])
    else:
        state = np.zeros(n, np.uint8)
    letter_before_was_contraction = before(state, 0) == _ONE
    word = cls <= _NUMBER
    space = (cls == _SPACE) | (cls == _BLANK)
    other = cls == _OTHER
    space_next = (nxt == _SPACE) | (nxt == _BLANK)
    text_next = (nxt <= _NUMBER) | (nxt == _OTHER)
    space_prev = (prev == _SPACE) | (prev == _BLANK)
    start = (word | other) & (cls != prev) & (prev != _BLANK)
    start |= word & (cls == prev) & letter_before_was_contraction
    start |= word & letter_before_was_contraction & (prev != _BLANK)
    start &= state < _ONE  # inside a contraction nothing starts ...
    start |= other & (state >= _ONE) & (cls != prev)
    # White space: a run is one piece, but its last character parts from it before text.
    start |= space & ~space_prev
    start |= space & space_prev & ~space_next & text_next
    start &= inside
    return start


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one "base64 rank" pair per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Pair merging by rank, many pieces at a time, with a bounded cache of encoded pieces."""

    def __init__(self, ranks: dict[bytes, int], entries: int = CACHE_ENTRIES):
        self.ranks, self.entries = ranks, entries
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        pairs = array("q")
        for token, rank in ranks.items():
            self.widths[rank] = len(token)
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    pairs.extend((a, b, rank))
        table = np.frombuffer(pairs, np.int64).reshape(-1, 3)
        key = table[:, 0] * len(self.widths) + table[:, 1]
        order = np.argsort(key)
        self.pair_keys, self.pair_ranks = key[order], table[order, 2]
        self.reset()

    def reset(self) -> None:
        """Forget all encoded pieces: number of a piece -> flat[base[k] : base[k] + count[k]]."""
        self.number: dict[str, int] = {}
        self.flat, self.base, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, _NONE where they don't join."""
        key = a * len(self.widths) + b
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], _NONE)

    def _merge_many(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most `width` bytes: each round joins the leftmost pair of lowest rank in every row."""
        if not len(self.pair_keys):
            return [self.single[np.frombuffer(p, np.uint8)] for p in pieces]
        m = len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        column = np.arange(width)
        filled = column[None, :] < lengths[:, None]
        ids = np.full((m, width), -1, np.int64)
        ids[filled] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((m, width), _NONE, np.int64)
        rank[:, :-1] = self._pair_rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(m, width - 1)
        done, row = [np.empty(0)] * m, np.arange(m)
        while len(row):
            at = rank.argmin(1)
            best = rank[np.arange(len(row)), at]
            ended = best == _NONE
            if ended.any():
                for i in np.flatnonzero(ended).tolist():
                    done[row[i]] = ids[i, : lengths[i]]
                go = ~ended
                ids, rank, row, at, best, lengths = ids[go], rank[go], row[go], at[go], best[go], lengths[go]
                if not len(row):
                    break
            each = np.arange(len(row))
            later = column[None, :-1] > at[:, None]
            ids[:, :-1] = np.where(later, ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(later, rank[:, 1:], rank[:, :-1])
            ids[:, -1], rank[:, -1] = -1, _NONE
            ids[each, at] = best
            lengths -= 1
            right = np.minimum(at + 1, width - 1)
            rank[each, at] = np.where(at + 1 < width, self._pair_rank(best, ids[each, right]), _NONE)
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self._pair_rank(ids[left, at[left] - 1], best[left])
        return done

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one piece of any length, with a heap of pairs over a linked list: n log n."""
        ranks, n = self.ranks, len(piece)
        end, nxt, prv, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := nxt[i]) >= n or end[j] != stop or end[i] != j:
                continue
            alive[j], end[i], nxt[i] = False, stop, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if prv[i] >= 0 and (r := ranks.get(piece[prv[i] : end[i]])) is not None:
                heapq.heappush(heap, (r, prv[i], end[i]))
        return np.array([ranks[piece[i : end[i]]] for i in range(n) if alive[i]], np.int64)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = np.array([whole], np.int64)
            else:
                by_width.setdefault(next((w for w in _WIDTHS if len(p) <= w), 0), []).append(i)
        for w, members in by_width.items():
            found = self._merge_many([pieces[i] for i in members], w) if w else [self._merge_long(pieces[i]) for i in members]
            for i, ids in zip(members, found, strict=True):
                out[i] = ids
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces and give them numbers."""
        ids = self.merge([p.encode("utf-8", "surrogatepass") for p in pieces])
        count = np.array([len(x) for x in ids], np.int64)
        at = len(self.base)
        self.base = np.concatenate([self.base, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, np.concatenate(ids).astype(np.int32)])
        self.number.update(zip(pieces, range(at, at + len(pieces)), strict=True))

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts, the byte offset of each token in its text, and where each text's tokens begin (one more: the end)."""
        if len(self.base) > self.entries or len(self.flat) > 16 * self.entries:
            self.reset()
        joined = "\0".join(texts) + "\0"
        ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64)) - 1
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        points[ends] = 0x110000
        starts = np.flatnonzero(piece_starts(points))
        first = np.searchsorted(starts, np.concatenate([[0], ends[:-1] + 1]))
        last = np.searchsorted(starts, ends)
        # a piece ends where the next starts, or with its text
        stops = np.empty(len(starts), np.int64)
        stops[:-1] = starts[1:]
        stops[last[last > first] - 1] = ends[last > first]
        pieces = [joined[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        if new := [p for p in dict.fromkeys(pieces) if p not in self.number]:
            self._learn(new)
        known = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        count = self.count[known]
        to = np.cumsum(count)
        take = np.arange(to[-1] if len(to) else 0) + np.repeat(self.base[known] - to + count, count)
        ids = self.flat[take]
        reach = np.concatenate([[0], np.cumsum(self.widths[ids])])
        bounds = np.concatenate([[0], to])
        begin = np.append(bounds[first], len(ids))
        offsets = reach[:-1] - np.repeat(reach[begin[:-1]], np.diff(begin))
        return ids, offsets, begin

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, byte offset of each token) per text."""
        ids, offsets, begin = self.encode_flat(texts)
        return [(ids[a:b], offsets[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK bytes of text; a longer text is a range of its own."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > CHUNK:
            yield at, k
            at, held = k, 0
        held += n + 1
    if at < len(sizes):
        yield at, len(sizes)


class Decoder:
    """The bytes of token ids, gathered from one array of all tokens' bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.widths = np.array([len(t) for t in tokens], np.int64)
        self.base = np.cumsum(self.widths) - self.widths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode_flat(self, ids: np.ndarray, offsets: np.ndarray, begin: np.ndarray) -> pa.Array:
        """One binary value per text: its tokens' bytes, each at its own offset. begin: as of encode_flat.

        Offsets that leave a gap or overlap don't belong to these ids, and raise.
        """
        width = self.widths[ids]
        total = np.concatenate([[0], np.cumsum(width)])
        start = total[begin]  # where each text begins
        at = offsets + np.repeat(start[:-1], np.diff(begin))
        if not np.array_equal(at, total[:-1]):
            raise ValueError("offsets don't fit the token ids")
        data = np.empty(total[-1], np.uint8)
        for k in range(0, len(ids), CHUNK):
            a, b, w = total[k], total[min(k + CHUNK, len(ids))], width[k : k + CHUNK]
            data[a:b] = self.bytes[np.arange(a, b) + np.repeat(self.base[ids[k : k + CHUNK]] - at[k : k + CHUNK], w)]
        if total[-1] < 1 << 31:
            return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(start.astype(np.int32)), pa.py_buffer(data)])
        return pa.array([data[a:b].tobytes() for a, b in zip(start[:-1], start[1:], strict=True)], pa.binary())


def encode(docs: DataFrame, ranks_path: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """keep columns, ids array<int> and offsets array<bigint> (byte offset of each token in the UTF-8 text).

    decoded: also a column decoded (binary), what decode() gives for the ids and offsets, without a second
    stage of Python workers. ranks_path: a rank file that the driver reads; the ranks (bounded by the
    vocabulary) are broadcast. A null or empty text has no tokens. Texts are encoded whole, several at a
    time when short; an empty table gives no rows; repeated rows are encoded each; other columns are
    ignored. keep must not name ids, offsets or decoded.
    """
    ranks = read_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key = ("bpe", hash(frozenset(ranks.items())))
    kept = [f"k{i}" for i in range(len(keep))]
    slim = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = worker_table(key, lambda: (Encoder(shared.value), Decoder(shared.value)))
        for batch in batches:
            texts = batch.column("text")
            for a, b in _chunks(texts):
                ids, offsets, begin = encoder.encode_flat(texts.slice(a, b - a).to_pylist())
                columns = [pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(v)) for v in (ids.astype(np.int32), offsets)]
                columns += [decoder.decode_flat(ids, offsets, begin)] * decoded
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(a, b - a) for k in kept], *columns], names=[*kept, "ids", "offsets", "decoded"][: len(kept) + len(columns)])

    made = ["ids array<int>", "offsets array<bigint>", "decoded binary"][: 2 + decoded]
    schema = ", ".join([f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in zip(kept, keep, strict=True)] + made)
    return slim.mapInArrow(run, schema).select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], *[c.split()[0] for c in made])


def decode(tokens: DataFrame, ranks_path: str, *, ids: str = "ids", offsets: str = "offsets", rows: int = 256) -> DataFrame:
    """tokens with one more column decoded (binary; another name if tokens has one): the bytes of the ids, each token at its offset.

    Null or no ids give empty bytes; repeated rows are decoded each, an empty table gives no rows; all
    columns of tokens are kept. An offset that doesn't fit the ids raises. rows: decoded at once.
    """
    ranks = read_ranks(ranks_path)
    shared = tokens.sparkSession.sparkContext.broadcast(ranks)
    key = ("bpe-decoder", hash(frozenset(ranks.items())))
    place, where = tokens.columns.index(ids), tokens.columns.index(offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = worker_table(key, lambda: Decoder(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                column = part.column(place)
                begin = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                flat = [part.column(k).flatten().to_numpy(zero_copy_only=False) for k in (place, where)]
                yield pa.RecordBatch.from_arrays([*part.columns, decoder.decode_flat(*flat, begin)], names=[*[f"c{i}" for i in range(part.num_columns)], "decoded"])

    named = tokens.toDF(*[f"c{i}" for i in range(len(tokens.columns))])
    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(tokens.schema)] + ["decoded binary"])
    return named.mapInArrow(run, schema).toDF(*tokens.columns, own_name(tokens, "decoded"))
