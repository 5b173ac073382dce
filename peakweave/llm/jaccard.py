"""N-gram Jaccard self-join: T-occurrence search with DivideSkip in groups that prefixes of shingles form.

1. Texts become sets of hashed word shingles; equal sets are one class and meet no more.
2. A pair over the threshold shares a shingle among the first n - ceil(0.8 n) + 1 of either set, in any
   fixed order of shingles. The order puts shingles that several sets hold last (a list and a filter,
   sized by the data, say which), and after them those that aren't counted, so passages that many
   documents share stay out of the prefixes. Classes that share a prefix shingle form candidate groups:
   connected components, no pairs.
3. In a group, inverted lists answer "which sets share at least T shingles with this one": DivideSkip
   heap-merges the short lists and binary-probes the long ones. In a large group all members first ask
   a small index of a few of them; what links to the member with most links is one component, so only
   the rest asks the index of the whole group, in chunks. Every link comes from a search.
All steps are lossless: any pair with Jaccard >= threshold ends in one component.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import broadcast_if_small, discard, materialise, own_name, worker_table

WORDS = 5
SHARE = (4, 5)  #: least Jaccard similarity as a fraction
COUNTED_BITS = 1  #: document frequencies are counted for hashes below 2**(64 - COUNTED_BITS): prefixes seldom reach beyond
REPEATED_FROM = 3  #: sets from which a shingle counts as repeated
WINDOW = 1_500_000  #: shingles that a task holds at once
CHUNK, CHUNKS, CHUNK_BYTES = 128, 64, 8 << 20  #: a group of m sets is searched in chunks of m / CHUNKS sets, CHUNK at least, of about CHUNK_BYTES at most
QUERIES = 256  #: queries that meet one chunk in one piece of work
SPREAD = 4  #: tasks of the search for each shuffle partition, so that few pieces of work meet in one
PIVOTS = 4
_MU = 0.01  #: cost of a probe against a merge step in the choice of long lists

_MULT, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    """Word -> 64-bit hash, of as many words as a worker should hold."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h



def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text; A-Z lower-cased; fewer words are one shingle."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(worker_table("words", _Words).__getitem__, parts), np.uint64, len(parts))
    k = min(words, len(w))
    m = len(w) - k + 1
    h = np.full(m, k, np.uint64)
    for i in range(k):
        h = h * _MULT + w[i : i + m]
        h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(31)
    return np.unique(h)


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """128-bit digest of a set as two signed longs."""
    d = xxhash.xxh3_128_digest(tokens.tobytes())
    a, b = np.frombuffer(d, np.int64)
    return int(a), int(b)


def least_overlap(n: int, m: int) -> int:
    """Smallest intersection of sets of n and m with i / (n + m - i) >= SHARE."""
    p, q = SHARE
    return -(-p * (n + m) // (p + q))


def prefix_length(n: int) -> int:
    p, q = SHARE
    return n - -(-p * n // q) + 1


def _survey(docs: DataFrame, buckets: int) -> DataFrame:
    """kind 0: id, n and digest (a, b) of each row; kind 1: for each bucket of hashes (a) the shingles of the distinct
    sets of a window, packed: six bytes each, and for those of several sets four more with how many besides."""
    bits = buckets.bit_length() - 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        size = 0

        def packed() -> pd.DataFrame:
            every = np.concatenate(held)
            tokens, count = np.unique(every[every < np.uint64(1 << (64 - COUNTED_BITS))], return_counts=True)
            bucket = (tokens >> np.uint64(64 - COUNTED_BITS - bits)).astype(np.int64)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            six = tokens.view(np.uint8).reshape(-1, 8)[:, :6]
            rows = []
            for k in np.flatnonzero(np.diff(cut)).tolist():
                part = slice(cut[k], cut[k + 1])
                more = np.flatnonzero(count[part] > 1)
                extra = np.concatenate([six[part][more], (count[part][more] - 1).astype(np.uint32).view(np.uint8).reshape(-1, 4)], 1)
                rows.append((k, six[part].tobytes(), extra.tobytes()))
            return pd.DataFrame({"kind": 1, "id": pd.array([None] * len(rows), "Int64"), "n": 0, "a": [r[0] for r in rows], "b": 0, "once": [r[1] for r in rows], "more": [r[2] for r in rows]})

        for frame in frames:
            n, a, b = [], [], []
            for text in frame["text"]:
                tokens = shingles(text)
                d = digest(tokens)
                n.append(len(tokens))
                a.append(d[0])
                b.append(d[1])
                if len(tokens) and d not in seen:
                    seen.add(d)
                    held.append(tokens)
                    size += len(tokens)
                    if size > WINDOW:
                        yield packed()
                        held.clear()
                        size = 0
            yield pd.DataFrame({"kind": 0, "id": frame["id"].astype("Int64"), "n": n, "a": a, "b": b, "once": None, "more": None})
        if held:
            yield packed()

    return docs.mapInPandas(run, "kind int, id bigint, n bigint, a bigint, b bigint, once binary, more binary")


def _slots(six: np.ndarray, size: int) -> list[np.ndarray]:
    """Two places of each shingle in a bucket's slice of the filter, from its low 48 bits."""
    return [(six >> np.uint64(k)) % np.uint64(size) for k in (0, 17)]


def _wide(six: bytes, step: int) -> np.ndarray:
    """Six-byte numbers at the start of records of `step` bytes."""
    raw = np.frombuffer(six, np.uint8).reshape(-1, step)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw[:, :6]
    return out.view(np.uint64)[:, 0]


def _repeated_shingles(survey: DataFrame, buckets: int, marks: int, ranked: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low 48 bits of the most repeated shingles, sorted; their counts; filter slices by bucket).

    Each bucket of hashes is counted by itself; what reaches the driver are the filter and the list,
    of fixed sizes.
    """
    size, top = marks // buckets, max(1, ranked // buckets)

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        tokens, n = np.unique(np.concatenate([_wide(x, 6) for x in frame["once"]]), return_counts=True)
        extra = b"".join(frame["more"])
        if extra:
            plus = np.frombuffer(extra, np.uint8).reshape(-1, 10)[:, 6:].copy().view(np.uint32)[:, 0]
            np.add.at(n, np.searchsorted(tokens, _wide(extra, 10)), plus)
        again = n >= REPEATED_FROM
        tokens, n = tokens[again], n[again]
        bits = np.zeros(size, bool)
        for place in _slots(tokens, size):
            bits[place] = True
        best = np.argsort(-n, kind="stable")[:top]
        return pd.DataFrame({"a": frame["a"].iloc[:1], "marks": [np.packbits(bits).tobytes()], "tokens": [tokens[best].tobytes()], "counts": [n[best].astype(np.int64).tobytes()]})

    found = survey.where("kind = 1").groupBy("a").applyInPandas(count, "a bigint, marks binary, tokens binary, counts binary").collect()
    filter_ = np.zeros((buckets, size // 8), np.uint8)
    keys, counts = [], []
    for r in found:
        filter_[r["a"]] = np.frombuffer(r["marks"], np.uint8)
        keys.append(np.frombuffer(r["tokens"], np.uint64))
        counts.append(np.frombuffer(r["counts"], np.int64))
    key, n = (np.concatenate(keys), np.concatenate(counts)) if keys else (np.empty(0, np.uint64), np.empty(0, np.int64))
    order = np.argsort(key, kind="stable")
    return key[order], n[order], filter_


def _ranks(s: np.ndarray, hot: np.ndarray, count: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """0 for shingles of fewer than REPEATED_FROM sets, 1 for marked ones, more for those with a count, most for those
    that aren't counted. Any function of the shingle alone is right."""
    buckets, size = len(marks), marks.shape[1] * 8
    inside = s < np.uint64(1 << (64 - COUNTED_BITS))
    bucket = (s >> np.uint64(64 - COUNTED_BITS - (buckets.bit_length() - 1))).astype(np.int64)
    bucket[~inside] = 0
    six = s & np.uint64((1 << 48) - 1)
    marked = inside
    for place in _slots(six, size):
        at = place.astype(np.int64)
        marked = marked & ((marks[bucket, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)
    out = marked.astype(np.int64)
    if len(hot):
        at = np.searchsorted(hot, six)
        at[at == len(hot)] = 0
        out = np.where(marked & (hot[at] == six), 1 + count[at], out)
    return np.where(inside, out, np.iinfo(np.int64).max)


def _prefixes(docs: DataFrame, shared) -> DataFrame:
    """(token, cls, n, hot) for the prefix of each set of n; a partition sends equal sets once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot, count, marks = shared.value
        seen: set[tuple[int, int]] = set()
        for frame in frames:
            tokens, cls, size, flags = [], [], [], []
            for text in frame["text"]:
                s = shingles(text)
                if not len(s) or (d := digest(s)) in seen:
                    continue
                seen.add(d)
                rank = _ranks(s, hot, count, marks)
                first = np.lexsort((s, rank))[: prefix_length(len(s))]
                tokens.append(s[first].view(np.int64))
                cls.append(np.full(len(first), d[0]))
                size.append(np.full(len(first), len(s)))
                flags.append(rank[first] > 0)
            if tokens:
                yield pd.DataFrame({"token": np.concatenate(tokens), "cls": np.concatenate(cls), "n": np.concatenate(size), "hot": np.concatenate(flags)})

    return docs.mapInPandas(run, "token bigint, cls bigint, n bigint, hot boolean")


def band(n: Column) -> Column:
    """Sizes in steps of 1 / SHARE: sets that can reach the threshold are at most one band apart."""
    p, q = SHARE
    return F.floor(F.ln(n.cast("double")) / F.lit(float(np.log(q / p)) + 1e-9)).cast("long")


def _candidate_edges(rows: DataFrame) -> DataFrame:
    """Edges that connect the classes that share a prefix shingle and are near enough in size.

    A shingle that isn't hot occurs in fewer than REPEATED_FROM sets: its few rows meet in a window, and
    neighbours in size are tied. Hot ones (marked or not counted) are aggregated before the shuffle, by
    bands of size (a set is in its own and the next), and joined back, where adaptive execution can split
    them.
    """
    p, q = SHARE
    by_size = Window.partitionBy("token").orderBy("n", "cls")
    cold = rows.where("not hot").select("cls", "n", F.lag("cls").over(by_size).alias("m"), F.lag("n").over(by_size).alias("k"))
    cold = cold.where((F.col("cls") != F.col("m")) & (q * F.col("k") >= p * F.col("n"))).select("cls", "m")
    hot = rows.where("hot").select("token", "cls", F.explode(F.array(band(F.col("n")), band(F.col("n")) + 1)).alias("band"))
    least = hot.groupBy("token", "band").agg(F.min("cls").alias("m"), F.max("cls").alias("z")).where("m <> z").select("token", "band", "m")
    warm = hot.join(least, ["token", "band"]).where("cls <> m").select("cls", "m")
    return cold.union(warm).select(F.col("cls").alias("a"), F.col("m").alias("b")).distinct()


class Index:
    """Inverted lists over some sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.tokens, start = np.unique(flat[order], return_index=True)
        self.bounds = np.append(start, len(flat)).tolist()
        self.postings = array("i", owner[order].astype(np.int32).tobytes())

    def search(self, query: np.ndarray) -> list[int]:
        """Members whose overlap with query reaches the least overlap of their sizes (T-occurrence by DivideSkip)."""
        n = len(query)
        if not n or not len(self.tokens):
            return []
        at = np.searchsorted(self.tokens, query)
        at[at == len(self.tokens)] = 0
        at = at[self.tokens[at] == query]
        p, q = SHARE
        least = -(-p * n // q)
        if len(at) < least:
            return []
        bounds, postings = self.bounds, self.postings
        lists = sorted(((bounds[k + 1] - bounds[k], bounds[k]) for k in at.tolist()), reverse=True)
        longest = lists[0][0]
        n_long = min(least - 1, int(least / (_MU * np.log2(longest + 1) + 1)))
        long_, short = lists[:n_long], lists[n_long:]
        # Heap-merge of the short lists: members with at least least - n_long occurrences.
        need, found, current, times = least - n_long, [], -1, 0
        for member in heapq.merge(*[postings[a : a + k] for k, a in short]):
            if member == current:
                times += 1
            else:
                if times >= need:
                    found.append((current, times))
                current, times = member, 1
        if times >= need:
            found.append((current, times))
        out = []
        for member, times in found:
            wanted = least_overlap(n, int(self.sizes[member]))
            for left, (k, a) in zip(range(len(long_), 0, -1), long_, strict=True):
                if times >= wanted or times + left < wanted:
                    break
                i = bisect_left(postings, member, a, a + k)
                times += i < a + k and postings[i] == member
            if times >= wanted:
                out.append(member)
        return out


def _search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (a, b) from rows sorted by (grp, chunk, part, asks); asks: 0 is in the index, 1 asks it, 2 both.

    Links are those that span what a piece of work joins; a member that asks pivots (chunk < 0) gets its
    links to all of them. The index of a piece is held in memory, the sets that ask it pass by.
    """
    out: list[tuple[int, int]] = []
    key, ids, sets, index, parent = None, [], [], None, {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    def ask(i: int, s: np.ndarray) -> int:
        joined = 0
        for member in index.search(s):
            a, b = root(i), root(ids[member])
            if a != b:
                parent[max(a, b)] = min(a, b)
                joined += 1
            if a != b or key[1] < 0 and i != ids[member]:
                out.append((i, ids[member]))
        return joined

    def close() -> None:
        """Let the members of a whole small group ask each other, until all are joined."""
        nonlocal index
        if both and len(ids) > 1:
            index, parts = Index(sets), len(ids)
            for i, s in zip(ids, sets, strict=True):
                if parts > 1:
                    parts -= ask(i, s)

    both = False
    for frame in frames:
        for g, c, p, i, s, x in zip(frame["grp"], frame["chunk"], frame["part"], frame["id"], frame["tokens"], frame["asks"], strict=True):
            if (g, c, p) != key:
                close()
                key, ids, sets, index, parent, both = (g, c, p), [], [], None, {}, x == 2
            tokens = np.frombuffer(s, np.uint64)
            if x != 1:
                ids.append(i)
                sets.append(tokens)
            else:
                index = index or Index(sets)
                sets = []
                ask(i, tokens)
        if len(out) > 50_000:
            yield pd.DataFrame(out, columns=["a", "b"])
            out = []
    close()
    yield pd.DataFrame(out, columns=["a", "b"])


def _searched(work: DataFrame) -> DataFrame:
    """Links of pieces of work (grp, chunk, part, id, tokens, asks)."""
    n = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["grp", "chunk", "part"]
    return work.repartition(SPREAD * n, *key).sortWithinPartitions(*key, "asks").select(*key, "id", "tokens", "asks").mapInPandas(_search, "a bigint, b bigint")


def _links(sets: DataFrame) -> DataFrame:
    """Links (a, b) that join the similar sets of each group. sets: grp, id, tokens, m (members of the group), large."""
    big = sets.where("large")
    zero = F.lit(0).cast("long")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    # The pivots of a large group are a few members drawn by hash; all members ask them.
    drawn = [big.groupBy("grp", "m").agg(F.min(F.struct(F.xxhash64("id", F.lit(k)), F.col("id").alias("id"))).alias("x")).select("grp", "m", F.col("x.id").alias("id")) for k in range(PIVOTS)]
    pivots = materialise(reduce(DataFrame.union, drawn).distinct().withColumn("parts", F.expr(f"(m + {QUERIES} - 1) div {QUERIES}")), "jaccard-pivots")
    part = F.pmod(F.xxhash64("id", F.lit("pivot")), F.expr(f"(m + {QUERIES} - 1) div {QUERIES}"))
    held = pivots.select("id", every("parts").alias("part")).join(big.select("grp", "id", "tokens"), "id")
    asking = big.select("grp", "id", "tokens", part.alias("part"), F.lit(1).alias("asks")).unionByName(held.select("grp", "id", "tokens", "part", F.lit(0).alias("asks")))
    tested = materialise(_searched(asking.withColumn("chunk", F.lit(-1).cast("long"))), "jaccard-pivot-links")
    # What links to the pivot with most links is one component.
    tally = tested.groupBy("b").agg(F.count(F.lit(1)).alias("k")).join(pivots.select("grp", F.col("id").alias("b")), "b")
    best = tally.groupBy("grp").agg(F.max(F.struct("k", "b")).alias("x")).select(F.col("x.b").alias("b"))
    settled = materialise(tested.join(best, "b").select(F.col("a").alias("id")).union(best.select(F.col("b").alias("id"))).distinct(), "jaccard-settled")
    # Everything else of a large group asks the chunks of its own and the neighbouring bands.
    slim = big.select("grp", "id", band(F.octet_length("tokens") / 8).alias("band"), F.octet_length("tokens").alias("bytes"))
    rest = slim.join(settled, "id", "left_anti").select("grp", "id", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    sizes = slim.groupBy("grp", "band").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("bytes")).join(rest.groupBy("grp", "band").agg(F.count(F.lit(1)).alias("r")), ["grp", "band"])
    chunks = F.greatest(F.least(F.ceil(F.col("m") / CHUNK), F.lit(CHUNKS).cast("long")), F.ceil(F.col("bytes") / CHUNK_BYTES))
    sizes = materialise(sizes.select("grp", "band", chunks.alias("chunks"), F.expr(f"(r + {QUERIES} - 1) div {QUERIES}").alias("parts")), "jaccard-bands")
    place = F.col("band") * F.lit(1 << 32)
    asking = rest.join(sizes, ["grp", "band"]).select("id", "grp", place.alias("place"), every("chunks").alias("chunk"), F.pmod(F.xxhash64("id", F.lit("ask")), F.col("parts")).alias("part"), F.lit(1).alias("asks"))
    placed = slim.join(sizes, ["grp", "band"]).select("id", "grp", place.alias("place"), F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk"), every("parts").alias("part"), F.lit(0).alias("asks"))
    keys = asking.union(placed).select("id", "grp", (F.col("place") + F.col("chunk")).alias("chunk"), "part", "asks")
    large_work = keys.join(big.select("id", "tokens"), "id").select("grp", "id", "tokens", "chunk", "part", "asks")
    small = sets.where("not large").select("grp", "id", "tokens", zero.alias("chunk"), zero.alias("part"), F.lit(2).alias("asks"))
    return _searched(small.union(large_work)).union(tested)


def _plan(docs: DataFrame) -> tuple[int, int, int]:
    """Buckets of hashes (of about two million shingles), bits of the filter of repeated shingles, and entries of
    the list of the most repeated ones, from the bytes of all texts. The bounds (256 MB, 32 MB) bound what is
    broadcast; a filter that is too small makes candidate groups larger, never results different."""
    shingles_ = max(1, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6)
    two = lambda x, least, most: min(most, max(least, 1 << int(x).bit_length()))
    return two(shingles_ >> 22, 64, 1 << 16), two(shingles_ >> 3, 1 << 20, 1 << 31), two(shingles_ >> 12, 1 << 12, 1 << 21)


def jaccard_components(docs: DataFrame, *, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component) for every row of docs.

    Sets hold the distinct shingles of WORDS words of the whole text, A-Z lower-cased, words parted by
    ASCII white space; fewer words are one shingle; null, empty and blank texts have empty sets and link
    with nothing (their component is their own id). Two rows link when their sets' Jaccard similarity is
    at least SHARE; component is the smallest id reachable. Repeated rows and ids share their class's
    component; a null id is in its class's component but names none. An empty table gives no rows, other
    columns are ignored. ident must be an integer.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{ident}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    buckets, marks, ranked = _plan(slim)
    survey = materialise(_survey(slim, buckets), "jaccard-survey")
    shared = spark.sparkContext.broadcast(_repeated_shingles(survey, buckets, marks, ranked))
    rows = survey.where("kind = 0").select("id", "n", "a", "b")
    rows, packed = materialise(rows, "jaccard-rows"), survey
    discard(packed)
    prefixes = materialise(_prefixes(slim.select("text"), shared), "jaccard-prefixes")
    edges = materialise(_candidate_edges(prefixes), "jaccard-candidates")
    discard(prefixes)
    groups = materialise(components(edges), "jaccard-groups")
    discard(edges)

    classes = rows.where("n > 0").groupBy("a", "b").agg(F.min("id").alias("rep"), F.max("n").alias("n"))
    members = classes.where("rep is not null").join(groups, F.col("a") == F.col("id")).select("a", "b", "n", "rep", F.col("component").alias("grp"))
    tally = members.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum(8 * F.col("n")).alias("bytes")).where("m > 1")
    tally = tally.select("grp", "m", ((F.col("m") > CHUNK) | (F.col("bytes") > CHUNK_BYTES)).alias("large"))
    sized = materialise(members.drop("n").join(tally, "grp"), "jaccard-members")

    def collect_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [shingles(t) for t in frame["text"]]
            same = np.array([digest(s) == (a, b) for s, a, b in zip(sets, frame["a"], frame["b"], strict=True)], bool)
            yield pd.DataFrame({"grp": frame["grp"], "id": frame["rep"], "tokens": [s.tobytes() for s in sets], "m": frame["m"], "large": frame["large"]})[same]

    fetched = slim.join(broadcast_if_small(sized), F.col("id") == F.col("rep")).select("text", "a", "b", "rep", "grp", "m", "large")
    sets = fetched.mapInPandas(collect_sets, "grp bigint, id bigint, tokens binary, m bigint, large boolean")
    sets = materialise(sets, "jaccard-sets")
    links = materialise(_links(sets), "jaccard-links")
    discard(sets)
    labels = components(links)

    labelled = classes.join(labels, F.col("rep") == F.col("id"), "left").select("a", "b", F.coalesce("component", "rep").alias("component"))
    out = rows.join(materialise(labelled, "jaccard-classes"), ["a", "b"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))


def drop_near_copies(docs: DataFrame, *, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is the smallest of their component, with all columns.

    Rows with a null id stay, and so do all rows of an id that one of its components is named by. Empty
    texts stay, an empty table gives no rows. Only identifiers are shuffled unless very many rows go.
    """
    found = jaccard_components(docs, text=text, ident=ident).where("id is not null")
    gone = found.groupBy("id").agg(F.max((F.col("id") == F.col("component")).cast("int")).alias("named")).where("named = 0").select(F.col("id").alias(mark := own_name(docs, "__gone")))
    gone = broadcast_if_small(materialise(gone, "jaccard-gone"))
    return docs.join(gone, F.col(f"`{ident}`").cast("long") == F.col(mark), "left_anti")
