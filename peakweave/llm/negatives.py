"""Hard negatives of anchor vectors by blocked dense products in double precision.

The anchors are streamed through the driver in blocks of a fixed number of bytes; each block is
broadcast and multiplied with every candidate in tiles (BLAS on float64, exact while products stay
below 2^53, Python integers beyond). A task keeps only the best few of each anchor; these partial lists
merge by rank. A first pass finds each anchor's positives, a second one the negatives inside each
positive's window of scores. No pair of rows is ever shuffled: what moves is a few rows per anchor and task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, folder, materialise

BLOCK_BYTES = 16 << 20  #: of anchors that are broadcast at once
TILE = (256, 2048)  #: anchors and candidates that are multiplied at once
EXACT = float(1 << 52)  #: integer products whose norms multiply to less are exact in float64
LEAST, MOST = -(1 << 63), (1 << 63) - 1


@dataclass
class Anchors:
    """Anchors of one length, ordered by norm so that wide ones share tiles."""

    row: np.ndarray
    label: np.ndarray
    vec: np.ndarray
    norm: np.ndarray
    low: np.ndarray | None = None  #: windows of the positives: anchors x positives
    high: np.ndarray | None = None


@dataclass
class Best:
    """The best few (score, id, row) of each anchor so far: larger scores first, then smaller ids."""

    k: int
    n: int
    score: np.ndarray = field(init=False)
    ident: np.ndarray = field(init=False)
    row: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.score = np.full((self.n, self.k), LEAST, np.int64)
        self.ident = np.full((self.n, self.k), MOST, np.int64)
        self.row = np.full((self.n, self.k), -1, np.int64)

    def take(self, at: slice, scores: np.ndarray, allowed: np.ndarray, ident: np.ndarray, row: np.ndarray) -> None:
        """Merge a tile: scores and allowed are anchors x candidates."""
        last, last_id, open_ = self.score[at, -1:], self.ident[at, -1:], self.row[at, -1:] < 0
        hit = allowed & (open_ | (scores > last) | ((scores == last) & (ident < last_id)))
        if hit.sum() > 8 * hit.shape[0] * self.k and hit.shape[1] > self.k:  # far more than can stay: raise the bar first
            bar = np.partition(np.where(hit, scores, LEAST), -self.k, axis=1)[:, -self.k, None]
            hit &= scores >= bar
        i, j = np.nonzero(hit)
        if not len(i):
            return
        n = hit.shape[0]
        old = np.repeat(np.arange(n), self.k)
        which = np.concatenate([old, i])
        score = np.concatenate([self.score[at].ravel(), scores[i, j]])
        name = np.concatenate([self.ident[at].ravel(), ident[j]])
        rows = np.concatenate([self.row[at].ravel(), row[j]])
        order = np.lexsort((rows, name, ~score, rows < 0, which))
        starts = np.searchsorted(which[order], np.arange(n))
        best = order[starts[:, None] + np.arange(self.k)]
        self.score[at], self.ident[at], self.row[at] = score[best], name[best], rows[best]


def _product(a: np.ndarray, b: np.ndarray, norm_a: np.ndarray, norm_b: np.ndarray) -> np.ndarray:
    """Integer inner products as int64, in the range of a long; columns too wide for float64 in Python integers."""
    wide = norm_b * norm_a.max(initial=0.0) >= EXACT
    if not wide.any():
        return (a @ b.T).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    if not wide.all():
        out[:, ~wide] = (a @ b[~wide].T).astype(np.int64)
    exact = [[int(x) for x in r] for r in a]
    for j in np.flatnonzero(wide).tolist():
        other = [int(x) for x in b[j]]
        out[:, j] = [max(-MOST, min(MOST, sum(x * y for x, y in zip(r, other, strict=True)))) for r in exact]
    return out


def _vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (positions, matrix) of a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    values, starts = column.values.to_numpy(zero_copy_only=False).astype(float, copy=False), column.offsets.to_numpy()
    return {int(d): (p := np.flatnonzero(sizes == d), values[starts[p][:, None] + np.arange(d)]) for d in np.unique(sizes).tolist()}


def _norms(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((m * m).sum(1))


def _scan(shared, kept: int, seek_positives: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Anchors] = shared.value
        best: dict[tuple[int, int], Best] = {}
        for batch in batches:
            ident = batch["id"].fill_null(MOST).to_numpy()
            row, label = batch["row"].to_numpy(), batch["label"].to_numpy()
            for dim, (at, matrix) in _vectors(batch["vec"]).items():
                if dim not in blocks:
                    continue
                block = blocks[dim]
                norm = _norms(matrix)
                for c in range(0, len(at), TILE[1]):
                    part = at[c : c + TILE[1]]
                    for r in range(0, len(block.row), TILE[0]):
                        rows = slice(r, min(r + TILE[0], len(block.row)))
                        scores = _product(block.vec[rows], matrix[c : c + TILE[1]], block.norm[rows], norm[c : c + TILE[1]])
                        same = block.label[rows, None] == label[part]
                        for k in range(1 if seek_positives else block.low.shape[1]):
                            if seek_positives:
                                allowed = same & (block.row[rows, None] != row[part])
                            else:
                                allowed = ~same & (scores >= block.low[rows, k, None]) & (scores <= block.high[rows, k, None])
                            if (dim, k) not in best:
                                best[dim, k] = Best(kept, len(block.row))
                            best[dim, k].take(rows, scores, allowed, ident[part], row[part])
        for (dim, k), found in best.items():
            i, j = np.nonzero(found.row >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks[dim].row[i]), pa.array(np.full(len(i), k, np.int32)), pa.array(found.ident[i, j], mask=found.ident[i, j] == MOST), pa.array(found.row[i, j]), pa.array(found.score[i, j])],
                names=["anchor", "window", "id", "row", "score"],
            )

    return run


_FOUND = "anchor bigint, window int, id bigint, row bigint, score bigint"


def _ranked(found: DataFrame, kept: int) -> DataFrame:
    """The best of all tasks' lists, with rank from 1."""
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)


def _blocks(anchors: DataFrame, most_bytes: int) -> Iterator[dict[int, Anchors]]:
    """Anchors in blocks of at most most_bytes (one at least), a partition of them at the driver at a time."""

    def packed(rows: list) -> dict[int, Anchors]:
        out = {}
        for dim in {len(r["vec"]) for r in rows}:
            own = [r for r in rows if len(r["vec"]) == dim]
            vec = np.array([r["vec"] for r in own], float).reshape(len(own), dim)
            order = np.argsort(norm := _norms(vec), kind="stable")
            out[dim] = Anchors(np.array([r["row"] for r in own], np.int64)[order], np.array([r["label"] for r in own], np.int64)[order], vec[order], norm[order])
        return out

    rows, held = [], 0
    for r in anchors.toLocalIterator():
        size = 8 * len(r["vec"]) + 128
        if rows and held + size > most_bytes:
            yield packed(rows)
            rows, held = [], 0
        rows.append(r)
        held += size
    if rows:
        yield packed(rows)


def hard_negatives(
    table: DataFrame,
    *,
    anchors: Column,
    ident: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows where `anchors` holds.

    A component x counts as floor(scale * x), x as double; a score is the integer inner product. An anchor's
    positives are its first `positives` other rows of the same label, larger scores first, ties by smaller id; the
    negatives of a positive are the first `negatives` rows of other labels with
    low * positive_score <= 100 * score <= high * positive_score.

    Rows with a null label or vector, or a null or non-finite component, take no part. Vectors of different
    lengths aren't compared; empty ones score 0 among themselves. Rows repeated with one id are rows of their
    own; a null id is no anchor's unless `anchors` says so, and comes last among ties. Scores beyond the range
    of a long stay at its ends, products of scale that overflow at the largest double. An empty table, or no
    anchor, gives no rows; other columns are ignored. Labels are compared as longs.
    """
    spark = table.sparkSession
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # floor() of Spark returns a long; doubles beyond 2^53 are integers already.
    whole = F.transform("vec", lambda v: F.when(F.abs(v * scale) < 2.0**53, F.floor(v * scale).cast("double")).otherwise(F.greatest(F.least(v * scale, F.lit(1.7e308)), F.lit(-1.7e308))))
    rows = table.select(
        F.col(f"`{ident}`").cast("long").alias("id"), (F.col(f"`{label}`") if isinstance(label, str) else label).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), x.alias("vec")
    ).where(F.col("label").isNotNull() & F.col("vec").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = materialise(rows.withColumns({"vec": whole, "row": F.monotonically_increasing_id()}), "negatives-rows")
    candidates = rows.select("id", "row", "label", "vec")
    path = folder(spark, "negatives")
    written = False
    for block in _blocks(rows.where("anchor").select("row", "label", "vec"), block_bytes):
        shared = spark.sparkContext.broadcast(block)
        first = materialise(_ranked(candidates.mapInArrow(_scan(shared, positives, True), _FOUND), positives), "negatives-positives")
        shared.destroy()
        place = {int(r): (dim, i) for dim, b in block.items() for i, r in enumerate(b.row)}
        for b in block.values():
            b.low, b.high = np.full((len(b.row), positives), MOST, np.int64), np.full((len(b.row), positives), LEAST, np.int64)
        for r in first.select("anchor", "rank", "score").collect():  # at most `positives` of each anchor of one block
            dim, i = place[r["anchor"]]
            block[dim].low[i, r["rank"] - 1] = max(LEAST, -(-low * r["score"] // 100))
            block[dim].high[i, r["rank"] - 1] = min(MOST, high * r["score"] // 100)
        shared = spark.sparkContext.broadcast(block)
        second = _ranked(candidates.mapInArrow(_scan(shared, negatives, False), _FOUND), negatives)
        pairs = first.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = second.join(pairs, ["anchor", "window"]).select("anchor", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.mode("append").parquet(path)
        shared.destroy()
        discard(first)
        written = True
    schema = "anchor bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    found = spark.read.schema(schema).parquet(path) if written else spark.createDataFrame([], schema)
    names = rows.where("anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return found.join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
