"""Near-duplicate vectors: sign hashing by random hyperplanes in several tables, exact cosine, components.

Two vectors at angle a agree in one sign with probability 1 - a/pi, so in all `bits` signs of a table
with its power, and meet in at least one of `tables` tables with a probability that is set by the
parameter `miss`. Every pair that meets is verified by its cosine in double precision. Copies of a
vector are one class and are not compared among themselves. Large buckets are split into blocks, and
every pair of blocks is a piece of work of bounded size: nothing is capped. A pair that meets in
several tables counts in the first of them only, so links are counted without listing pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import materialise

BLOCK = 1024  #: vectors of a bucket that meet in one piece of work
STRIP = 256  #: of those, rows that are multiplied at once


def plan_tables(n: int, threshold: float, miss: float, bucket: int = 256) -> tuple[int, int]:
    """(bits, tables): buckets of about `bucket` of n vectors, and a pair exactly at the threshold missed with probability `miss`."""
    bits = max(4, min(30, round(log2(max(n, 2) / bucket)) if n > bucket else 4))
    meet = (1 - acos(threshold) / pi) ** bits
    return bits, ceil(log(miss) / log(1 - meet))


def _planes(seed: int, dim: int, count: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, count))


def _units(vectors: list) -> np.ndarray:
    """Vectors of length 1 in double precision; scaled first, so that no square overflows or vanishes."""
    x = np.stack(vectors).astype(float)
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _codes(vectors: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """id, weight, vec, dim and codes (one integer per table)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits, dtype=np.int64)
        for frame in frames:
            dims = frame["vec"].map(len).to_numpy()
            for dim in np.unique(dims).tolist():
                part = frame[dims == dim]
                if dim not in planes:
                    planes[dim] = _planes(seed, dim, bits * tables)
                signs = _units(part["vec"].to_list()) @ planes[dim] >= 0
                codes = signs.reshape(len(part), tables, bits) @ powers
                yield pd.DataFrame({"id": part["id"], "weight": part["weight"], "vec": part["vec"], "dim": dim, "codes": list(codes.astype(np.int32))})

    return vectors.mapInPandas(run, f"id bigint, weight bigint, vec {vectors.schema['vec'].dataType.simpleString()}, dim int, codes array<int>")


def _spanning(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest position that each of n positions reaches, after joining label (of earlier links) by the links (i, j)."""
    while True:
        least = np.minimum(label[i], label[j])
        after = label.copy()
        for ends in (i, j, label[i], label[j]):
            np.minimum.at(after, ends, least)
        after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def _block(t: int, same: bool, left: list[tuple], right: list[tuple], threshold: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Link counts and spanning links of the pairs of one block; (id, weight, vec, codes) rows.

    A pair is counted in the first table in which it meets. Rows are compared a strip at a time.
    """
    rows = left if same else [*left, *right]
    first = 0 if same else len(left)
    unit, codes, weight = _units([r[2] for r in rows]), np.stack([r[3][: max(t, 1)] for r in rows]), np.array([r[1] for r in rows], float)
    n = np.zeros(len(rows))
    label = np.arange(len(rows))
    for at in range(0, len(left), STRIP):
        i, j = np.nonzero(unit[at : min(at + STRIP, len(left))] @ unit[first:].T >= threshold)
        i, j = i + at, j + first
        if same:
            i, j = i[i < j], j[i < j]
        if t and len(i):
            new = np.concatenate([~(codes[i[k : k + 100_000]] == codes[j[k : k + 100_000]]).any(1) for k in range(0, len(i), 100_000)])
            i, j = i[new], j[new]
        if len(i):
            n += np.bincount(i, weight[j], len(rows)) + np.bincount(j, weight[i], len(rows))
            label = _spanning(len(rows), i, j, label)
    ids = [r[0] for r in rows]
    return {ids[k]: int(n[k]) for k in np.flatnonzero(n).tolist()}, [(ids[k], ids[label[k]]) for k in np.flatnonzero(label != np.arange(len(rows))).tolist()]


def _compare(threshold: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, []
        out: list[tuple] = []

        def close() -> None:
            if key is None:
                return
            _, t, _, i, j = key
            left = [r[:4] for r in rows if r[4] == i]
            right = left if i == j else [r[:4] for r in rows if r[4] == j]
            if left and right:
                counts, links = _block(t, i == j, left, right, threshold)
                out.extend((x, None, n) for x, n in counts.items())
                out.extend((x, r, None) for x, r in links)

        for frame in frames:
            for d, t, c, i, j, ident, w, v, codes, chunk in zip(*[frame[k] for k in ("dim", "t", "code", "i", "j", "id", "weight", "vec", "codes", "chunk")], strict=True):
                if (d, t, c, i, j) != key:
                    close()
                    key, rows = (d, t, c, i, j), []
                rows.append((ident, w, v, codes, chunk))
            if len(out) > 20_000:
                yield _frame(out)
                out = []
        close()
        yield _frame(out)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({"a": [r[0] for r in rows], "b": pd.array([r[1] for r in rows], "Int64"), "n": pd.array([r[2] for r in rows], "Int64")})


def near_duplicates(table: DataFrame, *, ident: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, miss: float = 1e-3, seed: int = 2) -> DataFrame:
    """(id, n_links, component, kept) for every row of table.

    n_links counts the other rows linked directly (copies included), component is the smallest id
    reachable, kept says that a row is its component's. Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing; so do vectors of different lengths with each other. No
    pair under the threshold is linked; a pair exactly at it is missed with probability `miss`, a closer
    one far more rarely. Rows repeated with one id count as rows; a null id counts but names no component, so a
    component without any id has a null name, and rows with a null id are kept. Ties of cosine at the
    threshold link. Vectors of other types than float are compared as doubles, huge and tiny values too.
    An empty table gives no rows, other columns are ignored.
    """
    spark = table.sparkSession
    v = F.col(f"`{vector}`")
    v = v if dict(table.dtypes)[vector] in ("array<float>", "array<double>") else v.cast("array<double>")
    rows = table.select(F.col(f"`{ident}`").cast("long").alias("id"), v.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce((F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = materialise(rows.withColumn("usable", usable).withColumn("number", F.monotonically_increasing_id()), "vectors")
    # One class per distinct vector, named by the number of one of its rows: ids may be null.
    classes = rows.where("usable").groupBy("vec").agg(F.min("number").alias("id"), F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"))
    classes = materialise(classes, "vector-classes")
    n = classes.count()
    bits, tables = plan_tables(n, threshold, miss)
    coded = materialise(_codes(classes.drop("least"), bits, tables, seed), "vector-codes")
    places = coded.select("dim", F.posexplode("codes").alias("t", "code"))
    sizes = materialise(places.groupBy("dim", "t", "code").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1), "vector-buckets")
    met = coded.select("id", "weight", "vec", "dim", "codes", F.posexplode("codes").alias("t", "code")).join(sizes, ["dim", "t", "code"])
    chunks = F.expr(f"(m + {BLOCK} - 1) div {BLOCK}").cast("int")
    met = met.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("id", "t"), F.col("chunks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    work = met.select("dim", "t", "code", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "id", "weight", "vec", F.slice("codes", 1, F.greatest("t", F.lit(1))).alias("codes"), "chunk")
    order = ["dim", "t", "code", "i", "j"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = work.repartition(parts, *order).sortWithinPartitions(*order).mapInPandas(_compare(threshold), "a bigint, b bigint, n bigint")
    found = materialise(found, "vector-links")
    counts = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("links"))
    labels = components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "node")
    known = classes.join(counts, F.col("id") == F.col("a"), "left").join(labels, F.col("id") == F.col("node"), "left").withColumn("group", F.coalesce("component", "id"))
    names = known.groupBy("group").agg(F.min("least").alias("name"))
    known = known.join(names, "group").select("vec", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("name").alias("component"))
    linked = rows.where("usable").join(materialise(known, "vector-labels"), "vec").select("id", "n_links", "component")
    alone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))
