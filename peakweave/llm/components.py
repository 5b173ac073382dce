"""Connected components of a distributed edge list by alternating large-star and small-star rounds.

Nothing is collected: a round is two aggregations (with map-side combine) and two joins on node ids,
which adaptive execution can split where a node has very many edges. Each round is written to the
shared folder, which cuts lineage and survives lost executors. Before the first round every partition
contracts its own edges, so long chains and dense groups arrive as short stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialise


ROWS_A_FILE = 50_000


def union_find(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Root (smallest member) of every node named in pairs."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p] if p in parent else p
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def _contracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def pairs() -> Iterator[tuple[int, int]]:
        for frame in frames:
            yield from zip(frame["a"].tolist(), frame["b"].tolist(), strict=True)

    roots = union_find(pairs())
    rows = [(x, r) for x, r in roots.items() if x != r]
    for at in range(0, len(rows), 100_000):
        yield pd.DataFrame(rows[at : at + 100_000], columns=["a", "b"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): smallest id reachable, for every node of edges (a, b: bigint); rows with nulls and loops are left out."""
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = materialise(e.mapInPandas(_contracted, "a bigint, b bigint").distinct(), "cc-start")
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, mark = e.count(), None
    for _ in range(most_rounds):
        files = min(parts, rows // ROWS_A_FILE + 1)  # rounds over few edges shouldn't write hundreds of files
        # Large star: every larger neighbour of u is tied to the smallest node around u.
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: u and its smaller neighbours are tied to the smallest of them.
        tied = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(tied, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, e = e, materialise(small.union(tied.select("a", F.col("m").alias("b"))).distinct().coalesce(files), "cc-round")
        discard(last)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark, rows = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
