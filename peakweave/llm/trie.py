"""Prefix trie of conversations: digest-keyed parent edges and pointer-jumping rollups.

A node is a distinct sequence of first turns, keyed by its depth and the running exclusive-or of the
digests of (position, turn): 128 bits of SHA-256, so equal keys are taken for equal sequences. Running
values are scans over range-sorted rows, with the last value of each partition carried over to the next,
so that one conversation may hold any share of the rows. Subtree sums take one round per doubling of the
depth: a node's pointer jumps to the ancestor twice as far, and what it has gathered is added there.
Nodes too shallow to jump further leave the rounds, which therefore shrink.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, folder, materialise

CHUNK = 4096  #: characters of an id list that are hashed together
ROWS_A_FILE = 50_000


def _local_scan(lanes: list[str]):
    """Adds part and k (place of a row in its run of equal conv), and turns each lane into its running exclusive-or."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, held, carried = None, 0, np.zeros(len(lanes), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch["conv"].to_numpy()
            begins = np.r_[True, conv[1:] != conv[:-1]]
            first = np.flatnonzero(begins)[np.cumsum(begins) - 1]
            k = np.arange(1, n + 1) - first
            ongoing = (first == 0) & (conv[0] == last)
            k += ongoing * held
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for i, lane in enumerate(lanes):
                x = np.bitwise_xor.accumulate(batch[lane].to_numpy())
                x = x ^ np.where(first > 0, x[first - 1], 0) ^ np.where(ongoing, carried[i], 0)
                carried[i] = x[-1]
                columns[lane] = pa.array(x)
            last, held = conv[-1], int(k[-1])
            yield pa.RecordBatch.from_pydict(columns | {"part": pa.array(np.full(n, part, np.int32)), "k": pa.array(k)})

    return run


def _scanned(rows: DataFrame, order: list[str], lanes: list[str], name: str) -> DataFrame:
    """rows with k, the place of each in the order of its conv (from 1), and lanes as running exclusive-ors; order is dropped."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in rows.columns if c in lanes or c not in order]
    placed = rows.repartitionByRange(parts, "conv", *order).sortWithinPartitions("conv", *order).select(*kept)
    schema = ", ".join(f"{c} {t}" for c, t in placed.dtypes) + ", part int, k bigint"
    placed = materialise(placed.mapInArrow(_local_scan(lanes), schema), name)
    ends = placed.groupBy("part").agg(F.min("conv").alias("first"), F.max(F.struct("conv", "k", *lanes)).alias("last")).orderBy("part").collect()  # a row for each partition
    carry, before = [], None
    for e in ends:
        tail = [e["last"]["k"], *[e["last"][x] for x in lanes]]
        if before and before[0] == e["first"]:
            carry.append((e["part"], e["first"], *before[1]))
            if e["last"]["conv"] == e["first"]:
                tail = [before[1][0] + tail[0], *[a ^ b for a, b in zip(before[1][1:], tail[1:], strict=True)]]
        before = (e["last"]["conv"], tail)
    if not carry:
        return placed.drop("part")
    added = spark.createDataFrame(carry, "part int, conv bigint, add_k bigint" + "".join(f", add_{x} bigint" for x in lanes))
    joined = placed.join(F.broadcast(added), ["part", "conv"], "left")
    new = {"k": F.col("k") + F.coalesce("add_k", F.lit(0))} | {x: F.col(x).bitwiseXOR(F.coalesce(f"add_{x}", F.lit(0).cast("long"))) for x in lanes}
    return joined.withColumns(new).drop("part", "add_k", *[f"add_{x}" for x in lanes])


def ordered_turns(table: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, digest, words) of every turn: place from 1 by turn, digest of role and text, words of the text.

    Null turns come first, ties go by role and the text's digest, repeated rows are turns of their own; a null role or
    text counts as empty. Rows with a null conv belong to no conversation and are left out. Texts of any length are hashed where
    they are read and don't travel. An empty table gives no rows; other columns are ignored.
    """
    r, t = F.coalesce(F.col(f"`{role}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digest = F.unhex(F.sha2(F.encode(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), "UTF-8"), 256))
    rows = table.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), r.alias("role"), digest.alias("digest"), F.regexp_count(t, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words")
    )
    rows = materialise(rows.withColumn("tie", F.col("digest")), "trie-turns")
    return _scanned(rows, ["turn", "role", "tie"], [], "trie-places").withColumnRenamed("k", "place")


def with_shared_heads(turns: DataFrame, *, block: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on shared openings: (conv, place, digest, words), and (conv, length) of all, turnless ones too.

    Conversation c takes the first h turns of conversation c - c % block (all if fewer, none if absent), then its own after
    its first h; h is the unsigned CRC-32 of c in decimal, modulo most + 1.
    """
    sizes = materialise(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "trie-sizes")
    h = (F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % (most + 1)).alias("h")
    info = sizes.select("conv", "n", h, (F.col("conv") - F.col("conv") % block).alias("base"))
    bases = sizes.where(F.col("conv") % block == 0).select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    info = info.join(bases, "base", "left").withColumn("s", F.least("h", F.coalesce("base_n", F.lit(0))))
    info = materialise(info.select("conv", "base", "h", "s", (F.col("s") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-heads")
    own = turns.join(info.select("conv", "h", "s"), "conv").where("place > h").select("conv", (F.col("place") - F.col("h") + F.col("s")).alias("place"), "digest", "words")
    heads = turns.where((F.col("place") <= most) & (F.col("conv") % block == 0)).withColumnRenamed("conv", "base")
    heads = heads.join(info.where("s > 0").select("base", "conv", "s"), "base").where("place <= s").select("conv", "place", "digest", "words")
    return own.unionByName(heads), info.select("conv", "length")


def _list_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (k0, k1, depth, conv) as pieces of comma-joined lists with their part and number."""
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch[c].to_numpy() for c in ("k0", "k1", "depth")]
        conv = batch["conv"].to_pylist()
        begins = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]).tolist()
        out = []
        for at, end in zip(begins, [*begins[1:], len(conv)], strict=True):
            for i in range(at, end, CHUNK // 8):
                out.append((int(keys[0][at]), int(keys[1][at]), int(keys[2][at]), part, seq, ",".join(map(str, conv[i : min(end, i + CHUNK // 8)]))))
                seq += 1
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["k0", "k1", "depth", "part", "seq", "piece"])


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces joined by commas; rows come sorted by key, part and number."""
    key, state, done = None, None, []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["k0", "k1", "depth", "ends_sha256"])

    for batch in batches:
        for k0, k1, depth, piece in zip(*[batch[c].to_pylist() for c in ("k0", "k1", "depth", "piece")], strict=True):
            if (k0, k1, depth) == key:
                state.update(b"," + piece.encode())
                continue
            if key:
                done.append((*key, state.hexdigest()))
            key, state = (k0, k1, depth), hashlib.sha256(piece.encode())
        if len(done) > 10_000:
            yield flush()
            done = []
    if key:
        done.append((*key, state.hexdigest()))
    yield flush()


def _few_files(df: DataFrame, rows: int) -> DataFrame:
    return df.coalesce(max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_A_FILE + 1)))


def _subtree_sums(nodes: DataFrame, deepest: int) -> DataFrame:
    """(id, more_leaves, more_saved): sums of leaf and saved over the proper descendants of nodes (id, parent, depth, leaf, saved).

    Invariant: with pointers `span` up, a node's sums cover descendants less than span below it. Each round adds
    them at the pointer's end, which makes that 2 * span, and doubles the pointers of nodes deep enough.
    """
    spark = nodes.sparkSession
    path = folder(spark, "trie-sums")
    active = nodes.where("depth >= 1").select("id", F.col("parent").alias("ptr"), "depth", "leaf", "saved")
    span, stored = 1, None
    while span <= deepest:
        given = active.groupBy("ptr").agg(F.sum("leaf").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        rows = active.count()
        _few_files(given, rows).write.mode("append").parquet(f"{path}/span={span}")
        if 2 * span <= deepest:
            given = spark.read.schema("ptr bigint, more_leaves bigint, more_saved bigint").parquet(f"{path}/span={span}")
            deep = active.where(F.col("depth") >= 2 * span).join(given.withColumnRenamed("ptr", "id"), "id", "left")
            far = active.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"))
            deep = deep.join(far, "ptr").select("id", F.col("next").alias("ptr"), "depth", (F.col("leaf") + F.coalesce("more_leaves", F.lit(0))).alias("leaf"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
            active = materialise(_few_files(deep, rows), "trie-round")
            if stored is not None:
                discard(stored)
            stored = active
        span *= 2
    if deepest < 1:
        return spark.createDataFrame([], "id bigint, more_leaves bigint, more_saved bigint")
    sums = spark.read.schema("ptr bigint, more_leaves bigint, more_saved bigint").parquet(*[f"{path}/span={1 << i}" for i in range(deepest.bit_length())])
    return sums.groupBy(F.col("ptr").alias("id")).agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row per distinct sequence of first turns, the empty one included.

    turns: (conv, place from 1 without gaps, digest, words); members: (conv, length), turnless ones too. Returns conv_id
    (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless nodes of the
    subtree), saved_tokens (over the subtree, (n_convs - 1) times the words of a node's last turn) and ends_sha256 (SHA-256 of the
    ids of those that end here, ascending, comma-joined; of nothing if none). No members, no rows.
    """
    spark = turns.sparkSession
    hexed = F.sha2(F.concat(F.encode(F.concat(F.col("place").cast("string"), F.lit(":")), "UTF-8"), F.col("digest")), 256)
    lane = [F.conv(F.substring(hexed, at, 16), 16, -10).cast("long") for at in (1, 17)]
    rows = materialise(turns.select("conv", "place", lane[0].alias("e0"), lane[1].alias("e1"), "words").withColumns({"k0": F.col("e0"), "k1": F.col("e1")}), "trie-lanes")
    keyed = _scanned(rows.withColumnRenamed("place", "depth_").withColumn("depth", F.col("depth_")), ["depth_"], ["k0", "k1"], "trie-keys").drop("k")
    discard(rows)
    key = ["k0", "k1", "depth"]
    parents = {"p0": F.col("k0").bitwiseXOR(F.col("e0")), "p1": F.col("k1").bitwiseXOR(F.col("e1"))}
    nodes = keyed.withColumns(parents).groupBy(*key).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.min("p0").alias("p0"), F.min("p1").alias("p1"), F.min("words").alias("words"))
    zero = F.lit(0).cast("long")
    nodes = materialise(nodes.withColumn("id", F.monotonically_increasing_id()), "trie-nodes")
    root = members.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    root = root.select(zero.alias("k0"), zero.alias("k1"), zero.alias("depth"), "n_convs", "conv_id", zero.alias("words"), F.lit(-1).cast("long").alias("id"), F.lit(None).cast("long").alias("parent"))
    above = nodes.select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), (F.col("depth") + 1).alias("depth"), F.col("id").alias("parent"))
    linked = nodes.where("depth > 1").join(above, ["p0", "p1", "depth"]).select(*root.columns)
    top = nodes.where("depth = 1").withColumn("parent", F.lit(-1).cast("long")).select(*root.columns)
    nodes = materialise(linked.union(top).union(root), "trie-linked")
    children = nodes.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = materialise(nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}), "trie-counted")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = _subtree_sums(nodes, deepest)
    over = keyed.join(members, "conv").where("depth = length").select(*key, "conv")
    over = over.union(members.where("length = 0").select(zero, zero, zero, "conv"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = over.repartitionByRange(parts, *key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(_list_pieces, "k0 bigint, k1 bigint, depth bigint, part bigint, seq bigint, piece string")
    ends = pieces.repartition(parts, *key).sortWithinPartitions(*key, "part", "seq").mapInArrow(_list_digests, "k0 bigint, k1 bigint, depth bigint, ends_sha256 string")
    names = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "id", "left").join(ends, key, "left").join(names, "parent", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaf") + F.coalesce("more_leaves", zero)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(table: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """prefix_trie of a table's conversations as they are; odd rows as ordered_turns says."""
    turns = ordered_turns(table, conv=conv, turn=turn, role=role, text=text)
    return prefix_trie(turns, turns.groupBy("conv").agg(F.count(F.lit(1)).alias("length")))
