"""Sharding along a Hilbert curve: rows that agree in several metadata dimensions land in the same few files.

Each dimension is quantised at equi-depth cut points, the cells are put in Hilbert order, and the order
is cut into runs, one per shard. Everything on the executors is a built-in function.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import broadcast_if_small, materialise, own_name

BITS = 5  #: bits of each quantised dimension
IMAGE_BYTES = 7  #: bytes of a string, after the prefix that all values share, that make its numeric image


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def hilbert_index(coords: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve through len(coords) dimensions of `bits` bits each (bigint).

    Skilling's transform: undo the excess rotations from the highest bit down, Gray-encode, interleave.
    """
    n = len(coords)
    if n * bits > 62:
        raise ValueError("dimensions x bits must not exceed 62")
    start = F.array(*[c.cast("long") for c in coords])

    def rotate(x: Column, q: Column) -> Column:
        p = q - 1
        for i in range(n):
            x = _bound(x, lambda v: step(v, i, p, q))  # noqa: B023
        return x

    def step(x: Column, i: int, p: Column, q: Column) -> Column:
        set_ = x[i].bitwiseAND(q) != 0
        if i == 0:  # exchanging a coordinate with itself changes nothing
            return F.array(F.when(set_, x[0].bitwiseXOR(p)).otherwise(x[0]), *[x[k] for k in range(1, n)])
        swap = F.when(set_, p).otherwise(x[0].bitwiseXOR(x[i]).bitwiseAND(p))
        own = F.when(set_, x[i]).otherwise(x[i].bitwiseXOR(x[0].bitwiseXOR(x[i]).bitwiseAND(p)))
        return F.array(x[0].bitwiseXOR(swap), *[own if k == i else x[k] for k in range(1, n)])

    steps = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<bigint>")
    undone = F.aggregate(steps, start, rotate)

    def interleave(x: Column) -> Column:
        gray, parts = [x[0]], []
        for i in range(1, n):
            gray.append(reduce(lambda a, b: a.bitwiseXOR(b), [x[k] for k in range(i + 1)]))
        last = gray[-1]
        flip = reduce(lambda a, b: a.bitwiseXOR(b), [F.when(last.bitwiseAND(F.lit(1 << b).cast("long")) != 0, F.lit((1 << b) - 1).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(1, bits)], F.lit(0).cast("long"))
        for b in range(bits):
            for i in range(n):
                bit = F.shiftright(gray[i].bitwiseXOR(flip), b).bitwiseAND(F.lit(1).cast("long"))
                parts.append(F.shiftleft(bit, b * n + n - 1 - i))
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    return _bound(undone, interleave)


def _images(df: DataFrame, dims: list[str]) -> list[Column]:
    """A numeric image of each dimension that keeps its order; null stays null.

    Strings: the bytes after the prefix that smallest and largest value share (all values share it).
    """
    strings = [d for d in dims if isinstance(df.schema[d].dataType, T.StringType)]
    ends = df.agg(*[f(F.encode(F.col(f"`{d}`"), "UTF-8")).alias(f"{k}{i}") for i, d in enumerate(strings) for k, f in (("lo", F.min), ("hi", F.max))]).first() if strings else None
    out = []
    for d in dims:
        col, kind = F.col(f"`{d}`"), df.schema[d].dataType
        if isinstance(kind, T.StringType):
            lo, hi = (bytes(ends[f"{k}{strings.index(d)}"] or b"") for k in ("lo", "hi"))
            shared = next((i for i, (a, b) in enumerate(zip(lo, hi, strict=False)) if a != b), min(len(lo), len(hi)))
            cut = F.substring(F.encode(col, "UTF-8"), shared + 1, IMAGE_BYTES)
            out.append(F.conv(F.rpad(F.hex(cut), 2 * IMAGE_BYTES, "0"), 16, 10).cast("double"))
        elif isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
            out.append(F.unix_micros(col.cast("timestamp")).cast("double"))
        elif isinstance(kind, T.BooleanType):
            out.append(col.cast("int").cast("double"))
        else:
            out.append(col.cast("double"))
    return out


def quantised(df: DataFrame, dims: list[str], bits: int = BITS) -> list[Column]:
    """Each dimension as 0 .. 2**bits - 1 by equi-depth cut points over all rows; null is cell 0.

    The cut points come from one aggregation with bounded sketches; at most len(dims) * 2**bits numbers reach the driver.
    """
    images = _images(df, dims)
    share = [k / (1 << bits) for k in range(1, 1 << bits)]
    row = df.agg(*[F.percentile_approx(x, share, 10_000).alias(f"c{i}") for i, x in enumerate(images)]).first()
    out = []
    for i, x in enumerate(images):
        cuts = sorted({c for c in (row[f"c{i}"] or []) if c == c})
        cell = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c <= x)) if cuts else F.lit(0)  # noqa: B023
        out.append(F.when(x.isNull() | F.isnan(x), F.lit(0)).otherwise(cell))
    return out


def _checksums(text: Column) -> tuple[Column, Column]:
    """size (UTF-8 bytes plus 1) and CRC-32 of a text; null as empty."""
    body = F.coalesce(text, F.lit(""))
    return F.octet_length(body).cast("long") + 1, F.crc32(F.encode(body, "UTF-8"))


def _ordered(keyed: DataFrame, order: list[str], partitions: int | None) -> tuple[DataFrame, DataFrame]:
    """keyed in the given order, stored, with part and place (rank = rows of earlier parts + place), and the parts' rows and bytes before."""
    parts = partitions or int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.monotonically_increasing_id()
    # Generated once, where the sorted rows are written; nothing below depends on their being generated again.
    placed = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"part": F.shiftright(number, 33), "place": number.bitwiseAND(F.lit((1 << 33) - 1))})
    placed = materialise(placed, "shard-order")
    tally = placed.groupBy("part").agg(F.count(F.lit(1)).alias("part_rows"), F.sum("size").alias("part_bytes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    tally = tally.select("part", F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"))
    return placed, materialise(tally, "shard-parts")


def shard(
    docs: DataFrame,
    *,
    shards: int,
    dims: list[str],
    law: str = "rows",
    text: str = "text",
    ident: str = "doc_id",
    bits: int = BITS,
    partitions: int | None = None,
    keep: bool = False,
) -> DataFrame:
    """Every row with its Hilbert position, shard and slot.

    Returns id, size (UTF-8 bytes of the text, null none, plus 1), text_crc32 (of empty for null), the
    dimensions, hilbert, rank (gapless over all rows), shard and slot (gapless from 0 in each shard);
    with keep also row, a struct of all columns of docs, in files that are sorted along the curve.
    law "rows": shard sizes differ by one row at most. law "bytes": a row goes to the shard in which the
    middle of its bytes falls, so sizes differ by less than two rows' bytes.
    Ties on the curve are ordered by id, checksum and size, so reruns agree; fully equal rows are
    interchangeable. Null dimensions take cell 0, null ids come first, an empty table gives no rows;
    columns of docs that are not named here are ignored, whatever their names.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    size, crc = _checksums(F.col(f"`{text}`"))
    names = [f"dim{i}" for i in range(len(dims))]
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    cells = quantised(docs, dims, bits)
    slim = docs.select(F.col(f"`{ident}`").alias("id"), size.alias("size"), crc.alias("text_crc32"), *[F.col(f"`{d}`").alias(n) for d, n in zip(dims, names, strict=True)], *row, hilbert_index(cells, bits).alias("hilbert"))
    placed, tally = _ordered(slim, ["hilbert", "id", "text_crc32", "size"], partitions)
    total = placed.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    ranked = placed.join(broadcast_if_small(tally), "part").withColumn("rank", F.col("rows_before") + F.col("place"))
    if law == "rows":
        rows = max(1, total["rows"])
        ranked = ranked.withColumn("shard", F.expr(f"rank * {shards} div {rows}").cast("int"))
        slot = F.col("rank") - F.expr(f"(cast(shard as bigint) * {rows} + {shards - 1}) div {shards}")
        ranked = ranked.withColumn("slot", slot)
    else:
        inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        ranked = ranked.withColumn("offset", F.col("bytes_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        middle = F.expr(f"cast((cast(2 * offset + size as decimal(38,0)) * {shards}) div (2 * cast({max(1, total['bytes'])} as decimal(38,0))) as int)")
        ranked = materialise(ranked.withColumn("shard", F.least(middle, F.lit(shards - 1))), "shard-cuts")
        starts = ranked.groupBy("shard").agg(F.min("rank").alias("shard_start"))  # one row per shard
        ranked = ranked.join(F.broadcast(starts), "shard").withColumn("slot", F.col("rank") - F.col("shard_start"))
    return ranked.select("id", "size", "text_crc32", *[F.col(n).alias(d) for n, d in zip(names, dims, strict=True)], *["row"] * keep, "hilbert", "rank", "shard", "slot")


def write_shards(docs: DataFrame, path: str, *, shards: int, dims: list[str], rows_per_file: int = 1_000_000, **options) -> tuple[str, str, str]:
    """Write docs as one folder per shard, rows in curve order, so that file statistics prune on every dimension.

    Returns the names of the columns added: shard (the folders), slot and the position on the curve; they
    are new names where docs has such columns. Each row is written once, whatever its id; options and odd
    inputs are those of shard(). The texts are shuffled once, by position; the files of a shard are what
    each range of the curve holds of it.
    """
    placed = shard(docs, shards=shards, dims=dims, keep=True, **options)
    added = tuple(own_name(docs, c) for c in ("shard", "slot", "hilbert"))
    out = placed.select("row.*", *[F.col(c).alias(n) for c, n in zip(("shard", "slot", "hilbert"), added, strict=True)])
    out.write.option("maxRecordsPerFile", rows_per_file).partitionBy(added[0]).parquet(path)
    return added
