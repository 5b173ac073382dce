"""Mixing sources to target weights: fixed-length word blocks, multinomial draws per shard, index joins.

The words of a source, documents in hashed order, form one stream that is cut into blocks of
block_words. Every slot of an output shard draws its source by a uniform of its own, so a shard's counts of
sources are multinomial. What a source draws over its number of blocks to give goes to the sources that
drew too few (the slots to give up picked pseudorandomly over all shards), so the totals meet the targets.
The ordinal of a draw picks a block through a pseudorandom permutation of that source's block indices;
blocks and slots meet in a join by index. All of it is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise, own_name

SPACE = "\\x20\\x09-\\x0D"
_EDGES = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
GRID = 4096  #: cells that the draws' interval join is keyed by


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in text (null: 0): pieces of a split, less the empty ones at the edges."""
    edge = lambda at: F.substring(text, at, 1).isin(_EDGES).cast("int")
    return F.when(text.isNull() | (text == ""), 0).otherwise(F.size(F.split(text, f"[{SPACE}]+", -1)) - edge(1) - edge(-1)).cast("long")


def permuted(x: Column, n: Column, *key: Column, rounds: int = 24) -> Column:
    """Image of x under a keyed pseudorandom permutation of 0 .. n-1 (swap-or-not rounds, exact for every n)."""
    n = F.greatest(n, F.lit(1).cast("long"))

    def swap(acc: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r), n) - acc, n)
        chosen = F.xxhash64(F.greatest(acc, partner), r, *key).bitwiseAND(F.lit(1).cast("long")) == 1
        return F.when(chosen, partner).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x.cast("long"), swap)


def _in_interval(rows: DataFrame, spans: DataFrame, at: str, n: int) -> DataFrame:
    """rows joined to the span (lo <= at < hi) that holds their number; the spans part 0 .. n-1. The join is keyed by cell."""
    cell = lambda c: F.expr(f"{c} * {GRID} div {n}")
    wide = spans.where("lo < hi").withColumn("cell", F.explode(F.sequence(cell("lo"), cell("(hi - 1)"))))
    return rows.withColumn("cell", cell(at)).join(wide, "cell").where(f"{at} >= lo and {at} < hi").drop("cell")


@dataclass
class Mixture:
    rows: DataFrame  #: uid, id, sid, size: one row per input row
    sources: DataFrame  #: sid, source, weight, source_size, target, ...
    slots: DataFrame  #: shard, slot, sid, epoch, block, words: one row per output slot
    pieces: DataFrame  #: shard, slot, sid, epoch, block, uid, first_word, n_words: the documents' parts in each slot

    def shard_counts(self) -> DataFrame:
        """The draws: slots of each source in each output shard."""
        return self.slots.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("slots"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], ceiling: int) -> DataFrame:
    """Target words of each source; sizes: (source, source_size), one row per source.

    Sources ordered by code point, null last, weigh `weights` in turn and share all words; a target
    stops at ceiling times its source's size and the excess is shared again by weight. Filling up in
    order of ceiling / weight gives that fixed point directly. The windows hold one row per source.
    """
    w = F.element_at(F.array(*[F.lit(x).cast("double") for x in weights]), F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1)
    s = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", w)
    s = s.withColumn("cap", ceiling * F.col("source_size"))
    every = Window.partitionBy(F.lit(0))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("place", F.row_number().over(fill))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    s = s.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(every)["level"]
    s = s.withColumn("water", level)
    return s.select("sid", "source", "weight", "source_size", F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame,
    *,
    text: str = "text",
    ident: str = "doc_id",
    source: str = "source",
    uid: str | None = None,
    weights: tuple[int, ...] = (5, 2, 1),
    ceiling: int = 3,
    block_words: int = 512,
    slots_per_shard: int = 1024,
    buckets: int = 4096,
    seed: int = 20,
) -> Mixture:
    """Draw a mixture of docs by target weights; no document is taken more than ceiling times.

    uid: a column that numbers the rows, if docs has one. Null and empty texts have no words: they get a
    row and are never drawn. A null source is a source of its own, last in order. Repeated identifiers
    are separate rows. Very long texts span many blocks. An empty table gives empty frames. Other
    columns are ignored. Reruns agree: order and draws depend on seed, identifiers and texts alone
    (equal rows are interchangeable).
    """
    number = F.col(f"`{uid}`") if uid else F.monotonically_increasing_id()
    rows = materialise(docs.select(number.alias("uid"), F.col(f"`{ident}`").alias("id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash")), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = source_targets(sizes, weights, ceiling)
    b = F.lit(block_words).cast("long")
    words = F.round("target").cast("long")
    ceil = lambda a, q: F.expr(f"({a} + {q} - 1) div {q}")
    sources = sources.withColumn("words", words).withColumn("n_blocks", ceil("source_size", block_words))
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size")).withColumn("rest_slots", ceil("rest", block_words))
    sources = sources.withColumn("n_slots", F.col("epochs") * F.col("n_blocks") + F.col("rest_slots"))
    hi = F.sum("n_slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    sources = materialise(sources.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("n_slots")), "mix-sources")
    total = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]

    # Draw: slot -> a uniform p in 0 .. total-1 -> the source whose interval holds p.
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, total)
    slot = spark.range(0, total, 1, parts).select(F.col("id").alias("slot"), F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(n).cast("long")).alias("p"))
    given = sources.where("n_slots > 0").select("sid", "lo", "hi", "n_slots", "n_blocks", "epochs", "rest", "rest_slots")
    drawn = _in_interval(slot, given.select("sid", "lo", "hi"), "p", n).select("slot", F.expr(f"slot div {slots_per_shard}").alias("shard"), "sid")
    # The draw's ordinal i in its source: draws of earlier shards, and earlier ones in the shard.
    counts = materialise(drawn.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("k")), "mix-draws")
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "sid", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("earlier"))
    drawn = drawn.withColumn("i", F.row_number().over(Window.partitionBy("shard", "sid").orderBy("slot")) - 1).join(counts, ["shard", "sid"])
    drawn = drawn.select("slot", "sid", (F.col("i") + F.col("earlier")).cast("long").alias("i"))
    # Settle: a source keeps n_slots of its draws, any of them; the others fill what other sources lack.
    totals = given.join(drawn.groupBy("sid").agg(F.count(F.lit(1)).alias("got")), "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    over, lack = F.greatest(F.col("got") - F.col("n_slots"), F.lit(0)), F.greatest(F.col("n_slots") - F.col("got"), F.lit(0))
    upto_source = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)  # one row per source
    totals = totals.withColumns({"over_hi": F.sum(over).over(upto_source), "lack_hi": F.sum(lack).over(upto_source), "over": over, "lack": lack})
    totals = materialise(totals, "mix-totals")
    placed_draws = drawn.join(totals.select("sid", "got", "n_slots", (F.col("over_hi") - F.col("over")).alias("over_lo")), "sid")
    placed_draws = placed_draws.withColumn("i", F.when(F.col("got") > F.col("n_slots"), permuted(F.col("i"), F.col("got"), F.lit(seed), F.lit("over"), F.col("sid"))).otherwise(F.col("i")))
    placed_draws = materialise(placed_draws.select("slot", "sid", "i", F.when(F.col("i") >= F.col("n_slots"), F.col("over_lo") + F.col("i") - F.col("n_slots")).alias("spare")), "mix-placed")
    moved = max(1, int(totals.agg(F.coalesce(F.max("lack_hi"), F.lit(0))).first()[0]))
    takers = totals.where("lack > 0").select("sid", (F.col("lack_hi") - F.col("lack")).alias("lo"), F.col("lack_hi").alias("hi"), "got")
    filled = _in_interval(placed_draws.where("spare is not null").select("slot", "spare"), takers, "spare", moved).select("slot", "sid", (F.col("got") + F.col("spare") - F.col("lo")).alias("i"))
    drawn = placed_draws.where("spare is null").select("slot", "sid", "i").unionByName(filled).join(given.drop("lo", "hi"), "sid")
    drawn = drawn.withColumns({"epoch": F.expr("i div n_blocks"), "k": F.expr("i % n_blocks")})
    partial = F.col("epoch") >= F.col("epochs")
    # The last, short block stays out of the partial epoch until all whole blocks are used.
    whole = F.when(partial, F.col("n_blocks") - 1).otherwise(F.col("n_blocks"))
    block = F.when(F.col("k") >= whole, F.col("k")).otherwise(permuted(F.col("k"), whole, F.lit(seed), F.col("sid"), F.col("epoch")))
    limit = F.when(partial & (F.col("k") == F.col("rest_slots") - 1), F.col("rest") - F.col("k") * b).otherwise(b)
    slots = drawn.select(F.expr(f"slot div {slots_per_shard}").alias("shard"), "slot", "sid", "epoch", block.alias("block"), limit.alias("words"))
    slots = materialise(slots, "mix-slots")

    # Pack: offset of each document in its source's stream = earlier buckets + earlier rows of its bucket.
    numbered = rows.join(sources.select("sid", F.col("source").alias("name")), F.col("source").eqNullSafe(F.col("name"))).select("uid", "id", "sid", "size", "text_hash")
    hashed = numbered.withColumn("hash", F.xxhash64(F.lit(seed), "id", "text_hash")).withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    sums = hashed.groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size"))
    upto = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("bucket_size").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("hash", "id", "text_hash", "uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["sid", "bucket"])
    placed = placed.where("size > 0").select("uid", "sid", "size", (F.col("base") + F.col("before")).alias("start"))
    parts_ = placed.select("uid", "sid", "start", "size", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))).alias("block"))
    origin = F.col("block") * b
    parts_ = parts_.select("uid", "sid", "block", (F.greatest(F.col("start"), origin) - origin).alias("a"), (F.least(F.col("start") + F.col("size"), origin + b) - origin).alias("z"), (F.greatest(F.col("start"), origin) - F.col("start")).alias("first_word"))
    pieces = parts_.join(slots, ["sid", "block"]).withColumn("n_words", F.least("z", "words") - F.col("a")).where("n_words > 0")
    return Mixture(numbered, sources, slots, pieces.select("shard", "slot", "sid", "epoch", "block", "uid", "first_word", "n_words"))


def taken_words(m: Mixture) -> DataFrame:
    """uid, id, size, source_size, target, taken for every input row; rows without words take 0, repeated rows each their own."""
    taken = m.pieces.groupBy("uid").agg(F.sum("n_words").alias("taken"))
    rows = m.rows.join(taken, "uid", "left").join(m.sources.select("sid", "source_size", "target"), "sid")
    return rows.select("uid", "id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, *, text: str = "text", ident: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mixture as rows with the columns of docs: one row per document and epoch that takes words of it.

    Null, empty and blank texts are in no row; repeated rows each have theirs; an empty table gives no rows.
    A document taken whole keeps its text byte for byte; one taken in part holds the taken words with
    the white space after each. A column n_chars, if there, is brought up to date.
    """
    uid = own_name(docs, "mix_uid")
    numbered = materialise(docs.withColumn(uid, F.monotonically_increasing_id()), "mix-docs")
    m = mix(numbered, text=text, ident=ident, source=source, uid=uid, **options)
    runs = m.pieces.groupBy("uid", "epoch").agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("runs"), F.sum("n_words").alias("n"))
    runs = runs.join(m.rows.select("uid", "size"), "uid")
    body = F.col("__body")
    chosen = F.flatten(F.transform("runs", lambda r: F.slice("__words", r["first_word"].cast("int") + 1, r["n_words"].cast("int"))))
    with_text = numbered.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(uid).alias("uid")).join(runs, "uid")
    with_text = with_text.withColumn("__body", F.col("doc").getField(text))
    with_text = with_text.withColumn("__words", F.when(F.col("n") < F.col("size"), F.regexp_extract_all(body, F.lit(f"[^{SPACE}]+[{SPACE}]*"), F.lit(0))))
    with_text = with_text.withColumn("__text", F.when(F.col("n") < F.col("size"), F.array_join(chosen, "")).otherwise(body))
    out = []
    for c in docs.columns:
        own = F.col("doc").getField(c)
        out.append((F.col("__text") if c == text else F.length("__text").cast(docs.schema[c].dataType) if c == "n_chars" else own).alias(c))
    return with_text.select(*out)
