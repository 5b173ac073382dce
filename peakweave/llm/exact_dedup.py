"""Exact deduplication as a streaming aggregation whose keyed state lives on disk and never expires.

The stream keeps one state row per digest: the stable identifier and locator of the row that stays,
and how many rows had the digest. State is held by RocksDB and checkpointed to the shared folder; with a
`state_home` a query that is cut off goes on where it stopped. A hit (a second row with a digest) is not trusted:
the bytes of both rows are compared, and digests that cover different texts are regrouped by text.
Only built-in functions run on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import ascii_lower, broadcast_if_small, folder, materialise

SALTED = 4096  #: bodies of one digest that are compared in one place
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's store pre-allocates megabytes
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normal(text: Column) -> Column:
    """The compared form: null as empty, A-Z lower-cased."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _located(df: DataFrame, text: str, ident: str, digest: Callable[[Column], Column]) -> DataFrame:
    """id, digest and locator of each row; the locator (file, row) tells equal identifiers apart."""
    file = df.metadataColumn("_metadata")  # not a column of that name that the table may have
    at = F.struct(F.col(f"`{ident}`").alias("id"), file["file_path"].alias("file"), file["row_index"].alias("row"))
    return df.select(digest(normal(F.col(f"`{text}`"))).alias("digest"), at.alias("at"), F.col(f"`{text}`").alias("text"))


def _source_folder(docs: DataFrame) -> str | None:
    """The one path that docs is an unchanged Parquet scan of, if so."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.nodeName() != "LogicalRelation":
        return None
    roots = plan.relation().location().rootPaths()
    return roots.head().toString() if roots.size() == 1 else None


def _streamable(spark: SparkSession, path: str) -> str:
    """path, or for a single file a glob that matches it alone: the streaming source takes folders and globs."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    return f"{path[:-1]}[{path[-1]}]" if single else path


def keyed_state(spark: SparkSession, path: str, text: str, ident: str, digest: Callable[[Column], Column], max_bytes: int, home: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run the streams over what lies at path until nothing new is there: (keys, state).

    The first stream writes digest and locator (at) of every row once, the second keeps the keyed state
    over those; state: digest, at (of the row that stays), n. home: folder of both; a second call with the
    same folder reads and adds only new files.
    """
    home = home or folder(spark, "dedup-state")
    before = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    for k, v in _STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        source = spark.read.parquet(path)
        read = lambda schema, at: spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes)).parquet(at)
        run = lambda writer, name: writer.option("checkpointLocation", f"{home}/checkpoint-{name}").trigger(availableNow=True).start().awaitTermination()
        located = _located(read(source.schema, _streamable(spark, path)), text, ident, digest).select("digest", "at")
        run(located.writeStream.format("parquet").option("path", f"{home}/keys"), "keys")
        state = read(located.schema, f"{home}/keys").groupBy("digest").agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("n"))

        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{home}/updates/batch={number}")  # a repeated batch replaces itself

        run(state.writeStream.outputMode("update").foreachBatch(save), "state")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    updates = "digest string, at struct<id:{}, file:string, row:bigint>, n bigint, batch long".format(source.schema[ident].dataType.simpleString())
    last = F.max(F.struct("batch", "at", "n"))
    state = spark.read.schema(updates).parquet(f"{home}/updates").groupBy("digest").agg(last.alias("last")).select("digest", "last.at", "last.n")
    return spark.read.schema(located.schema).parquet(f"{home}/keys"), state


def exact_dedup(
    spark: SparkSession,
    source: str | DataFrame,
    *,
    text: str = "text",
    ident: str = "doc_id",
    digest: Callable[[Column], Column] = sha256,
    max_bytes_per_trigger: int = 64 << 30,
    state_home: str | None = None,
) -> DataFrame:
    """One row per row of source: id, digest, keep_id, group_size, kept, and the row's locator at.

    source: a Parquet path, or a DataFrame (written to the shared folder first unless it is a plain scan).
    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row
    with the largest identifier stays; null identifiers rank lowest, and of repeated identifiers the
    largest locator stays, so exactly one row of a group is kept. Very long texts are only hashed and
    compared. An empty table gives no rows. Other columns of source are ignored, whatever their names.
    state_home: a folder of the caller's that keeps the stream's state. A run that is cut off and called again with it goes on
    where it stopped, and files that come to source later are added to the state, and only they are hashed. Without it the
    state is the application's own and ends with it.
    """
    path = source if isinstance(source, str) else _source_folder(source)
    if path is None:
        path = folder(spark, "dedup-input")
        source.select(F.col(f"`{ident}`"), F.col(f"`{text}`")).write.parquet(path)
    scan = _located(spark.read.parquet(path), text, ident, digest)
    if spark.read.parquet(path).isEmpty():
        at = scan.schema["at"].dataType.simpleString()
        return spark.createDataFrame([], f"id {scan.select('at.id').schema[0].dataType.simpleString()}, digest string, keep_id {scan.select('at.id').schema[0].dataType.simpleString()}, group_size long, kept boolean, at {at}")
    keys, state = keyed_state(spark, path, text, ident, digest, max_bytes_per_trigger, state_home)
    state = materialise(state, "dedup-keys")

    # Full bytes of the hits only: rows of digests that were seen more than once. A digest of very many
    # rows is compared in several places, each with a copy of the row that stays.
    seen_again = state.where("n > 1").select("digest", F.col("at").alias("keep"), F.expr(f"n div {SALTED} + 1").alias("salts"))
    hits = materialise(keys.join(seen_again, "digest").select("at", "keep", "digest", "salts"), "dedup-hit-keys")
    bodies = materialise(scan.select("at", normal(F.col("text")).alias("body")).join(broadcast_if_small(hits), "at").select("digest", "at", "keep", "salts", "body"), "dedup-hits")
    stays = bodies.where("at = keep").select("digest", F.col("body").alias("keep_body"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    salted = bodies.withColumn("salt", F.pmod(F.xxhash64("at"), F.col("salts")))
    unequal = salted.join(stays, ["digest", "salt"]).where("body <> keep_body").select("digest").distinct()
    slim = keys.join(state.select("digest", F.col("at").alias("keep"), "n"), "digest")
    if not unequal.isEmpty():
        # Different texts under one digest: those digests are grouped by the text itself.
        unequal = materialise(unequal, "dedup-collisions")
        by_text = bodies.join(unequal, "digest", "left_semi")
        groups = by_text.groupBy("digest", "body").agg(F.max("at").alias("keep"), F.count(F.lit(1)).alias("n"))
        again = by_text.drop("keep").join(groups, ["digest", "body"]).select("digest", "at", "keep", "n")
        slim = slim.join(unequal, "digest", "left_anti").select("digest", "at", "keep", "n").unionByName(again)
    return slim.select(F.col("at.id").alias("id"), "digest", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("keep")).alias("kept"), "at")


def drop_copies(spark: SparkSession, docs: DataFrame, *, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all its columns; one row of each group of equal texts, as exact_dedup says.

    Only locators are shuffled unless very many rows go. An empty table gives no rows.
    """
    path = _source_folder(docs)
    if path is None:
        docs = materialise(docs, "dedup-input")
        path = _source_folder(docs)
    gone = exact_dedup(spark, path, text=text, ident=ident).where("not kept").select(F.col("at.file").alias("file"), F.col("at.row").alias("row"))
    gone = broadcast_if_small(materialise(gone, "dedup-gone"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    table = spark.read.parquet(path)
    file = table.metadataColumn("_metadata")
    full = table.select(F.struct(*columns).alias("doc"), file["file_path"].alias("file"), file["row_index"].alias("row"))
    return full.join(gone, ["file", "row"], "left_anti").select("doc.*")
