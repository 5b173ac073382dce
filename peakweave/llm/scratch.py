"""Shared work folder, materialised tables and small text helpers of the training-data operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_registered: set[str] = set()
_local: list[str] = []
_worker: dict[Hashable, object] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, one sub-folder per application.

    It is the session's ``spark.checkpoint.dir``. Only a ``local[...]`` session without that setting
    (tests, a laptop) gets a temporary folder; a cluster without it is an error, because a local
    folder of one machine is not visible to the others. The sub-folder is deleted when the driver ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="peakweave-"))
        root = _local[0]
    home = f"{root.rstrip('/')}/peakweave-{spark.sparkContext.applicationId}"
    if home not in _registered:
        _registered.add(home)
        atexit.register(_delete, spark, home)
    return home


def _delete(spark: SparkSession, path: str) -> None:
    if path.startswith("file:/") and spark.sparkContext.master.startswith("local"):
        import shutil

        shutil.rmtree(path.removeprefix("file:").replace("//", "/", 1), ignore_errors=True)
        return
    jsc = getattr(spark.sparkContext, "_jsc", None)
    if jsc is None or jsc.sc().isStopped():
        return
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(jsc.hadoopConfiguration()).delete(hadoop, True)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is created."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there and survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that materialise() wrote and nothing reads any more, and let Spark drop unreferenced shuffle files."""
    for df in frames:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    if frames:
        gc.collect()
        frames[0].sparkSession.sparkContext._jvm.System.gc()


def worker_table[T](key: Hashable, build: Callable[[], T]) -> T:
    """What build() makes, kept in a Python worker for its next tasks. A worker holds one at a time: workers
    serve the tasks of all operators in turn, and would else hold the tables of all of them."""
    if key not in _worker:
        _worker.clear()
        gc.collect()
        _worker[key] = build()
    return _worker[key]


def broadcast_if_small(df: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint if its rows, written as JSON, have at most most_bytes bytes (measured), else as it is."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= most_bytes else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the byte-wise path; other texts are translated char by char."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def own_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have (names compare case-insensitively)."""
    have, name = {c.lower() for c in df.columns}, stem
    while name.lower() in have:
        name += "_"
    return name
