"""Corpus pipeline: quality, exact and near copies, source mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as
Parquet to the shared folder and reads it again as the next stage's docs, so a stage starts from a
table that survives lost executors and works on all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakweave.llm.bpe import encode
from peakweave.llm.exact_dedup import drop_copies
from peakweave.llm.jaccard import drop_near_copies
from peakweave.llm.mixing import mixed_documents
from peakweave.llm.quality import keep_good
from peakweave.llm.scratch import folder

LEAST_QUALITY = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose probability of being marked good is at least LEAST_QUALITY.

    A null text counts as empty and is scored like an empty one; long texts are measured whole; repeated
    rows fare alike; a null doc_id has no label but a score. An empty table gives an empty one.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), LEAST_QUALITY)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that agree but for the case of A-Z: the one with the largest doc_id.

    Null counts as empty, so one null or empty text stays; null ids rank lowest, and of rows repeated with
    one id one stays. Long texts are compared whole. An empty table gives an empty one.
    """
    return drop_copies(spark, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingle links join: the one with the smallest doc_id.

    Null and empty texts link with nothing and stay, as do rows with a null id; rows repeated with one id
    stay or go together. Long texts are compared whole. An empty table gives an empty one.
    """
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by source weights: a row per document and epoch that takes words of it, cut to those words.

    Texts without words (null, empty, blank) have nothing to take and are not in the mixture; a null source
    is a source of its own; repeated rows are taken each. An empty table gives an empty one.
    """
    return mixed_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and whether decoding them through their offsets gives the text back.

    A null or empty text has no tokens; null columns stay null; repeated rows are encoded each; long texts
    whole. An empty table gives an empty one.
    """
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = docs.select("doc_id", "lang", "source", "n_chars", "text", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"))
    tokens = encode(plain, ranks, keep=("doc_id", "lang", "source", "n_chars", "text_sha256"), decoded=True)
    return tokens.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokenise),
]

#: SQL can express neither the fitted classifier nor the draws and the tokeniser; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = folder(spark, "stage-" + name.split()[0])
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
