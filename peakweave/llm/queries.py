"""The registered queries of the training-data operators and, where SQL can say it, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .bpe import encode
from .chat import format_chats, read_chats
from .embed_dedup import near_duplicates
from .exact_dedup import exact_dedup
from .jaccard import jaccard_components
from .licenses import license_report
from .mixing import mix, taken_words
from .negatives import hard_negatives
from .quality import fit, fold, scored, with_statistics
from .scratch import folder, materialise
from .sharding import write_shards
from .suffix_tree import lm_scores
from .trie import ordered_turns, prefix_trie, with_shared_heads
from .warc import read_archives, write_archives

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), " "), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = folder(spark, "shards")
    part, slot, curve = write_shards(docs, path, shards=8, dims=["source", "lang", "n_chars"], law="rows")
    schema = StructType([*docs.schema, StructField(slot, LongType()), StructField(curve, LongType()), StructField(part, IntegerType())])
    body = F.coalesce("text", F.lit(""))
    return spark.read.schema(schema).parquet(path).select(
        "doc_id", (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col(part).alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col(curve).alias("hilbert"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hostile = "\\### Assistant: </turn> ok"
    roles = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), roles.alias("role"), F.lit(hostile).alias("text"))
    back = read_chats(format_chats(turns.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = taken_words(mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialise(with_statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")), "quality-stats")
    model = fit(measured, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(measured, model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    read = materialise(read_archives(spark, path).drop("payload"), "warc-records")
    if not read.where("quarantined is not null").isEmpty():
        raise RuntimeError(f"bytes of {path} could not be read back")
    return read.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = (F.col("label").cast("decimal(20,0)") + 1) % 10
    label = F.when(F.col("vec_id") % 7 == 0, moved.cast("long")).otherwise(F.col("label").cast("long"))
    return hard_negatives(table, anchors=F.col("vec_id") % 100 == 0, label=label)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*with_shared_heads(ordered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 != 1
    return lm_scores(docs, train=train).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_chat_format": op5_chat_format,
    "op6_license_scan": op6_license_scan,
    "op7_mix_sources": op7_mix_sources,
    "op8_quality": op8_quality,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_warc_archives": op10_warc_archives,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_lm_scores": op13_lm_scores,
}

ORACLES: dict[str, str] = {
    "op2_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        ok AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
            WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
        link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
        reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
        c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
        n AS (SELECT x, count(*) AS n_links FROM link GROUP BY x)
        SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
        FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id""",
    "op9_jaccard_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
        i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS meet FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * meet >= 80 * (p.k + q.k - meet)),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
        c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
        SELECT d.doc_id, coalesce(k, 0)::BIGINT AS n_shingles, component_id FROM documents d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op10_warc_archives": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS hex FROM p),
        g AS (SELECT hex, max(page_id) AS keep FROM d GROUP BY hex)
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(hex, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> keep THEN keep END AS refers_to
        FROM d JOIN g USING (hex)""",
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
            FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
        n AS (SELECT p.anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
                row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op12_prefix_trie": r"""
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p FROM conversations WHERE conv_id IS NOT NULL),
        ids AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda y: ascii(y)::BIGINT)),
            lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 4 AS h,
            (SELECT count(*) FROM t WHERE t.c = d.c - d.c % 20) AS base_n FROM (SELECT DISTINCT c FROM t) d),
        rebuilt AS (SELECT i.c, p AS d, r, x FROM ids i JOIN t ON t.c = i.c - i.c % 20 AND p <= h
            UNION ALL SELECT i.c, least(h, base_n) + p - h, r, x FROM ids i JOIN t ON t.c = i.c AND p > h),
        s AS (SELECT i.c, coalesce(list({'r': r, 'x': x} ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS turns FROM ids i LEFT JOIN rebuilt b ON b.c = i.c GROUP BY i.c),
        e AS (SELECT c, d, d = len(turns) AS ends, md5(to_json(turns[1:d])::VARCHAR) AS k, CASE WHEN d > 0 THEN md5(to_json(turns[1:d - 1])::VARCHAR) END AS up,
            CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM s)),
        n AS (SELECT k, d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
            sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM e GROUP BY k, d),
        kids AS (SELECT up AS k, count(*) AS n_children FROM n GROUP BY up),
        m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON kids.k = n.k),
        below AS (SELECT e.k, sum((m.n_children = 0)::INT)::BIGINT AS n_leaves, sum(m.saved)::BIGINT AS saved_tokens FROM m JOIN e ON e.c = m.conv_id AND e.d <= m.d GROUP BY e.k)
        SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
        FROM m JOIN below ON below.k = m.k LEFT JOIN m u ON u.k = m.up""",
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UP}', '{_LOW}')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op5_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, replace(replace(replace(replace(text, '\', '\b'), '</turn>', '\t'), '<part/>', '\p'), '### ', '\h') AS esc,
            replace(replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\t'), '<part/>', '\p'), '### ', '\h'), ': ', '\c') AS head,
            coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), false) AS joined FROM t)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
            sum(length(esc) + CASE WHEN joined THEN 7 ELSE length(head) + 4 + 2 + 8 END)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
}
