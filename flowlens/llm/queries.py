"""Registered queries of the training-data operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import chat, manifest, mixing, packing, prefix_tokens, quality, repair, sharding, simhash, substring, topk, urls, vptree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_vantage_point_search")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op2_prefix_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit = prefix_tokens.TOKEN_LIMIT
    path = public_tokenizers.path("byte_bpe_50k.json")
    counts = prefix_tokens.token_prefixes(table(spark, sf_dir, "documents"), path, limit, keep=False)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")


@query(
    "op3_chat_snapshot_collapse",
    """
    WITH turns AS (
      SELECT DISTINCT conv_id, coalesce(turn, 9223372036854775807) AS turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
      FROM conversations
    ),
    logged AS (
      SELECT conv_id, count(*) AS n, list({'role': role, 'text': text} ORDER BY turn, role, text) AS said FROM turns GROUP BY conv_id
    ),
    starts AS (SELECT DISTINCT k, said[1:k] AS said FROM (SELECT said, unnest(range(1, n)) AS k FROM logged)),
    longest AS (
      SELECT min(conv_id) AS conv_id, n, count(*) AS copies, said FROM logged l
      WHERE NOT EXISTS (SELECT 1 FROM starts s WHERE s.k = l.n AND s.said = l.said) GROUP BY n, said
    )
    SELECT conv_id, CAST(p AS INTEGER) AS part, n AS n_turns, copies,
      list_aggregate(list_transform(said[256 * p + 1:256 * p + 256],
        lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), 'string_agg', '') AS text
    FROM (SELECT *, unnest(range(0, (n + 255) // 256)) AS p FROM longest)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


@query(
    "op4_columnar_branch_and_bound",
    """
    WITH fine AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM fine q JOIN fine c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    ),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op5_weak_label_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "reject_score", (~F.col("rejected")).alias("keep"))


@query("op6_low_discrepancy_mix")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, takes = mixing.mix_sources(table(spark, sf_dir, "documents"))
    taken = takes.groupBy(F.col("row").alias("take_row")).agg(F.sum("words").alias("taken"), F.min("first_slot").alias("first_slot"))
    return documents.join(taken, F.col("row") == F.col("take_row"), "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot"
    )


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: Twelve words behind the first one, as SQL; null where the document ends before.
_NEXT_WORDS = " ".join(f"|| ' ' || lead(word, {k}) OVER d" for k in range(1, substring.WINDOW_WORDS))


@query(
    "op8_substring_dedup",
    rf"""
    WITH split AS (
      SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
    ),
    words AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM split),
    windows AS (
      SELECT doc_id, i, word, word {_NEXT_WORDS} AS said FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)
    ),
    starts AS (SELECT said, min(doc_id) AS first_id FROM windows WHERE said IS NOT NULL GROUP BY said),
    judged AS (
      SELECT w.doc_id, w.i, w.word, max(CASE WHEN s.first_id < w.doc_id THEN 1 ELSE 0 END)
        OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN {substring.WINDOW_WORDS - 1} PRECEDING AND CURRENT ROW) AS gone
      FROM windows w LEFT JOIN starts s ON w.said = s.said
    ),
    kept AS (
      SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept
      FROM judged GROUP BY doc_id
    )
    SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
      sha256(coalesce(kept, '')) AS kept_sha256
    FROM documents d LEFT JOIN kept USING (doc_id)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op9_label_propagation_shards")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@query("op11_merkle_manifest")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.merkle_manifest(table(spark, sf_dir, "documents"))


@query("op12_association_url_filter")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, urls.page_labels(pages, table(spark, sf_dir, "labels")))


@query("op13_auction_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audit_conversations(table(spark, sf_dir, "conversations"))
