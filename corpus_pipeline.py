"""Corpus pipeline over ``documents``: quality, near-duplicates, repeated passages, source mix, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; each is written as Parquet and read again before
the next.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import mixing, packing, quality, simhash, substring
from flowlens.llm.common import written

#: SQL has neither the trained classifier nor the fingerprints; the stages are tested against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the weak-label classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels).filter(~F.col("rejected")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group: the one with the smallest id (null ids last), of rows that share it the smallest by hash."""
    #: 128 bits of the whole row: neither null nor shared ids bring different rows together.
    whole = [x for n in docs.columns for x in (F.col(n).isNull(), F.col(n))]
    rows = docs.withColumns({"_row1": F.xxhash64(F.lit(1), *whole), "_row2": F.xxhash64(F.lit(2), *whole)})
    key = ["_row1", "_row2"]
    kept = written(simhash.group_firsts(rows, key, simhash.SHINGLE_WORDS, simhash.MAX_BITS).select(*key), "kept-rows")
    # one shuffle of the texts serves the join and the dropping of equal rows, at every size
    return rows.join(kept.hint("merge"), key, "left_semi").dropDuplicates(key).select(*docs.columns)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document has; a document that loses nothing keeps its text as it is."""
    cut = substring.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = cut.withColumn("text", text)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights: a row for each pass over a document, cut to the words taken."""
    return mixing.mixed_rows(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the mix into training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("substring dedup", repeated_passage_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
