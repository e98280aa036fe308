"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

Chat logs often hold the same conversation again after every turn.  Each turn gets a hash of (place, role, text); the
running exclusive-or of a conversation's turn hashes is a rolling hash of each of its prefixes.  A conversation whose
whole hash is also the hash of a longer one's prefix is a snapshot of that one; an anti-join leaves the maximal
conversations, of equal ones the smallest id, and only these are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import running_total, running_totals, written

#: Turns rendered into one output row, and turn numbers that share one bucket of the running hash.
PART_TURNS = 256
BUCKET_TURNS = 1024
#: The turn markers of the published ChatML layout.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LAST = (1 << 63) - 1


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """One row per turn: (conv, place, role, text, h1, h2); h1, h2 hash the conversation up to this turn.

    ``place`` counts a conversation's turns from 0 in order of (turn, role, text).
    """
    turns = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(LAST)).alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).distinct()
    order = [F.col("turn"), F.col("role"), F.col("text")]
    placed = running_total(turns, ["conv"], F.floor(F.col("turn") / BUCKET_TURNS), order, F.lit(1).cast("long"), "place")
    own = placed.withColumn("x1", F.xxhash64(F.lit(1), "place", "role", "text")).withColumn("x2", F.xxhash64(F.lit(2), "place", "role", "text"))
    before = running_totals(
        own, ["conv"], F.floor(F.col("place") / BUCKET_TURNS), [F.col("place")], {"b1": (F.col("x1"), "bit_xor"), "b2": (F.col("x2"), "bit_xor")}
    )
    return before.select("conv", "place", "role", "text", F.col("b1").bitwiseXOR(F.col("x1")).alias("h1"), F.col("b2").bitwiseXOR(F.col("x2")).alias("h2"))


def maximal_conversations(hashes: DataFrame) -> DataFrame:
    """``(conv, n_turns, copies)`` of the conversations that no longer one begins with; of equal ones the smallest id."""
    key = ["place", "h1", "h2"]
    last = hashes.groupBy("conv").agg(F.max(F.struct(*key)).alias("last"))
    whole = last.select("conv", "last.*").groupBy(*key).agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    whole = written(whole, "whole-conversations")
    seen = hashes.groupBy(*key).agg(F.count("*").alias("seen"))
    #: Hashes seen more often than as a whole conversation: some conversation goes on after them.
    longer = seen.join(whole, key).filter("seen > copies").select(*key)
    return whole.join(longer, key, "left_anti").select("conv", (F.col("place") + 1).alias("n_turns"), "copies")


def format_conversations(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """``conversations`` -> (conv_id, part, n_turns, copies, text): maximal conversations, rendered.

    A row holds at most ``part_turns`` turns; longer conversations go on in further parts.  ``copies``: logged
    conversations equal to this one, itself included.  A turn logged twice (same id, turn, role and text) counts
    once; null roles are "user", null texts empty, null turns last; turns without an id are one conversation with a
    null id; turns with the same number stand in order of role and text; an empty table gives an empty result; other
    columns are ignored.
    """
    hashes = written(prefix_hashes(conversations), "prefix-hashes")
    kept = written(maximal_conversations(hashes.select("conv", "place", "h1", "h2")), "maximal")
    said = F.concat(F.lit(OPEN), F.col("role"), F.lit("\n"), F.col("text"), F.lit(CLOSE + "\n"))
    turns = hashes.select(F.col("conv").alias("turn_conv"), "place", said.alias("said"))
    parts = (
        turns.join(kept, F.col("turn_conv") == F.col("conv"))
        .groupBy("conv", F.floor(F.col("place") / part_turns).cast("int").alias("part"), "n_turns", "copies")
        .agg(F.sort_array(F.collect_list(F.struct("place", "said"))).alias("turns"))
    )
    return parts.select(
        F.nullif("conv", F.lit(LAST)).alias("conv_id"), "part", "n_turns", "copies", F.array_join(F.col("turns.said"), "").alias("text")
    )
