"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked.  Members of a group are interchangeable, so the state is a small table (group,
shard, members); a group of any size has at most as many rows as there are shards.  Every round joins a group's
rows with each other: all members outside the shard where their group is strongest (among shards with room)
ask to move there (from a full shard also when the group is stronger at home, if all fit), the requests that save most links come first, and a shard admits as many as its quota leaves.  In
the end, documents without links (and members beyond a quota) fill the shards up exactly, so that row counts are at
most one apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import drop_written, running_total, written

SHARDS = 24
#: Rounds after which members stay where they are; a group needs one round per shard that it fills.
MAX_ROUNDS = 32
BUCKETS = 1024
LAW = "rows"


def _by_shard(shard: Column, values: list[int]) -> Column:
    """A column that looks a shard's number up in a list with one entry per shard."""
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), (shard + 1).cast("int"))


def _loads(state: DataFrame, shards: int) -> list[int]:
    """Members in each shard: ``shards`` numbers."""
    found = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def propagate(state: DataFrame, quota: int, shards: int, rounds: int = MAX_ROUNDS) -> DataFrame:
    """``state(g1, g2, shard, n)`` after moving linked documents towards their neighbours' shards within ``quota``."""
    group = ["g1", "g2"]
    for _ in range(rounds):
        room = [max(0, quota - n) for n in _loads(state, shards)]
        best = (
            state.filter(_by_shard(F.col("shard"), room) > 0)
            .groupBy(*group).agg(F.max(F.struct("n", (-F.col("shard")).alias("minus"))).alias("best"))
            .select(F.col("g1").alias("b1"), F.col("g2").alias("b2"), (-F.col("best.minus")).alias("to"), F.col("best.n").alias("there"))
        )
        asks = (
            state.join(best, (F.col("g1") == F.col("b1")) & (F.col("g2") == F.col("b2")))
            .filter((F.col("shard") != F.col("to")) & (
                (F.col("n") < F.col("there")) | ((F.col("n") == F.col("there")) & (F.col("shard") > F.col("to")))
                | ((_by_shard(F.col("shard"), room) == 0) & (F.col("n") <= _by_shard(F.col("to"), room)))
            ))
            .select(*group, "shard", "n", "to", F.greatest(F.lit(1), F.col("there") - F.col("n") + 1).alias("gain"))
        )
        asks = written(asks, "asks")
        #: Strong requests first, by powers of two; equals in hash order, spread over buckets.
        strength = F.lit(62) - F.least(F.lit(62), F.floor(F.log2(F.col("gain"))))
        queue = running_total(
            asks, ["to"], strength * BUCKETS + F.pmod("g1", F.lit(BUCKETS)), [F.col("gain").desc(), F.col("g1"), F.col("g2"), F.col("shard")], F.col("n"), "ahead"
        )
        moves = written(
            queue.withColumn("moved", F.least(F.col("n"), _by_shard(F.col("to"), room) - F.col("ahead"))).filter("moved > 0")
            .select(*group, "shard", "to", "moved"),
            "moves",
        )
        change = moves.select(*group, "shard", (-F.col("moved")).alias("n")).unionByName(
            moves.select(*group, F.col("to").alias("shard"), F.col("moved").alias("n")))
        count = moves.agg(F.sum("moved")).first()[0] or 0
        if count:
            after = written(state.unionByName(change).groupBy(*group, "shard").agg(F.sum("n").alias("n")).filter("n > 0"), "labels")
            drop_written(state)
            state = after
        drop_written(asks)
        drop_written(moves)
        if not count:
            break
    return state


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = MAX_ROUNDS) -> DataFrame:
    """``documents`` -> (doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per input row.

    Law ``rows``: shards' row counts are at most one apart.  ``slot`` numbers a shard's rows from 0 without gaps;
    ``grown_shard`` is null under this law.  Null texts have size 8, checksum 0 and are equal to empty ones; null
    ids and rows that repeat are rows like any other; an empty table gives an empty result; columns besides
    ``doc_id`` and ``text`` are ignored, whatever their names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
            F.monotonically_increasing_id().alias("row"), "doc_id", (F.octet_length("text") + 8).cast("long").alias("size"),
            F.crc32("text").alias("text_crc32"), F.xxhash64("text").alias("g1"), F.xxhash64(F.lit(9), "text").alias("g2"),
            F.xxhash64(F.lit(24), "doc_id", "text").alias("place"),
        ).withColumn("shard", F.pmod(F.xxhash64("place", "row"), F.lit(shards))),
        "rows",
    )
    total = rows.count()
    low, more = divmod(total, shards)
    members = rows.groupBy("g1", "g2", "shard").agg(F.count("*").alias("n"))
    size = F.sum("n").over(Window.partitionBy("g1", "g2"))
    state = written(members.withColumn("all", size).filter("all > 1").select("g1", "g2", "shard", "n"), "labels")
    state = propagate(state, low, shards, rounds)
    loads = _loads(state, shards)
    extra = set(sorted(range(shards), key=lambda s: (-loads[s], s))[:more])
    full = [low + (s in extra) for s in range(shards)]
    linked = [min(n, f) for n, f in zip(loads, full)]
    gaps = [f - n for f, n in zip(full, linked)]
    starts = [sum(gaps[:s]) for s in range(shards)]

    #: Where each (group, shard) stands: its members' numbers within the group, its first slot in the shard.
    placed = running_total(state, ["shard"], F.pmod("g1", F.lit(BUCKETS)), [F.col("g1"), F.col("g2")], F.col("n"), "slot")
    up = Window.partitionBy("g1", "g2").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        placed.withColumn("begin", F.coalesce(F.sum("n").over(up), F.lit(0)))
        .groupBy(F.col("g1").alias("p1"), F.col("g2").alias("p2"))
        .agg(F.collect_list(F.struct("begin", (F.col("begin") + F.col("n")).alias("end"), "shard", "slot")).alias("parts"))
    )
    parts = written(parts, "parts")
    base = rows.select("row", "doc_id", "size", "text_crc32", "g1", "g2", "place")
    grouped = written(base.join(parts, (F.col("g1") == F.col("p1")) & (F.col("g2") == F.col("p2")), "left").drop("p1", "p2"), "grouped")
    order = [F.col("place"), F.col("row")]
    bucket = F.pmod(F.xxhash64("place", "row"), F.lit(BUCKETS))
    inside = running_total(grouped.filter("parts is not null"), ["g1", "g2"], bucket, order, F.lit(1), "number")
    part = F.filter("parts", lambda p: (F.col("number") >= p["begin"]) & (F.col("number") < p["end"]))[0]
    inside = inside.withColumn("part", part).select(
        "row", "doc_id", "size", "text_crc32", "place", F.col("part.shard").alias("shard"),
        (F.col("part.slot") + F.col("number") - F.col("part.begin")).alias("slot"))
    inside = written(inside, "members")
    fits = F.col("slot") < _by_shard(F.col("shard"), linked)
    loose = inside.filter(~fits).select("row", "doc_id", "size", "text_crc32", "place").unionByName(
        grouped.filter("parts is null").select("row", "doc_id", "size", "text_crc32", "place"))
    queue = running_total(loose, [], bucket, order, F.lit(1), "number")
    to = reduce(lambda a, s: F.when((F.col("number") >= starts[s]) & (F.col("number") < starts[s] + gaps[s]), F.lit(s)).otherwise(a), range(shards), F.lit(None).cast("int"))
    filled = queue.withColumn("shard", to.cast("long")).withColumn(
        "slot", F.col("number") - _by_shard(F.col("shard"), starts) + _by_shard(F.col("shard"), linked))
    columns = ["doc_id", "size", "text_crc32", "shard", "slot"]
    return inside.filter(fits).select(*columns).unionByName(filled.select(*columns)).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
