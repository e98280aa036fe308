"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Sources get target words by weight, with a ceiling of ``max_epochs`` times their own size whose excess is shared
again.  Slot t of the schedule sits at the van der Corput point of t; the sources' cumulative targets cut [0, 1)
into intervals, and the interval that holds the point says whose slot it is.  The r-th slot of a source takes block
r of its stream: its documents in hash order, cut into blocks of equal words, over and over.  Slots beyond a
source's target are dropped, the last one is cut, and a source that the schedule leaves short gets its missing slots
at the end, so each source takes its target to the word.  The slots give the mix its order: a document stands where the
first slot that takes of it stands, so every beginning of the mix holds the sources near their shares.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import running_total, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2
BLOCK_WORDS = 1024
WORD = r"[^\x20\x09-\x0D]+"
#: Hash buckets of a source's stream, slots of one schedule bucket, cells that cut [0, 1) for the slot lookup.
STREAM_BUCKETS = 1024
SLOT_BUCKET = 16_384
CELLS = 4096
#: Binary digits of a van der Corput point: exact for 2**48 slots.
DIGITS = 48


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def van_der_corput(t: Column) -> Column:
    """The base-2 radical inverse of a slot number: its binary digits mirrored behind the point."""
    return reduce(lambda a, b: a + b, (F.shiftright(t, k).bitwiseAND(F.lit(1)) * F.lit(2.0 ** -(k + 1)) for k in range(DIGITS)))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sized(key, source, size)`` -> one row per source: (key, source_size, target).

    Sources in code-point order (null last) take the weights in turn.  Sorted by ceiling per weight, the sources at
    their ceiling come first; the rest share what is left by weight.  One row per source is sorted here, never documents.
    """
    sizes = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    one = F.lit(0)
    place = F.row_number().over(Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (((place - 1) % len(weights)) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("ceiling", max_epochs * F.col("source_size").cast("double"))
    order = [F.col("ceiling") / F.col("weight"), F.col("key")]
    up = Window.partitionBy(one).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(one).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(one)
    return (
        ranked.withColumn("wanted", F.lit(share) * F.sum("source_size").over(whole))
        .withColumn("level", (F.col("wanted") - F.coalesce(F.sum("ceiling").over(up), F.lit(0.0))) / F.sum("weight").over(down))
        .withColumn("full", F.col("level") * F.col("weight") > F.col("ceiling"))
        .withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(whole))
        .withColumn("target", F.when(F.col("full"), F.col("ceiling")).otherwise(
            F.least(F.col("ceiling"), F.col("level") * F.col("weight"))))
        .select("key", "source_size", "target")
    )


def slot_schedule(targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """``(key, source_size, target)`` -> the slots in use: (slot, key, epoch, block, words)."""
    spark = targets.sparkSession
    quota = written(
        targets.filter("source_size > 0")
        .withColumn("goal", F.floor(F.col("target") + 0.5))
        .withColumn("blocks", F.ceil(F.col("source_size") / block))
        .withColumn("slots", F.expr(f"(goal div source_size) * blocks + ceil((goal % source_size) / {block})"))
        .withColumn("end", F.sum("target").over(Window.partitionBy(F.lit(0)).orderBy("key")) / F.sum("target").over(Window.partitionBy(F.lit(0))))
        .withColumn("begin", F.coalesce(F.lag("end").over(Window.partitionBy(F.lit(0)).orderBy("key")), F.lit(0.0)))
        .select("key", "source_size", "goal", "blocks", "slots", "begin", "end"),
        "quota",
    )
    total = quota.agg(F.sum("slots")).first()[0] or 0
    cells = quota.select("key", "begin", "end", F.explode(F.sequence(
        F.floor(F.col("begin") * CELLS), F.floor(F.col("end") * CELLS))).alias("cell"))
    points = spark.range(total).select(F.col("id").alias("slot"), van_der_corput(F.col("id")).alias("point"))
    dealt = (
        points.withColumn("cell", F.floor(F.col("point") * CELLS)).join(cells, "cell")
        .filter("point >= begin and point < end").select("slot", "key")
    )
    ranked = running_total(dealt, ["key"], F.floor(F.col("slot") / SLOT_BUCKET), [F.col("slot")], F.lit(1), "rank")
    ranked = written(ranked.select("slot", "key", "rank"), "slots")
    have = ranked.groupBy(F.col("key").alias("have_key")).agg(F.count("*").alias("have"))
    short = (
        quota.join(have, F.col("key") == F.col("have_key"), "left").withColumn("have", F.coalesce("have", F.lit(0)))
        .filter("have < slots")
        .select("key", F.explode(F.expr("sequence(have, slots - 1)")).alias("rank"))
        .select((F.lit(total) + F.col("rank")).cast("long").alias("slot"), "key", "rank")
    )
    every = ranked.unionByName(short).withColumnRenamed("key", "slot_key")
    return (
        every.join(quota, F.col("slot_key") == F.col("key")).filter("rank < slots")
        .withColumn("epoch", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks"))
        .withColumn("words", F.greatest(F.lit(0), F.least(
            F.lit(block), F.col("source_size") - F.col("block") * block,
            F.col("goal") - F.col("epoch") * F.col("source_size") - F.col("block") * block)))
        .filter("words > 0").select("slot", "key", "epoch", "block", "words")
    )


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, block: int = BLOCK_WORDS,
                carry: tuple[str, ...] = ()):
    """Mix ``documents(doc_id, source, text)``: returns ``(documents, takes)``.

    ``documents``: (row, doc_id, size, source_size, target, and the columns named in ``carry``), one row per input row,
    ``row`` numbering them.
    ``takes``: (row, epoch, words, first_slot), the words that each pass over the source's stream takes from the row's
    beginning; a row that nothing is taken from has none.  Null and blank texts have size 0 and are never taken; null
    sources form a source of their own, behind the others; rows that repeat are separate rows of equal place; an empty
    table gives two empty results; other columns are ignored.
    """
    sized = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), *carry
        ).select(
            *carry, F.monotonically_increasing_id().alias("row"), "doc_id", "source",
            F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"),
            word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(6), "doc_id", "text").alias("place"),
        ),
        "sized",
    )
    targets = written(source_targets(sized, weights, share, max_epochs), "targets")
    stream = running_total(
        sized.filter("size > 0").select("row", "key", "size", "place"), ["key"], F.pmod("place", F.lit(STREAM_BUCKETS)),
        [F.col("place"), F.col("row")], F.col("size"), "start",
    )
    parts = (
        stream.select("row", "key", "start", "size", F.explode(F.expr(
            f"sequence(start div {block}, (start + size - 1) div {block})")).alias("at"))
        .select("row", F.col("key").alias("part_key"), "at",
                F.greatest(F.lit(0), F.col("start") - F.col("at") * block).alias("from"),
                F.least(F.lit(block), F.col("start") + F.col("size") - F.col("at") * block).alias("to"))
    )
    slots = slot_schedule(targets, block)
    takes = (
        parts.join(slots, (F.col("part_key") == F.col("key")) & (F.col("at") == F.col("block")))
        .withColumn("got", F.least("to", "words") - F.col("from")).filter("got > 0")
        .groupBy("row", "epoch").agg(F.sum("got").alias("words"), F.min("slot").alias("first_slot"))
    )
    by_key = targets.withColumnRenamed("key", "target_key")
    documents = sized.join(by_key, F.col("key") == F.col("target_key")).select("row", "doc_id", "size", "source_size", "target", *carry)
    return documents, takes


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus, in the order of the schedule: each document once per pass that takes of it, at the place of its
    first slot in that pass, text cut to the words taken, columns as given.  So every beginning of the result holds the
    sources near their shares."""
    named = written(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "mix-input")
    documents, takes = mix_sources(named, **options, carry=("_mix_row",))
    cut = takes.join(documents, "row").select(
        F.col("_mix_row").alias("_mix_take"), F.col("words").alias("_mix_words"), F.col("size").alias("_mix_size"),
        F.col("first_slot").alias("_mix_slot"), F.col("epoch").alias("_mix_epoch"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(F.col("_mix_words") >= F.col("_mix_size"), F.col("text")).otherwise(
        F.array_join(F.slice(words, F.lit(1), F.col("_mix_words").cast("int")), " "))
    mixed = named.join(cut, F.col("_mix_row") == F.col("_mix_take")).withColumn("text", text)
    return mixed.orderBy("_mix_slot", "_mix_epoch", "_mix_row").select(*docs.columns)
