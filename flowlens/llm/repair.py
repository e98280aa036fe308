"""Conversation structure repair: cheapest edits to a lawful order of turns, by an auction over each block of rows.

1. Rows are sorted by (conversation, turn, role, text) over range partitions; row numbers of the sorted table cut each
   conversation into blocks of at most ``BLOCK_ROWS`` rows.  Most conversations are one block.
2. A block's lattice is solved by the auction algorithm (:mod:`flowlens.llm.auction`).  A conversation of several blocks
   is solved in sweeps over trees of blocks: transfer costs go up by min-plus products, prices at the blocks' ends come
   down, the states that each block's least script leads to go up, entry states come down.
3. Edits meet their rows again, sorted, in one pass that streams each conversation: constant memory but for its script.

Only that last pass sees a whole conversation in one task, as one SHA-256 over its repaired text must; it holds one
batch of rows at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm import auction
from flowlens.llm.auction import FAR, STATES
from flowlens.llm.common import ship_package, shuffle_width, written

BLOCK_ROWS = 64
#: Units that one step of a sweep brings together.
FAN = 256
#: Leading characters of a text that its place among rows of one turn and role follows (then the hash).
ORDER_CHARS = 256
SPACE = " \t\n\x0b\x0c\r"
#: Solved blocks that a Python worker keeps: short conversations repeat the same pattern of roles and faults.
KEPT = 50_000
RESULT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_SOLVED: dict[tuple, tuple] = {}


def damaged(conversations: DataFrame) -> DataFrame:
    """The damage of the test set: ``(conv, turn, role, text)`` after drops, emptied and cut texts, repeats and wrong roles.

    ``conv`` is the id as text; null ids, roles and texts are one space.
    """
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit(" ")).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    kind = F.crc32(F.concat("conv", F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    rows = rows.withColumn("kind", kind).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.expr("sequence(1, if(kind = 3, 2, 1))"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def sorted_rows(rows: DataFrame) -> DataFrame:
    """The written table ``(conv, turn, role, text, same, at)``; ``at`` numbers the rows in order, gapless in a partition.

    A conversation of any size is spread over range partitions; ``same`` is the text's hash.
    """
    rows = rows.withColumn("same", F.sha2("text", 256)).withColumn("_row", F.monotonically_increasing_id())
    order = ["conv", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, ORDER_CHARS), "same"]
    dealt = rows.repartitionByRange(shuffle_width(rows.sparkSession), *order, "_row").sortWithinPartitions(*order).drop("_row")
    return written(dealt.withColumn("at", F.monotonically_increasing_id()), "sorted-turns")


def faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault``: each row's first one of blank, duplicate, truncated, or null."""
    again = rows.groupBy("conv", "role", "same").agg(F.min("at").alias("first_at"), F.count("*").alias("n")).filter("n > 1").select(
        F.col("conv").alias("d_conv"), F.col("role").alias("d_role"), F.col("same").alias("d_same"), "first_at"
    )
    seen = rows.join(again, (F.col("conv") == F.col("d_conv")) & (F.col("role") == F.col("d_role")) & (F.col("same") == F.col("d_same")), "left")
    said = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (
        F.when(said == "", "blank").when(F.col("first_at") < F.col("at"), "duplicate")
        .when(~F.substring(said, -1, 1).isin(".", "!", "?"), "truncated")
    )
    return seen.withColumn("fault", fault).drop("d_conv", "d_role", "d_same", "first_at")


def _code() -> Column:
    """A row's two characters for the lattice."""
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", "t").otherwise("k")
    return F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), fault)


def _solve(codes: str, last: bool, out: tuple, origins: tuple) -> dict:
    key = (codes, last, out, origins)
    known = _SOLVED.get(key)
    if known is None:
        if len(_SOLVED) >= KEPT:
            _SOLVED.clear()
        known = _SOLVED[key] = auction.Lattice(codes, last, out).scripts(origins)
    return known


def _mapped(df: DataFrame, step: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    """``step`` on each row; rows are small (codes and matrices, never texts)."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                done = [x for r in batch.slice(at, 1000).to_pylist() for x in step(r)]
                if done:
                    yield pa.RecordBatch.from_pydict({n: [x[n] for x in done] for n in names}, schema=_arrow(schema))

    return df.mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])


def _packed(units: DataFrame, name: str) -> DataFrame:
    """Units ``(conv, unit, value)`` by groups of FAN neighbours: ``(conv, unit, units: [(unit, value)])``, written."""
    parts = units.groupBy("conv", F.floor(F.col("unit") / FAN).alias("up")).agg(F.sort_array(F.collect_list(F.struct("unit", "value"))).alias("units"))
    return written(parts.select("conv", F.col("up").alias("unit"), "units"), name)


def _sweep_up(units: DataFrame, levels: int, combine: Callable, name: str) -> list[DataFrame]:
    """Packed tables from the lowest level to the highest one; ``combine`` joins two neighbouring values."""
    packs = [_packed(units, name)]

    def one(r: dict) -> Iterable[dict]:
        value = r["units"][0]["value"]
        for u in r["units"][1:]:
            value = combine(value, u["value"])
        yield {"conv": r["conv"], "unit": r["unit"], "value": value}

    for _ in range(levels - 1):
        packs.append(_packed(_mapped(packs[-1], one, "conv string, unit long, value array<long>"), name))
    return packs


def _sweep_down(packs: list[DataFrame], top: list[int], step: Callable, name: str) -> DataFrame:
    """Hand ``top`` down: ``step(values of a group in order, the group's own)`` gives each member's.  -> (conv, unit, given)."""
    given = None
    for pack in reversed(packs):
        if given is None:
            rows = pack.withColumn("given", F.array(*[F.lit(x).cast("long") for x in top]))
        else:
            own = given.select(F.col("conv").alias("g_conv"), F.col("unit").alias("g_unit"), "given")
            rows = pack.join(own, (F.col("conv") == F.col("g_conv")) & (F.col("unit") == F.col("g_unit"))).select("conv", "unit", "units", "given")

        def one(r: dict) -> Iterable[dict]:
            for u, value in zip(r["units"], step([u["value"] for u in r["units"]], r["given"])):
                yield {"conv": r["conv"], "unit": u["unit"], "given": value}

        given = written(_mapped(rows, one, "conv string, unit long, given array<long>"), name)
    return given


def _min_plus(a: list[int], b: list[int]) -> list[int]:
    n = range(STATES)
    return [min(FAR, min(a[STATES * i + k] + b[STATES * k + j] for k in n)) for i in n for j in n]


def _prices(matrices: list, out: list[int]) -> list[list[int]]:
    """Prices behind each unit, from those behind the last one."""
    found = [out]
    for m in reversed(matrices[1:]):
        found.append([min(FAR, min(m[STATES * i + k] + found[-1][k] for k in range(STATES))) for i in range(STATES)])
    return found[::-1]


def _entries(maps: list, entry: list[int]) -> list[list[int]]:
    found = [entry]
    for m in maps[:-1]:
        found.append([m[found[-1][0]]])
    return found


def scripts(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``(conv, at, role, fault)`` -> ``(conv, at, edits)``: insertions before a row and its own edit, as letters.

    Insertions behind the last row come under the ``at`` that follows it.
    """
    spark = rows.sparkSession
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    size = rows.agg(F.max(part).alias("part"), F.max(inside).alias("inside")).first()
    stride = (size["inside"] or 0) // block_rows + 1
    levels, reach = 1, ((size["part"] or 0) + 1) * stride
    while reach > FAN:
        levels, reach = levels + 1, -(-reach // FAN)
    unit = part * stride + F.floor(inside / block_rows)
    blocks = (
        rows.select("conv", "at", unit.alias("unit"), _code().alias("code")).groupBy("conv", "unit")
        .agg(F.min("at").alias("first_at"), F.sort_array(F.collect_list(F.struct("at", "code"))).alias("codes"))
        .select("conv", "unit", "first_at", F.array_join(F.col("codes.code"), "").alias("codes"))
    )
    blocks = written(blocks, "turn-blocks")
    ends = blocks.groupBy(F.col("conv").alias("e_conv")).agg(F.count("*").alias("blocks"), F.max("unit").alias("last_unit"))
    blocks = blocks.join(ends, F.col("conv") == F.col("e_conv")).drop("e_conv")
    done = "conv string, at long, edits string"

    def edits(r: dict, parts: list[str], last: bool) -> Iterable[dict]:
        for k, x in enumerate(parts):
            if k < len(parts) - 1 or last and x:
                yield {"conv": r["conv"], "at": r["first_at"] + k, "edits": x}

    def single(r: dict) -> Iterable[dict]:
        return edits(r, _solve(r["codes"], True, (), (0,))[0][1], True)

    alone = _mapped(blocks.filter("blocks = 1"), single, done)
    many = written(blocks.filter("blocks > 1").withColumn("last", F.col("unit") == F.col("last_unit")).select("conv", "unit", "first_at", "codes", "last"), "long-talks")

    def matrix(r: dict) -> Iterable[dict]:
        yield {"conv": r["conv"], "unit": r["unit"], "value": auction.transfer(r["codes"], r["last"])}

    value = "conv string, unit long, value array<long>"
    costs = _sweep_up(_mapped(many, matrix, value), levels, _min_plus, "transfer-costs")
    prices = _sweep_down(costs, [0, FAR, FAR, FAR], _prices, "end-prices")

    def beside(given: DataFrame) -> DataFrame:
        given = given.select(F.col("conv").alias("g_conv"), F.col("unit").alias("g_unit"), "given")
        return many.join(given, (F.col("conv") == F.col("g_conv")) & (F.col("unit") == F.col("g_unit"))).drop("g_conv", "g_unit")

    def exits(r: dict) -> Iterable[dict]:
        found = _solve(r["codes"], r["last"], () if r["last"] else tuple(r["given"]), tuple(range(STATES)))
        yield {"conv": r["conv"], "unit": r["unit"], "value": [found[q][2] if q in found else 0 for q in range(STATES)]}

    priced = written(beside(prices), "priced-blocks")
    maps = _sweep_up(_mapped(priced, exits, value), levels, lambda a, b: [b[x] for x in a], "exit-states")
    entries = _sweep_down(maps, [0], _entries, "entry-states")
    entries = entries.select(F.col("conv").alias("n_conv"), F.col("unit").alias("n_unit"), F.col("given")[0].alias("entry"))
    entered = priced.join(entries, (F.col("conv") == F.col("n_conv")) & (F.col("unit") == F.col("n_unit"))).drop("n_conv", "n_unit")

    def block(r: dict) -> Iterable[dict]:
        found = _solve(r["codes"], r["last"], () if r["last"] else tuple(r["given"]), tuple(range(STATES)))
        return edits(r, found[r["entry"]][1], r["last"])

    return alone.unionByName(_mapped(entered, block, done))


class _Talk:
    """What one conversation's rows add up to, fed in order."""

    def __init__(self):
        self.turns, self.low, self.high, self.turn = 0, None, None, None
        self.count = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.cost = 0
        self.before, self.after = None, ""
        self.audit: list[str] = []
        self.digest, self.begun = hashlib.sha256(), False

    def _say(self, role: str, text: str) -> None:
        if self.begun:
            self.digest.update(b"\n")
        self.begun = True
        self.after = role[:1]
        self.digest.update(f"{role}:".encode())
        self.digest.update(text.encode())

    def _fitting(self) -> str:
        return "assistant" if self.after == "u" else "user"

    def edit(self, edits: str, row: dict | None) -> None:
        self.audit.append(edits)
        for x in edits:
            if x == "I":
                self.cost += auction.INSERT
                self._say(self._fitting(), "")
        if row is None:
            return
        turn, fault, initial = row["turn"], row["fault"], row["role"][:1]
        if turn is not None:
            self.turns += turn != self.turn
            self.turn = self.high = turn
            self.low = turn if self.low is None else self.low
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if fault:
            self.count[fault] += 1
        if edits[-1] == "D":
            self.cost += auction.DELETE
            return
        self.cost += (auction.REROLE if edits[-1] == "R" else 0) + (auction.TRUNCATED if fault == "truncated" else 0)
        self._say(self._fitting() if edits[-1] == "R" else row["role"], row["text"])

    def result(self, conv: str) -> dict:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {"conv": conv, "gaps": min(gaps, (1 << 63) - 1), **self.count, "illegal": self.illegal, "cost": self.cost,
                "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (conv, at, edits before its row) -> one row per conversation."""
    from flowlens.llm.common import text_slices

    names = [f.split()[0] for f in RESULT.split(", ")]
    conv, talk, waiting, done = None, None, None, []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pydict({n: [x[n] for x in done] for n in names}, schema=_arrow(RESULT))
        done.clear()
        return batch

    def close() -> None:
        if waiting is not None:
            talk.edit(waiting["edits"], None)
        done.append(talk.result(conv))

    for batch in batches:
        for part in text_slices([batch]):
            for r in part.to_pylist():
                if conv is None or r["conv"] != conv:
                    if conv is not None:
                        close()
                    conv, talk, waiting = r["conv"], _Talk(), None
                if r["edits"] is not None:
                    waiting = r
                else:
                    talk.edit(waiting["edits"], r)
                    waiting = None
            if len(done) >= 1000:
                yield flush()
    if conv is not None:
        close()
        yield flush()


def repair_conversations(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows ``(conv, turn, role, text)`` without nulls but in ``turn`` -> one row per conversation (RESULT).

    Rows stand in order of turn (nulls first), role, text (its first characters, then its hash); a row's first fault
    counts: blank, duplicate (same role and text earlier), truncated.  Edits: K keeps a row, R gives it the role user or
    assistant, D deletes it, I inserts an empty row.  ``audit``: the cheapest edits that make the roles' initials
    ``(s?(ua)+)?``, of equally cheap ones the ASCII-least; ``repaired_sha256``: of the repaired ``role:text`` lines.
    ``gaps`` beyond a long end at its largest value.  An empty table gives an empty result; other columns are ignored.
    """
    ship_package(rows.sparkSession)
    sorted_ = sorted_rows(rows.select("conv", "turn", "role", "text"))
    judged = written(faults(sorted_).select("conv", "at", "turn", "role", "text", "fault"), "judged-turns")
    edits = scripts(judged.select("conv", "at", "role", "fault"), block_rows)
    empty = [F.lit(None).cast(kind).alias(n) for n, kind in (("turn", "long"), ("role", "string"), ("text", "string"), ("fault", "string"))]
    both = judged.withColumn("edits", F.lit(None).cast("string")).select("conv", "at", "edits", "turn", "role", "text", "fault").union(
        edits.select("conv", "at", "edits", *empty)
    )
    dealt = both.repartition(shuffle_width(rows.sparkSession), "conv").sortWithinPartitions("conv", "at", F.col("edits").asc_nulls_last())
    return dealt.mapInArrow(_stream, RESULT)


def audit_conversations(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> one row per original ``conv_id``: damaged, judged and repaired.

    Null ids are one conversation; a conversation that loses all its rows has zeros, an empty audit and the hash of an
    empty string; rows that repeat are rows of their own; other columns are ignored; an empty table stays empty.
    """
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    ids = ids.withColumn("id_key", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    found = repair_conversations(damaged(conversations), block_rows)
    counts = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, F.col("id_key") == F.col("conv"), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
