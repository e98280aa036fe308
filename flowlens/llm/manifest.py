"""Merkle manifest of a dataset by checkpoint-and-recompute.

Every tree's leaves stand in a gapless order.  Of its levels only every ``LEVELS``-th is persisted: going up, aligned
subtrees of ``2 ** LEVELS`` stored nodes are hashed to their top in one step and the nodes between are dropped.  Proof
extraction goes down again: each aligned subtree regenerates its missing nodes from the stored ones below, hands every
stored child its siblings (and those of its ancestors), and drops the nodes once more.

Texts are hashed where they are read; rows that move hold digests only.  A subtree is the largest group that a task sees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from flowlens.llm.common import ship_package, shuffle_width, written

LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: (leaf of) every 7th id by its checksum is tampered with in the check of the proofs.
TAMPERED_EVERY = 7
STORED = "tree string, n long, at long, node string"
PATHS = "tree string, at long, path array<string>, subroot string"
PROOFS = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: dict[str, Column]) -> Column:
    """A row's digest: each field ``-`` if null, else its UTF-8 byte count, ``:`` and value."""
    return F.sha2(F.concat(*[_field(values[f]) for f in FIELDS]).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """The written table ``(tree, doc_id, leaf, shown)``: ``shown`` is the leaf as a verifier sees it, null if it is the same.

    ``tree``: ``-`` for null, else ``=`` and the language, which sorts null first, then by bytes.
    """
    own = {f: F.col(f) for f in FIELDS}
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % TAMPERED_EVERY == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    # One more than the largest long is the next integer all the same.
    more = (F.col("n_chars").cast("decimal(20,0)") + F.lit(1)).cast("decimal(20,0)")
    return written(docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf(own).alias("leaf"), F.when(changed, leaf({**own, "n_chars": more})).alias("shown"),
    ), "leaves")


def numbered(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Adds ``at``, gapless from 0 in each ``tree`` by ``order``, and ``n``, the tree's row count.

    Rows are sorted over range partitions (equal ones by place too, so no key stays in one task); a window only runs over
    one row for each partition of a tree.
    """
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(shuffle_width(rows.sparkSession), "tree", *order, "_row").sortWithinPartitions("tree", *order, "_row")
    sorted_ = written(dealt.drop("_row").withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    runs = sorted_.groupBy("tree", part.alias("part")).agg(F.min("_at").alias("begin"), F.count("*").alias("size"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        F.col("tree").alias("o_tree"), F.col("part").alias("o_part"), (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("begin")).alias("shift"),
        F.sum("size").over(whole).alias("n"),
    )
    placed = sorted_.join(offsets, (F.col("tree") == F.col("o_tree")) & (part == F.col("o_part")))
    return placed.withColumn("at", F.col("_at") + F.col("shift")).drop("o_tree", "o_part", "_at", "shift")


def _packed(nodes: DataFrame, levels: int, members: list[str], name: str) -> DataFrame:
    """Aligned subtrees, one row each: ``(tree, n, at, nodes)``, written."""
    return written(nodes.groupBy("tree", "n", F.shiftright("at", levels).alias("up")).agg(
        F.sort_array(F.collect_list(F.struct("at", *members))).alias("nodes")
    ).select("tree", "n", F.col("up").alias("at"), "nodes"), name)


def _steps(n: int, levels: int) -> int:
    """Levels from the stored nodes (``n`` in the whole tree) to the top of an aligned subtree."""
    return min(levels, (n - 1).bit_length())


def subtree(nodes: list[str], steps: int) -> list[list[str]]:
    """All levels of a subtree, the given nodes first; every two become one, and so does a last single one."""
    found = [nodes]
    for _ in range(steps):
        below = found[-1]
        found.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return found


def siblings(found: list[list[str]], i: int) -> list[str]:
    """What a fold from node ``i`` needs, level by level: ``<`` or ``>`` (its side) and the sibling; empty without one."""
    path = []
    for level in found[:-1]:
        k = i ^ 1
        path.append(("<" if k < i else ">") + level[k] if k < len(level) else "")
        i >>= 1
    return path


def fold(node: str, path: Iterable[str]) -> str:
    for s in path:
        node = digest(s[1:], node) if s[:1] == "<" else digest(node, s[1:])
    return node


def _mapped(df: DataFrame, step: Callable[[dict], Iterable[dict]], schema: str) -> DataFrame:
    kinds = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
    fields = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one subtree at a time
                done = [x for r in batch.slice(k, 1).to_pylist() for x in step(r)]
                yield pa.RecordBatch.from_pydict({n: [x[n] for x in done] for n in fields.names}, schema=fields)

    return df.mapInArrow(run, schema)


def climb(packed: DataFrame, levels: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """From packed subtrees to the roots: (stored tables from below, roots ``(tree, n, at, node)``).

    One number, the largest tree's size, reaches the driver.
    """
    def top(r: dict) -> Iterable[dict]:
        steps = _steps(r["n"], levels)
        up = -(-r["n"] // (1 << levels))
        yield {"tree": r["tree"], "n": up, "at": r["at"], "node": subtree([x["node"] for x in r["nodes"]], steps)[-1][0]}

    stored, largest = [packed], packed.agg(F.max("n")).first()[0] or 0
    while True:
        tops = written(_mapped(stored[-1], top, STORED), name)
        largest = -(-largest // (1 << levels))
        if largest <= 1:
            return stored, tops
        stored.append(_packed(tops, levels, ["node"], name + "-stored"))


def descend(stored: list[DataFrame], given: DataFrame, levels: int, name: str) -> DataFrame:
    """Hand ``given`` (PATHS: each tree's own path) down to the lowest subtrees: PATHS, one row for each of them."""
    def down(r: dict) -> Iterable[dict]:
        found = subtree([x["node"] for x in r["nodes"]], _steps(r["n"], levels))
        for i, x in enumerate(r["nodes"]):
            yield {"tree": r["tree"], "at": x["at"], "path": siblings(found, i) + r["path"], "subroot": r["subroot"]}

    for table in reversed(stored[1:]):
        given = written(_mapped(beside(table, given), down, PATHS), name)
    return given


def beside(table: DataFrame, given: DataFrame) -> DataFrame:
    """Packed subtrees with the path of their top; a key has one row on both sides."""
    given = given.select(F.col("tree").alias("g_tree"), F.col("at").alias("g_at"), "path", "subroot")
    return table.join(given, (F.col("tree") == F.col("g_tree")) & (F.col("at") == F.col("g_at"))).drop("g_tree", "g_at")


def merkle_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``documents`` -> ``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``, one row for each row.

    A tree for each language over its rows by doc_id (nulls first; rows that share an id by their digest), a tree over the
    languages' roots (null first, then by bytes).  ``proof_sha256`` is the digest of all siblings from the leaf to the
    root; ``folded_root`` is folded from the leaf as shown, which is tampered with for some ids, and ``verified`` says
    whether it is the root.  Null values are fields of their own, rows that repeat are leaves of their own, other columns
    are ignored; a lone leaf is its tree's root and has no siblings; an empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_first(), "leaf"]
    nodes = numbered(leaves(docs), order, "sorted-leaves").withColumnRenamed("leaf", "node")
    lowest = _packed(nodes, levels, ["node", "doc_id", "shown"], "leaf-subtrees")
    stored, roots = climb(lowest, levels, "subtree-tops")

    # The roots of the languages are the leaves of one more tree.
    langs = numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("lang_tree"), "node"), ["lang_tree"], "subroots")
    lang_lowest = _packed(langs, levels, ["node", "lang_tree"], "subroot-subtrees")
    lang_stored, top = climb(lang_lowest, levels, "root-tops")
    own = top.select("tree", "at", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"))
    above = descend(lang_stored, own, levels, "root-paths")

    def for_lang(r: dict) -> Iterable[dict]:
        found = subtree([x["node"] for x in r["nodes"]], _steps(r["n"], levels))
        for i, x in enumerate(r["nodes"]):
            yield {"tree": x["lang_tree"], "at": 0, "path": siblings(found, i) + r["path"], "subroot": x["node"]}

    lang_paths = written(_mapped(beside(lang_lowest, above), for_lang, PATHS), "lang-paths")
    paths = descend(stored, lang_paths, levels, "leaf-paths")

    def prove(r: dict) -> Iterable[dict]:
        found = subtree([x["node"] for x in r["nodes"]], _steps(r["n"], levels))
        for i, x in enumerate(r["nodes"]):
            path = siblings(found, i) + r["path"]
            yield {"doc_id": x["doc_id"], "leaf": x["node"], "subroot": r["subroot"], "proof_sha256": digest(*[s[1:] for s in path]),
                   "folded_root": fold(x["shown"] or x["node"], path)}

    proofs = _mapped(beside(lowest, paths), prove, PROOFS)
    whole = top.agg(F.max("node")).first()[0]
    root = F.lit(whole).cast("string")
    return proofs.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
