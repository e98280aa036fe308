"""SimHash near-duplicates: 64-bit fingerprints and a binary-trie self-join under a Hamming budget.

Fingerprints are computed per document in Arrow batches.  Equal fingerprints collapse first, so a group of
copies is one trie leaf however large it is.  The trie's upper part is dealt out by Spark: a task holds the
two subtries of one pair of prefixes whose own distance is within the budget, and descends node pairs together,
adding one error when the children differ and dropping a pair when the budget is exceeded.  A task returns a
spanning forest of the links it found (never all pairs), and the forests meet in connected components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import drop_written, ship_package, text_slices, written
from flowlens.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
HASH_SEED = 42
#: A prefix is made longer until its subtrie has at most so many distinct fingerprints, or MAX_PREFIX bits.
SUBTRIE_LIMIT = 8192
MAX_PREFIX = 18
#: Node pairs of a frontier that one step expands; the rest wait on a stack.
FRONTIER = 1 << 18
#: Bytes of one text that are split into words at a time.
WORD_BYTES = 1 << 22


def word_runs(text: bytes, limit: int = WORD_BYTES) -> Iterator[list[bytes]]:
    """The text's words in order, as lists from pieces of about ``limit`` bytes cut at white space."""
    if len(text) <= limit:
        yield text.split()
        return
    at, n = 0, len(text)
    while at < n:
        end = min(n, at + limit)
        while end < n and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end].split()
        at = end


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of one UTF-8 text (None or no words: 0)."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    counts, total, tail, seen = np.zeros(64, np.int64), 0, [], 0
    pattern = b" ".join([b"%b"] * shingle)
    for words in word_runs((text or b"").lower()):
        seen += len(words)
        words = tail + words
        hashes = [digest(pattern % t, HASH_SEED) for t in zip(*[words[i:] for i in range(shingle)])]
        tail = words[-(shingle - 1):] if shingle > 1 else []
        if hashes:
            bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
            counts += bits.sum(axis=0, dtype=np.int64)
            total += len(hashes)
    if 0 < seen < shingle:
        return digest(b" ".join(tail), HASH_SEED) if seen else 0
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, keys: Sequence[str] = ()) -> DataFrame:
    """``documents`` -> ``(doc_id, *keys, fp)``, one row per input row; ``fp`` is the fingerprint as a signed long.

    Null and empty texts have fingerprint zero; columns besides the longs ``keys`` are ignored.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            texts = part.column(1).cast(pa.binary()).to_pylist()
            fps = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(fps)], names=["doc_id", *keys, "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keys).mapInArrow(
        run, ", ".join(f"{n} long" for n in ["doc_id", *keys, "fp"])
    )


def _hook(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Merge the components of ``label`` (label[i] <= i, roots point at themselves) along the links u - v."""
    while True:
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            return label
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """First position of each sorted range whose key has bit ``depth`` (from the top) set; its higher bits agree."""
    bit = 1 << (63 - depth)
    want = (keys[lo] & np.uint64((1 << 64) - 2 * bit)) | np.uint64(bit)
    return np.clip(np.searchsorted(keys, want), lo, hi)


def trie_links(a: np.ndarray, b: np.ndarray | None, skip_bits: int, spent: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the sorted distinct uint64 keys of two subtries (``b`` None: within ``a``).

    All keys of a subtrie share their first ``skip_bits`` bits, which differ in ``spent`` places.  Returns a
    spanning forest ``(key, root key)`` of the links with at most ``budget`` differing bits.
    """
    own = b is None
    b = a if own else b
    base = 0 if own else len(a)
    keys = a if own else np.concatenate([a, b])
    label = np.arange(len(keys), dtype=np.int64)
    one = lambda x, kind=np.int64: np.array([x], kind)
    stack = [(skip_bits, one(0), one(len(a)), one(0), one(len(b)), one(spent, np.int8))]
    while stack:
        depth, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > FRONTIER:
            stack.append((depth, *(x[FRONTIER:] for x in (alo, ahi, blo, bhi, err))))
            alo, ahi, blo, bhi, err = (x[:FRONTIER] for x in (alo, ahi, blo, bhi, err))
        na, nb = ahi - alo, bhi - blo
        small = (na * nb <= 4) | (depth >= 64)
        if small.any():
            s_alo, s_blo, s_nb, size = alo[small], blo[small], nb[small], (na * nb)[small]
            pair = np.repeat(np.arange(len(size)), size)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            i, j = s_alo[pair] + k // s_nb[pair], s_blo[pair] + k % s_nb[pair]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if own:
                near &= i < j
            label = _hook(label, i[near], base + j[near])
            alo, ahi, blo, bhi, err = (x[~small] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        am, bm = _split(a, alo, ahi, depth), _split(b, blo, bhi, depth)
        ways = [(alo, am, blo, bm, err), (am, ahi, bm, bhi, err), (alo, am, bm, bhi, err + 1), (am, ahi, blo, bm, err + 1)]
        nxt = []
        for w, (l0, h0, l1, h1, e) in enumerate(ways):
            keep = (h0 > l0) & (h1 > l1) & (e <= budget)
            if own and w == 3:
                keep &= alo != blo  # the mirror image of the third way
            nxt.append([x[keep] for x in (l0, h0, l1, h1, e)])
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*nxt))))
    moved = np.flatnonzero(label != np.arange(len(keys)))
    return keys[moved], keys[label[moved]]


def _subtrie_pair(pdf):
    import pandas as pd

    lo, hi, depth, budget = (int(pdf[c].iloc[0]) for c in ("lo", "hi", "depth", "budget"))
    sides = {int(s): np.sort(np.asarray(f, dtype=np.int64).view(np.uint64)) for s, f in zip(pdf["side"], pdf["fps"])}
    u = v = np.empty(0, np.uint64)
    if lo == hi:
        u, v = trie_links(sides[lo], None, depth, 0, budget)
    elif len(sides) == 2:
        u, v = trie_links(sides[lo], sides[hi], depth, (lo ^ hi).bit_count(), budget)
    return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})


def trie_self_join(nodes: DataFrame, max_bits: int = MAX_BITS, subtrie_limit: int = SUBTRIE_LIMIT) -> DataFrame:
    """``nodes(fp)`` distinct fingerprints -> ``(u, v)``: forests that span all links of at most ``max_bits`` bits."""
    top = F.shiftrightunsigned("fp", 64 - MAX_PREFIX)
    filled = nodes.groupBy(top.alias("prefix")).count()
    #: Largest subtrie for each prefix length: at most MAX_PREFIX + 1 numbers reach the driver.
    sizes = (
        filled.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(MAX_PREFIX)), lambda b: F.floor(
            F.col("prefix") / F.pow(F.lit(2.0), F.lit(MAX_PREFIX) - b)))).alias("bits", "at"), "count")
        .groupBy("bits", "at").agg(F.sum("count").alias("n")).groupBy("bits").agg(F.max("n").alias("n")).collect()
    )
    largest = {r["bits"]: r["n"] for r in sizes}
    bits = next((b for b in range(MAX_PREFIX + 1) if largest.get(b, 0) <= subtrie_limit), MAX_PREFIX)
    masks = [m for m in range(1 << bits) if m.bit_count() <= max_bits]
    prefix = F.shiftrightunsigned("fp", 64 - bits) if bits else F.lit(0).cast("long")
    packed = nodes.groupBy(prefix.alias("side")).agg(F.collect_list("fp").alias("fps"))
    other = F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))
    pairs = packed.select("side", "fps", other.alias("mask")).select(
        F.least("side", F.col("side").bitwiseXOR(F.col("mask"))).alias("lo"),
        F.greatest("side", F.col("side").bitwiseXOR(F.col("mask"))).alias("hi"),
        "side", "fps", F.lit(bits).alias("depth"), F.lit(max_bits).alias("budget"),
    )
    return pairs.groupBy("lo", "hi").applyInPandas(_subtrie_pair, "u long, v long")


def fingerprint_groups(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fps(doc_id, fp)`` -> ``(node, component_id, group_id)`` of every distinct fingerprint.

    ``group_id``: the smallest fingerprint of the component; ``component_id``: its smallest ``doc_id``.
    """
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fp-nodes")
    labels = connected_components(written(trie_self_join(nodes.select("fp"), max_bits), "fp-links"))
    linked = labels.join(nodes, F.col("node") == F.col("fp")).select("node", "label", "first_id")
    smallest = linked.groupBy("label").agg(F.min("first_id").alias("component_id"))
    member = written(linked.join(smallest, "label").select("node", "component_id", "label"), "fp-members")
    whole = written(
        nodes.join(member, F.col("fp") == F.col("node"), "left").select(
            F.col("fp").alias("node"), F.coalesce("component_id", "first_id").alias("component_id"), F.coalesce("label", "fp").alias("group_id")
        ),
        "fp-components",
    )
    drop_written(member)
    return whole


def simhash_components(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``documents`` -> ``(doc_id, fingerprint, component_id)``, one row per input row.

    ``fingerprint``: 16 lowercase hex digits.  ``component_id``: the smallest ``doc_id`` among the rows reachable
    over links of at most ``max_bits`` differing bits (null only if every such row has a null id).  Null, empty
    and blank texts share fingerprint zero and link like any other; repeated rows share a component; an empty
    table gives an empty result; other columns are ignored.
    """
    fps = written(fingerprints(docs, shingle), "fingerprints")
    return fps.join(fingerprint_groups(fps, max_bits), F.col("fp") == F.col("node")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def group_firsts(docs: DataFrame, keys: Sequence[str], shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``(group_id, doc_id, *keys)``: of each group of :func:`simhash_components` the row with the smallest id (null
    ids last), of rows that share it the one with the smallest ``keys`` (columns of longs)."""
    fps = written(fingerprints(docs, shingle, keys), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *keys)).alias("first")
    firsts = fps.groupBy("fp").agg(first).join(fingerprint_groups(fps, max_bits), F.col("fp") == F.col("node"))
    return firsts.groupBy("group_id").agg(F.min("first").alias("first")).select("group_id", *[f"first.{n}" for n in ["doc_id", *keys]])
