"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

1. Every document becomes token ids plus an end id; a document longer than a sequence is cut into pieces.
2. Each partition of the written piece table packs its own pieces best-fit decreasing, in bounded chunks.  Nearly
   full bins are final.
3. The underfull bins become items of their own size.  They are merged over ever fewer partitions and packed
   best-fit again, until they fit one chunk or a round no longer closes any.
4. Small tables say where each open bin went (final bin, shift); a piece's place is its place in its first bin plus
   that shift.

Only lengths move in steps 2 to 4; ids never leave the tokenising task except through a checksum.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import drop_written, ship_package, text_slices, written

SEQUENCE_TOKENS = 4096
END_ID = 1
#: Pieces or bins that one best-fit chunk holds.
CHUNK_ITEMS = 1 << 17
#: A bin whose free tokens are at most this part of a sequence is final.
NEARLY_FULL = 1 / 1024
#: Words whose ids a Python worker keeps.
KEPT_WORDS = 400_000

_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids of words between ASCII white space, kept as little-endian uint32 bytes.

    The vocabulary file drops white space and never joins across it, so a text's ids are its words' ids in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.kept: dict[str, bytes] = {}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def ids(self, word: str) -> bytes:
        if not word:  # empty texts and the edges of texts that begin or end with white space
            return b""
        known = self.kept.get(word)
        if known is None:
            if word[-1] in ",.;:!?" and len(word) > 1 and word[:-1].isalpha():
                known = self.ids(word[:-1]) + self.ids(word[-1])
            else:
                known = np.array(self._encode(word), "<u4").tobytes()
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            self.kept[word] = known
        return known

    def _encode(self, word: str) -> list[int]:
        low = word.lower()
        if low.isalpha() and max(low) < "ɐ":  # one word of letters that are normal already: straight to the model
            if not low.isascii():
                low = low.encode().decode("latin-1").translate(self.alphabet)
            return [t.id for t in self.model.tokenize(low)]
        return self.library.encode(word, add_special_tokens=False).ids


def encoder(path: str) -> WordEncoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def encoded_texts(texts: pa.Array, path: str) -> Iterator[bytes]:
    """Little-endian uint32 ids of each text (null: none)."""
    enc = encoder(path)
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = split.flatten().dictionary_encode()
    names = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
    ids = list(map(enc.kept.get, names))
    for k, known in enumerate(ids):
        if known is None:
            ids[k] = enc.ids(names[k])
    codes = flat.indices.to_numpy(zero_copy_only=False)
    offsets = split.offsets.to_numpy()
    offsets = (offsets - offsets[0]).tolist()
    for lo, hi in zip(offsets, offsets[1:]):
        yield b"".join(map(ids.__getitem__, codes[lo:hi].tolist()))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, length: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """``documents`` -> one row per piece of at most ``length`` tokens: (doc_id, piece, start, length, ids_crc32).

    A document's ids are the library's for its whole text, then ``end_id``; null and empty texts have the end
    id alone.  Rows that repeat and null ids are kept, each with its own pieces; other columns are ignored.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for part in text_slices(batches):
            row, piece, size, crc = [], [], [], []
            for d, ids in enumerate(encoded_texts(part.column(1), path)):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    cut = ids[at : at + 4 * length]
                    row.append(d)
                    piece.append(k)
                    size.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            number = np.array(piece, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row, pa.int32())), pa.array(number, pa.int32()), pa.array(number * length),
                 pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: for each item its bin and its offset there, and each bin's used size.

    Bins with the same free size wait on one stack; a bit set of the free sizes in use finds the tightest fit.
    """
    bins, offsets, used = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_sizes = 0
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = free_sizes >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = waiting[free].pop()
            if not waiting[free]:
                free_sizes ^= 1 << free
        else:
            b, free = len(used), capacity
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        left = free - size
        if left:
            if not waiting[left]:
                free_sizes |= 1 << left
            waiting[left].append(b)
    return bins, offsets, np.array(used, np.int64)


def _packed(rows: DataFrame, size: str, round_: int, capacity: int) -> DataFrame:
    """Pack each partition of ``rows`` by column ``size`` in chunks; adds (bin, shift, used)."""
    names = rows.columns
    fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = (round_ << 56) + (TaskContext.get().partitionId() << 32)

        def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal first
            chunk = pa.Table.from_batches(held).combine_chunks()
            bins, shift, used = best_fit(chunk.column(size).to_numpy().astype(np.int64), capacity)
            out = [*(chunk.column(n).combine_chunks() for n in names), pa.array(bins + first), pa.array(shift), pa.array(used[bins])]
            first += len(used)
            return pa.RecordBatch.from_arrays(
                [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in out], names=[*names, "bin", "shift", "used"]
            )

        held, count = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ITEMS):
                part = batch.slice(at, CHUNK_ITEMS)
                if count and count + part.num_rows > CHUNK_ITEMS:
                    yield emit(held)
                    held, count = [], 0
                held.append(part)
                count += part.num_rows
        if count:
            yield emit(held)

    return rows.mapInArrow(run, f"{fields}, bin long, shift long, used long")


def pack_pieces(pieces: DataFrame, length: int = SEQUENCE_TOKENS, nearly_full: float = NEARLY_FULL) -> DataFrame:
    """Adds (sequence_id, offset) to rows with a column ``length`` of at most ``length`` tokens each.

    ``pieces`` must be a written table (a retried task has to see the same rows).  An empty table stays empty.
    """
    first = written(_packed(pieces, "length", 0, length), "packed")
    is_open = F.col("used") < length - int(nearly_full * length)
    bins = first.filter(is_open).groupBy("bin").agg(F.max("used").alias("used"))
    #: (bin, target, moved): where each bin that was open after the first round is now.
    places = written(bins.select("bin", F.col("bin").alias("target"), F.lit(0).cast("long").alias("moved"), "used"), "bins")
    waiting = places.select(F.col("target").alias("item"), F.col("used").alias("size"))
    n, round_ = waiting.count(), 0
    while n > 1:
        round_ += 1
        parts = -(-n // CHUNK_ITEMS)
        merged = written(_packed(written(waiting.coalesce(parts) if parts > 1 else waiting.repartition(1), "open"), "size", round_, length), "packed")
        after = places.join(
            merged.select(F.col("item").alias("target"), F.col("bin").alias("to"), F.col("shift").alias("by"), F.col("used").alias("now")),
            "target", "left",
        ).select(
            "bin", F.coalesce("to", "target").alias("target"), (F.col("moved") + F.coalesce("by", F.lit(0))).alias("moved"),
            F.coalesce("now", "used").alias("used"),
        )
        after = written(after, "bins")
        drop_written(places)
        places = after
        waiting = merged.filter(is_open).groupBy("bin").agg(F.max("used").alias("size")).withColumnRenamed("bin", "item")
        left = waiting.count()
        if parts == 1 or left > 0.99 * n:
            break
        n = left
    to = places.select(F.col("bin").alias("open_bin"), "target", "moved")
    return first.join(to, F.col("bin") == F.col("open_bin"), "left").select(
        *pieces.columns,
        F.coalesce("target", "bin").alias("sequence_id"),
        (F.col("shift") + F.coalesce("moved", F.lit(0))).alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, length: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """``documents`` -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    Null and empty texts pack as their end id alone; equal lengths and rows that repeat are packed one by one;
    an empty table gives no pieces; columns besides ``doc_id`` and ``text`` are ignored, whatever their names.
    """
    return pack_pieces(written(token_pieces(docs, path, length, end_id), "pieces"), length)
