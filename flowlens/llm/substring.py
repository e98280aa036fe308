"""Exact repeated-passage removal with one compressed FM-index per shard of candidate passages.

A window is ``window`` consecutive words of one document.  The corpus is cut into slices of whole documents, written
once; a slice is the unit in which texts move.

1. *Anchors.*  Each window picks the smallest of its ANCHOR_WORDS-word hashes; neighbouring windows with the same
   pick form a passage.  Equal windows pick equal anchors, so a window can only repeat where its anchor repeats.
   Slices send their distinct anchors with the smallest and largest document; buckets find the anchors
   that two documents share and tell each slice which of its own these are.
2. *Shards.*  Slices send the distinct passages behind such anchors to the shard of the anchor.  An anchor with very
   many different passages (a common line in ever new surroundings) is split: its windows go out one by one, by hash.
3. *FM-index.*  Each shard indexes its distinct passages (BWT in a wavelet matrix) and streams them through
   backward search; the matching statistics give, for every window, the interval of all its occurrences, and with it
   the first document that has the window.
4. *Decision.*  Slices get those first documents back, mark each window whose first document is smaller than their
   own, and drop the covered words.

A group of copies counts once per slice in every step, so no step's group grows with the number of copies in a slice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import drop_written, ship_package, text_slices, written
from flowlens.llm.fm_index import FMIndex

WINDOW_WORDS = 13
ANCHOR_WORDS = 4
#: Text bytes behind one bucket of anchors, passages in one shard, different passages of an anchor that is split.
BUCKET_BYTES = 32 << 20
SHARD_PASSAGES = 25_000
SPLIT_PASSAGES = 5_000
#: Stands for a null doc_id: behind all others.
LAST_ID = np.iinfo(np.int64).max

_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


class _Words:
    """The words of some documents: names, codes in text order, and each document's range."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        flat = split.flatten().dictionary_encode()
        self.names = flat.dictionary.to_numpy(zero_copy_only=False)
        codes = flat.indices.to_numpy(zero_copy_only=False)
        ends = split.offsets.to_numpy()
        ends = ends - ends[0]
        empty = np.flatnonzero(self.names == "")
        if len(empty):
            real = codes != empty[0]
            ends = np.r_[0, np.cumsum(real)][ends]
            codes = codes[real]
        self.codes, self.ends = codes, ends.astype(np.int64)

    def hashes(self) -> np.ndarray:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        unique = np.fromiter((digest(n) for n in self.names), np.uint64, len(self.names))
        return unique[self.codes]


class _Passages:
    """All passages of some documents: begin (word position), windows, anchor, content hash, document row."""

    def __init__(self, words: _Words, window: int):
        h = words.hashes()
        n = len(h)
        self.window, self.h = window, h
        size = np.diff(words.ends)
        self.doc = np.repeat(np.arange(len(size)), size)
        grams = max(0, n - ANCHOR_WORDS + 1)
        gram = np.zeros(grams, np.uint64)
        for k in range(ANCHOR_WORDS):
            gram = (gram ^ h[k : k + grams]) * np.uint64(_ODD)
            gram ^= gram >> np.uint64(29)
        count = max(0, n - window + 1)
        at = np.arange(count)
        real = self.doc[:count] == self.doc[window - 1 :] if count else np.zeros(0, bool)
        best, pick = gram[:count].copy(), np.zeros(count, np.int64)
        for k in range(1, window - ANCHOR_WORDS + 1):
            other = gram[k : k + count]
            less = other < best
            best[less] = other[less]
            pick[less] = k
        pick += at
        fresh = np.ones(count, bool)
        if count:
            fresh[1:] = (pick[1:] != pick[:-1]) | ~real[:-1]
        self.begin = np.flatnonzero(fresh & real)
        run = np.cumsum(fresh)[real] if count else np.zeros(0, np.int64)
        self.windows = np.unique(run, return_counts=True)[1] if len(run) else np.zeros(0, np.int64)
        self.anchor = best[self.begin]
        power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)])
        self._inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE_INVERSE, np.uint64)])
        self._sums = np.r_[np.uint64(0), np.cumsum(h * power[:n])]
        self.real = real

    def hash(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A hash of the words at [begin, begin + size)."""
        value = (self._sums[begin + size] - self._sums[begin]) * self._inverse[begin]
        value = (value ^ size.astype(np.uint64)) * np.uint64(_ODD)
        return value ^ (value >> np.uint64(32))


def _doc_ids(batch: pa.RecordBatch) -> np.ndarray:
    ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
    return pc.fill_null(ids, int(LAST_ID)).to_numpy(zero_copy_only=False)


def _opened(body: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(body).read_next_batch()


def _texts(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(batch.schema.get_field_index("text"))


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts the keys, and where each key's group begins in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)


def _arrays(blobs: Iterable[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def corpus_slices(docs: DataFrame) -> DataFrame:
    """The written table of slices: (slice, bytes, body), body holding whole rows as a compressed Arrow stream."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for part in text_slices(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                writer.write_batch(part)
            size = pc.sum(pc.binary_length(_texts(part))).as_py() or 0
            yield pa.RecordBatch.from_pydict({"slice": [number], "bytes": [size], "body": [sink.getvalue().to_pybytes()]},
                                             pa.schema([("slice", pa.int64()), ("bytes", pa.int64()), ("body", pa.binary())]))
            number += 1

    return written(docs.mapInArrow(run, "slice long, bytes long, body binary"), "slices")


def _anchor_rows(window: int, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs = _opened(body.as_buffer())
                p = _Passages(_Words(_texts(docs)), window)
                own = _doc_ids(docs)[p.doc[p.begin]]
                order, first = _groups(p.hash(p.begin, p.windows + window - 1))
                if not len(first):
                    continue
                low, high = np.minimum.reduceat(own[order], first), np.maximum.reduceat(own[order], first)
                anchor = p.anchor[order[first]]
                order, first = _groups(anchor)
                anchor = anchor[order[first]]
                low, high = np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)
                passages = np.diff(np.r_[first, len(order)]).astype(np.int32)
                bucket = (anchor >> np.uint64(20)) % np.uint64(buckets)
                order, first = _groups(bucket)
                out = {"bucket": bucket[order[first]].astype(np.int64), "slice": np.full(len(first), number)}
                for name, values in (("anchors", anchor), ("low", low), ("high", high), ("passages", passages)):
                    out[name] = [x.tobytes() for x in np.split(values[order], first[1:])]
                yield pa.RecordBatch.from_pydict(out)

    return run


def _shared_anchors(table: pa.Table) -> pa.Table:
    """The anchors of one bucket that two documents share, told to each slice that has them."""
    blobs = table.column("anchors").to_pylist()
    anchor = _arrays(blobs, "<u8")
    low, high = _arrays(table.column("low").to_pylist(), "<i8"), _arrays(table.column("high").to_pylist(), "<i8")
    passages = _arrays(table.column("passages").to_pylist(), "<i4")
    row = np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs])
    order, first = _groups(anchor)
    shared = np.minimum.reduceat(low[order], first) < np.maximum.reduceat(high[order], first)
    split = np.add.reduceat(passages[order].astype(np.int64), first) > SPLIT_PASSAGES
    size = np.diff(np.r_[first, len(order)])
    keep = np.zeros(len(anchor), bool)
    wide = np.zeros(len(anchor), np.uint8)
    keep[order] = np.repeat(shared, size)
    wide[order] = np.repeat(split, size)
    row, anchor, wide, passages = row[keep], anchor[keep], wide[keep], passages[keep]
    at = np.searchsorted(row, np.arange(len(blobs) + 1))
    return pa.table({
        "slice": table.column("slice"),
        "passages": pa.array([int(passages[a:b].sum()) for a, b in zip(at, at[1:])], pa.int64()),
        "anchors": pa.array([anchor[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()),
        "wide": pa.array([wide[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()),
    })


def _passage_rows(window: int, shards: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for number, body, blobs, wides in zip(*(batch.column(i) for i in range(4))):
                docs = _opened(body.as_buffer())
                words = _Words(_texts(docs))
                p = _Passages(words, window)
                shared, wide = _arrays(blobs.as_py(), "<u8"), _arrays(wides.as_py(), "u1")
                order = np.argsort(shared)
                shared, wide = shared[order], wide[order]
                at = np.searchsorted(shared, p.anchor).clip(0, max(0, len(shared) - 1))
                hit = np.flatnonzero(shared[at] == p.anchor) if len(shared) else np.zeros(0, np.int64)
                one = hit[wide[at[hit]] == 0]
                many = hit[wide[at[hit]] == 1]
                n = p.windows[many]
                alone = np.repeat(p.begin[many] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                begin = np.r_[p.begin[one], alone]
                size = np.r_[p.windows[one] + window - 1, np.full(len(alone), window)]
                if not len(begin):
                    continue
                content = p.hash(begin, size)
                route = np.r_[p.anchor[one], content[len(one):]]
                own = _doc_ids(docs)[p.doc[begin]]
                order, first = _groups(content)
                low, high = np.minimum.reduceat(own[order], first), np.maximum.reduceat(own[order], first)
                pick = order[first]
                begin, size, content = begin[pick], size[pick], content[pick]
                shard = (route[pick] >> np.uint64(20)) % np.uint64(shards)
                order, first = _groups(shard)
                named = words.names[words.codes].tolist() if len(begin) else []
                for group in np.split(order, first[1:]):
                    lines = "\n".join(" ".join(named[b : b + s]) for b, s in zip(begin[group].tolist(), size[group].tolist()))
                    yield pa.RecordBatch.from_pydict({
                        "shard": [int(shard[group[0]])], "slice": [number.as_py()], "content": [content[group].tobytes()],
                        "low": [low[group].tobytes()], "high": [high[group].tobytes()], "lines": [pack(lines.encode())],
                    })

    return run


def _first_documents(window: int):
    def run(table: pa.Table) -> pa.Table:
        """Index one shard's distinct passages, stream them through it, and answer each slice."""
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        blobs = table.column("content").to_pylist()
        low, high = _arrays(table.column("low").to_pylist(), "<i8"), _arrays(table.column("high").to_pylist(), "<i8")
        lines = [line for blob in table.column("lines").to_pylist() for line in unpack(blob).split(b"\n")]
        _, pick, back = np.unique(_arrays(blobs, "<u8"), return_index=True, return_inverse=True)
        passage = [lines[i].split(b" ") for i in pick.tolist()]
        size = np.fromiter(map(len, passage), np.int64, len(passage))
        code = pa.array([w for line in passage for w in line], pa.binary()).dictionary_encode().indices
        code = code.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        least = np.full(len(pick), LAST_ID)
        np.minimum.at(least, back, low)
        #: Indexed text: every passage and a separator behind it.
        begin = np.cumsum(size + 1) - size - 1
        text = np.zeros(int((size + 1).sum()), np.int64)
        text[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(code))] = code
        index = FMIndex(text, window)
        owner = np.repeat(least, size + 1)[index.order]
        group = index.starts[window][:-1]
        group_first = np.minimum.reduceat(owner, group)
        windows = size - window + 1
        slot = np.cumsum(windows) - windows
        answer = np.full(int(windows.sum()), LAST_ID)
        for lane, at, length, lo, _ in index.matching_statistics(text, begin, size):
            whole = length == window
            answer[slot[lane[whole]] + at[whole]] = group_first[np.searchsorted(group, lo[whole], "right") - 1]
        #: A passage is worth telling if a window of it begins before the slice's last document with it.
        earliest = np.minimum.reduceat(answer, slot)
        useful = earliest[back] < high
        cut = np.cumsum([0, *(len(b) // 8 for b in blobs)])
        out = {"slice": table.column("slice"), "content": [], "windows": [], "first": []}
        contents = _arrays(blobs, "<u8")
        for a, b in zip(cut, cut[1:]):
            mine = np.flatnonzero(useful[a:b]) + a
            p = back[mine]
            n = windows[p]
            where = np.repeat(slot[p] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            out["content"].append(contents[mine].tobytes())
            out["windows"].append(n.astype(np.int32).tobytes())
            out["first"].append(answer[where].tobytes())
        return pa.table(out, pa.schema([("slice", pa.int64()), ("content", pa.binary()), ("windows", pa.binary()), ("first", pa.binary())]))

    return run


def _kept_rows(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, contents, counts, firsts in zip(*(batch.column(i) for i in range(1, 5))):
                docs = _opened(body.as_buffer())
                words = _Words(_texts(docs))
                n = len(words.codes)
                gone = np.zeros(n, bool)
                content = _arrays(contents.as_py() or [], "<u8")
                if len(content):
                    gone = _covered(words, window, _doc_ids(docs), content, _arrays(counts.as_py(), "<i4").astype(np.int64), _arrays(firsts.as_py(), "<i8"))
                removed = np.r_[0, np.cumsum(gone)][words.ends]
                named = words.names[words.codes].tolist()
                kept = []
                for lo, hi, r in zip(words.ends[:-1].tolist(), words.ends[1:].tolist(), np.diff(removed).tolist()):
                    mine = named[lo:hi]
                    if r:
                        mine = [w for w, g in zip(mine, gone[lo:hi].tolist()) if not g]
                    kept.append(" ".join(mine))
                yield pa.RecordBatch.from_arrays(
                    [*docs.columns, pa.array(np.diff(words.ends)), pa.array(np.diff(removed)), pa.array(kept, pa.string())],
                    names=[*docs.schema.names, "n_words", "n_removed", "kept_text"],
                )

    return run


def _covered(words: _Words, window: int, ids: np.ndarray, content: np.ndarray, count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words a window covers whose first document is smaller than the word's own."""
    p = _Passages(words, window)
    order = np.argsort(content)
    content, count, start = content[order], count[order], (np.cumsum(count) - count)[order]

    def marks(begin: np.ndarray, windows: np.ndarray) -> np.ndarray:
        key = p.hash(begin, windows + window - 1)
        at = np.searchsorted(content, key).clip(0, len(content) - 1)
        hit = np.flatnonzero(content[at] == key)
        b, at = begin[hit], at[hit]
        n = count[at]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(b, n) + inner
        return place[first[np.repeat(start[at], n) + inner] < ids[p.doc[place]]]

    every = np.flatnonzero(p.real)  # windows told one by one (split anchors) as well as passages
    starts = np.r_[marks(p.begin, p.windows), marks(every, np.ones(len(every), np.int64))]
    edge = np.zeros(len(words.codes) + 1, np.int64)
    starts = np.unique(starts)
    edge[starts] += 1
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge)[:-1] > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """Adds (n_words, n_removed, kept_text) to ``docs``, one row per input row.

    Words are the runs between ASCII white space.  A word goes if a window that covers it also starts in a document
    with a smaller ``doc_id``; windows are judged on the input.  ``kept_text``: the kept words joined by one space
    (all of them where nothing is removed).  Null texts have no words; null ids stand behind all others and never
    remove anything from each other; rows that share an id never remove each other's words; documents shorter than
    a window stay whole; an empty table stays empty.  Other columns pass through; the three added names replace
    input columns of the same names.
    """
    ship_package(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "kept_text").withColumn("text", F.col("text").cast("string"))
    slices = corpus_slices(docs)
    total = slices.agg(F.sum("bytes")).first()[0] or 0
    buckets = 1 + total // BUCKET_BYTES
    anchors = slices.select("slice", "body").mapInArrow(
        _anchor_rows(window, buckets), "bucket long, slice long, anchors binary, low binary, high binary, passages binary"
    )
    shared = written(
        anchors.groupBy("bucket").applyInArrow(lambda t: _shared_anchors(t), "slice long, passages long, anchors binary, wide binary")
        .filter("passages > 0"),
        "shared-anchors",
    )
    shards = 1 + (shared.agg(F.sum("passages")).first()[0] or 0) // SHARD_PASSAGES
    told = shared.groupBy("slice").agg(F.collect_list(F.struct("anchors", "wide")).alias("told")).select(
        F.col("slice").alias("told_slice"), F.col("told.anchors").alias("anchors"), F.col("told.wide").alias("wide")
    )
    passages = (
        slices.join(told, F.col("slice") == F.col("told_slice")).select("slice", "body", "anchors", "wide")
        .mapInArrow(_passage_rows(window, shards), "shard long, slice long, content binary, low binary, high binary, lines binary")
    )
    firsts = written(
        passages.groupBy("shard").applyInArrow(_first_documents(window), "slice long, content binary, windows binary, first binary")
        .filter(F.length("content") > 0),
        "first-documents",
    )
    drop_written(shared)
    answers = firsts.groupBy("slice").agg(F.collect_list(F.struct("content", "windows", "first")).alias("a")).select(
        F.col("slice").alias("a_slice"), F.col("a.content").alias("content"), F.col("a.windows").alias("windows"), F.col("a.first").alias("first")
    )
    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return (
        slices.join(answers, F.col("slice") == F.col("a_slice"), "left").select("slice", "body", "content", "windows", "first")
        .mapInArrow(_kept_rows(window), f"{fields}, n_words long, n_removed long, kept_text string")
    )
