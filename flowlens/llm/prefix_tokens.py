"""Token counts of every prefix of a text, by dynamic programming over byte-pair encodings.

In a byte-pair encoding the last token of a string's encoding and the encoding of what stands before it
determine each other: token t ends the encoding of w[:i] exactly when t = w[i-len(t):i] and the pair (last token
of w[:i-len(t)], t) encodes to itself.  So one pass over a piece of text gives the exact token count of all its
prefixes.  A text's table joins its pieces' tables; truncation ("how many tokens has the text cut here?") and
budget questions ("where must I cut for 1024 tokens?") are then look-ups, with no second encoding.

A prefix is measured in characters.  The few places where a cut changes how the library splits words before it
(inside runs of white space, contractions and special strings) are computed for the cut itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import ship_package, text_slices

TOKEN_LIMIT = 1024
#: Chunks of text whose tables a Python worker keeps, and characters of one text that are joined at a time.
KEPT_CHUNKS = 400_000
JOIN_CHARS = 1 << 20
#: The byte-level split pattern of the public vocabulary, and its contractions of three characters.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The code points with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")

_COUNTERS: dict[str, PrefixCounter] = {}


def _starts(i: int, start: int, first: int = 0) -> tuple[int, ...]:
    """Where the last token of w[:i] may begin (from ``first`` on), if that of w[:i-1] begins at ``start``.

    That token longer by one byte, then shorter ones, then longer ones.
    """
    return (*range(max(start, first), i), *range(min(start, i) - 1, first - 1, -1))


#: The same for short words, made once.
STARTS = [[_starts(i, start) for start in range(max(i, 1))] for i in range(33)]


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies, inverted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PrefixCounter:
    """Prefix token counts under one byte-level BPE file of the `tokenizers` library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.ids = {to_bytes(t): i for t, i in vocab.items()}
        self.token = {i: t for t, i in self.ids.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = [(to_bytes(a), to_bytes(b)) for a, b in pairs]
        self.ranks = {p: r for r, p in enumerate(pairs)}
        #: How each token is made: (rank of its merge, left part, right part); single bytes are given.
        self.made = {i: (-1, i, i) for i in self.ids.values()}
        for r, (a, b) in enumerate(pairs):
            if self.made.get(self.ids[a + b], (0,))[0] < 0:
                self.made[self.ids[a + b]] = (r, self.ids[a], self.ids[b])
        self.id_ranks = {self.ids[a] << 20 | self.ids[b]: r for r, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words = regex.compile(SPLIT)
        self.blank_runs = regex.compile(r"\p{White_Space}{2,}")
        self.fits: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.short: dict[str, list[int]] = {}
        self._last: tuple[bytes, list[int], list[int]] = (b"", [], [])

    def _merge(self, word: bytes) -> list[bytes]:
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, a: int, b: int) -> bool:
        """Whether token b may follow token a (a = -1: begin) in an encoding.

        The two tokens' merges are undone, latest first; the pair is broken up if the tokens that face each
        other at some stage would have merged before the merge undone last (on equal ranks the left one goes first).
        """
        key = (a + 1) << 20 | b
        known = self.fits.get(key)
        if known is not None:
            return known
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        if a < 0:
            known = self._merge(self.token[b]) == [self.token[b]]
        elif not self._fit(-1, b):
            known = False
        else:
            made, ranks, limit = self.made, self.id_ranks, 1 << 30
            while known is None:
                if ranks.get(a << 20 | b, limit) < limit:
                    known = False
                else:
                    (ra, _, inner_a), (rb, inner_b, _) = made[a], made[b]
                    if ra > rb:
                        limit, a = ra, inner_a
                    elif rb >= 0:
                        limit, b = rb + 1, inner_b
                    else:
                        known = True
        self.fits[key] = known
        return known

    def byte_counts(self, word: bytes) -> list[int]:
        """Token counts of word[:1], word[:2], ... for one word of the split; shares the last call's common prefix."""
        before, counts, lasts = self._last
        k, m = 0, min(len(before), len(word))
        while k < m and before[k] == word[k]:
            k += 1
        del counts[k:], lasts[k:]
        ids, fits = self.ids, self.fits
        # one last token only passes the test, so the likely ones go first: see _starts
        start = k - len(self.token[lasts[-1]]) if k else 0
        for i in range(k + 1, len(word) + 1):
            for j in STARTS[i][start] if i < len(STARTS) else _starts(i, start, max(0, i - self.longest)):
                t = ids.get(word[j:i])
                if t is None:
                    continue
                a = lasts[j - 1] if j else -1
                ok = fits.get((a + 1) << 20 | t)
                if ok is None:
                    ok = self._fit(a, t)
                if ok:
                    counts.append(counts[j - 1] + 1 if j else 1)
                    lasts.append(t)
                    start = j
                    break
        self._last = (word, counts, lasts)
        return counts

    def word_counts(self, word: str) -> list[int]:
        """The same by characters."""
        known = self.short.get(word)
        if known is not None:
            return known[:]
        raw = word.encode()
        if len(word) <= 3:
            kept, self._last = self._last, (b"", [], [])
            counts = self.byte_counts(raw)[:]
            self._last = kept
        else:
            counts = self.byte_counts(raw)
        if len(raw) != len(word):
            counts = self._by_character(raw, counts)
        if len(word) <= 3 and len(self.short) < 100_000:
            self.short[word] = counts
        return counts[:]

    @staticmethod
    def _by_character(raw: bytes, counts: list[int]) -> list[int]:
        ends = [i for i in range(1, len(raw) + 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]
        return [counts[i - 1] for i in ends]

    def _plain(self, text: str) -> tuple[list[int], int]:
        """Counts of all prefixes of a text without special strings; where its last word begins."""
        out: list[int] = []
        base, last = 0, 0
        for m in self.words.finditer(text):
            word, last = m.group(), m.start()
            counts = self.word_counts(word)
            if word in LONG_CONTRACTIONS:
                counts[1] = self.word_counts("'")[-1] + self.word_counts(word[1])[-1]
            out += [base + c for c in counts] if base else counts
            base = out[-1]
        for m in self.blank_runs.finditer(text):
            base = out[m.start() - 1] if m.start() else 0
            out[m.start() : m.end()] = [base + c for c in self.word_counts(m.group())]
            # the run's own last character belongs to the next word in the whole text, but not in this prefix
        return out, last

    def prefix_counts(self, text: str) -> list[int]:
        """Token counts of text[:1], text[:2], ...; a text that is not empty."""
        if self.special is None:
            return self._plain(text)[0]
        out: list[int] = []
        at = 0
        for m in [*self.special.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            base = out[-1] if out else 0
            last = 0
            if part:
                counts, last = self._plain(part)
                total = self._whole(part) if m else 0
                out += [base + c for c in counts] if base else counts
            else:
                total = 0
            if m:
                tail = part[last:]
                head = base + (total - self._whole(tail) if part else 0)
                out += [head + self._plain(tail + m.group()[:k])[0][-1] for k in range(1, len(m.group()))]
                out.append(base + total + 1)
                at = m.end()
        return out

    def _whole(self, text: str) -> int:
        return sum(self.word_counts(w)[-1] for w in self.words.findall(text))

    def spaced(self, name: str) -> bytes | None:
        """Prefix counts of a space and ``name``, one byte for each; None if a count is over 255."""
        known = self.chunks.get(name)
        if known is None:
            if name.isalpha():
                counts = self.word_counts(" " + name)
            elif name[-1] in ",.;:!?" and name[:-1].isalpha():
                counts = [*(self.spaced(name[:-1]) or self.word_counts(" " + name[:-1]))]
                counts.append(counts[-1] + 1)
            else:
                counts = self.prefix_counts(" " + name)
            if len(counts) > 255 and max(counts) > 255:
                return None
            if len(self.chunks) >= KEPT_CHUNKS:
                self.chunks.clear()
            known = self.chunks[name] = bytes(counts)
        return known


def counter(path: str) -> PrefixCounter:
    """One counter for each file and Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


_CUT = re.compile(r"(?= \S)")


def chunks_of(text: str) -> list[str]:
    """Cut a text before each space that follows something and stands before a word: words never cross such cuts."""
    return [c for c in _CUT.split(text) if c]


class _Joined:
    """The prefix table of one text, made from its chunks' tables piece by piece."""

    def __init__(self, count: PrefixCounter, limit: int, keep: bool):
        self.count, self.limit, self.kept = count, limit, [] if keep else None
        self.chars = self.tokens = self.fit = 0
        self.blank, self.blank_base = "", 0  # the white space that ends the text so far, and the count before it

    def add(self, table: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> None:
        """Join chunks (no white space but the leading space) whose tables are table[start:start+size].

        ``least``: the smallest count in each chunk's table.  If the joined table isn't kept, only the last chunk
        that holds a prefix within the limit is expanded.
        """
        ends = table[starts + sizes - 1].astype(np.int64)
        before = self.tokens + np.cumsum(ends) - ends
        if self.kept is None:
            total = int(before[-1] + ends[-1])
            if total <= self.limit:
                self.fit = self.chars + int(sizes.sum())
            else:
                inside = np.flatnonzero(before + least <= self.limit)
                if len(inside):
                    k = int(inside[-1])
                    part = table[starts[k] : starts[k] + sizes[k]] + before[k]
                    self.fit = self.chars + int(sizes[:k].sum()) + int(np.flatnonzero(part <= self.limit)[-1]) + 1
            self.chars += int(sizes.sum())
            self.tokens = total
            return
        at = np.cumsum(sizes) - sizes
        part = table[np.repeat(starts - at, sizes) + np.arange(int(sizes.sum()))] + np.repeat(before, sizes)
        self._push(part, int(before[-1] + ends[-1]))

    def add_text(self, chunk: str) -> None:
        """Join one chunk that may follow or end with white space."""
        part = np.array(self.count.prefix_counts(chunk), np.int64) + self.tokens
        total = int(part[-1])
        if self.blank and chunk[0] == " ":
            part[0] = self.blank_base + self.count.word_counts(self.blank + " ")[-1]
        kept = chunk.rstrip(WHITE_SPACE)
        base = part[len(kept) - 1] if kept else self.tokens
        self.blank, self.blank_base = (chunk[len(kept):], int(base)) if len(kept) < len(chunk) else ("", 0)
        self._push(part, total)

    def _push(self, part: np.ndarray, tokens: int) -> None:
        if tokens <= self.limit:
            self.fit = self.chars + len(part)
        else:
            fits = np.flatnonzero(part <= self.limit)
            if len(fits):
                self.fit = self.chars + int(fits[-1]) + 1
        if self.kept is not None:
            self.kept.append(part.astype("<i4").tobytes())
        self.chars += len(part)
        self.tokens = tokens


def _tables(texts: pa.Array, count: PrefixCounter, limit: int, keep: bool) -> Iterator[_Joined]:
    """One joined table for each text."""
    split = pc.split_pattern(texts.cast(pa.large_string()), " ")
    flat = split.flatten().dictionary_encode()
    names = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = split.offsets.to_numpy()
    offsets = offsets - offsets[0]
    odd = np.fromiter((not s or s[0].isspace() or s[-1].isspace() for s in names), bool, len(names))
    tables = [b"" if o else count.chunks.get(s) for s, o in zip(names, odd.tolist())]
    for k in sorted((k for k, t in enumerate(tables) if t is None), key=names.__getitem__):
        tables[k] = count.spaced(names[k])
        if tables[k] is None:
            tables[k], odd[k] = b"", True
    odd_upto = np.r_[0, np.cumsum(odd[codes])] if len(codes) else np.zeros(1, np.int64)
    table = np.frombuffer(b"".join(tables), np.uint8)
    sizes = np.fromiter(map(len, tables), np.int64, len(tables))
    starts = np.cumsum(sizes) - sizes
    least = np.zeros(len(sizes), np.int64)
    filled = np.flatnonzero(sizes)
    if len(filled):
        least[filled] = np.minimum.reduceat(table, starts[filled])
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    for d in range(len(texts)):
        joined = _Joined(count, limit, keep)
        lo, hi = int(offsets[d]), int(offsets[d + 1])
        if not valid[d] or lo == hi:
            yield joined
            continue
        if odd_upto[hi] > odd_upto[lo]:
            for chunk in chunks_of(texts[d].as_py()):
                joined.add_text(chunk)
            yield joined
            continue
        joined.add_text(names[codes[lo]])
        rest = codes[lo + 1 : hi]
        if len(rest):
            s, n, small = starts[rest], sizes[rest], least[rest]
            cuts = np.flatnonzero(np.diff((np.cumsum(n) - 1) // JOIN_CHARS)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(rest)]):
                joined.add(table, s[a:b], n[a:b], small[a:b])
        yield joined


SCHEMA = "doc_id long, n_bytes long, n_tokens long, fit_chars long"


def token_prefixes(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT, keep: bool = True) -> DataFrame:
    """``documents`` -> ``(doc_id, n_bytes, n_tokens, fit_chars[, prefix])``, one row per input row.

    ``prefix`` (with ``keep``): token counts of the text's first 1, 2, ... characters, little-endian int32, for
    :func:`tokens_at` and :func:`longest_fit`.  ``fit_chars`` answers one budget at once: the most leading
    characters whose own encoding has at most ``limit`` tokens.  Counts are those of the `tokenizers` library
    for the file at ``path`` without added special tokens; special strings inside texts count as one token.
    Null texts are empty (no bytes, no tokens); rows that repeat and null ids are kept; other columns are
    ignored.  Texts are worked through in slices, so memory does not follow the longest text (but the
    ``prefix`` value itself does).
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for part in text_slices(batches):
            done = list(_tables(part.column(1), count, limit, keep))
            sizes = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
            columns = [part.column(0), sizes, pa.array([x.tokens for x in done], pa.int64()), pa.array([x.fit for x in done], pa.int64())]
            if keep:
                columns.append(pa.array([b"".join(x.kept) for x in done], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "fit_chars", "prefix"][: len(columns)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA + (", prefix binary" if keep else ""))


def tokens_at(prefix: bytes, chars: int) -> int:
    """Token count of a text's first ``chars`` characters, from its stored table."""
    counts = np.frombuffer(prefix, "<i4")
    return int(counts[min(chars, len(counts)) - 1]) if chars > 0 and len(counts) else 0


def longest_fit(prefix: bytes, budget: int) -> int:
    """Most leading characters that have at most ``budget`` tokens, from the stored table."""
    fits = np.flatnonzero(np.frombuffer(prefix, "<i4") <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0
