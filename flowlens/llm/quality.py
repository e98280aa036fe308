"""Quality classifier from weak labels: overlapping heuristic labellers, expectation-maximisation, hashed linear scorer.

1. Labellers vote keep, reject or abstain on every document: six on junk (repetition, variety, symbols, marked words,
   capitals, function words) and three on toxic language (a seed list and two that use a word list learned from labelled rows).
2. The documents are counted by vote pattern.  For each of the two questions, expectation-maximisation on these counts
   estimates how often each labeller votes what on good and bad documents, and with it every pattern's posterior.
3. The posteriors of a bounded sample train a logistic scorer over hashed features (word beginnings and votes).
4. The scorer decides on every document.

Vote patterns, the learned word list and the weights have fixed upper sizes; nothing that grows with the corpus
reaches the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import ship_package, text_slices, written

#: At most about so many labelled rows teach the word list, and so many documents train the scorer (hash samples).
LABELLED_ROWS = 20_000
FIT_DOCUMENTS = 8_000
#: Word beginnings of these lengths enter the list if in at least MIN_ROWS toxic texts and RATIO times as frequent there.
BEGINNINGS, MIN_ROWS, RATIO, MOST_WORDS = (4, 5, 6, 7, 8), 5, 20.0, 2_000
#: Letters of a word that the scorer's features keep.
PREFIX = 5
FEATURES = 1 << 20
EPOCHS, RATE, DECAY = 8, 0.3, 1e-6
THRESHOLD = 0.5

#: Common function words of four languages, everyday English insults, characters stripped from words.
FUNCTION_WORDS = frozenset(
    "the of and in to a is that for with as was on by it from this be are or an at not have "
    "le la de et les des en un une que est pour dans qui par sur au du ce il "
    "der die das und den von zu mit ist im ein eine dem auf für nicht sich "
    "el los las del y una se por con para es su al lo como más".split()
)
INSULTS = frozenset("idiot moron stupid loser pathetic worthless disgusting scum trash clown".split())
STRIPPED = ".,;:!?\"'()[]{}*&%$#|<>-_=+/\\~`^@"
SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-")
CAPITALS = bytes(range(65, 91))
_MARKS = re.compile("[" + re.escape(SYMBOLS.decode().replace("!", "").replace("?", "")) + "]|[!?]{2}")

JUNK = ("repetition", "variety", "symbols", "marked_words", "capitals", "function_words")
TOXIC = ("insults", "list_share", "listed_words")
ABSTAIN, KEEP, REJECT = 0, 1, 2


@dataclass
class Model:
    """What fitting leaves behind; its size does not depend on the corpus."""

    lexicon: frozenset[str]
    votes: dict[str, np.ndarray]  # labeller -> P(keep, reject | good), P(keep, reject | bad)
    weights: np.ndarray
    bias: float


def _listed(word: str, lexicon: frozenset[str]) -> bool:
    return any(word[:k] in lexicon for k in BEGINNINGS if k <= len(word))


class _Documents:
    """Word statistics of some documents."""

    def __init__(self, texts: pa.Array, lexicon: frozenset[str] = frozenset()):
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        flat = split.flatten().dictionary_encode()
        names = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = split.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        real = np.fromiter(map(bool, names), bool, len(names))
        if not real.all():
            keep = real[codes]
            ends = np.r_[0, np.cumsum(keep)][ends]
            codes = codes[keep]
        self.texts, self.codes, self.ends = texts, codes, ends
        self.doc = np.repeat(np.arange(len(texts)), np.diff(ends))
        self.words = np.diff(ends)
        self.names = names
        self.whole = [w.strip(STRIPPED).lower() for w in names]
        self.begin = [w[:PREFIX] for w in self.whole]
        self.lexicon = lexicon

    def _count(self, hit: np.ndarray) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(hit)][self.ends])

    def _distinct(self, value: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Different values in each document, counted separately in each of its parts."""
        key = np.stack([self.doc, part, value])
        order = np.lexsort(key[::-1])
        key = key[:, order]
        fresh = np.ones(key.shape[1], bool)
        fresh[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        return np.bincount(key[0][fresh], minlength=len(self.words))

    def votes(self) -> np.ndarray:
        """One row per document, one column per labeller (JUNK, then TOXIC)."""
        n = np.maximum(1, self.words)
        place = np.arange(len(self.codes)) - self.ends[self.doc] if len(self.codes) else self.codes
        same = np.r_[False, (self.codes[1:] == self.codes[:-1]) & (self.doc[1:] == self.doc[:-1])][: len(self.codes)]
        repeated = self._count(same) / n
        variety = self._distinct(self.codes, place // 100) / n
        function = self._count(np.fromiter((w in FUNCTION_WORDS for w in self.whole), bool, len(self.whole))[self.codes]) / n
        raw = [b or b"" for b in self.texts.cast(pa.binary()).to_pylist()]
        size = np.maximum(1, np.fromiter(map(len, raw), np.int64, len(raw)))
        symbols = (size - np.fromiter((len(b.translate(None, SYMBOLS)) for b in raw), np.int64, len(raw))) / size
        capitals = (size - np.fromiter((len(b.translate(None, CAPITALS)) for b in raw), np.int64, len(raw))) / size
        marked = self._count(np.fromiter(map(bool, map(_MARKS.search, self.names)), bool, len(self.names))[self.codes]) / n
        insults = self._count(np.fromiter((w in INSULTS for w in self.whole), bool, len(self.whole))[self.codes])
        toxic = np.fromiter((_listed(w, self.lexicon) for w in self.whole), bool, len(self.whole))[self.codes]
        listed = self._count(toxic)
        pairs = np.unique(np.stack([self.doc, self.codes])[:, toxic], axis=1)
        entries = np.bincount(pairs[0], minlength=len(self.words))
        empty, brief = self.words == 0, self.words < 20

        def vote(reject, keep, abstain):
            return np.where(abstain, ABSTAIN, np.where(reject, REJECT, np.where(keep, KEEP, ABSTAIN)))

        return np.stack([
            vote(repeated > 0.15, repeated < 0.05, self.words < 5), vote(variety < 0.4, variety > 0.5, brief),
            vote(symbols > 0.03, symbols < 0.01, empty), vote(marked > 0.15, marked < 0.05, empty), vote(capitals > 0.2, capitals < 0.1, empty),
            vote(function < 0.1, function > 0.15, brief),
            vote(insults > 0, insults == 0, empty), vote(listed / n >= 0.004, listed == 0, empty), vote(entries >= 2, entries == 0, empty),
        ], axis=1).astype(np.uint8)

    def features(self, votes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hashed features of each document: its votes with value 1, its word beginnings with a joint norm of 1."""
        bucket = np.fromiter((zlib.crc32(b.encode()) % FEATURES for b in self.begin), np.int64, len(self.begin))
        cast = np.array([[zlib.crc32(f"vote {k} {v}".encode()) % FEATURES for v in range(3)] for k in range(votes.shape[1])])
        for d in range(len(self.words)):
            own = np.unique(bucket[self.codes[self.ends[d] : self.ends[d + 1]]])
            at = np.r_[cast[np.arange(votes.shape[1]), votes[d]], own]
            yield at, np.r_[np.ones(votes.shape[1]), np.full(len(own), 1 / np.sqrt(max(1, len(own))))]


def _text_rows(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def _share(column: str | Column, rows: int, most: int):
    """A hash sample of about ``most`` of ``rows`` rows."""
    return F.pmod(F.xxhash64(F.lit(5), column), F.lit(1 << 30)) < F.lit(int(min(1.0, most / max(1, rows)) * (1 << 30)))


def toxic_word_list(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> frozenset[str]:
    """Word beginnings typical of texts labelled toxic, from a hash sample of about ``rows`` labelled rows.

    Every different text counts once, however many rows hold it; it is toxic if one of them is labelled so.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).filter("label_id is not null and toxic is not null")
    sample = labels.filter(_share("label_id", labels.count(), rows)).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    #: Bounded by ``rows``: a few hundred kilobytes.
    known = _text_rows(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("toxic", "text")
    known = known.groupBy(F.sha2("text", 256).alias("same")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("toxic", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for part in text_slices(batches):
            found = (Counter(), Counter())
            words = _Documents(part.column(1))
            for d, toxic in enumerate(part.column(0).to_pylist()):
                own = set(words.codes[words.ends[d] : words.ends[d + 1]].tolist())
                found[toxic > 0].update({words.whole[c][:k] for c in own for k in BEGINNINGS if k <= len(words.whole[c])})
                found[toxic > 0]["\0"] += 1  # counts the texts
            names = sorted(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_pydict({"word": names, "clean": [found[0][w] for w in names], "toxic": [found[1][w] for w in names]},
                                             pa.schema([("word", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]))

    counts = written(known.mapInArrow(run, "word string, clean long, toxic long").groupBy("word").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "word-counts")
    total = counts.filter(F.col("word") == "\0").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return frozenset()
    odds = (F.col("toxic") / total["toxic"]) / ((F.col("clean") + 1) / total["clean"])
    picked = counts.filter((F.col("word") != "\0") & (F.col("toxic") >= MIN_ROWS) & (odds > RATIO))
    # a beginning says nothing new beside a shorter one: these go before the list is cut
    shorter = F.explode(F.filter(F.array(*[F.substring("word", 1, k) for k in BEGINNINGS]), lambda b: F.length(b) < F.length("word")))
    covered = picked.select("word", shorter.alias("shorter")).join(picked.select(F.col("word").alias("shorter")), "shorter", "left_semi")
    merged = picked.join(covered.select("word"), "word", "left_anti")
    return frozenset(r["word"] for r in merged.orderBy(odds.desc(), "word").limit(MOST_WORDS).collect())


def estimate_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: (tables of P(keep, reject | class) per labeller, P(bad | pattern)).

    Labellers are taken as independent given the class, and a vote withheld says nothing.  The labellers are built to
    reject seldom and for cause: the start believes every reject vote, and the prior expects few of them on good rows.
    """
    n = patterns.shape[1]
    spoken = patterns != ABSTAIN
    bad = np.where((patterns == REJECT).any(axis=1), 0.95, 0.02)
    prior = (0.02 * counts.sum() + 5) * np.array([[0.99, 0.01], [0.4, 0.6]])
    tables = np.empty((n, 2, 2))
    for _ in range(rounds):
        for j in range(n):
            for c, weight in enumerate((counts * (1 - bad), counts * bad)):
                tables[j, c] = np.bincount(patterns[:, j], weights=weight, minlength=3)[1:] + prior[c]
            tables[j] /= tables[j].sum(axis=1, keepdims=True)
        share = np.array([(counts * (1 - bad)).sum() + 1, (counts * bad).sum() + 1])
        log = np.log(share / share.sum())[None, :]
        for j in range(n):
            log = log + np.where(spoken[:, j : j + 1], np.log(tables[j][:, np.maximum(patterns[:, j], 1) - 1]).T, 0.0)
        after = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(after - bad).max(initial=0.0) < 1e-9:
            break
        bad = after
    return tables, bad


def _train(rows: list, seed: int = 5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adagrad; ``rows`` of (feature ids, values, target)."""
    weights, seen, bias, bias_seen = np.zeros(FEATURES), np.full(FEATURES, 1e-6), 0.0, 1e-6
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            at, x, y = rows[k]
            z = float(weights[at] @ x) + bias
            error = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y
            grad = error * x + DECAY * weights[at]
            seen[at] += grad * grad
            weights[at] -= RATE * grad / np.sqrt(seen[at])
            bias_seen += error * error
            bias -= RATE * error / np.sqrt(bias_seen)
    return weights.astype(np.float32), bias


def fit(docs: DataFrame, labels: DataFrame | None, fit_documents: int = FIT_DOCUMENTS) -> Model:
    """Fit labeller accuracies on all documents' votes and the scorer on about ``fit_documents`` of them."""
    ship_package(docs.sparkSession)
    lexicon = toxic_word_list(docs, labels) if labels is not None else frozenset()
    chosen = _share(F.coalesce(F.col("text").cast("string"), F.lit("")), docs.count(), fit_documents)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            words = _Documents(part.column(1), lexicon)
            votes = words.votes()
            picked = part.column(2).to_pylist()
            features = [(a.astype("<i4").tobytes(), x.astype("<f4").tobytes()) if p else (None, None) for p, (a, x) in zip(picked, words.features(votes))]
            yield pa.RecordBatch.from_pydict(
                {"pattern": ["".join(map(str, v)) for v in votes.tolist()], "at": [f[0] for f in features], "x": [f[1] for f in features]},
                pa.schema([("pattern", pa.string()), ("at", pa.binary()), ("x", pa.binary())]),
            )

    cast = written(_text_rows(docs, F.coalesce(chosen, F.lit(False)).alias("picked")).mapInArrow(run, "pattern string, at binary, x binary"), "votes")
    found = cast.groupBy("pattern").count().collect()  # at most 3 ** 9 patterns
    if not found:
        return Model(lexicon, {}, np.zeros(FEATURES, np.float32), -1.0)
    patterns = np.array([[int(c) for c in r["pattern"]] for r in found])
    counts = np.array([r["count"] for r in found], float)
    k = len(JUNK)
    junk_tables, junk = estimate_labellers(patterns[:, :k], counts)
    toxic_tables, toxic = estimate_labellers(patterns[:, k:], counts)
    bad = {r["pattern"]: 1 - (1 - a) * (1 - b) for r, a, b in zip(found, junk, toxic)}
    #: Texts are sampled by their hash and count once: neither null nor hot ids, nor copies, fill or empty the sample.
    sample = cast.filter("at is not null").dropDuplicates(["pattern", "at", "x"])
    rows = [(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["x"], "<f4").astype(float), bad[r["pattern"]])
            for r in sample.orderBy(F.xxhash64("at", "x"), "pattern", "at", "x").limit(2 * fit_documents).toLocalIterator()]
    weights, bias = _train(rows) if rows else (np.zeros(FEATURES, np.float32), -1.0)  # nothing learned: all are kept
    return Model(lexicon, dict(zip(JUNK + TOXIC, [*junk_tables, *toxic_tables])), weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds (reject_score, rejected) to ``docs``, one row per input row; input columns of these names are replaced.

    Null, empty and blank texts have no words for a labeller to judge: score 0, kept.
    """
    ship_package(docs.sparkSession)
    docs = docs.drop("reject_score", "rejected").withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one weight per hashed feature: 4 MB

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in text_slices(batches):
            words = _Documents(part.column(part.schema.get_field_index("text")), m.lexicon)
            z = np.array([float(m.weights[at] @ x) + m.bias for at, x in words.features(words.votes())])
            p = np.where(words.words == 0, 0.0, 1 / (1 + np.exp(-np.clip(z, -50, 50))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array(p >= THRESHOLD)], names=[*part.schema.names, "reject_score", "rejected"])

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{fields}, reject_score double, rejected boolean")


def classify(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Fit on ``docs`` (and ``labels(doc_id, toxic)``) and score them; an empty table stays empty."""
    return score(docs, fit(docs, labels))
