import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from flowlens.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length string, bin long, piece string"


def check(rows, got, length):
    library = Tokenizer.from_file(PATH)
    want = []
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, at, len(ids[at : at + length]), zlib.crc32(ids[at : at + length].tobytes())) for k, at in enumerate(range(0, len(ids), length))]
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= length
    whole = packing.best_fit(np.array([w[3] for w in want]), length)[2]
    return len(bins), len(whole)


def test_packs_gapless_and_tight(spark, monkeypatch):
    rnd = random.Random(5)
    words = ["Hello,", "world", "don't", "ÉTÉ", "naïve.", "x1y2", "<|endoftext|>", "İstanbul", "Σας", "日本", "éa", "\xa0b", "trash!", "ﬁn", "***"]
    rows = [(i, "".join(rnd.choice(words) + rnd.choice([" ", "\n", "  "]) for _ in range(rnd.choice([0, 1, 3, 20, 60, 200, 700])))) for i in range(400)]
    rows += [(900, None), (901, ""), (None, "a b"), (5, rows[5][1]), (902, " \t ")]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(6)
    bins, least = check(rows, packing.pack_documents(df, PATH, 256).collect(), 256)
    assert bins <= 1.02 * least + 2
    monkeypatch.setattr(packing, "CHUNK_ITEMS", 40)
    bins, least = check(rows, packing.pack_documents(df, PATH, 256).collect(), 256)
    assert bins <= 1.05 * least + 2
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def test_empty_words_after_the_cache_was_cleared(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    monkeypatch.setattr(packing, "_ENCODERS", {})
    library = Tokenizer.from_file(PATH)
    texts = ["one two three four five", "", " six", "seven\n", None, " \t ", "eight, nine. ten", "", "\none two"]
    for _ in range(2):
        got = list(packing.encoded_texts(pa.array(texts, pa.string()), PATH))
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(b, "<u4").tolist() for b in got] == want
    assert len(packing.encoder(PATH).kept) <= 3


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, used = packing.best_fit(np.array([7, 6, 3, 4, 1]), 10)
    assert used.tolist() == [10, 10, 1] and bins.tolist() == [0, 1, 0, 1, 2] and offsets.tolist() == [0, 0, 7, 6, 0]
