import random

import pytest

from flowlens.llm import substring
from flowlens.llm.substring import remove_repeats

SCHEMA = "doc_id long, text string, n_words string, slice long, body string"


def brute(rows, window):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            f = first.get(tuple(words[k : k + window]))
            if f is not None and (i is None or f < i):
                gone[k : k + window] = [True] * window
        out.append((i if i is not None else -1, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out)


def result(df, window):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_removed"], r["kept_text"]) for r in remove_repeats(df, window).collect())


@pytest.mark.parametrize("window, split, slice_bytes", [(13, 5_000, 4 << 20), (13, 3, 3000), (6, 1, 800)])
def test_matches_brute_force(spark, monkeypatch, window, split, slice_bytes):
    monkeypatch.setattr(substring, "SPLIT_PASSAGES", split)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(substring, "SHARD_PASSAGES", 150)
    monkeypatch.setattr(substring.text_slices, "__defaults__", (slice_bytes,))
    rnd = random.Random(window + split)
    vocab = [f"w{k}" for k in range(60)] + ["É", "日本", "it's", "\xa0", " x"]
    passage = [[rnd.choice(vocab) for _ in range(rnd.choice([5, 12, 13, 14, 40]))] for _ in range(12)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rnd.randint(0, 5)):
            words += rnd.choice(passage) if rnd.random() < 0.5 else [rnd.choice(vocab) for _ in range(rnd.randint(1, 30))]
        rows.append((i * 3 % 151, rnd.choice([" ", "\n", "  ", "\t"]).join(words) + rnd.choice(["", " "])))
    rows += [(500, None), (501, ""), (None, rows[3][1]), (None, " ".join(f"n{k}" for k in range(40))), (None, " ".join(f"n{k}" for k in range(40)))]
    rows += [(7, rows[0][1]), (600, "a " * 200), (601, "a " * 90), (602, rows[0][1])]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", 1, "b") for i, t in rows], SCHEMA).repartition(3)
    assert result(df, window) == brute(rows, window)


def test_empty_and_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert remove_repeats(df).count() == 0
    out = remove_repeats(spark.createDataFrame([(1, "a b", "x", 9, None)], SCHEMA))
    assert out.columns == ["doc_id", "text", "slice", "body", "n_words", "n_removed", "kept_text"]
    assert out.first()["slice"] == 9
