import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from flowlens.llm.prefix_tokens import PrefixCounter, _tables, longest_fit, token_prefixes, tokens_at

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [
    " ", "  ", "\n", "\t", " \n ", "\x1c", "\xa0", " ", "don't", "we're", "they'll", "I've", "'r", "'", "''s", "hello", "World",
    "123", "4567", "!!", "...", "é", "ñandú", "日本語", "🙂👍", "é", "<|endoftext|>", "<|endo", "x<|endoftext|>y", "tion", "a", "b", "-----",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_every_prefix_matches_the_library(library):
    rnd = random.Random(11)
    count = PrefixCounter(PATH)
    texts = ["".join(rnd.choice(PIECES) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(1, 14))) for _ in range(250)]
    for text, joined in zip(texts, _tables(pa.array(texts, pa.string()), count, 5, True)):
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]
        prefix = b"".join(joined.kept)
        assert [tokens_at(prefix, k) for k in range(1, len(text) + 1)] == want, repr(text)
        assert joined.tokens == want[-1] and joined.chars == len(text)
        fit = max([k for k, n in enumerate(want, 1) if n <= 5], default=0)
        assert joined.fit == fit == longest_fit(prefix, 5)


def test_query_rows(spark, library):
    rows = [(1, "Some words, and don't forget <|endoftext|> this  one.", "k"), (2, None, "k"), (3, "", "k"), (None, "x" * 9000, "k"),
            (5, " lead", "k"), (5, " lead", "k"), (6, "ab " * 60000, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["fit_chars"]) for r in token_prefixes(df, PATH, 1024, keep=False).collect()))
    want = []
    for i, text, _ in rows:
        text = text or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        fit = len(text)
        if n > 1024:
            fit = max(k for k in range(1, 12000) if k <= len(text) and len(library.encode(text[:k], add_special_tokens=False).ids) <= 1024) if i is None else 3 * 1024 - 1
        want.append((i or 0, len(text.encode()), n, fit))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert all(len(library.encode((t or "")[:f], add_special_tokens=False).ids) <= 1024 for (i, t, _), f in zip(rows, [dict((g[0], g[3]) for g in got)[i or 0] for i, _, _ in rows]))
    assert token_prefixes(df.limit(0), PATH).count() == 0
    kept = {r["doc_id"]: r for r in token_prefixes(df, PATH, 1024).collect()}
    assert tokens_at(kept[1]["prefix"], 10_000) == kept[1]["n_tokens"] and kept[2]["prefix"] == b""
