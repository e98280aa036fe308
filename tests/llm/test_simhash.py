import random

import numpy as np
from tests_llm_brute import simhash_rows

from flowlens.llm.simhash import simhash_components, trie_links

SCHEMA = "doc_id long, text string, fp string, node long, extra string"


def test_components_match_brute_force(spark):
    rnd = random.Random(3)
    vocab = [f"w{k}" for k in range(400)]
    base = [[rnd.choice(vocab) for _ in range(300)] for _ in range(6)]
    rows = []
    for i in range(120):
        words = list(base[i % 6])
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(300)] = rnd.choice(vocab)
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One"), (204, "one"), (205, "é ü Ab"), (206, rows[0][1])]
    df = spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], SCHEMA).repartition(5)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_components(df).collect()}
    assert got == simhash_rows(rows)


def test_empty_null_ids_and_repeats(spark):
    assert simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "zz yy xx ww vv")]
    df = spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], SCHEMA)
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash_components(df).collect())
    assert got == [(-1, -1), (-1, 7), (7, 7), (7, 7)]


def test_trie_links_equal_all_pairs():
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    keys = []
    for s in seeds:
        for _ in range(30):
            k = int(s)
            for bit in rng.choice(64, rng.integers(0, 5), replace=False):
                k ^= 1 << int(bit)
            keys.append(k)
    keys = np.unique(np.array(keys, np.uint64))

    def groups(pairs):
        root = {int(k): int(k) for k in keys}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in pairs:
            x, y = sorted((find(int(a)), find(int(b))))
            root[y] = x
        return {k: find(k) for k in root}

    near = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if (int(a) ^ int(b)).bit_count() <= 3]
    assert groups(zip(*trie_links(keys, None, 0, 0, 3))) == groups(near)
    a, b = keys[keys < 2**62], keys[(keys >= 2**62) & (keys < 2**63)]
    across = [(x, y) for x, y in near if (x < 2**62) and (2**62 <= y < 2**63)]
    assert groups(zip(*trie_links(a, b, 2, 1, 3))) == groups(across)
