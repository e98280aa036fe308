import hashlib
import random
import zlib

from flowlens.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, at long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """(root, for each node its siblings with their sides, from below)."""
    under, paths = [[i] for i in range(len(nodes))], [[] for _ in nodes]
    while len(nodes) > 1:
        up, up_under = [], []
        for i in range(0, len(nodes), 2):
            run = nodes[i : i + 2]
            for k in range(len(run)):
                for x in under[i + k]:
                    paths[x].append((run[:k], run[k + 1 :]))
            up.append(h(*run))
            up_under.append([x for u in under[i : i + 2] for x in u])
        nodes, under = up, up_under
    return nodes[0], paths


def brute(rows):
    if not rows:
        return []
    langs = {}
    for doc_id, text, lang, source, n_chars in rows:
        langs.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n_chars, text), (doc_id, source, lang, n_chars, text)))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        langs[lang].sort(key=lambda r: r[:3])
        trees[lang] = tree([r[2] for r in langs[lang]])
    root, above = tree([trees[x][0] for x in order])
    out = []
    for lang, high in zip(order, above):
        for (_, _, own, row), low in zip(langs[lang], trees[lang][1]):
            node = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                node = leaf(*row[:3], row[3] + 1, row[4])
            for left, right in low + high:
                node = h(*left, node, *right)
            out.append((row[0], own, trees[lang][0], root, h(*(s for a, b in low + high for s in a + b)), node, node == root))
    return sorted(out, key=str)


def run(spark, rows, levels):
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, manifest.merkle_manifest(df, levels).collect()), key=str)


def some_rows(n, langs):
    rnd = random.Random(n)
    return [
        (rnd.choice([i, i, i, None]), rnd.choice(["", "é words", None, "x" * 50_000]), rnd.choice(langs), rnd.choice(["src0", None]), rnd.choice([5, None, -1]))
        for i in range(n)
    ]


def test_matches_brute_force_in_small_subtrees(spark):
    rows = some_rows(300, ["en", "en", "de", None, ""]) + [(7, "one", "zz", "s", 1)] + [(8, "same", "en", "s", 2)] * 40 + [(2**63 - 1, "a", "é", "s", 2**63 - 1)]
    got = run(spark, rows, 2)
    assert got == brute(rows) and {r[-1] for r in got} == {True, False}


def test_many_languages(spark):
    rows = [(i, str(i), f"l{i % 37}", "s", i) for i in range(200)]
    assert run(spark, rows, 3) == brute(rows)


def test_lone_leaf_and_empty(spark):
    one = [(1, "only", "en", "s", 4)]
    assert run(spark, one, manifest.LEVELS) == brute(one)
    assert run(spark, [], manifest.LEVELS) == []
