"""The registered queries: SQL equality where there is SQL, brute force on the given tables elsewhere."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowlens.llm import queries
from tests_llm_brute import simhash_rows

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{D}/documents.parquet'").fetchall()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got = queries.QUERIES[name](spark, D)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_op2_equals_library(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_prefix_token_counts"](spark, D).collect()}
    assert got.keys() == documents.keys()
    for i, text in documents.items():
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len(text.encode()), n, n > 1024)


def test_op6_takes(spark, documents):
    got = queries.QUERIES["op6_low_discrepancy_mix"](spark, D).collect()
    assert {r["doc_id"]: r["size"] for r in got} == {i: len(t.encode().split()) for i, t in documents.items()}
    taken = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[(r["source_size"], r["target"])] += r["taken"]
    assert all(abs(n - target) <= 1 for (_, target), n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(r["size"] for r in got)) < len(taken)


def test_op7_pieces(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = queries.QUERIES["op7_best_fit_packing"](spark, D).collect()
    want = []
    for i, text in documents.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    used = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used[r["sequence_id"]]
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 4096 and len(used) <= 1 + -(-sum(used.values()) // 4096)


def test_op9_rows(spark, documents):
    got = queries.QUERIES["op9_label_propagation_shards"](spark, D).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in documents.items())
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) <= set(range(24))


def test_op10_components(spark, documents):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op10_simhash_near_dedup"](spark, D).collect()}
    assert got == simhash_rows(list(documents.items()))


def test_op5_one_row_per_document(spark, documents):
    got = queries.QUERIES["op5_weak_label_quality"](spark, D).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(documents) and all(r["keep"] == (r["reject_score"] < 0.5) for r in got)
