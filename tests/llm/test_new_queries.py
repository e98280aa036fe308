"""op11 to op13 as registered, over the given tables, against brute force."""

import duckdb

import test_manifest
import test_repair
import test_urls
from flowlens.llm import queries, urls

D = "/root/testdata/sf0.001"


def read(sql):
    return duckdb.sql(sql).fetchall()


def test_op11(spark):
    rows = read(f"SELECT doc_id, text, lang, source, n_chars FROM '{D}/documents.parquet'")
    got = queries.QUERIES["op11_merkle_manifest"](spark, D)
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == test_manifest.brute(rows)


def test_op12(spark):
    rows = dict(read(f"SELECT page_id, url FROM '{D}/pages.parquet'"))
    got = {r["page_id"]: r for r in queries.QUERIES["op12_association_url_filter"](spark, D).collect()}
    assert got.keys() == rows.keys()
    for i, url in rows.items():
        rule = test_urls.rule(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (*test_urls.parts(url), rule)
        assert got[i]["verdict"] == (dict(urls.RULES).get(rule) or got[i]["mined"] or "allow")


def test_op13(spark):
    rows = read(f"SELECT conv_id, turn, role, text FROM '{D}/conversations.parquet'")
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.QUERIES["op13_auction_repair"](spark, D).collect()}
    assert got == test_repair.brute(rows)
