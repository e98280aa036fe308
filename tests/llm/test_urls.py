import re
from itertools import combinations

from flowlens.llm import urls

SCHEMA = "page_id long, url string, host string, rule string, items int"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(url):
    host, path = parts(url)
    best = None
    for r, _ in urls.RULES:
        name, rest = r.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(r) > len(best)):
            best = r
    return best


URLS = [
    "http://a.example.net/en/1", "http://EXAMPLE.net/en", "https://net/", "https://net", "http://xnet/", "http://b.org/fr/2?x=1#t",
    "http://example.com/de/", "http://example.com/de", "x://w.example.com/de/9#a?b", "http://exämple.ORG/fr/", "no scheme.net/", "", None,
    "://net/a", "http://?net/", "http:///net/", "http://a.net?x/", "http://a.net#/x", "http://h\n.net/\nb", "http://a://b.net/", "http://" + "a." * 500 + "net/" + "p/" * 20_000,
]


def run(spark, rows, labelled, **mining):
    df = spark.createDataFrame([(i, u, "h", "r", 3) for i, u in rows], SCHEMA).repartition(3)
    marks = spark.createDataFrame(labelled, "url string, bad boolean")
    return [tuple(r) for r in urls.filter_urls(df, marks, **mining).collect()]


def test_written_rules(spark):
    rows = [*enumerate(URLS), (None, "http://c.net/"), (1, "http://EXAMPLE.net/en")]
    got = run(spark, rows, [])
    said = dict(urls.RULES)
    want = [(i, *parts(u), rule(u), said.get(rule(u), "allow"), None) for i, u in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty(spark):
    assert run(spark, [], []) == []


def baskets(spark, names):
    df = spark.createDataFrame([(u,) for u in names], "url string")
    df = urls.with_items(df.withColumns({"host": urls.host(df.url), "path": urls.path(df.url)}))
    return {r["url"]: frozenset(r["items"]) for r in df.collect()}


def test_mined_rules_and_verdicts_equal_brute_force(spark):
    sites = ["casino.example.com", "m.casino.example.org", "blog.news.example.com", "news.example.org", "a.b.example.io"]
    names = [f"http{'s' * (i % 2)}://{sites[i % 5]}/{['en', 'fr', 'es'][i % 3]}/{i}{['', '.html', '?ref=x', '#top'][i % 4]}" for i in range(240)]
    bad = {u: ("casino" in u) != (i % 11 == 0) or (u.endswith("#top") and "/fr/" in u) for i, u in enumerate(names)}
    marks = [(u, b) for u, b in bad.items()] + [(names[0], False)] * 30 + [(None, True), (names[1], None)]
    items = baskets(spark, names)
    counts, hits = {}, {}
    for u in names:
        for n in range(1, len(items[u]) + 1):
            for s in combinations(sorted(items[u]), n):
                counts[s] = counts.get(s, 0) + 1
                hits[s] = hits.get(s, 0) + bad[u]
    share, known = sum(bad.values()) / len(names), {}
    for s, n in counts.items():
        for verdict, k, base in (("block", hits[s], share), ("allow", n - hits[s], 1 - share)):
            if k >= 0.05 * len(names) and k / n >= 0.8 and k / n / base >= 1.1:
                known[s, verdict] = (k / n, k)
    needed = {
        (s, v): c for (s, v), c in known.items()
        if not any(known.get((p, v), (0,))[0] >= c[0] for n in range(1, len(s)) for p in combinations(s, n))
    }
    mining = {"min_support": 0.05, "min_confidence": 0.8}
    found = urls.mined_rules(spark.createDataFrame(marks, "url string, bad boolean"), **mining).collect()
    assert {(tuple(r["items"]), r["verdict"]) for r in found} == set(needed) and needed
    got = {r[0]: r for r in run(spark, list(enumerate(names)), marks, **mining)}
    ids = {(tuple(r["items"]), r["verdict"]): r["rule_id"] for r in found}
    for i, u in enumerate(names):
        fired = [(-c[0], -c[1], -len(s), v == "allow", ids[s, v], v) for (s, v), c in needed.items() if set(s) <= items[u]]
        mined = min(fired)[-1] if fired and rule(u) is None else None
        assert got[i][3:] == (rule(u), dict(urls.RULES).get(rule(u)) or mined or "allow", mined)


def test_page_labels(spark):
    pages = spark.createDataFrame([("http://a/en/5.html",), ("http://a/en/5.html",), ("http://a/x",), (None,), ("http://a/6/",)], "url string")
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (6, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, urls.page_labels(pages, labels).collect())) == [("http://a/6/", False), ("http://a/en/5.html", True)]
