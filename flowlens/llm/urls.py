"""URL filters: written rules first, then association rules that Spark's FP-growth mines from labelled URLs.

1. A URL becomes items, one for each of a fixed number of places (scheme, end of the host, site, first label, first two
   path parts, ending, query, fragment).  A place has one value, so the item sets of a URL are bounded however long it is.
2. FP-growth mines the distinct labelled URLs, each with one more item for its label.  Rules that lead to a label are
   kept by confidence, support and lift; a rule goes if a part of its items is as sure of the same label.
3. The rules' inverted index (item -> rule) meets the items of the distinct item lists; a rule fires where all its items
   met.  Of those that fire the surest counts.

Only DataFrame functions and the library's miner run here: no Python code in tasks.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import shuffle_width, written

#: (rule, verdict): host and all its subdomains, paths that start alike; the longest that fits wins.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Share of the distinct labelled URLs that a rule's items and label hold at least; it bounds the rules, see mined_rules.
MIN_SUPPORT = 0.001
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"


def host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """From behind the host to the next ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def fitting_rule(rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """Over columns ``host`` and ``path``: the longest rule that fits (ties: the first), or null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])) :
        name, slash, rest = rule.partition("/")
        fits = ((F.col("host") == name) | F.endswith(F.col("host"), F.lit("." + name))) & F.startswith(F.col("path"), F.lit(slash + rest))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def url_items(url: Column, host_: Column, path_: Column) -> Column:
    """The sorted items of a URL, at most one for each place."""
    labels = F.split(host_, r"\.")
    parts = F.filter(F.split(path_, "/"), lambda x: x != "")
    behind = F.substring(_rest(url), F.length(host_) + F.length(path_) + 1, F.length(url))
    fragment = F.instr(behind, "#")
    query = F.when(fragment > 0, F.substring(behind, F.lit(1), fragment - 1)).otherwise(behind)
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))

    def item(place: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(place + "="), value))

    places = [
        item("scheme", F.when(F.instr(url, "://") > 0, F.translate(F.substring_index(url, "://", 1), UPPER, LOWER))),
        item("end", F.element_at(labels, -1)),
        item("site", F.when(F.size(labels) > 1, F.concat_ws(".", F.slice(labels, -2, 2)))),
        item("host", F.when(F.size(labels) > 2, F.element_at(labels, 1))),
        item("word", F.when(F.size(labels) > 2, F.try_element_at(labels, F.lit(-3)))),
        item("path1", F.try_element_at(parts, F.lit(1))),
        item("path2", F.try_element_at(parts, F.lit(2))),
        item("ending", F.regexp_extract(last, r"\.([A-Za-z0-9]+)$", 1)),
        item("query", F.regexp_extract(query, r"^\?([^=&]*)", 1)),
        item("fragment", F.when(fragment > 0, "yes")),
    ]
    return F.array_sort(F.array_compact(F.array(*places)))


def with_items(urls: DataFrame) -> DataFrame:
    """Adds ``items`` to a table with ``url``, ``host`` and ``path``."""
    return urls.withColumn("items", url_items(F.coalesce("url", F.lit("")), F.col("host"), F.col("path")))


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """``labelled(url, bad)`` -> written rules ``(rule_id, items, verdict, confidence, support)``.

    Each distinct URL counts once (bad, if any of its rows is); null urls and labels take no part, no labelled URLs give
    no rules.  Frequent items are at most (places + 1) / min_support, and each URL has at most 2^places item sets, so the
    rules are bounded by the parameters and do not grow with the table.
    """
    spark = labelled.sparkSession
    once = labelled.select(F.col("url").cast("string").alias("url"), F.col("bad").cast("boolean").alias("bad")).dropna()
    once = once.groupBy("url").agg(F.max("bad").alias("bad"))
    once = with_items(once.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}))
    label = F.concat(F.lit("verdict:"), F.when(F.col("bad"), BLOCK).otherwise(ALLOW))
    baskets = written(once.select(F.array_append("items", label).alias("items")), "url-baskets")
    schema = "rule_id long, items array<string>, verdict string, confidence double, support double"
    if baskets.isEmpty():
        return spark.createDataFrame([], schema)
    miner = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=shuffle_width(spark))
    rules = miner.fit(baskets).associationRules.filter(F.startswith(F.col("consequent")[0], F.lit("verdict:")) & (F.col("lift") >= min_lift))
    rules = written(rules.select(
        F.array_sort("antecedent").alias("items"), F.substring_index(F.col("consequent")[0], ":", -1).alias("verdict"), "confidence", "support"
    ), "url-rules")
    return written(_needed(rules).withColumn("rule_id", F.xxhash64("items", "verdict")).select("rule_id", "items", "verdict", "confidence", "support"), "url-needed-rules")


def _needed(rules: DataFrame) -> DataFrame:
    """Without the rules of which some of the items alone say the same at least as surely.

    Each rule looks its own smaller item sets up (at most 2^places of them), so no pairs of rules are formed.
    """
    def subsets(items: Column) -> Column:
        return F.aggregate(
            items, F.array(F.array().cast("array<string>")), lambda sets, x: F.concat(sets, F.transform(sets, lambda s: F.array_append(s, x)))
        )

    parts = rules.select(
        F.col("items").alias("whole"), F.col("verdict").alias("p_verdict"), F.col("confidence").alias("whole_confidence"),
        F.explode(subsets(F.col("items"))).alias("part"),
    ).filter("size(part) > 0 and size(part) < size(whole)")
    beaten = parts.join(
        rules, (F.col("part") == F.col("items")) & (F.col("p_verdict") == F.col("verdict")) & (F.col("confidence") >= F.col("whole_confidence"))
    ).select(F.col("whole").alias("b_items"), F.col("p_verdict").alias("b_verdict")).distinct()
    return rules.join(beaten, (F.col("items") == F.col("b_items")) & (F.col("verdict") == F.col("b_verdict")), "left_anti")


def matched_rules(baskets: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``items`` lists -> ``(items, verdict)`` of the surest rule that fires; lists without one are left out.

    Ties: more support, more items, block before allow, then the smaller rule id.
    """
    index = rules.select(F.explode("items").alias("item"), "rule_id", F.size("items").alias("n_items"), "verdict", "confidence", "support")
    entries = baskets.select("items", F.explode("items").alias("b_item"))
    met = entries.join(index, F.col("b_item") == F.col("item"))
    fired = met.groupBy("items", "rule_id", "n_items", "verdict", "confidence", "support").agg(F.count("*").alias("n")).filter("n = n_items")
    order = F.struct(-F.col("confidence"), -F.col("support"), -F.col("n_items"), F.col("verdict") == ALLOW, "rule_id", "verdict")
    return fired.groupBy("items").agg(F.min(order).getField("verdict").alias("mined"))


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, **mining) -> DataFrame:
    """``pages(page_id, url)`` -> ``(page_id, host, path, rule, verdict, mined)``, one row for each row.

    ``rule`` is the longest written rule that fits, else null; ``verdict`` is its verdict, else that of the surest mined
    rule (``mined``), else allow.  A null url, or one without ``://``, has an empty host and path and is judged by what
    items it has.  Rows that repeat are rows of their own, null ids stay, other columns are ignored, an empty table
    gives an empty result.  Hot URLs are judged once: rows meet the verdict by their list of items, in few values.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.withColumns({"host": host(F.coalesce("url", F.lit(""))), "path": path(F.coalesce("url", F.lit("")))})
    known = mined_rules(labelled, **mining)
    frequent = known.select(F.explode("items").alias("item")).distinct()
    rows = with_items(rows).withColumn("rule", fitting_rule(rules)).drop("url")
    said = F.lit(None).cast("string")
    for rule, verdict in rules:
        said = F.when(F.col("rule") == rule, verdict).otherwise(said)
    # Lists are compared by two 64-bit hashes of their items: the shuffles carry no long items.
    rows = rows.withColumns({"said": said, "list1": F.xxhash64("items"), "list2": F.xxhash64(F.lit(1), "items")})
    lists = rows.filter("said is null").groupBy("list1", "list2").agg(F.first("items").alias("all_items"))
    held = lists.select("list1", "list2", F.explode("all_items").alias("b_item")).join(frequent, F.col("b_item") == F.col("item"), "left_semi")
    held = held.groupBy("list1", "list2").agg(F.array_sort(F.collect_list("b_item")).alias("items"))
    held = written(held, "url-lists")
    judged = matched_rules(held.select("items").distinct(), known)
    verdicts = held.join(judged.withColumnRenamed("items", "j_items"), F.col("items") == F.col("j_items")).select(
        F.col("list1").alias("v1"), F.col("list2").alias("v2"), "mined"
    )
    verdicts = written(verdicts, "url-verdicts")
    out = rows.join(verdicts, (F.col("list1") == F.col("v1")) & (F.col("list2") == F.col("v2")) & F.col("said").isNull(), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", "mined", F.lit(ALLOW)).alias("verdict"), "mined")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``(url, bad)`` of the pages whose document has a label.

    A page's document is the number that is its path's last part (an ending may follow).  A document is bad if any of
    its labels says toxic or of no quality; null ids and labels take no part.
    """
    number = F.regexp_extract(path(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    urls = pages.select(F.col("url").cast("string").alias("url")).dropna().distinct()
    urls = urls.withColumn("number", F.when(number != "", number).cast("long")).dropna()
    bad = F.greatest(F.col("toxic") == 1, F.col("quality") == 0)
    marks = labels.select(F.col("doc_id").cast("long").alias("l_doc"), bad.alias("bad")).dropna().groupBy("l_doc").agg(F.max("bad").alias("bad"))
    return urls.join(marks, F.col("number") == F.col("l_doc")).select("url", "bad")
