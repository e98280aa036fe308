"""Set operations and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.exprs import c


def union_outer(dfs: list[DataFrame]) -> DataFrame:
    """Union of rows and of columns; absent columns are NULL; column order = first appearance."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def feature_map(props: str = "props") -> "F.Column":
    """JSON object text -> ``map<string,double>``."""
    return F.from_json(c(props), "map<string,double>")


def explode_map(df: DataFrame, key_cols: list[str], map_col: str) -> DataFrame:
    return df.select(*key_cols, F.explode(c(map_col)).alias("key", "value"))


def to_json_record(df: DataFrame, cols: list[str], name: str = "json") -> DataFrame:
    """Nested record -> JSON text (metrics sink format)."""
    return df.select(F.to_json(F.struct(*[c(n) for n in cols])).alias(name))


def from_json_record(df: DataFrame, schema: str, col: str = "json") -> DataFrame:
    return df.select(F.from_json(c(col), schema).alias("r")).select("r.*")


def report_lines(df: DataFrame, section: str, order_col: str, fmt: str, cols: list[str]) -> DataFrame:
    """Plain-text report rows ``(section, ord, line)`` from a result table (the numbers, not the prose)."""
    return df.select(
        F.lit(section).alias("section"),
        F.col(order_col).cast("bigint").alias("ord"),
        F.format_string(fmt, *[c(n) for n in cols]).alias("line"),
    )
