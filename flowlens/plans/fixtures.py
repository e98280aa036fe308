"""Deterministic views over the driver's tables that stand in for flow data.

Each view exists twice: as a DataFrame (what the engine runs) and as SQL text
(what the DuckDB oracle runs).  Both are derived from the given tables only, so
the work of every query grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.sources.tables import read_table

LABEL = "label"
FEATURES = [
    "destination_port",
    "flow_duration",
    "flow_bytes_s",
    "down_up_ratio",
    "fwd_iat_std",
    "avg_packet_size",
    "bwd_psh_flags",
    "syn_flag_count",
]
# The constant column of the view, dropped by the cleaning step.
FLOWS_CONSTANT = ["bwd_psh_flags"]
CLEAN_FEATURES = [f for f in FEATURES if f not in FLOWS_CONSTANT]


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled flow rows over ``lineitem`` with raw labels, NaN, +/-Inf, NULL and duplicates."""
    li = read_table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    label = (
        F.when(k % 997 == 0, F.lit(" Heartbleed"))
        .when(k % 499 == 0, F.lit("infiltration"))
        .when(k % 211 == 0, F.lit(None).cast("string"))
        .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), F.lit(" BENIGN "))
        .when(F.col("l_returnflag") == "A", F.lit("Benign"))
        .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), F.lit("DoS  Hulk"))
        .when(F.col("l_returnflag") == "N", F.lit("Web Attack - XSS"))
        .when(F.col("l_linestatus") == "F", F.lit("portscan"))
        .otherwise(F.lit("Botnet"))
    )
    zero_tax = F.col("l_tax") == 0
    ln = F.col("l_linenumber")
    bytes_s = (
        F.when((ln == 7) & zero_tax, F.lit(float("inf")))
        .when((ln == 6) & zero_tax, F.lit(float("-inf")))
        .when((ln == 5) & zero_tax, F.lit(float("nan")))
        .otherwise(F.col("l_extendedprice"))
    )
    base = li.select(
        label.alias(LABEL),
        (F.col("l_partkey") % 1024).cast("double").alias("destination_port"),
        F.col("l_quantity").alias("flow_duration"),
        bytes_s.alias("flow_bytes_s"),
        F.when(~((ln == 4) & zero_tax), F.col("l_discount")).alias("down_up_ratio"),
        F.col("l_tax").alias("fwd_iat_std"),
        (F.col("l_quantity") * 2.0 + F.col("l_tax")).alias("avg_packet_size"),
        F.lit(0.0).alias("bwd_psh_flags"),
        (F.col("l_suppkey") % 2).cast("double").alias("syn_flag_count"),
    )
    dups = li.filter(k % 97 == 0).select(
        F.lit("BENIGN").alias(LABEL),
        F.lit(80.0).alias("destination_port"),
        F.lit(1.0).alias("flow_duration"),
        F.lit(10.0).alias("flow_bytes_s"),
        F.lit(0.5).alias("down_up_ratio"),
        F.lit(0.0).alias("fwd_iat_std"),
        F.lit(2.0).alias("avg_packet_size"),
        F.lit(0.0).alias("bwd_psh_flags"),
        F.lit(1.0).alias("syn_flag_count"),
    )
    return base.unionByName(dups)


FLOWS_SQL = """
SELECT
  CASE WHEN l_orderkey % 997 = 0 THEN ' Heartbleed'
       WHEN l_orderkey % 499 = 0 THEN 'infiltration'
       WHEN l_orderkey % 211 = 0 THEN CAST(NULL AS VARCHAR)
       WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN ' BENIGN '
       WHEN l_returnflag = 'A' THEN 'Benign'
       WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'DoS  Hulk'
       WHEN l_returnflag = 'N' THEN 'Web Attack - XSS'
       WHEN l_linestatus = 'F' THEN 'portscan'
       ELSE 'Botnet' END                         AS label,
  CAST(l_partkey % 1024 AS DOUBLE)               AS destination_port,
  l_quantity                                     AS flow_duration,
  CASE WHEN l_linenumber = 7 AND l_tax = 0 THEN CAST('Infinity' AS DOUBLE)
       WHEN l_linenumber = 6 AND l_tax = 0 THEN CAST('-Infinity' AS DOUBLE)
       WHEN l_linenumber = 5 AND l_tax = 0 THEN CAST('NaN' AS DOUBLE)
       ELSE l_extendedprice END                  AS flow_bytes_s,
  CASE WHEN l_linenumber = 4 AND l_tax = 0 THEN NULL ELSE l_discount END AS down_up_ratio,
  l_tax                                          AS fwd_iat_std,
  l_quantity * 2.0 + l_tax                       AS avg_packet_size,
  CAST(0 AS DOUBLE)                              AS bwd_psh_flags,
  CAST(l_suppkey % 2 AS DOUBLE)                  AS syn_flag_count
FROM lineitem
UNION ALL
SELECT 'BENIGN', 80.0::DOUBLE, 1.0::DOUBLE, 10.0::DOUBLE, 0.5::DOUBLE, 0.0::DOUBLE, 2.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE
FROM lineitem WHERE l_orderkey % 97 = 0
"""
