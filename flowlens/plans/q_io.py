"""Registered queries: CSV sources and sinks, split table, metrics JSON, streaming scoring.

Inputs are written from the driver's tables into the shared scratch folder
first (the "raw" flow files), then read back through the source operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.plans.fixtures import CLEAN_FEATURES, FEATURES, LABEL, flows
from flowlens.plans.q_eval import LONG_METRICS_SQL
from flowlens.plans.q_score import sql as scored_sql
from flowlens.plans.registry import ORACLE, register
from flowlens.plans.sqltext import with_clean, with_prepared
from flowlens.plans.stages import resettable
from flowlens.session import scratch_dir
from flowlens.sources import csv as CSV

# Raw headers as a flow exporter writes them: stray and doubled spaces.
RAW_NAMES = {LABEL: " Label", "destination_port": " Destination  Port", "flow_duration": "Flow Duration ", "flow_bytes_s": "Flow Bytes/s"}
_RAW: dict = resettable({})


def raw_flow_dir(spark: SparkSession, sf_dir: str) -> str:
    """Flows written as CSV: part files with the full header plus a folder whose files lack two columns."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RAW:
        base = scratch_dir(spark, "raw-flows")
        df = flows(spark, sf_dir).withColumn("_part", F.col("destination_port") % 4)
        full = df.filter(F.col("_part") != 3).drop("_part")
        narrow = df.filter(F.col("_part") == 3).drop("_part", "syn_flag_count", "bwd_psh_flags")
        ren = lambda d: d.select(*[F.col(n).alias(RAW_NAMES.get(n, n)) for n in d.columns])
        for part, folder in ((full, "monday"), (narrow, "tuesday")):
            ren(part).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{base}/{folder}")
        _RAW[key] = base
    return _RAW[key]


@register("src_discover")
def q_src_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = CSV.src_discover(spark, raw_flow_dir(spark, sf_dir), recursive=True)
    return spark.createDataFrame([(p.rsplit("/", 1)[-1],) for p in files], "file string")


#: Columns under their standard names; the files of one folder lack two of them.
_STANDARD = {n: " ".join(RAW_NAMES.get(n, n).split()) for n in [LABEL] + FEATURES}


def _raw_sql(source: str, label: str) -> str:
    cols = [f'{label} AS "{_STANDARD[LABEL]}"']
    for f in FEATURES:
        value = f"CASE WHEN isnan({f}) THEN NULL ELSE {f} END"
        if f in ("syn_flag_count", "bwd_psh_flags"):
            value = f"CASE WHEN destination_port % 4 = 3 THEN NULL ELSE {value} END"
        cols.append(f'{value} AS "{_STANDARD[f]}"')
    return with_clean(f"SELECT {', '.join(cols)} FROM {source}")


@register("src_csv", _raw_sql("flows_in", LABEL))
def q_src_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw files: standard headers, typed columns, labels normalised, union by name."""
    return CSV.read_flow_files(spark, raw_flow_dir(spark, sf_dir), label_col="Label", strict=True, recursive=True)


@register("src_csv_positions")
def q_src_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's file and position in it: per file as many rows as positions, from 0 without gaps."""
    rows = CSV.read_flow_files(spark, raw_flow_dir(spark, sf_dir), label_col="Label", recursive=True, positions=True)
    return rows.groupBy("source_file").agg(F.count("*").alias("rows"), F.countDistinct("file_row").alias("positions"), F.min("file_row").alias("first"), F.max("file_row").alias("last"))


@register("src_upload_csv", _raw_sql("flows_raw", LABEL))
def q_src_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CSV.src_upload_csv(spark, CSV.src_discover(spark, raw_flow_dir(spark, sf_dir), recursive=True))


@register("src_csv_width_filter", _raw_sql("flows_raw", LABEL))
def q_src_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CSV.src_csv_width_filter(spark, CSV.src_discover(spark, raw_flow_dir(spark, sf_dir), recursive=True))


@register("src_splits", with_prepared("SELECT * FROM flows_enc WHERE split = 'test'"))
def q_src_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded split table written partitioned by split; reading 'test' prunes the other partitions."""
    from flowlens.plans.q_prepare import flows_enc

    path = scratch_dir(spark, "splits")
    CSV.sink_splits(flows_enc(spark, sf_dir), path)
    return CSV.src_splits(spark, path, "test")


@register("src_metrics_json", LONG_METRICS_SQL)
def q_src_metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written as JSON by the sink, read back; an absent optional file gives an empty frame."""
    from flowlens.plans.q_eval import long_metrics

    path = scratch_dir(spark, "metrics")
    CSV.sink_json(long_metrics(spark, sf_dir), path)
    schema = "model string, split string, metric string, value double"
    missing = CSV.src_metrics_json(spark, path + "-absent", schema, required=False)
    return CSV.src_metrics_json(spark, path, schema).unionByName(missing)


@register("sink_reports_csv", ORACLE["profile_labels"])
def q_sink_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small report table written as a single CSV and read back."""
    from flowlens.operators import quality as Q
    from flowlens.plans.q_quality import flows_in

    path = scratch_dir(spark, "report")
    CSV.sink_csv(Q.profile_labels(flows_in(spark, sf_dir), LABEL), path, single_file=True)
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def _streamed(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """All cleaned flows written as CSV files and streamed through the scorer: (predictions, summary)."""
    from flowlens.plans.q_eval import classes, rule_probability
    from flowlens.plans.q_quality import flows_clean
    from flowlens.streaming.score_stream import score_stream

    in_dir = scratch_dir(spark, "stream-in")
    flows_clean(spark, sf_dir).write.option("header", True).csv(in_dir)
    schema = T.StructType([T.StructField(LABEL, T.StringType())] + [T.StructField(f, T.DoubleType()) for f in CLEAN_FEATURES])
    return score_stream(spark, in_dir, schema, CLEAN_FEATURES, lambda x: rule_probability("A"), classes(spark, sf_dir))


@register("score_stream", scored_sql(f'SELECT prediction, confidence, {", ".join(CLEAN_FEATURES)} FROM preds JOIN tst USING ("row")'))
def q_score_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream files of all cleaned flows through the scorer; returns the streamed predictions."""
    return spark.read.parquet(_streamed(spark, sf_dir)[0]).select("prediction", "confidence", *CLEAN_FEATURES)


@register("score_stream_summary", ORACLE["prediction_summary"])
def q_score_stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running summary of the streamed predictions."""
    return spark.read.parquet(_streamed(spark, sf_dir)[1])


@register("sink_predictions_csv", ORACLE["score_batch"])
def q_sink_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of all cleaned flows exported as (row, prediction, confidence) CSV files and read back."""
    from flowlens.plans.q_score import predictions

    path = scratch_dir(spark, "predictions")
    CSV.sink_csv(predictions(spark, sf_dir).select("row", "prediction", "confidence"), path)
    return spark.read.option("header", True).schema("row long, prediction string, confidence double").csv(path)
