"""CSV edges: discovery, header rules, typed ingest, uploads, and the small sinks.

Rules (SURVEY 1.4): headers are whitespace-normalised (S4) and duplicate names
become ``X``, ``X.1`` (S3); every cell is read as text and a column is numeric
when every non-empty cell casts to double (``Infinity``, ``inf``, ``NaN``
included, S2); NaN is missing (S1); a row wider than the header fails the file
(``strict=True``) or is counted and dropped; a shorter row is padded with
missing values; a file whose header or labels hold U+FFFD after a UTF-8 read is
re-read as ISO-8859-1.
"""

from __future__ import annotations

import csv
import io
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.session import scratch_dir

REPLACEMENT_CHAR = "�"
CORRUPT = "_corrupt_record"
FILE, FILE_ROW = "source_file", "file_row"


def src_discover(spark: SparkSession, raw_dir: str, pattern: str = "*.csv", recursive: bool = False) -> list[str]:
    """``*.csv`` files of one folder (with ``recursive``: and below) sorted by name; error if there is none."""
    try:
        reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
        files = reader.load(raw_dir).select("path").collect()
    except Exception as exc:  # PATH_NOT_FOUND
        raise FileNotFoundError(raw_dir) from exc
    paths = sorted((r["path"] for r in files), key=lambda p: p.rsplit("/", 1)[-1])
    if not paths:
        raise FileNotFoundError(f"no {pattern} files in {raw_dir}")
    return paths


def standard_header(names: list[str]) -> list[str]:
    """Collapse whitespace, then suffix repeats ``.1``, ``.2`` like the reference's reader."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for raw in names:
        name = " ".join(raw.split())
        if name in seen:
            seen[name] += 1
            cand = f"{name}.{seen[name]}"
            while cand in seen:
                seen[name] += 1
                cand = f"{name}.{seen[name]}"
            seen[cand] = 0
            out.append(cand)
        else:
            seen[name] = 0
            out.append(name)
    return out


def _headers(spark: SparkSession, paths: list[str], encoding: str) -> dict[str, list[str]]:
    """First line of every file, in one job: the first row of the split that starts at byte 0."""
    lines = spark.read.option("encoding", encoding).option("lineSep", "\n").text(paths)
    first = (
        lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
        .filter("at = 0").groupBy("file").agg(F.min_by("value", "n").alias("value")).collect()
    )
    found = {r["file"]: next(csv.reader(io.StringIO(r["value"].rstrip("\r")))) for r in first}
    if len(found) < len(paths):
        raise ValueError(f"empty file among {sorted(p.rsplit('/', 1)[-1] for p in paths)}")
    return found


def _cells(line: Column) -> Column:
    """Number of cells of a raw CSV line: commas outside quotes, and one."""
    return F.regexp_count(F.regexp_replace(line, '"(?:[^"]|"")*"', ""), F.lit(",")) + 1


def _staged(spark: SparkSession, paths: list[str], names: list[str], encoding: str) -> DataFrame:
    """All files with one header as text cells (_c0, ...), the file, each row's number in it, and the raw line of odd rows.

    Parsed once into a written table: the later passes read columns from it instead of parsing text again, and
    queries on the corrupt-record column are allowed only over parsed results.
    """
    cells = [f"_c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*cells, CORRUPT]])
    parsed = (
        spark.read.option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE").option("escape", '"')
        .option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", True).schema(schema).csv(paths)
    )
    staged = scratch_dir(spark, "csv-stage")
    parsed.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_n")).write.parquet(staged)
    rows = spark.read.parquet(staged)
    # position in the file: rows before this split of the file, and the row's place in the split
    splits = rows.groupBy(FILE, "_at").agg(F.count("*").alias("_rows"), F.min("_n").alias("_first"))
    before = Window.partitionBy(FILE).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(F.col(FILE).alias("_f"), F.col("_at").alias("_a"), "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    # one row for each split of a file: broadcast, so the rows themselves are not shuffled
    return rows.join(F.broadcast(starts), (F.col(FILE) == F.col("_f")) & (F.col("_at") == F.col("_a"))).withColumn(
        FILE_ROW, F.col("_before") + F.col("_n") - F.col("_first")
    ).select(*cells, CORRUPT, FILE, FILE_ROW)


def _load(spark: SparkSession, paths: list[str], label_col: str, require: tuple[str, ...]) -> list[tuple[DataFrame, list[str], str]]:
    """Text frames by (header, encoding): (rows, names, encoding).  The number of jobs follows the number of headers."""
    def grouped(files: list[str], encoding: str) -> list[tuple[DataFrame, list[str], str]]:
        by_header: dict[tuple[str, ...], list[str]] = {}
        for file, raw in sorted(_headers(spark, files, encoding).items()):
            by_header.setdefault(tuple(standard_header(raw)), []).append(file)
        return [(_staged(spark, members, list(names), encoding), list(names), encoding) for names, members in by_header.items()]

    def files_of(rows: DataFrame) -> set[str]:
        return {r[FILE] for r in rows.select(FILE).distinct().collect()}

    out, garbled = [], set()
    for rows, names, encoding in grouped(paths, "UTF-8"):
        if any(REPLACEMENT_CHAR in n for n in names):
            garbled |= files_of(rows)
            continue
        if label_col in names:
            slot = F.col(f"_c{names.index(label_col)}")
            mine = files_of(rows.filter(slot.contains(REPLACEMENT_CHAR)))
            garbled |= mine
            if mine and mine == files_of(rows):
                continue
            rows = rows.filter(~F.col(FILE).isin(sorted(mine))) if mine else rows
        out.append((rows, names, encoding))
    if garbled:
        out += grouped(sorted(garbled), "ISO-8859-1")
    for _, names, _ in out:
        src_require_columns(names, require)
    return out


def _narrow(rows: DataFrame, names: list[str], strict: bool) -> tuple[DataFrame, DataFrame]:
    """Rows no wider than the header, and the wide ones; with ``strict`` a wide row raises."""
    wide = F.coalesce(_cells(F.col(CORRUPT)) > len(names), F.lit(False))
    dropped = rows.filter(wide).groupBy(FILE).agg(F.count("*").alias("n"))
    if strict and (bad := dropped.first()):
        raise ValueError(f"{bad[FILE]}: {bad['n']} row(s) wider than the header")
    return rows.filter(~wide), dropped


def _typed(frames: list[tuple[DataFrame, list[str]]], label_col: str) -> list[DataFrame]:
    """Numeric where every non-empty cell of the whole load casts to double; NaN becomes NULL; the label stays text."""
    seen: dict[str, int] = {}
    for rows, names in frames:
        slots = [f"_c{i}" for i in range(len(names))]
        bad = rows.agg(*[F.count_if(F.col(s).isNotNull() & (F.trim(F.col(s)) != "") & F.col(s).try_cast("double").isNull()).alias(s) for s in slots]).first()
        for slot, name in zip(slots, names):
            seen[name] = seen.get(name, 0) + bad[slot]
    out = []
    for rows, names in frames:
        cols = []
        for i, n in enumerate(names):
            v = F.trim(F.col(f"_c{i}")).try_cast("double")
            cols.append((F.when(~F.isnan(v), v) if n != label_col and not seen[n] else F.col(f"_c{i}")).alias(n))
        out.append(rows.select(*cols, FILE, FILE_ROW))
    return out


def src_csv(
    spark: SparkSession,
    path: str,
    label_col: str = "Label",
    strict: bool = True,
    require: tuple[str, ...] = ("Label",),
) -> tuple[DataFrame, DataFrame]:
    """One CSV file -> typed DataFrame, plus a one-row report (encoding, rows dropped as too wide)."""
    ((rows, names, encoding),) = _load(spark, [path], label_col, require)
    kept, dropped = _narrow(rows, names, strict)
    n = (dropped.agg(F.sum("n")).first()[0] or 0) if not strict else 0
    report = spark.createDataFrame([(path.rsplit("/", 1)[-1], encoding, n)], "file string, encoding string, dropped_wide_rows long")
    return _typed([(kept, names)], label_col)[0].drop(FILE, FILE_ROW), report


def src_require_columns(columns: list[str], required: tuple[str, ...], where: str = "") -> None:
    missing = [r for r in required if r not in columns]
    if missing:
        raise ValueError(f"required column(s) {missing} missing {('in ' + where) if where else ''}".strip())


def read_flow_files(
    spark: SparkSession, raw_dir: str, label_col: str = "Label", strict: bool = True, recursive: bool = False, positions: bool = False
) -> DataFrame:
    """Discover, read the files of each header together, type columns over the whole load, normalise labels, union by name.

    ``positions`` keeps ``source_file`` and ``file_row`` (0-based data row in its file).
    """
    from flowlens.operators.quality import std_labels

    frames = []
    for rows, names, _ in _load(spark, src_discover(spark, raw_dir, recursive=recursive), label_col, (label_col,)):
        frames.append((_narrow(rows, names, strict)[0], names))
    out = union_files([std_labels(df, label_col) for df in _typed(frames, label_col)])
    return out if positions else out.drop(FILE, FILE_ROW)


def src_upload_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Uploaded files: must end in .csv, have a header and at least one row together; wide rows raise."""
    paths = [path] if isinstance(path, str) else path
    if not all(p.lower().endswith(".csv") for p in paths):
        raise ValueError("only .csv files are accepted")
    frames = [(_narrow(rows, names, strict=True)[0], names) for rows, names, _ in _load(spark, paths, "", ())]
    df = union_files(_typed(frames, "")).drop(FILE, FILE_ROW)
    if df.isEmpty():
        raise ValueError("the file has no data rows")
    return df


def src_csv_width_filter(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Client-side rule: blank lines skipped, rows whose width differs from the header dropped.

    A cell is a number where its text is one; a column with any other text stays text, so no cell is lost.
    """
    paths = [path] if isinstance(path, str) else path
    frames = [(rows.filter(F.col(CORRUPT).isNull()), names) for rows, names, _ in _load(spark, paths, "", ())]
    return union_files(_typed(frames, "")).drop(FILE, FILE_ROW)


def src_metrics_json(spark: SparkSession, path: str, schema: str | None = None, required: bool = True, document: bool = False) -> DataFrame:
    """Metrics / parameter JSON (JSON lines, or one document per file with ``document=True``).

    An optional absent file gives an empty frame with the schema.
    """
    try:
        reader = spark.read.option("multiLine", document)
        if schema:
            reader = reader.schema(schema)
        return reader.json(path)
    except Exception:
        if required or schema is None:
            raise
        return spark.createDataFrame([], schema)


def src_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """The split table written with ``partitionBy('split')``; a split name prunes partitions."""
    df = spark.read.parquet(path)
    return df.filter(F.col("split") == split) if split else df


def sink_splits(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def sink_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """CSV at the edges (reports, exported predictions); ``single_file`` only for small tables."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def sink_json(df: DataFrame, path: str) -> str:
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def union_files(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

