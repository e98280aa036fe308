"""Scalar helpers.

Feature names are data (``Fwd Avg Bytes/Bulk``), so columns are always
referenced through :func:`c`, which back-quotes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


def c(name: str) -> Column:
    """Column by literal name (spaces, slashes and dots allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    """Numeric columns in schema order, minus ``exclude`` (the target)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, FLOAT_TYPES)]


def is_inf(x: Column) -> Column:
    """True for +/-Infinity, False otherwise (NULL for NULL input)."""
    return F.abs(x) == F.lit(float("inf"))


def as_missing(x: Column) -> Column:
    """NaN is missing: turn it into NULL, keep +/-Infinity (rule S1)."""
    return F.when(~F.isnan(x), x)


def pct_guard(num: Column, den: Column) -> Column:
    """``num / den * 100`` or 0.0 when ``den`` is 0 (rule S12)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")) * F.lit(100.0), F.lit(0.0))


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` or 0.0 when ``den`` is 0 (zero-division rule of the metrics)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def argmax_index(arr: Column) -> Column:
    """0-based index of the first maximum of an array (numpy ``argmax``)."""
    return (F.array_position(arr, F.array_max(arr)) - F.lit(1)).cast("bigint")


def exact_text(x: Column) -> Column:
    """The exact value of a double as text, the same in any SQL engine: hexadecimal digits, one zero, NaN and infinities apart."""
    v = F.when(x == 0.0, F.lit(0.0)).otherwise(x.cast("double"))
    finite = F.replace(F.format_string("%a", v), F.lit(".0p"), F.lit("p"))
    return F.when(F.isnan(v), F.lit("nan")).when(is_inf(v), F.when(v > 0, F.lit("inf")).otherwise(F.lit("-inf"))).otherwise(finite)


def row_hash(df: DataFrame, cols: list[str] | None = None, seed: int = 42) -> Column:
    """Deterministic md5 of a row's content salted with ``seed``.

    Floating-point values enter exactly (:func:`exact_text`), other values as text behind their length; NULL
    prints as ``~``, which no value does.  Only identical rows hash alike, and those are interchangeable.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = [F.lit(str(seed))]
    for name in cols or df.columns:
        if isinstance(types[name], FLOAT_TYPES):
            text = F.when(c(name).isNotNull(), exact_text(c(name)))
        else:
            value = c(name).cast("string")
            text = F.concat(F.length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(text, F.lit("~")))
    return F.md5(F.concat_ws("|", *parts))


def row_hash_sql(cols_types: list[tuple[str, bool]], seed: int = 42) -> str:
    """The same hash as SQL text (for the DuckDB oracle); the flag says whether a column is floating-point."""
    parts = [f"'{seed}'"]
    for name, floating in cols_types:
        q = '"' + name + '"'
        if floating:
            hexa = f"replace(printf('%a', CASE WHEN {q} = 0 THEN 0.0 ELSE CAST({q} AS DOUBLE) END), 'p+', 'p')"
            inner = f"CASE WHEN {q} IS NULL THEN NULL WHEN isnan({q}) THEN 'nan' WHEN isinf({q}) THEN CASE WHEN {q} > 0 THEN 'inf' ELSE '-inf' END ELSE {hexa} END"
        else:
            inner = f"length(CAST({q} AS VARCHAR)) || ':' || CAST({q} AS VARCHAR)"
        parts.append(f"coalesce({inner}, '~')")
    return "md5(concat_ws('|', " + ", ".join(parts) + "))"
