"""Column expressions shared by the operators (all JVM-side, no Python UDFs)."""

from flowlens.functions.exprs import (  # noqa: F401
    argmax_index,
    as_missing,
    c,
    is_inf,
    numeric_columns,
    pct_guard,
    row_hash,
    row_hash_sql,
    safe_ratio,
)
