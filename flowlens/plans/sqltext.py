"""SQL text for the DuckDB oracle: the same views and cleaning chain as the engine.

Only the oracle uses these strings; the engine runs DataFrame code.
"""

from __future__ import annotations

from flowlens.operators.quality import LABEL_CANON, RARE_CLASSES, WEB_ATTACK_CLASS, WEB_ATTACK_TOKEN
from flowlens.plans.fixtures import CLEAN_FEATURES, FEATURES, FLOWS_SQL, LABEL


def q(name: str) -> str:
    return '"' + name + '"'


def label_norm_sql(col: str) -> str:
    clean = f"regexp_replace(regexp_replace({col}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABEL_CANON.items())
    return (
        f"CASE WHEN {col} IS NULL THEN NULL "
        f"WHEN contains(lower({clean}), '{WEB_ATTACK_TOKEN}') THEN '{WEB_ATTACK_CLASS}' "
        f"ELSE coalesce(CASE lower({clean}) {cases} END, {clean}) END"
    )


def _rare_list() -> str:
    return ", ".join(f"'{k}'" for k in RARE_CLASSES)


def clean_chain_ctes() -> str:
    """CTEs: flows_raw -> flows_in (labels normalised, NaN as NULL) -> ... -> flows_clean."""
    nan_null = ", ".join(f"CASE WHEN isnan({f}) THEN NULL ELSE {f} END AS {f}" for f in FEATURES)
    inf_null = ", ".join(f"CASE WHEN isinf({f}) THEN NULL ELSE {f} END AS {f}" for f in FEATURES)
    not_null = " AND ".join(f"{n} IS NOT NULL" for n in [LABEL] + FEATURES)
    return f"""
flows_raw AS ({FLOWS_SQL}),
flows_in AS (SELECT {label_norm_sql(LABEL)} AS {LABEL}, {nan_null} FROM flows_raw),
flows_norare AS (SELECT * FROM flows_in WHERE {LABEL} IS NULL OR {LABEL} NOT IN ({_rare_list()})),
flows_noinf AS (SELECT {LABEL}, {inf_null} FROM flows_norare),
flows_dedup AS (SELECT DISTINCT * FROM flows_noinf),
flows_nomissing AS (SELECT * FROM flows_dedup WHERE {not_null}),
flows_clean AS (SELECT {LABEL}, {", ".join(CLEAN_FEATURES)} FROM flows_nomissing)"""


def with_clean(body: str, extra_ctes: str = "") -> str:
    """Full oracle statement: the cleaning CTEs, optional extra CTEs, then ``body``."""
    ctes = clean_chain_ctes()
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"WITH {ctes}\n{body}"


def hash_sql(cols: list[str], seed: int = 42) -> str:
    from flowlens.functions.exprs import row_hash_sql

    return row_hash_sql([(n, n != LABEL) for n in cols], seed)


def prepared_ctes() -> str:
    """CTEs after cleaning: exact split (flows_split), label map (lmap), encoded rows (flows_enc)."""
    cols = [LABEL] + CLEAN_FEATURES
    return f"""
split_h AS (SELECT *, {hash_sql(cols)} AS _h FROM flows_clean),
split_r AS (SELECT *, row_number() OVER (PARTITION BY {LABEL} ORDER BY _h) - 1 AS _rank, count(*) OVER (PARTITION BY {LABEL}) AS _n FROM split_h),
flows_split AS (SELECT {", ".join(cols)}, CASE WHEN _rank < (_n * 70) // 100 THEN 'train' WHEN _rank < (_n * 85) // 100 THEN 'valid' ELSE 'test' END AS split FROM split_r),
lmap AS (SELECT {LABEL} AS label, CAST(row_number() OVER (ORDER BY {LABEL}) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT {LABEL} FROM flows_clean)),
flows_enc AS (SELECT s.*, m.idx AS label_idx FROM flows_split s JOIN lmap m ON s.{LABEL} = m.label)"""


def with_prepared(body: str, extra_ctes: str = "") -> str:
    ctes = prepared_ctes()
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return with_clean(body, ctes)
