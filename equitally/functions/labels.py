"""Audit label expressions (decoded, grouped, NULL when unmapped)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from equitally.functions.cleaning import col_of
from equitally.functions.sqltext import case_map, expr, ident
from equitally.sources.schema import AGE_LABELS, COUNTY_LABELS, GENDER_LABELS, RACE_LABELS


def age_label_sql(x: str) -> str:
    """Ordinal code (possibly an x.5 median) → band label; the code is
    truncated toward zero like an integer cast; missing or non-finite → NULL."""
    d = f"CAST({x} AS DOUBLE)"
    code = f"CASE WHEN {d} IS NOT NULL AND NOT isnan({d}) AND abs({d}) < 1e15D THEN CAST({d} AS BIGINT) END"
    return case_map(code, AGE_LABELS)


def county_label_sql(x: str) -> str:
    """County FIPS code → county name; other codes → NULL."""
    d = f"CAST({x} AS DOUBLE)"
    return case_map(f"CASE WHEN {d} = floor({d}) THEN CAST({d} AS BIGINT) END", COUNTY_LABELS)


def race_label_sql(x: str, include_other: bool = True) -> str:
    """Derived race → White / Black / Asian / Other (optional)."""
    mapping = RACE_LABELS if include_other else {k: v for k, v in RACE_LABELS.items() if v != "Other"}
    return case_map(f"CAST({x} AS STRING)", mapping)


def gender_label_sql(x: str) -> str:
    """Derived sex → Male / Female; others → NULL."""
    return case_map(f"CAST({x} AS STRING)", GENDER_LABELS)


def age_label(c: str) -> Column:
    return expr(age_label_sql(ident(c)))


def county_label(c: str) -> Column:
    return expr(county_label_sql(ident(c)))


def race_label(c: str, include_other: bool = True) -> Column:
    return expr(race_label_sql(ident(c), include_other))


def gender_label(c: str) -> Column:
    return expr(gender_label_sql(ident(c)))


def intersection_label(*cols: str | Column) -> Column:
    """P18: 'a b' joined with a space; NULL when any part is NULL (``concat``,
    not ``concat_ws``, which would skip NULLs)."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(" "))
        parts.append(col_of(c))
    return F.concat(*parts)
