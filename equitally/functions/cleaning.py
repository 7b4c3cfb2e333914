"""Column expressions for raw-value cleaning (JVM built-ins, no UDFs).

Each rule has a ``*_sql`` form that maps SQL text to SQL text (so rules
compose, e.g. a range midpoint inside a numeric cast) and a ``Column`` form
that takes a column name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equitally.functions.sqltext import case_map, expr, ident, in_list, string_lit
from equitally.sources.schema import (
    AGE_CODES,
    APPROVED_CODE,
    NA_TOKENS,
    RANGE_SENTINELS,
    RANGE_STRIP_CHARS,
)

# Plain decimal / scientific number, optional sign; what a CSV reader parses.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------- #
# SQL text forms
# --------------------------------------------------------------------------- #

def na_token_sql(x: str) -> str:
    """Pandas default NA tokens → NULL (exact field match)."""
    return f"CASE WHEN {x} IN {in_list(NA_TOKENS)} THEN NULL ELSE {x} END"


def to_double_sql(x: str, numeric: bool = False) -> str:
    """Text that is not a plain number → NULL; numeric NaN → NULL."""
    if numeric:
        return f"CASE WHEN isnan(CAST({x} AS DOUBLE)) THEN NULL ELSE CAST({x} AS DOUBLE) END"
    t = f"trim(CAST({x} AS STRING))"
    return f"CASE WHEN {t} RLIKE {string_lit(NUMBER_PATTERN)} THEN try_cast({t} AS DOUBLE) END"


def ordinal_age_sql(x: str) -> str:
    """Age band → ordinal code 0..6; anything else → NULL."""
    return f"CAST({case_map(f'CAST({x} AS STRING)', AGE_CODES)} AS DOUBLE)"


def range_midpoint_sql(x: str) -> str:
    """Strip '%', '<', '>' and blanks; 'a-b' → (a+b)/2, more than one '-'
    or a non-number part → NULL, sentinels → NULL, otherwise the number."""
    raw = f"CAST({x} AS STRING)"
    st = f"trim(regexp_replace({raw}, {string_lit('[' + RANGE_STRIP_CHARS + ']')}, ''))"
    parts = f"split({st}, '-')"
    lo, hi = to_double_sql(f"{parts}[0]"), to_double_sql(f"{parts}[1]")
    return (f"CASE WHEN {raw} IS NULL OR {raw} IN {in_list(RANGE_SENTINELS)} THEN NULL "
            f"WHEN instr({st}, '-') > 0 THEN CASE WHEN size({parts}) = 2 THEN ({lo} + {hi}) / 2.0D END "
            f"ELSE {to_double_sql(st)} END")


def decision_target_sql(x: str, numeric: bool) -> str:
    """1 when the decision code is 'approved', else 0."""
    cond = f"{x} = {APPROVED_CODE}" if numeric else f"{to_double_sql(x)} = {float(APPROVED_CODE)!r}D"
    return f"CAST(CASE WHEN {cond} THEN 1 ELSE 0 END AS INT)"


# --------------------------------------------------------------------------- #
# Column forms (take a column name)
# --------------------------------------------------------------------------- #

def na_token_to_null(c: str) -> Column:
    return expr(na_token_sql(ident(c)))


def to_double(c: str, dtype: T.DataType | None = None) -> Column:
    numeric = dtype is not None and isinstance(dtype, T.NumericType)
    return expr(to_double_sql(ident(c), numeric))


def ordinal_age(c: str) -> Column:
    return expr(ordinal_age_sql(ident(c)))


def range_midpoint(c: str) -> Column:
    return expr(range_midpoint_sql(ident(c)))


def decision_target(c: str, dtype: T.DataType | None = None) -> Column:
    return expr(decision_target_sql(ident(c), dtype is not None and isinstance(dtype, T.NumericType)))
