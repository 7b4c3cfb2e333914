"""Scalar helpers: decision threshold, safe division, bin indices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column

from equitally.functions.sqltext import expr, ident
from equitally.sources.schema import THRESHOLD


def _x(c: str | Column) -> str:
    if not isinstance(c, str):
        raise TypeError("pass a column name")
    return ident(c)


def predict_at_sql(p: str, threshold: float = THRESHOLD) -> str:
    return f"CAST({p} >= {float(threshold)!r}D AS INT)"


def predict_at(p: str, threshold: float = THRESHOLD) -> Column:
    """P20: hard decision ``p >= threshold`` (inclusive) as 0/1."""
    return expr(predict_at_sql(_x(p), threshold))


def ratio_sql(num: str, den: str) -> str:
    return f"coalesce(try_divide(CAST({num} AS DOUBLE), CAST({den} AS DOUBLE)), 0.0D)"


def ratio(num: str, den: str) -> Column:
    """num / den for SQL texts, 0 when den is 0 (the metric libraries' rule)."""
    return expr(ratio_sql(num, den))


def ratio_or_null(num: str, den: str) -> Column:
    """num / den for SQL texts, NULL when den is 0."""
    return expr(f"try_divide(CAST({num} AS DOUBLE), CAST({den} AS DOUBLE))")


def uniform_edges(n_bins: int) -> list[float]:
    """Equal-width bin edges on [0, 1], bit-identical to ``numpy.linspace``."""
    return [float(x) for x in np.linspace(0.0, 1.0, n_bins + 1)]


def left_closed_bin_sql(p: str, n_bins: int) -> str:
    edges = uniform_edges(n_bins)
    whens = " ".join(f"WHEN {p} >= {edges[i]!r}D AND {p} < {edges[i + 1]!r}D THEN {i}" for i in range(n_bins))
    return f"CASE {whens} END"


def left_closed_bin(p: str, n_bins: int) -> Column:
    """Bin index for ``[e_i, e_{i+1})``; values outside [0, 1) (so p = 1.0) → NULL."""
    return expr(left_closed_bin_sql(_x(p), n_bins))


def right_closed_bin_sql(p: str, n_bins: int) -> str:
    inner = uniform_edges(n_bins)[1:-1]
    total = " + ".join(f"CAST({p} > {e!r}D AS INT)" for e in inner) or "0"
    return f"CASE WHEN {p} IS NOT NULL THEN {total} END"


def right_closed_bin(p: str, n_bins: int) -> Column:
    """Bin index for ``(e_i, e_{i+1}]`` with values <= e_1 in bin 0 and values
    above e_{n-1} in the last bin (reliability-curve binning)."""
    return expr(right_closed_bin_sql(_x(p), n_bins))
