"""Spark SQL text helpers.

Column expressions are built as SQL text and turned into a ``Column`` with a
single ``F.expr`` call: the expression is parsed on the JVM side in one round
trip instead of one Python→JVM call per operator node, which matters for the
wide CASE / regex expressions of the cleaning and labelling rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ident(name: str) -> str:
    """Backtick-quoted column reference (names may contain '-')."""
    return "`" + name.replace("`", "``") + "`"


def string_lit(s: str) -> str:
    """Spark SQL string literal (backslashes and quotes escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def value_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, str):
        return string_lit(v)
    if isinstance(v, float):
        return repr(v) + "D"
    return str(v)


def in_list(values) -> str:
    return "(" + ", ".join(value_lit(v) for v in values) + ")"


def case_map(key_sql: str, mapping: dict, else_sql: str = "NULL") -> str:
    """``CASE key WHEN k THEN v ... ELSE else END``."""
    whens = " ".join(f"WHEN {value_lit(k)} THEN {value_lit(v)}" for k, v in mapping.items())
    return f"CASE {key_sql} {whens} ELSE {else_sql} END"


def expr(text: str) -> Column:
    return F.expr(text)
