"""Cleaning operators: raw application rows → modelling table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equitally.functions.cleaning import (
    decision_target,
    decision_target_sql,
    na_token_sql,
    ordinal_age_sql,
    range_midpoint_sql,
    to_double_sql,
)
from equitally.functions.sqltext import expr, ident
from equitally.operators.stats import median_fill_values
from equitally.session import write_table
from equitally.sources.schema import (
    AGE_COLUMNS,
    DECISION_CODES,
    INT_CODE_FEATURES,
    LEAKAGE_COLUMNS,
    NUMERIC_IMPUTE_COLUMNS,
    RANGE_COLUMNS,
    TARGET,
    UNKNOWN,
)


def _dtype(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def normalize_na_tokens(df: DataFrame) -> DataFrame:
    """NA tokens → NULL in every string column."""
    return df.selectExpr(*[
        f"{na_token_sql(ident(f.name))} AS {ident(f.name)}" if isinstance(f.dataType, T.StringType)
        else ident(f.name)
        for f in df.schema.fields
    ])


def decision_filter(df: DataFrame, column: str = "action_taken", codes=tuple(DECISION_CODES)) -> DataFrame:
    """Keep rows whose decision code is one of ``codes``.

    A numeric column gets a plain ``IN`` (pushed into the Parquet scan); a
    raw string column is parsed first.
    """
    dt = _dtype(df, column)
    if isinstance(dt, T.StringType):
        return df.where(expr(f"{to_double_sql(ident(column))} IN ({', '.join(repr(float(c)) + 'D' for c in codes)})"))
    return df.where(F.col(column).isin(*codes))


def add_target(df: DataFrame, column: str = "action_taken", target: str = TARGET) -> DataFrame:
    """Binary target, 1 for the approved code."""
    return df.withColumn(target, decision_target(column, _dtype(df, column)))


def drop_leakage(df: DataFrame, columns=tuple(LEAKAGE_COLUMNS)) -> DataFrame:
    """Drop leakage / redundant columns that are present (others: no-op)."""
    present = [c for c in columns if c in df.columns]
    return df.drop(*present)


def impute_medians(df: DataFrame, columns=tuple(NUMERIC_IMPUTE_COLUMNS), exact: bool = True,
                   medians: dict[str, float | None] | None = None) -> tuple[DataFrame, dict]:
    """P10: fill NULL with the column median over all rows of ``df``.

    Returns the filled table and the medians used (so the same values can be
    applied to other splits).  All-null columns stay NULL.
    """
    present = [c for c in columns if c in df.columns]
    if medians is None:
        medians = median_fill_values(df, present, exact=exact)
    out = df.select(*[
        F.coalesce(F.col(f.name), F.lit(medians[f.name]).cast("double")).alias(f.name)
        if f.name in present and medians.get(f.name) is not None else F.col(f.name)
        for f in df.schema.fields
    ])
    return out, medians


def fill_unknown(df: DataFrame, value: str = UNKNOWN) -> DataFrame:
    """Missing categorical strings → 'Unknown'."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.fillna(value, subset=strings) if strings else df


def prepare_features(raw: DataFrame, decision_column: str = "action_taken") -> DataFrame:
    """Everything up to (not including) imputation.

    Built as normalise → filter → ONE projection, so the plan is analysed a
    few times rather than once per rule.
    """
    df = decision_filter(normalize_na_tokens(raw), decision_column)
    exprs = []
    for f in df.schema.fields:
        if f.name in LEAKAGE_COLUMNS:
            continue
        x, numeric = ident(f.name), isinstance(f.dataType, T.NumericType)
        if f.name in AGE_COLUMNS:
            x, numeric = ordinal_age_sql(x), True
        elif f.name in RANGE_COLUMNS:
            x, numeric = range_midpoint_sql(x), True
        if f.name in NUMERIC_IMPUTE_COLUMNS:
            x = to_double_sql(x, numeric)
        elif f.name in INT_CODE_FEATURES and not isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType)):
            d = to_double_sql(x, numeric)  # what is no whole number in range is missing
            x = f"CASE WHEN {d} = floor({d}) THEN try_cast({d} AS INT) END"
        exprs.append(f"{x} AS {ident(f.name)}")
    dnum = isinstance(_dtype(df, decision_column), T.NumericType)
    exprs.append(f"{decision_target_sql(ident(decision_column), dnum)} AS {TARGET}")
    return df.selectExpr(*exprs)


def clean_applications(raw: DataFrame, exact_median: bool = True,
                       medians: dict[str, float | None] | None = None, materialize: bool = True) -> DataFrame:
    """Raw application rows → cleaned modelling table.

    The parsed decision rows are written once as Parquet to the shared
    checkpoint folder (``materialize``); the median passes then read only the
    numeric columns of that table, and the cleaned table is a projection of
    it.  Medians are computed over all decision rows, before any split, as
    the audited workflow does.
    """
    df = prepare_features(raw)
    present = [c for c in NUMERIC_IMPUTE_COLUMNS if c in df.columns]
    if materialize:
        # later passes read only the numeric columns of this Parquet table
        df = write_table(df, "prepared")
    df, _ = impute_medians(df, present, exact=exact_median, medians=medians)
    return fill_unknown(df)


def shape_report(raw: DataFrame, cleaned_columns: int, decision_column: str = "action_taken") -> DataFrame:
    """Row / column counts before and after cleaning, in one scan."""
    dt = _dtype(raw, decision_column)
    x = ident(decision_column)
    kept = (expr(f"{to_double_sql(na_token_sql(x))} IN ({', '.join(repr(float(c)) + 'D' for c in DECISION_CODES)})")
            if isinstance(dt, T.StringType) else F.col(decision_column).isin(*DECISION_CODES))
    counts = raw.agg(F.count(F.lit(1)).alias("raw_rows"),
                     F.count(F.when(kept, 1)).alias("clean_rows"))
    return counts.select(F.explode(F.array(
        F.struct(F.lit("raw").alias("stage"), F.col("raw_rows").alias("n_rows"),
                 F.lit(len(raw.columns)).alias("n_columns")),
        F.struct(F.lit("clean").alias("stage"), F.col("clean_rows").alias("n_rows"),
                 F.lit(cleaned_columns).alias("n_columns")),
    )).alias("s")).select("s.*")
