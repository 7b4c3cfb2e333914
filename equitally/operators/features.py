"""Feature preparation (J4, J5, F5–F11) with Spark ML stages and built-ins.

Fitted statistics (means, deviations, class counts, category levels) are
small aggregates: they come back as literals or as fitted ML models, never
as row data.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equitally.functions.sqltext import ident
from equitally.sources.schema import TARGET


# --------------------------------------------------------------------------- #
# Category domains and codes
# --------------------------------------------------------------------------- #

def category_domain(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """The levels of ``column`` seen in train ∪ test (distinct)."""
    return train.select(column).union(test.select(column)).distinct()


def factorize(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """Deterministic integer codes (0-based, sorted level order) for the
    levels of ``column`` over train ∪ test.

    The window runs over the distinct level table only — one row per
    category level of a feature column, not per data row.
    """
    dom = category_domain(train, test, column).where(F.col(column).isNotNull())
    return dom.select(F.col(column).alias("level"),
                      (F.dense_rank().over(Window.orderBy(column)) - 1).alias("code"))


def first_seen_codes(train: DataFrame, test: DataFrame, column: str, position: str) -> DataFrame:
    """J4 / J5 in first-seen order: (level, code, first_seen) over train, then test.

    Codes follow the smallest ``position`` of a level, train before test, so they
    are those of reading both tables in row order, whatever the partitions.  The
    window runs over the distinct levels only; a level's rows meet in a ``min``.
    """
    seen = train.select(column, F.struct(F.lit(0).alias("part"), F.col(position).alias("row")).alias("at")).unionByName(
        test.select(column, F.struct(F.lit(1).alias("part"), F.col(position).alias("row")).alias("at")))
    first = seen.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("level")).agg(F.min("at").alias("at"))
    return first.select("level", (F.row_number().over(Window.orderBy("at", "level")) - 1).alias("code"), F.col("at.row").alias("first_seen"))


# --------------------------------------------------------------------------- #
# standard scaling (population standard deviation)
# --------------------------------------------------------------------------- #

def fit_standard_scaler(train: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column in one aggregation; a zero (or
    undefined) deviation scales by 1."""
    row = train.agg(*[F.struct(F.avg(F.col(c).cast("double")).alias("m"),
                               F.stddev_pop(F.col(c).cast("double")).alias("s")).alias(f"c{i}")
                      for i, c in enumerate(columns)]).first()
    out = {}
    for i, c in enumerate(columns):
        m, s = row[f"c{i}"]["m"], row[f"c{i}"]["s"]
        out[c] = (m if m is not None else 0.0, s if s not in (None, 0.0) else 1.0)
    return out


def scaled_sql(column: str, mean: float, std: float) -> str:
    """(x − mean) / std with the fitted literals."""
    return f"(CAST({ident(column)} AS DOUBLE) - {mean!r}D) / {std!r}D"


def apply_standard_scaler(df: DataFrame, stats: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """Scaled columns from the fitted literals (no shuffle, no join)."""
    return df.withColumns({c + suffix: F.expr(scaled_sql(c, m, s)) for c, (m, s) in stats.items()})


def scaling_stage(stats: dict[str, tuple[float, float]]) -> SQLTransformer:
    """The same as a pipeline stage (``x__std``); a missing value takes the
    mean, so it neither raises nor lowers a linear score."""
    exprs = ", ".join(f"coalesce(nanvl({scaled_sql(c, m, s)}, NULL), 0.0D) AS {ident(c + '__std')}" for c, (m, s) in stats.items())
    return SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__")


# Trees see a missing number as a value of its own, ordered before all others.
MISSING = -1e12


def missing_stage(columns: list[str]) -> SQLTransformer:
    """Numeric tree inputs (``x__num``) in which missing is an ordered value."""
    exprs = ", ".join(f"coalesce(nanvl(CAST({ident(c)} AS DOUBLE), NULL), {MISSING!r}D) AS {ident(c + '__num')}" for c in columns)
    return SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__")


# --------------------------------------------------------------------------- #
# Categorical encodings
# --------------------------------------------------------------------------- #

def string_indexer(column: str, output: str | None = None) -> StringIndexer:
    """Sorted-level indexer; unseen and NULL levels go to the extra index."""
    return StringIndexer(inputCol=column, outputCol=output or f"{column}__idx",
                         stringOrderType="alphabetAsc", handleInvalid="keep")


def one_hot_stages(columns: list[str]) -> list:
    """one-hot with all known levels kept and unknown → all zeros.

    The indexer (``handleInvalid='keep'``) already appends one trailing
    'unknown' level; ``dropLast`` removes exactly that slot, so an unseen or
    NULL level encodes as the zero vector and every known level keeps its own.
    """
    stages = [string_indexer(c) for c in columns]
    stages.append(OneHotEncoder(inputCols=[f"{c}__idx" for c in columns],
                                outputCols=[f"{c}__ohe" for c in columns], dropLast=True,
                                handleInvalid="error"))
    return stages


def one_hot_index(df: DataFrame, column: str) -> DataFrame:
    """Position of the hot element of a one-hot vector column (NULL when all
    zeros) and the vector size — a plain-column view of F6 output."""
    arr = vector_to_array(F.col(column))
    pos = F.array_position(arr, F.lit(1.0))
    return df.withColumn(f"{column}_hot", F.when(pos > 0, (pos - 1).cast("int"))) \
             .withColumn(f"{column}_size", F.size(arr))


def ordinal_sql(model_column: str, n_levels: int) -> str:
    """indexer output with the 'unknown' index mapped to −1."""
    return f"CASE WHEN {ident(model_column)} >= {n_levels} THEN -1.0D ELSE CAST({ident(model_column)} AS DOUBLE) END"


def ordinal_codes(df: DataFrame, model_column: str, n_levels: int, output: str) -> DataFrame:
    """F7 as an ordered number (no nominal metadata, so trees split on order)."""
    return df.withColumn(output, F.expr(ordinal_sql(model_column, n_levels)))


def ordinal_stage(levels: dict[str, int]) -> SQLTransformer:
    """The same as a pipeline stage (``x__idx`` → ``x__ord``)."""
    exprs = ", ".join(f"{ordinal_sql(c + '__idx', n)} AS {ident(c + '__ord')}" for c, n in levels.items())
    return SQLTransformer(statement=f"SELECT *, {exprs} FROM __THIS__")


# --------------------------------------------------------------------------- #
# Class weights
# --------------------------------------------------------------------------- #

def _class_counts(df: DataFrame, label: str) -> dict:
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def balanced_weights(df: DataFrame, label: str = TARGET, output: str = "weight") -> DataFrame:
    """n / (n_classes · n_class) per row (class counts: one tiny agg)."""
    counts = _class_counts(df, label)
    n, k = sum(counts.values()), len(counts)
    w = None
    for c, nc in counts.items():
        cond = F.col(label) == F.lit(c)
        v = F.lit(n / (k * nc))
        w = F.when(cond, v) if w is None else w.when(cond, v)
    return df.withColumn(output, w)


def positive_class_weight(df: DataFrame, label: str = TARGET, output: str = "weight") -> DataFrame:
    """negatives / positives on positive rows, 1 elsewhere."""
    counts = _class_counts(df, label)
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    ratio = neg / pos if pos else 1.0
    return df.withColumn(output, F.when(F.col(label) == 1, F.lit(ratio)).otherwise(F.lit(1.0)))


# --------------------------------------------------------------------------- #
# assembly with feature names
# --------------------------------------------------------------------------- #

def assembler(inputs: list[str], output: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="keep")


def fit_pipeline(train: DataFrame, stages: list) -> PipelineModel:
    return Pipeline(stages=stages).fit(train)
