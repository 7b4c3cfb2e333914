"""Audit cells: the one shuffle every group metric is derived from.

Scored rows are aggregated once by ``(model, race, gender, age, county,
ece_bin, curve_bin)`` into additive sufficient statistics::

    n, n_pos = Σy, tp = Σ y·ŷ, fp = Σ (1-y)·ŷ, sum_p = Σp, sum_sq = Σ(p-y)²

with ``tn = n - n_pos - fp`` and ``fn = n_pos - tp``.  The number of cells is
bounded by the product of the label domains (and ~15 realised bin pairs), not
by the row count, so the map-side partial aggregation collapses every task's
rows before the shuffle and everything downstream works on a table of a few
thousand rows.  A hot group (one label holding a third of all rows) is just a
bigger count in the same cell; no task ever holds its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equitally.functions.labels import age_label, county_label, gender_label, race_label
from equitally.functions.thresholds import left_closed_bin, predict_at, right_closed_bin
from equitally.sources.schema import CURVE_BINS, ECE_BINS, TARGET, THRESHOLD

LABEL_KEYS = ["race", "gender", "age", "county"]
MEASURES = ["n", "n_pos", "tp", "fp", "sum_p", "sum_sq"]


LABEL_SOURCES = ["derived_race", "derived_sex", "applicant_age", "county_code"]


def label_columns() -> list:
    """Audit labels from the cleaned columns ``LABEL_SOURCES``."""
    return [
        race_label("derived_race").alias("race"),
        gender_label("derived_sex").alias("gender"),
        age_label("applicant_age").alias("age"),
        county_label("county_code").alias("county"),
    ]


def audit_rows(df: DataFrame, scores: str | dict[str, str] = "y_prob", target: str = TARGET,
               threshold: float = THRESHOLD, prediction: str | None = None) -> DataFrame:
    """Scored, labelled rows ``(model, y, p, yhat, race, gender, age, county)``.

    ``scores`` is one probability column, or ``{model_name: column}`` to audit
    several models side by side; the rows are then expanded once per model
    inside the same scan (no self-join).  ``yhat`` is ``p >= threshold``
    unless a hard ``prediction`` column is given.
    """
    base = [F.col(target).cast("int").alias("y")] + label_columns()
    if isinstance(scores, str):
        out = df.select(F.lit("model").alias("model"), F.col(scores).cast("double").alias("p"),
                        *([F.col(prediction).cast("int").alias("yhat")] if prediction else []), *base)
    else:
        items = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("p"))
                          for m, c in scores.items()])
        out = df.select(F.explode(items).alias("mp"), *base).select("mp.model", "mp.p", *[
            "y", *LABEL_KEYS])
    if "yhat" not in out.columns:
        out = out.withColumn("yhat", predict_at("p", threshold))
    return out.select("model", "y", "p", "yhat", *LABEL_KEYS)


def scored_audit_rows(scored: DataFrame) -> DataFrame:
    """Audit rows of the long output of ``models.score`` (model, y, p, yhat) that
    kept ``LABEL_SOURCES``: any number of models, no pivot, no shuffle."""
    return scored.select("model", "y", "p", "yhat", *label_columns())


def audit_cells(rows: DataFrame, keys: list[str] | None = None, ece_bins: int = ECE_BINS,
                curve_bins: int = CURVE_BINS) -> DataFrame:
    """Aggregate audit rows into additive cells (one partial+final hash agg).

    The final aggregation stays parallel; only its output, bounded by the
    label domains, is moved into ONE partition (a shuffle of a few thousand
    rows).  A single partition satisfies every clustering requirement, so
    all roll-ups, windows and joins over the cells run without another
    exchange.  (``coalesce(1)`` would instead pull the final aggregation of
    every map task's partial cells into one task.)
    """
    keys = keys or ["model", *LABEL_KEYS]
    y = F.col("y")
    yhat = F.col("yhat")
    err = F.col("p") - y.cast("double")
    return (rows
            .withColumn("ece_bin", left_closed_bin("p", ece_bins))
            .withColumn("curve_bin", right_closed_bin("p", curve_bins))
            .groupBy(*keys, "ece_bin", "curve_bin")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum(y).cast("long").alias("n_pos"),
                 F.sum(y * yhat).cast("long").alias("tp"),
                 F.sum((F.lit(1) - y) * yhat).cast("long").alias("fp"),
                 F.sum("p").alias("sum_p"),
                 F.sum(err * err).alias("sum_sq"))
            .repartition(1))


def rollup(cells: DataFrame, *keys: str) -> DataFrame:
    """Sum the additive measures of ``cells`` up to ``keys``."""
    return cells.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in MEASURES])


def stack_attributes(cells: DataFrame, attributes: dict[str, str], extra_keys: list[str] = ()) -> DataFrame:
    """One row per (attribute, group label) for every cell: the grouping-sets
    form that audits all attributes from one cell table.  Rows whose label is
    NULL for an attribute are left out of that attribute only."""
    items = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(c).alias("group_label"))
                      for a, c in attributes.items()])
    keep = [*extra_keys, *MEASURES]
    return (cells.select(F.explode(items).alias("ag"), *keep)
            .select("ag.attribute", "ag.group_label", *keep)
            .where(F.col("group_label").isNotNull()))
