"""Calibration roll-ups of the audit cells.

ECE bins are left-closed ``[e_i, e_{i+1})`` on ``numpy.linspace`` edges, so a
score of exactly 1.0 falls in no bin but still counts in the group size.
Reliability-curve bins are right-closed ``(e_i, e_{i+1}]`` with 0 in the first
bin.  Both bin indices are cell keys, so every number here is a small
aggregation of the cell table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equitally.functions.thresholds import ratio_or_null, uniform_edges
from equitally.operators.cells import MEASURES, stack_attributes
from equitally.sources.schema import CURVE_BINS, ECE_BINS, MIN_GROUP_SIZE

CALIBRATION_ATTRIBUTES = {"Race": "race", "Age": "age", "Gender": "gender", "County": "county"}


def _stacked(cells: DataFrame, attributes: dict[str, str], model: str | None, bin_col: str) -> DataFrame:
    c = cells if model is None else cells.where(F.col("model") == model)
    return stack_attributes(c, attributes, ["model", bin_col])


def calibration_bins(cells: DataFrame, attributes: dict[str, str] = CALIBRATION_ATTRIBUTES,
                     model: str | None = None, n_bins: int = ECE_BINS) -> DataFrame:
    """Per (attribute, group, ECE bin): size, accuracy (mean y), confidence
    (mean p) and the bin centre, for non-empty bins."""
    edges = uniform_edges(n_bins)
    centres = F.array(*[F.lit((edges[i] + edges[i + 1]) / 2) for i in range(n_bins)])
    s = _stacked(cells, attributes, model, "ece_bin").where(F.col("ece_bin").isNotNull())
    per = s.groupBy("model", "attribute", "group_label", "ece_bin").agg(
        F.sum("n").alias("bin_n"), F.sum("n_pos").alias("bin_pos"), F.sum("sum_p").alias("bin_sum_p"))
    return per.select(
        "model", "attribute", "group_label", "ece_bin",
        F.element_at(centres, F.col("ece_bin") + 1).alias("bin_center"),
        "bin_n",
        (F.col("bin_pos") / F.col("bin_n")).alias("bin_accuracy"),
        (F.col("bin_sum_p") / F.col("bin_n")).alias("bin_confidence"))


def calibration_table(cells: DataFrame, attributes: dict[str, str] = CALIBRATION_ATTRIBUTES,
                      model: str | None = None, min_size: int = MIN_GROUP_SIZE,
                      n_bins: int = ECE_BINS) -> DataFrame:
    """Per group sample size, actual rate, mean predicted
    probability, calibration gap, ECE and Brier score; groups under
    ``min_size`` left out; ordered by attribute then group label."""
    bins = calibration_bins(cells, attributes, model, n_bins)
    groups = (_stacked(cells, attributes, model, "ece_bin")
              .groupBy("model", "attribute", "group_label")
              .agg(*[F.sum(m).alias(m) for m in MEASURES]))
    ece_parts = (bins.join(groups.select("model", "attribute", "group_label", "n"),
                           ["model", "attribute", "group_label"])
                 .groupBy("model", "attribute", "group_label")
                 .agg(F.sum(F.abs(F.col("bin_accuracy") - F.col("bin_confidence")) * F.col("bin_n")
                            / F.col("n")).alias("ece")))
    order = F.array(*[F.lit(a) for a in attributes])
    out = (groups.where(F.col("n") >= min_size)
           .join(ece_parts, ["model", "attribute", "group_label"], "left")
           .select("model", "attribute", "group_label",
                   F.col("n").alias("sample_size"),
                   (F.col("n_pos") / F.col("n")).alias("actual_approval_rate"),
                   (F.col("sum_p") / F.col("n")).alias("mean_predicted_probability"),
                   F.abs(F.col("n_pos") / F.col("n") - F.col("sum_p") / F.col("n")).alias("calibration_gap"),
                   F.coalesce(F.col("ece"), F.lit(0.0)).alias("ece"),
                   (F.col("sum_sq") / F.col("n")).alias("brier_score"),
                   F.array_position(order, F.col("attribute")).alias("attribute_order")))
    return out.orderBy("model", "attribute_order", "group_label").drop("attribute_order")


def reliability_curve(cells: DataFrame, attributes: dict[str, str] = CALIBRATION_ATTRIBUTES,
                      model: str | None = None, min_size: int = MIN_GROUP_SIZE) -> DataFrame:
    """Mean predicted vs observed rate per non-empty uniform bin and group."""
    s = _stacked(cells, attributes, model, "curve_bin")
    sizes = s.groupBy("model", "attribute", "group_label").agg(F.sum("n").alias("group_n"))
    per = s.groupBy("model", "attribute", "group_label", "curve_bin").agg(
        F.sum("n").alias("bin_n"), F.sum("n_pos").alias("bin_pos"), F.sum("sum_p").alias("bin_sum_p"))
    return (per.join(sizes, ["model", "attribute", "group_label"])
            .where(F.col("group_n") >= min_size)
            .select("model", "attribute", "group_label", "curve_bin", "bin_n",
                    ratio_or_null("bin_sum_p", "bin_n").alias("prob_pred"),
                    ratio_or_null("bin_pos", "bin_n").alias("prob_true")))


def overall_calibration(cells: DataFrame, model: str | None = None, n_bins: int = ECE_BINS) -> DataFrame:
    """D1/D3/D4 over all rows of each model (no group split)."""
    c = cells if model is None else cells.where(F.col("model") == model)
    tot = c.groupBy("model").agg(*[F.sum(m).alias(m) for m in MEASURES])
    per_bin = (c.where(F.col("ece_bin").isNotNull())
               .groupBy("model", "ece_bin").agg(F.sum("n").alias("bn"), F.sum("n_pos").alias("bp"),
                                                F.sum("sum_p").alias("bs")))
    ece = (per_bin.join(tot.select("model", "n"), "model")
           .groupBy("model").agg(F.sum(F.abs(F.col("bp") / F.col("bn") - F.col("bs") / F.col("bn"))
                                       * F.col("bn") / F.col("n")).alias("ece")))
    return tot.join(ece, "model", "left").select(
        "model", F.col("n").alias("sample_size"),
        (F.col("n_pos") / F.col("n")).alias("actual_approval_rate"),
        (F.col("sum_p") / F.col("n")).alias("mean_predicted_probability"),
        F.abs(F.col("n_pos") / F.col("n") - F.col("sum_p") / F.col("n")).alias("calibration_gap"),
        F.coalesce(F.col("ece"), F.lit(0.0)).alias("ece"),
        (F.col("sum_sq") / F.col("n")).alias("brier_score"))


CURVE_EDGES = uniform_edges(CURVE_BINS)
