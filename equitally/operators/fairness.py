"""Group-fairness roll-ups of the audit cells.

All inputs here are cell tables (a few thousand rows); every function is a
small aggregation over them, never a rescan of the scored rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equitally.functions.labels import intersection_label
from equitally.functions.thresholds import ratio
from equitally.operators.cells import MEASURES, rollup, stack_attributes
from equitally.sources.schema import GROUP_ORDER, MIN_GROUP_SIZE

AUDIT_ATTRIBUTES = {"Race": "race", "Gender": "gender", "Age": "age", "County": "county"}
METRIC_NAMES = ["accuracy", "selection_rate", "tpr", "fpr"]


def with_rates(df: DataFrame) -> DataFrame:
    """C1–C4 from additive measures: accuracy, selection rate, TPR, FPR.

    Zero denominators give 0, as the metric libraries do.
    """
    return df.withColumns({
        "accuracy": ratio("tp + (n - n_pos - fp)", "n"),
        "selection_rate": ratio("tp + fp", "n"),
        "tpr": ratio("tp", "n_pos"),
        "fpr": ratio("fp", "n - n_pos"),
    })


def declared_groups(spark: SparkSession, order: dict[str, list[str]] = GROUP_ORDER) -> DataFrame:
    """J1 dimension: (attribute, group_label, group_order) in declared order."""
    rows = [(a, g, i) for a, groups in order.items() for i, g in enumerate(groups, start=1)]
    schema = T.StructType([T.StructField("attribute", T.StringType()),
                           T.StructField("group_label", T.StringType()),
                           T.StructField("group_order", T.IntegerType())])
    return spark.createDataFrame(rows, schema)


def _one_model(cells: DataFrame, model: str | None) -> DataFrame:
    return cells if model is None else cells.where(F.col("model") == model)


def group_rollup(cells: DataFrame, attributes: dict[str, str] = AUDIT_ATTRIBUTES,
                 extra_keys: list[str] = ()) -> DataFrame:
    """Measures per (attribute, group_label[, extra keys]) for all attributes at once."""
    stacked = stack_attributes(cells, attributes, list(extra_keys))
    return rollup(stacked, *extra_keys, "attribute", "group_label")


def _declared_per_model(cells: DataFrame, order: dict[str, list[str]]) -> DataFrame:
    """J1 dimension once for every model in the cells."""
    groups = F.array(*[F.struct(F.lit(a).alias("attribute"), F.lit(g).alias("group_label"), F.lit(i).alias("group_order"))
                       for a, labels in order.items() for i, g in enumerate(labels, start=1)])
    return cells.select("model").distinct().select("model", F.explode(groups).alias("g")).select("model", "g.*")


def group_metrics(cells: DataFrame, attributes: dict[str, str] = AUDIT_ATTRIBUTES,
                  order: dict[str, list[str]] = GROUP_ORDER, model: str | None = None) -> DataFrame:
    """C5 + J1: every model's metric frame for every attribute, reindexed to the
    declared group order (a declared group with no rows gets NULL metrics)."""
    cells = _one_model(cells, model)
    measured = with_rates(group_rollup(cells, attributes, ["model"]))
    dims = _declared_per_model(cells, {a: order[a] for a in attributes})
    return (dims.join(measured, ["model", "attribute", "group_label"], "left")
            .select("model", "attribute", "group_label", "group_order",
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"), *METRIC_NAMES))


def fairness_summary(cells: DataFrame, attributes: dict[str, str] = AUDIT_ATTRIBUTES,
                     model: str | None = None, ratio_floor: float = 0.8) -> DataFrame:
    """Demographic-parity difference, equalized-odds difference and the
    four-fifths ratio per model and attribute (over the groups present)."""
    m = with_rates(group_rollup(_one_model(cells, model), attributes, ["model"]))
    out = m.groupBy("model", "attribute").agg(
        (F.max("selection_rate") - F.min("selection_rate")).alias("dp_diff"),
        F.greatest(F.max("tpr") - F.min("tpr"), F.max("fpr") - F.min("fpr")).alias("eo_diff"),
        F.try_divide(F.min("selection_rate"), F.max("selection_rate")).alias("four_fifths_ratio"),
        F.min(F.struct("selection_rate", "group_label"))["group_label"].alias("min_group"),
        F.max(F.struct("selection_rate", "group_label"))["group_label"].alias("max_group"),
    )
    return out.withColumn("passes_four_fifths", F.col("four_fifths_ratio") >= F.lit(ratio_floor))


def model_comparison(cells: DataFrame, full: str = "full", blind: str = "blind",
                     attributes: dict[str, str] = AUDIT_ATTRIBUTES,
                     order: dict[str, list[str]] = GROUP_ORDER) -> DataFrame:
    """C10 + J2: both models' group metrics side by side with blind − full deltas.

    One conditional aggregation keyed by (attribute, group) — no join of two
    metric tables — then reindexed to the declared order.
    """
    per = with_rates(group_rollup(cells.where(F.col("model").isin(full, blind)), attributes, ["model"]))
    wide = per.groupBy("attribute", "group_label").agg(*[
        F.first(F.when(F.col("model") == m, F.col(k)), ignorenulls=True).alias(f"{p}_{k}")
        for m, p in ((full, "full"), (blind, "blind")) for k in ["n", *METRIC_NAMES]
    ])
    for k in METRIC_NAMES:
        wide = wide.withColumn(f"delta_{k}", F.col(f"blind_{k}") - F.col(f"full_{k}"))
    dims = declared_groups(cells.sparkSession, {a: order[a] for a in attributes})
    cols = ["attribute", "group_label", "group_order",
            *[f"full_{k}" for k in METRIC_NAMES], *[f"blind_{k}" for k in METRIC_NAMES],
            *[f"delta_{k}" for k in METRIC_NAMES]]
    return dims.join(wide, ["attribute", "group_label"], "left").select(*cols)


def pair_gap(cells: DataFrame, attribute_column: str = "race", first: str = "White",
             second: str = "Black", metric: str = "selection_rate") -> DataFrame:
    """C11: metric(first) − metric(second) per model (conditional aggregation)."""
    per = with_rates(rollup(cells.where(F.col(attribute_column).isin(first, second)),
                            "model", attribute_column))
    return per.groupBy("model").agg(
        F.first(F.when(F.col(attribute_column) == first, F.col(metric)), ignorenulls=True).alias("first_value"),
        F.first(F.when(F.col(attribute_column) == second, F.col(metric)), ignorenulls=True).alias("second_value"),
    ).select("model", F.lit(first).alias("first_group"), F.lit(second).alias("second_group"),
             "first_value", "second_value", (F.col("first_value") - F.col("second_value")).alias("gap"))


def intersection_cells(cells: DataFrame, parts: list[str], include_other: bool = False) -> DataFrame:
    """Cells rolled to an intersection label (P16 + P18): race without 'Other'
    unless ``include_other``; NULL when any part is NULL."""
    cols = [F.when(F.col(p) != "Other", F.col(p)) if (p == "race" and not include_other) else F.col(p)
            for p in parts]
    keyed = cells.withColumn("intersection", intersection_label(*cols))
    return rollup(keyed.where(F.col("intersection").isNotNull()), "model", "intersection")


def intersectional_metrics(cells: DataFrame, parts: list[str], model: str | None = None,
                           min_size: int = MIN_GROUP_SIZE, include_other: bool = False) -> DataFrame:
    """Per model and intersection count, accuracy, selection rate, TPR,
    FPR, approved and denied counts; groups under ``min_size`` left out; ordered
    by model and selection rate."""
    m = with_rates(intersection_cells(_one_model(cells, model), parts, include_other))
    return (m.where(F.col("n") >= min_size)
            .select("model", "intersection", F.col("n").alias("count"), "accuracy", "selection_rate", "tpr", "fpr",
                    (F.col("tp") + F.col("fp")).alias("approved"),
                    (F.col("n") - F.col("tp") - F.col("fp")).alias("denied"))
            .orderBy("model", "selection_rate", "intersection"))


def intersectional_gap(cells: DataFrame, parts: list[str], model: str | None = None,
                       min_size: int = MIN_GROUP_SIZE) -> DataFrame:
    """Each model's extreme selection-rate gap across intersections, with the groups."""
    m = intersectional_metrics(cells, parts, model, min_size)
    return m.groupBy("model").agg(
        F.min(F.struct("selection_rate", "intersection"))["intersection"].alias("min_group"),
        F.min("selection_rate").alias("min_selection_rate"),
        F.max(F.struct("selection_rate", "intersection"))["intersection"].alias("max_group"),
        F.max("selection_rate").alias("max_selection_rate"),
    ).withColumn("gap", F.col("max_selection_rate") - F.col("min_selection_rate"))


__all__ = [
    "AUDIT_ATTRIBUTES", "METRIC_NAMES", "MEASURES", "with_rates", "declared_groups", "group_rollup",
    "group_metrics", "fairness_summary", "model_comparison", "pair_gap", "intersection_cells",
    "intersectional_metrics", "intersectional_gap",
]
