"""

Every query reads the driver tables in ``sf_dir`` through the stand-in
application view (``equitally.sources.fixtures``) and runs the library's own
operators on all of its rows.  Doubles are rounded to nine places so the
Spark and DuckDB results hash alike.
"""

from __future__ import annotations

import importlib
import os
import sys
from collections.abc import Callable

# the package and the oracle module live next to this file; make them
# importable however the driver loads it
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import sql_oracles as O
from equitally.operators import calibration as cal
from equitally.operators import fairness as fair
from equitally.operators import metrics as met
from equitally.functions import labels as lab
from equitally.functions.cleaning import ordinal_age, range_midpoint, to_double
from equitally.functions.thresholds import predict_at
from equitally.operators import clean as cln
from equitally.operators import sampling as smp
from equitally.operators.cells import audit_cells, audit_rows
from equitally.operators.stats import exact_medians
from equitally.plans.audit import STANDIN_SCORES, cells_for, cleaned_applications
from equitally.plans.prepare import split_applications
from equitally.sources import ingest
from equitally.sources.fixtures import application_view

FLAGSHIP_SF = "/root/testdata/sf0.001"


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """Round every DOUBLE column (so both engines hash the same digits)."""
    return df.select(*[
        F.round(F.col(f.name), places).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


# --------------------------------------------------------------------------- #
# Shared inputs
# --------------------------------------------------------------------------- #

def _cells(spark: SparkSession, sf_dir: str, two_models: bool = False) -> DataFrame:
    cleaned = cleaned_applications(spark, sf_dir)
    return cells_for(cleaned, STANDIN_SCORES if two_models else "y_prob")


# --------------------------------------------------------------------------- #
# C: group fairness
# --------------------------------------------------------------------------- #

def q_c5_metric_frame(spark, sf_dir):
    return rounded(fair.group_metrics(_cells(spark, sf_dir, two_models=True)))


def _metric_only(metric):
    def run(spark, sf_dir):
        gm = fair.group_metrics(_cells(spark, sf_dir, two_models=True))
        return rounded(gm.select("model", "attribute", "group_label", "group_order", metric))
    return run


def q_c8_fairness_summary(spark, sf_dir):
    return rounded(fair.fairness_summary(_cells(spark, sf_dir, two_models=True)))


def q_c10_model_comparison(spark, sf_dir):
    return rounded(fair.model_comparison(_cells(spark, sf_dir, two_models=True)))


def q_c11_pair_gap(spark, sf_dir):
    return rounded(fair.pair_gap(_cells(spark, sf_dir, two_models=True)))


def q_c12_race_gender(spark, sf_dir):
    return rounded(fair.intersectional_metrics(_cells(spark, sf_dir, two_models=True), ["race", "gender"]))


def q_c12_race_age(spark, sf_dir):
    return rounded(fair.intersectional_metrics(_cells(spark, sf_dir, two_models=True), ["race", "age"]))


def q_c15_intersection_gap(spark, sf_dir):
    return rounded(fair.intersectional_gap(_cells(spark, sf_dir, two_models=True), ["race", "age"]))


# --------------------------------------------------------------------------- #
# D: calibration
# --------------------------------------------------------------------------- #

def q_d5_calibration_table(spark, sf_dir):
    return rounded(cal.calibration_table(_cells(spark, sf_dir)))


def q_d2_calibration_bins(spark, sf_dir):
    return rounded(cal.calibration_bins(_cells(spark, sf_dir)))


def q_d6_reliability_curve(spark, sf_dir):
    return rounded(cal.reliability_curve(_cells(spark, sf_dir)))


def q_d1_overall_calibration(spark, sf_dir):
    return rounded(cal.overall_calibration(_cells(spark, sf_dir, two_models=True)))


# --------------------------------------------------------------------------- #
# B: classification metrics (both stand-in models, keyed by model)
# --------------------------------------------------------------------------- #

def _scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_rows(cleaned_applications(spark, sf_dir), STANDIN_SCORES)


def q_b1_confusion_matrix(spark, sf_dir):
    return met.confusion_matrix(_scored_rows(spark, sf_dir))


def q_b2_classification_metrics(spark, sf_dir):
    return rounded(met.classification_metrics(_scored_rows(spark, sf_dir)))


def q_b3_classification_report(spark, sf_dir):
    return rounded(met.classification_report(_scored_rows(spark, sf_dir)))


def q_b5_ranking_metrics(spark, sf_dir):
    return rounded(met.ranking_metrics(_scored_rows(spark, sf_dir)))


def q_b7_roc_curve(spark, sf_dir):
    return rounded(met.roc_curve(_scored_rows(spark, sf_dir)))


def q_b8_pr_curve(spark, sf_dir):
    return rounded(met.pr_curve(_scored_rows(spark, sf_dir)))


def q_b9_curve_area(spark, sf_dir):
    pts = met.roc_curve(_scored_rows(spark, sf_dir))
    return rounded(met.curve_area(pts, "fpr", "tpr"))


def q_b10_leaderboard(spark, sf_dir):
    return rounded(met.leaderboard(_scored_rows(spark, sf_dir)))


# --------------------------------------------------------------------------- #
# P: cleaning rules, labels, thresholds
# --------------------------------------------------------------------------- #

def _normalized(spark, sf_dir):
    return cln.normalize_na_tokens(application_view(spark, sf_dir))


def q_p1_decision_filter(spark, sf_dir):
    return cln.decision_filter(_normalized(spark, sf_dir)).select("app_id", "action_taken")


def q_p2_binary_target(spark, sf_dir):
    d = cln.add_target(cln.decision_filter(_normalized(spark, sf_dir)))
    return d.select("app_id", "target")


def q_p3_drop_leakage(spark, sf_dir):
    return rounded(cln.drop_leakage(application_view(spark, sf_dir)))


def q_p7_ordinal_age(spark, sf_dir):
    v = _normalized(spark, sf_dir)
    return v.select("app_id", ordinal_age("applicant_age").alias("applicant_age"),
                    ordinal_age("co-applicant_age").alias("co-applicant_age"))


def q_p8_range_midpoint(spark, sf_dir):
    v = _normalized(spark, sf_dir)
    return rounded(v.select("app_id", range_midpoint("debt_to_income_ratio").alias("debt_to_income_ratio"),
                            range_midpoint("total_units").alias("total_units")))


def q_p9_numeric_coercion(spark, sf_dir):
    v = _normalized(spark, sf_dir)
    return rounded(v.select("app_id", *[to_double(c, v.schema[c].dataType).alias(c)
                                        for c in ("income", "property_value", "loan_term", "loan_amount")]))


def q_p10_medians(spark, sf_dir):
    prepared = cln.prepare_features(application_view(spark, sf_dir))
    cols = [c for c in O.IMPUTED if c in prepared.columns]
    med = exact_medians(prepared, cols)
    return rounded(spark.range(1).select(*[F.lit(med[c]).cast("double").alias(c) for c in cols]))


def q_p11_clean_table(spark, sf_dir):
    return rounded(cleaned_applications(spark, sf_dir))


def q_p12_na_tokens(spark, sf_dir):
    v = _normalized(spark, sf_dir)
    return v.select("app_id", *O.STRING_VIEW_COLS)


def q_p13_p18_audit_labels(spark, sf_dir):
    c = cleaned_applications(spark, sf_dir)
    race3 = lab.race_label("derived_race", include_other=False)
    return c.select(
        "app_id",
        lab.age_label("applicant_age").alias("age"),
        lab.county_label("county_code").alias("county"),
        lab.race_label("derived_race").alias("race"),
        race3.alias("race3"),
        lab.gender_label("derived_sex").alias("gender"),
        lab.intersection_label(race3, lab.gender_label("derived_sex")).alias("race_gender"),
        lab.intersection_label(race3, lab.age_label("applicant_age")).alias("race_age"))


def q_p20_threshold(spark, sf_dir):
    c = cleaned_applications(spark, sf_dir)
    return c.select("app_id", predict_at("y_prob").alias("yhat"))


def q_p23_shape_report(spark, sf_dir):
    view = application_view(spark, sf_dir)
    n_clean_cols = len(cln.prepare_features(view).columns)
    return cln.shape_report(view, n_clean_cols)


# --------------------------------------------------------------------------- #
# S: sources
# --------------------------------------------------------------------------- #

def q_s4_payload_rejection(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return pages.select("page_id", ingest.is_html_payload("html").alias("rejected"),
                        ingest.is_html_payload("html", strict=True).alias("rejected_strict"))


def q_s5_rows_per_county(spark, sf_dir):
    return ingest.rows_per_county(application_view(spark, sf_dir, ["county_code"]))


# --------------------------------------------------------------------------- #
# J, F: category domains, splits, samples
# --------------------------------------------------------------------------- #

def _split(spark, sf_dir):
    return split_applications(spark, sf_dir)


def q_f1_stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("app_id", "target", "split")


def q_f2_split_report(spark, sf_dir):
    return rounded(smp.split_report(_split(spark, sf_dir)))


def q_f3_stratified_sample(spark, sf_dir):
    return smp.stratified_sample(cleaned_applications(spark, sf_dir), 1000).select("app_id", "target")


def q_f4_uniform_sample(spark, sf_dir):
    return smp.uniform_sample(cleaned_applications(spark, sf_dir), 300).select("app_id", "target")


def q_j4_category_domain(spark, sf_dir):
    from equitally.operators.features import category_domain
    sp = _split(spark, sf_dir)
    return category_domain(sp.where("split = 'train'"), sp.where("split = 'test'"), "conforming_loan_limit")


def q_j5_label_codes(spark, sf_dir):
    from equitally.operators.features import factorize
    sp = _split(spark, sf_dir)
    codes = factorize(sp.where("split = 'train'"), sp.where("split = 'test'"), "derived_race")
    return codes


def q_j5_first_seen_codes(spark, sf_dir):
    from equitally.operators.features import first_seen_codes
    sp = _split(spark, sf_dir)
    return first_seen_codes(sp.where("split = 'train'"), sp.where("split = 'test'"), "derived_race", "app_id")


# --------------------------------------------------------------------------- #
# Features (fitted on the train split, applied to every row)
# --------------------------------------------------------------------------- #

def _train(spark, sf_dir):
    sp = _split(spark, sf_dir)
    return sp, sp.where("split = 'train'")


def q_f5_standard_scaling(spark, sf_dir):
    from equitally.operators import features as fx
    from equitally.operators.models import feature_columns
    sp, train = _train(spark, sf_dir)
    numeric, _ = feature_columns(train)
    stats = fx.fit_standard_scaler(train, numeric)
    return rounded(fx.apply_standard_scaler(sp, stats).select("app_id", *numeric))


def q_f6_one_hot(spark, sf_dir):
    from equitally.operators import features as fx
    sp, train = _train(spark, sf_dir)
    cols = ["conforming_loan_limit", "derived_race"]
    model = fx.fit_pipeline(train, fx.one_hot_stages(cols))
    out = model.transform(sp)
    for c in cols:
        out = fx.one_hot_index(out, f"{c}__ohe")
    return out.select("app_id", *[x for c in cols for x in (f"{c}__ohe_hot", f"{c}__ohe_size")])


def q_f7_ordinal_codes(spark, sf_dir):
    from equitally.operators import features as fx
    sp, train = _train(spark, sf_dir)
    m = fx.fit_pipeline(train, [fx.string_indexer("conforming_loan_limit")])
    n_levels = len(m.stages[0].labels)
    out = fx.ordinal_codes(m.transform(sp), "conforming_loan_limit__idx", n_levels, "conforming_loan_limit_code")
    return out.select("app_id", "conforming_loan_limit_code")


def q_f9_balanced_weights(spark, sf_dir):
    from equitally.operators import features as fx
    _, train = _train(spark, sf_dir)
    return rounded(fx.balanced_weights(train).select("app_id", "target", "weight"))


def q_f10_positive_weight(spark, sf_dir):
    from equitally.operators import features as fx
    _, train = _train(spark, sf_dir)
    return rounded(fx.positive_class_weight(train).select("app_id", "target", "weight"))


def q_m4_validation_indicator(spark, sf_dir):
    from equitally.operators.models import validation_indicator
    _, train = _train(spark, sf_dir)
    return validation_indicator(train).select("app_id", "is_validation")


# --------------------------------------------------------------------------- #
# M, E: models, scores, attribution (rows-only checks: no SQL equivalent)
# --------------------------------------------------------------------------- #

def _fit(spark, sf_dir, kind):
    from equitally.plans.prepare import train_test
    from equitally.plans.train import fitted_model
    _, test = train_test(spark, sf_dir)
    return fitted_model(spark, sf_dir, kind), test


def _as_table(spark, sf_dir, kind):
    """The fitted model as a table, left for the SQL that scores the same rows:
    nodes of trees, or coefficients."""
    from equitally.operators.explain import coefficient_table
    from equitally.operators.trees import node_table
    from equitally.session import model_tables
    m, test = _fit(spark, sf_dir, kind)
    if kind == "logistic":
        table = coefficient_table(m, test, None).select("feature", "coefficient") \
            .unionByName(spark.createDataFrame([("intercept", float(m.classifier.intercept))], "feature string, coefficient double"))
    else:
        table = node_table(spark, m.classifier, m.inputs)
    table.coalesce(1).write.mode("overwrite").parquet(f"{model_tables(spark)}/{kind}")
    return table


def _scores(kind):
    def run(spark, sf_dir):
        from equitally.operators.models import score
        m, test = _fit(spark, sf_dir, kind)
        _as_table(spark, sf_dir, kind)
        return rounded(score(m, test))
    return run


def q_m1_optimum(spark, sf_dir):
    """The fitted coefficients, and whether the loss's gradient vanishes there."""
    from equitally.operators.models import optimum_table
    from equitally.plans.prepare import train_test
    m, _ = _fit(spark, sf_dir, "logistic")
    _as_table(spark, sf_dir, "logistic")
    return rounded(optimum_table(m, train_test(spark, sf_dir)[0])).select(
        "feature", "coefficient", (F.abs("gradient") < 1e-4).alias("at_optimum"))


def _boosted(spark, sf_dir, kind="gbt"):
    from equitally.operators.trees import Walk
    from equitally.plans.prepare import train_test
    m, _ = _fit(spark, sf_dir, kind)
    train, _ = train_test(spark, sf_dir)
    return m, Walk(_as_table(spark, sf_dir, kind)), train


def q_m3_round_auc(spark, sf_dir):
    """Held-out ROC-AUC after every kept round, in one pass over the rows."""
    from equitally.operators.models import validation_indicator
    from equitally.operators.trees import auc_by_round
    m, walk, train = _boosted(spark, sf_dir)
    held_out = validation_indicator(train).where("is_validation")
    return rounded(auc_by_round(walk, m.model.transform(held_out), "target"))


def q_m3_newton_leaves(spark, sf_dir):
    """Second-order values of every leaf of the champion over the train rows."""
    from equitally.operators.features import positive_class_weight
    from equitally.operators.trees import newton_leaves
    m, walk, train = _boosted(spark, sf_dir)
    rows = m.model.transform(positive_class_weight(train, output="weight"))
    return rounded(newton_leaves(walk, rows, "target", "weight"), 6)


def q_f11_feature_names(spark, sf_dir):
    from equitally.operators.explain import slot_names
    m, test = _fit(spark, sf_dir, "logistic")
    names = slot_names(m, test)
    schema = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("feature", T.StringType())])
    return spark.createDataFrame(list(enumerate(names)), schema)


def q_m6_model_leaderboard(spark, sf_dir):
    from equitally.operators.models import score
    from equitally.plans.prepare import train_test
    from equitally.plans.train import fitted_model
    for kind in ("logistic", "gbt", "blind"):
        _as_table(spark, sf_dir, kind)
    _, test = train_test(spark, sf_dir)
    scored = score(fitted_model(spark, sf_dir, "logistic"), test) \
        .unionByName(score(fitted_model(spark, sf_dir, "gbt"), test)) \
        .unionByName(score(fitted_model(spark, sf_dir, "blind"), test))
    return rounded(met.leaderboard(scored))


def q_m7_function_scores(spark, sf_dir):
    import numpy as np
    from equitally.operators.models import score_with_function
    m, test = _fit(spark, sf_dir, "logistic")
    _as_table(spark, sf_dir, "logistic")
    lr = m.classifier
    # an external scorer: the fitted coefficients applied in numpy per Arrow batch
    prepared = m.model.transform(test).select("app_id", "target", vector_to_array("features").alias("x"))
    w, b = np.array(lr.coefficients.toArray()), float(lr.intercept)

    def predict(pdf):
        x = np.vstack(pdf["x"].to_numpy())
        return 1.0 / (1.0 + np.exp(-(x @ w + b)))

    return rounded(score_with_function(prepared, predict, ["x"], "logistic_numpy", batch_rows=1000))


def _load_logistic(folder):
    """A scorer from a saved table (position, coefficient); the last row is the intercept."""
    import numpy as np
    import pyarrow.parquet as pq
    table = pq.read_table(folder).sort_by("position")
    *w, b = table["coefficient"].to_pylist()
    return lambda x: 1.0 / (1.0 + np.exp(-(x @ np.array(w) + b)))


def q_m7_saved_scores(spark, sf_dir):
    """A scorer left in the shared folder and loaded once by every worker."""
    from equitally.operators.models import score_with_saved
    from equitally.session import write_table
    m, test = _fit(spark, sf_dir, "logistic")
    _as_table(spark, sf_dir, "logistic")
    values = [*m.classifier.coefficients.toArray().tolist(), float(m.classifier.intercept)]
    saved = write_table(spark.createDataFrame(list(enumerate(values)), "position int, coefficient double").coalesce(1), "scorer")
    prepared = m.model.transform(test).select("app_id", "target", vector_to_array("features").alias("x"))
    folder = os.path.dirname(saved.inputFiles()[0])
    return rounded(score_with_saved(prepared, folder, _load_logistic, ["x"], "logistic_saved", width=len(values) - 1))


def q_m_score_contracts(spark, sf_dir):
    """Every fitted model scores every test row: keys, labels and the two rules
    that hold whatever the model (its scores themselves have no SQL)."""
    from equitally.operators.models import score
    parts = []
    for kind in ("logistic", "forest", "gbt", "blind"):
        m, test = _fit(spark, sf_dir, kind)
        parts.append(score(m, test))
    scored = parts[0]
    for more in parts[1:]:
        scored = scored.unionByName(more)
    return scored.select("app_id", "model", "y", F.col("p").between(0.0, 1.0).alias("p_in_unit"),
                         (F.col("yhat") == (F.col("p") >= 0.5).cast("int")).alias("yhat_at_half"))


def q_m3_rounds(spark, sf_dir):
    """Boosting rounds of the champion and the blind model: fitted, kept, trees."""
    from equitally.plans.train import fitted_model
    rows = [(k, m.rounds, m.best_iteration, m.classifier.getNumTrees) for k in ("gbt", "blind") for m in [fitted_model(spark, sf_dir, k)]]
    return spark.createDataFrame(rows, "model string, rounds int, best_iteration int, trees int")


# --- the audit of the fitted champion and blind model ---------------------- #

def _fitted_cells(spark, sf_dir):
    from equitally.operators.cells import LABEL_SOURCES, scored_audit_rows
    from equitally.operators.models import score
    parts = []
    for kind in ("gbt", "blind"):
        m, test = _fit(spark, sf_dir, kind)
        parts.append(score(m, test, keep=LABEL_SOURCES))
    return audit_cells(scored_audit_rows(parts[0].unionByName(parts[1])))


def _all_in_unit(*names):
    ok = F.lit(True)
    for n in names:
        ok = ok & F.coalesce(F.col(n).between(0.0, 1.0), F.lit(True))
    return ok


def q_c5_fitted(spark, sf_dir):
    m = fair.group_metrics(_fitted_cells(spark, sf_dir))
    return m.select("model", "attribute", "group_label", "group_order", "n",
                    _all_in_unit("accuracy", "selection_rate", "tpr", "fpr").alias("rates_in_unit"))


def q_c10_fitted(spark, sf_dir):
    c = fair.model_comparison(_fitted_cells(spark, sf_dir), full="gbt", blind="blind")
    agree = F.lit(True)
    for k in ("accuracy", "selection_rate", "tpr", "fpr"):
        agree = agree & F.coalesce(F.abs(F.col(f"blind_{k}") - F.col(f"full_{k}") - F.col(f"delta_{k}")) < 1e-12, F.lit(True))
    return c.select("attribute", "group_label", "group_order", F.col("full_accuracy").isNotNull().alias("present"), agree.alias("deltas_agree"))


def q_c12_fitted(spark, sf_dir):
    m = fair.intersectional_metrics(_fitted_cells(spark, sf_dir), ["race", "age"])
    return m.select("model", "intersection", "count", (F.col("approved") + F.col("denied") == F.col("count")).alias("decisions_add_up"))


def q_d5_fitted(spark, sf_dir):
    t = cal.calibration_table(_fitted_cells(spark, sf_dir))
    return rounded(t.select("model", "attribute", "group_label", "sample_size", "actual_approval_rate",
                            _all_in_unit("mean_predicted_probability", "ece", "brier_score").alias("in_unit")))


# --- the same path for a scorer that SQL knows ----------------------------- #

CLOSED_FORM_INPUTS = ["income", "debt_to_income_ratio", "loan_amount"]


def _closed_form(pdf):
    import numpy as np
    z = (pdf["income"] - 345.0) / 80.0 - (pdf["debt_to_income_ratio"] - 38.0) / 30.0 + (pdf["loan_amount"] - 140000.0) / 200000.0
    return 1.0 / (1.0 + np.exp(-z))


def _closed_scores(rows, keep):
    from equitally.operators.models import score_with_function
    return score_with_function(rows, _closed_form, CLOSED_FORM_INPUTS, "closed", keep=keep, batch_rows=4096)


def q_m7_closed_form(spark, sf_dir):
    return rounded(_closed_scores(cleaned_applications(spark, sf_dir), ("app_id",)).select("app_id", "model", "y", "p", "yhat"))


def _closed_cells(spark, sf_dir):
    from equitally.operators.cells import LABEL_SOURCES, scored_audit_rows
    return audit_cells(scored_audit_rows(_closed_scores(cleaned_applications(spark, sf_dir), LABEL_SOURCES)))


def q_c5_closed_form(spark, sf_dir):
    return rounded(fair.group_metrics(_closed_cells(spark, sf_dir)))


def q_c8_closed_form(spark, sf_dir):
    return rounded(fair.fairness_summary(_closed_cells(spark, sf_dir)))


def q_c12_closed_form(spark, sf_dir):
    return rounded(fair.intersectional_metrics(_closed_cells(spark, sf_dir), ["race", "age"]))


def q_d5_closed_form(spark, sf_dir):
    return rounded(cal.calibration_table(_closed_cells(spark, sf_dir)))


def q_e4_closed_form(spark, sf_dir):
    from equitally.operators.explain import importance_from_scores
    return rounded(importance_from_scores(_closed_scores, cleaned_applications(spark, sf_dir), CLOSED_FORM_INPUTS))


def q_e5_closed_form(spark, sf_dir):
    """Exact Shapley values of the closed-form scorer, three rows as background."""
    from equitally.operators.explain import exact_shapley
    rows = cleaned_applications(spark, sf_dir)
    return rounded(exact_shapley(_closed_scores, rows, smp.uniform_sample(rows, 3), CLOSED_FORM_INPUTS))


def q_e6_top_lenders(spark, sf_dir):
    """E6 over more rows than its limit: the applicants with the highest mean score."""
    from equitally.operators.explain import top_n
    v = application_view(spark, sf_dir, ["lei", "y_prob"])
    return rounded(top_n(v.groupBy("lei").agg(F.round(F.avg("y_prob"), 9).alias("mean_score")), "mean_score", 20))


def q_e1_top_coefficients(spark, sf_dir):
    from equitally.operators.explain import coefficient_table
    m, test = _fit(spark, sf_dir, "logistic")
    _as_table(spark, sf_dir, "logistic")
    return rounded(coefficient_table(m, test, 20))


def _gains(kind, n):
    def run(spark, sf_dir):
        from equitally.operators.explain import top_n
        from equitally.operators.trees import gain_table
        gains = gain_table(_as_table(spark, sf_dir, kind), per_tree=kind == "forest").withColumn("decrease", F.round("decrease", 6))
        return rounded(top_n(gains, "importance", n) if n else gains)
    return run


def q_e4_permutation_importance(spark, sf_dir):
    from equitally.operators.explain import permutation_importance
    m, test = _fit(spark, sf_dir, "gbt")
    return rounded(permutation_importance(m, test))


def q_e5_shapley_summary(spark, sf_dir):
    from equitally.operators.explain import sampled_shapley, shapley_summary
    m, test = _fit(spark, sf_dir, "gbt")
    return rounded(shapley_summary(sampled_shapley(m, test, background_size=100, permutations=8)))


def q_e6_top_importance(spark, sf_dir):
    from equitally.operators.explain import importance_table, top_n
    m, test = _fit(spark, sf_dir, "gbt")
    return rounded(top_n(importance_table(m, test, None, column="gain"), "gain", 20))


# --------------------------------------------------------------------------- #
# Second input: labels (quality = y, toxic = ŷ) grouped by documents.lang
# --------------------------------------------------------------------------- #

def _label_rows(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return labels.join(docs, "doc_id", "left").select(
        F.lit("labels").alias("model"), F.col("quality").cast("int").alias("y"),
        F.col("toxic").cast("int").alias("yhat"), "lang")


def q_b2_label_metrics(spark, sf_dir):
    return rounded(met.classification_metrics(_label_rows(spark, sf_dir)))


def q_c1_c4_rates_by_lang(spark, sf_dir):
    from equitally.operators.cells import rollup
    rows = _label_rows(spark, sf_dir).withColumn("p", F.col("yhat").cast("double"))
    cells = audit_cells(rows, keys=["model", "lang"])
    return rounded(fair.with_rates(rollup(cells, "lang")).select(
        "lang", "n", "accuracy", "selection_rate", "tpr", "fpr"))


# --------------------------------------------------------------------------- #
# Contract
# --------------------------------------------------------------------------- #

def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the group metric frame (C1–C5, J1) on the sf0.001 tables."""
    return q_c5_metric_frame(spark, FLAGSHIP_SF)


def _training_data_modules() -> list:
    """The optional training-data queries: those of ``equitally.llm`` and the
    pipeline, where those files and the libraries that they import are there."""
    found = []
    for name in ("equitally.llm.queries", "corpus_pipeline"):
        try:
            found.append(importlib.import_module(name))
        except ModuleNotFoundError:
            continue
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "p1_decision_filter": q_p1_decision_filter,
        "p2_binary_target": q_p2_binary_target,
        "p3_drop_leakage": q_p3_drop_leakage,
        "p7_ordinal_age": q_p7_ordinal_age,
        "p8_range_midpoint": q_p8_range_midpoint,
        "p9_numeric_coercion": q_p9_numeric_coercion,
        "p10_medians": q_p10_medians,
        "p11_clean_table": q_p11_clean_table,
        "p12_na_tokens": q_p12_na_tokens,
        "p13_p18_audit_labels": q_p13_p18_audit_labels,
        "p20_threshold": q_p20_threshold,
        "p23_shape_report": q_p23_shape_report,
        "s4_payload_rejection": q_s4_payload_rejection,
        "s5_rows_per_county": q_s5_rows_per_county,
        "f1_stratified_split": q_f1_stratified_split,
        "f2_split_report": q_f2_split_report,
        "f3_stratified_sample": q_f3_stratified_sample,
        "f4_uniform_sample": q_f4_uniform_sample,
        "j4_category_domain": q_j4_category_domain,
        "j5_label_codes": q_j5_label_codes,
        "j5_first_seen_codes": q_j5_first_seen_codes,
        "f5_standard_scaling": q_f5_standard_scaling,
        "f6_one_hot": q_f6_one_hot,
        "f7_ordinal_codes": q_f7_ordinal_codes,
        "f9_balanced_weights": q_f9_balanced_weights,
        "f10_positive_weight": q_f10_positive_weight,
        "f11_feature_names": q_f11_feature_names,
        "m1_logistic_scores": _scores("logistic"),
        "m2_forest_scores": _scores("forest"),
        "m3_gbt_scores": _scores("gbt"),
        "m4_validation_indicator": q_m4_validation_indicator,
        "m5_blind_scores": _scores("blind"),
        "m6_model_leaderboard": q_m6_model_leaderboard,
        "m7_function_scores": q_m7_function_scores,
        "m7_saved_scores": q_m7_saved_scores,
        "m_score_contracts": q_m_score_contracts,
        "m3_rounds": q_m3_rounds,
        "m1_optimum": q_m1_optimum,
        "m3_round_auc": q_m3_round_auc,
        "m3_newton_leaves": q_m3_newton_leaves,
        "c5_fitted": q_c5_fitted,
        "c10_fitted": q_c10_fitted,
        "c12_fitted": q_c12_fitted,
        "d5_fitted": q_d5_fitted,
        "m7_closed_form": q_m7_closed_form,
        "c5_closed_form": q_c5_closed_form,
        "c8_closed_form": q_c8_closed_form,
        "c12_closed_form": q_c12_closed_form,
        "d5_closed_form": q_d5_closed_form,
        "e4_closed_form": q_e4_closed_form,
        "e5_closed_form": q_e5_closed_form,
        "e6_top_lenders": q_e6_top_lenders,
        "e1_top_coefficients": q_e1_top_coefficients,
        "e2_forest_importance": _gains("forest", 20),
        "e3_gbt_importance": _gains("gbt", None),
        "e4_permutation_importance": q_e4_permutation_importance,
        "e5_shapley_summary": q_e5_shapley_summary,
        "e6_top_importance": q_e6_top_importance,
        "b2_label_metrics": q_b2_label_metrics,
        "c1_c4_rates_by_lang": q_c1_c4_rates_by_lang,
        "b1_confusion_matrix": q_b1_confusion_matrix,
        "b2_classification_metrics": q_b2_classification_metrics,
        "b3_classification_report": q_b3_classification_report,
        "b5_b6_auc_average_precision": q_b5_ranking_metrics,
        "b7_roc_curve": q_b7_roc_curve,
        "b8_pr_curve": q_b8_pr_curve,
        "b9_curve_area": q_b9_curve_area,
        "b10_leaderboard": q_b10_leaderboard,
        "c1_selection_rate": _metric_only("selection_rate"),
        "c2_true_positive_rate": _metric_only("tpr"),
        "c3_false_positive_rate": _metric_only("fpr"),
        "c4_accuracy": _metric_only("accuracy"),
        "c5_metric_frame": q_c5_metric_frame,
        "c8_fairness_summary": q_c8_fairness_summary,
        "c10_model_comparison": q_c10_model_comparison,
        "c11_pair_gap": q_c11_pair_gap,
        "c12_race_gender": q_c12_race_gender,
        "c12_race_age": q_c12_race_age,
        "c15_intersection_gap": q_c15_intersection_gap,
        "d1_overall_calibration": q_d1_overall_calibration,
        "d2_calibration_bins": q_d2_calibration_bins,
        "d5_calibration_table": q_d5_calibration_table,
        "d6_reliability_curve": q_d6_reliability_curve,
    }
    for module in _training_data_modules():
        found.update(module.queries())
    return found


def oracle_sql() -> dict[str, str]:
    found = dict(O.all_sql())
    for module in _training_data_modules():
        found.update(module.oracle_sql())
    return found
