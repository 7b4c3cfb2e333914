"""Golden values: published confusion matrices and group rates recomputed
through the library's operators (rows expanded from the published counts)."""

import pytest
from pyspark.sql import functions as F

from equitally.operators import metrics as met
from equitally.operators.cells import MEASURES
from equitally.operators.fairness import fairness_summary


def rows_from_counts(spark, tn, fp, fn, tp, model="m"):
    """(model, y, yhat) rows: tn of (0,0), fp of (0,1), fn of (1,0), tp of (1,1)."""
    parts = [(0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp)]
    dfs = [spark.range(n).select(F.lit(model).alias("model"), F.lit(y).alias("y"), F.lit(p).alias("yhat"))
           for y, p, n in parts]
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def test_boosted_confusion_metrics(spark):
    rows = rows_from_counts(spark, 9107, 2390, 3597, 24001)
    m = met.classification_metrics(rows).first()
    assert m["accuracy"] == pytest.approx(0.8468602123033636, abs=1e-12)
    assert m["precision"] == pytest.approx(0.9094388238414611, abs=1e-12)
    assert m["recall"] == pytest.approx(0.869664468439742, abs=1e-12)
    assert m["f1_score"] == pytest.approx(0.8891070403230288, abs=1e-12)
    assert m["n_test"] == 39095
    assert m["positive_rate"] == pytest.approx(27598 / 39095, abs=1e-12)


def test_boosted_classification_report(spark):
    rows = rows_from_counts(spark, 9107, 2390, 3597, 24001)
    rep = {r["label"]: r for r in met.classification_report(rows).collect()}
    assert rep["0"]["precision"] == pytest.approx(0.7168608312342569, abs=1e-12)
    assert rep["0"]["recall"] == pytest.approx(0.7921196833956684, abs=1e-12)
    assert rep["0"]["f1_score"] == pytest.approx(0.7526135283665965, abs=1e-12)
    assert rep["macro avg"]["precision"] == pytest.approx(0.813149827537859, abs=1e-12)
    assert rep["macro avg"]["f1_score"] == pytest.approx(0.8208602843448126, abs=1e-12)
    assert rep["weighted avg"]["precision"] == pytest.approx(0.8528057715072744, abs=1e-12)
    assert rep["weighted avg"]["f1_score"] == pytest.approx(0.8489672294274384, abs=1e-12)
    assert rep["1"]["support"] == 27598.0


@pytest.mark.parametrize("counts,acc,f1", [
    ((8115, 3382, 6263, 21335), 0.7533, 0.8156),   # logistic
    ((8965, 2532, 4640, 22958), 0.8165, 0.8649),   # forest
    ((6915, 4582, 1821, 25777), 0.8362, 0.8895),   # tabular transformer
])
def test_other_models_confusion(spark, counts, acc, f1):
    m = met.classification_metrics(rows_from_counts(spark, *counts)).first()
    assert round(m["accuracy"], 4) == acc
    assert round(m["f1_score"], 4) == f1


def test_race_disparity_from_group_rates(spark):
    # Published race selection rates → DP difference and four-fifths ratio.
    rates = {"White": 0.7065095921028124, "Black": 0.5661375661375662, "Asian": 0.7768619370032381,
             "Other": 0.7114624505928854}
    # cells with n = 10**9 and tp+fp = rate·n reproduce the rates to 1e-9
    n = 10 ** 9
    rows = [("m", g, n, 0, 0, int(round(r * n)), 0.0, 0.0) for g, r in rates.items()]
    cells = spark.createDataFrame(rows, "model string, race string, n long, n_pos long, tp long, fp long, "
                                        "sum_p double, sum_sq double")
    for c in ["gender", "age", "county"]:
        cells = cells.withColumn(c, F.lit(None).cast("string"))
    s = fairness_summary(cells, attributes={"Race": "race"}).first()
    assert s["dp_diff"] == pytest.approx(0.2107243709, abs=1e-9)
    assert s["four_fifths_ratio"] == pytest.approx(0.7287492657, abs=1e-9)
    assert s["min_group"] == "Black" and s["max_group"] == "Asian"
    assert s["passes_four_fifths"] is False
    assert set(MEASURES) <= set(cells.columns)
