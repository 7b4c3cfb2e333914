"""Fitted models: missing inputs, patience, audit of their own scores."""

import os

import pytest
from pyspark.sql import functions as F

from equitally.operators import models as mdl
from equitally.operators.cells import LABEL_SOURCES
from equitally.operators.metrics import ranking_metrics
from equitally.plans.audit import audit_report


@pytest.fixture(scope="module")
def rows(spark):
    """Applications whose outcome follows income, with some inputs missing."""
    return spark.createDataFrame([
            (i, float(i * 37 % 400) if i % 97 else None, [48029, 48113, 48201, 48453][i % 4] if i != 5 else None,
             ["White", "Black or African American", "Asian"][i % 3], ["Male", "Female"][i % 2], float(i % 5 + 1),
             int(i * 37 % 400 + i * 7919 % 150 > 275)) for i in range(1500)],
            "app_id long, income double, county_code int, derived_race string, derived_sex string, applicant_age double, target int").coalesce(2)


TRAINERS = {
    "logistic": lambda t: mdl.train_logistic(t, max_iter=50),
    "forest": lambda t: mdl.train_forest(t, num_trees=10, max_depth=5),
    "gbt": lambda t: mdl.train_gbt(t, max_iter=8, step=0.3, max_depth=3),
    "blind": lambda t: mdl.train_blind(t, max_iter=8, step=0.3, max_depth=3),
}


@pytest.mark.parametrize("kind", list(TRAINERS))
def test_trains_with_missing_numbers_and_ranks_well(rows, kind):
    m = TRAINERS[kind](rows)
    scored = mdl.score(m, rows)
    assert scored.count() == 1500 and scored.where("p is null or isnan(p) or yhat <> cast(p >= 0.5 as int)").count() == 0
    assert ranking_metrics(scored).first()["roc_auc"] > 0.9
    if kind in ("gbt", "blind"):
        assert m.rounds == 8 and m.classifier.getNumTrees == m.best_iteration + 1


def test_registered_models_are_fitted_with_all_rounds(rows, monkeypatch):
    """The queries boost as the trainers do by default: 600 rounds of 0.05, patience 30."""
    from pyspark.ml.classification import GBTClassifier

    from equitally.plans import prepare, train

    monkeypatch.setattr(prepare, "train_test", lambda spark, sf_dir: (rows, rows))
    monkeypatch.setattr(train, "_FITTED", {})
    monkeypatch.setattr(mdl, "ROUND_STEPS", ())
    asked, given = [], []

    class Enough(Exception):
        pass

    def fit(self, df, *a):
        asked.append((self.getMaxIter(), self.getStepSize(), self.getMaxDepth(), self.getSubsamplingRate()))
        raise Enough

    monkeypatch.setattr(GBTClassifier, "fit", fit)
    for kind in ("gbt", "blind"):
        with pytest.raises(Enough):
            train.fitted_model(rows.sparkSession, "nowhere", kind)
        monkeypatch.setitem(train.TRAINERS, kind, lambda t, **settings: given.append(settings))
        train.fitted_model(rows.sparkSession, "nowhere", kind)
    assert asked == [(600, 0.05, 6, 0.9)] * 2
    assert given == [{}, {}] and mdl.PATIENCE == 30


def test_patience():
    assert mdl.best_round([5, 4, 3, 4, 5, 2], 2) == (2, True)
    assert mdl.best_round([5, 4, 3, 4, 5, 2], 3) == (5, False)
    assert mdl.best_round([1], 30) == (0, False)


def test_audit_of_long_scores_equals_recomputed_rates(rows):
    parts = [mdl.score(TRAINERS[k](rows), rows, keep=LABEL_SOURCES) for k in ("gbt", "blind")]
    scored = parts[0].unionByName(parts[1])
    report = audit_report(scored, None, champion="gbt", blind="blind")
    race = {"White": "White", "Black or African American": "Black", "Asian": "Asian"}
    want = {}
    for r in scored.collect():
        if r["model"] == "gbt":
            n = want.setdefault(race[r["derived_race"]], [0, 0])
            n[0], n[1] = n[0] + 1, n[1] + r["yhat"]
    got = {r["group_label"]: (r["n"], r["selection_rate"]) for r in report.group_metrics.where("attribute = 'Race' and n > 0").collect()}
    assert got == {k: (n, pytest.approx(a / n)) for k, (n, a) in want.items()}
    assert {r["model"] for r in report.group_metrics.collect()} == {"gbt"}


def test_a_saved_scorer_is_loaded_once_in_a_worker(spark, tmp_path):
    saved, marks = tmp_path / "scorer-of-this-test.txt", tmp_path / "marks"
    saved.write_text("0.25")
    marks.mkdir()

    def load(path):
        import numpy as np
        step = float(open(path).read())
        open(marks / f"load-{os.getpid()}", "a").write(".")

        def predict(x):
            assert len(x) <= 100
            return np.nan_to_num(x[:, 0], nan=4.0) * step
        return predict

    df = spark.range(20_000).repartition(16).select(
        F.col("id").alias("app_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).cast("int").alias("a.b"),
        (F.col("id") * 2.0).alias("other"), (F.col("id") % 2).alias("target"))
    out = mdl.score_with_saved(df, str(saved), load, ["a.b", "other"], "saved", batch_rows=100)
    got = {r.app_id: (r.y, r.p, r.yhat) for r in out.collect()}
    assert got == {i: (i % 2, p, int(p >= 0.5)) for i in range(20_000) for p in [(i % 3 if i % 7 else 4) * 0.25]}
    assert {f.read_text() for f in marks.iterdir()} == {"."} and len(list(marks.iterdir())) <= 16
    assert mdl.score_with_saved(df.limit(0), str(saved), load, ["a.b", "other"], "saved").count() == 0
    with pytest.raises(ValueError):
        mdl.score_with_saved(df, str(saved), load, ["a.b", "other"], "saved", width=2)


def test_a_saved_scorer_takes_null_numbers_and_arrays(spark, tmp_path):
    saved = tmp_path / "scorer-of-arrays.txt"
    saved.write_text("0.5")

    def load(path):
        import numpy as np
        step = float(open(path).read())
        return lambda x: np.nan_to_num(x, nan=0.25).sum(axis=1) * step

    df = spark.createDataFrame([(1, [1.0, 0.5], 1), (2, None, 0), (3, [None, 1.5], None)], "app_id long, x array<double>, target int")
    out = mdl.score_with_saved(df, str(saved), load, ["x"], "saved", width=2)
    assert {r.app_id: (r.y, r.p) for r in out.collect()} == {1: (1, 0.75), 2: (0, 0.25), 3: (None, 0.875)}


def test_a_saved_folder_reaches_executors_that_are_other_processes(tmp_path):
    """Spark sends no local folder in a cluster; the scorer's folder is one."""
    import subprocess
    import sys

    code = f"""
import os
from pyspark.sql import SparkSession
from equitally.operators.models import score_with_saved
root = {str(tmp_path)!r}
spark = (SparkSession.builder.master("local-cluster[2,1,1200]").config("spark.ui.enabled", "false").config("spark.executor.memory", "700m")
         .config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", root + "/kept").getOrCreate())
os.makedirs(root + "/a scorer/inner")
for name, value in (("one", 0.25), ("inner/two", 0.5)):
    with open(root + "/a scorer/" + name, "w") as out:
        out.write(str(value))

def load(folder):
    import numpy as np
    total = sum(float(open(os.path.join(folder, name)).read()) for name in ("one", "inner/two"))
    return lambda x: np.full(len(x), total)

df = spark.range(40).selectExpr("id as app_id", "cast(id as double) as x", "1 as target").repartition(4)
for path in (root + "/a scorer", "file://" + root + "/a%20scorer/"):
    assert [r.p for r in score_with_saved(df, path, load, ["x"], "saved").collect()] == [0.75] * 40, path
spark.stop()
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=tmp_path,
                          env={**os.environ, "PYTHONPATH": root})
    assert done.returncode == 0, done.stderr[-1500:]
