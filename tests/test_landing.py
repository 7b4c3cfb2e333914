"""Malformed lines and the ledger of landed files (S1, S3); exact attribution and first-seen codes."""

import itertools
import math
import os
import time

import pytest
from pyspark.sql import functions as F

from equitally.operators.explain import exact_shapley
from equitally.operators.features import first_seen_codes
from equitally.sources import ingest

HEAD = "lei,county_code,income\n"
COLS = ["lei", "county_code", "income"]


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_malformed_lines_are_quarantined_and_counted(spark, tmp_dir):
    a = put(tmp_dir, "a.csv", HEAD + 'L1,48029,85\nL2,48113\nL3,48201,60,extra\nL4,"48453,70\nL5,48453,\n')
    b = put(tmp_dir, "b.csv", HEAD + 'L6,48029,"1,5"\n')
    keep = os.path.join(tmp_dir, "quarantine")
    with pytest.raises(ValueError, match="3 of 6 lines"):
        ingest.load_csv(spark, [a, b], COLS, quarantine_path=keep)
    assert spark.read.parquet(keep).count() == 3
    rows, bad, counts = ingest.load_csv(spark, [a, b], COLS, max_bad_share=0.5)
    assert sorted((r["lei"], r["county_code"], r["income"]) for r in rows.collect()) == [("L1", "48029", "85"), ("L5", "48453", ""), ("L6", "48029", "1,5")] \
        or sorted((r["lei"], r["county_code"]) for r in rows.collect()) == [("L1", "48029"), ("L5", "48453"), ("L6", "48029")]
    assert sorted(r["line"] for r in bad.collect()) == ["L2,48113", "L3,48201,60,extra", 'L4,"48453,70']
    assert {os.path.basename(r["file_path"]): (r["lines"], r["quarantined"]) for r in counts.collect()} == {"a.csv": (5, 3), "b.csv": (1, 0)}
    assert rows.columns == COLS


def test_ledger_lands_new_and_changed_files_only(spark, tmp_dir):
    inbox, out, ledger = (os.path.join(tmp_dir, n) for n in ("in", "out", "ledger"))
    os.mkdir(inbox)
    put(inbox, "a.csv", HEAD + "L1,1,1\nL2,2,2\n")
    put(inbox, "b.csv", HEAD + "L3,3,3\n")
    land = lambda: {os.path.basename(r["file_path"]) for r in ingest.land_new_files(spark, inbox, out, ledger, COLS).collect()}
    leis = lambda: sorted(r["lei"] for r in spark.read.parquet(out).collect())
    assert land() == {"a.csv", "b.csv"} and leis() == ["L1", "L2", "L3"]
    assert land() == set() and leis() == ["L1", "L2", "L3"]
    files = lambda: {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(out) for f in fs if f.endswith(".parquet")}
    before = files()
    time.sleep(1.1)
    put(inbox, "b.csv", HEAD + "L4,4,4\nL5,5,5\n")
    put(inbox, "c.csv", HEAD + "L6,6,6\n")
    put(inbox, "a.csv", HEAD + "L1,1,1\nL2,2,2\n")  # touched, not changed
    assert land() == {"a.csv", "b.csv", "c.csv"} and leis() == ["L1", "L2", "L4", "L5", "L6"]
    kept = set(before) & set(files())
    assert len(kept) == 1  # the rows of a.csv were not written again
    assert spark.read.parquet(ledger).count() == 5


def brute_shapley(f, x, zs):
    k = len(x)
    v = lambda s: sum(f([x[i] if i in s else z[i] for i in range(k)]) for z in zs) / len(zs)
    return [sum(math.factorial(len(s)) * math.factorial(k - len(s) - 1) / math.factorial(k) * (v({*s, i}) - v(set(s)))
                for n in range(k) for s in itertools.combinations([j for j in range(k) if j != i], n)) for i in range(k)]


def test_exact_attribution_and_its_limits(spark):
    f = lambda x: 1 / (1 + math.exp(-(x[0] * x[1] - 2 * x[2] + (x[3] or 0.0))))
    data = [(i, i % 2, float(i % 3), float(i % 5) / 2, float(i % 7) / 4, None if i == 4 else float(i) / 10) for i in range(12)]
    rows = spark.createDataFrame(data, "app_id long, target int, a double, b double, c double, d double")
    scorer = lambda df, keep: df.select(*keep, F.expr("1 / (1 + exp(-(a * b - 2 * c + coalesce(d, 0))))").alias("p"))
    got = {(r["app_id"], r["feature"]): r["phi"] for r in exact_shapley(scorer, rows, rows.where("app_id < 3"), ["a", "b", "c", "d"]).collect()}
    zs = [r[2:] for r in data[:3]]
    for r in data:
        for name, phi in zip("abcd", brute_shapley(f, r[2:], zs)):
            assert math.isclose(got[r[0], name], phi, abs_tol=1e-12)
        total = sum(got[r[0], n] for n in "abcd")
        assert math.isclose(total, f(r[2:]) - sum(map(f, zs)) / 3, abs_tol=1e-12)
    with pytest.raises(ValueError):
        exact_shapley(scorer, rows, rows.where("app_id < 0"), ["a"])
    with pytest.raises(ValueError):
        exact_shapley(scorer, rows, rows, [f"f{i}" for i in range(13)])


def test_sampled_attribution_is_near_the_exact_one(spark):
    from equitally.operators import models as mdl
    from equitally.operators.explain import sampled_shapley

    rows = spark.createDataFrame([(i, float(i * 37 % 40), float(i * 11 % 7), int(i * 37 % 40 + 3 * (i * 11 % 7) > 30)) for i in range(120)],
                                 "app_id long, income double, loan_amount double, target int")
    m = mdl.train_logistic(rows, max_iter=30)
    sampled = sampled_shapley(m, rows, sample_size=20, background_size=20, permutations=120)
    background = mdl.hash_order and __import__("equitally.operators.sampling", fromlist=["x"]).uniform_sample(rows, 20, "app_id", 42, "shap-background")
    scorer = lambda df, keep: mdl.score(m, df, keep=keep)
    exact = exact_shapley(scorer, rows, background, ["income", "loan_amount"])
    both = sampled.join(exact.withColumnRenamed("phi", "true_phi"), ["app_id", "feature"]).collect()
    assert len(both) == 40
    near = [abs(r["phi"] - r["true_phi"]) <= 3 * r["phi_error"] + 1e-9 for r in both]
    assert sum(near) >= 38


def test_first_seen_codes(spark):
    train = spark.createDataFrame([(3, "b"), (1, "c"), (2, "b"), (4, None), (9, "a")], "row long, x string").repartition(4)
    test = spark.createDataFrame([(0, "d"), (1, "a"), (-5, "e")], "row long, x string")
    got = [(r["level"], r["code"]) for r in first_seen_codes(train, test, "x", "row").orderBy("code").collect()]
    assert got == [("c", 0), ("b", 1), ("a", 2), ("e", 3), ("d", 4)]
