"""Edge cases of the non-standard semantics."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from equitally.functions.cleaning import na_token_to_null, ordinal_age, range_midpoint, to_double
from equitally.functions.labels import age_label, intersection_label, race_label
from equitally.functions.thresholds import left_closed_bin, predict_at, right_closed_bin
from equitally.operators import metrics as met
from equitally.operators.calibration import calibration_table
from equitally.operators.cells import audit_cells
from equitally.operators.fairness import intersectional_metrics
from equitally.operators.stats import exact_medians


def one_col(spark, values, dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {dtype}")


def test_range_midpoints(spark):
    cases = {"<20%": 20.0, "20%-<30%": 25.0, "30%-36%": 33.0, "50%-60%": 55.0, ">60%": 60.0, "36": 36.0,
             "5-24": 14.5, "25-49": 37.0, "50-99": 74.5, "100-149": 124.5, ">149": 149.0, "-5": None,
             "1-2-3": None, " 7 ": 7.0, "Exempt": None, "8888": None, "9999": None, "Unknown": None,
             None: None, "abc": None}
    df = one_col(spark, list(cases)).select("x", range_midpoint("x").alias("m"))
    got = {r["x"]: r["m"] for r in df.collect()}
    assert got == cases


def test_na_tokens_and_numbers(spark):
    df = one_col(spark, ["", "NA", "n/a", "NULL", "Exempt", " NA", "12", "1e3", "NaN", "Infinity", "1d"])
    out = df.select("x", na_token_to_null("x").alias("n"), to_double("x").alias("d")).collect()
    got = {r["x"]: (r["n"], r["d"]) for r in out}
    assert got[""][0] is None and got["NA"][0] is None and got["n/a"][0] is None and got["NULL"][0] is None
    assert got["Exempt"][0] == "Exempt" and got[" NA"][0] == " NA"  # exact token match, like the CSV reader
    assert got["12"][1] == 12.0 and got["1e3"][1] == 1000.0
    assert got["NaN"][1] is None and got["Infinity"][1] is None and got["1d"][1] is None


def test_ordinal_age_and_truncating_decode(spark):
    df = one_col(spark, ["<25", "25-34", ">74", "8888", "9999", None])
    got = [r[0] for r in df.select(ordinal_age("x")).collect()]
    assert got == [0.0, 1.0, 6.0, None, None, None]
    codes = one_col(spark, [3.5, 0.0, 6.9, -0.5, None, float("nan")], "double")
    labels = [r[0] for r in codes.select(age_label("x")).collect()]
    assert labels == ["45-54", "<25", ">74", "<25", None, None]


def test_race_groupings_and_null_propagating_intersection(spark):
    df = spark.createDataFrame([("Joint", "Male"), ("Asian", None), ("2 or more minority races", "Female")],
                               "r string, g string")
    out = df.select(race_label("r").alias("r4"), race_label("r", include_other=False).alias("r3"),
                    intersection_label(race_label("r"), F.col("g")).alias("i")).collect()
    assert [tuple(r) for r in out] == [("Other", None, "Other Male"), ("Asian", "Asian", None), (None, None, None)]


def test_bins_at_edges(spark):
    ps = [0.0, 0.1, 0.2, 0.3, 0.30000000000000004, 0.6, 0.6000000000000001, 0.7, 0.7000000000000001,
          0.8999999999999999, 0.9, 1.0]
    df = one_col(spark, ps, "double").select("x", left_closed_bin("x", 10).alias("e"),
                                            right_closed_bin("x", 5).alias("c"))
    got = {r["x"]: (r["e"], r["c"]) for r in df.collect()}
    assert got[0.0] == (0, 0) and got[0.1] == (1, 0) and got[0.2] == (2, 0)
    assert got[0.3][0] == 2 and got[0.30000000000000004][0] == 3      # linspace edge is 0.30000000000000004
    assert got[0.6][0] == 5 and got[0.6000000000000001][0] == 6
    assert got[0.7][0] == 6 and got[0.7000000000000001][0] == 7
    assert got[0.8999999999999999][0] == 8 and got[0.9][0] == 9
    assert got[1.0] == (None, 4)                                           # 1.0: no ECE bin, last curve bin


def test_threshold_inclusive(spark):
    df = one_col(spark, [0.4999999, 0.5, 0.9], "double")
    assert [r[0] for r in df.select(predict_at("x")).collect()] == [0, 1, 1]


def scored(spark, rows):
    return spark.createDataFrame(rows, "model string, y int, p double, yhat int, race string, gender string, "
                                       "age string, county string")


def test_all_ties_auc_is_half(spark):
    rows = [("m", y, 0.5, 1, None, None, None, None) for y in (0, 1, 0, 1, 1)]
    r = met.ranking_metrics(scored(spark, rows)).first()
    assert r["roc_auc"] == pytest.approx(0.5)


def test_single_class_group_rates_are_zero(spark):
    rows = [("m", 1, 0.9, 1, "White", "Male", "<25", "Bexar")] * 12
    cells = audit_cells(scored(spark, rows))
    m = intersectional_metrics(cells, ["race", "gender"]).first()
    assert m["fpr"] == 0.0 and m["tpr"] == 1.0 and m["count"] == 12


def test_min_group_size_nine_vs_ten(spark):
    rows = ([("m", 1, 0.7, 1, "White", "Male", "<25", "Bexar")] * 10
            + [("m", 0, 0.2, 0, "Black", "Male", "<25", "Bexar")] * 9)
    cells = audit_cells(scored(spark, rows))
    got = {r["intersection"] for r in intersectional_metrics(cells, ["race", "gender"]).collect()}
    assert got == {"White Male"}
    cal = {r["group_label"] for r in calibration_table(cells, attributes={"Race": "race"}).collect()}
    assert cal == {"White"}


def test_ece_ignores_p_one_in_bins_but_counts_it(spark):
    rows = [("m", 1, 1.0, 1, "White", None, None, None)] * 5 + [("m", 0, 0.25, 0, "White", None, None, None)] * 5
    cells = audit_cells(scored(spark, rows))
    r = calibration_table(cells, attributes={"Race": "race"}).first()
    # only the 0.25 bin counts: |0 − 0.25| · 5 / 10
    assert r["ece"] == pytest.approx(0.125)
    assert r["calibration_gap"] == pytest.approx(abs(0.5 - 0.625))


def test_exact_median_even_odd_and_all_null(spark):
    df = spark.createDataFrame([(1.0, 1.0, None), (2.0, 2.0, None), (3.0, 3.0, None), (4.0, None, None)],
                               "a double, b double, c double")
    med = exact_medians(df, ["a", "b", "c"])
    assert med == {"a": 2.5, "b": 2.0, "c": None}


def test_exact_median_refinement_matches_sort(spark):
    import random
    rnd = random.Random(7)
    vals = [rnd.lognormvariate(0, 3) for _ in range(20001)] + [None] * 50
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(7)
    got = exact_medians(df, ["x"], bins=16, collect_limit=64)["x"]
    clean = sorted(v for v in vals if v is not None)
    assert got == clean[len(clean) // 2]


def test_unseen_category_encodes_as_zeros(spark):
    from equitally.operators import features as fx
    tr = one_col(spark, ["a", "b", "c"])
    te = one_col(spark, ["b", "zz", None])
    out = fx.one_hot_index(fx.fit_pipeline(tr, fx.one_hot_stages(["x"])).transform(te), "x__ohe")
    got = [(r["x"], r["x__ohe_hot"], r["x__ohe_size"]) for r in out.collect()]
    assert got == [("b", 1, 3), ("zz", None, 3), (None, None, 3)]
