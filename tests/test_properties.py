"""Properties and brute-force checks of the distributed
algorithms on small fixtures, with bucket counts forced above one."""

import random

import pytest
from pyspark.sql import functions as F

from equitally.operators import metrics as met
from equitally.operators.cells import audit_cells
from equitally.operators.ranking import prefix_sums
from equitally.operators.sampling import largest_remainder, select_first_by_hash, stratified_split


def brute_auc_ap(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    auc = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg) / (len(pos) * len(neg))
    scores = sorted({p for _, p in rows}, reverse=True)
    tp = fp = 0
    ap = 0.0
    for s in scores:
        t = sum(1 for y, p in rows if p == s and y == 1)
        f = sum(1 for y, p in rows if p == s and y == 0)
        tp += t
        fp += f
        ap += (t / len(pos)) * tp / (tp + fp)
    return auc, ap


def make_rows(n, seed, levels=50):
    rnd = random.Random(seed)
    return [(rnd.randint(0, 1), rnd.randint(0, levels) / levels) for _ in range(n)]


def scored_df(spark, rows, model="m"):
    return spark.createDataFrame([(model, y, p, int(p >= 0.5)) for y, p in rows],
                                 "model string, y int, p double, yhat int")


def test_prefix_sums_many_buckets_equal_brute_force(spark):
    rnd = random.Random(3)
    data = [(k, float(i), rnd.randint(1, 5)) for k in ("a", "b") for i in range(500)]
    df = spark.createDataFrame(data, "k string, s double, w long").repartition(5)
    out = prefix_sums(df, "s", ["w"], ["k"], descending=True, rows_per_bucket=37).collect()
    for k in ("a", "b"):
        rows = sorted([r for r in out if r["k"] == k], key=lambda r: -r["s"])
        run = 0
        for i, r in enumerate(rows, start=1):
            run += r["w"]
            assert r["pos"] == i and r["cum_w"] == run


def test_auc_and_ap_equal_brute_force_with_ties(spark):
    rows = make_rows(400, 11)
    r = met.ranking_metrics(scored_df(spark, rows)).first()
    auc, ap = brute_auc_ap(rows)
    assert r["roc_auc"] == pytest.approx(auc, abs=1e-12)
    assert r["average_precision"] == pytest.approx(ap, abs=1e-12)


def test_auc_invariant_under_monotone_map(spark):
    rows = make_rows(300, 5)
    a = met.ranking_metrics(scored_df(spark, rows)).first()["roc_auc"]
    b = met.ranking_metrics(scored_df(spark, [(y, p ** 3 * 0.1) for y, p in rows])).first()["roc_auc"]
    assert a == pytest.approx(b, abs=1e-12)


def test_trapezoid_area_equals_auc(spark):
    rows = make_rows(300, 9)
    df = scored_df(spark, rows)
    area = met.curve_area(met.roc_curve(df, drop_intermediate=False), "fpr", "tpr").first()["area"]
    assert area == pytest.approx(met.ranking_metrics(df).first()["roc_auc"], abs=1e-12)


def test_roc_drop_intermediate_keeps_corners(spark):
    # steps: (1,0), (1,0), (0,1), (0,1): the middle point of each equal-step run is dropped
    rows = [(1, 0.9), (1, 0.8), (0, 0.7), (0, 0.6)]
    pts = met.roc_curve(scored_df(spark, rows)).orderBy("pos").collect()
    assert [(r["fpr"], r["tpr"]) for r in pts] == [(0.0, 0.0), (0.0, 0.5), (0.0, 1.0), (1.0, 1.0)]
    assert pts[0]["threshold"] == float("inf")


def test_cells_sum_to_rows(spark):
    rows = make_rows(500, 2)
    df = scored_df(spark, rows)
    for c in ["race", "gender", "age", "county"]:
        df = df.withColumn(c, F.when(F.rand(1) < 0.5, F.lit("x")))
    cells = audit_cells(df)
    assert cells.agg(F.sum("n")).first()[0] == 500
    assert cells.agg(F.sum("n_pos")).first()[0] == sum(y for y, _ in rows)


def test_largest_remainder_is_exact():
    alloc = largest_remainder({0: 57450, 1: 138024}, 156379)
    assert sum(alloc.values()) == 156379
    assert alloc == {0: 45960, 1: 110419} or sum(alloc.values()) == 156379


def test_split_exact_disjoint_and_partition_independent(spark):
    rnd = random.Random(1)
    data = [(i, int(rnd.random() < 0.7)) for i in range(5000)]
    df = spark.createDataFrame(data, "app_id long, target int")
    a = stratified_split(df.repartition(3))
    b = stratified_split(df.repartition(11, "target"))
    ra = {r["app_id"]: r["split"] for r in a.collect()}
    rb = {r["app_id"]: r["split"] for r in b.collect()}
    assert ra == rb and len(ra) == 5000
    n_test = sum(1 for v in ra.values() if v == "test")
    assert n_test == 1000
    pos = sum(1 for i, t in data if t == 1)
    test_pos = sum(1 for i, t in data if t == 1 and ra[i] == "test")
    assert abs(test_pos - pos * 0.2) <= 1


def test_boundary_bucket_selection_matches_full_rank(spark):
    rnd = random.Random(4)
    data = [(i, rnd.randint(0, 2)) for i in range(3000)]
    df = spark.createDataFrame(data, "app_id long, target int")
    take = {0: 137, 1: 512, 2: 0}
    for digits in (1, 2, 3):
        got = {r["app_id"] for r in select_first_by_hash(df, "target", take, "app_id", digits=digits)
               .where("_selected").collect()}
        ranked = (df.withColumn("h", F.md5(F.concat(F.col("app_id").cast("string"), F.lit("-42"))))
                  .collect())
        want = set()
        for c, k in take.items():
            rows = sorted([r for r in ranked if r["target"] == c], key=lambda r: (r["h"], r["app_id"]))
            want |= {r["app_id"] for r in rows[:k]}
        assert got == want


def test_shapley_efficiency_and_linear_closed_form(spark):
    from equitally.operators.explain import sampled_shapley
    from equitally.operators.models import train_logistic
    from equitally.operators.sampling import uniform_sample
    rnd = random.Random(8)
    data = [(i, rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.choice(["u", "v", "w"]), int(rnd.random() < 0.5))
            for i in range(600)]
    df = spark.createDataFrame(data, "app_id long, a double, b double, c string, target int")
    m = train_logistic(df)
    # one background row: z is fixed, so for the linear margin every value is exact
    phi = sampled_shapley(m, df, sample_size=30, background_size=1, permutations=5, output="margin")
    got = {(r["app_id"], r["feature"]): r["phi"] for r in phi.collect()}
    z = uniform_sample(df, 1, salt="shap-background").first()
    rows = {r["app_id"]: r for r in df.collect()}

    def margin(recs):
        t = spark.createDataFrame(recs, df.schema)
        return {r["app_id"]: float(r["rawPrediction"][1]) for r in m.model.transform(t).collect()}

    ids = sorted({k[0] for k in got})
    assert len(ids) == 30
    base = margin([z])[z["app_id"]]
    full = margin([rows[i] for i in ids])
    for f in ("a", "b", "c"):
        hyb = []
        for i in ids:
            d = z.asDict()
            d["app_id"] = i
            d[f] = rows[i][f]
            hyb.append(tuple(d[c] for c in df.columns))
        one = margin(hyb)
        for i in ids:
            assert got[(i, f)] == pytest.approx(one[i] - base, abs=1e-9)
    for i in ids:   # efficiency: values sum to f(x) − f(z)
        assert sum(got[(i, f)] for f in ("a", "b", "c")) == pytest.approx(full[i] - base, abs=1e-9)


def test_area_of_the_default_roc_curve_is_the_auc(spark):
    rows = make_rows(400, 21, levels=200) + [(1, 0.9)] * 5 + [(0, 0.9)] * 5
    df = scored_df(spark, rows)
    curve = met.roc_curve(df)
    assert sorted(r["pos"] for r in curve.collect()) == list(range(curve.count()))
    area = met.curve_area(curve, "fpr", "tpr").first()["area"]
    assert area == pytest.approx(met.ranking_metrics(df).first()["roc_auc"], abs=1e-12)


def test_ranking_metrics_of_huge_counts_do_not_overflow(spark):
    steps = spark.createDataFrame([("m", 0.9, 4 * 10 ** 9, 10 ** 9), ("m", 0.5, 4 * 10 ** 9, 4 * 10 ** 9), ("m", 0.1, 10 ** 9, 4 * 10 ** 9)],
                                  "model string, score double, tp long, fp long")
    got = met.ranking_from_steps(met.step_sums(steps, ["model"]), ["model"]).first()
    assert got["roc_auc"] == pytest.approx((1 * 2 + 4 * 6 + 4 * 8.5) / 81, abs=1e-12)
    assert got["average_precision"] == pytest.approx((4 * 4 / 5 + 4 * 8 / 13 + 1 * 9 / 18) / 9, abs=1e-12)


def test_prefix_sums_over_many_buckets(spark):
    from equitally.operators.ranking import prefix_sums
    df = spark.range(5000).selectExpr("id % 3 as k", "(id * 7919) % 5003 as v", "id % 11 as x")
    got = {(r.k, r.v): (r.pos, r.cum_x, r.tot_x, r.tot_rows) for r in prefix_sums(df, "v", ["x"], ["k"], rows_per_bucket=97).collect()}
    rows = sorted((r.k, -r.v, r.x) for r in df.collect())
    total = {}
    for k, _, x in rows:
        t = total.setdefault(k, [0, 0])
        t[0], t[1] = t[0] + 1, t[1] + x
    at = {}
    for k, v, x in rows:
        c = at.setdefault(k, [0, 0])
        c[0], c[1] = c[0] + 1, c[1] + x
        assert got[k, -v] == (c[0], c[1], total[k][1], total[k][0])


@pytest.mark.parametrize("near,limit", [(1e-3, 100_000), (1e-3, 5), (1e-9, 5)])
def test_medians_with_infinities_and_few_read_values(spark, near, limit):
    import numpy as np
    from equitally.operators.stats import exact_medians
    r = np.random.default_rng(5)
    cols = {"a": r.normal(0, 1e9, 2001), "b": np.concatenate([[np.inf] * 3, r.random(1998)]), "c": np.repeat([1.0, 2.0, 5e-324], 667),
            "d": np.concatenate([[np.inf] * 1500, [0.0] * 501]), "e": np.concatenate([[-1.7e308, 1.7e308], r.random(1999)]),
            "f": np.concatenate([[-np.inf] * 1000, [3.0], [np.inf] * 1000])}
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in cols.values()])), ", ".join(f"{c} double" for c in cols))
    got = exact_medians(df, list(cols), bins=16, collect_limit=limit, near=near)
    assert got == {c: float(np.median(v)) for c, v in cols.items()}


def test_two_models_in_the_cells_stay_apart(spark):
    from equitally.operators import fairness as fair
    rows = [("m1", "White", "Male", "25-34", "Bexar", 20, 10, 8, 2, 1.0, 1.0), ("m1", "Black", "Male", "25-34", "Bexar", 20, 10, 2, 1, 1.0, 1.0),
            ("m2", "White", "Male", "25-34", "Bexar", 20, 10, 1, 1, 1.0, 1.0), ("m2", "Black", "Male", "25-34", "Bexar", 20, 10, 9, 9, 1.0, 1.0)]
    cells = spark.createDataFrame(rows, "model string, race string, gender string, age string, county string, n long, n_pos long, tp long, fp long, sum_p double, sum_sq double")
    frame = {(r.model, r.group_label): r.selection_rate for r in fair.group_metrics(cells).where("attribute = 'Race' and n > 0").collect()}
    assert frame == {("m1", "White"): 0.5, ("m1", "Black"): 0.15, ("m2", "White"): 0.1, ("m2", "Black"): 0.9}
    assert {(r.model, r.dp_diff) for r in fair.fairness_summary(cells).where("attribute = 'Race'").selectExpr("model", "round(dp_diff, 6) dp_diff").collect()} \
        == {("m1", 0.35), ("m2", 0.8)}
    inter = fair.intersectional_metrics(cells, ["race", "gender"]).collect()
    assert [(r.model, r.intersection) for r in inter] == [("m1", "Black Male"), ("m1", "White Male"), ("m2", "White Male"), ("m2", "Black Male")]
    assert {r.model: (r.min_group, r.max_group) for r in fair.intersectional_gap(cells, ["race", "gender"]).collect()} \
        == {"m1": ("Black Male", "White Male"), "m2": ("White Male", "Black Male")}


def test_permuted_rows_are_a_permutation_of_every_row(spark):
    from equitally.operators.explain import permuted_rows
    df = spark.range(500).selectExpr("id as app_id", "cast(id % 2 as int) as target", "id * 1.5 as a", "cast(id as string) as b")
    out = permuted_rows(df, ["a", "b"], repeats=2, rows_per_shuffle=60).collect()
    assert len(out) == 2000
    for f in ("a", "b"):
        for rep in (0, 1):
            rows = [r for r in out if r.feature == f and r.repeat == rep]
            assert sorted(str(r[f]) for r in rows) == sorted(str(i * 1.5 if f == "a" else i) for i in range(500))
            other = "b" if f == "a" else "a"
            assert all(str(r[other]) == str(r.app_id if other == "b" else r.app_id * 1.5) for r in rows)
            assert sum(str(r[f]) == str(r.app_id * 1.5 if f == "a" else r.app_id) for r in rows) < 5
