"""Node tables: scores, SQL, staged areas, leaf values and gains against the library's model."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from equitally.operators import models as mdl
from equitally.operators.trees import LeafMasks, Walk, auc_by_round, ensemble_sql, first_rounds, gain_table, newton_leaves, node_table, staged_margins


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([
        (i, float(i * 37 % 400) if i % 97 else None, ["White", "Black", "Asian", "Joint", None][i % 5], float(i % 7),
         int(i * 37 % 400 + i * 7919 % 250 + 40 * (i % 5 == 2) > 300)) for i in range(900)],
        "app_id long, income double, derived_race string, applicant_age double, target int").coalesce(2)


@pytest.fixture(scope="module")
def gbt(rows):
    return mdl.train_gbt(rows, max_iter=12, step=0.3, max_depth=3, patience=4)


@pytest.fixture(scope="module")
def forest(rows):
    return mdl.train_forest(rows, num_trees=8, max_depth=4)


def unseen(rows, spark):
    """Values that training never saw: a new level, NULLs, and thresholds themselves."""
    odd = spark.createDataFrame([(10_000, None, "Nobody", None, 1), (10_001, 186.5, None, 3.5, 0), (10_002, float("inf"), "White", -1.0, 1)], rows.schema)
    return rows.unionByName(odd)


def vectors(model, rows):
    scored = model.model.transform(rows)
    return scored.select("app_id", vector_to_array("features").alias("x"), vector_to_array("rawPrediction")[1].alias("raw"),
                         vector_to_array("probability")[1].alias("p")).orderBy("app_id").collect()


@pytest.mark.parametrize("kind", ["gbt", "forest"])
def test_expression_and_walk_score_as_the_model(kind, rows, spark, request):
    m = request.getfixturevalue(kind)
    nodes = node_table(spark, m.classifier, m.inputs)
    got = vectors(m, unseen(rows, spark))
    on_threshold = [n["threshold"] for n in nodes.where("threshold is not null").limit(3).collect()]
    assert on_threshold
    x = np.array([r["x"] for r in got])
    walk = Walk(nodes)
    leaf = walk.leaves(x)
    weights = np.array([r["weight"] for r in nodes.select("tree", "weight").distinct().orderBy("tree").collect()])
    by_walk = (walk.value[leaf] * weights).sum(1)
    want = [r["raw"] for r in got]
    assert np.allclose(by_walk, want, atol=1e-9)
    sql = ensemble_sql(nodes)
    table = spark.createDataFrame([(i, r["x"]) for i, r in enumerate(got)], "i int, x array<double>")
    in_spark = [r["s"] for r in table.selectExpr("i", f"{sql} AS s").orderBy("i").collect()]
    assert np.allclose(in_spark, want, atol=1e-9)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, x0 DOUBLE[])")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, r["x"]) for i, r in enumerate(got)])
    # DuckDB counts from 1: an element before the first shifts its array
    in_duck = [s for _, s in con.execute(f"SELECT i, {sql} FROM (SELECT i, list_prepend(NULL, x0) AS y, y[2:] AS z, map(range(len(x0)), x0) AS x FROM t) ORDER BY i").fetchall()]
    assert np.allclose([float(v) for v in in_duck], want, atol=1e-9)


def brute_auc(y, s):
    pos, neg = [v for t, v in zip(y, s) if t], [v for t, v in zip(y, s) if not t]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_areas_of_all_rounds_and_the_cut(rows, gbt, spark):
    held = mdl.validation_indicator(rows).where("is_validation")
    assembled = gbt.model.transform(held)
    nodes = node_table(spark, gbt.classifier, gbt.inputs)
    areas = [r["roc_auc"] for r in auc_by_round(Walk(nodes), assembled, "target").orderBy("round").collect()]
    scored = staged_margins(Walk(nodes), assembled, ["target"]).collect()
    for r, area in enumerate(areas):
        assert math.isclose(area, brute_auc([x["target"] for x in scored], [x["margins"][r] for x in scored]), abs_tol=1e-12)
    assert np.allclose(areas, gbt.round_auc[:len(areas)])
    assert gbt.classifier.getNumTrees == gbt.best_iteration + 1 == len(areas)
    assert gbt.best_iteration == mdl.best_round([-a for a in gbt.round_auc], 4)[0]
    two = first_rounds(gbt.classifier, 2)
    assert two.getNumTrees == 2 and list(two.treeWeights) == list(gbt.classifier.treeWeights)[:2]
    margins = two.transform(assembled.select("features")).select(vector_to_array("rawPrediction")[1].alias("m")).collect()
    assert np.allclose(sorted(r["m"] for r in margins), sorted(x["margins"][1] / 1e9 for x in scored), atol=1e-6)


def test_second_order_leaves_equal_brute_force(rows, gbt, spark):
    nodes = node_table(spark, gbt.classifier, gbt.inputs)
    walk = Walk(nodes)
    assembled = gbt.model.transform(rows).withColumn("w", F.when(F.col("target") == 1, 0.5).otherwise(1.0))
    got = {(r["tree"], r["leaf"]): r for r in newton_leaves(walk, assembled, "target", "w", 1.0, 2.0).collect()}
    data = assembled.select("target", "w", vector_to_array("features").alias("x")).collect()
    leaf = walk.leaves(np.array([r["x"] for r in data]))
    sums = {}
    for r, reached in zip(data, leaf):
        margin = 0.0
        for t, at in enumerate(reached):
            p = 1 / (1 + math.exp(-2 * margin))
            s = sums.setdefault((t, int(walk.node[at])), [0, 0.0, 0.0])
            s[0] += 1
            s[1] += r["w"] * (p - r["target"])
            s[2] += r["w"] * p * (1 - p)
            margin += walk.units[at] / 1e9
    assert set(got) == set(sums)
    merged = 0
    for k, (n, g, h) in sums.items():
        r = got[k]
        assert r["n"] == n and math.isclose(r["g"], g, abs_tol=1e-9) and math.isclose(r["h"], h, abs_tol=1e-9)
        if h >= 2.0:
            assert math.isclose(r["value"], -g / (h + 1), abs_tol=1e-9)
        else:
            merged += 1
    assert merged


def test_second_order_leaves_send_a_row_a_task_and_leaf(rows, gbt, spark, monkeypatch):
    """Not one for every thousand rows: 600 trees have some 40,000 leaves."""
    walk = Walk(node_table(spark, gbt.classifier, gbt.inputs))
    assembled = gbt.model.transform(rows.coalesce(1).crossJoin(F.broadcast(spark.range(3)))).withColumn("w", F.lit(1.0))
    sent, through = [], type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, *a: sent.append(out := through(self, *a)) or out)
    newton_leaves(walk, assembled, "target", "w").collect()
    n = sent[0].groupBy("at").count()
    assert n.count() and n.where("count > 1").count() == 0 and sent[0].agg(F.sum("n")).first()[0] == 2_700 * len(walk.trees)


def test_masks_reach_the_leaves_of_the_walk(rows, gbt, spark):
    walk = Walk(node_table(spark, gbt.classifier, gbt.inputs))
    got = vectors(gbt, unseen(rows, spark))
    x = np.array([r["x"] for r in got])
    assert LeafMasks.fits(walk) and walk.by_level.any() and not walk.by_level[~walk.leaf].all()
    masks = LeafMasks(walk, len(gbt.inputs))
    together = np.bitwise_and.reduce([masks.masks(i, x[:, i]) for i in range(x.shape[1])])
    want = (walk.value * walk.weight)[walk.leaves(x)].sum(1)
    assert np.allclose(masks.margins(together), want, atol=1e-12)
    walk.leaf = np.ones(65 * len(walk.root), bool)
    walk.root = np.arange(len(walk.root)) * 65
    walk.by_level = walk.slot = np.zeros(len(walk.leaf), bool)
    assert not LeafMasks.fits(walk)


@pytest.mark.parametrize("output", ["probability", "margin"])
def test_values_from_masks_equal_those_from_scored_hybrids(rows, gbt, spark, output, monkeypatch):
    """Rows that come twice and rows without a key among them."""
    from equitally.operators import explain

    some = rows.where("app_id % 20 < 3").withColumn("app_id", F.when(F.col("app_id") % 50 > 0, F.col("app_id")))
    some = some.unionByName(some.where("app_id % 7 = 0"))
    through = []
    transform = type(gbt.model).transform
    monkeypatch.setattr(type(gbt.model), "transform", lambda self, df, *a: through.append(len(self.stages)) or transform(self, df, *a))

    def values():
        found = explain.sampled_shapley(gbt, some, background_size=9, permutations=4, output=output).collect()
        return {(r["app_id"], r["feature"]): (r["phi"], r["phi_error"]) for r in found}, len(found)

    got, n = values()
    assert set(through) == {len(gbt.model.stages) - 1} and n == len(got) == 3 * some.where("app_id is not null").select("app_id").distinct().count()
    monkeypatch.setattr(LeafMasks, "fits", staticmethod(lambda walk: False))
    want, _ = values()
    twice = {r["app_id"] for r in some.groupBy("app_id").count().where("count > 1").collect()}
    assert set(got) == set(want) and twice - {None}
    for k, (phi, error) in want.items():
        assert math.isclose(got[k][0], phi, abs_tol=1e-9)
        assert k[0] in twice or math.isclose(got[k][1], error, abs_tol=1e-9)


@pytest.mark.parametrize("kind", ["gbt", "forest"])
def test_gains(kind, rows, spark, request):
    from equitally.operators.explain import importance_table

    m = request.getfixturevalue(kind)
    got = {r["feature"]: r for r in gain_table(node_table(spark, m.classifier, m.inputs), kind == "forest").collect()}
    library = {r["feature"]: r["importance"] for r in importance_table(m, rows).collect()}
    assert math.isclose(sum(r["importance"] for r in got.values()), 1.0, abs_tol=1e-9)
    for f, r in got.items():
        assert math.isclose(r["average_gain"] * r["splits"], r["total_gain"], rel_tol=1e-9)
        assert math.isclose(r["importance"], library[f], abs_tol=1e-9), (f, r["importance"], library[f])
