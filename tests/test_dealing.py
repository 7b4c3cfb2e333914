"""Tables in one row group: the rows of a pass lie evenly over the cores."""

import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from equitally.operators import explain
from equitally.operators import models as mdl
from equitally.session import dealt, tasks_for
from equitally.sources.fixtures import application_view


def sizes(df):
    return sorted(r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())


def even(df, rows, tasks):
    got = sizes(df)
    return len(got) == tasks and sum(got) == rows and got[-1] < 1.5 * rows / tasks


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("one-row-group")
    spark.range(70_000, numPartitions=1).selectExpr(
        "id + 1 as o_orderkey", "id % 500 as o_custkey", "if(id % 2 = 0, 'F', 'O') as o_orderstatus", "1000.0D + id % 977 as o_totalprice") \
        .write.parquet(f"{d}/orders.parquet")
    spark.range(500, numPartitions=1).selectExpr("id as c_custkey", "concat('c', id) as c_name", "cast(id % 25 as int) as c_nationkey", "'A' as c_mktsegment") \
        .write.parquet(f"{d}/customer.parquet")
    return str(d)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(50_000, numPartitions=1).selectExpr(
        "id as app_id", "cast(id * 37 % 400 as double) as income", "array('White', 'Asian', 'Joint')[cast(id % 3 as int)] as derived_race",
        "cast(id * 37 % 400 + id * 7919 % 150 > 275 as int) as target")


def test_tasks_follow_rows_between_two_bounds(spark):
    cores = spark.sparkContext.defaultParallelism
    assert tasks_for(spark, 0) == tasks_for(spark, 20_000) == 1
    assert tasks_for(spark, 20_001) == 2 and tasks_for(spark, 20_000 * cores) == cores == tasks_for(spark, 500_000 * cores)
    assert tasks_for(spark, 500_000 * cores + 1) == cores + 1
    few = spark.range(30, numPartitions=3)
    assert dealt(few, 30) is few


def test_applications_of_one_row_group_are_many_tasks(spark, tables):
    view = application_view(spark, tables)
    assert even(view, 70_000, 4) and view.select("app_id").distinct().count() == 70_000


@pytest.mark.parametrize("kind, of", [("gbt", GBTClassifier), ("forest", RandomForestClassifier)])
def test_trees_are_fitted_on_even_tasks(rows, kind, of, monkeypatch):
    seen, fit = [], of.fit
    monkeypatch.setattr(of, "fit", lambda self, df, *a: seen.append((sizes(df), df.rdd.getNumPartitions())) or fit(self, df, *a))
    train = mdl.train_gbt if kind == "gbt" else mdl.train_forest
    train(rows, max_depth=2, **({"max_iter": 2, "early_stopping": False} if kind == "gbt" else {"num_trees": 2}))
    assert seen[0][1] == 3 and sum(seen[0][0]) == 50_000 and seen[0][0][-1] < 25_000


def test_few_rows_are_boosted_in_one_task(rows, monkeypatch):
    seen, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, df, *a: seen.append(df.rdd.getNumPartitions()) or fit(self, df, *a))
    mdl.train_gbt(rows.limit(900).repartition(2, "app_id"), max_iter=2, max_depth=2, early_stopping=False)
    assert seen == [1]


def test_shapley_shuffles_rows_and_not_their_hybrids(rows):
    few = rows.limit(2_000)
    phi = explain.sampled_shapley(mdl.train_gbt(few, max_iter=2, max_depth=2, early_stopping=False), few, background_size=5, permutations=8)
    assert phi.count() == 2_000 * 2
    plan = phi._jdf.queryExecution().executedPlan().toString()
    assert "_step" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line), plan
