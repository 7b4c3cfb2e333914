"""Physical-plan checks: no Python in the core
operators, no unpartitioned window over row data, pruning and pushdown."""

import re

from pyspark.sql import functions as F

from tables import SF_SMALL
from equitally.operators import metrics as met
from equitally.operators.cells import audit_cells, audit_rows
from equitally.operators.clean import decision_filter
from equitally.plans.audit import cleaned_applications
from equitally.sources.fixtures import application_view


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_plan_is_jvm_only_with_partial_aggregation(spark):
    cells = audit_cells(audit_rows(cleaned_applications(spark, SF_SMALL), {"full": "y_prob", "blind": "y_prob_blind"}))
    cells.collect()
    p = plan_of(cells)
    assert "PythonUDF" not in p and "ArrowEvalPython" not in p and "BatchEvalPython" not in p
    assert p.count("HashAggregate") >= 2  # partial (map side) + final


def test_ranking_windows_are_partitioned(spark):
    rows = audit_rows(cleaned_applications(spark, SF_SMALL), {"full": "y_prob", "blind": "y_prob_blind"})
    r = met.ranking_metrics(rows)
    r.collect()
    p = plan_of(r)
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[", p)
    assert windows, p
    assert all(w.strip() for w in windows), "a window without partitionBy over ranked rows"


def test_projection_pruned_to_needed_columns(spark):
    v = application_view(spark, SF_SMALL, ["county_code"])
    p = v._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", p)
    assert schemas and all("o_totalprice" not in s and "c_name" not in s for s in schemas)


def test_decision_filter_reaches_parquet_scan(spark, tmp_dir):
    spark.range(100).select(F.col("id").alias("app_id"), (F.col("id") % 6 + 1).cast("int").alias("action_taken")) \
        .write.parquet(f"{tmp_dir}/apps")
    df = decision_filter(spark.read.parquet(f"{tmp_dir}/apps"))
    p = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*In\(action_taken", p), p
    assert df.count() == sum(1 for i in range(100) if i % 6 + 1 in (1, 3))


def test_split_shuffles_only_the_boundary_bucket(spark):
    from equitally.operators.sampling import stratified_split
    sp = stratified_split(cleaned_applications(spark, SF_SMALL))
    p = plan_of(sp)
    assert p.count("Exchange") == 1, p          # the boundary rows' window only
    union_children = p.split("+- Union", 1)[1]
    first_branch = union_children.split("\n   +-", 1)[0]
    assert "Exchange" not in first_branch       # bulk rows: scan → filter → project
