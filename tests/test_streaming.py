"""Incremental cells over a file stream equal the batch cells."""

import os

from pyspark.sql import functions as F

from tables import SF_SMALL
from equitally.operators.cells import audit_cells, audit_rows
from equitally.plans.audit import cleaned_applications
from equitally.streaming.cells_stream import scored_stream, start_cells_query, streaming_cells


def test_stream_cells_equal_batch(spark, tmp_dir):
    cleaned = cleaned_applications(spark, SF_SMALL).select(
        "app_id", "target", "derived_race", "derived_sex", "applicant_age", "county_code", "y_prob")
    src = os.path.join(tmp_dir, "scored")
    cleaned.where("app_id % 2 = 0").write.parquet(os.path.join(src, "b1"))
    cleaned.where("app_id % 2 = 1").write.parquet(os.path.join(src, "b2"))
    stream = scored_stream(spark, os.path.join(src, "*"), cleaned.schema, max_files_per_trigger=1)
    q = start_cells_query(streaming_cells(stream), os.path.join(tmp_dir, "ckpt"), query_name="cells_t")
    q.processAllAvailable()
    q.stop()
    keys = ["model", "race", "gender", "age", "county", "ece_bin", "curve_bin"]
    got = {tuple(r[k] for k in keys): (r["n"], r["tp"], r["fp"], round(r["sum_p"], 9))
           for r in spark.table("cells_t").collect()}
    want = {tuple(r[k] for k in keys): (r["n"], r["tp"], r["fp"], round(r["sum_p"], 9))
            for r in audit_cells(audit_rows(cleaned)).collect()}
    assert got == want


def test_stream_rollups_written_each_epoch(spark, tmp_dir):
    from equitally.streaming.cells_stream import rollup_writer

    cleaned = cleaned_applications(spark, SF_SMALL).select(
        "app_id", "target", "derived_race", "derived_sex", "applicant_age", "county_code", "y_prob")
    src = os.path.join(tmp_dir, "scored")
    cleaned.where("app_id % 2 = 0").write.parquet(os.path.join(src, "b1"))
    cleaned.where("app_id % 2 = 1").write.parquet(os.path.join(src, "b2"))
    out = os.path.join(tmp_dir, "reports")
    stream = scored_stream(spark, os.path.join(src, "*"), cleaned.schema, max_files_per_trigger=1)
    q = start_cells_query(streaming_cells(stream), os.path.join(tmp_dir, "ckpt2"),
                          foreach_batch=rollup_writer(out))
    q.processAllAvailable()
    q.stop()
    gm = spark.read.option("header", True).csv(os.path.join(out, "latest", "group_metrics"))
    total = gm.where("attribute = 'Age'").selectExpr("sum(CAST(n AS BIGINT))").first()[0]
    assert total == cleaned.count()
