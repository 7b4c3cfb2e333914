"""Sources and sinks: raw CSV ingest, landing, payload checks, reports,
model persistence (S1, S3, S4, S6, S7, S9)."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tables import SF_SMALL
from equitally.operators.clean import clean_applications, normalize_na_tokens
from equitally.sources import ingest, sinks


CSV = """activity_year,lei,county_code,action_taken,derived_race,derived_sex,applicant_age,debt_to_income_ratio,total_units,income,loan_amount,conforming_loan_limit
2023,L1,48029,1,White,Male,25-34,20%-<30%,1,85,205000,C
2023,L2,48113,3,Black or African American,Female,8888,>60%,5-24,NA,155000,
2023,L3,48201,2,Asian,Joint,<25,36,1,60,95000,NC
2023,L4,48453,1,Joint,Male,>74,Exempt,1,,305000,NA
"""


def test_raw_csv_ingest_and_clean(spark, tmp_dir):
    path = os.path.join(tmp_dir, "raw.csv")
    with open(path, "w") as f:
        f.write(CSV)
    cols = ingest.read_header(spark, path)
    raw = ingest.read_raw_csv(spark, path, cols)
    assert all(t == "string" for _, t in raw.dtypes)
    n = normalize_na_tokens(raw).collect()
    assert n[1]["income"] is None and n[1]["conforming_loan_limit"] is None and n[3]["income"] is None
    cleaned = clean_applications(raw).orderBy("loan_amount").collect()
    assert len(cleaned) == 3                                   # action 2 dropped
    assert "lei" not in cleaned[0] and "activity_year" not in cleaned[0]
    by_amount = {r["loan_amount"]: r for r in cleaned}
    assert by_amount[205000.0]["debt_to_income_ratio"] == 25.0
    assert by_amount[155000.0]["debt_to_income_ratio"] == 60.0
    assert by_amount[155000.0]["total_units"] == 14.5
    assert by_amount[155000.0]["applicant_age"] == 3.5       # 8888 → median of {1, 6}
    assert by_amount[155000.0]["income"] == 85.0             # median of the one known value
    assert by_amount[305000.0]["debt_to_income_ratio"] == 42.5   # median of {25, 60}
    assert by_amount[155000.0]["conforming_loan_limit"] == "Unknown"
    assert by_amount[155000.0]["target"] == 0 and by_amount[205000.0]["target"] == 1


def test_land_extracts_partitioned(spark, tmp_dir):
    path = os.path.join(tmp_dir, "raw.csv")
    with open(path, "w") as f:
        f.write(CSV)
    raw = ingest.read_raw_csv(spark, path, ingest.read_header(spark, path))
    out = os.path.join(tmp_dir, "landed")
    assert ingest.land_extracts(raw, out, 2023, "TX", "48453,48201,48113,48029") == "big4"
    assert ingest.land_extracts(raw, out, 2023, "TX", "48453") == "48453"
    back = spark.read.parquet(out)
    assert back.where("extract_counties = 'big4'").count() == 4
    assert sorted(r[0] for r in back.select("extract_counties").distinct().collect()) == ["48453", "big4"]
    ingest.land_extracts(raw, out, 2023, "TX", "48453")
    assert spark.read.parquet(out).groupBy("extract_counties").count().collect() \
        and {r[0]: r[1] for r in spark.read.parquet(out).groupBy("extract_counties").count().collect()} == {"48453": 4, "big4": 4}


def test_payload_rules(spark):
    df = spark.createDataFrame([("<!doctype html><html>",), ("  <!DOCTYPE html>x",), ("a,b\n1,2",),
                                ("x" * 50 + "<html>",), ("<HTML><body>",)], "t string")
    got = df.select(ingest.is_html_payload("t").alias("d"), ingest.is_html_payload("t", True).alias("s")).collect()
    assert [(r["d"], r["s"]) for r in got] == [(True, True), (True, False), (False, False), (False, True),
                                               (True, False)]
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    ok, bad = ingest.split_payloads(pages, "html")
    assert ok.count() + bad.count() == pages.count()


def test_rows_per_county(spark, tmp_dir):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "county_code int")
    assert [tuple(r) for r in ingest.rows_per_county(df).collect()] == [(1, 2), (2, 1)]


def test_report_sinks(spark, tmp_dir):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    sinks.write_report_csv(df, os.path.join(tmp_dir, "r.csv"))
    sinks.write_metrics_json(df, os.path.join(tmp_dir, "m.json"), single_file=True)
    files = [f for f in os.listdir(os.path.join(tmp_dir, "m.json")) if f.endswith(".json")]
    assert len(files) == 1
    with open(os.path.join(tmp_dir, "m.json", files[0])) as f:
        assert [json.loads(x)["k"] for x in f] == ["a", "b"]
    back = spark.read.option("header", True).csv(os.path.join(tmp_dir, "r.csv"))
    assert back.count() == 2
    sinks.write_report_csv(spark.range(150_000).repartition(3), os.path.join(tmp_dir, "big.csv"))
    assert spark.read.option("header", True).csv(os.path.join(tmp_dir, "big.csv")).count() == 150_000
    sinks.write_parquet(df, os.path.join(tmp_dir, "p"), partition_by=["k"])
    assert spark.read.parquet(os.path.join(tmp_dir, "p")).count() == 2


def test_model_save_load_roundtrip(spark, tmp_dir):
    from equitally.operators.models import load_model, save_model, score, train_logistic
    df = spark.createDataFrame([(i, float(i % 7), "abc"[i % 3], int(i % 5 < 2)) for i in range(200)],
                               "app_id long, x double, c string, target int")
    m = train_logistic(df)
    save_model(m, os.path.join(tmp_dir, "lr"))
    m2 = load_model(os.path.join(tmp_dir, "lr"))
    assert (m2.name, m2.numeric, m2.categorical, m2.inputs) == (m.name, m.numeric, m.categorical, m.inputs)
    a = {r["app_id"]: r["p"] for r in score(m, df).collect()}
    b = {r["app_id"]: r["p"] for r in score(m2, df).collect()}
    assert a == b


def test_landed_file_check(spark, tmp_dir):
    d = os.path.join(tmp_dir, "landing")
    os.makedirs(d)
    with open(os.path.join(d, "good.csv"), "w") as f:
        f.write(CSV)
    with open(os.path.join(d, "page.csv"), "w") as f:
        f.write("<!DOCTYPE html><html><body>too large</body></html>\n")
    with open(os.path.join(d, "other.csv"), "w") as f:
        f.write("a,b\n1,2\n")
    res = {os.path.basename(r["file_path"]): r for r in
           ingest.check_landed_files(spark, d, ["action_taken", "county_code"]).collect()}
    assert res["good.csv"]["accepted"] and res["good.csv"]["first_line"].startswith("activity_year")
    assert res["page.csv"]["is_html"] and not res["page.csv"]["accepted"]
    assert not res["other.csv"]["header_ok"] and not res["other.csv"]["accepted"]


def test_row_keys_depend_on_rows_alone(spark, monkeypatch):
    monkeypatch.setattr(ingest, "OCCURRENCES_PER_TASK", 7)
    rows = [("a", "1")] * 50 + [("b", None)] * 3 + [(None, "b")] * 2 + [("", "x")]
    keys = []
    for parts in (1, 5):
        keyed = ingest.assign_row_key(spark.createDataFrame(rows, "x string, y string").repartition(parts)).collect()
        assert len({r["app_id"] for r in keyed}) == len(rows)
        keys.append(sorted((str(r["x"]), str(r["y"]), r["app_id"]) for r in keyed))
    assert keys[0] == keys[1]


def test_swapped_columns_in_a_second_file_are_an_error(spark, tmp_dir):
    for name, text in (("a.csv", "p,q\n1,2\n"), ("b.csv", "q,p\n1,2\n")):
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write(text)
    with pytest.raises(Exception, match="header|HEADER|schema"):
        ingest.read_raw_csv(spark, tmp_dir, ["p", "q"]).collect()


def test_header_with_quoted_commas(spark, tmp_dir):
    path = os.path.join(tmp_dir, "h.csv")
    with open(path, "w") as f:
        f.write('a,"b, c",d\n1,2,3\n')
    assert ingest.read_header(spark, path) == ["a", "b, c", "d"]


def test_pages_behind_blank_lines_or_comments_are_rejected(spark, tmp_dir):
    pages = {"blank.csv": "\n\n <!DOCTYPE html><p>x", "comment.csv": "<!-- c --><html>", "good.csv": "a,b\n1,<html>\n"}
    for name, text in pages.items():
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write(text if name != "good.csv" else "a,b\n" + "1,2\n" * 60 + "1,<html>\n")
    got = {os.path.basename(r["file_path"]): r["accepted"] for r in ingest.check_landed_files(spark, tmp_dir).collect()}
    assert got == {"blank.csv": False, "comment.csv": False, "good.csv": True}


def test_code_columns_take_whole_numbers_in_range_only(spark):
    rows = [("1", c) for c in ("48029", "48029.0", "1.5", "99999999999", "x", None)]
    df = spark.createDataFrame(rows, "action_taken string, county_code string").withColumn("app_id", F.monotonically_increasing_id())
    from equitally.operators.clean import prepare_features
    assert [r["county_code"] for r in prepare_features(df).orderBy("app_id").collect()] == [48029, 48029, None, None, None, None]


def test_prepare_from_csv(spark, tmp_dir):
    from equitally.plans.prepare import prepare_from_csv
    path = os.path.join(tmp_dir, "raw.csv")
    rows = CSV.strip().split("\n")
    with open(path, "w") as f:
        f.write("\n".join([rows[0]] + rows[1:] * 10) + "\n")
    out = prepare_from_csv(spark, path, os.path.join(tmp_dir, "prepared"))
    split = spark.read.parquet(out["split"])
    assert split.count() == 30
    assert split.where("split = 'test'").count() == 6       # ceil(0.2 · 30)
    assert split.select("app_id").distinct().count() == 30
