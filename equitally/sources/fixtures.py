"""Stand-in application table derived from the TPC-H-style test tables.

The test tables hold no loan applications, so every query reads them through
this view: one row per order (joined to its customer) with raw, string-typed
application columns and a model score.  The view only shapes rows into the
schema the jobs expect; it does none of the jobs' work.  The same expression
text runs in Spark SQL and in DuckDB, so both engines see identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from equitally.session import dealt

# --------------------------------------------------------------------------- #
# The application view expressions (name, SQL expression).
# --------------------------------------------------------------------------- #
APPLICATION_VIEW = [
    ("app_id", "o_orderkey"),
    ("action_taken", "CASE WHEN o_orderstatus='F' THEN 1 WHEN o_orderstatus='O' THEN 3 "
                     "ELSE CAST(1 + o_orderkey % 6 AS INT) END"),
    ("derived_race", "CASE CAST(o_custkey % 9 AS INT) WHEN 0 THEN 'White' WHEN 1 THEN 'White' "
                     "WHEN 2 THEN 'White' WHEN 3 THEN 'Black or African American' WHEN 4 THEN 'Asian' "
                     "WHEN 5 THEN 'Joint' WHEN 6 THEN 'American Indian or Alaska Native' "
                     "WHEN 7 THEN '2 or more minority races' ELSE 'Race Not Available' END"),
    ("derived_sex", "CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' "
                    "WHEN 2 THEN 'Joint' ELSE 'Sex Not Available' END"),
    ("applicant_age", "CASE WHEN o_orderkey % 499 = 3 THEN '>74' ELSE "
                      "CASE CAST((o_orderkey * 7 + 3) % 9 AS INT) WHEN 0 THEN '<25' WHEN 1 THEN '25-34' "
                      "WHEN 2 THEN '35-44' WHEN 3 THEN '45-54' WHEN 4 THEN '55-64' WHEN 5 THEN '65-74' "
                      "WHEN 6 THEN '35-44' WHEN 7 THEN '8888' ELSE NULL END END"),
    ("co-applicant_age", "CASE CAST((o_orderkey * 5 + o_custkey) % 10 AS INT) WHEN 0 THEN '<25' "
                         "WHEN 1 THEN '25-34' WHEN 2 THEN '35-44' WHEN 3 THEN '45-54' WHEN 4 THEN '55-64' "
                         "WHEN 5 THEN '65-74' WHEN 6 THEN '>74' WHEN 7 THEN '9999' WHEN 8 THEN '8888' "
                         "ELSE NULL END"),
    ("county_code", "CASE CAST(c_nationkey % 5 AS INT) WHEN 0 THEN 48029 WHEN 1 THEN 48113 "
                    "WHEN 2 THEN 48201 WHEN 3 THEN 48453 ELSE 48999 END"),
    ("debt_to_income_ratio", "CASE CAST(o_orderkey % 10 AS INT) WHEN 0 THEN '<20%' WHEN 1 THEN '20%-<30%' "
                             "WHEN 2 THEN '30%-36%' WHEN 3 THEN '36' WHEN 4 THEN '41' WHEN 5 THEN '50%-60%' "
                             "WHEN 6 THEN '>60%' WHEN 7 THEN 'Exempt' WHEN 8 THEN 'NA' ELSE NULL END"),
    ("total_units", "CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN '5-24' WHEN 1 THEN '>149' ELSE '1' END"),
    ("income", "CASE WHEN o_orderkey % 17 = 0 THEN 'NA' WHEN o_orderkey % 19 = 0 THEN 'Exempt' "
               "ELSE CAST(20 + (o_custkey * 31) % 400 + CASE WHEN o_orderstatus = 'F' THEN 150 ELSE 0 END AS STRING) END"),
    ("loan_amount", "o_totalprice"),
    ("property_value", "CASE WHEN o_orderkey % 23 = 0 THEN 'Exempt' "
                       "ELSE CAST(5000 * (20 + o_custkey % 97) AS STRING) END"),
    ("loan_term", "CASE WHEN o_orderkey % 11 = 0 THEN 'Exempt' WHEN o_orderkey % 3 = 0 THEN '180' "
                  "ELSE '360' END"),
    ("conforming_loan_limit", "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE c_mktsegment END"),
    ("derived_ethnicity", "CASE CAST(o_custkey % 5 AS INT) WHEN 0 THEN 'Hispanic or Latino' "
                          "WHEN 1 THEN 'Not Hispanic or Latino' WHEN 2 THEN 'Joint' "
                          "WHEN 3 THEN 'NA' ELSE NULL END"),
    ("loan_purpose", "CAST(1 + o_custkey % 4 AS INT)"),
    ("lei", "c_name"),
    ("state_code", "'TX'"),
    ("denial_reason-1", "CASE WHEN o_orderstatus = 'O' THEN '1' ELSE '10' END"),
    ("interest_rate", "CASE WHEN o_orderstatus = 'F' THEN '6.5' ELSE 'NA' END"),
    ("y_prob", "CAST(LEAST(1000, GREATEST(0, (o_orderkey * 7919 + o_custkey * 104729) % 1001 + "
               "CASE WHEN o_orderstatus='F' THEN 150 ELSE -150 END)) AS DOUBLE) / CAST(1000 AS DOUBLE)"),
    ("y_prob_blind", "CAST(LEAST(1000, GREATEST(0, (o_orderkey * 7907 + o_custkey * 104729) % 1001 + "
                     "CASE WHEN o_orderstatus='F' THEN 100 ELSE -100 END)) AS DOUBLE) / CAST(1000 AS DOUBLE)"),
]

# Columns of the two driver tables the view reads (column pruning).
ORDERS_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


def _quote_spark(name: str) -> str:
    return f"`{name}`"


def _quote_sql(name: str) -> str:
    return f'"{name}"'


def application_view(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """The raw application rows for the tables in ``sf_dir``.

    Plain equi-join of orders to customer; Spark picks broadcast or
    sort-merge from table statistics, so the customer side is broadcast only
    while it is small.  A file of one row group would be one task, so the
    orders are dealt over the cores before anything is derived from them.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(*ORDERS_COLUMNS)
    orders = dealt(orders, orders.count(), "o_orderkey")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(*CUSTOMER_COLUMNS)
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "inner")
    wanted = [(n, e) for n, e in APPLICATION_VIEW if columns is None or n in columns]
    return joined.selectExpr(*[f"{e} AS {_quote_spark(n)}" for n, e in wanted])


def application_sql(columns: list[str] | None = None) -> str:
    """The same view as standard SQL over tables ``orders`` and ``customer``."""
    wanted = [(n, e) for n, e in APPLICATION_VIEW if columns is None or n in columns]
    cols = ",\n  ".join(f"{e} AS {_quote_sql(n)}" for n, e in wanted)
    return f"SELECT\n  {cols}\nFROM orders JOIN customer ON o_custkey = c_custkey"
