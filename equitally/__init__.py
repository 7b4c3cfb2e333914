"""equitally: decision-table analytics and fairness audits on Spark DataFrames.

Every public function takes and returns ``pyspark.sql.DataFrame`` objects and
is built from Spark SQL / Spark ML primitives, so Catalyst plans, prunes and
partitions the work.  Layout:

* ``sources``   – raw ingest, landing, payload checks, sinks, test-table view
* ``functions`` – column expressions (cleaning rules, audit labels, thresholds)
* ``operators`` – table operators (cleaning, sampling, features, models,
                  metrics, fairness, calibration, attribution)
* ``plans``     – end-to-end jobs composed from the operators
* ``streaming`` – incremental audit cells over a stream of scored rows
"""

__version__ = "0.1.0"
