"""Preparation plan: raw extract → cleaned table → exact stratified split.

Both results are written once as Parquet to the shared checkpoint folder
(the cleaned and split tables are what every later step reads), then reused
for the rest of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from equitally.operators.sampling import stratified_split
from equitally.plans.audit import cleaned_applications
from equitally.session import write_table
from equitally.sources.schema import SEED, TEST_FRACTION

_SPLITS: dict = {}


def split_applications(spark: SparkSession, sf_dir: str, test_fraction: float = TEST_FRACTION,
                       seed: int = SEED, reuse: bool = True) -> DataFrame:
    """Cleaned applications with a ``split`` column ('train' / 'test')."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir, test_fraction, seed)
    if reuse and key in _SPLITS:
        return _SPLITS[key]
    split = write_table(stratified_split(cleaned_applications(spark, sf_dir), test_fraction=test_fraction,
                                         seed=seed), "split")
    _SPLITS[key] = split
    return split


def train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sp = split_applications(spark, sf_dir)
    return sp.where("split = 'train'"), sp.where("split = 'test'")


def prepare_from_csv(spark: SparkSession, path: str | list[str], out_dir: str,
                     test_fraction: float = TEST_FRACTION, seed: int = SEED) -> dict[str, str]:
    """Raw CSV extract → keyed rows → cleaned table → exact split, written
    as Parquet under ``out_dir`` (``cleaned/`` and ``split/`` partitioned by
    split), the Spark form of the clean-then-split steps."""
    from equitally.operators.clean import clean_applications
    from equitally.sources.ingest import assign_row_key, read_header, read_raw_csv
    from equitally.sources.sinks import write_parquet

    first = path if isinstance(path, str) else path[0]
    raw = assign_row_key(read_raw_csv(spark, path, read_header(spark, first)))
    cleaned = write_table(clean_applications(raw), "cleaned")
    split = stratified_split(cleaned, test_fraction=test_fraction, seed=seed)
    out = {"cleaned": f"{out_dir.rstrip('/')}/cleaned", "split": f"{out_dir.rstrip('/')}/split"}
    write_parquet(cleaned, out["cleaned"])
    write_parquet(split, out["split"], partition_by=["split"])
    return out
