"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equitally import session

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes of the batches in which whole texts go to Python, for jobs that
#: are short of memory; Spark's own 10,000 rows are 25 MB and more of them.
TEXT_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def write_table(df: DataFrame, name: str, rows: int | None = None, per_file: int = 200_000, codec: str | None = None,
                settings: dict[str, str] | None = None) -> DataFrame:
    """``session.write_table``; the job's shuffle files go as soon as the table
    is there, not when the driver happens to collect its garbage.

    ``rows``, if known, bounds the table's rows: its last stage then has a task
    and a file for every ``per_file`` of them, not one for every shuffle
    partition however small.  ``codec`` compresses large tables closer,
    ``settings`` are Spark's for this job alone.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // per_file)))
    conf, own = df.sparkSession.conf, {CLEANUP: "true", **(settings or {})}
    was = {k: conf.get(k, None) for k in own}
    for k, v in own.items():
        conf.set(k, v)
    try:
        if codec is None:
            return session.write_table(df, name)
        path = f"{session.checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return df.sparkSession.read.parquet(path)
    finally:
        for k, v in was.items():
            conf.unset(k) if v is None else conf.set(k, v)


def importable(spark: SparkSession) -> None:
    """Python workers on this machine find the package where the driver found
    it (a cluster ships it as any job's code)."""
    place = os.path.dirname(os.path.dirname(os.path.abspath(session.__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if place not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, place]))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utf8(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def rows_of(batch: pa.RecordBatch, at_once: int = 256) -> Iterator[dict]:
    """A batch's rows as dictionaries, few of them in memory at once."""
    for at in range(0, batch.num_rows, at_once):
        yield from batch.slice(at, at_once).to_pylist()


def smallest_hashes(df: DataFrame, hashed: str, rows: int) -> DataFrame:
    """Rows of ``df`` that can be among its ``rows`` distinct smallest values of
    ``hashed`` (a column of xxhash64 values): all of them where there are few,
    else those under a bound that some one and a half times as many are under.
    So a sort for a sample meets a bounded number of rows and not every row."""
    n = df.agg(F.approx_count_distinct(hashed, 0.02)).first()[0]
    if n <= 2 * rows:
        return df
    return df.where(F.col(hashed) <= int(1.5 * rows / n * 2.0 ** 64) - 2 ** 63)


def spread(df: DataFrame, *columns) -> DataFrame:
    """Deal narrow rows with heavy work over the session's shuffle partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns)


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str], at_least: int = 400_000) -> Iterator[dict]:
    """Cut a partition that is sorted by ``keys`` into pieces that end where a
    key ends.  A piece holds ``at_least`` rows where there are that many; only
    one key's own rows can make it longer."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < at_least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cols = [table[k].to_numpy() for k in keys]
        differs = np.zeros(rows - 1, bool)
        for c in cols:
            differs |= c[1:] != c[:-1]
        cuts = np.flatnonzero(differs)
        if not len(cuts):
            held = table.to_batches()
            at_least = 2 * rows
            continue
        cut = int(cuts[-1]) + 1
        yield {n: table[n].slice(0, cut) for n in table.column_names}
        held, rows = table.slice(cut).to_batches(), rows - cut
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        yield {n: table[n] for n in table.column_names}


def starts_of_runs(*columns: np.ndarray) -> np.ndarray:
    """First index of every run of equal rows."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


# A key with more than one row in this many is looked up apart from the rest.
HOT_SHARE = 1_000


def totals_of(rows: DataFrame, totals: DataFrame, key: str, columns: list[str], how: str = "left") -> DataFrame:
    """``rows`` with ``columns`` of ``totals``, which has one row per ``key`` and
    its number of rows as ``n``; null keys match each other.

    Keys that hold more than a thousandth of all rows, a thousand at most, are
    broadcast; the rest, none of them large, meet in a shuffle.  So no key's
    rows gather in one task.  Both sides are read twice: pass written tables.
    """
    hot_above = F.lit((totals.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE)
    taken = [F.col(c).alias(f"_of_{c}") for c in columns]
    hot = F.broadcast(totals.where(F.col("n") > hot_above).select(F.col(key).alias("_key"), F.lit(True).alias("_hot"), *taken))
    rest = totals.where(F.col("n") <= hot_above).select(F.col(key).alias("_key"), *taken)
    marked = rows.join(hot, F.col(key).eqNullSafe(F.col("_key")), "left")
    found = [F.col(f"_of_{c}").alias(c) for c in columns]
    own = [F.col(c) for c in rows.columns]
    cold = marked.where("_hot is null").select(*own).join(rest, F.col(key).eqNullSafe(F.col("_key")), how)
    return marked.where("_hot").select(*own, *found).unionByName(cold.select(*own, *found))


def connected_components(edges: DataFrame, name: str, at_most: int | None = None, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long), root the smallest
    node of its component.

    Alternating large-star and small-star steps; every round is one written
    table in the shared folder, so no lineage grows and a lost executor costs
    one round at most.  A node's neighbours only meet in a ``min``.  ``at_most``
    is a bound of the number of edges, if known; it only sizes files.
    """
    now = write_table(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-links", at_most)
    mark = _digest(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        now = write_table(small, f"{name}-links", 2 * mark[0])
        was, mark = mark, _digest(now)
        if mark == was:
            break
    else:
        raise RuntimeError(f"components of {name} still change after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")) \
        .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]
