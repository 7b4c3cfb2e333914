"""Deterministic, exact, partition-independent sampling.

Rows are ordered by ``md5(key || '-' || seed)`` — a property of the row, not of
its partition — so the same rows are picked however the input is split.

Exact stratified selection never sorts a whole class: rows are counted per
(class, hash-prefix bucket); a running sum over those counts (at most
``16**digits`` rows per class, distributed by ``operators.ranking``) finds,
for each class, the bucket where the cut falls.  Every row below that bucket
is selected by a plain filter, every row above it is not, and only the rows
of the single boundary bucket are ranked.  Only per-class cut points (one row
per class) reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equitally.operators.ranking import prefix_sums
from equitally.sources.schema import SEED, TARGET, TEST_FRACTION


def hash_order(key: str | Column, seed: int = SEED, salt: str | None = None) -> Column:
    """Row order key: md5 hex of ``key-seed[-salt]`` (identical in SQL engines)."""
    k = F.col(key) if isinstance(key, str) else key
    tail = f"-{seed}" if salt is None else f"-{seed}-{salt}"
    return F.md5(F.concat(k.cast("string"), F.lit(tail)))


def largest_remainder(counts: dict, k: int) -> dict:
    """Split ``k`` draws over classes proportionally to ``counts``; leftover
    draws go to the largest fractional parts (ties: smaller class value)."""
    total = sum(counts.values())
    if total == 0:
        return {c: 0 for c in counts}
    cont = {c: n * k / total for c, n in counts.items()}
    alloc = {c: math.floor(v) for c, v in cont.items()}
    left = k - sum(alloc.values())
    order = sorted(counts, key=lambda c: (-(cont[c] - alloc[c]), c))
    for c in order[:left]:
        alloc[c] += 1
    return alloc


def _digits_for(max_class_rows: int, rows_per_bucket: int = 100_000) -> int:
    if max_class_rows <= rows_per_bucket:
        return 1
    return max(1, min(8, math.ceil(math.log(max_class_rows / rows_per_bucket, 16))))


def select_first_by_hash(df: DataFrame, label: str, take: dict, key: str, seed: int = SEED,
                         digits: int | None = None, flag: str = "_selected",
                         counts: dict | None = None) -> DataFrame:
    """Mark the first ``take[class]`` rows of each class in hash order.

    Returns ``df`` with a boolean ``flag`` column.  One small aggregation for
    bucket counts; the bulk rows are never shuffled — only the rows of one
    boundary bucket per class are.
    """
    h = hash_order(key, seed)
    if counts is None:
        counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    digits = digits or _digits_for(max(counts.values(), default=0))
    hashed = df.withColumn("_h", h).withColumn("_b", F.conv(F.substring("_h", 1, digits), 16, 10).cast("long"))
    per_bucket = hashed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("cnt"))
    cum = prefix_sums(per_bucket, "_b", ["cnt"], [label], descending=False, rows_per_bucket=250_000)
    # cut bucket per class: first bucket whose running count reaches `take`
    # (one aggregation; one row per class comes back)
    cuts = {}
    partial = {c: k for c, k in take.items() if 0 < k < counts.get(c, 0)}
    for c, k in take.items():
        if c not in partial:
            cuts[c] = (-1, 0) if k <= 0 else (16 ** digits, 0)
    if partial:
        need = F.lit(None).cast("long")
        for c, k in partial.items():
            need = F.when(F.col(label) == F.lit(c), F.lit(k)).otherwise(need)
        found = (cum.where(F.col(label).isin(*partial)).withColumn("_need", need)
                 .where(F.col("cum_cnt") >= F.col("_need"))
                 .groupBy(label).agg(F.min(F.struct("_b", (F.col("cum_cnt") - F.col("cnt")).alias("before")))
                                     .alias("m"))
                 .collect())
        for r in found:
            cuts[r[0]] = (r["m"]["_b"], partial[r[0]] - r["m"]["before"])
    bucket_cut = None
    rem = None
    for c, (b, left) in cuts.items():
        cond = F.col(label) == F.lit(c)
        bucket_cut = F.when(cond, F.lit(b)) if bucket_cut is None else bucket_cut.when(cond, F.lit(b))
        rem = F.when(cond, F.lit(left)) if rem is None else rem.when(cond, F.lit(left))
    marked = hashed.withColumn("_cut", bucket_cut).withColumn("_rem", rem)
    clear = marked.where(F.col("_b") != F.col("_cut")).withColumn(flag, F.col("_b") < F.col("_cut"))
    boundary = marked.where(F.col("_b") == F.col("_cut"))
    w = Window.partitionBy(label).orderBy("_h", key)
    ranked = boundary.withColumn(flag, F.row_number().over(w) <= F.col("_rem"))
    cols = [*df.columns, flag]
    return clear.select(*cols).unionByName(ranked.select(*cols))


def stratified_split(df: DataFrame, key: str = "app_id", label: str = TARGET,
                     test_fraction: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    """exact stratified train/test split → ``split`` column.

    Test size is ``ceil(test_fraction · n)``; the train share of each class is
    the largest-remainder allocation of the train size, the rest of the class
    is test.  Which rows go to test is decided by hash order within class.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    n_test = math.ceil(test_fraction * n)
    train = largest_remainder(counts, n - n_test)
    take = {c: counts[c] - train[c] for c in counts}
    marked = select_first_by_hash(df, label, take, key, seed, flag="_is_test", counts=counts)
    return marked.withColumn("split", F.when(F.col("_is_test"), "test").otherwise("train")).drop("_is_test")


def split_report(split_df: DataFrame, label: str = TARGET, split: str = "split") -> DataFrame:
    """class counts and within-split class ratios."""
    counts = split_df.groupBy(split, label).count()
    totals = counts.groupBy(split).agg(F.sum("count").alias("split_rows"))
    return (counts.join(F.broadcast(totals), split)
            .select(split, label, "count", (F.col("count") / F.col("split_rows")).alias("ratio")))


def stratified_sample(df: DataFrame, size: int, key: str = "app_id", label: str = TARGET,
                      seed: int = SEED) -> DataFrame:
    """exactly ``size`` rows with class proportions kept (largest
    remainder); the whole input when it has at most ``size`` rows."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if sum(counts.values()) <= size:
        return df
    take = largest_remainder(counts, size)
    marked = select_first_by_hash(df, label, take, key, seed, counts=counts)
    return marked.where("_selected").drop("_selected")


def uniform_sample(df: DataFrame, size: int, key: str = "app_id", seed: int = SEED,
                   salt: str | None = None) -> DataFrame:
    """``size`` rows without replacement, first in hash order.

    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: each task keeps
    its own top ``size`` rows, so no full sort; the limit is the feature here.
    """
    return df.orderBy(hash_order(key, seed, salt), F.col(key)).limit(size)
