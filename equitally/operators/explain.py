"""Attribution and feature importance.

Model-internal importances (coefficients, impurity importances) are vectors
the size of the feature list.  Permutation importance and sampled Shapley
values are Spark jobs: the perturbed rows are generated as DataFrames, scored
with ONE ``transform`` of the fitted pipeline, and aggregated by key.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equitally.operators.metrics import ranking_metrics
from equitally.operators.models import TrainedModel, score
from equitally.operators.sampling import hash_order, uniform_sample
from equitally.operators.trees import LeafMasks, Walk, matrix_of, node_table
from equitally.session import checkpoint_dir, dealt
from equitally.sources.schema import SEED, TARGET


# --------------------------------------------------------------------------- #
# names
# --------------------------------------------------------------------------- #

def slot_names(trained: TrainedModel, df: DataFrame) -> list[str]:
    """Readable names of the assembled vector slots: ``num__x`` for numeric
    inputs, ``cat__x_level`` for one-hot slots, ``cat__x`` for coded ones.
    Read from the schema metadata of the transformed frame (no job runs)."""
    meta = trained.model.transform(df).schema["features"].metadata.get("ml_attr", {})
    slots = sorted((a["idx"], a.get("name", "")) for g in meta.get("attrs", {}).values() for a in g)
    names = []
    for _, raw in slots:
        if raw.endswith("__std"):
            names.append("num__" + raw[: -len("__std")])
        elif "__ohe_" in raw:
            base, level = raw.split("__ohe_", 1)
            names.append(f"cat__{base}_{level}")
        elif raw.endswith("__num"):
            names.append("num__" + raw[: -len("__num")])
        elif raw.endswith("__ord") or raw.endswith("__idx"):
            names.append("cat__" + raw.rsplit("__", 1)[0])
        else:
            names.append("num__" + raw)
    return names


def _table(spark, rows, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def top_n(df: DataFrame, column: str, n: int = 20, by_abs: bool = False) -> DataFrame:
    """The ``n`` largest rows by ``column`` (TakeOrderedAndProject)."""
    key = F.abs(F.col(column)) if by_abs else F.col(column)
    return df.orderBy(key.desc(), df.columns[0]).limit(n)


# --------------------------------------------------------------------------- #
# Model-internal importances
# --------------------------------------------------------------------------- #

def coefficient_table(trained: TrainedModel, df: DataFrame, n: int | None = 20) -> DataFrame:
    """(feature, coefficient, abs_coefficient), largest |coefficient| first."""
    names = slot_names(trained, df)
    coefs = trained.classifier.coefficients.toArray().tolist()
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("coefficient", T.DoubleType()),
                           T.StructField("abs_coefficient", T.DoubleType())])
    t = _table(df.sparkSession, [(nm, float(c), abs(float(c))) for nm, c in zip(names, coefs)], schema)
    return top_n(t, "abs_coefficient", n) if n else t


def importance_table(trained: TrainedModel, df: DataFrame, n: int | None = None,
                     column: str = "importance") -> DataFrame:
    """Tree-ensemble importances per input (normalised to sum 1)."""
    names = slot_names(trained, df)
    imp = trained.classifier.featureImportances.toArray().tolist()
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField(column, T.DoubleType())])
    t = _table(df.sparkSession, [(nm, float(v)) for nm, v in zip(names, imp)], schema)
    return top_n(t, column, n) if n else t.orderBy(F.col(column).desc(), "feature")


# --------------------------------------------------------------------------- #
# Permutation importance
# --------------------------------------------------------------------------- #

ROWS_PER_SHUFFLE = 1_000


def _salted(key: str, seed: int, salt: str):
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}-{salt}-"), F.col("feature"),
                          F.lit("-"), F.col("repeat").cast("string")))


def permuted_rows(df: DataFrame, features: list[str], repeats: int = 1, key: str = "app_id", seed: int = SEED,
                  label: str = TARGET, rows_per_shuffle: int = ROWS_PER_SHUFFLE) -> DataFrame:
    """(feature, repeat, key, label, inputs...): every row of ``df`` once per
    (feature, repeat), with that feature's value taken from another row.

    A salted hash deals the rows of each (feature, repeat) into random groups of
    about ``rows_per_shuffle``; inside a group every row takes the value of the
    next row in a second salted order, the last that of the first.  So all
    rows are permuted and no window grows with the table.
    """
    n = df.count()
    groups = max(1, -(-n // rows_per_shuffle))
    variants = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat"))
                         for r in range(repeats) for f in features])
    base = df.select(F.explode(variants).alias("v"), key, label, *features) \
        .select("v.feature", "v.repeat", key, label, *features)
    dealt = base.withColumn("_group", F.conv(F.substring(_salted(key, seed, "group"), 1, 8), 16, 10).cast("long") % F.lit(groups))
    order = Window.partitionBy("feature", "repeat", "_group").orderBy(_salted(key, seed, "perm"), key)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.row_number().over(order) == F.count(F.lit(1)).over(whole)
    return dealt.select("feature", "repeat", key, label, *[
        F.when(F.col("feature") == f, F.when(last, F.first(f).over(whole)).otherwise(F.lead(f).over(order)))
        .otherwise(F.col(f)).alias(f) for f in features])


def permutation_importance(trained: TrainedModel, df: DataFrame, sample_size: int | None = None, repeats: int = 1,
                           key: str = "app_id", seed: int = SEED, label: str = TARGET) -> DataFrame:
    """Baseline ROC-AUC minus ROC-AUC with one input column shuffled
    among all rows (``sample_size``: among a uniform sample of that many);
    mean and population std over repeats."""
    return importance_from_scores(
        lambda rows, keep: score(trained, rows, keep=keep, label=label), df if sample_size is None else
        uniform_sample(df, sample_size, key, seed), trained.numeric + trained.categorical, repeats, key, seed, label)


def importance_from_scores(scorer, rows: DataFrame, features: list[str], repeats: int = 1, key: str = "app_id",
                           seed: int = SEED, label: str = TARGET) -> DataFrame:
    """E4 for any scorer: ``scorer(rows, keep)`` gives (keep..., model, y, p, yhat).
    All variants are scored in one pass; AUCs come from the grouped ranking metric."""
    permuted = permuted_rows(rows, features, repeats, key, seed, label)
    perm_auc = ranking_metrics(scorer(permuted, (key, "feature", "repeat")), keys=["feature", "repeat"]) \
        .select("feature", "repeat", "roc_auc")
    base_auc = ranking_metrics(scorer(rows, (key,)), keys=["model"]).first()
    drops = perm_auc.select("feature", (F.lit(base_auc["roc_auc"]) - F.col("roc_auc")).alias("d"))
    return (drops.groupBy("feature").agg(F.avg("d").alias("importance_mean"),
                                          F.stddev_pop("d").alias("importance_std"))
            .orderBy(F.col("importance_mean").desc(), "feature"))


# --------------------------------------------------------------------------- #
# E5: sampled Shapley values
# --------------------------------------------------------------------------- #

def _indexed(df: DataFrame, key: str, seed: int, salt: str, name: str) -> DataFrame:
    # the background sample alone: its size is a parameter
    return df.withColumn(name, F.row_number().over(Window.orderBy(hash_order(key, seed, salt), key)))


def sampled_shapley(trained: TrainedModel, df: DataFrame, sample_size: int | None = None, background_size: int = 100,
                    permutations: int = 8, key: str = "app_id", seed: int = SEED, label: str = TARGET,
                    output: str = "probability") -> DataFrame:
    """E5: per-row, per-input Shapley values by permutation sampling, for all
    rows (``sample_size``: for a uniform sample of that many).

    For row x, permutation m (feature order from a salted hash) and a
    hash-chosen background row z, the hybrid at step j takes the first j
    features of the permutation from x and the rest from z; the change of the
    model output from step j−1 to j is credited to the j-th feature.  All
    hybrids of all rows are scored by one ``transform``, or where the model is
    boosted trees of up to 64 leaves from the trees' masks (``_masked_shapley``);
    credits are averaged per (row, feature).  Rows without a key have no values,
    of rows that share a key one counts.  By construction the values of a row sum to
    f(x) − mean f(z) over its permutations (efficiency).  ``output='margin'``
    explains the raw score, for which a linear model's values are exact.
    ``phi_error`` is the standard error of a value over its permutations.
    """
    features = trained.numeric + trained.categorical
    nf = len(features)
    checkpoint_dir(df.sparkSession)
    xs = df if sample_size is None else uniform_sample(df, sample_size, key, seed, "shap-rows")
    zs = _indexed(uniform_sample(df, background_size, key, seed, "shap-background"), key, seed,
                  "shap-background", "_b").checkpoint()
    nb = zs.count()
    z_cols = zs.select("_b", *[F.col(f).alias(f"_z_{i}") for i, f in enumerate(features)])
    # dealt by key, so the hybrids of a row lie together and are never shuffled
    xs = dealt(xs, xs.count() * permutations * (nf + 1), key)
    if isinstance(trained.classifier, GBTClassificationModel) and [i.rsplit("__", 1)[0] for i in trained.inputs] == features:
        walk = Walk(node_table(df.sparkSession, trained.classifier, trained.inputs))  # the model itself
        if LeafMasks.fits(walk):
            return _masked_shapley(trained, LeafMasks(walk, nf), xs, zs, nb, permutations, key, seed, output)
    pairs = xs.withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    pick = (F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit("-"), F.col("_m").cast("string"),
                                              F.lit(f"-{seed}-background"))), 1, 8), 16, 10).cast("long")
            % F.lit(nb)) + 1
    pairs = pairs.withColumn("_b", pick).join(F.broadcast(z_cols), "_b")  # background_size rows
    order = F.array_sort(F.array(*[
        F.struct(F.md5(F.concat(F.col(key).cast("string"), F.lit("-"), F.col("_m").cast("string"),
                                F.lit(f"-{seed}-{f}"))).alias("h"), F.lit(f).alias("f"))
        for f in features]))
    pairs = pairs.withColumn("_order", F.transform(order, lambda s: s["f"]))
    steps = pairs.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(nf))))
    hybrid = steps.select(
        key, "_m", "_step", F.col(label),
        F.when(F.col("_step") > 0, F.element_at("_order", F.greatest(F.col("_step"), F.lit(1)))).alias("_credit"),
        *[F.when(F.array_position("_order", F.lit(f)) <= F.col("_step"), F.col(f))
          .otherwise(F.col(f"_z_{i}")).alias(f) for i, f in enumerate(features)])
    out = trained.model.transform(hybrid)
    val = (vector_to_array(F.col("rawPrediction")).getItem(1) if output == "margin"
           else vector_to_array(F.col("probability")).getItem(1))
    w = Window.partitionBy(key, "_m").orderBy("_step")  # ≤ nf + 1 rows per window partition
    credits = (out.select(key, "_m", "_step", "_credit", val.alias("_v"))
               .withColumn("_delta", F.col("_v") - F.lag("_v").over(w))
               .where(F.col("_step") > 0))
    return (credits.groupBy(key, F.col("_credit").alias("feature"))
            .agg((F.sum("_delta") / F.lit(float(permutations))).alias("phi"),
                 (F.stddev_samp("_delta") / F.lit(math.sqrt(permutations))).alias("phi_error")))


# Masks (rows x trees) that are worked on at once.
MASKS_AT_ONCE = 32_768


def _masked_shapley(trained: TrainedModel, masks: LeafMasks, xs: DataFrame, zs: DataFrame, nb: int, permutations: int,
                    key: str, seed: int, output: str) -> DataFrame:
    """``sampled_shapley`` of boosted trees with one slot a feature.

    Rows go through the pipeline once and not once a hybrid.  A hybrid's masks
    are those of its features put together: of the first j of a permutation from
    x and of the rest from z, so every step of a permutation is one more ``&``
    of a running mask, and the trees are read off the bits.
    """
    features = trained.numeric + trained.categorical
    nf = len(features)
    pre = PipelineModel(stages=trained.model.stages[:-1])
    z = np.array([r["x"].toArray() for r in pre.transform(zs).select("_b", F.col("features").alias("x")).orderBy("_b").collect()])  # background_size rows
    of_z = np.stack([masks.masks(f, z[:, f]) for f in range(nf)]) if nb else None

    def salted(m, tail: str):
        return F.md5(F.concat(F.col(key).cast("string"), F.lit("-"), m.cast("string"), F.lit(f"-{seed}-{tail}")))

    every = F.sequence(F.lit(0), F.lit(permutations - 1))
    picks = F.transform(every, lambda m: F.conv(F.substring(salted(m, "background"), 1, 8), 16, 10).cast("long") % F.lit(nb))
    orders = F.flatten(F.transform(every, lambda m: F.transform(
        F.array_sort(F.array(*[F.struct(salted(m, f).alias("h"), F.lit(f).alias("f"), F.lit(i).alias("i")) for i, f in enumerate(features)])),
        lambda s: s["i"])))
    rows = pre.transform(xs.where(F.col(key).isNotNull())).select(key, vector_to_array("features").alias("x")) \
        .groupBy(key).agg(F.min("x").alias("x")).select(key, "x", picks.alias("z"), orders.alias("o"))

    def value(h: np.ndarray) -> np.ndarray:
        margin = masks.margins(h)
        return margin if output == "margin" else 1 / (1 + np.exp(-2 * margin))  # the library's margin is half the log odds

    def changes(x: np.ndarray, picked: np.ndarray, order: np.ndarray) -> np.ndarray:
        """(rows, permutations, features) credits."""
        of_x = np.stack([masks.masks(f, x[:, f]) for f in range(nf)])
        n, trees = of_x.shape[1:]
        at, out = np.arange(n), np.empty((n, permutations, nf))
        rest = np.empty((nf + 1, n, trees), np.uint64)
        rest[nf] = masks.ALL
        for m in range(permutations):
            for j in range(nf - 1, -1, -1):
                np.bitwise_and(rest[j + 1], of_z[order[:, m, j], picked[:, m]], out=rest[j])
            first, was = np.full((n, trees), masks.ALL), value(rest[0])
            for j in range(nf):
                first &= of_x[order[:, m, j], at]
                now = value(first & rest[j + 1])
                out[at, m, order[:, m, j]] = now - was
                was = now
        return out

    def run(batches):
        step = max(1, MASKS_AT_ONCE // max(1, len(masks.offsets)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                n = batch.num_rows
                credits = changes(matrix_of(batch, 1), matrix_of(batch, 2), matrix_of(batch, 3).reshape(n, permutations, nf))
                phi = credits.sum(1) / permutations
                error = credits.std(1, ddof=1) / math.sqrt(permutations) if permutations > 1 else np.full((n, nf), np.nan)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), *[pa.array(list(v), pa.list_(pa.float64())) for v in (phi, error)]], [key, "phi", "phi_error"])

    kept = f"`{key}` {rows.schema[key].dataType.simpleString()}"
    found = rows.mapInArrow(run, f"{kept}, phi array<double>, phi_error array<double>")
    each = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), "phi", "phi_error")
    return found.select(key, F.explode(each).alias("v")).select(
        key, F.col("v.feature").alias("feature"), F.col("v.phi").alias("phi"), F.nanvl("v.phi_error", F.lit(None)).alias("phi_error"))


# Inputs of the exact form (2^k variants a row), and rows of its background.
LATTICE_INPUTS, LATTICE_BACKGROUND = 12, 100


def exact_shapley(scorer, rows: DataFrame, background: DataFrame, features: list[str], key: str = "app_id",
                  label: str = TARGET) -> DataFrame:
    """E5: exact Shapley values (key, feature, phi) over the whole coalition lattice.

    For every subset S of at most ``LATTICE_INPUTS`` features, a row's value v(S)
    is the mean score of its variants that take S from the row and the rest from
    each row of ``background`` (at most ``LATTICE_BACKGROUND`` rows, checked).
    ``scorer(rows, keep)`` gives (keep..., p) and scores all variants in one
    pass; phi is the sum of v(S) with the weight that S has for the feature, so
    one aggregation by key folds all differences of subsets.
    """
    k = len(features)
    if not 1 <= k <= LATTICE_INPUTS:
        raise ValueError(f"1 to {LATTICE_INPUTS} features")
    base = background.select(*features).limit(LATTICE_BACKGROUND + 1)
    zs = base.collect()
    if not 1 <= len(zs) <= LATTICE_BACKGROUND:
        raise ValueError(f"the background has 1 to {LATTICE_BACKGROUND} rows")
    types = {f.name: f.dataType for f in base.schema.fields}
    others = F.array(*[F.struct(*[F.lit(z[f]).cast(types[f]).alias(f"z{i}") for i, f in enumerate(features)]) for z in zs])
    variants = rows.select(key, label, *features).withColumn("_set", F.explode(F.sequence(F.lit(0), F.lit(2 ** k - 1)))) \
        .withColumn("_z", F.explode(others))
    inside = [F.col("_set").bitwiseAND(1 << i) != 0 for i in range(k)]
    scored = scorer(variants.select(key, label, "_set", *[F.when(inside[i], F.col(f)).otherwise(F.col(f"_z.z{i}")).alias(f)
                                                          for i, f in enumerate(features)]), (key, "_set"))
    size = F.bit_count(F.col("_set"))
    weight = F.array(*[F.lit(math.factorial(s) * math.factorial(k - s - 1) / math.factorial(k)) for s in range(k)])
    phis = [F.sum(F.col("p") * F.when(inside[i], F.get(weight, size - 1)).otherwise(-F.get(weight, size))) / F.lit(float(len(zs)))
            for i in range(k)]
    folded = scored.groupBy(key).agg(F.array(*[F.struct(F.lit(f).alias("feature"), phi.alias("phi")) for f, phi in zip(features, phis)]).alias("_phis"))
    return folded.select(key, F.inline("_phis"))


def shapley_summary(phi: DataFrame) -> DataFrame:
    """Global summary: mean |phi| per feature, largest first."""
    return (phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
            .orderBy(F.col("mean_abs_phi").desc(), "feature"))
