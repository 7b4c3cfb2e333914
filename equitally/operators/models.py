"""Classifiers on Spark ML (M1–M7).

Every model is a ``PipelineModel``: fitted statistics are baked into its
stages, so ``transform`` scores any number of rows per partition with no
shuffle, and ``write().save()`` / ``PipelineModel.load()`` persist it.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark import SparkFiles
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equitally.functions.thresholds import predict_at
from equitally.operators.features import (
    assembler,
    balanced_weights,
    fit_standard_scaler,
    missing_stage,
    one_hot_stages,
    ordinal_stage,
    positive_class_weight,
    scaling_stage,
    string_indexer,
)
from equitally.operators.sampling import hash_order
from equitally.operators.trees import Walk, auc_by_round, first_rounds, node_table
from equitally.session import checkpoint_dir, dealt, tasks_for, write_table
from equitally.sources.schema import PROTECTED_FEATURES, SEED, TARGET, THRESHOLD

NOT_FEATURES = {"app_id", TARGET, "y_prob", "y_prob_blind", "split", "weight", "is_validation",
                "model", "y", "p", "yhat"}


def feature_columns(df: DataFrame, exclude=()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) model inputs of a cleaned table."""
    skip = NOT_FEATURES | set(exclude)
    numeric, categorical = [], []
    for f in df.schema.fields:
        if f.name in skip or f.name.startswith("_"):
            continue
        if isinstance(f.dataType, T.StringType):
            categorical.append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            numeric.append(f.name)
    return numeric, categorical


def validation_indicator(df: DataFrame, fraction: float = 0.1, key: str = "app_id", seed: int = SEED,
                         output: str = "is_validation") -> DataFrame:
    """M4: a deterministic ``fraction`` of training rows held out for early
    stopping (hash of the key, so independent of partitioning)."""
    h = F.conv(F.substring(hash_order(key, seed, "validation"), 1, 8), 16, 10).cast("double")
    return df.withColumn(output, h < F.lit(fraction * 16 ** 8))


@dataclass
class TrainedModel:
    name: str
    model: PipelineModel
    numeric: list[str]
    categorical: list[str]
    inputs: list[str] = field(default_factory=list)
    # boosted trees: rounds fitted, and the round (from 0) that was kept last
    rounds: int | None = None
    best_iteration: int | None = None
    # boosted trees: held-out ROC-AUC after every fitted round
    round_auc: list[float] = field(default_factory=list)

    @property
    def classifier(self):
        return self.model.stages[-1]


def train_logistic(train: DataFrame, name: str = "logistic", exclude=(), max_iter: int = 3000,
                   c: float = 1.0, tol: float = 1e-6) -> TrainedModel:
    """M1: L2 logistic regression on standardised numerics + one-hot
    categoricals, class-balanced weights; ``regParam = 1/(C·Σw)`` matches the
    C-parameterised objective."""
    numeric, categorical = feature_columns(train, exclude)
    weighted = balanced_weights(train, output="weight")
    stats = fit_standard_scaler(weighted, numeric)
    total_w = weighted.agg(F.sum("weight")).first()[0]
    inputs = [f"{x}__std" for x in numeric] + [f"{x}__ohe" for x in categorical]
    stages = [scaling_stage(stats), *(one_hot_stages(categorical) if categorical else []), assembler(inputs),
              LogisticRegression(featuresCol="features", labelCol=TARGET, weightCol="weight",
                                 regParam=1.0 / (c * total_w), elasticNetParam=0.0, standardization=False,
                                 maxIter=max_iter, tol=tol, fitIntercept=True)]
    return TrainedModel(name, Pipeline(stages=stages).fit(weighted), numeric, categorical, inputs)


def train_forest(train: DataFrame, name: str = "forest", exclude=(), num_trees: int = 100, max_depth: int = 10,
                 min_instances: int = 2, seed: int = SEED) -> TrainedModel:
    """M2: random forest on numerics + ordinal-coded categoricals (unknown
    → −1, treated as ordered numbers), class-balanced weights."""
    numeric, categorical = feature_columns(train, exclude)
    weighted = balanced_weights(train, output="weight")
    indexers = Pipeline(stages=[string_indexer(c) for c in categorical]).fit(weighted) if categorical else None
    levels = {c: len(m.labels) for c, m in zip(categorical, indexers.stages)} if indexers else {}
    inputs = [f"{c}__num" for c in numeric] + [f"{c}__ord" for c in categorical]
    pre = [*([missing_stage(numeric)] if numeric else []), *(indexers.stages if indexers else []),
           *([ordinal_stage(levels)] if categorical else []), assembler(inputs)]
    prepared = PipelineModel(stages=pre).transform(weighted).select("features", TARGET, "weight")
    prepared = with_metadata(dealt(prepared, prepared.count()), prepared, "features")
    rf = RandomForestClassifier(featuresCol="features", labelCol=TARGET, weightCol="weight", numTrees=num_trees,
                                maxDepth=max_depth, minInstancesPerNode=min_instances,
                                featureSubsetStrategy="sqrt", seed=seed, maxBins=64).fit(prepared)
    return TrainedModel(name, PipelineModel(stages=[*pre, rf]), numeric, categorical, inputs)


def optimum_table(trained: TrainedModel, train: DataFrame, c: float = 1.0) -> DataFrame:
    """M1: (feature, coefficient, gradient) of the fitted penalised, weighted
    loss, per unit of weight: zero at its optimum.  One aggregation over the
    training rows; the intercept, which has no penalty, comes as ``intercept``."""
    from equitally.operators.explain import slot_names

    rows = trained.model.transform(balanced_weights(train, output="weight"))
    k = len(trained.inputs) and int(trained.classifier.numFeatures)
    x = vector_to_array("features")
    off = F.col("weight") * (vector_to_array("probability").getItem(1) - F.col(TARGET))
    sums = rows.select(off.alias("off"), "weight", x.alias("x")).agg(
        F.array(*[F.sum(F.col("off") * F.get("x", F.lit(i))) for i in range(k)], F.sum("off")).alias("g"), F.sum("weight").alias("w")).first()
    coefs = [*trained.classifier.coefficients.toArray().tolist(), float(trained.classifier.intercept)]
    penalty = [*[v / c for v in coefs[:-1]], 0.0]
    out = [(n, v, (g + a) / sums["w"]) for n, v, g, a in zip([*slot_names(trained, train), "intercept"], coefs, sums["g"], penalty)]
    return train.sparkSession.createDataFrame(out, "feature string, coefficient double, gradient double")


# Round counts that early stopping fits in turn, and its patience.
ROUND_STEPS = (60, 180)
PATIENCE = 30


def train_gbt(train: DataFrame, name: str = "gbt", exclude=(), max_iter: int = 600, step: float = 0.05,
              max_depth: int = 6, subsample: float = 0.9, feature_fraction: str = "0.8",
              min_instances: int = 2, patience: int = PATIENCE, seed: int = SEED,
              class_weight: bool = True, early_stopping: bool = True) -> TrainedModel:
    """M3 / M5: gradient-boosted trees with native categorical splits (F8),
    positive-class weight (F10) and early stopping on a held-out part of
    train (M4).  ``exclude`` drops inputs (the blind model drops the
    protected attributes).  A missing number is a value of its own.

    Boosting stops once the held-out ROC-AUC has not improved for ``patience``
    rounds.  The areas of all rounds come from one pass over the held-out rows,
    and the model is cut after its best round without another fit.  The first
    trees of a longer fit are those of a shorter one, so the rounds are tried in
    steps (``ROUND_STEPS``).
    """
    numeric, categorical = feature_columns(train, exclude)
    data = validation_indicator(train)
    data = positive_class_weight(data, output="weight") if class_weight else data.withColumn("weight", F.lit(1.0))
    inputs = [f"{c}__num" for c in numeric] + [f"{c}__idx" for c in categorical]
    arity = 0
    if categorical:
        counts = data.agg(*[F.countDistinct(c).alias(f"d{i}") for i, c in enumerate(categorical)]).first()
        arity = max(counts)
    checkpoint_dir(train.sparkSession)
    pre = Pipeline(stages=[*([missing_stage(numeric)] if numeric else []), *[string_indexer(c) for c in categorical],
                           assembler(inputs)]).fit(data)
    # all rounds read the assembled rows from one written table
    prepared = pre.transform(data).select("features", TARGET, "weight", "is_validation")
    ready = write_table(prepared, "gbt-rows")
    n = ready.count()
    ready = with_metadata(dealt(ready, n) if tasks_for(train.sparkSession, n) > 1 else ready.coalesce(1), prepared, "features")
    fit_on, held_out = (ready.where("not is_validation"), ready.where("is_validation")) if early_stopping else (ready, None)

    def fit(rounds: int):
        return GBTClassifier(featuresCol="features", labelCol=TARGET, weightCol="weight", maxIter=rounds,
                             stepSize=step, maxDepth=max_depth, subsamplingRate=subsample,
                             featureSubsetStrategy=feature_fraction, minInstancesPerNode=min_instances,
                             seed=seed, maxBins=max(32, arity + 2), checkpointInterval=25).fit(fit_on)

    rounds, best, areas = max_iter, max_iter - 1, []
    if early_stopping and not held_out.isEmpty():
        for rounds in [*[r for r in ROUND_STEPS if r < max_iter], max_iter]:
            fitted = fit(rounds)
            walk = Walk(node_table(train.sparkSession, fitted, inputs))
            areas = [r["roc_auc"] for r in auc_by_round(walk, held_out, TARGET).orderBy("round").collect()]  # one a round
            best, waited = best_round([-a for a in areas], patience)
            if waited:
                break
        fitted = first_rounds(fitted, best + 1)
    else:
        fitted = fit(max_iter)
    return TrainedModel(name, PipelineModel(stages=[*pre.stages, fitted]), numeric, categorical, inputs, rounds, best, areas)


def best_round(losses: list[float], patience: int) -> tuple[int, bool]:
    """(round with the least loss before patience ran out, whether it did)."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best, True
    return best, False


def with_metadata(df: DataFrame, like: DataFrame, column: str) -> DataFrame:
    """``df`` with the ML attributes that ``like`` has for ``column``."""
    return df.withMetadata(column, like.schema[column].metadata)


def train_blind(train: DataFrame, protected=tuple(PROTECTED_FEATURES), parity: bool = False,
                **kwargs) -> TrainedModel:
    """M5: the champion recipe retrained without the protected attributes.

    Default: identical hyper-parameters, so the comparison isolates the
    inputs.  ``parity=True`` uses the audited workflow's own blind settings
    (100 rounds, library-default learning settings, no class weight).
    """
    if parity:
        return train_gbt(train, name="blind", exclude=protected, max_iter=100, step=0.3, subsample=1.0,
                         feature_fraction="all", min_instances=1, class_weight=False, early_stopping=False)
    return train_gbt(train, name="blind", exclude=protected, **kwargs)


def score(trained: TrainedModel, df: DataFrame, threshold: float = THRESHOLD, keep=("app_id",),
          label: str = TARGET) -> DataFrame:
    """M6: probabilities and hard decisions for every row (no shuffle).

    Output ``(keep..., model, y, p, yhat)``; ``yhat = p >= threshold`` so the
    decision never depends on the library's argmax tie rule.
    """
    out = trained.model.transform(df)
    p = vector_to_array(F.col("probability")).getItem(1)
    cols = [c for c in keep if c in df.columns]
    return out.select(*cols, F.lit(trained.name).alias("model"), F.col(label).cast("int").alias("y"),
                      p.alias("p")).withColumn("yhat", predict_at("p", threshold))


def score_with_function(df: DataFrame, predict, feature_cols: list[str], name: str, threshold: float = THRESHOLD,
                        keep=("app_id",), label: str = TARGET, batch_rows: int | None = None) -> DataFrame:
    """M7: bounded-memory scoring with any Python scorer.

    ``predict(pandas.DataFrame) -> array of probabilities`` runs inside
    ``mapInPandas`` on at most ``batch_rows`` rows at a time (default: one Arrow
    batch), so memory per task is bounded however large the table is.  Scoring
    is embarrassingly parallel: no shuffle.
    """
    cols = [c for c in keep if c in df.columns]
    schema = T.StructType([*[df.schema[c] for c in cols], T.StructField("model", T.StringType()),
                           T.StructField("y", T.IntegerType()), T.StructField("p", T.DoubleType())])

    def run(batches):
        import pandas as pd

        for whole in batches:
            size = batch_rows or max(1, len(whole))
            for at in range(0, len(whole), size):
                pdf = whole.iloc[at:at + size]
                out = pdf[cols].copy()
                out["model"] = name
                out["y"] = pdf[label].astype("int32")
                out["p"] = pd.Series(predict(pdf[feature_cols]), index=pdf.index).astype("float64")
                yield out

    scored = df.select(*cols, *[c for c in feature_cols if c not in cols], label).mapInPandas(run, schema)
    return scored.withColumn("yhat", predict_at("p", threshold))


def send_to_executors(spark: SparkSession, path: str) -> str:
    """Bring a file or folder to every executor; gives its name for ``SparkFiles.get``.

    Spark sends no folder of the driver's own file system to a cluster, so such
    a folder goes as an archive, which Spark unpacks under a name of its own.
    """
    sc = spark.sparkContext
    last = path.rstrip("/").rsplit("/", 1)[-1]
    at = urlparse(path)
    own = unquote(at.path).rstrip("/") if at.scheme == "file" else path.rstrip("/")
    if at.scheme not in ("", "file") or not os.path.isdir(own):
        sc.addFile(path, recursive=True)
        return last
    # the driver serves the archive as long as the session lives
    packed = tempfile.mkdtemp(prefix="equitally-send-")
    atexit.register(shutil.rmtree, packed, ignore_errors=True)
    name = f"saved-{uuid.uuid4().hex}"
    sc.addArchive(f"{Path(shutil.make_archive(os.path.join(packed, name), 'zip', own)).as_uri()}#{name}")
    return name


def score_with_saved(df: DataFrame, path: str, load, feature_cols: list[str], name: str, threshold: float = THRESHOLD,
                     keep=("app_id",), label: str = TARGET, batch_rows: int = 4096, width: int | None = None) -> DataFrame:
    """M7: bounded-memory scoring with a saved model of any library.

    ``path`` is a folder or file in a store that Spark reads; Spark brings it to
    every executor once, and no task carries the model.  There ``load(local
    path)`` runs once in a Python worker and returns ``predict(matrix) -> array
    of probabilities``, which is called with ``batch_rows`` rows at most.  The
    matrix holds ``feature_cols`` as doubles, or the one array column of
    ``width`` numbers; a null number or array is NaN there.  No shuffle.

    Two models need two names of their last path part (``write_table`` makes
    such names).  Rows keep their ``label`` as ``y``, null if it is null.
    """
    if width is not None and len(feature_cols) != 1:
        raise ValueError("width belongs to a single array column")
    last = send_to_executors(df.sparkSession, path)

    def make():
        predict = load(SparkFiles.get(last))

        def on_batch(x):
            return predict(x)
        return on_batch

    if width is None:
        matrix = F.array(*[F.col(f"`{c}`").cast("double") for c in feature_cols])
    else:
        matrix = F.coalesce(F.col(f"`{feature_cols[0]}`").cast("array<double>"), F.array_repeat(F.lit(float("nan")), width))
    udf = predict_batch_udf(make, return_type=T.DoubleType(), batch_size=batch_rows,
                            input_tensor_shapes=[[width or len(feature_cols)]])
    cols = [c for c in keep if c in df.columns]
    return df.select(*cols, F.lit(name).alias("model"), F.col(label).cast("int").alias("y"), udf(matrix).alias("p")) \
        .withColumn("yhat", predict_at("p", threshold))


def save_model(trained: TrainedModel, path: str) -> None:
    """Persist the fitted pipeline (Spark ML format, any shared FS) with the
    model's name, inputs and boosting rounds."""
    trained.model.write().overwrite().save(path)
    about = {k: v for k, v in asdict(replace(trained, model=None)).items() if k != "model"}
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}-about")


def load_model(path: str) -> TrainedModel:
    """Load a persisted pipeline with its name and input lists."""
    about = SparkSession.active().read.text(f"{path.rstrip('/')}-about").first()[0]
    return TrainedModel(model=PipelineModel.load(path), **json.loads(about))
