"""Training plan: train split → models → scored test rows → metrics.

Each model is a fitted Spark ML pipeline; the test rows are scored by all
models into one long table keyed by ``model`` so every metric is one grouped
aggregation over it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from equitally.operators import models as mdl
from equitally.operators.metrics import classification_report, confusion_matrix, leaderboard

TRAINERS = {
    "logistic": mdl.train_logistic,
    "forest": mdl.train_forest,
    "gbt": mdl.train_gbt,
    "blind": mdl.train_blind,
    "blind_parity": lambda train, **kw: mdl.train_blind(train, parity=True, **kw),
}


def train_models(train: DataFrame, kinds=("logistic", "forest", "gbt")) -> dict[str, mdl.TrainedModel]:
    return {k: TRAINERS[k](train) for k in kinds}


def score_all(models: dict[str, mdl.TrainedModel], test: DataFrame, keep=("app_id",)) -> DataFrame:
    """Long table (keep..., model, y, p, yhat) over all models (no shuffle)."""
    return reduce(lambda a, b: a.unionByName(b), [mdl.score(m, test, keep=keep) for m in models.values()])


def evaluate(scored: DataFrame) -> dict[str, DataFrame]:
    """B1, B3, B10 over the long scored table."""
    return {"leaderboard": leaderboard(scored), "confusion": confusion_matrix(scored),
            "report": classification_report(scored)}


_FITTED: dict = {}


def fitted_model(spark, sf_dir: str, kind: str, reuse: bool = True) -> mdl.TrainedModel:
    """The ``kind`` model trained on the train split of ``sf_dir`` with the
    trainer's own settings (boosted: 600 rounds of 0.05, patience 30), fitted
    once per session and reused — the way a saved champion is loaded by every
    audit step instead of being retrained."""
    from equitally.plans.prepare import train_test

    key = (id(spark), spark.sparkContext.applicationId, sf_dir, kind)
    if reuse and key in _FITTED:
        return _FITTED[key]
    train, _ = train_test(spark, sf_dir)
    model = TRAINERS[kind](train)
    _FITTED[key] = model
    return model
