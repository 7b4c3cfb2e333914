"""Binary-classification metrics.

Thresholded metrics are sums of 0/1 products (one partial+final
aggregation).  Ranking metrics collapse the rows to distinct scores
(``groupBy(score)`` → tp, fp per score) and take running sums in descending
score order with the bucketed prefix sum of ``operators.ranking``; ties are
handled exactly because a tied score is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equitally.functions.thresholds import ratio
from equitally.operators.ranking import prefix_sums
from equitally.session import write_table


def _keys(df: DataFrame, keys) -> list[str]:
    """Group keys present in ``df`` (default: the model column).  Metrics
    always group by at least one key so group totals join back by key."""
    found = [k for k in (keys if keys is not None else ["model"]) if k in df.columns]
    if not found:
        raise ValueError("metrics need a group key column such as 'model'")
    return found


def confusion_counts(rows: DataFrame, keys=None, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """tp, fp, tn, fn and n per key group (one aggregation)."""
    keys = _keys(rows, keys)
    yc, pc = F.col(y).cast("long"), F.col(yhat).cast("long")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(yc * pc).alias("tp"),
        F.sum((F.lit(1) - yc) * pc).alias("fp"),
        F.sum((F.lit(1) - yc) * (F.lit(1) - pc)).alias("tn"),
        F.sum(yc * (F.lit(1) - pc)).alias("fn"),
        F.sum(yc).alias("n_pos"))


def confusion_matrix(rows: DataFrame, keys=None, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """B1: long 2×2 matrix (actual, predicted, count), all four cells present."""
    keys = _keys(rows, keys)
    c = confusion_counts(rows, keys, y, yhat)
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(k).alias("count"))
                      for a, p, k in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    return c.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.actual", "c.predicted", "c.count")


def _threshold_metrics(c: DataFrame) -> dict:
    return {
        "accuracy": ratio("tp + tn", "n"),
        "precision": ratio("tp", "tp + fp"),
        "recall": ratio("tp", "tp + fn"),
        "f1_score": ratio("2 * tp", "2 * tp + fp + fn"),
    }


def classification_metrics(rows: DataFrame, keys=None, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """B2 + B4: accuracy, precision, recall, F1, test size and positive rate."""
    keys = _keys(rows, keys)
    c = confusion_counts(rows, keys, y, yhat)
    m = _threshold_metrics(c)
    return c.select(*keys, *[v.alias(k) for k, v in m.items()],
                    F.col("n").alias("n_test"), ratio("n_pos", "n").alias("positive_rate"))


def classification_report(rows: DataFrame, keys=None, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and
    weighted averages (rows labelled '0', '1', 'accuracy', 'macro avg',
    'weighted avg')."""
    keys = _keys(rows, keys)
    c = confusion_counts(rows, keys, y, yhat)
    p1, r1, f1 = ratio("tp", "tp + fp"), ratio("tp", "tp + fn"), ratio("2 * tp", "2 * tp + fp + fn")
    p0, r0, f0 = ratio("tn", "tn + fn"), ratio("tn", "tn + fp"), ratio("2 * tn", "2 * tn + fn + fp")
    s1, s0 = F.expr("CAST(tp + fn AS DOUBLE)"), F.expr("CAST(tn + fp AS DOUBLE)")
    acc = ratio("tp + tn", "n")
    nd = F.expr("CAST(n AS DOUBLE)")

    def row(label, p, r, f, s):
        return F.struct(F.lit(label).alias("label"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1_score"), s.alias("support"))

    rows_ = F.array(
        row("0", p0, r0, f0, s0),
        row("1", p1, r1, f1, s1),
        row("accuracy", acc, acc, acc, nd),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, nd),
        row("weighted avg", (p0 * s0 + p1 * s1) / nd, (r0 * s0 + r1 * s1) / nd, (f0 * s0 + f1 * s1) / nd, nd),
    )
    return c.select(*keys, F.explode(rows_).alias("r")).select(*keys, "r.*")


def score_steps(rows: DataFrame, keys=None, y: str = "y", p: str = "p") -> DataFrame:
    """Distinct scores per group with their positive / negative counts,
    running sums in descending score order and group totals P and N."""
    keys = _keys(rows, keys)
    yc = F.col(y).cast("long")
    steps = rows.groupBy(*keys, F.col(p).alias("score")).agg(
        F.sum(yc).alias("tp"), F.sum(F.lit(1) - yc).alias("fp"))
    return step_sums(steps, keys)


def step_sums(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Running sums and totals of score steps (keys, score, tp, fp)."""
    cum = prefix_sums(steps, "score", ["tp", "fp"], keys, descending=True)
    return cum.withColumnRenamed("tot_tp", "P").withColumnRenamed("tot_fp", "N")


def ranking_metrics(rows: DataFrame, keys=None, y: str = "y", p: str = "p") -> DataFrame:
    """B5 + B6: exact ROC-AUC (ties count ½) and step-wise average precision."""
    keys = _keys(rows, keys)
    return ranking_from_steps(score_steps(rows, keys, y, p), keys)


def ranking_from_steps(s: DataFrame, keys: list[str]) -> DataFrame:
    """B5 + B6 from running score steps.  Counts become doubles before they
    are multiplied: their products pass a long's range at some 10^9 rows."""
    tp, fp, cum_tp, cum_fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "cum_tp", "cum_fp", "P", "N"))
    agg = s.groupBy(*keys).agg(
        F.sum(fp * (cum_tp - tp / F.lit(2.0))).alias("_auc"), F.sum(tp * (cum_tp / (cum_tp + cum_fp))).alias("_ap"),
        F.first(pos).alias("P"), F.first(neg).alias("N"))
    return agg.select(*keys,
                      F.try_divide(F.col("_auc"), F.col("P") * F.col("N")).alias("roc_auc"),
                      F.try_divide(F.col("_ap"), F.col("P")).alias("average_precision"))


def roc_curve(rows: DataFrame, keys=None, y: str = "y", p: str = "p", drop_intermediate: bool = True) -> DataFrame:
    """ROC points (pos, fpr, tpr, threshold), first point (0, 0, +inf).

    With ``drop_intermediate`` a point is dropped when its step equals the
    next step (second differences of both counts are zero); the neighbour is
    found by an equi-join on the position, never by a global window.  The
    points that stay are numbered anew, so positions are consecutive.
    """
    keys = _keys(rows, keys)
    s = write_table(score_steps(rows, keys, y, p), "roc-steps")
    pts = s
    if drop_intermediate:
        nxt = s.select(*keys, (F.col("pos") - 1).alias("pos"), F.col("tp").alias("next_tp"),
                       F.col("fp").alias("next_fp"))
        kept = (s.join(nxt, [*keys, "pos"], "left")
                .where((F.col("pos") == 1) | F.col("next_tp").isNull()
                       | (F.col("next_tp") != F.col("tp")) | (F.col("next_fp") != F.col("fp")))
                .select(*keys, F.col("pos").alias("_was"), "cum_fp", "cum_tp", "N", "P", "score"))
        pts = prefix_sums(kept, "_was", [], keys, descending=False)
    body = pts.select(*keys, F.col("pos").cast("long").alias("pos"),
                      ratio("cum_fp", "N").alias("fpr"), ratio("cum_tp", "P").alias("tpr"),
                      F.col("score").cast("double").alias("threshold"))
    origin = s.where(F.col("pos") == 1).select(
        *keys, F.lit(0).cast("long").alias("pos"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
        F.lit(float("inf")).alias("threshold"))
    return origin.unionByName(body)


def pr_curve(rows: DataFrame, keys=None, y: str = "y", p: str = "p") -> DataFrame:
    """Precision-recall points per distinct score plus the end point
    (precision 1, recall 0, no threshold)."""
    keys = _keys(rows, keys)
    s = write_table(score_steps(rows, keys, y, p), "pr-steps")
    body = s.select(*keys, F.col("pos").cast("long").alias("pos"),
                    ratio("cum_tp", "cum_tp + cum_fp").alias("precision"),
                    ratio("cum_tp", "P").alias("recall"),
                    F.col("score").cast("double").alias("threshold"))
    end = s.where(F.col("pos") == 1).select(
        *keys, F.lit(0).cast("long").alias("pos"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
        F.lit(None).cast("double").alias("threshold"))
    return body.unionByName(end)


def curve_area(points: DataFrame, x: str, y: str, keys=None, pos: str = "pos") -> DataFrame:
    """Trapezoid area under a curve whose points carry a consecutive
    position; the previous point is joined on ``pos - 1``."""
    keys = _keys(points, keys)
    prev = points.select(*keys, (F.col(pos) + 1).alias(pos), F.col(x).alias("_px"), F.col(y).alias("_py"))
    j = points.join(prev, [*keys, pos], "inner")
    return j.groupBy(*keys).agg(
        F.sum((F.col(x) - F.col("_px")) * (F.col(y) + F.col("_py")) / F.lit(2.0)).alias("area"))


def leaderboard(rows: DataFrame, keys=None, y: str = "y", p: str = "p", yhat: str = "yhat") -> DataFrame:
    """Accuracy, precision, recall, F1, ROC-AUC and AP per model."""
    keys = _keys(rows, keys)
    t = classification_metrics(rows, keys, y, yhat).drop("n_test", "positive_rate")
    r = ranking_metrics(rows, keys, y, p)
    return t.join(r, keys)
