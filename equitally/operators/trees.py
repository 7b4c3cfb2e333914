"""Fitted tree ensembles as tables.

A fitted forest or boosted model becomes one row per node: tree, node, input,
threshold or level set, children, value, gain.  The table has as many rows as
the model has nodes, whatever the data's size; everything about a model is then
an aggregation over it, its scores are a walk through it, and another engine
needs nothing but this table to score the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equitally.operators.metrics import ranking_metrics
from equitally.session import checkpoint_dir, write_table

# Margins are added up in whole billionths, so that sums do not depend on order.
UNIT = 1e9
ROWS_AT_ONCE = 1_024


def node_table(spark, classifier, inputs: list[str]) -> DataFrame:
    """One row per node of a fitted tree ensemble.

    ``tree, weight, node, slot, input, threshold, levels, left_child,
    right_child, value, impurity, gain, n, mass`` (``mass``: the weights of the
    ``n`` training rows).  A row of the data goes left if its
    input is at most ``threshold``, or in ``levels`` if that is set.  ``value``
    is a forest node's share of class 1 and a boosted tree's prediction.  A
    leaf has no input, no gain, and children −1.
    """
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/ensemble-{uuid.uuid4().hex}"
    classifier.write().overwrite().save(path)
    stats = F.col("nodeData.impurityStats")
    boosted = "GBT" in type(classifier).__name__
    mass = stats[0] if boosted else stats[0] + stats[1]
    value = F.col("nodeData.prediction") if boosted else stats[1] / mass
    inner, at = F.col("nodeData.leftChild") >= 0, F.col("nodeData.split")
    ordered = at["numCategories"] < 0
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "about", "weight").select("tree", "weight")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"),
        F.when(inner, at["featureIndex"]).alias("slot"),
        F.when(inner, F.get(F.array(*[F.lit(i) for i in inputs]), at["featureIndex"])).alias("input"),
        F.when(inner & ordered, F.get(at["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner & ~ordered, at["leftCategoriesOrThreshold"]).alias("levels"),
        F.col("nodeData.leftChild").alias("left_child"), F.col("nodeData.rightChild").alias("right_child"),
        value.alias("value"), F.col("nodeData.impurity").alias("impurity"), F.when(inner, F.col("nodeData.gain")).alias("gain"),
        F.col("nodeData.rawCount").alias("n"), mass.alias("mass"))
    return write_table(nodes.join(F.broadcast(weights), "tree"), "nodes")  # one weight a tree


def tree_sql(nodes: list, x: str = "x") -> str:
    """The nodes of one tree (rows of ``node_table``) as an SQL expression over
    an array ``x`` of the model's inputs; in Spark's and DuckDB's dialect alike."""
    of = {n["node"]: n for n in nodes}

    def at(i: int) -> str:
        n = of[i]
        if n["left_child"] < 0:
            return f"CAST({n['value']!r} AS DOUBLE)"
        v = f"{x}[{n['slot']}]"
        test = f"{v} <= CAST({n['threshold']!r} AS DOUBLE)" if n["levels"] is None else \
            f"{v} IN ({', '.join(repr(float(c)) for c in n['levels']) or 'NULL'})"
        return f"CASE WHEN {test} THEN {at(n['left_child'])} ELSE {at(n['right_child'])} END"
    return at(0)


def ensemble_sql(nodes: DataFrame, x: str = "x") -> str:
    """A whole ensemble as one SQL expression: the weighted sum of its trees.

    For ensembles small enough to be a statement; ``walk`` takes any.
    """
    by_tree: dict[int, list] = {}
    for n in nodes.collect():  # the model itself
        by_tree.setdefault(n["tree"], []).append(n)
    return " + ".join(f"CAST({t[0]['weight']!r} AS DOUBLE) * ({tree_sql(t, x)})" for _, t in sorted(by_tree.items()))


class Walk:
    """All trees of an ensemble as arrays, walked level by level."""

    def __init__(self, nodes: DataFrame):
        rows = sorted(nodes.collect(), key=lambda n: (n["tree"], n["node"]))  # the model itself, not data
        place = {(n["tree"], n["node"]): i for i, n in enumerate(rows)}
        self.trees = sorted({n["tree"] for n in rows})
        self.root = np.array([place[t, 0] for t in self.trees])
        self.node = np.array([n["node"] for n in rows])
        self.leaf = np.array([n["left_child"] < 0 for n in rows])
        self.left, self.right = (np.array([place[n["tree"], n[c]] if n[c] >= 0 else i for i, n in enumerate(rows)])
                                 for c in ("left_child", "right_child"))
        self.slot = np.array([n["slot"] or 0 for n in rows])
        self.threshold = np.array([np.nan if n["threshold"] is None else n["threshold"] for n in rows])
        self.value = np.array([n["value"] for n in rows])
        self.weight = np.array([n["weight"] for n in rows])
        self.units = np.array([round(n["weight"] * n["value"] * UNIT) for n in rows])
        levels = [n["levels"] or [] for n in rows]
        self.by_level = np.array([n["levels"] is not None for n in rows])
        # membership of level codes in a node's left set
        self.member = np.zeros((len(rows), int(max((max(s) for s in levels if s), default=0)) + 1), bool)
        for i, s in enumerate(levels):
            self.member[i, np.array(s, int)] = True

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows × trees) positions of the leaves that the rows of ``x`` reach."""
        at = np.repeat(self.root[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        while not self.leaf[at].all():
            v = x[rows, self.slot[at]]
            code = np.clip(v, 0, self.member.shape[1] - 1).astype(int)
            known = (v >= 0) & (v < self.member.shape[1])
            left = np.where(self.by_level[at], self.member[at, code] & known, v <= self.threshold[at])
            at = np.where(left, self.left[at], self.right[at])
        return at


class LeafMasks:
    """An ensemble of trees of up to 64 leaves as tables of bit masks, by slot.

    The leaves of a tree are bits, from the left.  A node whose test fails rules
    out the leaves on its left, so the least bit that all failing nodes leave is
    the leaf that a row reaches.  ``tables[slot]`` has, for every place that a
    value can take among the slot's thresholds (or every level code), the masks
    of all trees; masks of different slots are put together with ``&``.
    """

    ALL = np.uint64((1 << 64) - 1)

    def __init__(self, walk: Walk, slots: int):
        trees = len(walk.trees)
        self.values = np.zeros((trees, 64))
        tests: list[list] = [[] for _ in range(slots)]

        def leaves_under(t: int, i: int, at: int) -> int:
            if walk.leaf[i]:
                self.values[t, at] = walk.value[i] * walk.weight[i]
                return at + 1
            middle = leaves_under(t, walk.left[i], at)
            tests[walk.slot[i]].append((t, i, self.ALL ^ np.uint64((1 << middle) - (1 << at))))
            return leaves_under(t, walk.right[i], middle)

        for t, root in enumerate(walk.root):
            leaves_under(t, root, 0)
        self.offsets = np.arange(trees) * 64
        self.levels = walk.member.shape[1]
        self.cuts: list = []
        self.tables = []
        for found in tests:
            by_level = any(walk.by_level[i] for _, i, _ in found)
            self.cuts.append(None if by_level else np.unique([walk.threshold[i] for _, i, _ in found]))
            table = np.full((self.levels + 1 if by_level else len(self.cuts[-1]) + 1, trees), self.ALL)
            for t, i, mask in found:
                fails = np.append(~walk.member[i], True) if by_level else np.arange(len(table)) > np.searchsorted(self.cuts[-1], walk.threshold[i])
                table[fails, t] &= mask
            self.tables.append(table)

    @staticmethod
    def fits(walk: Walk) -> bool:
        """Whether no tree has over 64 leaves, and no slot both kinds of tests."""
        leaves = np.add.reduceat(walk.leaf.astype(int), walk.root)
        inner = ~walk.leaf
        return leaves.max(initial=0) <= 64 and not set(walk.slot[inner & walk.by_level]) & set(walk.slot[inner & ~walk.by_level])

    def masks(self, slot: int, v: np.ndarray) -> np.ndarray:
        """(values x trees) masks of the values ``v`` of a slot."""
        if self.cuts[slot] is not None:
            return self.tables[slot][np.searchsorted(self.cuts[slot], v)]
        known = (v >= 0) & (v < self.levels)
        return self.tables[slot][np.where(known, v, self.levels).astype(int)]

    def margins(self, masks: np.ndarray) -> np.ndarray:
        """The sum of all trees' weighted leaf values, from (rows x trees) masks."""
        leaf = np.bitwise_count((masks & (~masks + np.uint64(1))) - np.uint64(1))
        return self.values.ravel()[self.offsets + leaf].sum(1)


def matrix_of(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def staged_margins(walk: Walk, assembled: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., margins): the margin after every round, in billionths, of every
    row of ``assembled`` (with the model's ``features``), in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                margins = np.cumsum(walk.units[walk.leaves(matrix_of(batch, len(keep)))], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(margins), pa.list_(pa.int64()))], [*keep, "margins"])

    rows = assembled.select(*keep, vector_to_array("features").alias("x"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}, margins array<long>")


def auc_by_round(walk: Walk, assembled: DataFrame, label: str) -> DataFrame:
    """M3: (round, roc_auc) of every round over the rows of ``assembled``; equal
    margins count half.  Rounds that are ordered alike have equal areas."""
    margins = staged_margins(walk, assembled, [label])
    rounds = margins.select(F.col(label).cast("int").alias("y"), F.posexplode("margins").alias("round", "units")) \
        .withColumn("p", F.col("units") / F.lit(UNIT)).withColumn("yhat", (F.col("units") >= 0).cast("int"))
    return ranking_metrics(rounds, keys=["round"]).select("round", "roc_auc")


def newton_leaves(walk: Walk, assembled: DataFrame, label: str, weight: str, l2: float = 1.0,
                  min_hessian: float = 2.0) -> DataFrame:
    """M3: second-order values of a boosted model's leaves: (tree, leaf, n, g, h, value).

    Sums of gradient and hessian of the log loss at the margins before each tree,
    as one grouped aggregation over all trees; value = −G / (H + l2), the step
    in log odds.  A leaf whose hessian is below ``min_hessian`` takes the value
    of the leaf and its sibling together, where the sibling is a leaf too.
    """
    tree_of = np.repeat(np.array(walk.trees), len(walk.trees) and 1)

    def run(batches):
        sums = np.zeros((3, len(walk.leaf)))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                leaf = walk.leaves(matrix_of(batch, 2))
                y, w = (batch.column(i).to_numpy(zero_copy_only=False).astype(float)[:, None] for i in (0, 1))
                units = walk.units[leaf]
                before = (np.cumsum(units, axis=1) - units) / UNIT
                p = 1 / (1 + np.exp(-2 * before))  # the library's margin is half the log odds
                n, k = leaf.shape
                for i, v in enumerate((np.ones((n, k)), w * (p - y), w * p * (1 - p))):
                    np.add.at(sums[i], leaf, v)
        # a row a task and leaf, however many rows the task has
        hit = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), *[pa.array(s[hit]) for s in sums]], ["at", "n", "g", "h"])

    parts = assembled.select(F.col(label).cast("int").alias("y"), F.col(weight).cast("double").alias("w"),
                             vector_to_array("features").alias("x")).mapInArrow(run, "at long, n double, g double, h double")
    sums = parts.groupBy("at").agg(F.sum("n").cast("long").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))
    tree = np.searchsorted(walk.root, np.arange(len(walk.leaf)), "right") - 1
    parent = np.full(len(walk.leaf), -1)
    inner = np.flatnonzero(~walk.leaf)
    parent[walk.left[inner]], parent[walk.right[inner]] = inner, inner
    places = [(int(i), int(tree_of[tree[i]]), int(walk.node[i]), int(parent[i])) for i in np.flatnonzero(walk.leaf)]
    leaves = assembled.sparkSession.createDataFrame(places, "at long, tree int, leaf int, parent long")
    whole = F.broadcast(leaves).join(sums, "at")  # leaves of the model
    both = whole.groupBy("parent").agg(F.sum("g").alias("gp"), F.sum("h").alias("hp"))
    small = (F.col("h") < min_hessian) & (F.col("parent") >= 0)
    return whole.join(both, "parent").select(
        "tree", "leaf", "n", "g", "h",
        (-F.when(small, F.col("gp")).otherwise(F.col("g")) / (F.when(small, F.col("hp")).otherwise(F.col("h")) + l2)).alias("value"))


def gain_table(nodes: DataFrame, per_tree: bool) -> DataFrame:
    """Per input the number of splits, total and average gain per split,
    impurity decrease (gain times the weight of the node's rows) and the
    normalised importance: the input's share of all decreases (boosted trees),
    or with ``per_tree`` the mean of its shares in every tree (forests).
    Inputs that no tree splits on have no row."""
    splits = nodes.where("left_child >= 0").withColumn("decrease", F.col("gain") * F.col("mass"))
    of_tree = splits.groupBy("tree").agg(F.sum("decrease").alias("whole"))
    shares = splits.join(F.broadcast(of_tree), "tree")  # one row a tree
    share = F.expr("coalesce(try_divide(decrease, whole), 0D)") if per_tree else F.col("decrease")
    out = shares.groupBy("input").agg(
        F.count("*").alias("splits"), F.sum("gain").alias("total_gain"), F.avg("gain").alias("average_gain"),
        F.sum("decrease").alias("decrease"), F.sum(share).alias("_share"))
    whole = out.agg(F.sum("_share").alias("_all"))
    return out.crossJoin(F.broadcast(whole)).select(
        F.concat(F.when(F.col("input").endswith("__num"), "num__").otherwise("cat__"),
                 F.regexp_replace("input", "__(num|ord|idx)$", "")).alias("feature"),
        "splits", "total_gain", "average_gain", "decrease", F.expr("coalesce(try_divide(_share, _all), 0D)").alias("importance"))


def first_rounds(fitted, rounds: int):
    """A boosted model's first ``rounds`` trees as a model, without another fit."""
    from pyspark.ml.classification import GBTClassificationModel
    from pyspark.sql import SparkSession

    sc = SparkSession.active().sparkContext
    java, jvm = fitted._java_obj, sc._jvm
    trees = sc._gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = sc._gateway.new_array(jvm.double, rounds)
    for i, (tree, weight) in enumerate(zip(list(java.trees())[:rounds], list(java.treeWeights())[:rounds])):
        trees[i], weights[i] = tree, float(weight)
    cut = jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), trees, weights)
    return GBTClassificationModel(cut.copy(java.extractParamMap()))
