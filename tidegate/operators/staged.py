"""Boosted trees that stop at the round with the best ranking on a validation tail.

The margins after every round are one array per row, so all rounds are judged in one pass: the area under the curve of a
round is a sum over its distinct margins of counts, which are combined before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.session import scratch

PATIENCE = 50


class Trees:
    """Nodes of a fitted boosted ensemble as flat arrays; a leaf is its own child.

    ``session`` is needed in threads other than the main one, which have no active session.
    """

    def __init__(self, model, session: SparkSession | None = None):
        session = session or SparkSession.getActiveSession()
        path = scratch(session)   # the model's own table holds the nodes
        model.write().session(session).overwrite().save(path)
        nodes = session.read.parquet(f"{path}/data").select(
            F.col("treeID").alias("tree"), "nodeData.id", "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
            F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), "nodeData.prediction").orderBy(
            "tree", "id").toArrow()
        tree, node, left, right, feature = (nodes.column(c).to_numpy().astype(np.int64) for c in (
            "tree", "id", "leftChild", "rightChild", "featureIndex"))
        self.root = np.searchsorted(tree, np.arange(len(model.treeWeights)))
        first = self.root[tree]
        leaf = left < 0
        here = np.arange(len(tree))
        self.left, self.right = np.where(leaf, here, first + left), np.where(leaf, here, first + right)
        self.feature = np.where(leaf, 0, feature)
        self.threshold = nodes.column("threshold").to_pandas().fillna(0.0).to_numpy()
        self.value = nodes.column("prediction").to_numpy() * np.array(model.treeWeights)[tree]
        self.depth = max((t.depth for t in model.trees), default=0)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """(rows, rounds): the sum of the first trees' values."""
        at = np.broadcast_to(self.root, (len(x), len(self.root))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return np.cumsum(self.value[at], axis=1)


def _margins(trees: Trees, keep: int | None = None):
    """Arrow function features -> margins after every round, or after ``keep`` rounds alone."""
    @F.arrow_udf("array<double>")
    def margins(features: pa.Array) -> pa.Array:
        x = features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1)
        out = trees.margins(x)
        out = out if keep is None else out[:, keep - 1: keep]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
    return margins


def staged(rows: DataFrame, trees: Trees, features: str = "features", out: str = "margins") -> DataFrame:
    return rows.withColumn(out, _margins(trees)(vector_to_array(features)))


def auc_by_round(rows: DataFrame, margins: str = "margins", label: str = "label") -> DataFrame:
    """``round`` (from 1) and ``auc``: share of pairs of a one and a zero in the right order, ties counting half.

    NULL where a round has labels of one kind only.  Rows without label play no part.
    """
    each = rows.filter(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), F.posexplode(margins).alias("round", "m"))
    counts = each.groupBy("round", "m").agg(F.sum("y").alias("ones"), F.sum(1 - F.col("y")).alias("zeros"))
    below = F.coalesce(F.sum("zeros").over(
        Window.partitionBy("round").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    pairs = counts.withColumn("won", F.col("ones") * (below + F.col("zeros") / 2))
    return pairs.groupBy((F.col("round") + 1).alias("round")).agg(
        F.try_divide(F.sum("won"), F.sum("ones") * F.sum("zeros")).alias("auc"))


def stopping_round(aucs: dict[int, float | None], patience: int = PATIENCE) -> int:
    """The best round seen before ``patience`` rounds in a row brought nothing better; the first of equals."""
    best, at = -np.inf, 0
    for k in sorted(aucs):
        if aucs[k] is not None and aucs[k] > best:
            best, at = aucs[k], k
        elif at and k - at >= patience:
            break
    return at or max(aucs, default=0)


class StoppedTrees:
    """A boosted ensemble cut off after ``rounds`` trees."""

    def __init__(self, model, rounds: int, trees: Trees):
        self.model, self.rounds, self.trees = model, rounds, trees

    @property
    def featureImportances(self):
        return self.model.featureImportances

    def score(self, rows: DataFrame, out: str) -> DataFrame:
        """``rows`` with the probability of a one as ``out``."""
        margin: Column = F.get(_margins(self.trees, self.rounds)(vector_to_array("features")), F.lit(0))
        return rows.withColumn(out, 1 / (1 + F.exp(-2 * margin)))


class StagedBoosting:
    """Estimator: fits on rows that are not ``is_val`` and stops by the ranking of those that are."""

    def __init__(self, iterations: int, depth: int, rate: float, seed: int, patience: int = PATIENCE):
        self.settings = {"iterations": iterations, "depth": depth, "rate": rate, "seed": seed, "patience": patience}

    def fit(self, rows: DataFrame) -> StoppedTrees:
        s = self.settings
        estimator = GBTClassifier(maxIter=s["iterations"], maxDepth=s["depth"], stepSize=s["rate"], seed=s["seed"])
        model = estimator.fit(rows.filter(~F.col("is_val")))
        trees = Trees(model, rows.sparkSession)
        aucs = {r["round"]: r.auc for r in auc_by_round(staged(rows.filter("is_val"), trees)).collect()}
        return StoppedTrees(model, stopping_round(aucs, s["patience"]) or len(trees.root), trees)
