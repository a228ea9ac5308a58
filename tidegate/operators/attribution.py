"""Shapley values of tree ensembles for every row.

A leaf pays its value to rows inside the box of its path.  While a feature is unknown, its splits let through the share of
training rows that went the leaf's way.  The gain of a feature, averaged over all orders in which features become known, is
an integral of a product of linear terms, one for each feature of the path, over the moment in [0, 1] at which the feature
becomes known; Gauss-Legendre points for the path's length give it without error.  So a row costs leaves x path x points,
with no sum over subsets, and the values of a row add up to its prediction minus the ensemble's mean.

Boosted trees are explained on the margin (half the log odds), forests on the probability of a one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.columns import stack_rows
from tidegate.operators.staged import StoppedTrees
from tidegate.session import scratch

NODES = "tree int, id int, left int, right int, feature int, threshold double, cover double, value double"
ROWS_AT_ONCE, LEAVES_AT_ONCE = 128, 512


def model_nodes(model, session: SparkSession) -> DataFrame:
    """The nodes of a fitted ``pyspark.ml`` tree ensemble, or of a stopped one, as ``NODES``.

    ``cover`` is the training weight that reached a node, ``value`` what a leaf adds to the prediction.
    """
    rounds, fitted = (model.rounds, model.model) if isinstance(model, StoppedTrees) else (None, model)
    path = scratch(session)
    fitted.write().overwrite().save(path)
    node = session.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    stats, weights = F.col("impurityStats"), list(fitted.treeWeights)
    if hasattr(fitted, "numClasses") and not hasattr(fitted, "evaluateEachIteration"):   # a forest of class counts
        cover = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
        value = F.try_divide(F.get(stats, F.lit(1)), cover) / len(weights)
    else:
        cover = F.get(stats, F.lit(0))
        boosted = hasattr(fitted, "evaluateEachIteration")
        value = F.col("prediction") * (F.get(F.array(*map(F.lit, weights)), F.col("tree")) if boosted else F.lit(1 / len(weights)))
    if rounds is not None:
        node = node.filter(F.col("tree") < rounds)
    return node.select(
        "tree", "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), cover.alias("cover"), value.alias("value"))


class Leaves:
    """One line for each leaf: the features of its path, their bounds (low, high] and shares, and its value.

    ``nodes`` are the rows of ``NODES``; ``left`` is negative in a leaf, node 0 of a tree its root.  They come to the
    driver, which holds the model anyway.  Splits of one feature on a path are one entry.
    """

    def __init__(self, nodes: DataFrame):
        t = nodes.orderBy("tree", "id").toArrow()
        column = {c: t.column(c).to_pandas().fillna(0).to_numpy() for c in t.column_names}
        key = {k: i for i, k in enumerate(zip(column["tree"].tolist(), column["id"].tolist()))}
        inner = column["left"] >= 0
        child = {side: np.array([key[k, c] if c >= 0 else -1 for k, c in zip(column["tree"].tolist(), column[side].tolist())], int)
                 for side in ("left", "right")}
        at = np.flatnonzero(column["id"] == 0)
        done, width = [], 0
        path = [np.zeros((len(at), 0)) for _ in range(4)]
        while len(at):
            leaf = ~inner[at]
            done.append((at[leaf], [p[leaf] for p in path]))
            at, path = at[~leaf], [p[~leaf] for p in path]
            if not len(at):
                break
            width += 1
            sides = [self._step(path, column, at, child[side][at], side == "left") for side in ("left", "right")]
            at, path = np.concatenate([child["left"][at], child["right"][at]]), [np.concatenate(p) for p in zip(*sides)]
        fill = (0, -np.inf, np.inf, 1.0)   # an entry of its own that is always met and never counts
        self.feature, self.low, self.high, self.share = (np.concatenate([
            np.pad(p[k], ((0, 0), (0, width - p[k].shape[1])), constant_values=fill[k]) for _, p in done]) if done else np.zeros((0, 0))
            for k in range(4))
        self.feature = self.feature.astype(int)
        self.value = np.concatenate([column["value"][leaf] for leaf, _ in done]) if done else np.zeros(0)
        self.mean = float((self.value * self.share.prod(axis=1)).sum())

    @staticmethod
    def _step(path, column, parent, child, left: bool):
        """The paths of ``parent`` led on to ``child``: a feature met before is narrowed, a new one is put at the end."""
        f, cut = column["feature"][parent], column["threshold"][parent]
        share = np.divide(column["cover"][child], column["cover"][parent], out=np.zeros(len(child)), where=column["cover"][parent] > 0)
        n, met = len(parent), path[0] == f[:, None]
        known = met.any(axis=1)
        place = np.where(known, met.argmax(axis=1) if met.shape[1] else 0, path[0].shape[1])
        # places without a feature hold -1, so that no path takes them for one
        out = [np.concatenate([p, np.full((n, 1), v)], axis=1) for p, v in zip(path, (-1, -np.inf, np.inf, 1.0))]
        row = np.arange(n)
        out[0][row, place] = f
        if left:
            out[2][row, place] = np.minimum(out[2][row, place], cut)
        else:
            out[1][row, place] = np.maximum(out[1][row, place], cut)
        out[3][row, place] *= share
        return out

    def values(self, x: np.ndarray) -> np.ndarray:
        """(rows, features): the Shapley values of each row."""
        out = np.zeros(x.shape)
        width = self.feature.shape[1]
        points, weights = np.polynomial.legendre.leggauss(max(1, -(-width // 2)))
        for a in range(0, len(self.value) if width else 0, LEAVES_AT_ONCE):
            feature, low, high, share = (p[a: a + LEAVES_AT_ONCE] for p in (self.feature, self.low, self.high, self.share))
            real = (feature >= 0) & (np.isfinite(low) | np.isfinite(high))
            owner = np.zeros((feature.size, x.shape[1]))
            owner[np.flatnonzero(real.ravel()), feature.ravel()[real.ravel()]] = 1.0
            for b in range(0, len(x), ROWS_AT_ONCE):
                at = x[b: b + ROWS_AT_ONCE][:, np.where(real, feature, 0)]
                inside = ~(at <= low) & ((at <= high) | np.isinf(high))   # NaN goes right, as in training
                gain = np.zeros(inside.shape)
                for t, w in zip((points + 1) / 2, weights / 2):
                    term = t * inside + (1 - t) * share
                    rest = np.ones_like(term)   # the product of all other terms, without dividing by one that may be 0
                    np.cumprod(term[..., :-1], axis=2, out=rest[..., 1:])
                    after = np.cumprod(term[..., :0:-1], axis=2)[..., ::-1]
                    rest[..., :-1] *= after
                    gain += w * rest
                paid = (inside - share) * gain * self.value[a: a + LEAVES_AT_ONCE, None]
                out[b: b + ROWS_AT_ONCE] += paid.reshape(len(at), -1) @ owner
        return out


def attributions(rows: DataFrame, leaves: Leaves, features: str = "features", out: str = "attribution") -> DataFrame:
    """``rows`` with one value for each feature in ``out`` and the ensemble's mean in ``base``; NULL features give NULL.

    No shuffle; the leaves go to the tasks with the function.
    """
    @F.arrow_udf("array<double>")
    def shapley(vectors: pa.Array) -> pa.Array:
        there = vectors.is_valid().to_numpy(zero_copy_only=False)
        x = vectors.flatten().to_numpy(zero_copy_only=False)
        width = len(x) // max(1, there.sum())
        got = leaves.values(x.reshape(-1, width)) if len(x) else np.zeros((0, 0))
        ends = pa.array(np.concatenate([[0], np.cumsum(there * width)]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(got.ravel(), pa.float64()), mask=pa.array(~there))

    kind = dict(rows.dtypes)[features]
    vector = F.col(features) if kind.startswith("array") else vector_to_array(features)
    return rows.withColumns({out: shapley(vector), "base": F.lit(leaves.mean)})


def by_feature(rows: DataFrame, features: Sequence[str], keep: Sequence[str] = (), out: str = "attribution") -> DataFrame:
    """``keep``, ``feature``, ``value``: one line for each row and feature."""
    return rows.select(*keep, stack_rows(("feature", "value"), *[(f, F.get(out, F.lit(i))) for i, f in enumerate(features)]))
