"""Shapley values of every row against sums over all subsets of features."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tidegate.operators.attribution import NODES, Leaves, attributions, by_feature, model_nodes
from tidegate.operators.staged import StagedBoosting

NAMES = list("abcdef")


def expected(tree, node, x, known):
    """Value of a tree when only ``known`` features are known."""
    n = tree[node]
    if n.left < 0:
        return n.value
    parts = [(expected(tree, c, x, known), tree[c].cover) for c in (n.left, n.right)]
    if n.feature in known:
        return parts[0 if x[n.feature] <= n.threshold else 1][0]
    return sum(v * c for v, c in parts) / n.cover


def brute(nodes, x):
    trees = {}
    for n in nodes:
        trees.setdefault(n.tree, {})[n.id] = n
    d = len(x)
    worth = {s: sum(expected(t, 0, x, s) for t in trees.values())
             for k in range(d + 1) for s in map(frozenset, itertools.combinations(range(d), k))}
    return [sum(math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d) * (worth[s | {j}] - worth[s])
                for s in worth if j not in s) for j in range(d)], worth[frozenset()], worth[frozenset(range(d))]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = []
    for i in range(500):
        x = [rnd.gauss(0, 1), round(rnd.random(), 1), rnd.random(), rnd.gauss(0, 2), float(rnd.randrange(3)), rnd.random()]
        data.append((i, *x, float(x[0] * x[1] + x[3] * (x[4] > 0) + rnd.gauss(0, 1) > 0), i >= 400, 0.5 + rnd.random()))
    frame = spark.createDataFrame(data, "id int, a double, b double, c double, d double, e double, f double, label double, is_val boolean, weight double")
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(frame).cache()


def models(rows):
    return {
        "forest": RandomForestClassifier(numTrees=4, maxDepth=6, weightCol="weight", seed=1).fit(rows),
        "boosted": GBTClassifier(maxIter=4, maxDepth=4, stepSize=0.3, seed=1).fit(rows),
        "stopped": StagedBoosting(6, 3, 0.5, 1).fit(rows),
        "regression": RandomForestRegressor(numTrees=3, maxDepth=5, seed=1).fit(rows),
        "one feature": RandomForestClassifier(numTrees=1, maxDepth=1, seed=1).fit(rows),
    }


def predictions(name, model, rows):
    if name == "stopped":
        return {r.id: -math.log(1 / r.p - 1) / 2 for r in model.score(rows, "p").collect()}
    if name == "boosted":
        return {r.id: -math.log(1 / float(r.probability[1]) - 1) / 2 for r in model.transform(rows).collect()}
    return {r.id: float(r.prediction if name == "regression" else r.probability[1]) for r in model.transform(rows).collect()}


def test_every_model_against_all_subsets(spark, rows):
    for name, model in models(rows).items():
        nodes = model_nodes(model, spark)
        got = attributions(rows, Leaves(nodes)).collect()
        want = predictions(name, model, rows)
        assert {r.id: r.base + sum(r.attribution) for r in got} == pytest.approx(want, abs=1e-9), name
        listed = nodes.collect()
        for r in got[::50]:
            values, mean, whole = brute(listed, r.features)
            assert r.attribution == pytest.approx(values, abs=1e-9), name
            assert r.base == pytest.approx(mean, abs=1e-9) and whole == pytest.approx(want[r.id], abs=1e-9), name


def test_deep_paths_ties_and_missing(spark, rows):
    # one feature split again and again, a node nobody reached, a row without features, NaN
    nodes = spark.createDataFrame([
        (0, 0, 1, 2, 0, 0.0, 10.0, None), (0, 1, 3, 4, 0, -1.0, 6.0, None), (0, 2, -1, -1, None, None, 4.0, 5.0),
        (0, 3, -1, -1, None, None, 6.0, 1.0), (0, 4, 5, 6, 1, 0.5, 0.0, None), (0, 5, -1, -1, None, None, 0.0, 2.0),
        (0, 6, -1, -1, None, None, 0.0, 3.0)], NODES)
    leaves = Leaves(nodes)
    assert leaves.mean == pytest.approx(0.4 * 5 + 0.6 * 1)
    x = [[-2.0, 0.0], [-1.0, 0.0], [-0.5, 0.5], [-0.5, 0.6], [0.0, 9.0], [1.0, 0.0], [float("nan"), 0.0]]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate([*x, None])], "id int, features array<double>")
    got = {r.id: r.attribution for r in attributions(frame, leaves).collect()}
    assert got[7] is None
    whole = [1.0, 1.0, 2.0, 3.0, 3.0, 5.0, 5.0]
    assert [sum(got[i]) for i in range(7)] == pytest.approx([w - leaves.mean for w in whole])
    long = by_feature(attributions(frame.filter("id < 2"), leaves), ["p", "q"], ["id"]).orderBy("id", "feature").collect()
    assert [(r.id, r.feature) for r in long] == [(0, "p"), (0, "q"), (1, "p"), (1, "q")]
    # only a root: nothing to share out
    root = Leaves(spark.createDataFrame([(0, 0, -1, -1, None, None, 3.0, 0.25)], NODES))
    assert root.mean == 0.25 and np.all(root.values(np.ones((2, 3))) == 0)
    assert attributions(frame.filter(F.lit(False)), leaves).count() == 0
    assert Leaves(spark.createDataFrame([], NODES)).mean == 0.0
