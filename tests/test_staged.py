"""Boosting rounds judged in one pass against the library's own model and brute force."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidegate.operators.staged import StagedBoosting, Trees, auc_by_round, staged, stopping_round


def brute_auc(pairs):
    ones, zeros = [m for m, y in pairs if y == 1], [m for m, y in pairs if y == 0]
    if not ones or not zeros:
        return None
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    data = []
    for i in range(400):
        x = [rnd.gauss(0, 1), round(rnd.random(), 1), rnd.random()]
        data.append((i, *x, float(x[0] + 2 * (x[1] - 0.5) + rnd.gauss(0, 1.5) > 0), i >= 300))
    frame = spark.createDataFrame(data, "id int, a double, b double, c double, label double, is_val boolean")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(frame).cache()


def test_margins_and_rounds(spark, rows):
    model = GBTClassifier(maxIter=6, maxDepth=3, stepSize=0.3, seed=1).fit(rows.filter("not is_val"))
    trees = Trees(model)
    got = {r.id: r.margins for r in staged(rows, trees).collect()}
    want = {r.id: r.probability[1] for r in model.transform(rows).collect()}
    assert {k: 1 / (1 + np.exp(-2 * v[-1])) for k, v in got.items()} == pytest.approx(want, abs=1e-9)
    # every round by the trees themselves
    some = rows.limit(20).collect()
    for r in some:
        steps = np.cumsum([t.predict(r.features) * w for t, w in zip(model.trees, model.treeWeights)])
        assert got[r.id] == pytest.approx(steps.tolist(), abs=1e-9)
    label = {r.id: r.label for r in rows.collect()}
    val = [r.id for r in rows.filter("is_val").collect()]
    aucs = {r["round"]: r.auc for r in auc_by_round(staged(rows.filter("is_val"), trees)).collect()}
    assert aucs == pytest.approx({k + 1: brute_auc([(got[i][k], label[i]) for i in val]) for k in range(6)})


def test_best_round_is_kept(spark, rows):
    estimator = StagedBoosting(12, 3, 0.5, 1, patience=50)
    fitted = estimator.fit(rows)
    whole = staged(rows, fitted.trees)
    aucs = {r["round"]: r.auc for r in auc_by_round(whole.filter("is_val")).collect()}
    assert fitted.rounds == min(k for k, v in aucs.items() if v == max(aucs.values()))
    got = {r.id: r.p for r in fitted.score(rows, "p").collect()}
    want = {r.id: 1 / (1 + np.exp(-2 * r.margins[fitted.rounds - 1])) for r in whole.collect()}
    assert got == pytest.approx(want, abs=1e-12)
    assert StagedBoosting(3, 2, 0.5, 1).fit(rows.withColumn("is_val", F.lit(False))).rounds == 3   # nothing to judge by


def test_patience():
    curve = {1: 0.5, 2: 0.7, 3: 0.6, 4: 0.6, 5: 0.9}
    assert stopping_round(curve, 2) == 2 and stopping_round(curve, 3) == 5
    assert stopping_round({1: None, 2: None}) == 2 and stopping_round({}) == 0
    assert stopping_round({1: 0.6, 2: 0.6, 3: 0.6}, 5) == 1


def test_auc_without_both_labels(spark):
    frame = spark.createDataFrame([([0.1, 0.2], 1.0), ([0.3, 0.1], 1.0), ([9.0, 9.0], None)], "margins array<double>, label double")
    assert {r["round"]: r.auc for r in auc_by_round(frame).collect()} == {1: None, 2: None}


def test_fits_in_threads_without_an_active_session(spark, rows):
    from tidegate.operators.learn import at_once
    fit = lambda seed: StagedBoosting(3, 2, 0.5, seed).fit(rows)
    alone = [fit(seed).rounds for seed in (1, 2)]
    assert [f.rounds for f in at_once(spark, fit, (1, 2), in_flight=2)] == alone
