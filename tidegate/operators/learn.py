"""Walk-forward training, calibration and scoring with ``pyspark.ml``.

Folds overlap and their models are independent, so the driver deals with fold
numbers only, a few at a time in scheduler pools of their own; fitting and
scoring are distributed.  ``walk_forward`` with a root folder writes each fold's
predictions to a partition of its own and enters it in a ledger, and a new run
trains what is not there whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.columns import stack_rows
from tidegate.functions.draws import key_high
from tidegate.operators import folds as fo
from tidegate.operators.isotonic import calibrated, isotonic_blocks
from tidegate.operators.staged import PATIENCE, StagedBoosting
from tidegate.session import materialize
from tidegate.sources.ledger import commit_predictions, fingerprint, unfinished

SEED = 42
Factory = Callable[[int], Estimator]


def boosted_trees(iterations: int = 500, depth: int = 6, rate: float = 0.05, patience: int = PATIENCE) -> Factory:
    """Stops by the ranking of the validation tail, ``patience`` rounds after the best."""
    return lambda d: StagedBoosting(iterations, depth, rate, SEED, patience)


def random_forest(trees: int = 500, depth: int = 10, leaf: int = 20) -> Factory:
    return lambda d: RandomForestClassifier(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", weightCol="weight",
        seed=SEED)


def perceptron(iterations: int = 100, hidden: Sequence[int] = (256, 128, 64)) -> Factory:
    return lambda d: MultilayerPerceptronClassifier(layers=[d, *hidden, 2], maxIter=iterations, seed=SEED)


MEMBERS: Mapping[str, Factory] = {"boosted": boosted_trees(), "forest": random_forest(), "mlp": perceptron()}


def with_class_weight(rows: DataFrame, label: str = "label") -> DataFrame:
    """n / (2 * n_class), so both classes weigh the same."""
    rows = rows.filter(F.col(label).isNotNull())
    count = {r[label]: r["_c"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("_c")).collect()}
    total = sum(count.values())
    weight = F.lit(None).cast("double")
    for value, n in sorted(count.items()):
        weight = F.when(F.col(label) == value, total / (2 * n)).otherwise(weight)
    return rows.withColumn("weight", weight)


def assemble(rows: DataFrame, features: Sequence[str], target: str = "target") -> DataFrame:
    v = VectorAssembler(inputCols=list(features), outputCol="features")
    return v.transform(rows).withColumn("label", F.col(target).cast("double")).drop(*features)


def probability(scored: DataFrame, out: str) -> DataFrame:
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(
        "rawPrediction", "probability", "prediction")


def score_members(models: Mapping[str, object], rows: DataFrame) -> DataFrame:
    """One probability column per member and their equal-weight mean ``raw``."""
    for name, model in models.items():
        out = f"p_{name}"
        rows = model.score(rows, out) if hasattr(model, "score") else probability(model.transform(rows), out)
    total = None
    for name in models:
        c = F.col(f"p_{name}")
        total = c if total is None else total + c
    return rows.withColumn("raw", total / len(models))


def average_members(scores: DataFrame, members: Sequence[str]) -> DataFrame:
    """Mean over the members that are present in a row."""
    have = sum((F.col(m).isNotNull().cast("int") for m in members[1:]), F.col(members[0]).isNotNull().cast("int"))
    total = sum((F.coalesce(m, F.lit(0.0)) for m in members[1:]), F.coalesce(members[0], F.lit(0.0)))
    return scores.withColumn("prob", F.try_divide(total, have))


def fold_rows(panel: DataFrame, dates: DataFrame, fold: int, features: Sequence[str]) -> dict[str, DataFrame]:
    """Scaled and assembled rows per role; the model-train part marks its tail."""
    mine = dates.filter(F.col("fold") == fold)
    rows = fo.standardize(
        fo.rows_of_role(panel, mine, "model_train", "cal", "test"), fo.scaler_stats(panel, mine, features), features)
    train = fo.tail_validation(rows.filter(F.col("role") == "model_train"))
    return {
        "model_train": with_class_weight(assemble(train, features)),
        "cal": assemble(rows.filter(F.col("role") == "cal"), features),
        "test": assemble(rows.filter(F.col("role") == "test"), features),
    }


def run_fold(panel: DataFrame, dates: DataFrame, fold: int, features: Sequence[str],
             members: Mapping[str, Factory] = MEMBERS, calibrate: bool = True):
    """(models, cal rows, test rows) of one fold, scored and calibrated."""
    parts = fold_rows(panel, dates, fold, features)
    train = materialize(parts["model_train"])
    models = {name: make(len(features)).fit(train) for name, make in members.items()}
    cal = materialize(score_members(models, parts["cal"]))
    test = score_members(models, parts["test"])
    if calibrate:
        steps = isotonic_blocks(cal)
        cal, test = calibrated(cal, steps), calibrated(test, steps)
    else:
        cal, test = cal.withColumn("calibrated", F.col("raw")), test.withColumn("calibrated", F.col("raw"))
    tag = "+".join(members) + ("" if calibrate else "_raw")
    return models, cal.withColumn("model", F.lit(tag)), test.withColumn("model", F.lit(tag))


#: Folds that are trained at the same time.
IN_FLIGHT = 3


def at_once(session, work: Callable, items: Iterable, in_flight: int = IN_FLIGHT) -> list:
    """``work`` on every item, ``in_flight`` at a time, each in a scheduler pool of its own; results in order.

    With ``spark.scheduler.mode`` FAIR the pools share the executors evenly.  The first error ends the rest that has not
    begun.
    """
    def run(i, item):
        session.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{i % max(1, in_flight)}")
        try:
            return work(item)
        finally:
            session.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=max(1, in_flight)) as pool:
        tasks = [pool.submit(inheritable_thread_target(session)(run), i, item) for i, item in enumerate(items)]
        try:
            return [t.result() for t in tasks]
        except BaseException:
            for t in tasks:
                t.cancel()
            raise


def fold_marks(dates: DataFrame | None, folds: Sequence[int], features: Sequence[str], members: Mapping[str, Factory]) -> dict[int, str]:
    """Fingerprint of what decides each fold's predictions: features, members with their settings, days of each role."""
    days = {} if dates is None else {r.fold: (r.n, r.days) for r in dates.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("role", "date")).alias("days")).collect()}
    made = {}
    for name, make in members.items():
        estimator = None if make is None else make(len(features))
        made[name] = None if estimator is None else [type(estimator).__name__, {
            p.name: str(v) for p, v in estimator.extractParamMap().items()} if isinstance(estimator, Estimator) else vars(estimator)]
    return {int(f): fingerprint(features=list(features), members=made, days=days.get(f)) for f in folds}


def walk_forward(panel: DataFrame, dates: DataFrame, folds: Sequence[int], features: Sequence[str],
                 members: Mapping[str, Factory] = MEMBERS, calibrate: bool = True, root: str | None = None,
                 in_flight: int = IN_FLIGHT) -> DataFrame:
    """Out-of-sample predictions of the given folds, ``in_flight`` of them trained at a time.

    With ``root``, each fold is written there when it is done, folds that lie there
    whole and from the same features, members and days are not trained again, and
    the result is read back.
    """
    session = panel.sparkSession
    keep = ("fold", "model", "date", "ticker", "label", "raw", "calibrated")
    tag = "+".join(members) + ("" if calibrate else "_raw")
    folds = [int(f) for f in folds]
    if root is not None:
        marks = fold_marks(dates, folds, features, members)
        wanted = session.createDataFrame([(f, tag, marks[f]) for f in folds], "fold int, model string, fingerprint string")

        def train(fold: int) -> None:
            test = run_fold(panel, dates, fold, features, members, calibrate)[2]
            test = test.withColumns({"fold": F.lit(fold), "model": F.lit(tag)}).select(*keep)
            commit_predictions(test, root, fold, tag, marks[fold])

        at_once(session, train, sorted(r.fold for r in unfinished(session, wanted, root).collect()), in_flight)
        if not folds:
            return session.createDataFrame([], "fold int, model string, date date, ticker string, label double, raw double, calibrated double")
        return session.read.parquet(root).join(F.broadcast(wanted), ["fold", "model"], "left_semi").select(*keep)
    cal = test = None
    done = at_once(session, lambda fold: run_fold(panel, dates, fold, features, members, False)[1:], folds, in_flight)
    for fold, parts in zip(folds, done):
        parts = [p.withColumn("fold", F.lit(fold)) for p in parts]
        cal, test = parts if test is None else (cal.unionByName(parts[0]), test.unionByName(parts[1]))
    if calibrate:  # the calibrators of all folds in one job
        test = calibrated(test.drop("calibrated"), isotonic_blocks(cal, ["fold"]), ["fold"])
    return test.withColumn("model", F.lit(tag)).select(*keep)


def prediction_panel(scored: DataFrame, panel: DataFrame, score: str = "calibrated") -> DataFrame:
    """Scores joined to prices, label and realised return; rows without a return drop out."""
    facts = panel.select("date", "ticker", "close", "SMA_200", "target", "trailing_return_21d", "actual_return")
    joined = scored.select("fold", "model", "date", "ticker", F.col(score).alias("prob")).join(
        facts, ["date", "ticker"], "left")
    return joined.filter(F.col("actual_return").isNotNull())


def tree_importance(models: Mapping[str, object], features: Sequence[str], fold: int, session) -> DataFrame:
    """(fold, model, feature, value) from fitted tree ensembles."""
    rows = [
        (fold, name, f, float(v))
        for name, m in models.items() if hasattr(m, "featureImportances")
        for f, v in zip(features, m.featureImportances.toArray())
    ]
    return session.createDataFrame(rows, "fold int, model string, feature string, value double")


def permutation_importance(model, rows: DataFrame, features: Sequence[str], by: str = "date",
                           label: str = "label") -> DataFrame:
    """Loss increase when one feature is shuffled among the rows of its group.

    ``rows`` holds the scaled feature columns, ``date``, ``ticker`` and the label.
    Each feature's shuffled copy is a branch of one union, keyed by feature.
    """
    from pyspark.sql import Window

    by_hash = Window.partitionBy(by).orderBy(key_high("date", "ticker"), "ticker")
    by_name = Window.partitionBy(by).orderBy("ticker")
    placed = rows.withColumns({"_a": F.row_number().over(by_name), "_b": F.row_number().over(by_hash)})
    donors = placed.select(by, F.col("_b").alias("_a"), *[F.col(f).alias(f"_d_{f}") for f in features])
    paired = materialize(placed.join(donors, [by, "_a"]))
    variants = paired.select(label, stack_rows(
        ("feature", *features),
        *[(name, *[F.col(f"_d_{f}") if f == name else F.col(f) for f in features]) for name in ("none", *features)]))
    scored = probability(model.transform(VectorAssembler(
        inputCols=list(features), outputCol="features").transform(variants)), "p")
    loss = scored.groupBy("feature").agg(F.avg((F.col("p") - F.col(label)) * (F.col("p") - F.col(label))).alias("loss"))
    base = loss.filter(F.col("feature") == "none").select(F.col("loss").alias("base"), F.lit(1).alias("_one"))
    return loss.filter(F.col("feature") != "none").withColumn("_one", F.lit(1)).join(base, "_one").select(
        "feature", (F.col("loss") - F.col("base")).alias("value"))


def ordered_splits(days: DataFrame, k: int = 3) -> DataFrame:
    """(split, role, date): k expanding train/validation cuts in date order."""
    n = days.agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    rows = days.withColumn("_one", F.lit(1)).join(n, "_one").withColumn(
        "split", F.explode(F.array(*[F.lit(i) for i in range(1, k + 1)])))
    size = F.floor(F.col("n") / (k + 1))
    start = F.col("n") - (k + 1 - F.col("split")) * size
    role = F.when(F.col("day_no") < start, "train").when(F.col("day_no") < start + size, "val")
    return rows.withColumn("role", role).filter(F.col("role").isNotNull()).select("split", "role", "date")


def tune(rows: DataFrame, make: Callable[[], Estimator], grid: Mapping[str, Sequence], k: int = 3) -> list[tuple[dict, float]]:
    """Mean validation AUC per grid point over ordered splits, best first.

    ``rows`` holds ``date``, ``features`` and ``label``.
    """
    splits = ordered_splits(fo.date_index(rows), k)
    tagged = materialize(rows.join(splits, "date"))
    est = make()
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(est.getParam(name), list(values))
    auc = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC")
    scores = []
    for params in builder.build():
        parts = []
        for i in range(1, k + 1):
            part = tagged.filter(F.col("split") == i)
            model = est.fit(part.filter(F.col("role") == "train"), params)
            parts.append(auc.evaluate(model.transform(part.filter(F.col("role") == "val"))))
        scores.append(({p.name: v for p, v in params.items()}, sum(parts) / k))
    return sorted(scores, key=lambda s: -s[1])
