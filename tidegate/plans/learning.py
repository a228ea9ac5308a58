"""Calibration error, importance stability and the trained walk-forward."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidegate.operators import attribution as at
from tidegate.operators import calibration as ca
from tidegate.operators import learn as ml
from tidegate.operators.book import Strategy, backtest, performance
from tidegate.operators.features import FEATURES, model_panel
from tidegate.operators.folds import date_index, fold_dates, scaler_stats, standardize, rows_of_role
from tidegate.operators.inference import hac_test
from tidegate.operators.isotonic import calibrated, isotonic_blocks
from tidegate.operators.ranks import daily_ic
from tidegate.plans.base import FOLDS_SQL, PANEL_SQL, folds, panel, rounded, series_bars, sql, table
from tidegate.plans.registry import query
from tidegate.session import materialize

SMALL = {"boosted": ml.boosted_trees(5, 3, 0.1), "forest": ml.random_forest(10, 5), "mlp": ml.perceptron(20, (16, 8))}
INPUTS = ("score", "trend", "momentum")


def _r(expr: str, digits: int, name: str) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


PAIRS_SQL = """
s AS (SELECT lang AS model, least(1.0::DOUBLE, n_chars / 5000.0::DOUBLE) AS p, quality::DOUBLE AS y
      FROM documents JOIN labels USING (doc_id)
      UNION ALL SELECT 'edge', unnest([0.0, 0.1, 0.2, 0.5, 1.0])::DOUBLE, 1.0::DOUBLE FROM (SELECT 1 FROM labels LIMIT 1)),
b AS (SELECT *, CASE WHEN p <= 0 THEN 0 WHEN p <= 0.1::DOUBLE THEN 1 WHEN p <= 0.2::DOUBLE THEN 2 WHEN p <= 0.3::DOUBLE THEN 3
        WHEN p <= 0.4::DOUBLE THEN 4 WHEN p <= 0.5::DOUBLE THEN 5 WHEN p <= 0.6::DOUBLE THEN 6 WHEN p <= 0.7::DOUBLE THEN 7
        WHEN p <= 0.8::DOUBLE THEN 8 WHEN p <= 0.9::DOUBLE THEN 9 ELSE 10 END AS bin FROM s)"""


def score_pairs(spark, sf):
    """Length-based score against the quality label, plus points on the bin edges."""
    real = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(
        table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").select(
        F.col("lang").alias("model"), F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("p"),
        F.col("quality").cast("double").alias("y"))
    edge = table(spark, sf, "labels").groupBy().agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0).select(
        F.lit("edge").alias("model"), F.explode(F.array(*[F.lit(v) for v in (0.0, 0.1, 0.2, 0.5, 1.0)])).alias("p"),
        F.lit(1.0).alias("y"))
    return real.unionByName(edge)


@query("ece", sql(PAIRS_SQL + """,
g AS (SELECT model, bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM b GROUP BY 1, 2),
t AS (SELECT model, count(*) AS n, sqrt(avg((p - y) * (p - y))) AS rmse FROM s GROUP BY 1)""", f"""
SELECT model, t.n, {_r('coalesce(e, 0) / t.n', 8, 'ece')}, {_r('rmse', 8, 'rmse')}
FROM t LEFT JOIN (SELECT model, sum(n * abs(my - mp)) AS e FROM g WHERE bin > 0 GROUP BY model) USING (model)"""))
def ece(spark, sf):
    return rounded(ca.expected_calibration_error(score_pairs(spark, sf), ["model"]), 8)


@query("reliability", sql(PAIRS_SQL, f"""
SELECT model, bin, count(*) AS n, {_r('avg(p)', 8, 'mean_p')}, {_r('avg(y)', 8, 'share_y')} FROM b WHERE bin > 0 GROUP BY 1, 2"""))
def reliability(spark, sf):
    return rounded(ca.reliability(score_pairs(spark, sf), ["model"]), 8)


# least squares under order: the largest over starts of the smallest over ends of the mean between them
ISOTONIC_SQL = FOLDS_SQL + """,
sc AS (SELECT f.fold, role, floor(round(prob * 10000) / 10) / 1000.0::DOUBLE AS raw, target FROM panel JOIN fold_dates f ON panel.date = f.date AND role IN ('cal', 'test')),
d AS (SELECT fold, raw, sum(target) AS t, count(*) AS c FROM sc WHERE role = 'cal' GROUP BY ALL),
o AS (SELECT fold, raw, row_number() OVER w AS i, sum(t) OVER w AS st, sum(c) OVER w AS sw FROM d WINDOW w AS (PARTITION BY fold ORDER BY raw)),
jk AS (SELECT a.fold, a.i AS j, b.i AS k, (b.st - a.st + x.t) / (b.sw - a.sw + x.c) AS m
       FROM o a JOIN o b ON a.fold = b.fold AND a.i <= b.i JOIN d x ON x.fold = a.fold AND x.raw = a.raw),
low AS (SELECT fold, j, k AS i, min(m) OVER (PARTITION BY fold, j ORDER BY k DESC) AS m FROM jk),
fit AS (SELECT o.fold, raw AS x, max(m) AS y FROM low JOIN o USING (fold, i) GROUP BY ALL),
pt AS (SELECT fold, raw, count(*) AS n FROM sc WHERE role = 'test' GROUP BY ALL),
near AS (SELECT pt.fold, raw, any_value(n) AS n, max(x) FILTER (x <= raw) AS x0, min(x) FILTER (x > raw) AS x1 FROM pt JOIN fit USING (fold) GROUP BY ALL)"""


@query("isotonic_calibration", sql(ISOTONIC_SQL, f"""
SELECT near.fold, raw, n, {_r("CASE WHEN x0 IS NULL THEN b.y WHEN x1 IS NULL THEN a.y ELSE a.y + (b.y - a.y) * (raw - x0) / (x1 - x0) END", 8, 'calibrated')}
FROM near LEFT JOIN fit a ON a.fold = near.fold AND a.x = x0 LEFT JOIN fit b ON b.fold = near.fold AND b.x = x1"""))
def isotonic_calibration(spark, sf):
    """Calibrators of all folds fitted on calibration days, applied to the scores of test days."""
    p = panel(spark, sf)
    rows = rows_of_role(p, folds(spark, sf, p), "cal", "test").select("fold", "role", (F.floor(F.round(F.col("prob") * 10000) / 10) / 1000).alias("raw"), "target")
    steps = isotonic_blocks(rows.filter("role = 'cal'"), ["fold"], label="target")
    scores = rows.filter("role = 'test'").groupBy("fold", "raw").agg(F.count(F.lit(1)).alias("n"))
    return rounded(calibrated(scores, steps, ["fold"]), 8, "raw")


KINDS_SQL = ISOTONIC_SQL + """,
pair AS (SELECT near.fold, raw, n, CASE WHEN x0 IS NULL THEN b.y WHEN x1 IS NULL THEN a.y ELSE a.y + (b.y - a.y) * ((raw - x0) / (x1 - x0)) END AS calibrated
         FROM near LEFT JOIN fit a ON a.fold = near.fold AND a.x = x0 LEFT JOIN fit b ON b.fold = near.fold AND b.x = x1),
judged AS (SELECT sc.fold, unnest(['raw', 'calibrated']) AS kind, unnest([sc.raw, calibrated]) AS p, target AS y
           FROM sc JOIN pair ON pair.fold = sc.fold AND pair.raw = sc.raw WHERE role = 'test'),
binned AS (SELECT *, CASE WHEN p <= 0 THEN 0 ELSE (SELECT count(*) FROM range(0, 10) e(i) WHERE i / 10.0::DOUBLE < p) END AS bin FROM judged),
bins AS (SELECT fold, kind, bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS share_y FROM binned GROUP BY ALL),
errors AS (SELECT fold, kind, sum(CASE WHEN bin > 0 THEN n * abs(share_y - mean_p) ELSE 0 END) / sum(n) AS ece FROM bins GROUP BY ALL),
roots AS (SELECT fold, kind, sqrt(avg((p - y) * (p - y))) AS rmse FROM judged GROUP BY ALL),
shared AS (SELECT fold, count(*) FILTER (roles > 1) AS shared_days FROM (
             SELECT fold, date, count(DISTINCT role) AS roles FROM fold_dates WHERE role IN ('cal', 'test') GROUP BY ALL) GROUP BY fold)"""


@query("calibrate_and_report", sql(KINDS_SQL, f"""
SELECT fold, kind, bin, n, {_r('mean_p', 10, 'mean_p')}, {_r('share_y', 10, 'share_y')}, {_r('ece', 10, 'ece')}, {_r('rmse', 10, 'rmse')}, shared_days
FROM bins JOIN errors USING (fold, kind) JOIN roots USING (fold, kind) JOIN shared USING (fold) WHERE bin > 0"""))
def calibrate_and_report(spark, sf):
    """Reliability tables and errors of every fold before and after calibration, and whether its days were kept apart.

    Scores have three digits, so that means are ties of a shorter rounding.
    """
    p = panel(spark, sf)
    rows = rows_of_role(p, folds(spark, sf, p), "cal", "test").select(
        "fold", "role", "date", (F.floor(F.round(F.col("prob") * 10000) / 10) / 1000).alias("raw"), F.col("target").alias("label"))
    return rounded(ca.calibrate_and_report(rows, ["fold"]), 10)


@query("ensemble_average", sql(PANEL_SQL, f"""
SELECT ticker, date, {_r('(prob + coalesce(CASE WHEN close > SMA_200 THEN 0.75::DOUBLE END, 0)) / (1 + CASE WHEN close > SMA_200 THEN 1 ELSE 0 END)', 8, 'prob')}
FROM panel"""))
def ensemble_average(spark, sf):
    """Equal-weight mean of the members that have a score."""
    p = panel(spark, sf).select(
        "ticker", "date", F.col("prob").alias("a"), F.when(F.col("close") > F.col("SMA_200"), 0.75).alias("b"))
    return rounded(ml.average_members(p, ["a", "b"]).select("ticker", "date", "prob"), 8)


# importance of a feature in a fold: absolute mean of its product with the label
IMPORTANCE_SQL = FOLDS_SQL + """,
v AS (SELECT f.fold, target, unnest(['prob', 'close', 'trend', 'momentum', 'gap']) AS feature,
             unnest([prob, close / 1000, close / SMA_200, trailing_return_21d, (close - SMA_200) / 1000]) AS v
      FROM panel JOIN fold_dates f ON panel.date = f.date AND role = 'test'),
imp AS (SELECT fold, feature, abs(avg(v * (target - 0.5::DOUBLE))) AS mean_abs FROM v GROUP BY 1, 2),
rk AS (SELECT *, rank() OVER (PARTITION BY fold ORDER BY mean_abs) + (count(*) OVER (PARTITION BY fold, mean_abs) - 1) / 2.0::DOUBLE AS rk FROM imp),
rho AS (SELECT a.fold AS fold_i, b.fold AS fold_j, CASE WHEN a.fold = b.fold THEN 1.0::DOUBLE ELSE
          covar_pop(a.rk, b.rk) / (stddev_pop(a.rk) * stddev_pop(b.rk)) END AS rho
        FROM rk a JOIN rk b USING (feature) GROUP BY 1, 2)"""


def importance(spark, sf):
    p = panel(spark, sf)
    rows = rows_of_role(p, folds(spark, sf, p), "test")
    from tidegate.functions.columns import stack_rows
    long = rows.select("fold", "target", stack_rows(
        ("feature", "v"), ("prob", F.col("prob")), ("close", F.col("close") / 1000), ("trend", F.col("close") / F.col("SMA_200")),
        ("momentum", F.col("trailing_return_21d")), ("gap", (F.col("close") - F.col("SMA_200")) / 1000)))
    return long.groupBy("fold", "feature").agg(F.abs(F.avg(F.col("v") * (F.col("target") - 0.5))).alias("mean_abs"))


@query("rank_stability", sql(IMPORTANCE_SQL, f"SELECT fold_i, fold_j, {_r('rho', 8, 'rho')} FROM rho"))
def rank_stability(spark, sf):
    return rounded(ca.rank_stability(importance(spark, sf)), 8)


@query("rank_stability_summary", sql(IMPORTANCE_SQL + """,
m AS (SELECT avg(rho) AS r FROM rho WHERE fold_i <> fold_j
      AND fold_i IN (SELECT DISTINCT fold FROM imp ORDER BY fold DESC LIMIT 4) AND fold_j IN (SELECT DISTINCT fold FROM imp ORDER BY fold DESC LIMIT 4))""", f"""
SELECT {_r('r', 8, 'mean_rho')}, CASE WHEN r < 0.3 THEN 'low' WHEN r < 0.6 THEN 'moderate' ELSE 'high' END AS label FROM m"""))
def rank_stability_summary(spark, sf):
    """Mean correlation between the last four folds."""
    return rounded(ca.stability_summary(ca.rank_stability(ca.last_folds(importance(spark, sf)))), 8)


@query("mean_importance", sql(IMPORTANCE_SQL, f"""
SELECT feature, {_r('avg(mean_abs)', 8, 'mean_across_folds')} FROM imp GROUP BY feature ORDER BY avg(mean_abs) DESC LIMIT 3"""))
def mean_importance(spark, sf):
    values = importance(spark, sf).withColumnRenamed("mean_abs", "value")
    return rounded(ca.mean_importance(values, top=3), 8)


# two trees given as rules: (tree, node, left, right, feature, threshold, value); covers are counted on the panel
RULES = (
    (0, 0, 1, 4, 0, 0.0, None), (0, 1, 2, 3, 1, -0.05, None), (0, 2, -1, -1, None, None, 0.2), (0, 3, -1, -1, None, None, 0.45),
    (0, 4, 5, 6, 1, 0.05, None), (0, 5, -1, -1, None, None, 0.5), (0, 6, -1, -1, None, None, 0.75),
    (1, 0, 1, 4, 1, 0.0, None), (1, 1, 2, 3, 1, -0.1, None), (1, 2, -1, -1, None, None, 0.1), (1, 3, -1, -1, None, None, 0.4),
    (1, 4, 5, 6, 2, 1300.0, None), (1, 5, -1, -1, None, None, 0.6), (1, 6, -1, -1, None, None, 0.9))
RULE_INPUTS = ("trend", "momentum", "level")


def _way(known: bool, tree: int, node: int) -> str:
    """SQL of the value below a node: of a row's own leaf, or of the features in the set ``s`` alone."""
    rule = next(r for r in RULES if r[:2] == (tree, node))
    if rule[2] < 0:
        return str(rule[6]) + "::DOUBLE"
    low, high = (_way(known, tree, c) for c in rule[2:4])
    met = f"{RULE_INPUTS[rule[4]]} <= {rule[5]}::DOUBLE"
    if known:
        return f"(CASE WHEN {met} THEN {low} ELSE {high} END)"
    a, b, n = (f"c{tree}_{x}" for x in (rule[2], rule[3], node))
    return f"(CASE WHEN s & {1 << rule[4]} > 0 THEN CASE WHEN {met} THEN {low} ELSE {high} END ELSE coalesce(({a} * {low} + {b} * {high}) / nullif({n}, 0), 0) END)"


def _reached(tree: int, node: int) -> str:
    """Condition for a row to come by a node."""
    for rule in RULES:
        if rule[0] == tree and node in rule[2:4]:
            met = f"{RULE_INPUTS[rule[4]]} <= CAST({rule[5]} AS DOUBLE)"
            return f"({_reached(tree, rule[1])} AND {'' if node == rule[2] else 'NOT '}({met}))"
    return "true"


COVERS = {f"c{t}_{n}": _reached(t, n) for t, n, *_ in RULES}
RULES_SQL = PANEL_SQL + f""",
x AS (SELECT ticker, date, round(close / SMA_200 - 1, 4) AS trend, round(trailing_return_21d, 4) AS momentum, round(close, 2) AS level FROM panel),
c AS (SELECT {', '.join(f'CAST(count(*) FILTER ({w}) AS DOUBLE) AS {n}' for n, w in COVERS.items())} FROM x),
v AS (SELECT ticker, date, s, bit_count(s) AS k, {_way(True, 0, 0)} + {_way(True, 1, 0)} AS prediction, {_way(False, 0, 0)} + {_way(False, 1, 0)} AS v
      FROM x, c, (SELECT CAST(unnest(range(8)) AS INTEGER) AS s))"""
_WEIGHT = "CASE {k} WHEN 1 THEN 1.0::DOUBLE / 6 ELSE 1.0::DOUBLE / 3 END"


@query("attribution_rows", sql(RULES_SQL, f"""
SELECT ticker, date, {_r('any_value(prediction)', 7, 'prediction')}, {_r('max(v) FILTER (s = 0)', 7, 'base')},
       {', '.join(_r(f"sum(CASE WHEN s & {1 << j} > 0 THEN v * {_WEIGHT.format(k='k - 1')} ELSE -v * {_WEIGHT.format(k='k')} END)", 7, f) for j, f in enumerate(RULE_INPUTS))}
FROM v GROUP BY ticker, date"""))
def attribution_rows(spark, sf):
    """Shapley values of two given trees for every row of the panel; the SQL sums over all subsets of features."""
    rows = panel(spark, sf).select(
        "ticker", "date", F.round(F.col("close") / F.col("SMA_200") - 1, 4).alias("trend"),
        F.round("trailing_return_21d", 4).alias("momentum"), F.round("close", 2).alias("level"))
    count = rows.agg(*[F.count_if(F.expr(w)).alias(n) for n, w in COVERS.items()]).first()
    nodes = spark.createDataFrame([(*r[:6], float(count[f"c{r[0]}_{r[1]}"]), r[6]) for r in RULES], at.NODES)
    got = at.attributions(rows.withColumn("features", F.array(*RULE_INPUTS)), at.Leaves(nodes))
    total = F.col("base") + F.aggregate("attribution", F.lit(0.0), lambda a, x: a + x)
    return rounded(got.select("ticker", "date", total.alias("prediction"), "base", *[
        F.get("attribution", F.lit(j)).alias(f) for j, f in enumerate(RULE_INPUTS)]), 7)


@query("ml_attribution")
def ml_attribution(spark, sf):
    """Forests on all features in the last four folds, explained row by row: mean absolute value per feature.

    ``largest_gap`` is the largest difference between a row's prediction and what its values add up to.
    """
    p = materialize(model_panel(series_bars(spark, sf), gaps=False))
    dates = materialize(fold_dates(date_index(p), strict=False))
    last = [r.fold for r in ca.last_folds(dates.select("fold").distinct()).orderBy("fold").collect()]
    forest = {"forest": ml.random_forest(20, 5)}

    def explained(fold):
        models, _, test = ml.run_fold(p, dates, fold, FEATURES, forest, False)
        return at.attributions(test, at.Leaves(at.model_nodes(models["forest"], spark))).select(
            F.lit(fold).alias("fold"), "raw", "base", "attribution")

    parts = ml.at_once(spark, explained, last)
    if not parts:
        return spark.createDataFrame([], "feature string, mean_across_folds double, n_folds long, largest_gap double")
    rows = materialize(reduce(lambda a, b: a.unionByName(b), parts))
    gap = F.abs(F.col("raw") - F.col("base") - F.aggregate("attribution", F.lit(0.0), lambda a, x: a + x))
    checked = rows.agg(F.max(gap).alias("largest_gap"), F.count_distinct("fold").alias("n_folds")).withColumn("_one", F.lit(1))
    return ca.mean_importance(at.by_feature(rows, FEATURES, ["fold"])).withColumn("_one", F.lit(1)).join(checked, "_one").select(
        "feature", "mean_across_folds", "n_folds", "largest_gap")


def learning_panel(spark, sf):
    return panel(spark, sf).withColumns({
        "score": F.col("prob"), "trend": F.col("close") / F.col("SMA_200") - 1, "momentum": F.col("trailing_return_21d")})


def long_folds(p):
    """Two-year test windows: every day is used, in few folds."""
    return materialize(fold_dates(date_index(p), min_train=756, test=504, step=504, strict=False))


@query("ml_walk_forward")
def ml_walk_forward(spark, sf):
    """Train, calibrate and score per fold, then gate and trade the scores."""
    p = learning_panel(spark, sf)
    dates = long_folds(p)
    n = dates.agg(F.max("fold")).first()[0] or 0
    if n == 0:
        return spark.createDataFrame([], "fold int, n long, mean_ic double, t_hac double, sharpe_ratio double, ece_raw double, ece_calibrated double")
    scored = materialize(ml.walk_forward(p, dates, range(1, n + 1), INPUTS, SMALL))
    preds = materialize(ml.prediction_panel(scored, p))
    ic = hac_test(daily_ic(preds, "prob", "actual_return", by=["fold", "date"]), ["fold"])
    book = performance(backtest(preds, [Strategy("TopK1", "topk", 1)], ["fold"]), ["fold"])
    cal = ca.calibration_report(scored, ("fold",), y="label").groupBy("fold").agg(
        F.max(F.when(F.col("kind") == "raw", F.col("ece"))).alias("ece_raw"),
        F.max(F.when(F.col("kind") == "calibrated", F.col("ece"))).alias("ece_calibrated"))
    return ic.select("fold", "n", F.col("mean").alias("mean_ic"), "t_hac").join(
        book.select("fold", "sharpe_ratio"), "fold").join(cal, "fold")


@query("ml_importance")
def ml_importance(spark, sf):
    """Tree and permutation importance in the last fold."""
    p = learning_panel(spark, sf)
    dates = long_folds(p)
    fold = dates.agg(F.max("fold")).first()[0]
    if fold is None:
        return spark.createDataFrame([], "kind string, feature string, value double")
    models, _, _ = ml.run_fold(p, dates, fold, INPUTS, {"forest": SMALL["forest"]})
    trees = ml.tree_importance(models, INPUTS, fold, spark).select(F.lit("tree").alias("kind"), "feature", "value")
    mine = dates.filter(F.col("fold") == fold)
    rows = standardize(rows_of_role(p, mine, "test"), scaler_stats(p, mine, INPUTS), INPUTS).select(
        "date", "ticker", F.col("target").alias("label"), *INPUTS)
    perm = ml.permutation_importance(models["forest"], rows, INPUTS)
    return trees.unionByName(perm.select(F.lit("permutation").alias("kind"), "feature", "value"))


@query("ml_tuning")
def ml_tuning(spark, sf):
    """Mean validation AUC of a small grid over ordered splits."""
    p = learning_panel(spark, sf)
    rows = ml.assemble(p.select("date", "ticker", "target", *INPUTS), INPUTS)
    from pyspark.ml.classification import RandomForestClassifier
    scores = ml.tune(rows, lambda: RandomForestClassifier(numTrees=5, seed=ml.SEED), {"maxDepth": [2, 4]})
    return spark.createDataFrame([(int(g["maxDepth"]), float(v)) for g, v in scores], "max_depth int, auc double")
