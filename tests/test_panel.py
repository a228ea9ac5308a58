"""Features, folds and books on small hand-made panels."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegate.functions.draws import draw, key_high, key_low, round_keys, shuffled_place
from tidegate.operators import book as bk
from tidegate.operators.calibration import expected_calibration_error, reliability
from tidegate.operators.ewm import Ewm, ewm_mean
from tidegate.operators.features import FEATURES, all_features, smoothed_features, with_holding_return, with_target
from tidegate.operators.folds import date_index, fold_checks, fold_dates, fold_summary
from tidegate.operators.isotonic import calibrated, isotonic_blocks
from tidegate.operators.resample import drawn_positions, null_summary, permutation_sharpes, permuted_top

DAY0 = dt.date(2015, 1, 1)


def bar_rows(names, n, seed=1):
    rnd = random.Random(seed)
    out = []
    for t in names:
        price = 100.0
        for i in range(n):
            o = price
            price *= 1 + rnd.gauss(0, 0.02)
            out.append((t, DAY0 + dt.timedelta(i), o, max(o, price) * 1.01, min(o, price) * 0.99, price, float(rnd.randint(1, 900))))
    return out


SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume double"


def test_ewm_with_a_gap(spark):
    rows = [("a", DAY0 + dt.timedelta(i), v) for i, v in enumerate([1.0, 2.0, None, 4.0])]
    df = spark.createDataFrame(rows, "ticker string, date date, x double")
    got = [r.y for r in ewm_mean(df, [Ewm("y", "x", 0.3, 1)]).orderBy("date").collect()]
    assert got == pytest.approx([1.0, 1.3, 1.3, 2.325316], abs=1e-6)


@pytest.mark.parametrize("gaps", [True, False])
def test_ewm_blocks_equal_the_recursion(spark, gaps):
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=900).cumsum()
    if gaps:
        x[rnd.random(900) < 0.1] = np.nan
        x[:3] = np.nan
    df = spark.createDataFrame(
        [("a", DAY0 + dt.timedelta(i), None if np.isnan(v) else float(v)) for i, v in enumerate(x)],
        "ticker string, date date, x double")
    got = ewm_mean(df, [Ewm.span("y", "x", 50, gaps=gaps), Ewm.wilder("z", "x", 14, gaps=gaps)]).orderBy("date").toPandas()
    for name, kw in (("y", dict(span=50, min_periods=50)), ("z", dict(alpha=1 / 14, min_periods=14))):
        want = pd.Series(x).ewm(adjust=False, **kw).mean()
        np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-9, atol=1e-9)


def test_features_never_look_ahead(spark):
    rows = bar_rows("ab", 260)
    early = [r for r in rows if r[1] < DAY0 + dt.timedelta(230)]
    cut = lambda data: all_features(spark.createDataFrame(data, SCHEMA)).filter(
        F.col("date") == F.lit(DAY0 + dt.timedelta(229))).orderBy("ticker").select(*FEATURES).toPandas()
    pd.testing.assert_frame_equal(cut(rows), cut(early), rtol=1e-9)


def test_flat_series_and_zero_volume(spark):
    rows = [("a", DAY0 + dt.timedelta(i), 5.0, 5.0, 5.0, 5.0, 0.0 if i == 3 else 10.0) for i in range(40)]
    f = all_features(spark.createDataFrame(rows, SCHEMA)).orderBy("date").collect()
    assert f[-1].BB_width == 0.0 and f[-1].CCI_20 == 0.0 and f[-1].volume_zscore_5d == 0.0
    assert f[3].OBV is None and f[4].OBV == 0.0
    assert f[7].volume_zscore_5d is None and f[8].volume_zscore_5d is not None
    smooth = smoothed_features(spark.createDataFrame(rows, SCHEMA)).orderBy("date").collect()
    assert [i for i, r in enumerate(smooth) if r.RSI_14 is not None][0] == 14
    assert [i for i, r in enumerate(smooth) if r.ATR_14 is not None][0] == 13


def test_label_and_holding_return(spark):
    rows = [("a", DAY0 + dt.timedelta(i), c) for i, c in enumerate([1.0, 2.0, 4.0, 3.0, 3.0])]
    df = with_target(spark.createDataFrame(rows, "ticker string, date date, close double"))
    assert [r.target for r in df.orderBy("date").collect()] == [1.0, 0.0, 0.0, None, None]
    got = with_holding_return(df.dropna(subset=["target"])).orderBy("date").collect()
    assert [r.actual_return for r in got] == [1.0, None, None]


def test_folds_at_the_boundary(spark):
    days = lambda n: date_index(spark.createDataFrame([(DAY0 + dt.timedelta(i),) for i in range(n)], "date date"))
    assert fold_dates(days(883), strict=False).count() == 0
    with pytest.raises(Exception, match="884"):
        fold_dates(days(883)).count()
    f = fold_dates(days(884 + 126))
    sizes = {(r.fold, r.role): r.n_dates for r in fold_summary(f).collect()}
    assert sizes == {(1, "model_train"): 604, (1, "cal"): 152, (1, "embargo"): 2, (1, "test"): 126,
                     (2, "model_train"): 705, (2, "cal"): 177, (2, "embargo"): 2, (2, "test"): 126}
    assert fold_checks(f).filter("passed").count() == 14


def panel_rows():
    """Three names; b skips day 2; scores tie on day 1."""
    p = [(1, "a", 0.6, 0.10), (1, "b", 0.6, 0.20), (1, "c", 0.1, 0.0), (2, "a", 0.2, -0.1), (2, "c", 0.7, 0.05),
         (3, "a", 0.9, 0.02), (3, "b", 0.8, 0.03), (3, "c", 0.7, 0.01)]
    return [(DAY0 + dt.timedelta(d), t, s, 10.0, 9.0 if t != "a" else 11.0, s, r) for d, t, s, r in p]


PANEL = "date date, ticker string, prob double, close double, SMA_200 double, trailing_return_21d double, actual_return double"


def test_turnover_costs_and_ties(spark):
    panel = spark.createDataFrame(panel_rows(), PANEL)
    d = bk.backtest(panel, [bk.Strategy("top", "topk", 1), bk.Strategy("all", "equal_weight"), bk.Strategy("none", "threshold", threshold=2.0)])
    rows = {(r.strategy, r.date.day - 1): r for r in d.collect()}
    assert rows["top", 1].gross_return == 0.10            # the tie goes to the first name
    assert [rows["top", i].turnover for i in (1, 2, 3)] == [1.0, 2.0, 2.0]
    assert rows["all", 2].turnover == pytest.approx(2 * (1 / 2 - 1 / 3) + 1 / 3)
    assert rows["all", 3].turnover == pytest.approx(2 * (1 / 2 - 1 / 3) + 1 / 3)
    assert rows["top", 2].net_return == pytest.approx(0.05 - 2 * 5 / 10000)
    assert rows["none", 2].gross_return == 0.0 and rows["none", 2].n_positions == 0
    trend = bk.weights(panel, [bk.Strategy("t", "topk_trend", 1)]).orderBy("date").collect()
    assert [r.ticker for r in trend] == ["b", "c", "b"]


@pytest.mark.parametrize("curve,status,bps", [
    ([(0.0, 0.222260665754282), (5.0, -0.16015007906374146)], "crossing", 2.906),
    ([(0.0, -0.1), (5.0, -0.2)], "below_first", None), ([(0.0, 0.3), (5.0, 0.2)], "above_last", None)])
def test_break_even(spark, curve, status, bps):
    df = spark.createDataFrame([("s", c, v) for c, v in curve], "strategy string, cost_bps double, sharpe_ratio double")
    r = bk.break_even(df).first()
    assert r.status == status
    assert r.break_even_bps == (pytest.approx(bps, abs=1e-3) if bps else None)


def test_compound_keeps_sign_and_zero(spark):
    from pyspark.sql import Window
    rows = [(i, v) for i, v in enumerate([0.1, -1.5, 0.2, -1.0, 0.3])]
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    got = [r.v for r in spark.createDataFrame(rows, "i int, x double").select(bk.compound(F.col("x"), w).alias("v")).collect()]
    assert got == pytest.approx([1.1, -0.55, -0.66, 0.0, 0.0])


def test_calibration_edges(spark):
    rows = spark.createDataFrame([(0.0, 1.0), (0.1, 1.0), (1.0, 0.0)], "p double, y double")
    assert sorted((r.bin, r.n) for r in reliability(rows).collect()) == [(1, 1), (10, 1)]
    e = expected_calibration_error(rows).first()
    assert e.n == 3 and e.ece == pytest.approx((0.9 + 1.0) / 3)


def test_isotonic_clamps_outside_the_fitted_range(spark):
    fit = spark.createDataFrame([(0.2, 0.0), (0.4, 0.0), (0.6, 1.0), (0.8, 1.0)], "raw double, label double")
    out = calibrated(spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "raw double"), isotonic_blocks(fit))
    assert [r.calibrated for r in out.orderBy("raw").collect()] == pytest.approx([None, 0.0, 0.5, 1.0])


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_isotonic_fits_of_all_keys_equal_the_library(spark, ranges):
    from pyspark.ml.regression import IsotonicRegression

    rnd = random.Random(8)
    rows = []
    for fold in (1, 2, None):
        for _ in range(400):
            x = round(rnd.random(), 2 if fold == 2 else 6)
            rows.append((fold, x, float(rnd.random() < (x if fold != 2 else 1 - x)), float(rnd.randrange(1, 4))))
    rows += [(3, 0.5, 1.0, 1.0), (1, None, 1.0, 1.0), (1, 0.3, None, 1.0), (1, 0.0, 1.0, 0.0)]
    frame = spark.createDataFrame(rows, "fold int, raw double, label double, w double")
    test = spark.createDataFrame([(f, i / 57) for f in (1, 2, 3, None) for i in range(-3, 61)] + [(9, 0.5)], "fold int, raw double")
    got = calibrated(test, isotonic_blocks(frame, ["fold"], weight="w", ranges=ranges), ["fold"]).collect()
    have = {(r.fold, r.raw): r.calibrated for r in got}
    assert have.pop((9, 0.5)) is None and len(have) == 4 * 64
    for fold in (1, 2, 3, None):
        mine = frame.filter(F.col("fold").eqNullSafe(F.lit(fold))).dropna(subset=["raw", "label"]).filter("w > 0")
        model = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="w").fit(mine)
        want = {r.raw: r.prediction for r in model.transform(test.filter(F.col("fold").eqNullSafe(F.lit(fold)))).collect()}
        assert {x: y for (f, x), y in have.items() if f == fold} == pytest.approx(want, abs=1e-9)


def test_positions_are_a_permutation_when_days_are_split(spark):
    rows = spark.createDataFrame([(DAY0, f"n{i}", 0.0) for i in range(500)], "date date, ticker string, actual_return double")
    whole = {(r.rep, r.ticker): r.position for r in drawn_positions(rows, 3).collect()}
    split = {(r.rep, r.ticker): r.position for r in drawn_positions(rows, 3, split_rows=40).collect()}
    assert whole == split
    assert sorted(p for (rep, _), p in whole.items() if rep == 2) == list(range(1, 501))


def test_tied_scores_follow_the_shuffled_ranking(spark):
    panel = spark.createDataFrame(
        [(DAY0 + dt.timedelta(d), t, s, 0.0) for d in range(30) for t, s in zip("abcde", (0.9, 0.9, 0.9, 0.5, 0.1))],
        "date date, ticker string, prob double, actual_return double")
    reps = 40
    got = {(r.rep, r.date): r.ticker for r in permuted_top(panel, reps).collect()}
    assert len(got) == reps * 30
    # three equal scores at the top: of the names at the first three places, the first in the alphabet
    share = {x: sum(n == x for n in got.values()) / len(got) for x in "abcde"}
    assert share["a"] == pytest.approx(0.6, abs=0.05) and share["b"] == pytest.approx(0.3, abs=0.05)
    assert share["c"] == pytest.approx(0.1, abs=0.04) and share["d"] == share["e"] == 0


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_keyed_shuffle_is_a_bijection_with_an_inverse(spark, n):
    frame = spark.range(n).withColumns({"n": F.lit(n).cast("long"), "keys": round_keys(F.lit(123456789 + n))}).withColumn(
        "to", shuffled_place(F.col("id"), F.col("n"), F.col("keys"))).withColumn(
        "back", shuffled_place(F.col("to"), F.col("n"), F.col("keys"), back=True))
    rows = frame.collect()
    assert sorted(r.to for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    assert n < 7 or [r.to for r in rows] != list(range(n))


def test_keyed_shuffles_are_uniform(spark):
    """All orders of four places, and the places of one of 50, by chi-square."""
    reps = 24_000
    keyed = spark.range(reps).withColumn("key", draw(F.col("id"), F.lit(17), F.lit(99))).withColumn("keys", round_keys(F.col("key")))
    four = F.concat_ws("", *[shuffled_place(F.lit(i), F.lit(4), F.col("keys")).cast("string") for i in range(4)])
    seen = [r["count"] for r in keyed.groupBy(four.alias("o")).count().collect()]
    assert len(seen) == 24 and sum((c - 1_000) ** 2 / 1_000 for c in seen) < 60   # 23 degrees of freedom: p < 1e-4 beyond
    one = [r["count"] for r in keyed.groupBy(shuffled_place(F.lit(0), F.lit(50), F.col("keys")).alias("o")).count().collect()]
    assert len(one) == 50 and sum((c - 480) ** 2 / 480 for c in one) < 100


@pytest.mark.parametrize("k", [1, 2, 5])
@pytest.mark.parametrize("scores", ["distinct", "tied", "equal"])
def test_permuted_top_equals_a_whole_permutation(spark, k, scores):
    rnd = random.Random(k)
    value = {"distinct": lambda i: i / 100, "tied": lambda i: min(i, 6) // 3 / 10, "equal": lambda i: 0.5}[scores]
    rows = [(DAY0 + dt.timedelta(d), f"n{i:03d}", value(i), 0.0) for d in range(4) for i in range(3 + 20 * d)]
    rnd.shuffle(rows)
    panel = spark.createDataFrame(rows, "date date, ticker string, prob double, actual_return double")
    got = sorted((r.rep, r.date, r.ticker) for r in permuted_top(panel, 6, k).collect())
    want = []
    sizes = {r[0]: sum(x[0] == r[0] for x in rows) for r in rows}
    keys = spark.createDataFrame([(d, n, rep) for d, n in sizes.items() for rep in range(1, 7)], "date date, n long, rep long")
    keys = keys.withColumn("keys", round_keys(draw(F.col("rep"), key_high("date"), key_low("date"))))
    places = keys.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn(
        "place", shuffled_place(F.col("i"), F.col("n"), F.col("keys"), back=True)).collect()
    names = {d: sorted(r[1] for r in rows if r[0] == d) for d in sizes}
    best = {d: sorted((r[2] for r in rows if r[0] == d), reverse=True) for d in sizes}
    for d in sizes:
        for rep in range(1, 7):
            mine = sorted((-best[d][p.place], names[d][p.i]) for p in places if p.date == d and p.rep == rep)
            want += [(rep, d, name) for _, name in mine[:k]]
    assert got == sorted(want)


def test_a_heavily_tied_day_is_not_drawn_row_by_row(spark):
    rows = spark.range(20_000).select(F.lit(DAY0).alias("date"), F.format_string("n%06d", "id").alias("ticker"),
                                      (F.col("id") % 2).cast("double").alias("prob"), F.lit(0.0).alias("actual_return"))
    got = [r.ticker for r in permuted_top(rows, 300).collect()]
    assert len(got) == 300
    first = [int(t[1:]) for t in got]   # of ten thousand tied places in twenty thousand, the first name: half the time the first of all
    assert 0.4 < sum(i == 0 for i in first) / 300 < 0.6 and max(first) < 20


def test_permutation_p_value_and_rank(spark):
    null = spark.createDataFrame([(i, float(i)) for i in range(1, 11)], "rep int, s double")
    obs = spark.createDataFrame([(4.0,)], "observed double")
    r = null_summary(null, obs, "s").first()
    assert (r.p_value, r.percentile_rank, r.null_mean) == (0.7, 40.0, 5.5)
    assert r.null_95th == pytest.approx(9.55)


def test_single_name_path_equals_the_general_book(spark):
    rnd = random.Random(5)
    panel = spark.createDataFrame(
        [(DAY0 + dt.timedelta(d), t, rnd.random(), rnd.gauss(0, 0.02)) for d in range(60) for t in "abcd"],
        "date date, ticker string, prob double, actual_return double")
    from tidegate.operators.resample import replicate_metrics
    fast = {r.rep: r.null_sharpe for r in permutation_sharpes(panel, 20).collect()}
    slow = {r.rep: r.sharpe_ratio for r in replicate_metrics(permuted_top(panel, 20), panel, 20).collect()}
    assert fast == pytest.approx(slow, rel=1e-9)


@pytest.mark.parametrize("k", [1, 2])
def test_books_and_permutations_draw_every_row(spark, k):
    from tidegate.operators.resample import drawn_picks, drawn_top, random_baseline, replicate_metrics
    rnd = random.Random(11)
    rows = [(DAY0 + dt.timedelta(d), f"n{i:02d}", (i if d % 2 else min(i, 4)) / 10, rnd.gauss(0, 0.02)) for d in range(5) for i in range(2 + 3 * d)]
    panel = spark.createDataFrame(rows, "date date, ticker string, prob double, actual_return double")
    reps = 4
    drawn = panel.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn(
        "u", draw(F.col("rep"), key_high("date", "ticker"), key_low("date", "ticker"))).collect()
    books, tops = [], []
    for rep in range(1, reps + 1):
        for day in sorted({r[0] for r in rows}):
            names = [r.ticker for r in sorted((r for r in drawn if r.rep == rep and r.date == day), key=lambda r: r.u)]
            scores = sorted((r[2] for r in rows if r[0] == day), reverse=True)
            books += [(rep, day, n) for n in names[:k]]
            tops += [(rep, day, n) for _, n in sorted((-s, n) for s, n in zip(scores, names))[:k]]
    key = lambda f: sorted((r.rep, r.date, r.ticker) for r in f.collect())
    assert key(drawn_picks(panel, reps, k)) == sorted(books)
    assert key(drawn_top(panel, reps, k)) == sorted(tops)
    picks = panel.join(spark.createDataFrame(books, "rep int, date date, ticker string"), ["date", "ticker"])
    want = replicate_metrics(picks.select("rep", "date", "ticker", "actual_return"), panel, reps, k).agg(F.avg("total_return")).first()[0]
    assert random_baseline(panel, reps, k).first().total_return == pytest.approx(want)
