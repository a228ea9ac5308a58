"""What used to depend on size, on promises or on luck: ranks, gaps, singular factors, missing rows, restarts."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegate.operators import learn
from tidegate.operators.ewm import Ewm, ewm_mean
from tidegate.operators.features import FEATURES, smoothed_features
from tidegate.operators.folds import fold_checks
from tidegate.operators.ranks import daily_ic, rank_columns
from tidegate.operators.regression import factor_regressions
from tidegate.session import materialize, shared_folder
from tidegate.sources import ledger
from tidegate.sources.readers import read_bars
from tidegate.sources.writers import write_predictions, write_report

DAY0 = dt.date(2020, 1, 1)


def cross_sections():
    rng = np.random.default_rng(1)
    rows = []
    for day in (DAY0, DAY0 + dt.timedelta(1), None):
        for i in range(60):
            rows.append((day, f"n{i}", float(rng.integers(0, 12)), float(rng.integers(0, 50))))
    rows += [(DAY0, "x", None, 1.0), (None, "x", 1.0, None)]
    return rows


def test_ranks_do_not_depend_on_source_size_or_null_keys(spark, tmp_path):
    frame = spark.createDataFrame(cross_sections(), "date date, ticker string, s double, r double")
    frame.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    want = {}
    for day in {r[0] for r in cross_sections()}:
        pairs = [(r[2], r[3]) for r in cross_sections() if r[0] == day and None not in (r[2], r[3])]
        rank = lambda v: [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]
        want[day] = float(np.corrcoef(*map(rank, zip(*pairs)))[0, 1])
    for source in (frame, stored, stored.repartition(7)):
        for split in (10, 1_000_000):
            got = {r.date: r.ic for r in daily_ic(source, "s", "r", split_rows=split).collect()}
            assert got == pytest.approx(want, abs=1e-12)


def test_rank_columns_keep_rows_with_null_values(spark):
    frame = spark.createDataFrame([("a", None), ("a", 2.0), ("a", 1.0), (None, 5.0)], "g string, x double")
    got = {(r.g, r.x): r.k for r in rank_columns(frame, ["g"], {"x": "k"}).collect()}
    assert got == {("a", None): 1.0, ("a", 1.0): 2.0, ("a", 2.0): 3.0, (None, 5.0): 1.0}


def test_a_gap_against_the_promise_is_an_error(spark):
    rows = [("a", DAY0 + dt.timedelta(i), 10.0 + i % 5, 11.0 + i % 5, 9.0 + i % 5, 10.5 + i % 5, 0.0 if i in (20, 35) else 100.0)
            for i in range(60)]
    bars = spark.createDataFrame(
        rows, "ticker string, date date, open double, high double, low double, close double, volume double")
    bars = bars.withColumn("volume", F.when(F.col("volume") > 0, F.col("volume")))
    with pytest.raises(Exception, match="gaps=False"):
        smoothed_features(bars, gaps=False).collect()
    assert smoothed_features(bars).count() == 60
    late = spark.createDataFrame([("a", DAY0, 1.0), ("a", DAY0 + dt.timedelta(1), 2.0)], "ticker string, date date, x double")
    with pytest.raises(Exception, match="before row 2"):
        ewm_mean(late, [Ewm("y", "x", 0.5, 1, first=2, gaps=False)]).collect()


def test_dependent_factors_and_short_books_do_not_end_the_job(spark):
    rng = np.random.default_rng(3)
    days = [DAY0 + dt.timedelta(i) for i in range(80)]
    m = rng.normal(0, 0.01, 80)
    factors = spark.createDataFrame([(d, float(x), float(2 * x), 0.0) for d, x in zip(days, m)],
                                    "date date, A double, B double, RF double")
    returns = [("long", d, float(0.5 * x + e)) for d, x, e in zip(days, m, rng.normal(0, 0.001, 80))]
    returns += [("short", days[0], 0.01), ("short", days[1], 0.02)]
    got = {(r.strategy, r.model, r.term): r for r in factor_regressions(
        spark.createDataFrame(returns, "strategy string, date date, net_return double"), factors,
        models={"one": ("A",), "both": ("A", "B")}).collect()}
    one, both = got["long", "one", "A"].coef, [got["long", "both", t].coef for t in "AB"]
    assert both[0] + 2 * both[1] == pytest.approx(one, rel=1e-6)
    assert got["long", "one", "A"].t > 10
    assert all(r.t is None and r.r2_adj is None for k, r in got.items() if k[0] == "short")


def test_bars_without_values_are_dropped(spark, tmp_path):
    rows = [(DAY0, "a", 1.0, 2.0, 0.5, 1.5, 10.0), (DAY0, "b", None, None, None, float("nan"), None),
            (DAY0, "c", None, None, None, 1.0, None)]
    path = str(tmp_path / "bars")
    spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume double"
                          ).write.parquet(path)
    assert sorted(r.ticker for r in read_bars(spark, path).collect()) == ["a", "c"]


def test_class_weights_balance(spark):
    frame = spark.createDataFrame([(1.0,)] * 3 + [(0.0,)] * 9 + [(None,)], "label double")
    got = learn.with_class_weight(frame).groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert {r.label: r.w for r in got} == {0.0: 6.0, 1.0: 6.0}


def test_walk_forward_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    trained = []

    def run_fold(panel, dates, fold, features, members, calibrate):
        trained.append(fold)
        rows = spark.createDataFrame([(fold, "m", DAY0, f"t{fold}", 1.0, 0.4, 0.1 * fold)],
                                     "fold int, model string, date date, ticker string, label double, raw double, calibrated double")
        return None, rows, rows

    monkeypatch.setattr(learn, "run_fold", run_fold)
    panel, root = spark.range(1), str(tmp_path / "folds")
    first = learn.walk_forward(panel, None, [1, 2], ["x"], {"m": None}, root=root)
    assert sorted(r.fold for r in first.collect()) == [1, 2] and sorted(trained) == [1, 2]
    again = learn.walk_forward(panel, None, [1, 2, 3], ["x"], {"m": None}, root=root)
    assert sorted((r.fold, r.ticker) for r in again.collect()) == [(1, "t1"), (2, "t2"), (3, "t3")] and sorted(trained) == [1, 2, 3]
    whole = learn.walk_forward(panel, None, [1, 2, 3], ["x"], {"m": None})
    assert whole.columns == again.columns and sorted((r.fold, r.model, r.ticker, r.raw) for r in whole.collect()) == sorted(
        (r.fold, r.model, r.ticker, r.raw) for r in again.collect())
    raw = learn.walk_forward(panel, None, [1, 2], ["x"], {"m": None}, calibrate=False)
    assert sorted((r.fold, r.model, r.calibrated) for r in raw.collect()) == [(1, "m_raw", 0.1), (2, "m_raw", 0.2)]


def test_partitions_that_are_not_whole_are_trained_again(spark, tmp_path, monkeypatch):
    trained = []

    def run_fold(panel, dates, fold, features, members, calibrate):
        trained.append(fold)
        rows = spark.createDataFrame([(DAY0, f"t{i}", 1.0, 0.4, 0.5) for i in range(4)],
                                     "date date, ticker string, label double, raw double, calibrated double")
        return None, rows, rows

    monkeypatch.setattr(learn, "run_fold", run_fold)
    panel, root = spark.range(1), str(tmp_path / "folds")
    dates = spark.createDataFrame([(f, "test", DAY0 + dt.timedelta(f)) for f in (1, 2, 3)], "fold int, role string, date date")
    members = {"forest": learn.random_forest(3, 2)}

    def run(dates=dates, features=("x",), members=members):
        trained.clear()
        out = learn.walk_forward(panel, dates, [1, 2, 3], list(features), members, root=root)
        assert out.count() == 12
        return sorted(trained)

    assert run() == [1, 2, 3] and run() == []
    # begun and not ended
    ledger._add(spark, root, 2, "forest", None, "x")
    assert run() == [2] and run() == []
    # rows lost after the entry
    part = next((tmp_path / "folds" / "fold=3").glob("model=*"))
    spark.createDataFrame([(DAY0, "t0", 1.0, 0.4, 0.5)], "date date, ticker string, label double, raw double, calibrated double"
                          ).write.mode("overwrite").parquet(str(part))
    assert run() == [3]
    # other features, settings or days
    assert run(features=("x", "y")) == [1, 2, 3]
    assert run(features=("x", "y"), members={"forest": learn.random_forest(4, 2)}) == [1, 2, 3]
    moved = dates.withColumn("date", F.when(F.col("fold") == 1, F.date_add("date", 9)).otherwise(F.col("date")))
    assert run(moved, ("x", "y"), {"forest": learn.random_forest(4, 2)}) == [1]


def test_a_killed_write_is_redone(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, "m", DAY0, "t", 0.5)], "fold int, model string, date date, ticker string, p double")
    wanted = spark.createDataFrame([(1, "m", "f")], "fold int, model string, fingerprint string")
    root = str(tmp_path / "p")

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(ledger, "write_predictions", killed)
        with pytest.raises(KeyboardInterrupt):
            ledger.commit_predictions(rows, root, 1, "m", "f")
    assert ledger.unfinished(spark, wanted, root).count() == 1
    assert ledger.commit_predictions(rows, root, 1, "m", "f") == 1
    assert ledger.unfinished(spark, wanted, root).count() == 0
    assert spark.read.parquet(root).count() == 1   # the ledger is not read as data


def test_work_at_once_keeps_order_and_ends_at_an_error(spark):
    assert learn.at_once(spark, lambda i: spark.range(i).count(), [3, 1, 2], 2) == [3, 1, 2]
    with pytest.raises(ZeroDivisionError):
        learn.at_once(spark, lambda i: 1 // i, [1, 0, 2], 2)


def test_fold_checks_see_a_calibration_day_outside_training(spark):
    def days(role, start, n):
        return [(1, role, DAY0 + dt.timedelta(start + i)) for i in range(n)]
    good = days("model_train", 0, 30) + days("cal", 30, 10) + days("embargo", 40, 3) + days("test", 43, 5)
    spoiled = good + days("cal", 41, 1)
    result = {}
    for name, rows in (("good", good), ("spoiled", spoiled)):
        frame = spark.createDataFrame(rows, "fold int, role string, date date")
        result[name] = {r.check_name: r.passed for r in fold_checks(frame, min_train=30).collect()}
    assert all(result["good"].values())
    assert not result["spoiled"]["cal_in_train"]


def test_written_tables_and_reports(spark, tmp_path):
    assert shared_folder(spark) and materialize(spark.range(5)).count() == 5
    write_report(spark.range(5), str(tmp_path / "report"))
    assert len(list((tmp_path / "report").glob("part-*.csv"))) == 1
    rows = spark.range(50).select(F.lit(1).alias("fold"), F.lit("m").alias("model"), F.col("id").cast("string").alias("ticker"))
    write_predictions(rows, str(tmp_path / "pred"))
    assert spark.read.parquet(str(tmp_path / "pred")).count() == 50
    assert len(FEATURES) == 49
