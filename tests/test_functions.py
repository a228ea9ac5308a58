"""Tails, draws, ranks and text parsing on values known from elsewhere."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidegate.functions import tails
from tidegate.functions.columns import clip01, feature_category, lower_names
from tidegate.functions.draws import PRIME, draw, draw_columns
from tidegate.operators.ranks import daily_ic, rank_columns
from tidegate.sources.readers import parse_factor_text


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("z,p", [
    (1.348255422, 0.088788122), (0.0, 0.5), (-1.0, 0.8413447460685429), (5.0, 2.866515718791933e-07),
    (9.0, 1.1285884059538405e-19)])
def test_normal_upper_tail(spark, z, p):
    assert one(spark, tails.normal_sf(F.lit(z)))[0] == pytest.approx(p, rel=1e-7)


def test_normal_two_sided_matches_published_regression_value(spark):
    assert one(spark, tails.normal_two_sided(F.lit(-2.154291568)))[0] == pytest.approx(0.031217314, rel=1e-6)


@pytest.mark.parametrize("t,df,p", [
    (1.0, 1, 0.25), (2.0, 2, 0.09175170953613698), (2.0, 10, 0.036694017385370196), (-1.5, 5, 0.9030481598787634),
    (1.812461122811676, 10, 0.05), (1.65, 2000, 0.049551)])
def test_student_tail(spark, t, df, p):
    assert one(spark, tails.student_sf(F.lit(t), F.lit(df)))[0] == pytest.approx(p, rel=2e-4)


def test_draws_agree_between_forms_and_look_uniform(spark):
    rows = spark.range(20000).withColumns({"rep": F.lit(7).cast("long"), "h": F.col("id") * 131 % 268435399, "l": F.col("id") % 97})
    rows = draw_columns(rows, "rep", "h", "l", "u").withColumn("v", draw(F.col("rep"), F.col("h"), F.col("l")))
    got = rows.agg(F.sum((F.col("u") != F.col("v")).cast("int")).alias("bad"), F.avg(F.col("u") / PRIME).alias("m"),
                   F.min("u").alias("lo"), F.max("u").alias("hi")).first()
    assert got.bad == 0 and 0.48 < got.m < 0.52 and 0 <= got.lo and got.hi < PRIME


def brute_ranks(values):
    return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]


def test_split_ranks_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = [(g, i, rnd.choice([0.5, 0.5, 0.5, rnd.random()]), rnd.gauss(0, 1)) for g in "ab" for i in range(300)]
    df = spark.createDataFrame(rows, "g string, i int, x double, y double")
    got = {(r.g, r.i): (r.rx, r.ry) for r in rank_columns(df, ["g"], {"x": "rx", "y": "ry"}, split_rows=10).collect()}
    for g in "ab":
        mine = [r for r in rows if r[0] == g]
        for r, rx, ry in zip(mine, brute_ranks([r[2] for r in mine]), brute_ranks([r[3] for r in mine])):
            assert got[g, r[1]] == (rx, ry)


def test_daily_ic_degenerate_and_minimum_names(spark):
    rows = [(1, "a", 0.5, 0.1), (1, "b", 0.5, 0.2), (1, "c", 0.5, 0.3), (2, "a", 1.0, 0.1), (2, "b", 2.0, 0.3), (2, "c", 3.0, 0.2)]
    df = spark.createDataFrame(rows, "date int, ticker string, s double, r double")
    assert {r.date: r.ic for r in daily_ic(df, "s", "r").collect()} == {1: 0.0, 2: pytest.approx(0.5)}
    assert [r.date for r in daily_ic(df, "s", "r", on_degenerate="skip").collect()] == [2]
    assert daily_ic(df, "s", "r", min_names=4).count() == 0
    with pytest.raises(ValueError):
        daily_ic(df, "s", "r", on_degenerate="other")


def test_factor_text(spark):
    lines = ["Daily data", "", ",A,B", "20200102,  1.50, -0.25", "20200103, 0.10,", "202001, 9, 9", "2020, 9, 9", "Copyright"]
    got = parse_factor_text(spark.createDataFrame([(x,) for x in lines], "value string"), ["A", "B"]).orderBy("date").collect()
    assert [str(r.date) for r in got] == ["2020-01-02", "2020-01-03"]
    assert got[0].A == pytest.approx(0.015) and got[0].B == pytest.approx(-0.0025) and got[1].B is None


def test_small_helpers(spark):
    assert tuple(one(spark, clip01(F.lit(-0.1)), clip01(F.lit(0.4)), clip01(F.lit(7.0)))) == (0.0, 0.4, 1.0)
    names = ("rolling_vol_5d", "EMA_9", "MACD_hist", "MFI_14", "BB_pct_b", "OC_body_norm")
    assert [one(spark, feature_category(F.lit(n)))[0] for n in names] == [
        "Volatility", "Trend / MA", "Trend / MA", "Volume", "Oscillator", "Other"]
    assert lower_names(spark.createDataFrame([(1, 2)], "Datetime int, Symbol int")).columns == ["date", "ticker"]
    assert math.isclose(one(spark, tails.normal_cdf(F.lit(1.96)))[0], 0.9750021048517795, rel_tol=1e-9)
