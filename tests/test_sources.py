"""Readers and writers on files written by the test."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidegate.sources import readers as rd
from tidegate.sources import writers as wr

DAY = dt.date(2020, 1, 1)


def bars(spark, names="ab", n=3):
    rows = [(DAY + dt.timedelta(i), t, 1.0, 2.0, 0.5, 1.5 + i, float("nan") if i == 1 else 10.0) for t in names for i in range(n)]
    return spark.createDataFrame(rows, "Date date, Symbol string, Open double, High double, Low double, Close double, Volume double")


def test_read_bars_accepts_synonyms_and_nan(spark, tmp_path):
    bars(spark).write.parquet(str(tmp_path / "b"))
    got = rd.read_bars(spark, str(tmp_path / "b"))
    assert got.columns == list(rd.BAR_COLUMNS) and got.filter("volume is null").count() == 2
    plan = got.filter(F.col("ticker") == "a").select("close")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(Symbol), EqualTo(Symbol,a)]" in plan
    bars(spark).drop("Close").write.parquet(str(tmp_path / "c"))
    with pytest.raises(ValueError, match="close"):
        rd.read_bars(spark, str(tmp_path / "c"))


def test_one_file_per_entity(spark, tmp_path):
    for t in "ab":
        bars(spark, t).drop("Symbol").toPandas().astype({"Date": "datetime64[us]"}).to_parquet(tmp_path / f"{t}.parquet")
    got = rd.read_bars_per_entity(spark, str(tmp_path / "*.parquet"))
    assert sorted((r.ticker, r["count"]) for r in got.groupBy("ticker").count().collect()) == [("a", 3), ("b", 3)]


def test_wide_and_long(spark):
    long = bars(spark).select(F.col("Date").alias("date"), F.col("Symbol").alias("ticker"), F.col("Close").alias("close"))
    wide = rd.long_to_wide(long, ["a", "b"])
    assert wide.columns == ["date", "a", "b"]
    assert sorted(rd.wide_to_long(wide).select("date", "ticker", "close").collect()) == sorted(long.collect())


def test_predictions_resume(spark, tmp_path):
    root = str(tmp_path / "pred")
    wanted = spark.createDataFrame([(1, "m"), (2, "m")], "fold int, model string")
    assert wr.pending_folds(spark, wanted, root).count() == 2
    one = lambda fold, p: spark.createDataFrame([(fold, "m", DAY, "a", p)], "fold int, model string, date date, ticker string, prob double")
    wr.write_predictions(one(1, 0.1), root)
    assert [r.fold for r in wr.pending_folds(spark, wanted, root).collect()] == [2]
    wr.write_predictions(one(2, 0.2), root)
    wr.write_predictions(one(1, 0.3), root)
    assert sorted((r.fold, r.prob) for r in rd.read_predictions(spark, root).collect()) == [(1, 0.3), (2, 0.2)]


def test_universe_and_reports(spark, tmp_path):
    (tmp_path / "u.json").write_text(json.dumps(["b", "a", "b"], indent=1))
    names = rd.read_universe(spark, str(tmp_path / "u.json"))
    assert [r.ticker for r in names.orderBy("pos").collect()] == ["b", "a"]
    wr.write_universe(names, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value) == ["b", "a"]
    wr.write_report(names, str(tmp_path / "csv"))
    assert rd.read_table(spark, str(tmp_path / "csv"), "ticker string, pos int").count() == 2


def test_first_available(spark, tmp_path):
    bars(spark).write.parquet(str(tmp_path / "second"))
    got = rd.first_available(
        spark, (str(tmp_path / "first"), rd.read_predictions), (str(tmp_path / "second"), rd.read_bars))
    assert got.count() == 6
    with pytest.raises(FileNotFoundError):
        rd.first_available(spark, (str(tmp_path / "none"), rd.read_bars))


def test_wide_blocks_of_five_thousand_names(spark, tmp_path):
    from tidegate.sources import wide

    rows = spark.range(5_000).select(F.format_string("n%05d", "id").alias("ticker"), F.explode(F.sequence(
        F.lit(0), F.lit(5))).alias("d"), "id").filter("(id + d) % 3 > 0").select(
        "ticker", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).alias("date"), (F.col("id") + F.col("d") / 7).alias("close"))
    root = str(tmp_path / "wide")
    wide.write_wide(rows.unionByName(spark.createDataFrame([(None, None, 1.0), ("x", None, 2.0), ("n00001", None, None)], "ticker string, date date, close double")), root, block=64)
    back = wide.read_wide(spark, root)
    assert back.count() == rows.count() and back.select(*rows.columns).exceptAll(rows).count() == 0
    names = ["n00007", "n04999", "absent"]
    some = wide.read_wide(spark, root, names)
    assert some.select(*rows.columns).exceptAll(rows.filter(F.col("ticker").isin(names))).count() == 0
    assert {r.ticker for r in some.collect()} == {"n00007", "n04999"}
    lines = wide.dense(spark, root)
    assert lines.filter(F.size("values") != 64).count() == 0 and lines.count() == 6 * 79
    assert lines.agg(F.sum(F.size(F.array_compact("values")))).first()[0] == rows.count()


def test_wide_blocks_group_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    from tidegate.sources import wide

    monkeypatch.setattr(wide, "PART_ROWS", 1_000)
    seen, kept = [], wide.materialize
    monkeypatch.setattr(wide, "materialize", lambda df: seen.append(df) or kept(df))
    rows = spark.range(20_000).select(F.format_string("n%04d", F.col("id") % 500).alias("ticker"), F.date_add(
        F.lit("2020-01-01").cast("date"), (F.col("id") / 1_000).cast("int")).alias("date"), F.col("id").cast("double").alias("close"))
    root = str(tmp_path / "wide")
    wide.write_wide(rows, root, block=64)
    each = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(each) == 10_000 and len(each) == 20 and max(each) < 1_500   # four parts of the session would hold 2,500 each
    want = rows.groupBy("ticker", "date").agg(F.max("close").alias("close"))   # two rows of each name and day
    assert wide.read_wide(spark, root).select(*want.columns).exceptAll(want).count() == 0
    assert wide.read_wide(spark, root).count() == 10_000
