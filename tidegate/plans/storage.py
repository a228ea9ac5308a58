"""Readers and writers on data from the given tables: written to the shared folder, read back, compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.operators import folds as fo
from tidegate.plans.base import BARS_SQL, FOLDS_SQL, OOS_SQL, bars, folds, out_of_sample, sql, table
from tidegate.plans.registry import query
from tidegate.session import scratch
from tidegate.sources import ledger, wide
from tidegate.sources import readers as rd
from tidegate.sources import writers as wr


@query("stored_bars", sql(BARS_SQL, """
SELECT * FROM bars"""))
def stored_bars(spark, sf):
    """Bars in a file with other letter case and with empty bars, as the reader returns them."""
    b, path = bars(spark, sf), scratch(spark)
    empty = b.groupBy("ticker").agg(F.max("date").alias("date")).select(
        "ticker", F.date_add("date", 1).alias("date"), *[F.lit(None).cast("double").alias(c) for c in rd.BAR_COLUMNS[2:]])
    wr.write_panel(b.unionByName(empty).withColumnsRenamed({c: c.title() for c in b.columns}), path)
    return rd.read_bars(spark, path)


@query("stored_bars_by_source", sql(BARS_SQL, """
SELECT ticker, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY ticker"""))
def stored_bars_by_source(spark, sf):
    """The first source that exists answers; the ones before it are missing."""
    path = scratch(spark)
    wr.write_panel(bars(spark, sf), path, ["ticker"])
    b = rd.first_available(spark, (path + "-cache", rd.read_bars), (path + "-old", rd.read_bars), (path, rd.read_bars))
    return b.groupBy("ticker").agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("stored_predictions", sql(OOS_SQL, """
SELECT fold, 'proxy' AS model, CASE WHEN fold <= 3 THEN count(*) ELSE 0 END AS n_stored, fold > 3 AS pending FROM oos GROUP BY fold"""))
def stored_predictions(spark, sf):
    """Folds 1 to 3 are written, fold 2 twice; which folds are left to do."""
    rows, root = out_of_sample(spark, sf).withColumn("model", F.lit("proxy")), scratch(spark)
    keep = ("fold", "model", "date", "ticker", "prob", "actual_return")
    wr.write_predictions(rows.filter("fold <= 3").select(*keep), root)
    wr.write_predictions(rows.filter("fold = 2").select(*keep), root)
    wanted = rows.select("fold", "model").distinct()
    left = wr.pending_folds(spark, wanted, root).withColumn("pending", F.lit(True))
    have = rd.read_predictions(spark, root).groupBy("fold", "model").agg(F.count("prob").alias("n_stored"))
    return wanted.join(have, ["fold", "model"], "left").join(left, ["fold", "model"], "left").select(
        "fold", "model", F.coalesce("n_stored", F.lit(0)).alias("n_stored"), F.coalesce("pending", F.lit(False)).alias("pending"))


@query("stored_report", sql(FOLDS_SQL, """
SELECT fold, role, min(date) AS first_date, max(date) AS last_date, count(*) AS n_dates FROM fold_dates GROUP BY 1, 2"""))
def stored_report(spark, sf):
    """The fold summary through a CSV report."""
    path = scratch(spark)
    summary = fo.fold_summary(folds(spark, sf))
    wr.write_report(summary, path)
    return rd.read_table(spark, path, summary.schema)


@query("stored_universe", sql(BARS_SQL, """
SELECT ticker, row_number() OVER (ORDER BY n DESC, ticker) - 1 AS pos FROM (SELECT ticker, count(*) AS n FROM bars GROUP BY ticker)"""))
def stored_universe(spark, sf):
    """Names by number of bars through a JSON list in which each stands twice."""
    names = bars(spark, sf).groupBy("ticker").agg(F.count("*").alias("n")).select(
        "ticker", F.struct(-F.col("n"), "ticker").alias("at"))
    path = scratch(spark)
    twice = names.withColumn("turn", F.lit(0)).unionByName(names.withColumn("turn", F.lit(1)))
    wr.write_universe(twice.select(F.struct("turn", "at").alias("pos"), "ticker"), path)
    return rd.read_universe(spark, path).select("ticker", F.col("pos").cast("long").alias("pos"))


@query("stored_ledger", sql(OOS_SQL, """
SELECT fold, 'proxy' AS model, fold NOT IN (2, 4) AND fold <= 5 AS done, CASE WHEN fold NOT IN (2, 4) AND fold <= 5 THEN count(*) END AS n_rows
FROM oos GROUP BY fold"""))
def stored_ledger(spark, sf):
    """Folds 1 to 5 are committed; fold 2 was begun anew and not ended, and fold 4 was made from other features."""
    rows, root = out_of_sample(spark, sf).withColumn("model", F.lit("proxy")), scratch(spark)
    rows = rows.select("fold", "model", "date", "ticker", "prob", "actual_return")
    marks = {f: ledger.fingerprint(features=["prob"] if f != 4 else ["other"], fold=f) for f in range(1, 6)}
    for f, mark in marks.items():
        ledger.commit_predictions(rows, root, f, "proxy", mark)
    ledger.begin(spark, root, 2, "proxy", marks[2])
    folds_there = rows.select("fold").distinct().withColumn("model", F.lit("proxy"))
    want = {f: ledger.fingerprint(features=["prob"], fold=f) for f in marks}
    wanted = folds_there.join(F.broadcast(spark.createDataFrame(list(want.items()), "fold int, fingerprint string")), "fold", "left")
    left = ledger.unfinished(spark, wanted.fillna("none", ["fingerprint"]), root).select("fold", F.lit(False).alias("done"))
    have = ledger.entries(spark, root).select("fold", "n_rows")
    return folds_there.join(left, "fold", "left").join(have, "fold", "left").select(
        "fold", "model", F.coalesce("done", F.lit(True)).alias("done"),
        F.when(F.col("done").isNull(), F.col("n_rows")).alias("n_rows"))


@query("wide_blocks_round_trip", sql("""
px AS (SELECT CAST(l_partkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS p FROM lineitem)""", """
SELECT ticker, date, round(max(p), 8) AS close FROM px GROUP BY ALL"""))
def wide_blocks_round_trip(spark, sf):
    """Highest price of every part and day (thousands of names) through a table of one array for each date and block of names."""
    root = scratch(spark)
    prices = table(spark, sf, "lineitem").select(   # the writer keeps the highest of a name and day
        F.col("l_partkey").cast("string").alias("ticker"), F.to_date("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))
    wide.write_wide(prices, root)
    return wide.read_wide(spark, root).select("ticker", "date", F.round("close", 8).alias("close"))
