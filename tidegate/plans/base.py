"""Inputs of the registered queries, in Spark and in SQL.

Bars come from ``lineitem`` and ``part``: a name is a brand, a price is
``l_extendedprice / l_quantity``.  The score is a fixed function of trailing
momentum, so the operators behind a model can be checked without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.columns import change, series, spread_by
from tidegate.operators.features import long_average, with_holding_return, with_target
from tidegate.operators.folds import date_index, fold_dates, test_rows
from tidegate.session import materialize
from tidegate.sources.bars import bars_from_trades, packed_order

# digits suffice for 100 TB of these tables; more would raise, not misorder
ORDER_KEY = (("l_orderkey", 13), ("l_linenumber", 1), ("l_partkey", 12), ("l_suppkey", 11))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars as a written table: the raw trades are read once per query."""
    return materialize(raw_bars(spark, sf))


def series_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars laid out for per-name windows."""
    return spread_by(bars(spark, sf), "ticker")


def raw_bars(spark: SparkSession, sf: str) -> DataFrame:
    trades = table(spark, sf, "lineitem").join(
        table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return bars_from_trades(
        trades, entity="p_brand", time="l_shipdate", price=F.col("l_extendedprice") / F.col("l_quantity"),
        quantity="l_quantity", order=packed_order(*ORDER_KEY))


def panel(spark: SparkSession, sf: str, frame: DataFrame | None = None) -> DataFrame:
    """Scored panel after warm-up, with label and realised holding return, from ``frame`` if a query has bars already."""
    frame = raw_bars(spark, sf) if frame is None else frame
    rows = spread_by(frame.select("ticker", "date", "close"), "ticker")
    rows = long_average(rows, "SMA_200", (10, 4, 5)).withColumn(
        "trailing_return_21d", change("close", series("ticker", "date"), 21))
    rows = with_target(rows).dropna(subset=["SMA_200", "trailing_return_21d", "target"])
    rows = with_holding_return(rows).filter(F.col("actual_return").isNotNull())
    return materialize(rows.withColumn("prob", F.round(
        0.5 + 0.5 * F.col("trailing_return_21d") / (1 + F.abs("trailing_return_21d")), 4)))


def folds(spark: SparkSession, sf: str, frame: DataFrame | None = None) -> DataFrame:
    frame = panel(spark, sf) if frame is None else frame
    return fold_dates(date_index(frame), strict=False)


def out_of_sample(spark: SparkSession, sf: str, frame: DataFrame | None = None) -> DataFrame:
    """Panel rows on test days, tagged with their fold, from the panel ``frame`` if a query has one already."""
    p = panel(spark, sf) if frame is None else frame
    return materialize(test_rows(p, folds(spark, sf, p)))


def rounded(df: DataFrame, digits: dict[str, int] | int = 6, *keep: str) -> DataFrame:
    """Round doubles so that results do not depend on summation order."""
    def one(c: str, t: str) -> Column:
        if t != "double" or c in keep:
            return F.col(c)
        n = digits if isinstance(digits, int) else digits.get(c, 6)
        # adding 0 turns -0.0 into 0.0
        return (F.round(F.col(c), n) + 0.0).alias(c)
    return df.select(*[one(c, t) for c, t in df.dtypes])


def significant(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to ``digits`` significant digits, for values of any magnitude."""
    fmt = f"%.{digits - 1}e"
    return df.select(*[
        (F.format_string(fmt, F.col(c)).try_cast("double") + 0.0).alias(c) if t == "double" else F.col(c)
        for c, t in df.dtypes])


def sig_sql(expr: str, name: str, digits: int = 9) -> str:
    return f"CAST(printf('%.{digits - 1}e', CAST({expr} AS DOUBLE)) AS DOUBLE) + 0.0 AS {name}"


BARS_SQL = """
bars AS (
  SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date,
         first(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS open,
         max(px) AS high, min(px) AS low,
         last(px ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS close,
         CAST(sum(l_quantity) AS DOUBLE) AS volume
  FROM (SELECT l.*, p_brand, l_extendedprice / l_quantity AS px
        FROM lineitem l JOIN part ON l_partkey = p_partkey)
  GROUP BY 1, 2)"""

PANEL_SQL = BARS_SQL + """,
p0 AS (
  SELECT ticker, date, close,
         CASE WHEN count(close) OVER w200 = 200 THEN avg(close) OVER w200 END AS SMA_200,
         close / lag(close, 21) OVER w - 1 AS trailing_return_21d,
         CASE WHEN lead(close, 2) OVER w IS NOT NULL
              THEN CASE WHEN lead(close, 2) OVER w > lead(close, 1) OVER w THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS target
  FROM bars
  WINDOW w AS (PARTITION BY ticker ORDER BY date),
         w200 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
p1 AS (
  SELECT *, lead(close, 2) OVER w / lead(close, 1) OVER w - 1 AS actual_return,
         round(0.5::DOUBLE + 0.5::DOUBLE * trailing_return_21d / (1 + abs(trailing_return_21d)), 4) AS prob
  FROM p0 WHERE SMA_200 IS NOT NULL AND trailing_return_21d IS NOT NULL AND target IS NOT NULL
  WINDOW w AS (PARTITION BY ticker ORDER BY date)),
panel AS (SELECT * FROM p1 WHERE actual_return IS NOT NULL)"""

FOLDS_SQL = PANEL_SQL + """,
days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS day_no FROM (SELECT DISTINCT date FROM panel)),
fold_list AS (
  SELECT fold, 756 + (fold - 1) * 126 AS n_train, CAST(floor((756 + (fold - 1) * 126) * 0.8::DOUBLE) AS BIGINT) AS n_fit
  FROM (SELECT CAST(unnest(range(1, CASE WHEN n < 884 THEN 1 ELSE (n - 884) // 126 + 2 END)) AS INTEGER) AS fold
        FROM (SELECT count(*) AS n FROM days))),
fold_dates AS (
  SELECT fold, date, day_no,
         CASE WHEN day_no < n_fit THEN 'model_train' WHEN day_no < n_train THEN 'cal'
              WHEN day_no < n_train + 2 THEN 'embargo' ELSE 'test' END AS role
  FROM fold_list JOIN days ON day_no < n_train + 2 + 126)"""

OOS_SQL = FOLDS_SQL + """,
oos AS (SELECT p.*, f.fold FROM panel p JOIN fold_dates f ON p.date = f.date AND f.role = 'test')"""


def sql(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"
