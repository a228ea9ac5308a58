"""Wide price tables for any number of names: one array for each date and block of names, and a dictionary of names.

Names are numbered in alphabetical order; ``BLOCK`` neighbours make a block.  A row holds a date's values of one block, with
their places in it, so a date without a price costs nothing and a block is read without the others.  Nothing is collected
and no table grows wider with the names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators.resample import numbered_rows
from tidegate.session import materialize

BLOCK = 1_024
#: Rows that one task groups or joins.  Hardly two share a name and a date, so a table of groups before the shuffle is waste.
PART_ROWS = 500_000


def write_wide(bars: DataFrame, root: str, value: str = "close", block: int = BLOCK) -> None:
    """``root/names`` (ticker, pos) and ``root/values`` (date, at, values), by block.

    Rows without name, date or value are left out; of several rows of a name and date the largest value stays.
    Rows are shuffled before they are grouped, into as many parts as their number asks for.
    """
    spark = bars.sparkSession
    rows = bars.select("ticker", "date", F.col(value).cast("double").alias("v")).dropna()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))
    best = materialize(rows.repartition(parts, "ticker", "date").groupBy("ticker", "date").agg(F.max("v").alias("v")))
    named = best.repartition(parts, "ticker")
    numbered_rows(named.select("ticker").distinct(), None, "ticker", "pos").select("ticker", "pos").write.mode(
        "overwrite").parquet(f"{root}/names")
    places = spark.read.parquet(f"{root}/names")
    cells = named.join(places, "ticker").select(
        "date", F.expr(f"pos div {block}").alias("block"), (F.col("pos") % block).cast("int").alias("at"), "v").repartition(
        parts, "date", "block")
    line = F.array_sort(F.collect_list(F.struct("at", "v")))
    lines = cells.groupBy("date", "block").agg(line.alias("line")).select(
        "date", "block", F.transform("line", lambda c: c["at"]).alias("at"), F.transform("line", lambda c: c["v"]).alias("values"))
    lines.hint("rebalance", "block").write.mode("overwrite").partitionBy("block").option("maxRecordsPerFile", 100_000).parquet(
        f"{root}/values")
    spark.createDataFrame([(block,)], "block int").coalesce(1).write.mode("overwrite").parquet(f"{root}/layout")


def read_wide(spark: SparkSession, root: str, names: Sequence[str] | None = None, out: str = "close") -> DataFrame:
    """(date, ticker, ``out``); of chosen names only the blocks that hold them are read."""
    block = spark.read.parquet(f"{root}/layout").first().block
    places = spark.read.parquet(f"{root}/names")
    values = spark.read.parquet(f"{root}/values")
    if names is not None:
        places = places.filter(F.col("ticker").isin(list(names)))
        values = values.filter(F.col("block").isin(sorted({r.b for r in places.select(F.expr(f"pos div {block}").alias("b")).collect()})))
    cells = values.select("date", "block", F.inline(F.arrays_zip("at", "values")))
    return cells.withColumn("pos", F.col("block").cast("long") * block + F.col("at")).join(places, "pos").select(
        "date", "ticker", F.col("values").alias(out))


def dense(spark: SparkSession, root: str) -> DataFrame:
    """(date, block, values): each line spread out to the width of its block, NULL where there is no value."""
    block = spark.read.parquet(f"{root}/layout").first().block
    gaps = lambda at: F.array_except(F.sequence(F.lit(0), F.lit(block - 1)), at)
    empty = F.transform(gaps(F.col("at")), lambda i: F.struct(i.alias("at"), F.lit(None).cast("double").alias("values")))
    whole = F.array_sort(F.concat(F.arrays_zip("at", "values"), empty), lambda a, b: a["at"] - b["at"])
    return spark.read.parquet(f"{root}/values").select("date", "block", F.transform(whole, lambda c: c["values"]).alias("values"))
