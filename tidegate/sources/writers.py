"""Sinks: fold-partitioned predictions, caches and small result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.session import materialize
from tidegate.sources.readers import path_exists


def write_predictions(df: DataFrame, root: str, keys: Sequence[str] = ("fold", "model")) -> None:
    """Replace only the partitions present in ``df``; other folds stay.

    Rows are dealt by key, and a key's rows to as many tasks as their size takes.
    """
    (
        df.hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(root)
    )


def pending_folds(spark: SparkSession, wanted: DataFrame, root: str,
                  keys: Sequence[str] = ("fold", "model")) -> DataFrame:
    """Wanted (fold, model) pairs whose output does not exist yet.

    Only partition columns are read, so finished folds cost a folder listing.
    """
    if not path_exists(spark, root + "/fold=*"):
        return wanted
    done = spark.read.parquet(root).select(*keys).distinct()
    return wanted.join(done, list(keys), "left_anti")


def write_panel(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A result table (one row per test, strategy or day) as one CSV file."""
    materialize(df).coalesce(1).write.mode("overwrite").csv(path, header=True)  # only the copy runs in one task


def write_universe(df: DataFrame, path: str) -> None:
    """Names as a JSON array, in list order.  A universe is a list of names."""
    df.agg(F.to_json(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "ticker"))), lambda s: s["ticker"]
    )).alias("value")).coalesce(1).write.mode("overwrite").text(path)
