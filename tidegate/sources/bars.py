"""Bars from raw trades, and benchmark returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.columns import change, series


def bars_from_trades(
    trades: DataFrame,
    *,
    entity: str,
    time: str,
    price: str | Column,
    quantity: str,
    order: Sequence[str] | Column,
) -> DataFrame:
    """Open/high/low/close/volume per entity and day.

    One grouped aggregation with map-side combine: an entity that holds a third
    of all trades costs one partial row per task.  ``order`` must be unique
    within an entity and day for the open and close to be well defined.  A single
    numeric order column keeps the aggregation hash-based; several columns are
    compared as a struct, which Spark aggregates by sorting.
    """
    price = F.col(price) if isinstance(price, str) else price
    key = order if isinstance(order, Column) else F.struct(*order)
    return (
        trades.select(
            F.col(entity).alias("ticker"), F.to_date(time).alias("date"),
            price.cast("double").alias("_px"), F.col(quantity).alias("_qty"), key.alias("_key"),
        )
        .groupBy("ticker", "date")
        .agg(
            F.min_by("_px", "_key").alias("open"),
            F.max("_px").alias("high"),
            F.min("_px").alias("low"),
            F.max_by("_px", "_key").alias("close"),
            F.sum("_qty").cast("double").alias("volume"),
        )
    )


def packed_order(*columns: tuple[str, int]) -> Column:
    """One decimal that orders like the columns, given the digits each may have.

    A value with more digits than stated would change the order, so it raises.
    """
    total = None
    for name, digits in columns:
        fits = F.when(F.col(name).between(0, 10 ** digits - 1), F.col(name)).otherwise(
            F.raise_error(F.concat(F.lit(f"{name} needs more than {digits} digits: "), F.col(name).cast("string"))).cast("long"))
        part = fits.cast("decimal(38,0)")
        total = part if total is None else (total * F.lit(10 ** digits).cast("decimal(19,0)") + part).cast("decimal(38,0)")
    return total


def daily_returns(levels: DataFrame, *, time: str = "date", level: str = "close",
                  by: str | None = None, out: str = "ret") -> DataFrame:
    """Simple returns of a benchmark level, first row dropped.

    Without ``by`` the table is one series: at most one row per calendar day.
    """
    if by is None:
        frame = levels.withColumn("_one", F.lit(1))
        w = series("_one", time)
        return frame.withColumn(out, change(level, w, 1)).filter(F.col(out).isNotNull()).drop("_one")
    return levels.withColumn(out, change(level, series(by, time), 1)).filter(F.col(out).isNotNull())
