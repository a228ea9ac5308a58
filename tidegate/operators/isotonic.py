"""Isotonic calibration of any number of keys (folds, models) in one job.

Equal scores are pooled first, combined before the shuffle.  The non-decreasing least-squares step function is the slope of
the greatest convex minorant of the cumulative sums of what is left, which one pass over the scores in order finds: a new
block is merged with those before it as long as their means are not smaller.  Merging part of the blocks first changes
nothing, so a large key is cut into ranges of scores, each range is merged in a task of its own, and only what remains of
the ranges meets in one task, no more than the steps of the calibrator.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.columns import clip01
from tidegate.operators.ranks import null_safe_join

RANGES = 64
_BLOCK = "lo double, hi double, total double, weight double"


def merged_blocks(lo: np.ndarray, hi: np.ndarray, total: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Blocks in ascending order of scores, merged until their means increase."""
    top = -1
    lo, hi, total, weight = (np.array(x, float) for x in (lo, hi, total, weight))
    for k in range(len(lo)):
        top += 1
        lo[top], hi[top], total[top], weight[top] = lo[k], hi[k], total[k], weight[k]
        while top and total[top - 1] * weight[top] >= total[top] * weight[top - 1]:
            top -= 1
            hi[top], total[top], weight[top] = hi[top + 1], total[top] + total[top + 1], weight[top] + weight[top + 1]
    return [x[: top + 1] for x in (lo, hi, total, weight)]


def _merge(table: pa.Table) -> pa.Table:
    table = table.sort_by([("lo", "ascending")])
    columns = merged_blocks(*(table.column(c).to_numpy() for c in ("lo", "hi", "total", "weight")))
    keys = [c for c in table.column_names if c not in ("lo", "hi", "total", "weight")]
    return pa.table({**{c: table.column(c).slice(0, len(columns[0])) for c in keys},
                     **dict(zip(("lo", "hi", "total", "weight"), columns))})


def isotonic_blocks(rows: DataFrame, by: Sequence[str] = (), score: str = "raw", label: str = "label",
                    weight: str | None = None, ranges: int = RANGES) -> DataFrame:
    """``by``, ``lo``, ``hi``, ``value``: the steps of each key's calibrator; from ``lo`` to ``hi`` it is constant.

    Rows without score or label, or without positive weight, play no part.  A NULL key is a key like others.
    """
    if not by:
        return isotonic_blocks(rows.withColumn("_all", F.lit(0)), ["_all"], score, label, weight, ranges).drop("_all")
    by, w = list(by), F.lit(1.0) if weight is None else F.col(weight).cast("double")
    x = F.col(score).cast("double")
    scores = rows.select(*by, (x + 0.0).alias("lo"), F.col(label).cast("double").alias("_y"), w.alias("_w")).filter(
        F.col("lo").isNotNull() & ~F.isnan("lo") & F.col("_y").isNotNull() & (F.col("_w") > 0))
    scores = scores.groupBy(*by, "lo").agg(F.sum(F.col("_y") * F.col("_w")).alias("total"), F.sum("_w").alias("weight"))
    scores = scores.select(*by, "lo", F.col("lo").alias("hi"), "total", "weight")
    edges = scores.groupBy(*by).agg(F.percentile_approx(
        "lo", F.lit([i / ranges for i in range(1, ranges)]), F.lit(1000)).alias("_cut"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(*by).schema.fields}
    shape = ", ".join([*(f"`{k}` {kinds[k]}" for k in by), _BLOCK])
    ranged = null_safe_join(scores, edges, by).withColumn(
        "_range", F.size(F.filter("_cut", lambda e: e < F.col("lo")))).drop("_cut")
    part = ranged.groupBy(*by, "_range").applyInArrow(_merge, f"{shape.removesuffix(_BLOCK)}_range int, {_BLOCK}").drop("_range")
    whole = part.groupBy(*by).applyInArrow(_merge, shape)
    return whole.select(*by, "lo", "hi", (F.col("total") / F.col("weight")).alias("value"))


def calibrators(blocks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per key with the step ends ``_xs`` in order and their values ``_ys``."""
    ends = F.array_sort(F.flatten(F.collect_list(F.array(
        F.struct(F.col("lo").alias("x"), F.col("value").alias("y")), F.struct(F.col("hi").alias("x"), F.col("value").alias("y"))))))
    return blocks.groupBy(*by).agg(ends.alias("_ends")).select(
        *by, F.transform("_ends", lambda e: e["x"]).alias("_xs"), F.transform("_ends", lambda e: e["y"]).alias("_ys"))


def interpolated(x: Column, xs: Column, ys: Column) -> Column:
    """Straight lines between the ends, constant outside; NULL without ends."""
    at = F.size(F.filter(xs, lambda e: e <= x))
    low_x, low_y, high_x, high_y = (F.get(a, i) for i in (at - 1, at) for a in (xs, ys))
    between = low_y + (high_y - low_y) * F.try_divide(x - low_x, high_x - low_x)
    return F.when(at == 0, F.get(ys, F.lit(0))).when(at >= F.size(xs), F.get(ys, F.size(ys) - 1)).otherwise(between)


def calibrated(rows: DataFrame, blocks: DataFrame, by: Sequence[str] = (), score: str = "raw", out: str = "calibrated") -> DataFrame:
    """``rows`` with the calibrated score; NULL where a key has no calibrator or a row no score.

    A key's calibrator is one row; there are as many as folds and models.
    """
    if not by:
        rows, blocks = rows.withColumn("_all", F.lit(0)), blocks.withColumn("_all", F.lit(0))
        return calibrated(rows, blocks, ["_all"], score, out).drop("_all")
    joined = null_safe_join(rows, calibrators(blocks, by), list(by), "left")
    value = clip01(interpolated(F.col(score).cast("double"), F.col("_xs"), F.col("_ys")))
    return joined.withColumn(out, F.when(F.col(score).isNotNull() & F.col("_xs").isNotNull(), value)).drop("_xs", "_ys")
