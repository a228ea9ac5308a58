"""Exponentially weighted means with the recursive definition.

    y_t = (q^g * y_prev + alpha * x_t) / (q^g + alpha),   q = 1 - alpha

``g`` is the number of rows since the previous value, 1 without gaps; a NULL row
repeats the previous mean.  The recursion is linear, so it is cut into blocks of
rows: inside a block the mean is a weighted running sum, and the mean at the end
of each earlier block enters as a carry.  One shuffle by entity serves all
requested means; the block ends (one row in ``BLOCK``) are folded per entity.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.columns import series, so_far


class Ewm(NamedTuple):
    """One requested mean.

    ``gaps=False`` promises that ``column`` is NULL before row ``first`` (counted
    from 1) of each entity and never after it; a row that breaks the promise ends
    the job with an error.
    """

    out: str
    column: str
    alpha: float
    min_periods: int
    first: int = 1
    gaps: bool = True

    @staticmethod
    def span(out: str, column: str, span: int, first: int = 1, gaps: bool = True) -> "Ewm":
        return Ewm(out, column, 2.0 / (span + 1), span, first, gaps)

    @staticmethod
    def wilder(out: str, column: str, period: int, first: int = 1, gaps: bool = True) -> "Ewm":
        return Ewm(out, column, 1.0 / period, period, first, gaps)


def _block_size(specs: Sequence[Ewm]) -> int:
    """Block whose weights q^-j stay far inside the double range, gaps included."""
    steepest = max(-math.log1p(-min(s.alpha, 1 - 1e-9)) for s in specs)
    return max(4, min(256, int(300 / steepest)))


def _carry(i: int):
    """Appends the mean at the end of the next block to the means so far."""
    return lambda means, block: F.concat(
        means, F.array(block[f"v{i}"] + block[f"d{i}"] * F.element_at(means, -1)))


def _fixed_carry(i: int, last: float, q: float):
    """As ``_carry`` with the decay of a full block known beforehand."""
    return lambda means, block: F.concat(
        means, F.array(last * (block[f"v{i}"] + q * F.element_at(means, -1))))


def ewm_mean(df: DataFrame, specs: Sequence[Ewm], *, entity: str = "ticker", time: str = "date") -> DataFrame:
    """Add one column per spec; NULL until ``min_periods`` values were seen."""
    plain = [s for s in specs if not s.gaps]
    gappy = [s for s in specs if s.gaps]
    if plain:
        df = _without_gaps(df, plain, entity, time)
    if gappy:
        df = _with_gaps(df, gappy, entity, time)
    return df


def _without_gaps(df: DataFrame, specs: Sequence[Ewm], entity: str, time: str) -> DataFrame:
    """Decay depends on the row number alone: one running sum per mean."""
    base = df.columns
    size = _block_size(specs)
    pos = F.col("_pos")
    in_block = Window.partitionBy(entity, "_blk").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)

    def power(s: Ewm, sign: int):
        """q^(sign * position) from a table of the block's positions."""
        q = 1 - s.alpha
        return F.get(F.lit([q ** (sign * j) for j in range(size)]), pos)

    rows = df.withColumn("_rn", F.row_number().over(series(entity, time)))
    rows = rows.withColumns({
        "_blk": F.expr(f"cast((_rn - 1) div {size} as int)"),
        "_pos": F.expr(f"cast((_rn - 1) % {size} as int)"),
    })
    def checked(column: str, first: int):
        value = F.col(column)
        late = F.lit(f"a gap in {column}, which was said to have none (gaps=False)")
        return F.when(value.isNull() & (F.col("_rn") >= first), F.raise_error(late).cast("double")).when(
            value.isNotNull() & (F.col("_rn") < first),
            F.raise_error(F.lit(f"a value of {column} before row {first}")).cast("double")).otherwise(value)

    def entry(s: Ewm, value):
        return value * F.when(F.col("_rn") == s.first, 1.0).otherwise(s.alpha) * power(s, -1)

    # a promise is checked once for each column, on the way to the running sums; the sums of blocks read the same rows
    inputs = {key: f"_x{k}" for k, key in enumerate({(s.column, s.first): None for s in specs})}
    ends = (
        rows.groupBy(F.col(entity).alias("_e"), "_blk")
        .agg(*[F.coalesce(F.sum(entry(s, F.col(s.column))), F.lit(0.0)).alias(f"v{i}") for i, s in enumerate(specs)])
        .groupBy("_e")
        .agg(F.array_sort(F.collect_list(F.struct("_blk", *[f"v{i}" for i in range(len(specs))]))).alias("_ends"))
        .select("_e", *[
            F.aggregate("_ends", F.array(F.lit(0.0)), _fixed_carry(i, (1 - s.alpha) ** (size - 1), 1 - s.alpha))
            .alias(f"_c{i}")
            for i, s in enumerate(specs)
        ])
    )
    rows = rows.withColumns({x: checked(*key) for key, x in inputs.items()})
    rows = rows.withColumns({
        f"_acc{i}": F.sum(entry(s, F.col(inputs[s.column, s.first]))).over(in_block) for i, s in enumerate(specs)})
    joined = rows.join(ends, rows[entity] == ends["_e"], "left")
    return joined.select(*base, *[
        F.when(
            F.col("_rn") >= s.first + max(s.min_periods, 1) - 1,
            power(s, 1) * (F.coalesce(F.col(f"_acc{i}"), F.lit(0.0))
                           + (1 - s.alpha) * F.get(F.col(f"_c{i}"), F.col("_blk"))),
        ).alias(s.out)
        for i, s in enumerate(specs)
    ])


def _with_gaps(df: DataFrame, specs: Sequence[Ewm], entity: str, time: str) -> DataFrame:
    base = df.columns
    size = _block_size(specs)
    w = series(entity, time)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    in_block = Window.partitionBy(entity, "_blk").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)

    rows = df.withColumn("_rn", F.row_number().over(w))
    rows = rows.withColumn("_blk", F.floor((F.col("_rn") - 1) / size).cast("int"))

    # gap to the previous value, and the count of values, per distinct input
    inputs = {s.column: f"_{i}" for i, s in enumerate({s.column: s for s in specs}.values())}
    rows = rows.withColumns({
        f"{tag}_prev": F.last(F.when(F.col(c).isNotNull(), F.col("_rn")), ignorenulls=True).over(before)
        for c, tag in inputs.items()
    } | {f"{tag}_seen": F.count(c).over(so_far(w)) for c, tag in inputs.items()})

    step, share = {}, {}
    for i, s in enumerate(specs):
        tag = inputs[s.column]
        gap = F.col("_rn") - F.col(f"{tag}_prev")
        log_q = math.log1p(-s.alpha)
        decay = F.exp(gap * log_q)
        have = F.col(s.column).isNotNull()
        plain = gap == 1
        step[f"_la{i}"] = (
            F.when(~have, None).when(gap.isNull(), 0.0).when(plain, F.lit(log_q))
            .otherwise(gap * log_q - F.log(decay + s.alpha))
        )
        share[f"_in{i}"] = (
            F.when(~have, None).when(gap.isNull(), F.col(s.column))
            .when(plain, s.alpha * F.col(s.column))
            .otherwise(F.col(s.column) * s.alpha / (decay + s.alpha))
        )
    rows = rows.withColumns(step | share)

    # log of the decay inside the block, in full and relative to its first value
    rows = rows.withColumns(
        {f"_lp{i}": F.sum(f"_la{i}").over(in_block) for i in range(len(specs))}
        | {f"_l1{i}": F.first(f"_la{i}", ignorenulls=True).over(in_block) for i in range(len(specs))}
    )
    rows = rows.withColumns({
        f"_acc{i}": F.sum(F.col(f"_in{i}") * F.exp(F.col(f"_l1{i}") - F.col(f"_lp{i}"))).over(in_block)
        for i in range(len(specs))
    })
    local = {
        i: F.coalesce(F.col(f"_acc{i}") * F.exp(F.col(f"_lp{i}") - F.col(f"_l1{i}")), F.lit(0.0))
        for i in range(len(specs))
    }
    damp = {i: F.coalesce(F.exp(F.col(f"_lp{i}")), F.lit(1.0)) for i in range(len(specs))}

    # means at the end of each complete block, folded in block order per entity
    ends = (
        rows.filter(F.col("_rn") % size == 0)
        .groupBy(F.col(entity).alias("_e"))
        .agg(F.array_sort(F.collect_list(F.struct(
            "_blk",
            *[local[i].alias(f"v{i}") for i in range(len(specs))],
            *[damp[i].alias(f"d{i}") for i in range(len(specs))],
        ))).alias("_ends"))
        .select("_e", *[
            F.aggregate("_ends", F.array(F.lit(0.0)), _carry(i)).alias(f"_c{i}")
            for i in range(len(specs))
        ])
    )
    joined = rows.join(ends, rows[entity] == ends["_e"], "left")
    return joined.select(*base, *[
        F.when(
            F.col(f"{inputs[s.column]}_seen") >= max(s.min_periods, 1),
            local[i] + damp[i] * F.coalesce(F.get(F.col(f"_c{i}"), F.col("_blk")), F.lit(0.0)),
        ).alias(s.out)
        for i, s in enumerate(specs)
    ])
