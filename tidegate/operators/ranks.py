"""Cross-sectional ranks and the daily rank correlation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.columns import stack_rows

SPLIT_ROWS = 1_000_000
_EDGES = [i / 256 for i in range(1, 256)]


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation, NULL when either side is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def average_rank(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Rank from 1 with ties sharing their mean, for groups of bounded size."""
    w = Window.partitionBy(*by)
    return df.withColumn(
        out,
        F.rank().over(w.orderBy(value))
        + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2,
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of one name where NULL equals NULL; the left side's keys stay."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return left.join(renamed, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]), how).drop(
        *[f"_r_{k}" for k in keys])


def rank_table(values: DataFrame, by: Sequence[str], value: str, out: str,
               split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(by, value, rank): the average rank of each distinct value, for groups of any size.

    Equal values are counted first, so a value shared by many rows is one row.
    The distinct values of a large group are cut into ranges at approximate
    quantiles; ranks are counted inside a range and shifted by the size of the
    ranges below.  Where the cuts fall changes the balance, never the result.
    NULL keys are a group like any other, and a NULL value is the smallest.
    """
    by = list(by)
    counts = values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    cuts = counts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_d"),
        F.percentile_approx(value, F.lit(_EDGES), F.lit(1000)).alias("_cut"),
    ).filter(F.col("_d") > split_rows).drop("_d")
    ranged = null_safe_join(counts, cuts, by, "left").withColumn(
        "_range",
        F.when(F.col("_cut").isNotNull() & F.col(value).isNotNull(),
               F.size(F.filter("_cut", lambda e: e < F.col(value)))).otherwise(0),
    ).drop("_cut")
    below = (
        ranged.groupBy(*by, "_range").agg(F.sum("_c").alias("_n"))
        .withColumn("_below", F.sum("_n").over(
            Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
        .filter(F.col("_below").isNotNull()).drop("_n")
    )
    inside = F.sum("_c").over(
        Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return (
        null_safe_join(ranged.withColumn("_upto", inside), below, [*by, "_range"], "left")
        .select(*by, value, (F.coalesce("_below", F.lit(0)) + F.col("_upto") - (F.col("_c") - 1) / 2).alias(out))
    )


def rank_columns(rows: DataFrame, by: Sequence[str], columns: dict[str, str],
                 split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Average ranks of several columns at once: ``{value column: rank column}``.

    One way for every size and source: distinct values are ranked, large groups in
    ranges, and the ranks are joined back to the rows.
    """
    long = rows.select(*by, stack_rows(("_of", "_x"), *[(c, F.col(c)) for c in columns]))
    table = rank_table(long, [*by, "_of"], "_x", "_rank", split_rows)
    for value, rank in columns.items():
        mine = table.filter(F.col("_of") == value).select(
            *by, F.col("_x").alias(value), F.col("_rank").alias(rank))
        rows = null_safe_join(rows, mine, [*by, value])
    return rows


def daily_ic(
    panel: DataFrame,
    score: str,
    realised: str,
    *,
    by: Sequence[str] = ("date",),
    min_names: int = 1,
    on_degenerate: str = "zero",
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Spearman correlation of score and realised return per cross-section.

    ``on_degenerate`` says what a constant side gives: ``zero`` or ``skip``.
    Rows without a score or a return are left out; a NULL key is a cross-section.
    """
    if on_degenerate not in ("zero", "skip"):
        raise ValueError("on_degenerate is 'zero' or 'skip'")
    by = list(by)
    rows = panel.select(*by, F.col(score).cast("double").alias("_s"), F.col(realised).cast("double").alias("_r")) \
        .filter(F.col("_s").isNotNull() & F.col("_r").isNotNull())
    rows = rank_columns(rows, by, {"_s": "_rs", "_r": "_rr"}, split_rows)
    stats = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("_s").alias("_vs"), F.var_pop("_r").alias("_vr"),
        safe_corr(F.col("_rs"), F.col("_rr")).alias("_rho"),
    ).filter(F.col("n") >= min_names)
    if on_degenerate == "skip":
        return stats.filter(F.col("_rho").isNotNull()).select(*by, F.col("_rho").alias("ic"), "n")
    flat = (F.col("_vs") < 1e-12) | (F.col("_vr") < 1e-12)
    return stats.select(*by, F.when(flat, 0.0).otherwise(F.coalesce("_rho", F.lit(0.0))).alias("ic"), "n")
