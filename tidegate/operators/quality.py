"""Data-quality measures and audits as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.columns import change, ratio, series
from tidegate.operators.features import FEATURES, with_target


def quality_by_entity(bars: DataFrame, *, entity: str = "ticker", time: str = "date",
                      jump: float = 0.20) -> DataFrame:
    """Missing, stale, outlier and zero-volume counts per entity."""
    w = series(entity, time)
    c, back1, back2 = F.col("close"), F.lag("close", 1).over(w), F.lag("close", 2).over(w)
    rows = bars.withColumns({
        "_stale": (c == back1) & (c == back2), "_jump": F.abs(F.log(ratio(c, back1))) > jump})

    def hits(cond: Column) -> Column:
        return F.sum(F.coalesce(cond, F.lit(False)).cast("long"))

    return rows.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_rows"), hits(c.isNull()).alias("missing_close"),
        hits(F.col("volume").isNull()).alias("missing_volume"), hits(F.col("_stale")).alias("stale"),
        hits(F.col("_jump")).alias("outliers"), hits(F.col("volume") == 0).alias("zero_volume"),
        F.min("close").alias("min_close"))


def universe_screen(bars: DataFrame, *, min_rows: int = 1800, entity: str = "ticker") -> DataFrame:
    """Entities with enough rows and only positive closes."""
    return bars.groupBy(entity).agg(
        F.count("close").alias("n_rows"), F.min("close").alias("min_close"),
    ).filter((F.col("n_rows") >= min_rows) & (F.col("min_close") > 0))


def select_entities(bars: DataFrame, wanted: DataFrame, entity: str = "ticker") -> DataFrame:
    return bars.join(wanted.select(entity).distinct(), entity, "left_semi")


def missing_entities(bars: DataFrame, wanted: DataFrame, entity: str = "ticker") -> DataFrame:
    return wanted.select(entity).distinct().join(bars.select(entity).distinct(), entity, "left_anti")


def in_range(bars: DataFrame, start: str | None = None, end: str | None = None, time: str = "date") -> DataFrame:
    """Rows with ``start <= date <= end``; reaches the scan as a pushed filter."""
    if start is not None:
        bars = bars.filter(F.col(time) >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.filter(F.col(time) <= F.lit(end).cast("date"))
    return bars


def without_entity(bars: DataFrame, name: str, entity: str = "ticker") -> DataFrame:
    return bars.filter(F.col(entity) != name)


def reconcile_sources(a: DataFrame, b: DataFrame, *, entity: str = "ticker", time: str = "date",
                      period: str = "quarter", tolerance: float = 0.0005) -> DataFrame:
    """Last close of each period in two sources and their relative difference."""
    def closing(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy(entity, F.to_date(F.date_trunc(period, F.col(time))).alias("period")).agg(
            F.max_by("close", time).alias(out))

    both = closing(a, "close_a").join(closing(b, "close_b"), [entity, "period"])
    return both.withColumn("rel_diff", F.abs(ratio(F.col("close_a"), F.col("close_b")) - 1)).withColumn(
        "agrees", F.col("rel_diff") <= tolerance)


def integrity_audit(panel: DataFrame, bars: DataFrame, warm: DataFrame | None = None,
                    features: Sequence[str] = FEATURES) -> DataFrame:
    """(check_name, passed, detail) rows for a feature panel built from ``bars``.

    ``warm`` is the feature panel before warm-up rows are dropped.
    """
    one = lambda name, ok, detail: F.struct(
        F.lit(name).alias("check_name"), F.coalesce(ok, F.lit(False)).alias("passed"), detail.cast("double").alias("detail"))
    have = [c for c in features if c in panel.columns]
    present = len(have)
    nulls = sum((F.col(c).isNull().cast("long") for c in have), F.lit(0).cast("long"))
    gap = F.abs(F.col("return_1d") - change("close", series("ticker", "date"), 1))
    expected = with_target(bars.select("ticker", "date", "close")).select(
        "ticker", "date", F.col("target").alias("_want"))
    rows = panel.select(
        "ticker", "date", "target", nulls.alias("_nulls"), gap.alias("_gap"), "price_to_SMA200",
    ).join(expected, ["ticker", "date"], "left")
    agree = F.coalesce(F.abs(F.col("target") - F.col("_want")) <= 1e-6, F.lit(False))
    total = rows.groupBy("ticker", "date").agg(
        F.count(F.lit(1)).alias("c"), F.sum("_nulls").alias("nulls"), F.max("_gap").alias("gap"),
        F.sum((~F.col("target").isin(0.0, 1.0)).cast("long")).alias("odd"),
        F.sum((~agree).cast("long")).alias("off"), F.min("price_to_SMA200").alias("low"),
    ).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("c") - 1).alias("dup"), F.sum("nulls").alias("nulls"),
        F.max("gap").alias("gap"), F.sum("odd").alias("odd"), F.sum("off").alias("off"), F.min("low").alias("low"))
    out = total.select(F.inline(F.array(
        one("no_null_features", F.col("nulls") == 0, F.col("nulls")),
        one("feature_count", F.lit(present == 49), F.lit(present)),
        one("target_recomputed", F.col("off") == 0, F.col("off")),
        one("unique_keys", F.col("dup") == 0, F.col("dup")),
        one("has_rows", F.col("n") > 0, F.col("n")),
        one("target_binary", F.col("odd") == 0, F.col("odd")),
        one("return_is_backward", F.col("gap") <= 1e-8, F.col("gap")),
        one("ratio_positive", F.col("low") > 0, F.col("low")),
    )))
    if warm is not None:
        lead = warm.groupBy("ticker").agg(
            F.sum(F.col("SMA_200").isNull().cast("long")).alias("k"), F.count(F.lit(1)).alias("c")).agg(
            F.sum((F.col("k") != F.least(F.lit(199), F.col("c"))).cast("long")).alias("bad"))
        out = out.unionByName(lead.select(F.inline(F.array(
            one("sma200_warmup_199", F.col("bad") == 0, F.col("bad"))))))
    return out


def prediction_audit(predictions: DataFrame, required: Sequence[str] = ("prob", "close", "target", "actual_return")) -> DataFrame:
    """Nulls per required column and duplicate keys of a prediction panel."""
    s = predictions.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in required])
    rows = s.unpivot([], list(required), "check_name", "n_bad")
    dup = predictions.groupBy("date", "ticker").agg(F.count(F.lit(1)).alias("c")).agg(
        F.lit("duplicate_keys").alias("check_name"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_bad"))
    return rows.unionByName(dup).withColumn("passed", F.col("n_bad") == 0)
