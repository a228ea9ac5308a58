"""Calibration error, reliability tables and importance stability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.columns import stack_rows
from tidegate.operators.isotonic import calibrated as with_calibrated, isotonic_blocks
from tidegate.operators.ranks import average_rank, null_safe_join, safe_corr


def with_bin(rows: DataFrame, p: str = "p", bins: int = 10) -> DataFrame:
    """Right-closed equal bins 1..bins; exactly 0 falls in none (bin 0)."""
    edges = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    return rows.withColumn("bin", F.size(F.filter(edges, lambda e: e < F.col(p))))


def reliability(rows: DataFrame, by: Sequence[str] = (), p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """Mean prediction and share of ones per non-empty bin."""
    return with_bin(rows, p, bins).filter(F.col("bin").between(1, bins)).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("share_y"))


def expected_calibration_error(rows: DataFrame, by: Sequence[str] = (), p: str = "p", y: str = "y",
                               bins: int = 10) -> DataFrame:
    """Weighted gap between prediction and outcome; rows in no bin count in n."""
    keys = list(by) or ["_all"]
    if not by:
        rows = rows.withColumn("_all", F.lit(0))
    per_bin = with_bin(rows, p, bins).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mp"), F.avg(y).alias("my"),
        F.sum((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("sq"))
    used = F.col("bin").between(1, bins)
    return per_bin.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        (F.coalesce(F.sum(F.when(used, F.col("n") * F.abs(F.col("my") - F.col("mp")))), F.lit(0.0)) / F.sum("n")).alias("ece"),
        F.sqrt(F.sum("sq") / F.sum("n")).alias("rmse")).drop("_all")


def calibration_report(rows: DataFrame, by: Sequence[str] = ("fold", "model"), raw: str = "raw",
                       calibrated: str = "calibrated", y: str = "y") -> DataFrame:
    """Raw and calibrated error side by side."""
    both = rows.select(*by, y, stack_rows(
        ("kind", "p"), ("raw", F.col(raw)), ("calibrated", F.col(calibrated))))
    return expected_calibration_error(both, [*by, "kind"], "p", y)


def calibration_tables(rows: DataFrame, by: Sequence[str] = ("fold", "model"), raw: str = "raw",
                       calibrated: str = "calibrated", y: str = "y", bins: int = 10) -> DataFrame:
    """Reliability table of raw and calibrated scores with both errors beside it: ``by``, ``kind``, ``bin``, ``n``,
    ``mean_p``, ``share_y``, ``ece``, ``rmse``.

    The error is that of the whole key, the same in all its bins.  Rows without score or label play no part.
    """
    both = rows.select(*by, F.col(y).alias("y"), stack_rows(("kind", "p"), ("raw", F.col(raw)), ("calibrated", F.col(calibrated))))
    both = both.filter(F.col("p").isNotNull() & F.col("y").isNotNull())
    errors = expected_calibration_error(both, [*by, "kind"], bins=bins).drop("n")
    return null_safe_join(reliability(both, [*by, "kind"], bins=bins), errors, [*by, "kind"])


def calibrate_and_report(rows: DataFrame, by: Sequence[str] = ("fold", "model"), score: str = "raw", label: str = "label",
                         day: str = "date", role: str = "role", bins: int = 10) -> DataFrame:
    """Calibrators fitted on the ``cal`` rows of each key, judged on its ``test`` rows: ``calibration_tables`` and ``shared_days``.

    ``shared_days`` counts days on which a key has rows of both roles; a figure with any is not out of sample.
    """
    by = list(by)
    rows = rows.filter(F.col(role).isin("cal", "test"))
    days = rows.groupBy(*by, day).agg(F.count_distinct(role).alias("_roles"))
    shared = days.groupBy(*by).agg(F.count_if(F.col("_roles") > 1).alias("shared_days"))
    steps = isotonic_blocks(rows.filter(F.col(role) == "cal"), by, score, label)
    test = with_calibrated(rows.filter(F.col(role) == "test"), steps, by, score)
    return null_safe_join(calibration_tables(test, by, score, "calibrated", label, bins), shared, by)


def mean_importance(values: DataFrame, top: int | None = None) -> DataFrame:
    """Mean absolute importance per feature over folds, largest first."""
    per_fold = values.groupBy("fold", "feature").agg(F.avg(F.abs("value")).alias("mean_abs"))
    out = per_fold.groupBy("feature").agg(F.avg("mean_abs").alias("mean_across_folds"))
    if top is None:
        return out
    return out.orderBy(F.desc("mean_across_folds"), "feature").limit(top)


def rank_stability(values: DataFrame, value: str = "mean_abs") -> DataFrame:
    """Spearman correlation of feature importance for every pair of folds.

    A fold has one row per feature, so groups are as small as the feature list.
    """
    ranked = average_rank(values.select("fold", "feature", value), ["fold"], value, "rk")
    a = ranked.select("feature", F.col("fold").alias("fold_i"), F.col("rk").alias("ri"))
    b = ranked.select("feature", F.col("fold").alias("fold_j"), F.col("rk").alias("rj"))
    rho = a.join(b, "feature").groupBy("fold_i", "fold_j").agg(
        F.coalesce(safe_corr(F.col("ri"), F.col("rj")), F.lit(0.0)).alias("rho"))
    return rho.withColumn("rho", F.when(F.col("fold_i") == F.col("fold_j"), 1.0).otherwise(F.col("rho")))


def stability_summary(pairs: DataFrame) -> DataFrame:
    s = pairs.filter(F.col("fold_i") != F.col("fold_j")).agg(F.avg("rho").alias("mean_rho"))
    return s.withColumn(
        "label", F.when(F.col("mean_rho") < 0.3, "low").when(F.col("mean_rho") < 0.6, "moderate").otherwise("high"))


def stability_matrix(pairs: DataFrame, folds: Sequence[int]) -> DataFrame:
    return pairs.groupBy("fold_i").pivot("fold_j", list(folds)).agg(F.first("rho"))


def last_folds(values: DataFrame, n: int = 4) -> DataFrame:
    """Rows of the ``n`` highest fold numbers."""
    keep = values.select("fold").distinct().orderBy(F.desc("fold")).limit(n)
    return values.join(keep, "fold", "left_semi")


def histogram(rows: DataFrame, value: str, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Counts in bins of fixed width, labelled by their lower edge.

    Rounding keeps values that sit on an edge up to the last bit in one bin.
    """
    return rows.filter(F.col(value).isNotNull()).groupBy(
        *by, (F.floor(F.round(F.col(value) / width, 9)) * width).alias("bin_low")).agg(F.count(F.lit(1)).alias("n"))
