"""Tests on a series of daily values: plain t, HAC t, bandwidths, power, regimes.

A series holds one value per key and day, so per-key windows stay as short as
the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.columns import ratio
from tidegate.functions.tails import (
    Z_80, Z_90, Z_95, Z_975, normal_cdf, normal_sf, student_sf, student_two_sided,
)
from tidegate.operators.ranks import safe_corr

# Fixed values.
HAC_LAGS = 9
CRITICAL_T = 1.645
ALPHA = 0.05


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if by:
        return df, list(by)
    return df.withColumn("_all", F.lit(0)), ["_all"]


def series_summary(df: DataFrame, by: Sequence[str] = (), value: str = "ic") -> DataFrame:
    """n, mean, sample standard deviation, their ratio and the plain t statistic."""
    df, keys = _keyed(df, by)
    s = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    s = s.withColumn("icir", F.when(F.col("std") > 0, ratio(F.col("mean"), F.col("std"))).otherwise(0.0))
    s = s.withColumn("t_naive", ratio(F.col("mean"), F.greatest(F.col("std") / F.sqrt("n"), F.lit(1e-16))))
    return s.drop("_all")


def with_naive_p(summary: DataFrame) -> DataFrame:
    """One-sided p value (mean > 0) and the verdict at 5 %."""
    p = student_sf(F.col("t_naive"), F.col("n") - 1)
    return summary.withColumn("p_naive", p).withColumn(
        "significant", (F.col("p_naive") < ALPHA) & (F.col("mean") > 0))


def autocovariances(df: DataFrame, by: Sequence[str] = (), value: str = "ic", time: str = "date",
                    lags: int = HAC_LAGS) -> DataFrame:
    """Per series: n, mean, lag-1 correlation and gamma[0..lags] (divided by n)."""
    df, keys = _keyed(df, by)
    rows = df.filter(F.col(value).isNotNull())
    every, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(time)
    rows = rows.withColumns({
        "_e": F.col(value) - F.avg(value).over(every), "_prev": F.lag(value).over(w)})
    rows = rows.withColumns({f"_e{k}": F.lag("_e", k).over(w) for k in range(1, lags + 1)})
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        safe_corr(F.col(value), F.col("_prev")).alias("ar1"),
        F.array(
            F.sum(F.col("_e") * F.col("_e")),
            *[F.coalesce(F.sum(F.col("_e") * F.col(f"_e{k}")), F.lit(0.0)) for k in range(1, lags + 1)],
        ).alias("_g"),
    )
    return out.withColumn("gamma", F.transform("_g", lambda g: g / F.col("n"))).drop("_g", "_all")


def hac_variance(gamma: Column, lags: Column, floor: float) -> Column:
    """Bartlett-weighted long-run variance, bounded below."""
    total = F.aggregate(
        F.sequence(F.lit(1), lags), F.get(gamma, F.lit(0)),
        lambda v, k: v + 2 * (1 - k / (lags + 1)) * F.get(gamma, k),
    )
    return F.greatest(total, F.lit(floor))


def hac_t(lags: int | Column = HAC_LAGS, floor: float = 1e-16) -> Column:
    """t statistic of the mean from the columns of ``autocovariances``."""
    lags = F.lit(lags) if isinstance(lags, int) else lags
    return F.col("mean") / F.sqrt(hac_variance(F.col("gamma"), lags, floor) / F.col("n"))


def hac_test(df: DataFrame, by: Sequence[str] = (), value: str = "ic", time: str = "date",
             lags: int = HAC_LAGS, floor: float = 1e-16, tail: str = "normal") -> DataFrame:
    """HAC t test of a positive mean, one row per series."""
    s = autocovariances(df, by, value, time, lags)
    s = s.withColumns({
        "icir": F.when(F.col("std") > 0, ratio(F.col("mean"), F.col("std"))).otherwise(0.0),
        "t_naive": ratio(F.col("mean"), F.greatest(F.col("std") / F.sqrt("n"), F.lit(1e-16))),
        "t_hac": hac_t(lags, floor),
    })
    p = normal_sf(F.col("t_hac")) if tail == "normal" else student_sf(F.col("t_hac"), F.col("n") - 1)
    return s.withColumn("p_hac", p).drop("gamma")


def condition_a(t: str = "t_hac", mean: str = "mean") -> Column:
    return (F.col(t) > CRITICAL_T) & (F.col(mean) > 0)


def bandwidth_sweep(df: DataFrame, by: Sequence[str] = (), value: str = "ic", time: str = "date",
                    max_lag: int = 20) -> DataFrame:
    """HAC t for every bandwidth; autocovariances are summed once."""
    s = autocovariances(df, by, value, time, max_lag)
    s = s.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(max_lag))))
    return s.withColumn("t_hac", hac_t(F.col("lag"))).select(
        *by, "lag", "t_hac", normal_sf(F.col("t_hac")).alias("p_hac"))


def rule_bandwidth(n: Column) -> Column:
    return F.floor(4 * F.pow(n / 100.0, F.lit(2.0 / 9.0))).cast("long")


def plug_in_bandwidth(rho: Column, n: Column) -> Column:
    strength = 4 * rho * rho / F.pow(1 - rho, F.lit(4.0))
    lag = F.ceil(1.1447 * F.pow(strength * n, F.lit(1.0 / 3.0))).cast("long")
    return F.when(F.abs(rho) < 1e-10, F.lit(1).cast("long")).otherwise(F.greatest(lag, F.lit(1).cast("long")))


def ar1_multiplier(rho: Column, lags: Column | int) -> Column:
    """Long-run over plain variance when autocorrelations are rho^k."""
    lags = F.lit(lags) if isinstance(lags, int) else lags
    return F.aggregate(
        F.sequence(F.lit(1), lags), F.lit(1.0),
        lambda m, k: m + 2 * (1 - k / (lags + 1)) * F.pow(rho, k.cast("double")),
    )


def ar1_lag_table(df: DataFrame, by: Sequence[str] = (), value: str = "ic", time: str = "date",
                  lags: Sequence[int] = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20)) -> DataFrame:
    """Closed-form HAC t of the mean under AR(1) over a list of bandwidths."""
    s = autocovariances(df, by, value, time, 1)
    s = s.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags])))
    variance = F.col("std") * F.col("std") / F.col("n") * ar1_multiplier(F.col("ar1"), F.col("lag"))
    return s.withColumn("var_mean", variance).withColumn("t_ar1", ratio(F.col("mean"), F.sqrt("var_mean"))) \
        .select(*by, "lag", "var_mean", "t_ar1")


def effective_n(n: Column, rho: Column) -> Column:
    return F.when(F.abs(rho) >= 1, n.cast("double")).otherwise(n / (1 + 2 * rho / (1 - rho)))


def power_report(df: DataFrame, by: Sequence[str] = (), value: str = "ic", time: str = "date") -> DataFrame:
    """Effective sample size, bandwidth rules and minimum detectable means."""
    s = autocovariances(df, by, value, time, 1)
    s = s.withColumn("n_eff", effective_n(F.col("n"), F.col("ar1")))
    se = F.col("std") / F.sqrt("n_eff")
    return s.select(
        *by, "n", "mean", "std", "ar1", "n_eff",
        rule_bandwidth(F.col("n")).alias("lag_rule"),
        plug_in_bandwidth(F.col("ar1"), F.col("n")).alias("lag_plug_in"),
        ar1_multiplier(F.col("ar1"), HAC_LAGS).alias("hac_multiplier"),
        ((Z_95 + Z_80) * se).alias("mde_80"), ((Z_95 + Z_90) * se).alias("mde_90"),
        (F.col("mean") - Z_975 * F.col("std") / F.sqrt("n")).alias("ci_low"),
        (F.col("mean") + Z_975 * F.col("std") / F.sqrt("n")).alias("ci_high"),
    )


def power_curve(df: DataFrame, by: Sequence[str] = (), value: str = "ic", time: str = "date",
                top: float = 0.06, points: int = 61) -> DataFrame:
    """Chance to reject at 5 % for a grid of true means."""
    s = autocovariances(df, by, value, time, 1)
    s = s.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    se = F.col("std") / F.sqrt(effective_n(F.col("n"), F.col("ar1")))
    return s.withColumn("true_mean", F.col("_i") * (top / (points - 1))).select(
        *by, "true_mean", normal_cdf(F.col("true_mean") / se - Z_95).alias("power"))


def regime_table(ic: DataFrame, state: DataFrame, *, level: str = "level", value: str = "ic",
                 low: float = 0.333, high: float = 0.667, min_days: int = 10) -> DataFrame:
    """Statistics of the series by terciles of a date-keyed state variable."""
    rows = ic.join(state.select("date", level), "date").dropna(subset=[value, level]).withColumn("_all", F.lit(0))
    cuts = rows.groupBy("_all").agg(
        F.percentile(level, F.lit(low)).alias("_lo"), F.percentile(level, F.lit(high)).alias("_hi"))
    rows = rows.join(cuts, "_all").withColumn(
        "regime", F.when(F.col(level) <= F.col("_lo"), "low").when(F.col(level) <= F.col("_hi"), "mid")
        .otherwise("high"))
    s = rows.groupBy("regime").agg(
        F.avg(level).alias("level_mean"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"), F.stddev_samp(value).alias("_sd"),
    ).filter(F.col("n") >= min_days)
    s = s.withColumns({
        "icir": F.col("mean") / (F.col("std") + 1e-10),
        "t": ratio(F.col("mean"), F.col("_sd") / F.sqrt("n")),
    }).drop("_sd")
    return s.withColumn("p_upper", student_sf(F.col("t"), F.col("n") - 1)).withColumn(
        "gate_open", F.coalesce((F.col("p_upper") < ALPHA) & (F.col("mean") > 0), F.lit(False)))


def loss_difference_test(pairs: DataFrame, by: Sequence[str], a: str, b: str, *, time: str = "date",
                         loss: str = "squared", lags: int = 5, min_days: int = 50) -> DataFrame:
    """Equal-accuracy test of two return series with the small-sample factor.

    ``pairs`` has one row per key and shared day.
    """
    rows = pairs.dropna(subset=[a, b])
    cost = (lambda c: F.col(c) * F.col(c)) if loss == "squared" else (lambda c: F.abs(F.col(c)))
    s = autocovariances(rows.withColumn("_d", cost(a) - cost(b)), by, "_d", time, lags)
    h = lags + 1
    n = F.col("n")
    s = s.filter(n >= min_days).withColumn(
        "dm_stat", hac_t(lags, 1e-12) * F.sqrt((n + 1 - 2 * h + h * lags / n) / n))
    s = s.withColumn("p_value", student_two_sided(F.col("dm_stat"), n - 1))
    sure = F.col("p_value") < ALPHA
    return s.select(
        *by, "n", F.col("mean").alias("mean_loss_diff"), "dm_stat", "p_value",
        # fixed values: the three verdicts
        F.when(sure & (F.col("mean") < 0), "r1 BETTER").when(sure & (F.col("mean") > 0), "r2 BETTER")
        .otherwise("NOT SIG.").alias("result"),
    )


def compare_strategies(returns: DataFrame, anchor: str = "TopK1",
                       extra: Sequence[tuple[str, str]] = (("Random_Top1", "Equal_Weight"),),
                       strategy: str = "strategy", value: str = "net_return", **kw) -> DataFrame:
    """Anchor against every other strategy, plus the named extra pairs."""
    left = returns.select("date", F.col(strategy).alias("strategy_1"), F.col(value).alias("r1"))
    right = returns.select("date", F.col(strategy).alias("strategy_2"), F.col(value).alias("r2"))
    wanted = (F.col("strategy_1") == anchor) & (F.col("strategy_2") != anchor)
    firsts = [anchor]
    for a, b in extra:
        wanted = wanted | ((F.col("strategy_1") == a) & (F.col("strategy_2") == b))
        firsts.append(a)
    pairs = left.filter(F.col("strategy_1").isin(firsts)).join(right, "date").filter(wanted)
    return loss_difference_test(pairs, ["strategy_1", "strategy_2"], "r1", "r2", **kw)


def p_value_audit(stats: DataFrame, t: str = "t", reported: str = "p_reported", tolerance: float = 0.012) -> DataFrame:
    """Recompute tail probabilities from t and flag which one was reported."""
    rows = stats.withColumns({
        "p_upper": normal_sf(F.col(t)), "p_lower": normal_cdf(F.col(t)), "p_two": 2 * normal_sf(F.abs(F.col(t)))})
    return rows.withColumns({
        f"match_{k}": F.abs(F.col(f"p_{k}") - F.col(reported)) < tolerance for k in ("upper", "lower", "two")
    }).withColumn(
        "verdict", F.when(F.col("match_upper"), "upper").when(F.col("match_lower"), "lower")
        .when(F.col("match_two"), "two").when(F.col(t).isNotNull(), "flag"))
