"""Portfolio weights, turnover, returns and performance.

Strategies, periods, cost levels and replicates are key columns, so any number
of books runs in one job.  A prediction panel has the columns ``date, ticker,
prob, close, SMA_200, trailing_return_21d, actual_return`` plus book keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.functions.columns import ratio, stack_rows
from tidegate.functions.draws import draw, key_high, key_low
from tidegate.functions.tails import Z_975, normal_sf, student_sf
from tidegate.operators.ranks import daily_ic, safe_corr

YEAR = 252.0
COST_BPS = 5.0


class Strategy(NamedTuple):
    name: str
    rule: str
    k: int = 1
    threshold: float = 0.5
    cost_bps: float = COST_BPS


# The ten books and their parameters.
STRATEGIES = (
    Strategy("Baseline_P50", "threshold", threshold=0.50),
    Strategy("Threshold_P60", "threshold", threshold=0.60),
    Strategy("TopK1", "topk", k=1),
    Strategy("TopK2", "topk", k=2),
    Strategy("TopK3", "topk", k=3),
    Strategy("TopK1_Trend", "topk_trend", k=1),
    Strategy("Random_Top1", "random", k=1),
    Strategy("Momentum_Top1", "momentum", k=1),
    Strategy("Equal_Weight", "equal_weight"),
)
LONG_SHORT = Strategy("TopK1_LongShort", "long_short", k=1)

# Named inclusive date ranges of the sub-period report.
PERIODS = (
    ("Period 1 - ZIRP Bull", "2015-10-16", "2018-12-31"),
    ("Period 2 - COVID/Growth", "2019-01-01", "2021-12-31"),
    ("Period 3 - Rate Shock", "2022-01-01", "2024-12-31"),
)

# Score by which a rule ranks; rows with a NULL score are not eligible.
RANK_SCORES = {
    "topk": lambda: F.col("prob"),
    "topk_trend": lambda: F.when(F.col("close") > F.col("SMA_200"), F.col("prob")),
    "momentum": lambda: F.col("trailing_return_21d"),
    "random": lambda: -draw(F.lit(0), key_high("date", "ticker"), key_low("date", "ticker")).cast("double"),
    "long": lambda: F.col("prob"),
    "short": lambda: -F.col("prob"),
}
SET_FILTERS = {
    "threshold": lambda s: F.col("prob") > s.threshold,
    "equal_weight": lambda s: F.lit(True),
}


def strategies_frame(spark: SparkSession, strategies: Sequence[Strategy] = STRATEGIES) -> DataFrame:
    return spark.createDataFrame(
        [tuple(s) for s in strategies],
        "strategy string, rule string, k int, threshold double, cost_bps double")


def _ranked_weights(panel: DataFrame, strategies: Sequence[Strategy], by: list[str]) -> DataFrame:
    """Top-k books: one ranking per distinct rule, cut to k before the shuffle."""
    legs = []
    for s in strategies:
        if s.rule == "long_short":
            legs += [(s.name, "long", s.k, 0.5), (s.name, "short", s.k, -0.5)]
        else:
            legs.append((s.name, s.rule, s.k, 1.0))
    rules = sorted({leg[1] for leg in legs})
    deepest = max(leg[2] for leg in legs)
    scored = panel.select(
        *by, "date", "ticker", "actual_return",
        stack_rows(("rule", "score"), *[(r, RANK_SCORES[r]().cast("double")) for r in rules]),
    ).filter(F.col("score").isNotNull())
    order = Window.partitionBy(*by, "rule", "date").orderBy(F.desc("score"), "ticker")
    top = scored.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= deepest)
    picks = top.withColumn("leg", F.explode(F.array(*[
        F.struct(F.lit(n).alias("strategy"), F.lit(r).alias("r"), F.lit(k).alias("k"), F.lit(side).alias("side"))
        for n, r, k, side in legs]))).filter((F.col("leg.r") == F.col("rule")) & (F.col("rn") <= F.col("leg.k")))
    # at most k rows per book, leg and day
    members = F.count(F.lit(1)).over(Window.partitionBy(*by, "leg.strategy", "rule", "date"))
    return picks.select(
        *by, F.col("leg.strategy").alias("strategy"), "date", "ticker",
        (F.col("leg.side") / members).alias("w"), "actual_return")


def _set_weights(panel: DataFrame, strategies: Sequence[Strategy], by: list[str]) -> DataFrame:
    """Equal weights over all rows that pass a filter, however many."""
    rows = panel.select(
        *by, "date", "ticker", "actual_return",
        F.explode(F.array_compact(F.array(*[
            F.when(SET_FILTERS[s.rule](s), F.lit(s.name)) for s in strategies]))).alias("strategy"))
    sizes = rows.groupBy(*by, "strategy", "date").agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(sizes, [*by, "strategy", "date"]).select(
        *by, "strategy", "date", "ticker", (F.lit(1.0) / F.col("_n")).alias("w"), "actual_return")


def weights(panel: DataFrame, strategies: Sequence[Strategy] = STRATEGIES, by: Sequence[str] = ()) -> DataFrame:
    """(keys, strategy, date, ticker, w, actual_return); no row means weight 0.

    Ties in a ranking go to the first name in alphabetical order.
    """
    by = list(by)
    sets = [s for s in strategies if s.rule in SET_FILTERS]
    ranked = [s for s in strategies if s.rule not in SET_FILTERS]
    parts = []
    if ranked:
        parts.append(_ranked_weights(panel, ranked, by))
    if sets:
        parts.append(_set_weights(panel, sets, by))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def calendar(panel: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct days per key with the following day."""
    by = list(by)
    days = panel.select(*by, "date").distinct()
    keys = by or [F.lit(0)]
    return days.withColumn("next_date", F.lead("date").over(Window.partitionBy(*keys).orderBy("date")))


def daily_book(w: DataFrame, days: DataFrame, strategies: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Gross return, turnover and positions per book and day.

    Each weight counts for its own day and against the following one; the sum
    per name and day is its change, so a name that leaves or skips a day is
    handled like any other.  The first day is built up from zero.  Long and
    short exposure count by size.
    """
    by = list(by)
    keys = [*by, "strategy"]
    flows = w.join(days, [*by, "date"]).select(
        *keys, "ticker",
        stack_rows(
            ("date", "dw", "wr", "held"),
            (F.col("date"), F.abs("w"), F.col("w") * F.col("actual_return"), (F.col("w") > 0).cast("long")),
            (F.col("next_date"), -F.abs("w"), F.lit(None).cast("double"), F.lit(0).cast("long")),
        ),
    ).filter(F.col("date").isNotNull())
    per_name = flows.groupBy(*keys, "date", "ticker").agg(
        F.abs(F.sum("dw")).alias("dw"), F.sum("wr").alias("wr"), F.sum("held").alias("held"))
    per_day = per_name.groupBy(*keys, "date").agg(
        F.sum("wr").alias("gross_return"), F.sum("dw").alias("turnover"), F.sum("held").alias("n_positions"))
    every = days.select(*by, "date", F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy"))
    return every.join(per_day, [*keys, "date"], "left").select(
        *keys, "date", *[F.coalesce(c, F.lit(0).cast(t)).alias(c) for c, t in (
            ("gross_return", "double"), ("turnover", "double"), ("n_positions", "long"))])


def charge(daily: DataFrame, bps: Column | float) -> DataFrame:
    """Cost and net return; ``bps`` per unit of weight traded, one way."""
    bps = F.lit(float(bps)) if isinstance(bps, (int, float)) else bps
    d = daily.withColumn("cost", F.col("turnover") * bps / 10000.0)
    return d.withColumn("net_return", F.col("gross_return") - F.col("cost"))


def charge_by_strategy(daily: DataFrame, strategies: Sequence[Strategy] = STRATEGIES) -> DataFrame:
    expr = F.lit(None).cast("double")
    for s in strategies:
        expr = F.when(F.col("strategy") == s.name, F.lit(float(s.cost_bps))).otherwise(expr)
    return charge(daily, expr)


def charge_levels(daily: DataFrame, levels: Sequence[float]) -> DataFrame:
    """Every cost level as a key; gross return and turnover are computed once."""
    d = daily.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    return charge(d, F.col("cost_bps"))


def backtest(panel: DataFrame, strategies: Sequence[Strategy] = STRATEGIES, by: Sequence[str] = ()) -> DataFrame:
    """Daily record per book at each strategy's own cost."""
    w = weights(panel, strategies, by)
    d = daily_book(w, calendar(panel, by), [s.name for s in strategies], by)
    return charge_by_strategy(d, strategies)


def daily_record(panel: DataFrame, strategies: Sequence[Strategy] = STRATEGIES, score: str = "prob",
                 realised: str = "actual_return") -> DataFrame:
    """Daily record per book with its value and the day's rank correlation of score and return."""
    ic = daily_ic(panel, score, realised).select("date", "ic")
    return equity_curve(backtest(panel, strategies)).drop("drawdown").join(ic, "date", "left")


def benchmark_book(returns: DataFrame, panel: DataFrame, name: str = "BuyHold", ret: str = "ret",
                   by: Sequence[str] = ()) -> DataFrame:
    """Buy-and-hold record on the panel's days (of each key): no cost, no turnover."""
    days = panel.select(*by, "date").distinct()
    return returns.join(days, "date").select(
        *by, F.lit(name).alias("strategy"), "date", F.col(ret).alias("gross_return"), F.lit(0.0).alias("turnover"),
        F.lit(1).cast("long").alias("n_positions"), F.lit(0.0).alias("cost"), F.col(ret).alias("net_return"))


def compound(x: Column, window) -> Column:
    """Running product of 1 + x, through logs with the sign kept apart."""
    f = 1 + x
    zero = F.max((f == 0).cast("int")).over(window)
    negative = F.sum((f < 0).cast("int")).over(window)
    size = F.exp(F.sum(F.log(F.when(f != 0, F.abs(f)))).over(window))
    return F.when(zero == 1, 0.0).otherwise(F.when(negative % 2 == 1, -1.0).otherwise(1.0) * F.coalesce(size, F.lit(1.0)))


def equity_curve(daily: DataFrame, by: Sequence[str] = ("strategy",)) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = daily.withColumn("portfolio_value", compound(F.col("net_return"), w))
    return d.withColumn("drawdown", ratio(F.col("portfolio_value"), F.max("portfolio_value").over(w)) - 1)


def performance(daily: DataFrame, by: Sequence[str] = ("strategy",)) -> DataFrame:
    """One metrics row per book."""
    by = list(by)
    d = equity_curve(daily, by).withColumn(
        "_prev", F.lag("net_return").over(Window.partitionBy(*by).orderBy("date")))
    r, turn = F.col("net_return"), F.col("turnover")
    s = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.max_by("portfolio_value", "date").alias("_last"),
        F.sum((turn > 0.001).cast("long")).alias("n_trades"),
        F.avg(turn).alias("avg_turnover"), F.avg("n_positions").alias("avg_positions"),
        F.avg(r).alias("_mean"), F.stddev_samp(r).alias("_sd"),
        F.stddev_samp(F.when(r < 0, r)).alias("_down"),
        F.min("drawdown").alias("max_drawdown"), safe_corr(r, F.col("_prev")).alias("_rho"),
        F.sum((r > 0).cast("long")).alias("_wins"),
        F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(r < 0, r)), F.lit(0.0)).alias("avg_loss"),
        F.sum("cost").alias("total_cost"), F.avg("cost").alias("avg_daily_cost"),
    )
    n = F.col("n_days")
    year = math.sqrt(YEAR)
    s = s.withColumns({
        "total_return": F.col("_last") - 1,
        "annual_return": F.when(F.col("_last") >= 0, F.pow("_last", YEAR / n) - 1),
        "annual_vol": F.col("_sd") * year,
        "_down": F.coalesce(F.col("_down") * year, F.lit(0.0)),
        "_sr": F.when(F.col("_sd") > 0, F.col("_mean") / F.when(F.col("_sd") > 0, F.col("_sd"))).otherwise(0.0),
        "_rho": F.when(n > 2, F.col("_rho")).otherwise(0.0),
        "win_rate": F.col("_wins") / n,
        "win_loss_ratio": F.coalesce(F.abs(ratio(F.col("avg_win"), F.col("avg_loss"))), F.lit(0.0)),
        "cost_drag_annual": F.col("total_cost") / (n / YEAR),
    })

    def guarded(den: str) -> Column:
        return F.when(F.col(den) > 0, F.col("annual_return") / F.when(F.col(den) > 0, F.col(den))).otherwise(0.0)

    sr2 = F.col("_sr") * F.col("_sr")
    s = s.withColumns({
        "sharpe_ratio": guarded("annual_vol"), "sortino_ratio": guarded("_down"),
        "calmar_ratio": F.when(F.col("max_drawdown") < 0, F.try_divide("annual_return", F.abs(F.col("max_drawdown"))))
        .otherwise(0.0),
        "_se": F.sqrt(F.greatest(
            F.lit(0.0), (1 + 0.5 * sr2 - F.col("_rho") * sr2 + F.col("_rho") * F.col("_rho") * sr2) / n)) * year,
    })
    s = s.withColumns({
        "sharpe_ci_lower": F.col("sharpe_ratio") - Z_975 * F.col("_se"),
        "sharpe_ci_upper": F.col("sharpe_ratio") + Z_975 * F.col("_se"),
        "sharpe_tstat": F.coalesce(ratio(F.col("sharpe_ratio"), F.col("_se")), F.lit(0.0)),
    }).withColumn("sharpe_pvalue", normal_sf(F.col("sharpe_tstat")))
    return s.withColumn("sharpe_significant", F.col("sharpe_pvalue") < 0.05).select(
        *by, "total_return", "annual_return", "n_days", "n_trades", "avg_turnover", "avg_positions", "annual_vol",
        "sharpe_ratio", "sortino_ratio", "max_drawdown", "calmar_ratio", "sharpe_ci_lower", "sharpe_ci_upper",
        "sharpe_tstat", "sharpe_pvalue", "sharpe_significant", "win_rate", "avg_win", "avg_loss", "win_loss_ratio",
        "total_cost", "avg_daily_cost", "cost_drag_annual")


def with_ic_fields(metrics: DataFrame, ic: DataFrame, benchmark: str = "BuyHold") -> DataFrame:
    """Add mean_ic, icir and ic_significant; NULL for the benchmark."""
    s = ic.groupBy(F.lit(0).alias("_all")).agg(
        F.count("ic").alias("_n"), F.avg("ic").alias("_m"), F.stddev_samp("ic").alias("_s"))
    s = s.withColumn("_p", student_sf(ratio(F.col("_m"), F.col("_s") / F.sqrt("_n")), F.col("_n") - 1))
    real = F.col("strategy") != benchmark
    return metrics.withColumn("_all", F.lit(0)).join(s, "_all").withColumns({
        "mean_ic": F.when(real, F.col("_m")),
        "icir": F.when(real, F.when(F.col("_s") > 0, ratio(F.col("_m"), F.col("_s"))).otherwise(0.0)),
        "ic_significant": F.when(real, (F.col("_p") < 0.05) & (F.col("_m") > 0)),
    }).drop("_all", "_n", "_m", "_s", "_p")


def in_periods(panel: DataFrame, periods: Sequence[tuple[str, str, str]] = PERIODS) -> DataFrame:
    """Tag rows with every named inclusive date range they fall in."""
    tags = F.array_compact(F.array(*[
        F.when(F.col("date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), F.lit(n))
        for n, lo, hi in periods]))
    return panel.withColumn("sub_period", F.explode(tags))


def subperiods(panel: DataFrame, strategies: Sequence[Strategy], periods=PERIODS, benchmark: DataFrame | None = None) -> DataFrame:
    """Metrics per period; each period starts from an empty book.

    ``benchmark`` is (date, ret); with it each period has a row of the book that buys and holds.
    """
    rows = in_periods(panel, periods)
    daily = backtest(rows, strategies, ["sub_period"])
    if benchmark is not None:
        daily = daily.unionByName(benchmark_book(benchmark, rows, by=["sub_period"]))
    return performance(daily, ["strategy", "sub_period"])


def cost_sensitivity(panel: DataFrame, strategy: Strategy, levels: Sequence[float]) -> DataFrame:
    w = weights(panel, [strategy])
    daily = daily_book(w, calendar(panel), [strategy.name])
    return performance(charge_levels(daily, levels), ["strategy", "cost_bps"])


def break_even(curve: DataFrame, by: Sequence[str] = ("strategy",)) -> DataFrame:
    """Cost at which the Sharpe ratio crosses zero, by linear interpolation."""
    w = Window.partitionBy(*by).orderBy("cost_bps")
    rows = curve.withColumns({
        "_c1": F.lag("cost_bps").over(w), "_s1": F.lag("sharpe_ratio").over(w),
        "_hit": F.col("sharpe_ratio") <= 0})
    point = F.col("_c1") + ratio(
        (0 - F.col("_s1")) * (F.col("cost_bps") - F.col("_c1")), F.col("sharpe_ratio") - F.col("_s1"))
    s = rows.groupBy(*by).agg(
        F.min(F.when(F.col("_hit"), F.col("cost_bps"))).alias("_at"),
        F.min_by(point, F.when(F.col("_hit"), F.col("cost_bps"))).alias("break_even_bps"),
        F.min("cost_bps").alias("_first"), F.max("cost_bps").alias("last_bps"))
    return s.select(
        *by, "break_even_bps",
        F.when(F.col("_at").isNull(), "above_last").when(F.col("_at") == F.col("_first"), "below_first")
        .otherwise("crossing").alias("status"))


def cost_extrapolation(curve: DataFrame, low: float = 0.0, high: float = 5.0, top: int = 30, step: int = 5,
                       by: Sequence[str] = ("strategy",)) -> DataFrame:
    """Sharpe and return along the line through two cost levels."""
    at = lambda c, x: F.max(F.when(F.col("cost_bps") == x, F.col(c)))
    s = curve.groupBy(*by).agg(
        at("sharpe_ratio", low).alias("s0"), at("sharpe_ratio", high).alias("s1"),
        at("annual_return", low).alias("r0"), at("annual_return", high).alias("r1"))
    s = s.withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in range(0, top + 1, step)])))
    slope = lambda a, b: (F.col(b) - F.col(a)) / (high - low)
    return s.select(
        *by, "cost_bps", slope("s0", "s1").alias("sharpe_per_bp"), slope("r0", "r1").alias("return_per_bp"),
        (F.col("s0") + slope("s0", "s1") * (F.col("cost_bps") - low)).alias("sharpe_line"),
        (F.col("r0") + slope("r0", "r1") * (F.col("cost_bps") - low)).alias("return_line"))


def return_matrix(panel: DataFrame, strategies: Sequence[Strategy], cost_bps: float = COST_BPS) -> DataFrame:
    """Daily net returns, one column per strategy."""
    names = [s.name for s in strategies]
    daily = charge(daily_book(weights(panel, strategies), calendar(panel), names), cost_bps)
    return daily.groupBy("date").pivot("strategy", names).agg(F.first("net_return"))


def gate_weights(w: DataFrame, decisions: DataFrame, dates: DataFrame) -> DataFrame:
    """Zero the weights on days of folds whose gate is closed.

    ``decisions`` is (fold, gate_open); ``dates`` maps test days to folds.
    """
    open_days = dates.filter(F.col("role") == "test").join(
        decisions.filter(F.col("gate_open")).select("fold"), "fold", "left_semi").select("date").distinct()
    return w.join(open_days, "date", "left_semi")


def gated_backtest(panel: DataFrame, strategies: Sequence[Strategy], decisions: DataFrame, dates: DataFrame) -> DataFrame:
    """Daily record when books are held only while the fold's gate is open."""
    w = gate_weights(weights(panel, strategies), decisions, dates)
    return charge_by_strategy(daily_book(w, calendar(panel), [s.name for s in strategies]), strategies)
