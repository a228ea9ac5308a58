"""Backtests, their experiments, the Sharpe permutation test, regressions and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators import book as bk
from tidegate.operators import inference as inf
from tidegate.operators.ranks import daily_ic
from tidegate.operators.regression import MODELS, factor_regressions, join_factors
from tidegate.operators.resample import (
    drawn_top, null_summary, permutation_sharpes, random_baseline, random_day_returns,
)
from tidegate.plans.base import OOS_SQL, out_of_sample, panel, rounded, sig_sql, significant, sql
from tidegate.plans.registry import query
from tidegate.plans.signals import OOS_IC_SQL, boot_sql, drawn_sql, gate, hac_sql, normal_sf_sql, student_sf_sql
from tidegate.functions.draws import draw_sql, round_keys_sql, shuffled_place_sql
from tidegate.session import materialize

TOP1 = bk.Strategy("TopK1", "topk", 1)
MATRIX = (TOP1, bk.LONG_SHORT, bk.STRATEGIES[0], bk.STRATEGIES[6], bk.STRATEGIES[8])
PERIODS = (("early", "1992-01-01", "1995-12-31"), ("middle", "1996-01-01", "1998-12-31"), ("late", "1998-06-01", "2002-12-31"))
COSTS = (0.0, 5.0, 10.0, 15.0, 20.0, 30.0, 50.0)


def _r(expr: str, digits: int, name: str) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def weights_sql(source: str, strategies: Sequence[bk.Strategy], by: Sequence[str] = (), name: str = "w") -> str:
    """One SELECT per strategy, each by its own definition."""
    keys = "".join(f"{k}, " for k in by)
    part = f"PARTITION BY {keys}date"
    out = []
    for s in strategies:
        head = f"SELECT {keys}'{s.name}' AS strategy, date, ticker, actual_return"
        top = {"topk": ("prob", "true"), "topk_trend": ("prob", "close > SMA_200"), "momentum": ("trailing_return_21d", "true")}
        if s.rule in top:
            score, cond = top[s.rule]
            out.append(f"""{head}, 1.0::DOUBLE / count(*) OVER ({part}) AS w FROM (
                SELECT * FROM {source} WHERE {cond} QUALIFY row_number() OVER ({part} ORDER BY {score} DESC, ticker) <= {s.k})""")
        elif s.rule == "random":
            h = [f"CAST('0x' || substr(md5(concat_ws('|', date, ticker)), {i}, 7) AS BIGINT)" for i in (1, 8)]
            out.append(f"""{head}, 1.0::DOUBLE / count(*) OVER ({part}) AS w FROM (
                SELECT * FROM {source} QUALIFY row_number() OVER ({part} ORDER BY {draw_sql('0', *h)}, ticker) <= {s.k})""")
        elif s.rule == "long_short":
            out.append(f"""{head}, sum(side) AS w FROM (
                SELECT *, 0.5::DOUBLE AS side FROM {source} QUALIFY row_number() OVER ({part} ORDER BY prob DESC, ticker) = 1
                UNION ALL SELECT *, -0.5::DOUBLE FROM {source} QUALIFY row_number() OVER ({part} ORDER BY prob, ticker) = 1)
                GROUP BY {keys}date, ticker, actual_return""")
        else:
            cond = f"prob > {s.threshold}::DOUBLE" if s.rule == "threshold" else "true"
            out.append(f"{head}, 1.0::DOUBLE / count(*) OVER ({part}) AS w FROM (SELECT * FROM {source} WHERE {cond})")
    return f",\n{name} AS (" + " UNION ALL ".join(out) + ")"


def daily_sql(source: str, strategies: Sequence[bk.Strategy], by: Sequence[str] = (), w: str = "w", name: str = "daily") -> str:
    """Previous-day weights by full outer join."""
    keys = "".join(f"{k}, " for k in by)
    on = ", ".join([*by, "strategy", "date", "ticker"])
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    names = ", ".join(f"'{s.name}'" for s in strategies)
    bps = "CASE strategy " + " ".join(f"WHEN '{s.name}' THEN {s.cost_bps}::DOUBLE" for s in strategies) + " END"
    return f""",
cal_{name} AS (SELECT {keys}date, lead(date) OVER ({part} ORDER BY date) AS next_date FROM (SELECT DISTINCT {keys}date FROM {source})),
prev_{name} AS (SELECT {keys}strategy, c.next_date AS date, ticker, w FROM {w} JOIN cal_{name} c USING ({keys}date) WHERE next_date IS NOT NULL),
chg_{name} AS (SELECT {keys}strategy, date, sum(abs(abs(coalesce(a.w, 0)) - abs(coalesce(b.w, 0)))) AS turnover
        FROM {w} a FULL OUTER JOIN prev_{name} b USING ({on}) GROUP BY ALL),
grs_{name} AS (SELECT {keys}strategy, date, sum(w * actual_return) AS gross, count(*) FILTER (w > 0) AS held FROM {w} GROUP BY ALL),
{name} AS (
  SELECT {keys}strategy, date, coalesce(gross, 0) AS gross_return, coalesce(turnover, 0) AS turnover, coalesce(held, 0) AS n_positions,
         coalesce(turnover, 0) * {bps} / 10000 AS cost, coalesce(gross, 0) - coalesce(turnover, 0) * {bps} / 10000 AS net_return
  FROM cal_{name} JOIN (SELECT unnest([{names}]) AS strategy) ON true
  LEFT JOIN chg_{name} USING ({keys}strategy, date) LEFT JOIN grs_{name} USING ({keys}strategy, date))"""


def metrics_sql(by: str, source: str = "daily", name: str = "met") -> str:
    corr = """CASE WHEN stddev_pop(pr) > 0 AND stddev_pop(CASE WHEN pr IS NOT NULL THEN net_return END) > 0
      THEN covar_pop(net_return, pr) / (stddev_pop(pr) * stddev_pop(CASE WHEN pr IS NOT NULL THEN net_return END)) END"""
    return f""",
eq_{name} AS (SELECT *, CASE WHEN min(abs(1 + net_return)) OVER w = 0 THEN 0 ELSE exp(sum(ln(nullif(abs(1 + net_return), 0))) OVER w)
         * CASE WHEN (sum(CASE WHEN 1 + net_return < 0 THEN 1 ELSE 0 END) OVER w) % 2 = 1 THEN -1 ELSE 1 END END AS pv, lag(net_return) OVER w AS pr FROM {source}
       WINDOW w AS (PARTITION BY {by} ORDER BY date)),
dd_{name} AS (SELECT *, pv / max(pv) OVER (PARTITION BY {by} ORDER BY date) - 1 AS dd FROM eq_{name}),
m0_{name} AS (
  SELECT {by}, count(*) AS n_days, arg_max(pv, date) AS last_pv, arg_max(pv, date) - 1 AS total_return, count(*) FILTER (turnover > 0.001::DOUBLE) AS n_trades,
         avg(turnover) AS avg_turnover, avg(n_positions) AS avg_positions, stddev_samp(net_return) * sqrt(252) AS annual_vol,
         avg(net_return) / stddev_samp(net_return) AS sr, coalesce(stddev_samp(net_return) FILTER (net_return < 0) * sqrt(252), 0) AS down,
         min(dd) AS max_drawdown, coalesce({corr}, 0) AS rho, count(*) FILTER (net_return > 0) / count(*)::DOUBLE AS win_rate,
         coalesce(avg(net_return) FILTER (net_return > 0), 0) AS avg_win, coalesce(avg(net_return) FILTER (net_return < 0), 0) AS avg_loss,
         sum(cost) AS total_cost, avg(cost) AS avg_daily_cost, sum(cost) / (count(*) / 252.0::DOUBLE) AS cost_drag_annual
  FROM dd_{name} GROUP BY {by}),
m1_{name} AS (SELECT *, CASE WHEN last_pv >= 0 THEN pow(last_pv, 252.0::DOUBLE / n_days) - 1 END AS annual_return,
       sqrt(greatest(0, (1 + 0.5::DOUBLE * sr * sr - rho * sr * sr + rho * rho * sr * sr) / n_days)) * sqrt(252) AS se FROM m0_{name}),
{name} AS (SELECT *, annual_return / annual_vol AS sharpe_ratio, CASE WHEN down > 0 THEN annual_return / down ELSE 0 END AS sortino_ratio,
       CASE WHEN max_drawdown < 0 THEN annual_return / abs(max_drawdown) ELSE 0 END AS calmar_ratio,
       abs(avg_win / nullif(avg_loss, 0)) AS win_loss_ratio FROM m1_{name})"""


METRICS = ("total_return", "annual_return", "avg_turnover", "avg_positions", "annual_vol", "sharpe_ratio", "sortino_ratio",
           "max_drawdown", "calmar_ratio", "win_rate", "avg_win", "avg_loss", "total_cost", "avg_daily_cost", "cost_drag_annual")


def metric_columns(extra: bool = True) -> str:
    cols = [sig_sql(c, c) for c in METRICS]
    if extra:
        cols += [sig_sql("sharpe_ratio - 1.96::DOUBLE * se", "sharpe_ci_lower"), sig_sql("sharpe_ratio + 1.96::DOUBLE * se", "sharpe_ci_upper"),
                 sig_sql("sharpe_ratio / se", "sharpe_tstat"), _r(normal_sf_sql("(sharpe_ratio / se)"), 6, "sharpe_pvalue"),
                 f"({normal_sf_sql('(sharpe_ratio / se)')}) < 0.05 AS sharpe_significant",
                 sig_sql("coalesce(win_loss_ratio, 0)", "win_loss_ratio")]
    return ", ".join(cols)


@query("weights", sql(OOS_SQL + weights_sql("oos", [*bk.STRATEGIES, bk.LONG_SHORT]), f"""
SELECT strategy, date, ticker, {_r('w', 8, 'w')} FROM w"""))
def q_weights(spark, sf):
    w = bk.weights(out_of_sample(spark, sf), [*bk.STRATEGIES, bk.LONG_SHORT])
    w = w.groupBy("strategy", "date", "ticker").agg(F.sum("w").alias("w"))
    return rounded(w, 8)


@query("backtest_daily", sql(OOS_SQL + weights_sql("oos", [*bk.STRATEGIES, bk.LONG_SHORT]) + daily_sql("oos", [*bk.STRATEGIES, bk.LONG_SHORT]), f"""
SELECT strategy, date, {_r('gross_return', 8, 'gross_return')}, {_r('turnover', 8, 'turnover')}, n_positions,
       {_r('cost', 8, 'cost')}, {_r('net_return', 8, 'net_return')} FROM daily"""))
def backtest_daily(spark, sf):
    return rounded(bk.backtest(out_of_sample(spark, sf), [*bk.STRATEGIES, bk.LONG_SHORT]), 8)


def benchmark_ret(p: DataFrame) -> DataFrame:
    """Equally weighted mean holding return of a panel as the buy-and-hold series."""
    return p.groupBy("date").agg(F.avg("actual_return").alias("ret"))


@query("backtest_strategies", sql(OOS_IC_SQL + weights_sql("oos", bk.STRATEGIES) + daily_sql("oos", bk.STRATEGIES) + """,
bh AS (SELECT 'BuyHold' AS strategy, date, avg(actual_return) AS r FROM oos GROUP BY date),
every AS (SELECT * FROM daily UNION ALL SELECT strategy, date, r, 0, 1, 0, r FROM bh)""" + metrics_sql("strategy", "every") + f""",
i AS (SELECT avg(ic) AS mi, stddev_samp(ic) AS si, count(*) AS n, avg(ic) / (stddev_samp(ic) / sqrt(count(*))) AS t FROM ic)""", f"""
SELECT strategy, n_days, n_trades, {metric_columns()},
       CASE WHEN strategy <> 'BuyHold' THEN CAST(printf('%.8e', mi) AS DOUBLE) END AS mean_ic, CASE WHEN strategy <> 'BuyHold' THEN CAST(printf('%.8e', mi / si) AS DOUBLE) END AS icir,
       CASE WHEN strategy <> 'BuyHold' THEN ({student_sf_sql('t', '(n - 1)')}) < 0.05 AND mi > 0 END AS ic_significant
FROM met, i"""))
def backtest_strategies(spark, sf):
    """All strategies and the benchmark with the full metrics row, best Sharpe first."""
    p = panel(spark, sf)
    rows = out_of_sample(spark, sf, p)
    daily = bk.backtest(rows).unionByName(bk.benchmark_book(benchmark_ret(p), rows))
    m = bk.with_ic_fields(bk.performance(daily), daily_ic(rows, "prob", "actual_return"))
    p = F.round("sharpe_pvalue", 6) + 0.0
    return significant(m).withColumn("sharpe_pvalue", p).orderBy(F.desc("sharpe_ratio"), "strategy")


@query("backtest_equity", sql(OOS_SQL + weights_sql("oos", [TOP1]) + daily_sql("oos", [TOP1]) + metrics_sql("strategy"), f"""
SELECT strategy, date, {sig_sql('pv', 'portfolio_value')}, {_r('dd', 6, 'drawdown')} FROM dd_met"""))
def backtest_equity(spark, sf):
    d = bk.equity_curve(bk.backtest(out_of_sample(spark, sf), [TOP1]))
    return rounded(significant(d.select("strategy", "date", "portfolio_value", "drawdown"), 9), 6, "portfolio_value")


@query("backtest_record", sql(OOS_IC_SQL + weights_sql("oos", MATRIX) + daily_sql("oos", MATRIX) + metrics_sql("strategy") + """,
ics AS (SELECT date, any_value(ic) AS ic FROM ic GROUP BY date)""", f"""
SELECT strategy, date, {_r('gross_return', 8, 'gross_return')}, {_r('cost', 8, 'cost')}, {_r('net_return', 8, 'net_return')},
       {_r('turnover', 8, 'turnover')}, n_positions, {sig_sql('pv', 'portfolio_value')}, {_r('ic', 8, 'ic')}
FROM dd_met LEFT JOIN ics USING (date)"""))
def backtest_record(spark, sf):
    """Daily record with the book's value and the day's rank correlation."""
    d = bk.daily_record(out_of_sample(spark, sf), MATRIX)
    value = significant(d.select("strategy", "date", "portfolio_value"))
    return rounded(d.drop("portfolio_value"), 8).join(value, ["strategy", "date"])


SUBS = (TOP1, bk.STRATEGIES[0], bk.STRATEGIES[5], bk.STRATEGIES[6], bk.STRATEGIES[8])
SUB_SQL = OOS_SQL + """,
per(sub_period, lo, hi) AS (VALUES """ + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in PERIODS) + """),
subs AS (SELECT o.*, sub_period FROM oos o JOIN per ON date BETWEEN lo AND hi)"""


@query("backtest_subperiods", sql(
    SUB_SQL + weights_sql("subs", SUBS, ["sub_period"]) + daily_sql("subs", SUBS, ["sub_period"]) + """,
bench AS (SELECT date, avg(actual_return) AS r FROM panel GROUP BY date),
every AS (SELECT sub_period, strategy, date, gross_return, turnover, n_positions, cost, net_return FROM daily
          UNION ALL SELECT sub_period, 'BuyHold', date, r, 0, 1, 0, r FROM (SELECT DISTINCT sub_period, date FROM subs) JOIN bench USING (date))"""
    + metrics_sql("strategy, sub_period", "every"), f"""
SELECT strategy, sub_period, n_days, {sig_sql('annual_return', 'annual_return')}, {sig_sql('sharpe_ratio', 'sharpe_ratio')},
       {sig_sql('max_drawdown', 'max_drawdown')}, {sig_sql('total_cost', 'total_cost')} FROM met"""))
def backtest_subperiods(spark, sf):
    """Named date ranges, two of them overlapping, and the benchmark in each; each starts from an empty book."""
    p = panel(spark, sf)
    m = bk.subperiods(out_of_sample(spark, sf, p), SUBS, PERIODS, benchmark_ret(p))
    return significant(m.select("strategy", "sub_period", "n_days", "annual_return", "sharpe_ratio", "max_drawdown", "total_cost"))


COST_SQL = OOS_SQL + weights_sql("oos", [TOP1]) + daily_sql("oos", [TOP1]) + f""",
lev AS (SELECT unnest([{', '.join(f'{c}::DOUBLE' for c in COSTS)}]) AS cost_bps),
levd AS (SELECT strategy, cost_bps, date, gross_return, turnover, n_positions, turnover * cost_bps / 10000 AS cost,
                gross_return - turnover * cost_bps / 10000 AS net_return FROM daily, lev)""" + metrics_sql("strategy, cost_bps", "levd")


def cost_curve(spark: SparkSession, sf: str) -> DataFrame:
    return bk.cost_sensitivity(out_of_sample(spark, sf), TOP1, COSTS)


@query("cost_sensitivity", sql(COST_SQL, f"SELECT strategy, cost_bps, n_days, n_trades, {metric_columns(False)} FROM met"))
def cost_sensitivity(spark, sf):
    return significant(cost_curve(spark, sf).select("strategy", "cost_bps", "n_days", "n_trades", *METRICS))


@query("break_even", sql(COST_SQL + """,
x AS (SELECT strategy, cost_bps AS c2, sharpe_ratio AS s2, lag(cost_bps) OVER w AS c1, lag(sharpe_ratio) OVER w AS s1
      FROM met WINDOW w AS (PARTITION BY strategy ORDER BY cost_bps)),
h AS (SELECT strategy, min(c2) AS at FROM x WHERE s2 <= 0 GROUP BY strategy)""", f"""
SELECT m.strategy, {_r('CASE WHEN x.c1 IS NOT NULL THEN c1 - s1 * (c2 - c1) / (s2 - s1) END', 6, 'break_even_bps')},
       CASE WHEN h.at IS NULL THEN 'above_last' WHEN h.at = m.first THEN 'below_first' ELSE 'crossing' END AS status
FROM (SELECT strategy, min(cost_bps) AS first FROM met GROUP BY strategy) m
LEFT JOIN h USING (strategy) LEFT JOIN x ON x.strategy = h.strategy AND x.c2 = h.at"""))
def break_even(spark, sf):
    return rounded(bk.break_even(cost_curve(spark, sf)))


@query("cost_extrapolation", sql(COST_SQL + """,
e AS (SELECT a.strategy, a.sharpe_ratio AS s0, (b.sharpe_ratio - a.sharpe_ratio) / 5 AS ss, a.annual_return AS r0,
             (b.annual_return - a.annual_return) / 5 AS rs FROM met a JOIN met b ON a.strategy = b.strategy AND a.cost_bps = 0 AND b.cost_bps = 5),
g AS (SELECT unnest([0, 5, 10, 15, 20, 25, 30])::DOUBLE AS cost_bps)""", f"""
SELECT strategy, cost_bps, {sig_sql('ss', 'sharpe_per_bp')}, {sig_sql('rs', 'return_per_bp')},
       {sig_sql('s0 + ss * cost_bps', 'sharpe_line')}, {sig_sql('r0 + rs * cost_bps', 'return_line')} FROM e, g"""))
def cost_extrapolation(spark, sf):
    return significant(bk.cost_extrapolation(cost_curve(spark, sf)))


KS = tuple(bk.Strategy(f"TopK{k}", "topk", k) for k in (1, 2, 3))


@query("k_sensitivity", sql(OOS_SQL + weights_sql("oos", KS) + daily_sql("oos", KS) + metrics_sql("strategy"), f"""
SELECT strategy, n_days, n_trades, {metric_columns(False)} FROM met"""))
def k_sensitivity(spark, sf):
    m = bk.performance(bk.backtest(out_of_sample(spark, sf), KS))
    return significant(m.select("strategy", "n_days", "n_trades", *METRICS))


@query("return_matrix", sql(OOS_SQL + weights_sql("oos", MATRIX) + daily_sql("oos", MATRIX), f"""
SELECT date, {', '.join(_r(f"max(CASE WHEN strategy = '{s.name}' THEN net_return END)", 8, s.name) for s in MATRIX)}
FROM daily GROUP BY date"""))
def return_matrix(spark, sf):
    return rounded(bk.return_matrix(out_of_sample(spark, sf), MATRIX), 8)


def places_sql(reps: int) -> str:
    """Days times replicates with the keys of each shuffle, and a day's names numbered in alphabetical order."""
    h1, h2 = (f"CAST('0x' || substr(md5(CAST(date AS VARCHAR)), {i}, 7) AS BIGINT)" for i in (1, 8))
    return f""",
named AS (SELECT date, ticker, actual_return, row_number() OVER (PARTITION BY date ORDER BY ticker) - 1 AS i FROM oos),
sized AS (SELECT date, count(*) AS n, {h1} AS h1, {h2} AS h2 FROM oos GROUP BY date),
drawn_days AS (SELECT rep, date, n, {draw_sql('rep', 'h1', 'h2')} AS key FROM sized, (SELECT unnest(range(1, {reps} + 1)) AS rep)),
keyed_days AS (SELECT rep, date, n, {round_keys_sql('key')} AS keys FROM drawn_days)"""


def random_picks_sql(reps: int) -> str:
    return places_sql(reps) + f""",
first_place AS (SELECT rep, date, {shuffled_place_sql('0', 'n', 'keys')} AS i FROM keyed_days),
picks AS (SELECT rep, date, ticker, actual_return FROM first_place JOIN named USING (date, i))"""


@query("random_day_returns", sql(OOS_SQL + random_picks_sql(50), f"""
SELECT date, {_r('avg(actual_return - 5 / 10000.0::DOUBLE)', 8, 'net_return')} FROM picks GROUP BY date"""))
def q_random_day_returns(spark, sf):
    return rounded(random_day_returns(out_of_sample(spark, sf), 50), 8)


REP_SQL = """,
rw AS (SELECT rep, date, ticker, actual_return, lag(ticker) OVER (PARTITION BY rep ORDER BY date) AS pt FROM picks),
repd AS (SELECT rep, date, actual_return AS gross_return, 1 AS n_positions,
                CASE WHEN pt IS NULL THEN 1.0::DOUBLE WHEN pt = ticker THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END AS turnover FROM rw),
repn AS (SELECT *, turnover * 5.0::DOUBLE / 10000 AS cost, gross_return - turnover * 5.0::DOUBLE / 10000 AS net_return FROM repd)"""


@query("random_baseline", sql(OOS_SQL + drawn_sql(100) + """,
picks AS (SELECT * FROM drawn WHERE pos = 1)""" + REP_SQL + metrics_sql("rep", "repn"), f"""
SELECT {', '.join(sig_sql(f'avg({c})', c) for c in (*METRICS, 'n_trades'))} FROM met"""))
def q_random_baseline(spark, sf):
    """Numeric metrics averaged over 100 random single-name books."""
    return significant(random_baseline(out_of_sample(spark, sf), 100).select(*METRICS, "n_trades"))


PERM_SQL = OOS_SQL + drawn_sql(1000) + """,
picks AS (SELECT * FROM shuffled QUALIFY row_number() OVER (PARTITION BY rep, date ORDER BY prob DESC, ticker) = 1)""" + REP_SQL \
    + metrics_sql("rep", "repn")


def permutation_null(spark: SparkSession, sf: str, reps: int = 1000) -> DataFrame:
    return permutation_sharpes(out_of_sample(spark, sf), reps, top=drawn_top)


@query("perm_sharpe_null", sql(PERM_SQL, f"SELECT rep, {sig_sql('sharpe_ratio', 'null_sharpe')} FROM met"))
def perm_sharpe_null(spark, sf):
    """Null Sharpe ratios of the top-1 book, 1,000 within-day shuffles of the score."""
    return significant(permutation_null(spark, sf))


@query("perm_sharpe", sql(
    PERM_SQL + weights_sql("oos", [TOP1]) + daily_sql("oos", [TOP1]) + metrics_sql("strategy", "daily", "obs") + """,
z AS (SELECT met.sharpe_ratio AS x, obs.sharpe_ratio AS o FROM met, obs)""", f"""
SELECT {sig_sql('max(o)', 'observed')}, count(*) AS n_reps, {sig_sql('avg(x)', 'null_mean')}, {sig_sql('quantile_cont(x, 0.95::DOUBLE)', 'null_95th')},
       {_r('avg(CASE WHEN x >= o THEN 1.0::DOUBLE ELSE 0 END)', 6, 'p_value')},
       {_r('(count(*) FILTER (x < o) + count(*) FILTER (x <= o) + CASE WHEN bool_or(x = o) THEN 1 ELSE 0 END) * 50.0::DOUBLE / count(*)', 6, 'percentile_rank')},
       avg(CASE WHEN x >= o THEN 1.0::DOUBLE ELSE 0 END) < 0.05 AS significant FROM z"""))
def perm_sharpe(spark, sf):
    """Permutation test of the top-1 Sharpe ratio."""
    rows = out_of_sample(spark, sf)
    observed = bk.performance(bk.backtest(rows, [TOP1])).select(F.col("sharpe_ratio").alias("observed"))
    return significant(null_summary(permutation_sharpes(rows, 1000, top=drawn_top), observed, "null_sharpe"))


TOP2 = bk.Strategy("TopK2", "topk", 2)


@query("perm_sharpe_top2", sql(OOS_SQL + drawn_sql(1000) + """,
pk AS (SELECT * FROM shuffled QUALIFY row_number() OVER (PARTITION BY rep, date ORDER BY prob DESC, ticker) <= 2),
w AS (SELECT rep, 'null' AS strategy, date, ticker, actual_return, 1.0::DOUBLE / count(*) OVER (PARTITION BY rep, date) AS w FROM pk),
src AS (SELECT DISTINCT rep, date FROM pk)""" + daily_sql("src", [bk.Strategy("null", "topk")], ["rep"]) + metrics_sql("rep"), f"""
SELECT rep, {sig_sql('sharpe_ratio', 'null_sharpe')} FROM met"""))
def perm_sharpe_top2(spark, sf):
    return significant(permutation_sharpes(out_of_sample(spark, sf), 1000, k=2, top=drawn_top))


@query("gated_backtest", sql(OOS_IC_SQL + hac_sql("fold") + boot_sql("fold", 1000, 1) + weights_sql("oos", [TOP1], (), "w0") + """,
gates AS (SELECT fold, any_value(t_hac) > 1.645 AND any_value(mean) > 0 AND avg(CASE WHEN null_mean >= mean THEN 1.0::DOUBLE ELSE 0 END) < 0.05 AS open
          FROM boot JOIN hac USING (fold) GROUP BY fold),
w AS (SELECT w0.* FROM w0 JOIN (SELECT DISTINCT date, fold FROM oos) USING (date)
      WHERE fold IN (SELECT fold FROM gates WHERE open))""" + daily_sql("oos", [TOP1]), f"""
SELECT date, {_r('net_return', 8, 'net_return')}, n_positions, {_r('turnover', 8, 'turnover')} FROM daily"""))
def gated_backtest(spark, sf):
    """Books held only in folds whose gate is open: robust t and resampled null of the daily correlations."""
    rows = out_of_sample(spark, sf)
    ic = materialize(daily_ic(rows, "prob", "actual_return", by=["fold", "date"]))
    decisions = gate(ic, ["fold"], block=1).select("fold", "gate_open")
    days = rows.select("fold", "date").distinct().withColumn("role", F.lit("test"))
    d = bk.gated_backtest(rows, [TOP1], decisions, days)
    return rounded(d.select("date", "net_return", "n_positions", "turnover"), 8)


# ---------------------------------------------------------------- comparisons and regressions

DM = bk.STRATEGIES


@query("dm_tests", sql(OOS_SQL + weights_sql("oos", DM) + daily_sql("oos", DM) + """,
pr AS (SELECT a.strategy AS strategy_1, b.strategy AS strategy_2, date, a.net_return * a.net_return - b.net_return * b.net_return AS d
       FROM daily a JOIN daily b USING (date)
       WHERE (a.strategy = 'TopK1' AND b.strategy <> 'TopK1') OR (a.strategy = 'Random_Top1' AND b.strategy = 'Equal_Weight'))"""
    + hac_sql("strategy_1, strategy_2", 5, "1e-12", "pr", "d") + """,
q AS (SELECT *, t_hac * sqrt((n + 1 - 12 + 30.0::DOUBLE / n) / n) AS dm FROM hac WHERE n >= 50),
p AS (SELECT *, 2 * (""" + student_sf_sql("abs(dm)", "(n - 1)") + """) AS p FROM q)""", f"""
SELECT strategy_1, strategy_2, n, {_r('mean', 8, 'mean_loss_diff')}, {_r('dm', 6, 'dm_stat')}, {_r('p', 6, 'p_value')},
       CASE WHEN p < 0.05 AND mean < 0 THEN 'r1 BETTER' WHEN p < 0.05 AND mean > 0 THEN 'r2 BETTER' ELSE 'NOT SIG.' END AS result FROM p"""))
def dm_tests(spark, sf):
    returns = materialize(bk.backtest(out_of_sample(spark, sf), DM).select("strategy", "date", "net_return"))
    return rounded(inf.compare_strategies(returns), {"mean_loss_diff": 8})




def factors(p: DataFrame) -> DataFrame:
    """Factor table from a panel: market, return spreads of name groups, momentum."""
    last = F.substring("ticker", -1, 1).cast("int")
    mean = lambda cond: F.avg(F.when(cond, F.col("actual_return")))
    five = p.groupBy("date").agg(
        (F.avg("actual_return") - 0.0001).alias("Mkt_RF"),
        (mean(last == 1) - mean(last == 2)).alias("SMB"), (mean(last == 3) - mean(last == 4)).alias("HML"),
        (mean(last == 5) - mean(last == 1)).alias("RMW"), (mean(last == 2) - mean(last == 3)).alias("CMA"),
        F.lit(0.0001).alias("RF"))
    mom = p.groupBy("date").agg(
        (mean(F.col("trailing_return_21d") > 0) - mean(F.col("trailing_return_21d") <= 0)).alias("Mom"))
    return materialize(join_factors(five, mom))


_LAST = "CAST(right(ticker, 1) AS INTEGER)"
FACTORS_SQL = f""",
fac AS (SELECT date, avg(actual_return) - 0.0001::DOUBLE AS Mkt_RF, 0.0001::DOUBLE AS RF,
  avg(actual_return) FILTER ({_LAST} = 1) - avg(actual_return) FILTER ({_LAST} = 2) AS SMB,
  avg(actual_return) FILTER ({_LAST} = 3) - avg(actual_return) FILTER ({_LAST} = 4) AS HML,
  avg(actual_return) FILTER ({_LAST} = 5) - avg(actual_return) FILTER ({_LAST} = 1) AS RMW,
  avg(actual_return) FILTER ({_LAST} = 2) - avg(actual_return) FILTER ({_LAST} = 3) AS CMA,
  avg(actual_return) FILTER (trailing_return_21d > 0) - avg(actual_return) FILTER (trailing_return_21d <= 0) AS Mom
  FROM panel GROUP BY date)"""


@query("factor_table", sql(OOS_SQL + FACTORS_SQL, "SELECT date, " + ", ".join(
    _r(c, 8, c) for c in ("Mkt_RF", "SMB", "HML", "RMW", "CMA", "RF", "Mom")) + " FROM fac"))
def factor_table(spark, sf):
    return rounded(factors(panel(spark, sf)), 8)


REG = (*(s for s in MATRIX if s.rule != "equal_weight"), bk.STRATEGIES[7])  # equal weights are the market factor itself


def book_returns(spark: SparkSession, sf: str, p: DataFrame) -> DataFrame:
    return materialize(bk.backtest(out_of_sample(spark, sf, p), REG).select("strategy", "date", "net_return"))


@query("factor_regression_capm", sql(OOS_SQL + weights_sql("oos", REG) + daily_sql("oos", REG) + FACTORS_SQL + """,
xy AS (SELECT strategy, date, net_return - RF AS y, Mkt_RF AS x FROM daily JOIN fac USING (date)
       WHERE Mkt_RF + SMB + HML + RMW + CMA + Mom IS NOT NULL),
c AS (SELECT strategy, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, count(*) AS n,
             sum(x) AS sx, sum(x * x) AS sxx FROM xy GROUP BY strategy),
e AS (SELECT strategy, y - a - b * x AS e, x, row_number() OVER (PARTITION BY strategy ORDER BY date) AS rn FROM xy JOIN c USING (strategy)),
g AS (SELECT p.strategy, k, CASE WHEN k = 0 THEN 1 ELSE (1 - k / 6.0::DOUBLE) END AS wk,
             sum(p.e * q.e) AS m00, sum(p.e * q.e * q.x) AS m01, sum(p.e * p.x * q.e) AS m10, sum(p.e * p.x * q.e * q.x) AS m11
      FROM e p JOIN (SELECT unnest(range(0, 6)) AS k) ON true JOIN e q ON q.strategy = p.strategy AND q.rn = p.rn - k GROUP BY ALL),
m AS (SELECT strategy, sum(CASE WHEN k = 0 THEN m00 ELSE wk * 2 * m00 END) AS s00, sum(CASE WHEN k = 0 THEN m01 ELSE wk * (m01 + m10) END) AS s01,
             sum(CASE WHEN k = 0 THEN m11 ELSE wk * 2 * m11 END) AS s11 FROM g GROUP BY strategy),
v AS (SELECT c.*, n * sxx - sx * sx AS det, s00, s01, s11 FROM c JOIN m USING (strategy)),
t AS (SELECT strategy, n, a, b, 1 - (1 - r2) * (n - 1) / (n - 2) AS r2_adj,
             sqrt((sxx * (sxx * s00 - sx * s01) - sx * (sxx * s01 - sx * s11))) / det AS sa,
             sqrt((-sx * (-sx * s00 + n * s01) + n * (-sx * s01 + n * s11))) / det AS sb FROM v),
r AS (SELECT strategy, 'const' AS term, n, r2_adj, a AS coef, a / sa AS t, a * 252 AS annual FROM t
      UNION ALL SELECT strategy, 'Mkt_RF', n, r2_adj, b, b / sb, NULL FROM t),
z AS (SELECT *, 2 * (""" + normal_sf_sql("abs(t)") + """) AS p FROM r)""", f"""
SELECT strategy, 'CAPM' AS model, term, n, {_r('r2_adj', 6, 'r2_adj')}, {_r('coef', 8, 'coef')}, {_r('t', 5, 't')}, {_r('p', 6, 'p')},
       {_r('annual', 6, 'annual')}, CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' ELSE '' END AS stars FROM z"""))
def factor_regression_capm(spark, sf):
    p = panel(spark, sf)
    out = factor_regressions(book_returns(spark, sf, p), factors(p), models={"CAPM": ("Mkt_RF",)})
    return rounded(out.drop("se"), {"coef": 8, "t": 5})


def regression_sql(models: dict[str, Sequence[str]], lags: int = 5) -> str:
    """Normal equations of each model by Gauss-Jordan steps on lists of p (p + 1) numbers, and the HAC sandwich."""
    out = []
    wide = max(map(len, models.values())) + 1
    rows = " UNION ALL ".join(
        f"SELECT strategy, '{m}' AS model, {len(fs) + 1} AS p, date, net_return - RF AS y, "
        f"[1.0::DOUBLE, {', '.join(fs)}] AS x, ['const', {', '.join(repr(f) for f in fs)}] AS terms FROM daily JOIN fac USING (date) "
        "WHERE net_return IS NOT NULL AND Mkt_RF + SMB + HML + RMW + CMA + Mom + RF IS NOT NULL" for m, fs in models.items())
    out.append(f"""
xs AS ({rows}),
cells AS (SELECT strategy, model, p, i, j, sum(x[i] * CASE WHEN j <= p THEN x[j] ELSE CASE WHEN j = 2 * p + 1 THEN y END END) AS v
          FROM xs, unnest(range(1, p + 1)) AS a(i), unnest([k for k in range(1, 2 * p + 2) if k <= p or k = 2 * p + 1]) AS b(j) GROUP BY ALL),
every AS (SELECT strategy, model, p, i, j, v FROM cells
          UNION ALL SELECT strategy, model, p, i, p + k, CASE WHEN i = k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
          FROM (SELECT DISTINCT strategy, model, p, i FROM cells), unnest(range(1, p + 1)) AS c(k)),
step0 AS (SELECT strategy, model, p, list(v ORDER BY i, j) AS a FROM every GROUP BY ALL)""")
    for k in range(wide):
        at = lambda i, j: f"a[({i}) * (2 * p + 1) + ({j}) + 1]"
        i, j, d = "(q // (2 * p + 1))", "(q % (2 * p + 1))", at(k, k)
        out.append(f"""
step{k + 1} AS (SELECT strategy, model, p, CASE WHEN {k} >= p THEN a ELSE list_transform(range(0, p * (2 * p + 1)), lambda q:
          CASE WHEN {i} = {k} THEN {at(k, j)} / {d} ELSE {at(i, j)} - {at(i, k)} * {at(k, j)} / {d} END) END AS a FROM step{k})""")
    out.append(f"""
solved AS (SELECT strategy, model, p, [a[i * (2 * p + 1) + 2 * p + 1] for i in range(0, p)] AS b,
           [[a[i * (2 * p + 1) + p + j + 1] for j in range(0, p)] for i in range(0, p)] AS inv FROM step{wide}),
errs AS (SELECT xs.strategy, xs.model, xs.p, date, y, x, terms, y - list_sum([x[i] * b[i] for i in range(1, xs.p + 1)]) AS e,
                row_number() OVER (PARTITION BY xs.strategy, xs.model ORDER BY date) AS rn FROM xs JOIN solved USING (strategy, model)),
lagged AS (SELECT u.strategy, u.model, u.p, i, j, sum(CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE (1 - k / ({lags} + 1.0::DOUBLE)) END
               * (u.e * u.x[i] * w.e * w.x[j] + CASE WHEN k > 0 THEN u.e * u.x[j] * w.e * w.x[i] ELSE 0 END)) AS m
          FROM errs u JOIN (SELECT unnest(range(0, {lags} + 1)) AS k) ON true
          JOIN errs w ON w.strategy = u.strategy AND w.model = u.model AND w.rn = u.rn - k,
          unnest(range(1, u.p + 1)) AS a(i), unnest(range(1, u.p + 1)) AS b(j) GROUP BY ALL),
varied AS (SELECT strategy, model, t, sum(inv[t][i] * m * inv[j][t]) AS v
           FROM lagged JOIN solved USING (strategy, model), unnest(range(1, solved.p + 1)) AS a(t) GROUP BY ALL),
sums AS (SELECT strategy, model, p, count(*) AS n, sum(e * e) AS ssr, var_pop(y) * count(*) AS sst, any_value(terms) AS terms
         FROM errs GROUP BY ALL),
reg AS (SELECT strategy, model, terms[t] AS term, n, 1 - (1 - (1 - ssr / sst)) * (n - 1) / (n - sums.p) AS r2_adj, b[t] AS coef,
               b[t] / sqrt(v) AS t FROM varied JOIN solved USING (strategy, model) JOIN sums USING (strategy, model)),
regp AS (SELECT *, 2 * (""" + normal_sf_sql("abs(t)") + """) AS p FROM reg)""")
    return ",".join(out)


@query("factor_regression", sql(OOS_SQL + weights_sql("oos", REG) + daily_sql("oos", REG) + FACTORS_SQL + "," + regression_sql(MODELS), f"""
SELECT strategy, model, term, n, {_r('r2_adj', 6, 'r2_adj')}, {_r('coef', 8, 'coef')}, {_r('t', 5, 't')}, {_r('p', 6, 'p')},
       {_r("CASE WHEN term = 'const' THEN coef * 252 END", 6, 'annual')},
       CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' ELSE '' END AS stars FROM regp"""))
def factor_regression(spark, sf):
    """All books under all four factor models."""
    p = panel(spark, sf)
    return rounded(factor_regressions(book_returns(spark, sf, p), factors(p)).drop("se"), {"coef": 8, "t": 5})
