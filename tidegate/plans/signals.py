"""Folds, rank correlations, tests, the gate, bootstraps and permutations of the signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.functions.columns import change, ratio, series, stack_rows
from tidegate.functions.draws import draw_sql
from tidegate.operators import folds as fo
from tidegate.operators import inference as inf
from tidegate.operators.quality import universe_screen
from tidegate.operators.ranks import daily_ic
from tidegate.operators.resample import centred_bootstrap, moving_block_interval, null_summary, permuted_ic
from tidegate.plans.base import BARS_SQL, FOLDS_SQL, OOS_SQL, bars, folds, out_of_sample, panel, rounded, sql
from tidegate.plans.registry import query
from tidegate.session import materialize

FEATURES4 = ("prob", "close", "SMA_200", "trailing_return_21d")


def _r(expr: str, digits: int, name: str) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def normal_sf_sql(z: str) -> str:
    terms = f"""list_sum(list_transform(range(0, 200), lambda k:
        exp((2*k+1) * ln(greatest(abs({z}), 1e-300)) - lgamma(2*k+2) + k * ln(2) + lgamma(k+1))))"""
    return (f"CASE WHEN {z} IS NULL THEN NULL WHEN {z} > 8 THEN 0.0::DOUBLE WHEN {z} < -8 THEN 1.0::DOUBLE "
            f"ELSE 0.5::DOUBLE - sign({z}) * exp(-({z})*({z})/2) / sqrt(2*pi()) * {terms} END")


def student_sf_sql(t: str, v: str) -> str:
    """Simpson's rule on the density."""
    dens = f"pow(1 + u*u/({v}), -(({v})+1)/2.0::DOUBLE)"
    nodes = (f"list_transform(range(0, 801), lambda i: CASE WHEN i = 0 OR i = 800 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END "
             f"* {dens.replace('u*u', f'(abs({t})*i/800.0::DOUBLE)*(abs({t})*i/800.0::DOUBLE)')})")
    const = f"exp(lgamma((({v})+1)/2.0::DOUBLE) - lgamma(({v})/2.0::DOUBLE)) / sqrt(({v})*pi())"
    return (f"CASE WHEN {t} IS NULL THEN NULL WHEN {t} > 12 THEN 0.0::DOUBLE WHEN {t} < -12 THEN 1.0::DOUBLE "
            f"ELSE 0.5::DOUBLE - sign({t}) * {const} * abs({t}) / 2400.0::DOUBLE * list_sum({nodes}) END")


CORR = """CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0
     THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END"""


def ic_sql(source: str, by: str = "date", score: str = "prob", ret: str = "actual_return", having: int = 1,
           skip: bool = False, name: str = "ic") -> str:
    rho = CORR.format(a="rs", b="rr")
    value = rho if skip else (
        f"CASE WHEN var_pop(s) < 1e-12 OR var_pop(r) < 1e-12 THEN 0.0::DOUBLE ELSE coalesce({rho}, 0.0::DOUBLE) END")
    return f""",
rk_{name} AS (
  SELECT {by}, {score} AS s, {ret} AS r,
         rank() OVER (PARTITION BY {by} ORDER BY {score}) + (count(*) OVER (PARTITION BY {by}, {score}) - 1) / 2.0::DOUBLE AS rs,
         rank() OVER (PARTITION BY {by} ORDER BY {ret}) + (count(*) OVER (PARTITION BY {by}, {ret}) - 1) / 2.0::DOUBLE AS rr
  FROM {source} WHERE {score} IS NOT NULL AND {ret} IS NOT NULL),
{name} AS (SELECT * FROM (SELECT {by}, count(*) AS n, {value} AS ic FROM rk_{name} GROUP BY {by} HAVING count(*) >= {having})
     WHERE ic IS NOT NULL)"""


def hac_sql(by: str, lags: int = 9, floor: str = "1e-16", source: str = "ic", value: str = "ic", name: str = "hac") -> str:
    """Autocovariances by self-join; one row per key with V and t."""
    return f""",
ser_{name} AS (
  SELECT {by}, date, {value} AS x, row_number() OVER w AS rn, lag({value}) OVER w AS prev,
         {value} - avg({value}) OVER (PARTITION BY {by}) AS e, count(*) OVER (PARTITION BY {by}) AS n
  FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY date)),
gam_{name} AS (
  SELECT {', '.join('a.' + c.strip() for c in by.split(','))}, k.k, sum(a.e * b.e) / max(a.n) AS g
  FROM ser_{name} a JOIN (SELECT unnest(range(0, {lags} + 1)) AS k) k ON true
  JOIN ser_{name} b ON {' AND '.join(f'a.{c.strip()} = b.{c.strip()}' for c in by.split(','))} AND b.rn = a.rn - k.k
  GROUP BY ALL),
v_{name} AS (SELECT {by}, greatest(sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / ({lags} + 1.0::DOUBLE)) * g END), {floor}::DOUBLE) AS v
      FROM gam_{name} GROUP BY {by}),
sm_{name} AS (SELECT {by}, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS std, stddev_pop(x) AS std_pop,
             {CORR.format(a='CASE WHEN prev IS NOT NULL THEN x END', b='prev')} AS ar1
      FROM ser_{name} GROUP BY {by}),
{name} AS (SELECT s.*, v, mean / sqrt(v / n) AS t_hac, mean / (std / sqrt(n)) AS t_naive, mean / std AS icir
        FROM sm_{name} s JOIN v_{name} USING ({by}))"""


def boot_sql(by: str, reps: int, block: int, source: str = "ic", name: str = "boot") -> str:
    """Means of centred blocks drawn with replacement."""
    u = draw_sql("rep", "j", "j * 7919")
    return f""",
n_{name} AS (
  SELECT {by}, ic - avg(ic) OVER (PARTITION BY {by}) AS e, row_number() OVER (PARTITION BY {by} ORDER BY date) - 1 AS i,
         count(*) OVER (PARTITION BY {by}) AS n FROM {source}),
b_{name} AS (SELECT {by}, i // {block} AS i, avg(e) AS e FROM n_{name} WHERE i < (n // {block}) * {block} GROUP BY ALL),
d_{name} AS (
  SELECT {by}, rep, {u} % nb AS i
  FROM (SELECT {by}, nb, rep, unnest(range(1, nb + 1)) AS j
        FROM (SELECT {by}, count(*) AS nb FROM b_{name} GROUP BY {by}), (SELECT unnest(range(1, {reps} + 1)) AS rep))),
{name} AS (SELECT {by}, rep, avg(e) AS null_mean FROM d_{name} JOIN b_{name} USING ({by}, i) GROUP BY {by}, rep)"""


# ---------------------------------------------------------------- signals

SIGNALS_SQL = BARS_SQL + """,
m AS (SELECT ticker, date, close / lag(close, 252) OVER w - 1 AS mom, lead(close, 1) OVER w / close - 1 AS nxt,
             lead(close, 2) OVER w / lead(close, 1) OVER w - 1 AS hold
      FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
sig AS (SELECT 'momentum_next' AS signal, date, mom AS score, nxt AS ret FROM m
        UNION ALL SELECT 'reversal_next', date, -mom, nxt FROM m
        UNION ALL SELECT 'momentum_hold', date, mom, hold FROM m)"""


def signal_ic(spark: SparkSession, sf: str) -> DataFrame:
    """Daily rank correlation of three signals on the momentum of 252 rows, four names a day at least."""
    w = series("ticker", "date")
    c = F.col("close")
    rows = bars(spark, sf).select("ticker", "date", "close").select(
        "ticker", "date", change("close", w, 252).alias("mom"), (ratio(F.lead(c, 1).over(w), c) - 1).alias("nxt"),
        (ratio(F.lead(c, 2).over(w), F.lead(c, 1).over(w)) - 1).alias("hold"))
    rows = materialize(rows.select("ticker", "date", stack_rows(
        ("signal", "score", "ret"), ("momentum_next", F.col("mom"), F.col("nxt")),
        ("reversal_next", -F.col("mom"), F.col("nxt")), ("momentum_hold", F.col("mom"), F.col("hold")))))
    return materialize(daily_ic(rows, "score", "ret", by=["signal", "date"], min_names=4, on_degenerate="skip"))


SIGNAL_IC_SQL = SIGNALS_SQL + ic_sql("sig", "signal, date", "score", "ret", 4, True)
OOS_IC_SQL = OOS_SQL + ic_sql("oos", "fold, date")


def oos_ic(spark: SparkSession, sf: str) -> DataFrame:
    """A series of a few thousand values; kept, as tests and nulls both read it."""
    return materialize(daily_ic(out_of_sample(spark, sf), "prob", "actual_return", by=["fold", "date"]))


@query("gate_momentum", sql(SIGNAL_IC_SQL + hac_sql("signal") + boot_sql("signal", 1000, 5), f"""
SELECT h.signal, h.n, {_r('mean', 8, 'mean')}, {_r('std', 8, 'std')}, {_r('icir', 6, 'icir')}, {_r('ar1', 6, 'ar1')},
       {_r('t_naive', 6, 't_naive')}, {_r('t_hac', 6, 't_hac')}, {_r(normal_sf_sql('t_hac'), 6, 'p_hac')},
       round(p_null, 6) AS p_null, t_hac > 1.645 AND mean > 0 AS condition_a, p_null < 0.05 AS condition_b,
       t_hac > 1.645 AND mean > 0 AND p_null < 0.05 AS gate_open
FROM hac h JOIN (SELECT signal, avg(CASE WHEN null_mean >= mean THEN 1.0::DOUBLE ELSE 0 END) AS p_null
                 FROM boot JOIN sm_hac USING (signal) GROUP BY signal) USING (signal)"""))
def gate_momentum(spark, sf):
    """Both gate conditions for each signal: HAC t, and a resampled null of the mean."""
    ic = signal_ic(spark, sf)
    return rounded(gate(ic, ["signal"]), {"mean": 8, "std": 8})


def gate(ic: DataFrame, by: list[str], reps: int = 1000, block: int = 5) -> DataFrame:
    """Condition A (HAC t), condition B (null p) and their conjunction."""
    tests = inf.hac_test(ic, by)
    null = centred_bootstrap(ic, reps, by, block=block)
    p = null_summary(null, tests.select(*by, F.col("mean").alias("observed")), "null_mean", by).select(
        *by, F.col("p_value").alias("p_null"))
    out = tests.join(p, by)
    a, b = inf.condition_a(), F.col("p_null") < inf.ALPHA
    return out.select(*by, "n", "mean", "std", "icir", "ar1", "t_naive", "t_hac", "p_hac", "p_null",
                      a.alias("condition_a"), b.alias("condition_b"), (a & b).alias("gate_open"))


@query("gate_by_fold", sql(OOS_IC_SQL + hac_sql("fold") + boot_sql("fold", 1000, 1), f"""
SELECT h.fold, h.n, {_r('mean', 8, 'mean')}, {_r('t_naive', 6, 't_naive')}, {_r('t_hac', 6, 't_hac')},
       round(p_null, 6) AS p_null, t_naive > 1.645 AND mean > 0 AS gate_naive, t_hac > 1.645 AND mean > 0 AS gate_hac,
       t_hac > 1.645 AND mean > 0 AND p_null < 0.05 AS gate_full
FROM hac h JOIN (SELECT fold, avg(CASE WHEN null_mean >= mean THEN 1.0::DOUBLE ELSE 0 END) AS p_null
                 FROM boot JOIN sm_hac USING (fold) GROUP BY fold) USING (fold)"""))
def gate_by_fold(spark, sf):
    """Gate variants side by side per fold."""
    g = gate(oos_ic(spark, sf), ["fold"], block=1)
    return rounded(g.select(
        "fold", "n", "mean", "t_naive", "t_hac", "p_null", inf.condition_a("t_naive").alias("gate_naive"),
        F.col("condition_a").alias("gate_hac"), F.col("gate_open").alias("gate_full")), {"mean": 8})


@query("gate_open_counts", sql(OOS_IC_SQL + hac_sql("fold"), """
SELECT count(*) AS n_folds, count(*) FILTER (t_naive > 1.645 AND mean > 0) AS open_naive,
       count(*) FILTER (t_hac > 1.645 AND mean > 0) AS open_hac FROM hac"""))
def gate_open_counts(spark, sf):
    g = inf.hac_test(oos_ic(spark, sf), ["fold"])
    return g.agg(F.count(F.lit(1)).alias("n_folds"),
                 F.count_if(inf.condition_a("t_naive")).alias("open_naive"),
                 F.count_if(inf.condition_a("t_hac")).alias("open_hac"))


@query("daily_ic", sql(OOS_IC_SQL, f"SELECT fold, date, n, {_r('ic', 8, 'ic')} FROM ic"))
def q_daily_ic(spark, sf):
    return rounded(oos_ic(spark, sf), 8)


@query("daily_ic_skip", sql(SIGNAL_IC_SQL, f"SELECT signal, date, n, {_r('ic', 8, 'ic')} FROM ic"))
def q_daily_ic_skip(spark, sf):
    return rounded(signal_ic(spark, sf), 8)


@query("ic_histogram", sql(SIGNAL_IC_SQL, """
SELECT signal, round(floor(round(ic / 0.05::DOUBLE, 9)) * 0.05::DOUBLE, 4) + 0.0 AS bin_low, count(*) AS n FROM ic GROUP BY ALL"""))
def ic_histogram(spark, sf):
    from tidegate.operators.calibration import histogram
    return rounded(histogram(signal_ic(spark, sf), "ic", 0.05, ["signal"]), 4)


@query("ic_summary_hac", sql(SIGNAL_IC_SQL + hac_sql("signal"), f"""
SELECT signal, n, {_r('mean', 8, 'mean')}, {_r('std', 8, 'std')}, {_r('icir', 6, 'icir')}, {_r('t_naive', 6, 't_naive')},
       {_r(student_sf_sql('t_naive', '(n - 1)'), 6, 'p_naive')}, {_r('t_hac', 6, 't_hac')},
       {_r(normal_sf_sql('t_hac'), 6, 'p_hac')},
       ({student_sf_sql('t_naive', '(n - 1)')}) < 0.05 AND mean > 0 AS significant
FROM hac"""))
def ic_summary_hac(spark, sf):
    h = inf.with_naive_p(inf.hac_test(signal_ic(spark, sf), ["signal"]))
    return rounded(h.drop("ar1"), {"mean": 8, "std": 8})


@query("ic_bandwidth_sweep", sql(
    SIGNAL_IC_SQL + "".join(hac_sql("signal", k, name=f"h{k}") for k in range(1, 21)),
    " UNION ALL ".join(f"SELECT signal, {k} AS lag, {_r('t_hac', 6, 't_hac')} FROM h{k}" for k in range(1, 21))))
def ic_bandwidth_sweep(spark, sf):
    return rounded(inf.bandwidth_sweep(signal_ic(spark, sf), ["signal"]).drop("p_hac"))


_POWER = "(1 + 2 * ar1 / (1 - ar1))"
_MULT = "(1 + 2 * list_sum(list_transform(range(1, 10), lambda k: (1 - k / 10.0::DOUBLE) * pow(ar1, k))))"


@query("ic_power_mde", sql(SIGNAL_IC_SQL + hac_sql("signal", 1), f"""
SELECT signal, n, {_r('ar1', 6, 'ar1')}, {_r(f'n / {_POWER}', 4, 'n_eff')},
       CAST(floor(4 * pow(n / 100.0::DOUBLE, 2.0::DOUBLE / 9)) AS BIGINT) AS lag_rule,
       CAST(greatest(1, ceil(1.1447::DOUBLE * pow(4 * ar1 * ar1 / pow(1 - ar1, 4) * n, 1.0::DOUBLE / 3))) AS BIGINT) AS lag_plug_in,
       {_r(_MULT, 6, 'hac_multiplier')},
       {_r(f'(1.6448536269514722::DOUBLE + 0.8416212335729143::DOUBLE) * std / sqrt(n / {_POWER})', 8, 'mde_80')},
       {_r(f'(1.6448536269514722::DOUBLE + 1.2815515655446004::DOUBLE) * std / sqrt(n / {_POWER})', 8, 'mde_90')},
       {_r('mean - 1.96::DOUBLE * std / sqrt(n)', 8, 'ci_low')}, {_r('mean + 1.96::DOUBLE * std / sqrt(n)', 8, 'ci_high')}
FROM hac"""))
def ic_power_mde(spark, sf):
    p = inf.power_report(signal_ic(spark, sf), ["signal"]).drop("mean", "std")
    return rounded(p, {"mde_80": 8, "mde_90": 8, "ci_low": 8, "ci_high": 8, "n_eff": 4})


@query("ic_power_curve", sql(SIGNAL_IC_SQL + hac_sql("signal", 1) + f""",
g AS (SELECT signal, i * 0.001::DOUBLE AS true_mean, 1.6448536269514722::DOUBLE - i * 0.001::DOUBLE / (std / sqrt(n / {_POWER})) AS z
      FROM hac, (SELECT unnest(range(0, 61)) AS i))""", f"""
SELECT signal, {_r('true_mean', 4, 'true_mean')}, {_r(normal_sf_sql('z'), 6, 'power')} FROM g"""))
def ic_power_curve(spark, sf):
    return rounded(inf.power_curve(signal_ic(spark, sf), ["signal"]), {"true_mean": 4})


@query("ic_ar1_lag_table", sql(SIGNAL_IC_SQL + hac_sql("signal", 1) + """,
l AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20]) AS lag),
x AS (SELECT signal, lag, mean, std * std / n * (1 + 2 * list_sum(list_transform(range(1, lag + 1),
        lambda k: (1 - k / (lag + 1.0::DOUBLE)) * pow(ar1, k)))) AS vm FROM hac, l)""", f"""
SELECT signal, lag, {_r('vm', 10, 'var_mean')}, {_r('mean / sqrt(vm)', 6, 't_ar1')} FROM x"""))
def ic_ar1_lag_table(spark, sf):
    return rounded(inf.ar1_lag_table(signal_ic(spark, sf), ["signal"]), {"var_mean": 10})


@query("regime_ic", sql(OOS_IC_SQL + """,
st AS (SELECT date, stddev_pop(actual_return) AS level FROM oos GROUP BY date),
j AS (SELECT ic.ic, level FROM ic JOIN st USING (date)),
c AS (SELECT quantile_cont(level, 0.333::DOUBLE) AS lo, quantile_cont(level, 0.667::DOUBLE) AS hi FROM j),
s AS (SELECT CASE WHEN level <= lo THEN 'low' WHEN level <= hi THEN 'mid' ELSE 'high' END AS regime,
             avg(level) AS level_mean, count(*) AS n, avg(ic) AS mean, stddev_pop(ic) AS std,
             avg(ic) / (stddev_samp(ic) / sqrt(count(*))) AS t
      FROM j, c GROUP BY 1 HAVING count(*) >= 10)""", f"""
SELECT regime, {_r('level_mean', 8, 'level_mean')}, n, {_r('mean', 8, 'mean')}, {_r('std', 8, 'std')},
       {_r('mean / (std + 1e-10::DOUBLE)', 6, 'icir')}, {_r('t', 6, 't')}, {_r(student_sf_sql('t', '(n - 1)'), 6, 'p_upper')},
       ({student_sf_sql('t', '(n - 1)')}) < 0.05 AND mean > 0 AS gate_open FROM s"""))
def regime_ic(spark, sf):
    """Regimes by the cross-sectional dispersion of returns."""
    rows = out_of_sample(spark, sf)
    state = rows.groupBy("date").agg(F.stddev_pop("actual_return").alias("level"))
    ic = daily_ic(rows, "prob", "actual_return")
    return rounded(inf.regime_table(ic, state), {"level_mean": 8, "mean": 8, "std": 8})


# ---------------------------------------------------------------- folds

@query("walk_forward_folds", sql(FOLDS_SQL, """
SELECT fold, role, min(date) AS first_date, max(date) AS last_date, count(*) AS n_dates FROM fold_dates GROUP BY 1, 2"""))
def walk_forward_folds(spark, sf):
    return fo.fold_summary(folds(spark, sf))


@query("fold_dates", sql(FOLDS_SQL, "SELECT fold, role, date, day_no FROM fold_dates"))
def q_fold_dates(spark, sf):
    return folds(spark, sf)


@query("fold_checks", sql(FOLDS_SQL + """,
f AS (SELECT fold, count(*) FILTER (role IN ('model_train', 'cal')) AS tr, count(*) FILTER (role = 'test') AS te,
             max(date) FILTER (role IN ('model_train', 'cal')) AS train_end, min(date) FILTER (role = 'test') AS test_start,
             count(*) - count(DISTINCT date) AS dup FROM fold_dates GROUP BY fold)""", """
SELECT fold, 'min_train_size' AS check_name, tr >= 756 AS passed FROM f
UNION ALL SELECT fold, 'test_not_empty', te > 0 FROM f
UNION ALL SELECT fold, 'train_test_disjoint', dup = 0 FROM f
UNION ALL SELECT fold, 'test_after_train', test_start > train_end FROM f
UNION ALL SELECT fold, 'embargo_gap', date_diff('day', train_end, test_start) >= 2 FROM f
UNION ALL SELECT fold, 'cal_in_train', dup = 0 FROM f
UNION ALL SELECT fold, 'cal_test_disjoint', dup = 0 FROM f"""))
def q_fold_checks(spark, sf):
    return fo.fold_checks(folds(spark, sf))


@query("fold_balance", sql(FOLDS_SQL, """
SELECT fold, role, count(*) AS n_rows, round(avg(target), 4) AS share, NOT avg(target) BETWEEN 0.40 AND 0.60 AS warn
FROM panel JOIN fold_dates USING (date) GROUP BY 1, 2"""))
def fold_balance(spark, sf):
    p = panel(spark, sf)
    return fo.class_balance(p, folds(spark, sf, p))


@query("fold_scaler", sql(FOLDS_SQL, " UNION ALL ".join(f"""
SELECT fold, '{c}' AS feature, count({c}) AS n_rows, {_r(f'avg({c})', 5, 'mean')}, {_r(f'stddev_pop({c})', 5, 'std')}
FROM panel JOIN fold_dates USING (date) WHERE role = 'model_train' GROUP BY fold""" for c in FEATURES4)))
def fold_scaler(spark, sf):
    p = panel(spark, sf)
    return rounded(fo.scaler_stats(p, folds(spark, sf, p), FEATURES4), 5)


@query("fold_standardized", sql(FOLDS_SQL + ",\nst AS (SELECT fold, " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES4) + """
    FROM panel JOIN fold_dates USING (date) WHERE role = 'model_train' GROUP BY fold)""", f"""
SELECT f.fold, f.role, ticker, f.date, {', '.join(
    _r(f'({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END', 5, c) for c in FEATURES4)}
FROM panel JOIN fold_dates f ON panel.date = f.date AND role IN ('cal', 'test') JOIN st ON st.fold = f.fold"""))
def fold_standardized(spark, sf):
    """Calibration and test rows scaled by their fold's model-train statistics."""
    p = panel(spark, sf).select("ticker", "date", *FEATURES4)
    f = folds(spark, sf, p)
    rows = fo.rows_of_role(p, f, "cal", "test")
    return rounded(fo.standardize(rows, fo.scaler_stats(p, f, FEATURES4), FEATURES4), 5)


@query("fold_arrays", sql(FOLDS_SQL + ",\nst AS (SELECT fold, " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES4) + """
    FROM panel JOIN fold_dates USING (date) WHERE role = 'model_train' GROUP BY fold)""", f"""
SELECT f.fold, f.role, ticker, f.date, target, {', '.join(
    _r(f'({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END', 5, c) for c in FEATURES4)}
FROM panel JOIN fold_dates f ON panel.date = f.date AND role <> 'embargo' JOIN st ON st.fold = f.fold"""))
def fold_arrays(spark, sf):
    """Rows of all roles, once per fold, with the target; scaled by their fold's model-train statistics."""
    p = panel(spark, sf).select("ticker", "date", "target", *FEATURES4)
    f = folds(spark, sf, p)
    rows = fo.rows_of_role(p, f, "model_train", "cal", "test")
    return rounded(fo.standardize(rows, fo.scaler_stats(p, f, FEATURES4), FEATURES4), 5)


@query("fold_tail_validation", sql(FOLDS_SQL + """,
r AS (SELECT fold, date, ticker, row_number() OVER (PARTITION BY fold ORDER BY date, ticker) AS rn,
             count(*) OVER (PARTITION BY fold) AS n
      FROM panel JOIN fold_dates USING (date) WHERE role = 'model_train')""", """
SELECT fold, rn > floor(n * 0.85::DOUBLE) AS is_val, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date
FROM r GROUP BY 1, 2"""))
def fold_tail_validation(spark, sf):
    p = panel(spark, sf).select("ticker", "date")
    rows = fo.tail_validation(fo.rows_of_role(p, folds(spark, sf, p), "model_train"))
    return rows.groupBy("fold", "is_val").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("fold_split_overlap", sql(FOLDS_SQL + """,
tr AS (SELECT fold, date, day_no, count(*) OVER (PARTITION BY fold) AS n FROM fold_dates WHERE role IN ('model_train', 'cal')),
sp AS (SELECT *, n - CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT) AS pre FROM tr),
sq AS (SELECT *, pre - CAST(round_even(pre * 0.15::DOUBLE, 0) AS BIGINT) AS vs,
              row_number() OVER (PARTITION BY fold ORDER BY md5(concat_ws('|', 'val', fold, date))) AS rn FROM sp),
cal AS (SELECT fold, count(*) FILTER (day_no >= pre) AS n_cal,
               count(*) FILTER (day_no >= pre AND day_no >= vs AND day_no < pre) AS tail_overlap,
               count(*) FILTER (day_no >= pre AND rn <= round_even(n * 0.15::DOUBLE, 0)) AS random_overlap FROM sq GROUP BY fold)""", """
SELECT fold, n_cal, tail_overlap, random_overlap FROM cal"""))
def fold_split_overlap(spark, sf):
    """Overlap of calibration days with an ordered and with a random validation split."""
    f = folds(spark, sf)
    parts = fo.three_way_split(f)
    cal = parts.filter(F.col("part") == "calib")
    tail = fo.split_overlap(parts.filter(F.col("part") == "val"), cal)
    rand = fo.split_overlap(fo.random_validation(f), cal)
    return tail.select("fold", "n_cal", F.col("n_overlap").alias("tail_overlap")).join(
        rand.select("fold", F.col("n_overlap").alias("random_overlap")), "fold")


# ---------------------------------------------------------------- resampling of the signal

@query("boot_iid", sql(SIGNAL_IC_SQL + boot_sql("signal", 1000, 1), f"""
SELECT signal, rep, {_r('null_mean', 8, 'null_mean')} FROM boot"""))
def boot_iid(spark, sf):
    return rounded(centred_bootstrap(signal_ic(spark, sf), 1000, ["signal"]), 8)


@query("boot_block", sql(SIGNAL_IC_SQL + boot_sql("signal", 1000, 5), f"""
SELECT signal, rep, {_r('null_mean', 8, 'null_mean')} FROM boot"""))
def boot_block(spark, sf):
    return rounded(centred_bootstrap(signal_ic(spark, sf), 1000, ["signal"], block=5), 8)


@query("boot_fold_ci", sql(OOS_IC_SQL + f""",
s AS (SELECT fold, ic AS x, row_number() OVER (PARTITION BY fold ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY fold) AS n FROM ic),
d AS (SELECT fold, rep, j, {draw_sql('rep', 'j', 'j * 7919')} % n AS start, n
      FROM (SELECT fold, n, rep, unnest(range(1, greatest(n // 5, 1) + 1)) AS j
            FROM (SELECT DISTINCT fold, n FROM s), (SELECT unnest(range(1, 2001)) AS rep))),
m AS (SELECT d.fold, rep, avg(x) AS mean FROM d JOIN s ON s.fold = d.fold AND s.i >= d.start AND s.i < d.start + 5 GROUP BY 1, 2),
c AS (SELECT fold, quantile_cont(mean, 0.025::DOUBLE) AS lo, quantile_cont(mean, 0.975::DOUBLE) AS hi FROM m GROUP BY fold),
f AS (SELECT fold, count(*) AS n_days, avg(x) AS mean, stddev_pop(x) AS std FROM s GROUP BY fold)""", f"""
SELECT fold, n_days, {_r('mean', 8, 'mean')}, {_r('std', 8, 'std')}, {_r('lo', 8, 'ci_low')}, {_r('hi', 8, 'ci_high')},
       lo > 0 OR hi < 0 AS ci_excludes_zero FROM f JOIN c USING (fold)"""))
def boot_fold_ci(spark, sf):
    return rounded(moving_block_interval(oos_ic(spark, sf), ["fold"]), 8)


KEYED_SQL = """,
keyed AS (
  SELECT date, ticker, prob, actual_return, CAST('0x' || substr(md5(concat_ws('|', date, ticker)), 1, 7) AS BIGINT) AS h1,
         CAST('0x' || substr(md5(concat_ws('|', date, ticker)), 8, 7) AS BIGINT) AS h2,
         row_number() OVER (PARTITION BY date ORDER BY prob DESC, ticker) AS slot FROM oos)"""


def drawn_sql(reps: int) -> str:
    return KEYED_SQL + f""",
drawn AS (
  SELECT rep, date, ticker, actual_return, row_number() OVER (PARTITION BY rep, date ORDER BY u, h2, ticker) AS pos
  FROM (SELECT *, {draw_sql('rep', 'h1', 'h2')} AS u FROM keyed, (SELECT unnest(range(1, {reps} + 1)) AS rep))),
shuffled AS (SELECT d.rep, d.date, d.ticker, d.actual_return, k.prob FROM drawn d JOIN keyed k ON k.date = d.date AND k.slot = d.pos)"""


@query("perm_ic", sql(OOS_SQL + drawn_sql(1000) + ic_sql("shuffled", "rep, date"), f"""
SELECT rep, {_r('avg(ic)', 8, 'null_mean_ic')} FROM ic GROUP BY rep"""))
def perm_ic(spark, sf):
    """Mean daily rank correlation under within-day shuffles of the score."""
    return rounded(permuted_ic(out_of_sample(spark, sf), reps=1000), 8)


# ---------------------------------------------------------------- universes

@query("universe_fold_ic", sql(OOS_SQL + """,
good AS (SELECT ticker FROM bars GROUP BY ticker HAVING count(close) >= 1500 AND min(close) > 0),
u AS (SELECT 'all' AS universe, * FROM oos UNION ALL SELECT 'screened', * FROM oos WHERE ticker IN (SELECT ticker FROM good)),
nt AS (SELECT universe, fold, count(DISTINCT ticker) AS n_tickers, min(date) AS test_start, max(date) AS test_end,
              sqrt(avg((prob - target) * (prob - target))) AS rmse FROM u GROUP BY 1, 2)"""
    + ic_sql("u", "universe, fold, date", having=3) + hac_sql("universe, fold", 9, "1e-12"), f"""
SELECT universe, fold, test_start, test_end, n_tickers, n AS n_days, {_r('mean', 8, 'mean')}, {_r('std_pop', 8, 'std')},
       {_r('mean / (std_pop + 1e-10::DOUBLE)', 6, 'icir')}, {_r('t_hac', 6, 't_hac')},
       {_r(student_sf_sql('t_hac', '(n - 1)'), 6, 'p_hac')}, {_r('rmse', 6, 'rmse')},
       ({student_sf_sql('t_hac', '(n - 1)')}) < 0.05 AND mean > 0 AS gate_open
FROM hac JOIN nt USING (universe, fold)"""))
def universe_fold_ic(spark, sf):
    return rounded(universe_folds(spark, sf), {"mean": 8, "std": 8})


def universe_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Per-fold statistics with the universe as a key."""
    b = bars(spark, sf)
    rows = out_of_sample(spark, sf, panel(spark, sf, b))
    good = universe_screen(b, min_rows=1500).select("ticker")
    both = rows.withColumn("universe", F.lit("all")).unionByName(
        rows.join(good, "ticker", "left_semi").withColumn("universe", F.lit("screened")))
    keys = ["universe", "fold"]
    facts = both.groupBy(*keys).agg(
        F.countDistinct("ticker").alias("n_tickers"), F.min("date").alias("test_start"), F.max("date").alias("test_end"),
        F.sqrt(F.avg((F.col("prob") - F.col("target")) * (F.col("prob") - F.col("target")))).alias("rmse"))
    ic = daily_ic(both, "prob", "actual_return", by=[*keys, "date"], min_names=3)
    t = inf.hac_test(ic, keys, floor=1e-12, tail="student")
    pop = ic.groupBy(*keys).agg(F.stddev_pop("ic").alias("sd"))
    out = t.join(pop, keys).join(facts, keys)
    return out.select(
        *keys, "test_start", "test_end", "n_tickers", F.col("n").alias("n_days"), "mean", F.col("sd").alias("std"),
        (F.col("mean") / (F.col("sd") + 1e-10)).alias("icir"), "t_hac", "p_hac", "rmse",
        ((F.col("p_hac") < inf.ALPHA) & (F.col("mean") > 0)).alias("gate_open"))


@query("universe_comparison", sql(OOS_SQL + """,
good AS (SELECT ticker FROM bars GROUP BY ticker HAVING count(close) >= 1500 AND min(close) > 0),
u AS (SELECT 'all' AS universe, * FROM oos UNION ALL SELECT 'screened', * FROM oos WHERE ticker IN (SELECT ticker FROM good))"""
    + ic_sql("u", "universe, fold, date", having=3) + hac_sql("universe", 9, "1e-12"), f"""
SELECT universe, n, {_r('mean', 8, 'mean')}, {_r('std', 8, 'std')}, {_r('t_hac', 6, 't_hac')},
       {_r(student_sf_sql('t_hac', '(n - 1)'), 6, 'p_hac')}, t_hac > 1.645 AND mean > 0 AS condition_a FROM hac"""))
def universe_comparison(spark, sf):
    """One summary row per universe."""
    b = bars(spark, sf)
    rows = out_of_sample(spark, sf, panel(spark, sf, b))
    good = universe_screen(b, min_rows=1500).select("ticker")
    one = lambda df, name: inf.hac_test(
        daily_ic(df, "prob", "actual_return", by=["fold", "date"], min_names=3), floor=1e-12, tail="student",
    ).select(F.lit(name).alias("universe"), "n", "mean", "std", "t_hac", "p_hac", inf.condition_a().alias("condition_a"))
    both = one(rows, "all").unionByName(one(rows.join(good, "ticker", "left_semi"), "screened"))
    return rounded(both, {"mean": 8, "std": 8})


@query("p_value_audit", sql(SIGNAL_IC_SQL + hac_sql("signal") + f""",
a AS (SELECT signal, t_hac AS t, {normal_sf_sql('t_naive')} AS p_reported, {normal_sf_sql('t_hac')} AS p_upper FROM hac),
b AS (SELECT *, 1 - p_upper AS p_lower, CASE WHEN t >= 0 THEN 2 * p_upper ELSE 2 * (1 - p_upper) END AS p_two FROM a)""", f"""
SELECT signal, {_r('t', 6, 't')}, {_r('p_reported', 6, 'p_reported')}, {_r('p_upper', 6, 'p_upper')},
       {_r('p_lower', 6, 'p_lower')}, {_r('p_two', 6, 'p_two')}, abs(p_upper - p_reported) < 0.02::DOUBLE AS match_upper,
       abs(p_lower - p_reported) < 0.02::DOUBLE AS match_lower, abs(p_two - p_reported) < 0.02::DOUBLE AS match_two,
       CASE WHEN abs(p_upper - p_reported) < 0.02::DOUBLE THEN 'upper' WHEN abs(p_lower - p_reported) < 0.02::DOUBLE THEN 'lower'
            WHEN abs(p_two - p_reported) < 0.02::DOUBLE THEN 'two' ELSE 'flag' END AS verdict
FROM b"""))
def p_value_audit(spark, sf):
    """HAC tail probabilities against those a plain t test would report."""
    from tidegate.functions.tails import normal_sf
    h = inf.hac_test(signal_ic(spark, sf), ["signal"])
    rows = h.select("signal", F.col("t_hac").alias("t"), normal_sf(F.col("t_naive")).alias("p_reported"))
    return rounded(inf.p_value_audit(rows, tolerance=0.020))
