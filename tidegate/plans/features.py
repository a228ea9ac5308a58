"""Bars, features, labels and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.functions.columns import FEATURE_CATEGORIES, feature_category, finite_or_zero, stack_rows
from tidegate.operators.features import (
    FEATURES, all_features, model_panel, rolling_features, smoothed_features, with_holding_return, with_momentum,
    with_target,
)
from tidegate.operators.quality import (
    in_range, integrity_audit, missing_entities, prediction_audit, quality_by_entity, reconcile_sources, select_entities,
    universe_screen, without_entity,
)
from tidegate.plans.base import BARS_SQL, ORDER_KEY, PANEL_SQL, bars, panel, rounded, series_bars, significant, sql, table
from tidegate.plans.registry import ORACLES, query
from tidegate.sources.bars import bars_from_trades, daily_returns, packed_order
from tidegate.sources.readers import entity_names, long_to_wide, parse_factor_text, wide_to_long

KEY = ("ticker", "date")
EPS = "1e-10::DOUBLE"


def _r(expr: str, digits: int, name: str) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def _full(agg: str, x: str, n: int) -> str:
    """Aggregate over the last n rows, NULL when a value is missing."""
    frame = f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) OVER {frame} = {n} THEN {agg}({x}) OVER {frame} END)"


INPUTS_SQL = BARS_SQL + """,
i0 AS (SELECT *, nullif(volume, 0) AS v, (high + low + close) / 3 AS tp,
              lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl,
              row_number() OVER w AS rn
       FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
i1 AS (SELECT *, close - pc AS d, ln(close / pc) AS lr, tp - lag(tp) OVER w AS dtp, tp * v AS tpv,
              greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, high - ph AS up, pl - low AS down
       FROM i0 WINDOW w AS (PARTITION BY ticker ORDER BY date)),
i2 AS (SELECT *, CASE WHEN dtp > 0 THEN tpv ELSE 0 END AS pos, CASE WHEN dtp < 0 THEN tpv ELSE 0 END AS neg,
              greatest(d, 0) + d * 0 AS gain, greatest(-d, 0) + d * 0 AS loss,
              CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm,
              CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mdm,
              CASE WHEN v IS NOT NULL THEN sum(coalesce(sign(d), 0) * v) OVER w END AS obv
       FROM i1 WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING))"""


@query("bars_daily", sql(BARS_SQL, """
SELECT * FROM bars"""))
def bars_daily(spark, sf):
    return bars(spark, sf)


@query("bars_nation", """
WITH t AS (SELECT n_name, l_shipdate, l_quantity, l_extendedprice / l_quantity AS px, l_orderkey, l_linenumber,
                  l_partkey, l_suppkey
           FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT n_name AS ticker, CAST(l_shipdate AS DATE) AS date, max(px) AS high, min(px) AS low,
       CAST(sum(l_quantity) AS DOUBLE) AS volume
FROM t GROUP BY 1, 2""")
def bars_nation(spark, sf):
    """The same bars with an uneven entity: supplier nation."""
    trades = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey")))
    b = bars_from_trades(
        trades, entity="n_name", time="l_shipdate", price=F.col("l_extendedprice") / F.col("l_quantity"),
        quantity="l_quantity", order=packed_order(*ORDER_KEY))
    return b.select("ticker", "date", "high", "low", "volume")


RETURNS = {f"return_{n}d": f"close / lag(close, {n}) OVER w - 1" for n in (1, 2, 3, 5, 10, 21)}


@query("feat_returns_roc_dpo", sql(BARS_SQL + f""",
s AS (SELECT *, {_full('avg', 'close', 20)} AS sma20 FROM bars)""", f"""
SELECT ticker, date, {', '.join(_r(e, 8, n) for n, e in RETURNS.items())},
       {_r('100 * (close / lag(close, 10) OVER w - 1)', 6, 'ROC_10')},
       {_r('100 * (close / lag(close, 21) OVER w - 1)', 6, 'ROC_21')},
       {_r('lag(close, 11) OVER w - lag(sma20, 11) OVER w', 5, 'DPO_20')}
FROM s WINDOW w AS (PARTITION BY ticker ORDER BY date)"""))
def feat_returns_roc_dpo(spark, sf):
    f = rolling_features(series_bars(spark, sf)).select(*KEY, *RETURNS, "ROC_10", "ROC_21", "DPO_20")
    return rounded(f, {n: 8 for n in RETURNS} | {"DPO_20": 5})


@query("feat_sma_bollinger", sql(BARS_SQL + f""",
s AS (SELECT *, {_full('avg', 'close', 20)} AS m, {_full('stddev_samp', 'close', 20)} AS sd,
             {_full('avg', 'close', 50)} AS s50, {_full('avg', 'close', 200)} AS s200 FROM bars)""", f"""
SELECT ticker, date, {_r('m + 2 * sd', 5, 'BB_upper')}, {_r('m - 2 * sd', 5, 'BB_lower')}, {_r('m', 5, 'BB_mid')},
       {_r(f'4 * sd / (m + {EPS})', 7, 'BB_width')},
       {_r(f'(close - m + 2 * sd) / (4 * sd + {EPS})', 7, 'BB_pct_b')},
       {_r('s50', 5, 'SMA_50')}, {_r('s200', 5, 'SMA_200')},
       {_r(f'close / (s50 + {EPS})', 7, 'price_to_SMA50')}, {_r(f'close / (s200 + {EPS})', 7, 'price_to_SMA200')}
FROM s"""))
def feat_sma_bollinger(spark, sf):
    level = ("BB_upper", "BB_lower", "BB_mid", "SMA_50", "SMA_200")
    share = ("BB_width", "BB_pct_b", "price_to_SMA50", "price_to_SMA200")
    f = rolling_features(series_bars(spark, sf)).select(*KEY, *level, *share)
    return rounded(f, {c: 5 for c in level} | {c: 7 for c in share})


@query("feat_candles_vol", sql(INPUTS_SQL, f"""
SELECT ticker, date, {_r(f'(close - open) / (high - low + {EPS})', 7, 'OC_body_norm')},
       {_r(f'(high - greatest(open, close)) / (high - low + {EPS})', 7, 'upper_shadow_ratio')},
       {_r(f'(least(open, close) - low) / (high - low + {EPS})', 7, 'lower_shadow_ratio')},
       {_r(f'(high - low + {EPS}) / (close + {EPS})', 7, 'HL_range_norm')},
       {', '.join(_r(_full('stddev_samp', 'lr', n), 7, f'rolling_vol_{n}d') for n in (5, 21, 63))}
FROM i2"""))
def feat_candles_vol(spark, sf):
    names = ("OC_body_norm", "upper_shadow_ratio", "lower_shadow_ratio", "HL_range_norm",
             "rolling_vol_5d", "rolling_vol_21d", "rolling_vol_63d")
    return rounded(rolling_features(series_bars(spark, sf)).select(*KEY, *names), 7)


@query("feat_stoch_williams_cci", sql(INPUTS_SQL + f""",
s AS (SELECT *, {_full('min', 'low', 14)} AS ll, {_full('max', 'high', 14)} AS hh,
             {_full('avg', 'tp', 20)} AS tpm, {_full('list', 'tp', 20)} AS tps FROM i2),
k AS (SELECT *, 100 * (close - ll) / (hh - ll + {EPS}) AS k FROM s)""", f"""
SELECT ticker, date, {_r('k', 6, 'stoch_K')}, {_r(_full('avg', 'k', 3), 6, 'stoch_D')},
       {_r(f'-100 * (hh - close) / (hh - ll + {EPS})', 6, 'Williams_R')},
       {_r(f'(tp - tpm) / (0.015::DOUBLE * list_avg(list_transform(tps, lambda x: abs(x - tpm))) + {EPS})', 5, 'CCI_20')}
FROM k"""))
def feat_stoch_williams_cci(spark, sf):
    f = rolling_features(series_bars(spark, sf)).select(*KEY, "stoch_K", "stoch_D", "Williams_R", "CCI_20")
    return rounded(f, {"CCI_20": 5})


@query("feat_mfi_vwap_zvol", sql(INPUTS_SQL + f""",
s AS (SELECT *, {_full('sum', 'tpv', 20)} / {_full('sum', 'v', 20)} AS vw FROM i2)""", f"""
SELECT ticker, date,
       {_r(f"100 - 100 / (1 + {_full('sum', 'pos', 14)} / ({_full('sum', 'neg', 14)} + {EPS}))", 6, 'MFI_14')},
       {_r(f'(close - vw) / (vw + {EPS})', 7, 'VWAP_deviation')},
       {', '.join(_r(f"(v - {_full('avg', 'v', n)}) / ({_full('stddev_samp', 'v', n)} + {EPS})", 6, f'volume_zscore_{n}d')
                  for n in (5, 21))}
FROM s"""))
def feat_mfi_vwap_zvol(spark, sf):
    f = rolling_features(series_bars(spark, sf)).select(*KEY, "MFI_14", "VWAP_deviation", "volume_zscore_5d", "volume_zscore_21d")
    return rounded(f, {"VWAP_deviation": 7})


def _step(y: str, x: str, alpha: str) -> str:
    """One step of the recursive mean; a NULL value repeats the last mean."""
    return (f"CASE WHEN {x} IS NULL THEN {y} WHEN {y} IS NULL THEN {x} "
            f"ELSE ({alpha})::DOUBLE * ({x}) + (1 - ({alpha})::DOUBLE) * ({y}) END")


_MEANS = {  # name -> (input, alpha)
    "g14": ("s.gain", "1.0/14"), "l14": ("s.loss", "1.0/14"), "g21": ("s.gain", "1.0/21"), "l21": ("s.loss", "1.0/21"),
    "e12": ("s.close", "2.0/13"), "e26": ("s.close", "2.0/27"), "e9": ("s.close", "2.0/10"), "e21": ("s.close", "2.0/22"),
    "e50": ("s.close", "2.0/51"), "e200": ("s.close", "2.0/201"), "a14": ("s.tr", "1.0/14"), "a21": ("s.tr", "1.0/21"),
    "o21": ("s.obv", "2.0/22"), "p14": ("s.pdm", "1.0/14"), "m14": ("s.mdm", "1.0/14"),
}


def _ewm_sql(means: tuple[str, ...], body: str) -> str:
    """Row-by-row recursion over each name's series."""
    first = ", ".join(f"CAST({_MEANS[m][0]} AS DOUBLE) AS {m}" for m in means)
    step = ", ".join(f"{_step('e.' + m, *_MEANS[m])}" for m in means)
    return "WITH RECURSIVE " + (INPUTS_SQL + f""",
e AS (
  SELECT s.ticker, s.date, s.rn, s.obv, s.close, {first} FROM i2 s WHERE rn = 1
  UNION ALL
  SELECT s.ticker, s.date, s.rn, s.obv, s.close, {step} FROM e JOIN i2 s ON s.ticker = e.ticker AND s.rn = e.rn + 1)
""").strip() + body


@query("feat_ewm", _ewm_sql(("e9", "e21", "e50", "e200"), f"""
SELECT ticker, date, {', '.join(_r(f'CASE WHEN rn >= {n} THEN e{n} END', 5, f'EMA_{n}') for n in (9, 21, 50, 200))}
FROM e"""))
def feat_ewm(spark, sf):
    f = smoothed_features(series_bars(spark, sf), gaps=False)
    return rounded(f.select(*KEY, "EMA_9", "EMA_21", "EMA_50", "EMA_200"), 5)


@query("feat_rsi_macd", _ewm_sql(("g14", "l14", "g21", "l21", "e12", "e26"), f""",
m AS (SELECT *, CASE WHEN rn >= 26 THEN e12 - e26 END AS macd FROM e),
sg AS (
  SELECT ticker, rn, macd AS sig FROM m WHERE rn = 26
  UNION ALL
  SELECT m.ticker, m.rn, {_step('sg.sig', 'm.macd', '0.2')} FROM sg JOIN m ON m.ticker = sg.ticker AND m.rn = sg.rn + 1)
SELECT m.ticker, m.date,
       {_r(f'CASE WHEN m.rn > 14 THEN 100 - 100 / (1 + g14 / (l14 + {EPS})) END', 6, 'RSI_14')},
       {_r(f'CASE WHEN m.rn > 21 THEN 100 - 100 / (1 + g21 / (l21 + {EPS})) END', 6, 'RSI_21')},
       {_r('macd', 5, 'MACD_12_26')}, {_r('CASE WHEN m.rn >= 34 THEN sig END', 5, 'MACD_signal_9')},
       {_r('CASE WHEN m.rn >= 34 THEN macd - sig END', 5, 'MACD_hist')}
FROM m LEFT JOIN sg ON m.ticker = sg.ticker AND m.rn = sg.rn"""))
def feat_rsi_macd(spark, sf):
    f = smoothed_features(series_bars(spark, sf), gaps=False)
    return rounded(f.select(*KEY, "RSI_14", "RSI_21", "MACD_12_26", "MACD_signal_9", "MACD_hist"),
                   {"MACD_12_26": 5, "MACD_signal_9": 5, "MACD_hist": 5})


@query("feat_atr_adx", _ewm_sql(("a14", "a21", "p14", "m14"), f""",
x AS (SELECT *, CASE WHEN rn >= 14 THEN 100 * p14 / (a14 + {EPS}) END AS dp,
             CASE WHEN rn >= 14 THEN 100 * m14 / (a14 + {EPS}) END AS dm FROM e),
y AS (SELECT *, 100 * abs(dp - dm) / (dp + dm + {EPS}) AS dx FROM x),
ax AS (
  SELECT ticker, rn, dx AS adx FROM y WHERE rn = 14
  UNION ALL
  SELECT y.ticker, y.rn, {_step('ax.adx', 'y.dx', '1.0/14')} FROM ax JOIN y ON y.ticker = ax.ticker AND y.rn = ax.rn + 1)
SELECT y.ticker, y.date, {_r('CASE WHEN y.rn >= 14 THEN a14 END', 5, 'ATR_14')},
       {_r('CASE WHEN y.rn >= 21 THEN a21 END', 5, 'ATR_21')}, {_r('dp', 6, 'DI_plus')}, {_r('dm', 6, 'DI_minus')},
       {_r('CASE WHEN y.rn >= 27 THEN adx END', 6, 'ADX_14')}
FROM y LEFT JOIN ax ON y.ticker = ax.ticker AND y.rn = ax.rn"""))
def feat_atr_adx(spark, sf):
    f = smoothed_features(series_bars(spark, sf), gaps=False)
    return rounded(f.select(*KEY, "ATR_14", "ATR_21", "DI_plus", "DI_minus", "ADX_14"), {"ATR_14": 5, "ATR_21": 5})


@query("feat_obv", _ewm_sql(("o21",), f"""
SELECT ticker, date, {_r('obv', 3, 'OBV')}, {_r('CASE WHEN rn >= 21 THEN o21 END', 3, 'OBV_EMA')} FROM e"""))
def feat_obv(spark, sf):
    """Volume balance and its mean through the path that allows gaps."""
    f = rolling_features(smoothed_features(series_bars(spark, sf)))
    return rounded(f.select(*KEY, "OBV", "OBV_EMA"), 3)


@query("target_and_forward_return", sql(BARS_SQL + """,
t AS (SELECT ticker, date, close, CASE WHEN lead(close, 2) OVER w IS NOT NULL THEN
        CASE WHEN lead(close, 2) OVER w > lead(close, 1) OVER w THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS target
      FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))""", f"""
SELECT ticker, date, target,
       {_r('lead(close, 2) OVER w / lead(close, 1) OVER w - 1', 8, 'actual_return')}
FROM t WHERE target IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date)"""))
def target_and_forward_return(spark, sf):
    t = with_target(bars(spark, sf).select("ticker", "date", "close")).dropna(subset=["target"])
    return rounded(with_holding_return(t).drop("close"), 8)


@query("quality_by_entity", sql(BARS_SQL + """,
q AS (SELECT *, lag(close, 1) OVER w AS c1, lag(close, 2) OVER w AS c2 FROM bars
      WINDOW w AS (PARTITION BY ticker ORDER BY date))""", f"""
SELECT ticker, count(*) AS n_rows, count(*) - count(close) AS missing_close, count(*) - count(volume) AS missing_volume,
       count(*) FILTER (close = c1 AND close = c2) AS stale, count(*) FILTER (abs(ln(close / c1)) > 0.2) AS outliers,
       count(*) FILTER (volume = 0) AS zero_volume, {_r('min(close)', 6, 'min_close')}
FROM q GROUP BY ticker"""))
def quality_entity(spark, sf):
    return rounded(quality_by_entity(bars(spark, sf)))


#: Digits to which the queries of single features are compared; six for those not listed.
DIGITS = {
    **{f: 8 for f in FEATURES if f.startswith("return_")},
    **{f: 7 for f in FEATURES if f.startswith(("price_to_", "rolling_vol_")) or f in (
        "BB_width", "BB_pct_b", "OC_body_norm", "upper_shadow_ratio", "lower_shadow_ratio", "HL_range_norm", "VWAP_deviation")},
    **{f: 5 for f in FEATURES if f.startswith(("SMA_", "EMA_", "MACD_", "ATR_")) or f in (
        "BB_upper", "BB_lower", "BB_mid", "DPO_20", "CCI_20")},
    "OBV": 3, "OBV_EMA": 3,
}
FEATURE_QUERIES = ("feat_returns_roc_dpo", "feat_sma_bollinger", "feat_candles_vol", "feat_stoch_williams_cci", "feat_mfi_vwap_zvol",
                   "feat_ewm", "feat_rsi_macd", "feat_atr_adx", "feat_obv")
#: All features side by side, each by its own query's SQL, with label and day number of each name.
ALL_SQL = ", ".join(f"{name} AS ({ORACLES[name]})" for name in FEATURE_QUERIES) + f""", {BARS_SQL.strip()},
day AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM bars),
labelled AS (SELECT a.*, p.close AS c0, CASE WHEN y.close IS NOT NULL THEN (y.close > x.close)::INTEGER::DOUBLE END AS target
  FROM day a LEFT JOIN day p ON p.ticker = a.ticker AND p.rn = a.rn - 1
  LEFT JOIN day x ON x.ticker = a.ticker AND x.rn = a.rn + 1 LEFT JOIN day y ON y.ticker = a.ticker AND y.rn = a.rn + 2),
side AS (SELECT * FROM labelled {' '.join(f'JOIN {name} USING (ticker, date)' for name in FEATURE_QUERIES)}),
long AS (SELECT ticker, date, target, feature, x
         FROM (SELECT ticker, date, target, {', '.join(f'"{f}"' for f in FEATURES)} FROM side)
         UNPIVOT INCLUDE NULLS (x FOR feature IN ({', '.join(f'"{f}"' for f in FEATURES)}))),
whole AS (SELECT ticker, date FROM long WHERE target IS NOT NULL GROUP BY ALL HAVING count(*) = count(x))"""


@query("quality_audit", sql(ALL_SQL + f""",
q AS (SELECT * FROM side WHERE SMA_200 IS NOT NULL AND target IS NOT NULL),
lead2 AS (SELECT ticker, date, CASE WHEN lead(close, 2) OVER w IS NOT NULL THEN lead(close, 2) OVER w > lead(close, 1) OVER w END AS up,
                 close / lag(close) OVER w - 1 AS back FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
nulls AS (SELECT count(*) - count(x) AS n, count(DISTINCT feature) AS features FROM long JOIN q USING (ticker, date)),
off AS (SELECT count(*) FILTER (q.target IS DISTINCT FROM up::INTEGER::DOUBLE) AS n, max(abs(q.close / q.c0 - 1 - back)) AS gap
        FROM q LEFT JOIN lead2 USING (ticker, date)),
warm AS (SELECT ticker, count(*) - count(SMA_200) AS k, count(*) AS c FROM side GROUP BY ticker),
checks(check_name, passed, detail) AS (
  SELECT 'no_null_features', n = 0, n FROM nulls UNION ALL SELECT 'feature_count', features = 49, features FROM nulls
  UNION ALL SELECT 'target_recomputed', n = 0, n FROM off UNION ALL SELECT 'return_is_backward', gap <= 1e-8, gap FROM off
  UNION ALL SELECT 'unique_keys', count(*) = count(DISTINCT (ticker, date)), count(*) - count(DISTINCT (ticker, date)) FROM q
  UNION ALL SELECT 'has_rows', count(*) > 0, count(*) FROM q
  UNION ALL SELECT 'target_binary', count(*) FILTER (target NOT IN (0, 1)) = 0, count(*) FILTER (target NOT IN (0, 1)) FROM q
  UNION ALL SELECT 'ratio_positive', min(close / SMA_200) > 0, min(close / (SMA_200 + {EPS})) FROM q
  UNION ALL SELECT 'sma200_warmup_199', count(*) FILTER (k <> least(199, c)) = 0, count(*) FILTER (k <> least(199, c)) FROM warm)""", f"""
SELECT check_name, passed, {_r('detail', 5, 'detail')} FROM checks"""))
def quality_audit(spark, sf):
    """Integrity checks of the full feature panel."""
    b = series_bars(spark, sf)
    audit = integrity_audit(model_panel(b, gaps=False), b, rolling_features(b).select("ticker", "date", "SMA_200"))
    return rounded(audit, 5)


@query("feature_panel_summary", sql(ALL_SQL + """,
filled AS (SELECT feature, count(*) - count(x) AS n_filled, avg(coalesce(x, 0)) AS mean_filled FROM long GROUP BY feature)""", f"""
SELECT feature, count(*) AS n, min(x) AS lo, max(x) AS hi, CAST(printf('%.8e', avg(x)) AS DOUBLE) + 0.0 AS mean, any_value(n_filled) AS n_filled,
       CAST(printf('%.8e', any_value(mean_filled)) AS DOUBLE) + 0.0 AS mean_filled,
       CASE {' '.join("WHEN " + ' OR '.join(f"contains(lower(feature), '{x}')" for x in fragments) + f" THEN '{label}'"
                      for fragments, label in FEATURE_CATEGORIES)} ELSE 'Other' END AS category
FROM long JOIN whole USING (ticker, date) JOIN filled USING (feature) GROUP BY feature"""))
def feature_panel_summary(spark, sf):
    """Rows, range and mean per feature of the warmed-up panel, and of all rows with 0 for what is missing."""
    rows = with_target(all_features(series_bars(spark, sf), gaps=False))
    rows = rows.select("target", *[(F.round(f, DIGITS.get(f, 6)) + 0.0).alias(f) for f in FEATURES])
    whole = F.col("target").isNotNull()
    for f in FEATURES:
        whole = whole & F.col(f).isNotNull()
    rows = rows.withColumns({"whole": whole, "missing": F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in FEATURES]))})
    filled = finite_or_zero(rows, FEATURES)
    long = filled.select("whole", "missing", stack_rows(("feature", "x"), *[(f, F.col(f)) for f in FEATURES]))
    x = F.when(F.col("whole"), F.col("x"))
    out = long.groupBy("feature").agg(
        F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"),
        F.count_if(F.array_contains("missing", F.col("feature"))).alias("n_filled"), F.avg("x").alias("mean_filled"))
    means = significant(out.select("feature", "mean", "mean_filled"))
    return out.drop("mean", "mean_filled").join(means, "feature").withColumn("category", feature_category("feature"))


@query("prediction_audit", sql(PANEL_SQL, """
SELECT 'prob' AS check_name, count(*) - count(prob) AS n_bad, count(*) = count(prob) AS passed FROM panel
UNION ALL SELECT 'close', count(*) - count(close), count(*) = count(close) FROM panel
UNION ALL SELECT 'target', count(*) - count(target), count(*) = count(target) FROM panel
UNION ALL SELECT 'actual_return', count(*) - count(actual_return), count(*) = count(actual_return) FROM panel
UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT (ticker, date)), count(*) = count(DISTINCT (ticker, date)) FROM panel
"""))
def audit_predictions(spark, sf):
    return prediction_audit(panel(spark, sf))


@query("universe_screen", sql(BARS_SQL, f"""
SELECT ticker, count(close) AS n_rows, {_r('min(close)', 6, 'min_close')} FROM bars GROUP BY ticker
HAVING count(close) >= 1500 AND min(close) > 0"""))
def screen(spark, sf):
    return rounded(universe_screen(bars(spark, sf), min_rows=1500))


@query("universe_subset", sql(BARS_SQL + """,
wanted AS (SELECT DISTINCT p_brand AS ticker FROM part WHERE p_size > 48
           UNION SELECT 'Brand#99' UNION SELECT 'Brand#00')""", """
SELECT 'kept' AS status, ticker, count(*) AS n_rows FROM bars
WHERE ticker IN (SELECT ticker FROM wanted) AND ticker <> 'Brand#11'
  AND date BETWEEN DATE '1993-01-01' AND DATE '1997-12-31'
GROUP BY ticker
UNION ALL
SELECT 'missing', ticker, 0 FROM wanted WHERE ticker NOT IN (SELECT ticker FROM bars)"""))
def universe_subset(spark, sf):
    """Requested names in a date range without one excluded name; absent ones are listed."""
    b = bars(spark, sf)
    extra = F.array(F.col("p_brand"), F.lit("Brand#99"), F.lit("Brand#00"))
    wanted = table(spark, sf, "part").filter(F.col("p_size") > 48).select(F.explode(extra).alias("ticker")).distinct()
    kept = without_entity(select_entities(in_range(b, "1993-01-01", "1997-12-31"), wanted), "Brand#11")
    counted = kept.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(F.lit("kept").alias("status"), "ticker", "n_rows").unionByName(
        missing_entities(b, wanted).select(
            F.lit("missing").alias("status"), "ticker", F.lit(0).cast("long").alias("n_rows")))


@query("source_reconciliation", sql(BARS_SQL + """,
nb AS (SELECT p_type AS g, p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice / l_quantity) AS close
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
b AS (SELECT ticker, date, max(close) AS close FROM nb GROUP BY 1, 2),
qa AS (SELECT ticker, CAST(date_trunc('quarter', date) AS DATE) AS period, arg_max(close, date) AS close_a FROM bars GROUP BY 1, 2),
qb AS (SELECT ticker, CAST(date_trunc('quarter', date) AS DATE) AS period, arg_max(close, date) AS close_b FROM b GROUP BY 1, 2)""", f"""
SELECT ticker, period, {_r('close_a', 6, 'close_a')}, {_r('close_b', 6, 'close_b')},
       {_r('abs(close_a / close_b - 1)', 8, 'rel_diff')}, abs(close_a / close_b - 1) <= 0.0005 AS agrees
FROM qa JOIN qb USING (ticker, period)"""))
def source_reconciliation(spark, sf):
    """Closing price against the day's high as a second source, per quarter."""
    b = bars(spark, sf)
    second = b.select("ticker", "date", F.col("high").alias("close"))
    return rounded(reconcile_sources(b, second), {"rel_diff": 8})


@query("benchmark_returns", """
WITH b AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close FROM orders GROUP BY 1)
SELECT date, round(close, 7) AS close, round(close / lag(close) OVER (ORDER BY date) - 1, 8) AS ret
FROM b QUALIFY lag(close) OVER (ORDER BY date) IS NOT NULL""")
def benchmark_returns(spark, sf):
    level = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.avg("o_totalprice").alias("close"))
    return rounded(daily_returns(level), {"close": 7, "ret": 8})


@query("momentum_signal", sql(BARS_SQL, f"""
SELECT ticker, date, {_r('close / lag(close, 252) OVER w - 1', 8, 'momentum')},
       {_r('lead(close, 1) OVER w / close - 1', 8, 'next_return')}
FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)"""))
def momentum_signal(spark, sf):
    return rounded(with_momentum(bars(spark, sf)).select("ticker", "date", "momentum", "next_return"), 8)


@query("factor_text_parse", """
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS a, count(DISTINCT o_custkey) AS b FROM orders GROUP BY 1)
SELECT date, round(a / 100.0::DOUBLE, 6) AS A, CASE WHEN b % 3 <> 0 THEN round(b / 100.0::DOUBLE, 6) END AS B FROM d""")
def factor_text_parse(spark, sf):
    """Daily rows recovered from text that also holds monthly rows, prose and empty fields."""
    o = table(spark, sf, "orders").withColumn("date", F.to_date("o_orderdate"))
    daily = o.groupBy("date").agg(F.count(F.lit(1)).alias("a"), F.countDistinct("o_custkey").alias("b"))
    field = F.when(F.col("b") % 3 != 0, F.col("b").cast("string")).otherwise("")
    lines = daily.select(F.explode(F.array(
        F.concat_ws(",", F.date_format("date", "yyyyMMdd"), F.concat(F.lit("  "), F.col("a").cast("string")), field),
        F.concat_ws(",", F.date_format("date", "yyyyMM"), F.lit("9"), F.lit("9")),
        F.concat(F.lit("Note on "), F.col("date").cast("string")))).alias("value"))
    return rounded(parse_factor_text(lines, ["A", "B"]))


@query("wide_prices_round_trip", sql(BARS_SQL, "SELECT ticker, date, close FROM bars"))
def wide_prices_round_trip(spark, sf):
    """Closing prices to one column per name and back."""
    b = bars(spark, sf)
    wide = long_to_wide(b, entity_names(b))
    return wide_to_long(wide).select("ticker", "date", "close")
