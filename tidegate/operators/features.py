"""The 49 causal per-entity features, the label and the realised return.

Shifts count rows, not calendar days.  Every window shares one partitioning and
ordering, so the rolling features cost a single shuffle by entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.columns import EPS, change, ratio, rolling, series, so_far
from tidegate.operators.ewm import Ewm, ewm_mean

# The names of the 49 features.
ROLLING_FEATURES = (
    "BB_upper", "BB_lower", "BB_mid", "BB_width", "BB_pct_b", "OBV",
    "SMA_50", "SMA_200", "price_to_SMA200", "price_to_SMA50",
    "return_1d", "return_2d", "return_3d", "return_5d", "return_10d", "return_21d",
    "volume_zscore_5d", "volume_zscore_21d",
    "OC_body_norm", "upper_shadow_ratio", "lower_shadow_ratio", "HL_range_norm",
    "rolling_vol_5d", "rolling_vol_21d", "rolling_vol_63d",
    "stoch_K", "stoch_D", "Williams_R", "CCI_20", "MFI_14", "ROC_10", "ROC_21", "DPO_20",
    "VWAP_deviation",
)
SMOOTHED_FEATURES = (
    "RSI_14", "RSI_21", "MACD_12_26", "MACD_signal_9", "MACD_hist", "ATR_14", "ATR_21",
    "OBV_EMA", "EMA_9", "EMA_21", "EMA_50", "EMA_200", "ADX_14", "DI_plus", "DI_minus",
)
FEATURES = ROLLING_FEATURES + SMOOTHED_FEATURES


def _total(x: str, w, n: int, times: int) -> Column:
    """Sum over ``times`` adjoining windows of ``n`` rows, NULL if any is NULL.

    ``x`` holds the sum over the last ``n`` rows; a long window is put together
    from short ones, so its cost per row does not grow with its length.
    """
    total = F.col(x)
    for i in range(1, times):
        total = total + F.lag(x, i * n).over(w)
    return total


def long_average(df: DataFrame, out: str, parts: tuple[int, ...], *, column: str = "close",
                 entity: str = "ticker", time: str = "date") -> DataFrame:
    """Moving average over ``prod(parts)`` rows, put together from short sums."""
    w = series(entity, time)
    df = df.withColumn("_sum", rolling(F.sum, F.col(column), w, parts[0]))
    n = parts[0]
    for times in parts[1:]:
        df = df.withColumn("_sum", _total("_sum", w, n, times))
        n *= times
    return df.withColumn(out, F.col("_sum") / n).drop("_sum")


def _moments(prefix: str, w, n: int, times: int) -> tuple[Column, Column]:
    """Sum and squared deviations over ``times`` adjoining windows of ``n`` rows.

    Windows are merged by their means, so a flat series gives exactly 0.
    """
    sums = [F.col(f"{prefix}{n}_s")] + [F.lag(f"{prefix}{n}_s", i * n).over(w) for i in range(1, times)]
    devs = [F.col(f"{prefix}{n}_q")] + [F.lag(f"{prefix}{n}_q", i * n).over(w) for i in range(1, times)]
    total = sum(sums[1:], sums[0])
    mean = total / (n * times)
    spread = sum(devs[1:], devs[0])
    for part in sums:
        spread = spread + n * (part / n - mean) * (part / n - mean)
    return total, spread


def _sd(spread: str, n: int) -> Column:
    return F.sqrt(F.col(spread) / (n - 1))


def _inputs(bars: DataFrame, entity: str, time: str) -> DataFrame:
    """Row-level series the indicators are built from."""
    w = series(entity, time)
    c, h, l = F.col("close"), F.col("high"), F.col("low")
    lagged = bars.withColumns({
        "_v": F.when(F.col("volume") != 0, F.col("volume")),
        "_tp": (h + l + c) / 3,
        "_pc": F.lag("close").over(w), "_ph": F.lag("high").over(w), "_pl": F.lag("low").over(w),
    })
    return lagged.withColumns({
        "_d": c - F.col("_pc"),
        "_lr": F.log(ratio(c, F.col("_pc"))),
        "_dtp": F.col("_tp") - F.lag("_tp").over(w),
        "_tr": F.greatest(h - l, F.abs(h - F.col("_pc")), F.abs(l - F.col("_pc"))),
        "_up": h - F.col("_ph"), "_down": F.col("_pl") - l,
        "_tpv": F.col("_tp") * F.col("_v"),
    })


def _obv(w) -> Column:
    """Signed volume so far; NULL on rows without volume."""
    signed = F.coalesce(F.signum("_d"), F.lit(0.0)) * F.col("_v")
    return F.when(F.col("_v").isNotNull(), F.sum(signed).over(so_far(w)))


def rolling_features(bars: DataFrame, *, entity: str = "ticker", time: str = "date") -> DataFrame:
    """Features that need only lags and fixed-length windows."""
    base = bars.columns
    w = series(entity, time)
    c, o, h, l, v, tp = (F.col(x) for x in ("close", "open", "high", "low", "_v", "_tp"))
    span = h - l + EPS
    p = _inputs(bars, entity, time).withColumns({
        "_pos": F.when(F.col("_dtp") > 0, F.col("_tpv")).otherwise(0.0),
        "_neg": F.when(F.col("_dtp") < 0, F.col("_tpv")).otherwise(0.0),
        "OC_body_norm": (c - o) / span,
        "upper_shadow_ratio": (h - F.greatest(o, c)) / span,
        "lower_shadow_ratio": (F.least(o, c) - l) / span,
        "HL_range_norm": span / (c + EPS),
    })
    # short windows
    p = p.withColumns({
        **{f"{x}{n}_s": rolling(F.sum, F.col(x), w, n)
           for x, n in (("close", 5), ("_v", 5), ("_v", 7), ("_lr", 5), ("_lr", 7), ("_tpv", 5),
                        ("_tp", 5), ("_pos", 7), ("_neg", 7))},
        **{f"{x}{n}_q": rolling(F.var_pop, F.col(x), w, n) * n
           for x, n in (("close", 5), ("_v", 5), ("_v", 7), ("_lr", 5), ("_lr", 7))},
        "_ll7": rolling(F.min, l, w, 7), "_hh7": rolling(F.max, h, w, 7),
        "OBV": _obv(w),
        **{f"return_{n}d": change("close", w, n) for n in (1, 2, 3, 5, 10, 21)},
        "_c11": F.lag("close", 11).over(w),
    })
    # medium windows
    c20, v21, r21 = _moments("close", w, 5, 4), _moments("_v", w, 7, 3), _moments("_lr", w, 7, 3)
    ll7, hh7 = F.lag("_ll7", 7).over(w), F.lag("_hh7", 7).over(w)
    p = p.withColumns({
        "_close20_s": c20[0], "_close20_q": c20[1], "_v21_s": v21[0], "_v21_q": v21[1],
        "_lr21_s": r21[0], "_lr21_q": r21[1],
        "_close10_s": _total("close5_s", w, 5, 2), "_v20_s": _total("_v5_s", w, 5, 4),
        "_tpv20_s": _total("_tpv5_s", w, 5, 4), "_tpm": _total("_tp5_s", w, 5, 4) / 20,
        "_pos14": _total("_pos7_s", w, 7, 2), "_neg14": _total("_neg7_s", w, 7, 2),
        "_ll": F.when(ll7.isNotNull() & F.col("_ll7").isNotNull(), F.least("_ll7", ll7)),
        "_hh": F.when(hh7.isNotNull() & F.col("_hh7").isNotNull(), F.greatest("_hh7", hh7)),
    }).withColumns({
        "BB_mid": F.col("_close20_s") / 20,
        "stoch_K": 100 * (c - F.col("_ll")) / (F.col("_hh") - F.col("_ll") + EPS),
        "Williams_R": -100 * (F.col("_hh") - c) / (F.col("_hh") - F.col("_ll") + EPS),
        "MFI_14": 100 - 100 / (1 + F.col("_pos14") / (F.col("_neg14") + EPS)),
        "volume_zscore_5d": (v - F.col("_v5_s") / 5) / (_sd("_v5_q", 5) + EPS),
        "volume_zscore_21d": (v - F.col("_v21_s") / 21) / (_sd("_v21_q", 21) + EPS),
        "_vw": ratio(F.col("_tpv20_s"), F.col("_v20_s")),
    })
    # long windows
    r63 = _moments("_lr", w, 21, 3)
    off_mean = F.abs(tp - F.col("_tpm"))
    for i in range(1, 20):
        off_mean = off_mean + F.abs(F.lag("_tp", i).over(w) - F.col("_tpm"))
    p = p.withColumns({
        "SMA_50": _total("_close10_s", w, 10, 5) / 50,
        "SMA_200": _total("_close20_s", w, 20, 10) / 200,
        "_lr63_q": r63[1],
        "DPO_20": F.col("_c11") - F.lag("BB_mid", 11).over(w),
        "stoch_D": _total("stoch_K", w, 1, 3) / 3,
        "_mad": off_mean / 20,
    })
    band = 2 * _sd("_close20_q", 20)
    return p.select(
        *base, (F.col("BB_mid") + band).alias("BB_upper"), (F.col("BB_mid") - band).alias("BB_lower"), "BB_mid",
        (2 * band / (F.col("BB_mid") + EPS)).alias("BB_width"),
        ((c - F.col("BB_mid") + band) / (2 * band + EPS)).alias("BB_pct_b"),
        "OBV", "SMA_50", "SMA_200",
        (c / (F.col("SMA_200") + EPS)).alias("price_to_SMA200"),
        (c / (F.col("SMA_50") + EPS)).alias("price_to_SMA50"),
        *[f"return_{n}d" for n in (1, 2, 3, 5, 10, 21)],
        "volume_zscore_5d", "volume_zscore_21d",
        "OC_body_norm", "upper_shadow_ratio", "lower_shadow_ratio", "HL_range_norm",
        _sd("_lr5_q", 5).alias("rolling_vol_5d"), _sd("_lr21_q", 21).alias("rolling_vol_21d"),
        _sd("_lr63_q", 63).alias("rolling_vol_63d"),
        "stoch_K", "stoch_D", "Williams_R",
        ((tp - F.col("_tpm")) / (0.015 * F.col("_mad") + EPS)).alias("CCI_20"),
        "MFI_14",
        (100 * F.col("return_10d")).alias("ROC_10"), (100 * F.col("return_21d")).alias("ROC_21"),
        "DPO_20",
        ((c - F.col("_vw")) / (F.col("_vw") + EPS)).alias("VWAP_deviation"),
    )


def smoothed_features(bars: DataFrame, *, entity: str = "ticker", time: str = "date",
                      gaps: bool = True) -> DataFrame:
    """Features built on exponentially weighted means.

    ``gaps=False`` states that no price and no volume is NULL or zero, as in bars
    built from trades; the means then take a shorter path.
    """
    base = bars.columns
    w = series(entity, time)
    d, up, down = F.col("_d"), F.col("_up"), F.col("_down")
    p = _inputs(bars, entity, time).withColumns({
        "_gain": F.greatest(d, F.when(d.isNotNull(), 0.0)),
        "_loss": F.greatest(-d, F.when(d.isNotNull(), 0.0)),
        "_pdm": F.when((up > down) & (up > 0), up).otherwise(0.0),
        "_mdm": F.when((down > up) & (down > 0), down).otherwise(0.0),
        "_obv": _obv(w),
    })
    keep = [*base, "_gain", "_loss", "_pdm", "_mdm", "_tr", "_obv"]
    def means(frame: DataFrame, *specs: Ewm) -> DataFrame:
        return ewm_mean(frame, [m._replace(gaps=gaps) for m in specs], entity=entity, time=time)

    p = means(
        p.select(*keep),
        Ewm.wilder("_g14", "_gain", 14, 2), Ewm.wilder("_l14", "_loss", 14, 2),
        Ewm.wilder("_g21", "_gain", 21, 2), Ewm.wilder("_l21", "_loss", 21, 2),
        Ewm.span("_e12", "close", 12), Ewm.span("_e26", "close", 26),
        Ewm.span("EMA_9", "close", 9), Ewm.span("EMA_21", "close", 21),
        Ewm.span("EMA_50", "close", 50), Ewm.span("EMA_200", "close", 200),
        Ewm.wilder("ATR_14", "_tr", 14), Ewm.wilder("ATR_21", "_tr", 21),
        Ewm.span("OBV_EMA", "_obv", 21),
        Ewm.wilder("_p14", "_pdm", 14), Ewm.wilder("_m14", "_mdm", 14),
    )
    p = p.withColumns({
        "MACD_12_26": F.col("_e12") - F.col("_e26"),
        "DI_plus": 100 * F.col("_p14") / (F.col("ATR_14") + EPS),
        "DI_minus": 100 * F.col("_m14") / (F.col("ATR_14") + EPS),
    }).withColumn(
        "_dx", 100 * F.abs(F.col("DI_plus") - F.col("DI_minus"))
        / (F.col("DI_plus") + F.col("DI_minus") + EPS))
    p = means(p, Ewm.span("MACD_signal_9", "MACD_12_26", 9, 26), Ewm.wilder("ADX_14", "_dx", 14, 14))

    def rsi(n: int) -> Column:
        return 100 - 100 / (1 + F.col(f"_g{n}") / (F.col(f"_l{n}") + EPS))

    return p.select(
        *base, rsi(14).alias("RSI_14"), rsi(21).alias("RSI_21"),
        "MACD_12_26", "MACD_signal_9", (F.col("MACD_12_26") - F.col("MACD_signal_9")).alias("MACD_hist"),
        "ATR_14", "ATR_21", "OBV_EMA", "EMA_9", "EMA_21", "EMA_50", "EMA_200",
        "ADX_14", "DI_plus", "DI_minus",
    )


def all_features(bars: DataFrame, *, entity: str = "ticker", time: str = "date",
                 gaps: bool = True) -> DataFrame:
    return rolling_features(
        smoothed_features(bars, entity=entity, time=time, gaps=gaps), entity=entity, time=time)


def with_target(df: DataFrame, *, entity: str = "ticker", time: str = "date") -> DataFrame:
    """1 when the value two rows ahead exceeds the value one row ahead, else 0."""
    w = series(entity, time)
    one, two = F.lead("close", 1).over(w), F.lead("close", 2).over(w)
    return df.withColumn("target", F.when(one.isNotNull() & two.isNotNull(), (two > one).cast("double")))


def with_holding_return(df: DataFrame, *, entity: str = "ticker", time: str = "date",
                        out: str = "actual_return") -> DataFrame:
    """Return from one row ahead to two rows ahead, on the rows of ``df``."""
    w = series(entity, time)
    return df.withColumn(out, ratio(F.lead("close", 2).over(w), F.lead("close", 1).over(w)) - 1)


def with_momentum(df: DataFrame, n: int = 252, *, entity: str = "ticker", time: str = "date") -> DataFrame:
    """Trailing ``n``-row change and the next row's return."""
    w = series(entity, time)
    return df.withColumns({
        "momentum": change("close", w, n),
        "next_return": ratio(F.lead("close", 1).over(w), F.col("close")) - 1,
    })


def model_panel(bars: DataFrame, *, entity: str = "ticker", time: str = "date",
                gaps: bool = True) -> DataFrame:
    """Feature panel with label, warm-up and unlabelled rows removed."""
    labelled = with_target(
        all_features(bars, entity=entity, time=time, gaps=gaps), entity=entity, time=time)
    return labelled.dropna(subset=list(FEATURES)).dropna(subset=["target"])
