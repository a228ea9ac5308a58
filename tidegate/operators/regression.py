"""Factor regressions with HAC errors, any number of books and models at once.

Cross products are summed by Spark, one small row per (book, model); these rows hold systems of at most 7 x 7 numbers, which
are solved by a symmetric sweep in array expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.tails import normal_two_sided

# The factor sets of the four models.
MODELS: Mapping[str, Sequence[str]] = {
    "CAPM": ("Mkt_RF",),
    "FF3": ("Mkt_RF", "SMB", "HML"),
    "FF5": ("Mkt_RF", "SMB", "HML", "RMW", "CMA"),
    "FF5+MOM": ("Mkt_RF", "SMB", "HML", "RMW", "CMA", "Mom"),
}
HAC_LAGS = 5


#: A term whose own share (what the terms before it do not explain) is smaller than this is left out.
TOLERANCE = 1e-12


def _at(matrix: Column, i: Column, j: Column) -> Column:
    return F.get(F.get(matrix, i), j)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _scaled(matrix: Column, scale: Column) -> Column:
    """Each entry times its row's and its column's scale."""
    return F.transform(matrix, lambda row, i: F.transform(row, lambda v, j: v * F.get(scale, i) * F.get(scale, j)))


def sweep(matrix: Column, size: Column) -> Column:
    """Generalised inverse of a symmetric array of arrays with a unit diagonal, by one sweep of each pivot.

    A pivot below ``TOLERANCE`` belongs to a term that depends on those before it: its row and column become 0.
    """
    def pivoted(a: Column, k: Column) -> Column:
        d = _at(a, k, k)
        return F.transform(a, lambda row, i: F.transform(row, lambda v, j: F.when(
            d <= TOLERANCE, F.when((i == k) | (j == k), 0.0).otherwise(v)).when(
            (i == k) & (j == k), -1 / d).when((i == k) | (j == k), v / d).otherwise(v - _at(a, i, k) * _at(a, k, j) / d)))

    swept = F.aggregate(F.sequence(F.lit(0), size - 1), matrix, pivoted)
    return F.transform(swept, lambda row: F.transform(row, lambda v: -v))


def join_factors(five: DataFrame, momentum: DataFrame) -> DataFrame:
    """Momentum attached to the factor days; missing momentum stays NULL."""
    return five.join(momentum, "date", "left")


def factor_regressions(
    returns: DataFrame,
    factors: DataFrame,
    *,
    by: Sequence[str] = ("strategy",),
    value: str = "net_return",
    models: Mapping[str, Sequence[str]] = MODELS,
    risk_free: str = "RF",
    lags: int = HAC_LAGS,
) -> DataFrame:
    """One row per (key, model, term): coefficient, HAC t, p, and model figures.

    A day enters when the return and all factor columns are present.  A factor
    that depends on those before it has coefficient 0 and no ``t``; with no more
    days than independent terms, or a zero error, ``t`` and ``p`` are NULL.
    """
    by = list(by)
    names = [c for c in factors.columns if c not in ("date", risk_free)]
    rows = returns.select(*by, "date", value).join(factors, "date").dropna(subset=[value, risk_free, *names])
    specs = F.array(*[
        F.struct(
            F.lit(m).alias("model"), F.array(F.lit("const"), *[F.lit(f) for f in fs]).alias("terms"),
            F.array(F.lit(1.0), *[F.col(f).cast("double") for f in fs]).alias("x"))
        for m, fs in models.items()
    ])
    rows = rows.select(*by, "date", (F.col(value) - F.col(risk_free)).alias("y"), F.inline(specs))
    keys = [*by, "model"]
    wide = max(len(fs) for fs in models.values()) + 1

    def x(i: int):
        return F.get("x", F.lit(i))

    def matrix(products: dict) -> Column:
        """p x p array; p is the model's number of terms."""
        p = F.size("terms")
        full = F.array(*[F.array(*[products[i, j] for j in range(wide)]) for i in range(wide)])
        return F.transform(F.slice(full, 1, p), lambda r: F.slice(r, 1, p))

    gram = rows.groupBy(*keys).agg(
        F.first("terms").alias("terms"), F.count(F.lit(1)).alias("n"),
        F.avg("y").alias("_ym"), F.var_pop("y").alias("_yv"),
        *[F.sum(x(i) * x(j)).alias(f"g_{i}_{j}") for i in range(wide) for j in range(i, wide)],
        *[F.sum(x(i) * F.col("y")).alias(f"b_{i}") for i in range(wide)],
    )
    gram = gram.select(
        *keys, "terms", "n", "_yv",
        matrix({(i, j): F.col(f"g_{min(i, j)}_{max(i, j)}") for i in range(wide) for j in range(wide)}).alias("xtx"),
        F.slice(F.array(*[F.col(f"b_{i}") for i in range(wide)]), 1, F.size("terms")).alias("xty"))
    size = F.size("terms")
    fitted = gram.withColumn("diag", F.transform("xtx", lambda row, i: F.when(
        F.get(row, i) > 0, 1 / F.sqrt(F.get(row, i))).otherwise(0.0)))
    fitted = fitted.withColumn("inv", _scaled(F.col("xtx"), F.col("diag"))).withColumn("inv", sweep(F.col("inv"), size))
    fitted = fitted.withColumn("inv", _scaled(F.col("inv"), F.col("diag"))).withColumns({
        "beta": F.transform("inv", lambda row: _dot(row, F.col("xty"))),
        "rank": F.size(F.filter(F.transform("inv", lambda row, i: F.get(row, i)), lambda v: v > 0))}).drop("xtx", "xty", "diag")

    resid = rows.join(fitted.select(*keys, "beta"), keys).withColumn(
        "e", F.col("y") - _dot(F.col("x"), F.col("beta")))
    w = Window.partitionBy(*keys).orderBy("date")
    scores = resid.select(*keys, "date", "terms", "e", *[(x(i) * F.col("e")).alias(f"u{i}") for i in range(wide)])
    # u'v + v'u with v the half-weighted current plus weighted lagged scores is the Bartlett sum
    weighted = {}
    for i in range(wide):
        v = F.col(f"u{i}") * 0.5
        for k in range(1, lags + 1):
            v = v + (1 - k / (lags + 1)) * F.coalesce(F.lag(f"u{i}", k).over(w), F.lit(0.0))
        weighted[f"v{i}"] = v
    scores = scores.withColumns(weighted)
    meat = scores.groupBy(*keys).agg(
        F.first("terms").alias("terms"), F.sum(F.col("e") * F.col("e")).alias("ssr"),
        *[F.sum(F.col(f"u{i}") * F.col(f"v{j}")).alias(f"m_{i}_{j}") for i in range(wide) for j in range(wide)])
    meat = meat.select(*keys, "ssr", matrix(
        {(i, j): F.col(f"m_{i}_{j}") for i in range(wide) for j in range(wide)}).alias("meat"))

    def error(row: Column, i: Column) -> Column:
        """From the i-th diagonal entry of inv (meat + its transpose) inv."""
        half = _dot(row, F.transform("meat", lambda m: _dot(m, row)))
        return F.when(F.get(row, i) > 0, F.sqrt(F.greatest(2 * half, F.lit(0.0))))

    n, p = F.col("n"), F.col("rank")
    r2 = 1 - F.col("ssr") / (F.col("_yv") * n)
    out = fitted.join(meat, keys).withColumn("r2_adj", F.when(n > p, 1 - (1 - r2) * (n - 1) / (n - p))).withColumn(
        "se", F.when(n > p, F.transform("inv", error)).otherwise(F.transform("beta", lambda _: F.lit(None).cast("double"))))
    out = out.select(*keys, "n", "r2_adj", F.inline(F.arrays_zip("terms", "beta", "se")))
    out = out.withColumnsRenamed({"terms": "term", "beta": "coef"}).withColumn("t", F.try_divide(F.col("coef"), F.col("se")))
    return out.withColumn("p", normal_two_sided(F.col("t"))).withColumn(
        "annual", F.when(F.col("term") == "const", F.col("coef") * 252)).withColumn("stars", stars("p"))


def stars(p: str):
    return F.when(F.col(p) < 0.01, "***").when(F.col(p) < 0.05, "**").when(F.col(p) < 0.10, "*").otherwise("")
