"""Window shorthands, guarded arithmetic, null handling and name helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

# Added to denominators so that a flat series gives a finite feature.
EPS = 1e-10

# Columns of a feature panel that are not features.
NON_FEATURES = (
    "date", "ticker", "open", "high", "low", "close", "volume", "target",
    "actual_return", "row_index",
)

# The first entry whose fragment occurs in the lower-cased name wins.
FEATURE_CATEGORIES = (
    (("vol", "atr", "bb_width"), "Volatility"),
    (("ema", "sma", "ma"), "Trend / MA"),
    (("macd", "roc", "dpo", "return"), "Momentum"),
    (("volume", "vwap", "mfi"), "Volume"),
    (("bb", "williams", "stoch"), "Oscillator"),
)


def series(entity: str, time: str) -> WindowSpec:
    """One entity's rows in time order.

    A panel holds at most one row per entity and time step, so a partition is
    never longer than the calendar, however many entities there are.
    """
    return Window.partitionBy(entity).orderBy(time)


def last_rows(window: WindowSpec, n: int) -> WindowSpec:
    return window.rowsBetween(-(n - 1), 0)


def so_far(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, 0)


def rolling(fn: Callable[[Column], Column], x: Column, window: WindowSpec, n: int) -> Column:
    """``fn`` over the last ``n`` rows, NULL unless all ``n`` values are present."""
    frame = last_rows(window, n)
    return F.when(F.count(x).over(frame) == n, fn(x).over(frame))


def change(x: str | Column, window: WindowSpec, k: int) -> Column:
    """Relative change against the value ``k`` rows back (ahead when negative)."""
    x = F.col(x) if isinstance(x, str) else x
    return F.try_divide(x, F.lag(x, k).over(window)) - 1


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NULL when ``b`` is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN marks a missing value in files written from arrays; SQL uses NULL."""
    names = columns or [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names})


def finite_or_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    inf = float("inf")
    return df.withColumns({
        c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == inf), 0.0).otherwise(F.col(c))
        for c in columns
    })


def lower_names(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Lower-case all column names, then map synonyms (``symbol`` to ``ticker``)."""
    aliases = {"symbol": "ticker", "datetime": "date"} | (aliases or {})
    return df.withColumnsRenamed({c: aliases.get(c.lower(), c.lower()) for c in df.columns})


def feature_columns(df: DataFrame, exclude: Iterable[str] = NON_FEATURES) -> list[str]:
    skip = set(exclude)
    return [c for c in df.columns if c not in skip]


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def feature_category(name: str | Column) -> Column:
    low = F.lower(F.col(name) if isinstance(name, str) else name)
    expr = None
    for fragments, label in FEATURE_CATEGORIES:
        hit = None
        for fragment in fragments:
            found = low.contains(fragment)
            hit = found if hit is None else hit | found
        expr = F.when(hit, label) if expr is None else expr.when(hit, label)
    return expr.otherwise("Other")


def stack_rows(names: Sequence[str], *rows: Sequence) -> Column:
    """Generator of one output row per tuple, all with the same column names."""
    return F.inline(F.array(*[
        F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(names, row)]) for row in rows]))


def numbers(first: int | Column, last: int | Column) -> Column:
    """Generator of the 64-bit integers from first to last."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    return F.explode(F.sequence(a.cast("long"), b.cast("long")))


def spread_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Hash rows over the session's shuffle partitions.

    For work that is heavy per row: adaptive execution merges partitions by
    their bytes and would leave a few small, slow ones.  Windows and groupings
    on the same keys reuse this distribution.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
