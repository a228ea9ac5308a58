"""File readers.  Filters and column lists given later reach the scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions.columns import lower_names, nan_to_null, require_columns

BAR_SCHEMA = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("ticker", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)
BAR_COLUMNS = tuple(BAR_SCHEMA.fieldNames())


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Long bar table; column case and common synonyms are accepted, bars without any value are dropped."""
    raw = require_columns(lower_names(spark.read.parquet(path)), BAR_COLUMNS)
    typed = raw.select(
        F.to_date("date").alias("date"), F.col("ticker").cast("string").alias("ticker"),
        *[F.col(c).cast("double").alias(c) for c in BAR_COLUMNS[2:]],
    )
    return nan_to_null(typed).dropna(how="all", subset=list(BAR_COLUMNS[2:]))


def read_bars_per_entity(spark: SparkSession, pattern: str) -> DataFrame:
    """One file per entity, the entity being the file name without extension."""
    raw = lower_names(spark.read.parquet(pattern).withColumn("_file", F.col("_metadata.file_name")))
    typed = require_columns(raw, [c for c in BAR_COLUMNS if c != "ticker"])
    return nan_to_null(typed.select(
        F.to_date("date").alias("date"),
        F.regexp_extract("_file", r"^(.*)\.[^.]+$", 1).alias("ticker"),
        *[F.col(c).cast("double").alias(c) for c in BAR_COLUMNS[2:]],
    )).dropna(how="all", subset=list(BAR_COLUMNS[2:]))


def wide_to_long(prices: DataFrame, time: str = "date") -> DataFrame:
    """Wide table with one price column per entity to (date, ticker, close)."""
    names = [c for c in prices.columns if c != time]
    return (
        prices.select(time, *[F.col(c).cast("double").alias(c) for c in names])
        .unpivot([time], names, "ticker", "close")
        .filter(F.col("close").isNotNull())
    )


def entity_names(bars: DataFrame, most: int = 1000) -> list[str]:
    """Column names for a wide export; more names than a table can be wide raises."""
    names = [r[0] for r in bars.select("ticker").distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} names: stay with the long form")
    return sorted(names)


def long_to_wide(bars: DataFrame, entities: Sequence[str], value: str = "close") -> DataFrame:
    """Export form.  The column list is given, so no distinct scan is needed."""
    return bars.groupBy("date").pivot("ticker", list(entities)).agg(F.first(value))


def read_predictions(spark: SparkSession, root: str) -> DataFrame:
    """Fold-partitioned prediction files; a filter on ``fold`` prunes folders."""
    return nan_to_null(spark.read.parquet(root))


def read_table(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of names, first occurrence of each kept."""
    lines = spark.read.text(path, wholetext=True)
    return (
        lines.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "ticker"))
        .groupBy("ticker").agg(F.min("pos").alias("pos"))
    )


def parse_factor_text(lines: DataFrame, names: Sequence[str], column: str = "value") -> DataFrame:
    """Daily factor rows of a text file with preamble, footer and longer periods.

    A daily row starts with eight digits and a comma; monthly and annual rows
    have six and four, so they drop out with the prose.  Percent to decimal.
    """
    fields = F.split(F.col(column), ",")
    parsed = (
        lines.filter(F.trim(F.col(column)).rlike(r"^\d{8},"))
        .select(
            F.to_date(F.trim(fields[0]), "yyyyMMdd").alias("date"),
            *[
                (F.trim(F.get(fields, F.lit(i + 1))).try_cast("double") / 100).alias(n)
                for i, n in enumerate(names)
            ],
        )
    )
    return parsed.dropna(how="all", subset=list(names))


def read_factor_text(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    return parse_factor_text(spark.read.text(path), names)


def first_available(spark: SparkSession, *sources: tuple[str, Callable[[SparkSession, str], DataFrame]]) -> DataFrame:
    """The first source whose path holds data; later ones are not touched."""
    tried = []
    for path, reader in sources:
        if path_exists(spark, path):
            return reader(spark, path)
        tried.append(path)
    raise FileNotFoundError(f"no source among {tried}")


def path_exists(spark: SparkSession, pattern: str) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(path)
    return found is not None and len(found) > 0
