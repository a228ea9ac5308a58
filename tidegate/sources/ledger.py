"""Commit ledger of stored predictions: which (fold, model) is whole, and from what it was made.

An entry opens before a partition's data are written and closes after them, with the number of rows and a fingerprint of
features, members and dates.  A partition counts as done only if its last entry is closed, the fingerprint is the wanted
one and as many rows lie in the folder as the entry says, so a run that was killed while writing, data that were changed
afterwards and a changed feature list are all found out.  Entries are only ever added.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from hashlib import sha256

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidegate.sources.readers import path_exists
from tidegate.sources.writers import write_predictions

KEYS = ("fold", "model")
_ENTRY = "fold int, model string, n_rows long, fingerprint string, at long"


def fingerprint(**facts) -> str:
    """Digest of whatever decides the content of a partition."""
    return sha256(json.dumps(facts, sort_keys=True, default=str).encode()).hexdigest()


def _folder(root: str) -> str:
    return root.rstrip("/") + "/_ledger"   # readers of the data pass over names that start so


def _add(spark: SparkSession, root: str, fold: int, model: str, n_rows: int | None, mark: str) -> None:
    at = time.time_ns()
    entry = spark.createDataFrame([(fold, model, n_rows, mark, at)], _ENTRY).coalesce(1)
    entry.write.parquet(f"{_folder(root)}/{at}-{uuid.uuid4().hex[:8]}")   # a folder of its own: folds are written at once


def entries(spark: SparkSession, root: str) -> DataFrame:
    """The last entry of each (fold, model); ``n_rows`` is NULL where writing was begun and not ended."""
    if not path_exists(spark, _folder(root)):
        return spark.createDataFrame([], _ENTRY)
    rows = spark.read.schema(_ENTRY).parquet(_folder(root) + "/*")
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct("n_rows", "fingerprint", "at"), "at").alias("e")).select(*KEYS, "e.*")


def begin(spark: SparkSession, root: str, fold: int, model: str, mark: str) -> None:
    """From now on the partition is not whole, until ``commit_predictions`` has closed it."""
    _add(spark, root, fold, model, None, mark)


def commit_predictions(df: DataFrame, root: str, fold: int, model: str, mark: str) -> int:
    """Write one partition between the two entries of the ledger; returns its number of rows."""
    spark = df.sparkSession
    begin(spark, root, fold, model, mark)
    seen = Observation()   # counted while they are written: other folds may be written to the same folder meanwhile
    mine = df.filter((F.col("fold") == fold) & (F.col("model") == model))
    write_predictions(mine.observe(seen, F.count(F.lit(1)).alias("n")), root)
    n = seen.get["n"]
    _add(spark, root, fold, model, n, mark)
    return n


def _stored(spark: SparkSession, root: str) -> DataFrame:
    """Rows of each partition; only folder names and file footers are read."""
    if not path_exists(spark, root.rstrip("/") + "/fold=*"):
        return spark.createDataFrame([], "fold int, model string, stored long")
    return spark.read.parquet(root).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("stored"))


def unfinished(spark: SparkSession, wanted: DataFrame, root: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of ``wanted`` (fold, model, fingerprint) that are not stored whole and from the same facts."""
    good = entries(spark, root).filter("n_rows is not null").join(_stored(spark, root), list(keys), "left").filter(
        F.col("n_rows") == F.coalesce("stored", F.lit(0))).select(*keys, "fingerprint")
    return wanted.join(good, [*keys, "fingerprint"], "left_anti")
