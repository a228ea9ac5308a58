"""Global shuffle of a corpus into shards, in two passes.

1. *Scatter.*  Each row goes to a bucket by a seeded hash of its id and text; there are as many buckets as it takes for
   one to fit in a task's memory (``BUCKET_BYTES`` on average).
2. *Shuffle.*  Each bucket is put in id order, permuted by a Fisher-Yates shuffle seeded by the bucket, and written.

Buckets stand one after the other, so a row's position in the whole order is its place in the bucket plus the rows of the
buckets before.  The order is cut into shards of equal numbers of rows, at most one apart (the ``rows`` law).  Every step
depends on rows and seed alone, so a task that runs again writes the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidegate.llm.common import new_folder, written

BUCKET_BYTES = 16 << 20
#: Rows of a bucket on average, at most, however short their texts are.
BUCKET_ROWS = 1 << 17
SEED = 20_240
#: Buckets whose counts are summed in one task.
SPAN = 4_096


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of 0..n-1: from the last place down, swap with a place at or before it."""
    rng = np.random.Generator(np.random.PCG64([seed, bucket]))
    order = np.arange(n)
    partners = rng.integers(0, np.arange(n, 0, -1), dtype=np.int64) if n else order
    held = order.tolist()
    for place, partner in zip(range(n - 1, 0, -1), partners.tolist()):
        held[place], held[partner] = held[partner], held[place]
    return np.array(held, np.int64)


def bucket_count(rows: int, text: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for so many rows with so many bytes of text."""
    return max(1, -(-text // bucket_bytes), -(-rows // BUCKET_ROWS))


def bucket_starts(counts: DataFrame) -> DataFrame:
    """(bucket, first): rows in the buckets before; ``counts`` is (bucket, n).  Summed in spans of buckets."""
    spans = counts.withColumn("span", F.floor(F.col("bucket") / SPAN))
    total, bases = 0, []
    for r in spans.groupBy("span").agg(F.sum("n").alias("n")).orderBy("span").collect():  # one row per SPAN buckets
        bases.append((r.span, total))
        total += r.n
    before = Window.partitionBy("span").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.sparkSession.createDataFrame(bases, "span long, base long")
    return spans.join(base, "span").select(
        "bucket", (F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("first"))


def shuffled(docs: DataFrame, shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, in order of slots within each task.

    Slots of a shard are gapless from 0.  Nulls are hashed and sorted like any value (first); rows equal in id and text
    fall into one bucket and stay in any order.  Columns named ``shard`` or ``slot`` are replaced; others pass through.
    """
    docs = docs.drop("shard", "slot")
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    buckets = bucket_count(size.n, int(size.b or 0), bucket_bytes)
    rows = docs.toDF(*names).withColumns({
        "tie": F.xxhash64(text), "bucket": F.pmod(F.xxhash64(F.lit(seed), key, text), F.lit(buckets)).cast("long")})
    starts = written(bucket_starts(written(rows.groupBy("bucket").agg(F.count("*").alias("n")), "counts")), "starts")
    n = size.n

    def place(rows: pa.Table, start: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        rows = rows.sort_by([(key, "ascending"), ("tie", "ascending")])
        rows = rows.take(pa.array(fisher_yates(rows.num_rows, seed, rows.column("bucket")[0].as_py())))
        at = start.column("first")[0].as_py() + np.arange(rows.num_rows)
        shard = at * shards // n
        slot = at - -(-shard * n // shards)
        return pa.table([rows.column(c) for c in names] + [pa.array(shard.astype(np.int32)), pa.array(slot)], schema=schema)

    out = rows.select(*names, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).schema
    schema = to_arrow_schema(out)
    placed = rows.groupBy("bucket").cogroup(starts.groupBy("bucket")).applyInArrow(place, out)
    return placed.toDF(*docs.columns, "shard", "slot")


def write_shards(docs: DataFrame, folder: str, **how) -> DataFrame:
    """Write ``shuffled`` rows to a folder for each shard and read them back."""
    placed = shuffled(docs, **how)
    placed.write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.schema(placed.schema).parquet(folder)


def digest(docs: DataFrame, shards: int = 8) -> DataFrame:
    """What the written shards hold: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    text = F.coalesce("text", F.lit(""))
    return write_shards(docs, new_folder(docs.sparkSession, "shards"), shards=shards).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
