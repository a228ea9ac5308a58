"""Importance resampling: documents are drawn with probabilities that lean towards a target's distribution of features.

1. Features are single words and pairs of neighbours, hashed to ``buckets``; each task sums its counts in an array, and the
   sums of all tasks are one row for each bucket.  The logarithm of the ratio of a bucket's shares in target and corpus is
   its gain: an array of fixed size that goes to the tasks.  A document's weight is the mean gain of its features, looked up
   in that array; with a Gumbel draw from a digest of its id, the largest scores are a weighted sample without replacement.
2. The cutoff is found without sorting: in each round every task gives the median of its remaining keys and their number,
   the driver takes the weighted median of these, and one count tells on which side of it the cutoff lies.  At least a quarter
   of the remaining keys is discarded in each round, whatever the distribution.  When no more are left than one task's
   median needs, they are put in order and the exact key is read off.  What remains is written anew once it has shrunk.
3. Only the winners are sorted, by ranges, and numbered from the ranges' sizes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import written
from tidegate.llm.words import blocks

BUCKETS = 10_000
#: So many remaining keys are put in order on the driver.
FEW = 4_096
#: Remaining keys are written anew when they are this many times fewer than the table they are read from.
SHRUNK = 8
#: Bytes of a text whose words are held at once.
PIECE_BYTES = 1 << 20

#: Digits, small letters (and capitals, made small) and all bytes of non-ASCII characters are kept, others part words.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_KEYS = pa.schema([("score", pa.int64()), ("doc_id", pa.int64()), ("row", pa.binary())])


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in runs of about a megabyte; no word is cut."""
    start = 0
    while start < len(text):
        end = start + PIECE_BYTES
        end = text.find(b" ", end) if end < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def feature_buckets(text: str | None, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of single words and pairs) of the runs of a text; the pair across two runs is with the second."""
    last = None
    for words in _pieces((text or "").encode("utf-8").translate(_PLAIN)):
        if not words:
            continue
        single = list(map(crc32, words))
        heads = single[:-1] if last is None else [last, *single[:-1]]
        tails = words[1:] if last is None else words
        pairs = list(map(crc32, tails, map(crc32, repeat(b" "), heads)))
        last = single[-1]
        yield len(words), np.array(single + pairs, np.int64) % buckets


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's features occur in all texts: one array per task, summed by bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in blocks(batch):
                for text in block.column("text").to_pylist():
                    for _, found in feature_buckets(text, buckets):
                        total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths, with one occurrence more in every bucket."""
    n = len(corpus)
    s_all, t_all = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(
        corpus.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """A Gumbel draw in thousandths from a digest of the id; a null id counts as an empty one."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = 7) -> DataFrame:
    """``doc_id, row, n_words, n_features, weight, score`` of each row; ``row`` is a digest of the text."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                ids, out = block.column("doc_id").to_pylist(), []
                for doc_id, text in zip(ids, block.column("text").to_pylist()):
                    n_words = n = total = 0
                    for words, found in feature_buckets(text, len(gain)):
                        n_words, n, total = n_words + words, n + len(found), total + int(gain[found].sum())
                    weight = total // n if n else 0
                    row = sha256((text or "").encode()).digest()[:16]
                    out.append((row, n_words, n, weight, weight + gumbel(doc_id, seed)))
                columns = list(zip(*out)) or [()] * 5
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id").cast(pa.int64()), *map(pa.array, columns, kinds)],
                    names=["doc_id", "row", "n_words", "n_features", "weight", "score"])
    return docs.select("doc_id", "text").mapInArrow(
        score, "doc_id long, row binary, n_words long, n_features long, weight long, score long")


def _before(key: tuple) -> Column:
    """Rows whose key comes before this one: larger score, smaller id (null ids last), smaller row digest."""
    score, doc, row = key
    tie = F.col("row") < F.lit(bytes(row))
    same_doc = F.col("doc_id").isNull() if doc is None else F.col("doc_id") == doc
    less_doc = F.col("doc_id").isNotNull() if doc is None else F.col("doc_id") < doc
    return (F.col("score") > score) | ((F.col("score") == score) & F.coalesce(less_doc | (same_doc & tie), F.lit(False)))


def _order(key: tuple) -> tuple:
    score, doc, row = key
    return -score, doc is None, doc or 0, bytes(row)


def _sorted_by() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]


def _same(key: tuple) -> Column:
    score, doc, row = key
    return (F.col("score") == score) & F.col("doc_id").eqNullSafe(F.lit(doc)) & (F.col("row") == F.lit(bytes(row)))


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The middle key of a task's rows (the lower one of two), and their number."""
    rows = pa.concat_tables([_KEYS.empty_table(), *(pa.Table.from_batches([b]).cast(_KEYS) for b in batches)])
    if rows.num_rows:
        rows = rows.combine_chunks().sort_by([("score", "descending"), ("doc_id", "ascending"), ("row", "ascending")])
        middle = rows.slice((rows.num_rows - 1) // 2, 1)
        yield from middle.append_column("n", pa.array([rows.num_rows], pa.int64())).to_batches()


def cutoff(keys: DataFrame, k: int, few: int = FEW) -> tuple | None:
    """The k-th key (``score, doc_id, row``) in order, counted from 1; None for k = 0.

    ``keys`` is a written table.  Repeated keys count as often as they stand there.
    """
    if k <= 0:
        return None
    left = keys.select("score", "doc_id", "row")
    n = size = left.count()
    while n > few:
        middles = [(_order((r.score, r.doc_id, r.row)), (r.score, r.doc_id, r.row), r.n) for r in left.mapInArrow(
            _medians, "score long, doc_id long, row binary, n long").collect()]
        middles.sort(key=lambda m: m[0])
        seen, pivot = 0, middles[-1][1]
        for _, key, count in middles:
            seen += count
            if 2 * seen >= n:
                pivot = key
                break
        before, equal = _before(pivot), _same(pivot)
        less, same = left.agg(F.count_if(before), F.count_if(equal)).first()
        if less < k <= less + same:
            return pivot
        if k <= less:
            left, n = left.filter(before), less
        else:
            left, n, k = left.filter(~before & ~equal), n - less - same, k - less - same
        if n * SHRUNK <= size:
            left, size = written(left, "remaining-keys"), n
    rows = sorted((tuple(r) for r in left.collect()), key=_order)
    return rows[k - 1]


def resampled(docs: DataFrame, target: DataFrame, share: int = 25, min_words: int = 20, buckets: int = BUCKETS,
              seed: int = 7) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of each row of ``docs``; ``rank`` is null for those not drawn.

    Of the N rows with at least ``min_words`` words the floor(N * share / 100) largest scores are drawn, ties to the
    smaller id, then (repeated ids; null ids are the largest) to the smaller digest of the text; equal rows are drawn in no
    order of their own.  Null and empty texts have no features and weight 0.  An empty target has gains of an even
    distribution; an empty table gives an empty result.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = written(scored(docs, gain, seed), "scores")
    able = rows.filter(F.col("n_words") >= min_words)
    k = able.count() * share // 100
    last = cutoff(able, k)
    names = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return rows.select(*names, none)
    wins = (F.col("n_words") >= min_words) & (_before(last) | _same(last))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the high bits of the number are those of the range, the low ones the place in it; written, so that they stay
    order = written(rows.filter(wins).repartitionByRange(parts, *_sorted_by()).sortWithinPartitions(*_sorted_by())
                    .select(*names, F.monotonically_increasing_id().alias("place")), "winners")
    part = F.shiftright("place", 33)
    sizes = sorted((r.part, r.n) for r in order.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    starts = rows.sparkSession.createDataFrame(starts, "part long, start long")
    rank = F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    drawn = order.withColumn("part", part).join(F.broadcast(starts), "part").select(
        *names, F.when(rank <= k, rank).alias("rank"))
    return drawn.unionByName(rows.filter(~wins).select(*names, none))
