"""Removal of word passages that stand in a document with a smaller id.

Windows grow level by level: 25 words, then twice that for what was repeated.

1. Each window of ``words`` words is named by the smallest hash of the half-length windows in it, so equal windows have
   equal names wherever they stand.  Consecutive windows of one name form a *run*; a run is stored with its name, its
   place and a 128-bit hash of all the words it spans.
2. Half length: names that occur in one document alone drop out with their runs.
3. Full length: a surviving run whose whole span stands in a smaller document is settled at once, with all its windows.
   This takes care of whole copies and shared passages with one row for about 13 words.
4. What is left at the ends of common passages is compared window by window, by 128-bit hashes; of the documents that
   hold the other side only the first with a run is asked, and only for names that are still in question.

Longer windows need no level of their own: the words covered by repeated windows of more than ``words`` words are
covered by repeated windows of ``words`` words.  Counts and minima are combined before each shuffle, and joins on hashes
are left to adaptive skew handling, so a passage that a third of all documents share is split over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import list_array, written
from tidegate.llm.words import U64, Words, blocks, mix, signed, span_hashes, window_hashes, words_of

_RUNS = ("doc_id long, k long, n_words long, sha string, a array<long>, p array<int>, m array<int>, "
         "h1 array<long>, h2 array<long>")


def sliding_min(g: np.ndarray, size: int) -> np.ndarray:
    width, low = 1, g
    while width * 2 <= size:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = size - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def runs_of(words, size: int):
    """(row, first window, number of windows, name) of every run of a block."""
    half = size // 2
    none = np.zeros(0, np.int64)
    if len(words.hash) < size:
        return none, none, none, np.zeros(0, U64)
    names = sliding_min(window_hashes(words.hash, half), size - half + 1)
    row = words.row()
    within = np.flatnonzero(row[: len(names)] == row[size - 1:])
    if not len(within):
        return none, none, none, np.zeros(0, U64)
    name, at = names[within], row[within]
    new = np.ones(len(within), bool)
    new[1:] = (name[1:] != name[:-1]) | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    return at[first], within[first], np.diff(np.append(first, len(within))), name[first]


def _runs(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                w = words_of(block.column("text"))
                row, start, count, name = runs_of(w, size)
                per_row = np.bincount(row, minlength=block.num_rows)
                shas = [sha256(b" ".join(w.data[w.offsets[i]: w.offsets[i + 1]].tobytes().split())).hexdigest()
                        for i in range(block.num_rows)]
                span = count + size - 1
                longs = [list_array(signed(x), per_row, pa.int64()) for x in (
                    name, span_hashes(w.hash, start, span, 0), span_hashes(w.hash, start, span, 1))]
                ints = [list_array(x.astype(np.int32), per_row, pa.int32()) for x in (start - w.first[row], count)]
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), block.column("k"), pa.array(w.n.astype(np.int64)), pa.array(shas),
                     longs[0], *ints, *longs[1:]],
                    names=["doc_id", "k", "n_words", "sha", "a", "p", "m", "h1", "h2"])
    return run


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                w = words_of(block.column("text"))
                asked = block.column("runs")
                row = np.repeat(np.arange(block.num_rows), asked.value_lengths().to_numpy())
                flat = asked.flatten()
                p, m = (flat.field(x).to_numpy() for x in ("p", "m"))
                target = flat.field("target").to_numpy(zero_copy_only=False)
                inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                place = np.repeat(p, m) + inner
                at = w.first[np.repeat(row, m)] + place
                doc = block.column("doc_id").to_numpy()[np.repeat(row, m)]
                keys = block.column("k").take(pa.array(np.repeat(row, m)))
                hashes = [signed(window_hashes(w.hash, size, which)[at]) for which in (0, 1)]
                out = pa.RecordBatch.from_arrays(
                    [pa.array(doc), keys, pa.array(place.astype(np.int32)), pa.array(np.repeat(target, m)),
                     *map(pa.array, hashes)], names=["doc_id", "k", "p", "target", "h1", "h2"])
                for i in range(0, out.num_rows, 50_000):
                    yield out.slice(i, 50_000)
    return run


def _kept(w: Words, spans: pa.Array, size: int) -> np.ndarray:
    """Which words of a block no span covers; a span is (first window start, number of starts)."""
    row = np.repeat(np.arange(len(spans)), pc.fill_null(spans.value_lengths(), 0).to_numpy())
    p, m = (spans.flatten().field(x).to_numpy() for x in ("p", "m"))
    start = w.first[row] + p
    edge = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + m + size - 1, -1)
    return np.cumsum(edge[:-1]) == 0


def _kept_bytes(w: Words, keep: np.ndarray, i: int) -> bytes:
    chosen = np.flatnonzero(keep[w.first[i]: w.first[i + 1]]) + w.first[i]
    base = w.offsets[i]
    text = w.data[base: w.offsets[i + 1]].tobytes()
    return b" ".join([text[s:e] for s, e in zip((w.start[chosen] - base).tolist(), (w.end[chosen] - base).tolist())])


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                w = words_of(block.column("text"))
                keep = _kept(w, block.column("spans"), size)
                gone = np.add.reduceat(np.append(~keep, False).astype(np.int64), w.first[:-1]) * (w.n > 0)
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), block.column("k"), pa.array(gone),
                     pa.array([sha256(_kept_bytes(w, keep, i)).hexdigest() for i in range(block.num_rows)])],
                    names=["doc_id", "k", "n_removed", "kept_sha256"])
    return run


def _kept_text(size: int):
    @F.arrow_udf("string")
    def text(texts: pa.Array, spans: pa.Array) -> pa.Array:
        parts = []
        for block in blocks(pa.record_batch([texts, spans], names=["text", "spans"])):
            w = words_of(block.column("text"))
            keep = _kept(w, block.column("spans"), size)
            parts += [_kept_bytes(w, keep, i).decode() for i in range(block.num_rows)]
        return pa.array(parts, pa.string())
    return text


def repeated_spans(docs: DataFrame, words: int = 50) -> tuple[DataFrame, DataFrame]:
    """(one row per document row, spans of repeated windows by ``doc_id, k``).

    ``k`` is a hash of the text, so that rows with one id and other texts are told apart; of a span, ``p`` is the first
    window start and ``m`` the number of consecutive starts.
    """
    source = keyed(docs.select("doc_id", "text"))
    table = written(source.mapInArrow(_runs(words), _RUNS), "runs")
    held = table.filter("doc_id is not null")
    # half length
    # (tables of minima are written, so that both sides of a join are plain shuffles, which can be split)
    half = written(held.select("doc_id", F.explode("a").alias("a")).groupBy("a").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi"), "half")
    runs = held.select("doc_id", "k", F.inline(F.arrays_zip("a", "p", "m", "h1", "h2")))
    alive = written(runs.join(half, "a").select(
        "doc_id", "k", "a", "p", "m", "h1", "h2", (F.col("lo") < F.col("doc_id")).alias("target"),
        (F.col("hi") > F.col("doc_id")).alias("holder")), "alive")
    # full length, whole runs
    firsts = written(alive.groupBy("h1", "h2").agg(F.min("doc_id").alias("first")), "firsts")
    judged = written(alive.join(firsts, ["h1", "h2"]).select(
        "doc_id", "k", "a", "p", "m", "target", "holder", (F.col("first") < F.col("doc_id")).alias("settled")), "judged")
    settled = judged.filter("settled").select("doc_id", "k", "p", "m")
    # full length, window by window
    opened = judged.filter("not settled and target")
    asked = judged.filter("not settled and holder and not target").join(
        written(opened.select("a").distinct(), "names"), "a", "left_semi").select(judged.columns).unionByName(opened)
    per = asked.groupBy("doc_id", "k").agg(F.collect_list(F.struct("p", "m", "target")).alias("runs"))
    windows = written(source.join(per, ["doc_id", "k"]).select("doc_id", "k", "text", "runs").mapInArrow(
        _windows(words), "doc_id long, k long, p int, target boolean, h1 long, h2 long"), "windows")
    lows = written(windows.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last"), "lows")
    single = windows.filter("target").join(lows, ["h1", "h2"]).filter("first < doc_id").select(
        "doc_id", "k", "p", F.lit(1).alias("m"))
    spans = settled.unionByName(single).groupBy("doc_id", "k").agg(F.collect_list(F.struct("p", "m")).alias("spans"))
    return table.select("doc_id", "k", "n_words", "sha"), spans


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("k", F.xxhash64("text"))


def removal(docs: DataFrame, words: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of each row: what ``without_repeats`` does, without the texts."""
    rows, spans = repeated_spans(docs, words)
    cut = (keyed(docs.select("doc_id", "text")).join(spans, ["doc_id", "k"]).select("doc_id", "k", "text", "spans")
           .mapInArrow(_cut(words), "doc_id long, k long, n_removed long, kept_sha256 string").distinct())
    return rows.join(cut, ["doc_id", "k"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def without_repeats(docs: DataFrame, words: int = 50) -> DataFrame:
    """Drop every word covered by a window of ``words`` words that also starts in a document with a smaller id.

    Returns the rows and columns of ``docs``; a text that loses words becomes its other words joined by one space, any
    other text stays as it is.

    Windows are judged on the input.  A null text has no words; a null id is neither smaller nor larger than any other,
    so its row stays as it is and removes nothing.  Rows with equal ids do not remove each other's words and, with equal
    texts, get equal results.  Texts of fewer than ``words`` words have no window.  Columns other than ``doc_id`` and
    ``text`` are passed through, whatever their names.
    """
    _, spans = repeated_spans(docs, words)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    rows = (docs.toDF(*names).withColumns({"doc_id": F.col(names[docs.columns.index("doc_id")]),
                                           "k": F.xxhash64(names[at])}).join(spans, ["doc_id", "k"], "left"))
    mended = F.when(F.col("spans").isNotNull(), _kept_text(words)(names[at], "spans")).otherwise(F.col(names[at]))
    return rows.select([mended if i == at else F.col(c) for i, c in enumerate(names)]).toDF(*docs.columns)
