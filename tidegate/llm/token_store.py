"""Token ids in compressed segments with a shared zstandard dictionary and an offset index.

*Format.*  A folder with two Parquet tables.  ``dictionary`` has one row: the dictionary's bytes and their SHA-256.
``segments`` has rows of at most ``SEGMENT_DOCS`` documents in ascending id order: ``part`` and ``seq`` (order of
segments), ``before`` (ids of the part before the segment), ``first_doc`` and ``last_doc`` (of the known ids), ``doc_ids``, ``counts`` (ids
of each document), ``offsets`` (first byte of each document's frame in ``payload``), ``payload``, ``width`` (bytes of an
id) and ``dictionary`` (the dictionary's hash).  Every document is a frame of its own, little-endian ids compressed with
the dictionary, so one short document is read without its neighbours (``read_document``).

*Encoding.*  The tokenizer of the library splits texts at white space and drops it, so a text's ids are its words' ids in
order.  Each distinct word is encoded by the library once and kept, by its 64-bit hash, in a bounded table of the worker;
the ids are put together with array operations.  ``splits_at_spaces`` checks that premise for a tokenizer.

The dictionary is trained on the ids of at most ``SAMPLE_DOCS`` documents (those with the smallest hash of id and text),
``SAMPLE_IDS`` ids of each.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegate.llm.common import new_folder
from tidegate.llm.words import U64, blocks, words_of

END_ID = 2
SEGMENT_DOCS = 512
SEGMENT_BYTES = 4 << 20
PART_BYTES = 32 << 20
SAMPLE_DOCS, SAMPLE_IDS = 1_000, 8_192
DICTIONARY_BYTES = 64 << 10
#: Words kept by a worker; the table is started anew beyond.
CACHE_WORDS = 1_500_000


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


class WordIds:
    """Ids of words by word hash: sorted hashes, and for each a run in one flat array."""

    def __init__(self, tok: Tokenizer):
        self.tok = tok
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(0, U64)
        self.start, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        got = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for ids in got for i in ids), np.uint32, int(n.sum()))
        start = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate([self.flat, flat])
        order = np.argsort(np.concatenate([self.hash, hashes]), kind="stable")
        self.hash, self.start, self.n = (
            np.concatenate(x)[order] for x in ((self.hash, hashes), (self.start, start), (self.n, n)))

    def ids(self, block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids of each row)."""
        w = words_of(block.column("text"))
        hashes, at, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.hash) > CACHE_WORDS:
            self.clear()
        where = np.searchsorted(self.hash, hashes)
        known = np.zeros(len(hashes), bool)
        inner = where < len(self.hash)
        known[inner] = self.hash[where[inner]] == hashes[inner]
        if not known.all():
            new = at[~known]
            self.learn(hashes[~known], [w.data[s:e].tobytes().decode()
                                        for s, e in zip(w.start[new].tolist(), w.end[new].tolist())])
            where = np.searchsorted(self.hash, hashes)
        where = where[inverse]
        n = self.n[where]
        total = np.concatenate([[0], np.cumsum(n)])
        flat = self.flat[np.repeat(self.start[where] - total[:-1], n) + np.arange(total[-1])]
        return flat, total[w.first[1:]] - total[w.first[:-1]]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(tokenizer(path))


def splits_at_spaces(path: str, texts: list[str]) -> bool:
    """Whether ids by word equal the library's ids of the whole texts."""
    flat, n = word_ids(path).ids(pa.record_batch([pa.array(texts, pa.string())], names=["text"]))
    want = [tokenizer(path).encode(t, add_special_tokens=False).ids for t in texts]
    return flat.tolist() == [i for ids in want for i in ids] and n.tolist() == [len(ids) for ids in want]


def encoded(block: pa.RecordBatch, path: str, width: int) -> list[bytes]:
    """Little-endian ids of each row with the end id; a null or empty text has the end id alone."""
    flat, n = word_ids(path).ids(block)
    raw = np.insert(flat, np.cumsum(n), END_ID).astype(f"<u{width}").tobytes()
    ends = (np.cumsum(n + 1) * width).tolist()
    return [raw[s:e] for s, e in zip([0, *ends[:-1]], ends)]


def id_width(path: str) -> int:
    return 2 if tokenizer(path).get_vocab_size() <= 1 << 16 else 4


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A dictionary from a bounded sample; of too few ids for training, their bytes are the dictionary."""
    width = id_width(path)
    rows = docs.select("doc_id", "text")
    h = F.xxhash64("doc_id", "text")
    chosen = rows.groupBy(h.alias("h")).agg(F.lit(1)).select("h").orderBy("h").limit(SAMPLE_DOCS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                yield pa.RecordBatch.from_arrays(
                    [block.column("h"), pa.array([x[: SAMPLE_IDS * width] for x in encoded(block, path, width)], pa.binary())],
                    names=["h", "ids"])

    got = (rows.withColumn("h", h).join(F.broadcast(chosen), "h").dropDuplicates(["h"]).select("h", "text")
           .mapInArrow(encode, "h long, ids binary").collect())
    samples = [bytes(r.ids) for r in sorted(got, key=lambda r: r.h)]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def write_tokens(docs: DataFrame, path: str, folder: str) -> str:
    """Encode every text and write the store; returns the dictionary's hash.

    Documents stand in ascending id order, null ids first, equal ids by text.  Columns besides ``doc_id`` and ``text``
    play no part; an empty table gives an empty store.
    """
    spark = docs.sparkSession
    raw = train_dictionary(docs, path)
    name, width = sha256(raw).hexdigest(), id_width(path)
    spark.createDataFrame([(name, raw)], "hash string, bytes binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-int(size) // PART_BYTES))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw \
            else zstandard.ZstdCompressor()
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids, counts, frames, held = [], [], [], 0

        def segment() -> pa.RecordBatch:
            sizes, known = [len(f) for f in frames], [i for i in ids if i is not None]
            return pa.RecordBatch.from_pylist([{
                "part": part, "seq": seq, "before": before, "first_doc": min(known, default=None),
                "last_doc": max(known, default=None), "doc_ids": ids,
                "counts": counts, "offsets": (np.cumsum(sizes) - sizes).tolist(), "payload": b"".join(frames),
                "width": width, "dictionary": name}], schema=_SEGMENT)
        for batch in batches:
            for block in blocks(batch):
                for doc, x in zip(block.column("doc_id").to_pylist(), encoded(block, path, width)):
                    ids.append(doc)
                    counts.append(len(x) // width)
                    frames.append(packer.compress(x))
                    held += len(frames[-1])
                    if len(ids) == SEGMENT_DOCS or held > SEGMENT_BYTES:
                        yield segment()
                        seq, before, ids, counts, frames, held = seq + 1, before + sum(counts), [], [], [], 0
        if ids:
            yield segment()

    (docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(pack, "part int, seq int, before long, first_doc long, last_doc long, doc_ids array<long>, "
                 "counts array<int>, offsets array<int>, payload binary, width int, dictionary string")
     .write.parquet(f"{folder}/segments"))
    return name


_SEGMENT = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("first_doc", pa.int64()),
    ("last_doc", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())),
    ("offsets", pa.list_(pa.int32())), ("payload", pa.binary()), ("width", pa.int32()), ("dictionary", pa.string())])


def _dictionary(spark: SparkSession, folder: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    if sha256(bytes(row.bytes)).hexdigest() != row.hash:
        raise ValueError(f"the dictionary in {folder} is not the one its hash names")
    return row.hash, bytes(row.bytes)


def _frames(segment: dict, name: str, reader: zstandard.ZstdDecompressor, only: int | None = None):
    """(place, doc_id, ids as little-endian unsigned 32-bit bytes)"""
    if segment["dictionary"] != name:
        raise ValueError("a segment was written with another dictionary")
    payload, offsets = segment["payload"], [*segment["offsets"], len(segment["payload"])]
    for i, doc in enumerate(segment["doc_ids"]):
        if only is None or doc == only:
            raw = reader.decompress(payload[offsets[i]: offsets[i + 1]])
            yield i, doc, raw if segment["width"] == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()


def _reader(raw: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw \
        else zstandard.ZstdDecompressor()


def read_tokens(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if asked, ``ids`` of every document of a store."""
    name, raw = _dictionary(spark, folder)
    segments = spark.read.parquet(f"{folder}/segments")
    # one row for each task that wrote
    totals = segments.groupBy("part").agg(F.max(F.col("before") + F.aggregate(
        "counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    bases, total = {}, 0
    for r in totals:
        bases[r.part], total = total, total + r.n

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(raw)
        for batch in batches:
            for i in range(batch.num_rows):
                segment = batch.slice(i, 1).to_pylist()[0]
                start = bases[segment["part"]] + segment["before"]
                starts = start + np.cumsum(segment["counts"]) - segment["counts"]
                rows = list(_frames(segment, name, reader))
                columns = [pa.array([x[1] for x in rows], pa.int64()), pa.array(starts.astype(np.int64)),
                           pa.array([len(x[2]) // 4 for x in rows], pa.int64()),
                           pa.array([crc32(x[2]) for x in rows], pa.int64())]
                if ids:
                    columns.append(pa.array([x[2] for x in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    columns, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    return segments.mapInArrow(
        unpack, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else ""))


def read_document(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents with one id: the segments that may hold it are found by their first and last ids."""
    name, raw = _dictionary(spark, folder)
    rows = spark.read.parquet(f"{folder}/segments").filter(
        (F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).orderBy("part", "seq").collect()
    return [np.frombuffer(x[2], "<u4").tolist() for r in rows for x in _frames(r.asDict(), name, _reader(raw), doc_id)]


def stored(docs: DataFrame, path: str) -> DataFrame:
    """Write the store of ``docs`` to a new shared folder and read it back."""
    folder = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, folder)
    return read_tokens(docs.sparkSession, folder, ids=False)
