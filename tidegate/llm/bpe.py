"""Byte-level BPE with the tiktoken library and a local rank file.

A long text is cut before it is encoded, only where no match of the split pattern can span the cut.  No match holds white
space after something else than white space, and what follows a cut is matched as it would be without it, so the ids are
those of the whole text.  Cuts are made between a letter or digit and a space, and around long runs of white space, which
the library's pattern engine cannot step back through: such a run is one match, without its last character where something
other than white space follows, and is encoded as one.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.words import blocks

#: Characters of a text that are encoded at once, if there is a place to cut.
PIECE_CHARS = 1 << 16
#: The engine's white space, and runs of it that are encoded as one match.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"[{SPACES}]{{{PIECE_CHARS >> 2},}}")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def undivided(enc: tiktoken.Encoding) -> tiktoken.Encoding:
    """The same merges for a text that is one match."""
    return tiktoken.Encoding("undivided", pat_str=r"(?s:.+)", mergeable_ranks=enc._mergeable_ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    start = 0
    while len(text) - start > size:
        cut = text.find(" ", start + size)
        while cut > 0 and not text[cut - 1].isalnum():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str | None) -> list[int]:
    """Ids of a whole text; none for a null or empty one."""
    if not text:
        return []
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    ids, start = [], 0
    for run in _LONG_RUN.finditer(text):
        ids += [i for piece in pieces(text[start: run.start()]) for i in enc.encode_ordinary(piece)]
        start = run.end() - (run.end() < len(text))
        ids += undivided(enc).encode_ordinary(text[run.start(): start])
    return ids + [i for piece in pieces(text[start:]) for i in enc.encode_ordinary(piece)]


def encoder(path: str, pattern: str):
    """Arrow function text -> ids as little-endian unsigned 32-bit integers; a null text has no ids."""
    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        enc = encoding(path, pattern)
        return pa.array([np.array(encode_text(enc, t.as_py()), "<u4").tobytes() for t in texts], pa.binary())
    return encode


def decoder(path: str, pattern: str):
    """Arrow function ids -> raw bytes, which need not be a whole character at every cut of the ids."""
    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        enc = encoding(path, pattern)
        return pa.array([None if i.as_py() is None else enc.decode_bytes(np.frombuffer(i.as_py(), "<u4").tolist())
                         for i in ids], pa.binary())
    return decode


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``ids`` (unsigned 32-bit, little-endian) and ``n_tokens``; columns of these names are replaced.

    A null or empty text has no ids.  Rows are treated one by one, so repeated rows get equal ids; there are no ties.
    """
    return docs.withColumn("ids", encoder(path, pattern)("text")).withColumn(
        "n_tokens", (F.octet_length("ids") / 4).cast("long"))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row: encode, then decode the ids.

    A null or empty text has no tokens and the digests of nothing.  Rows are treated one by one, whatever their ids; an
    empty table gives an empty result, and other columns play no part.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            for block in blocks(batch):
                n, ids_sha, text_sha = [], [], []
                for text in block.column("text").to_pylist():
                    ids = encode_text(enc, text)
                    n.append(len(ids))
                    ids_sha.append(sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                    text_sha.append(sha256(enc.decode_bytes(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
