"""Words, word windows and hashes of many texts at once, as flat numpy arrays.

A word is a run of bytes other than space, tab, newline, vertical tab, form feed and carriage return, unchanged.  Word
hashes are 64 bits wide and depend on the word's bytes alone; window hashes depend on the word hashes alone, so they are
equal wherever the same words stand.  Everything is computed for a block of rows at once: no loop over words or rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into arrays at once; a longer text is cut at white space and put together again.
BLOCK_BYTES = 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 1 << 10

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32
PLAIN[65:91] += 32

_WORD_SALTS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ U64(salt)
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None and offsets[-1] > offsets[0] \
        else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw


def blocks(batch: pa.RecordBatch | pa.Table, text: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` bytes of text; a longer row stands alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, length in enumerate(lengths):
        if size and size + length > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += int(length)
    if start < len(lengths):
        yield batch.slice(start)


@dataclass
class Words:
    """Words of a block of rows in reading order."""

    offsets: np.ndarray   # row offsets into ``data``
    data: np.ndarray      # bytes of all texts
    start: np.ndarray     # first byte of each word
    end: np.ndarray       # byte after each word
    hash: np.ndarray      # 64-bit hash of each word
    first: np.ndarray     # per row: index of its first word; one entry more than rows

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.first)

    def row(self) -> np.ndarray:
        """Row number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.n)


def _boundaries(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = ~SPACE[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word: its bytes by eights, each mixed into what came before; of long words BLAKE2b's."""
    n = end - start
    out = mix(n.astype(U64), 0x9E3779B97F4A7C15)
    eights = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    alive = np.flatnonzero((n > 0) & (n <= LONG_WORD))
    at = 0
    while len(alive):
        left = np.minimum(n[alive] - at, 8)
        eight = eights[start[alive] + at] & (U64(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(U64))
        out[alive] = mix(out[alive] * U64(0x9FB21C651E98DF25) + eight)
        at += 8
        alive = alive[n[alive] > at]
    for k in np.flatnonzero(n > LONG_WORD):
        out[k] = int.from_bytes(blake2b(data[start[k]: end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def words_of(column: pa.Array | pa.ChunkedArray, plain: bool = False) -> Words:
    """Words of the rows; with ``plain``, ASCII capitals count as small and ASCII marks as white space."""
    offsets, data = text_bytes(column)
    if plain:
        data = PLAIN[data]
    start, end = _boundaries(offsets, data) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Words(offsets, data, start, end, word_hashes(data, start, end), np.searchsorted(start, offsets))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of what stands in ``a`` followed by what stands in ``b``."""
    return mix(a * U64(0x9FB21C651E98DF25) + b)


def _doubled(h: np.ndarray, which: int, most: int) -> list[np.ndarray]:
    """Hashes of all runs of 1, 2, 4, ... words, up to ``most``; two independent ones by ``which``."""
    levels = [mix(h, _WORD_SALTS[which])]
    while 2 << (len(levels) - 1) <= most:
        last, half = levels[-1], 1 << (len(levels) - 1)
        levels.append(_pair(last[:-half], last[half:]) if len(last) > half else last[:0])
    return levels


def window_hashes(h: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``size`` words, for the whole block; windows across rows are the caller's to leave out.

    A run is put together from runs of halved lengths, mixed at each step.  ``which`` 0 or 1 gives two independent hashes.
    """
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, at = None, 0
    for k, level in reversed(list(enumerate(_doubled(h, which, size)))):
        if size >> k & 1:
            part = level[at: at + n]
            out = part if out is None else _pair(out, part)
            at += 1 << k
    return mix(out, size)


def span_hashes(h: np.ndarray, start: np.ndarray, size: np.ndarray, which: int) -> np.ndarray:
    """Hashes of word spans of different lengths; two independent ones by ``which``."""
    out, at = mix(size.astype(U64), 50 + which), start.copy()
    for k, level in reversed(list(enumerate(_doubled(h, which, int(size.max(initial=1)))))):
        has = np.flatnonzero(size >> k & 1)
        out[has] = _pair(out[has], level[at[has]])
        at[has] += 1 << k
    return out


def inside(words: Words, size: int) -> np.ndarray:
    """Which of ``window_hashes``' windows lie within one row."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    row = words.row()
    return row[:n] == row[size - 1:]


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return h.view(np.int64)
