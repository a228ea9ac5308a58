"""Content or boilerplate for every line, by a linear-chain conditional random field, and retention by content share.

The lines of a text are a sequence of two states.  A line's score is linear in features of its characters and words; two
transition scores tie neighbours together.  Weights are fitted by gradient ascent on the conditional likelihood
(forward-backward) over a bounded sample of labelled documents, then every document is decoded by Viterbi.

The fit reads at most ``SAMPLE`` documents of each label (those with the smallest hash of the id) and ``FIT_LINES`` lines
of each; decoding reads all lines of all texts.  A labelled document's lines all carry its label, as nothing finer is
known; lines of junk documents that look like anybody's prose are outvoted by the same lines of good ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import list_array
from tidegate.llm.words import SPACE, U64, Words, blocks, inside, mix, window_hashes, word_hashes, words_of

SAMPLE = 1_500
FIT_LINES = 64
CONTENT_SHARE = 0.5

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
CAPITALS = np.zeros(256, dtype=bool)
CAPITALS[65:91] = True
DIGITS = np.zeros(256, dtype=bool)
DIGITS[48:58] = True
SHOUTS = np.zeros(256, dtype=bool)
SHOUTS[list(b"!?")] = True
TAILS = np.zeros(256, dtype=bool)
TAILS[128:192] = True  # bytes of a character after its first

FEATURES = ("bias", "symbols", "pipes", "capitals", "shouts", "digits", "other_marks", "twins", "few_words",
            "few_kinds", "long_words", "repeated_line", "first")
#: Where the fit starts and what it is drawn to: boilerplate is symbols, capitals, shouting, digits and repetition.
PRIOR = dict(bias=-2.0, symbols=4.0, pipes=2.0, capitals=2.0, shouts=3.0, digits=2.0, other_marks=1.0, twins=3.0,
             few_kinds=2.0, repeated_line=1.0)
PRIOR_TRANSITION = 1.0


@dataclass
class Lines:
    """Lines with a word of a block of rows, in reading order."""

    row: np.ndarray
    n_words: np.ndarray
    features: np.ndarray
    repeated: np.ndarray  # equal to an earlier line of its row


def _count(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[end] - sums[start]


def seen_before(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier one of their row; entries come in reading order."""
    key = mix(h ^ mix(row.astype(U64) + U64(1)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    same[order[1:]] = key[order[1:]] == key[order[:-1]]
    return same


def lines_of(w: Words) -> Lines:
    data = w.data
    cuts = np.flatnonzero(data == 10)
    bounds = np.unique(np.concatenate([w.offsets, cuts + 1, [len(data)]])) if len(data) else np.zeros(1, np.int64)
    start, end = bounds[:-1], bounds[1:]
    end = end - (data[end - 1] == 10) if len(end) else end
    first = np.searchsorted(w.start, start)
    n = np.searchsorted(w.start, end) - first
    with_word = n > 0
    start, end, first, n = start[with_word], end[with_word], first[with_word], n[with_word]
    row = np.searchsorted(w.offsets, start, side="right") - 1
    repeated = seen_before(row, word_hashes(data, start, end))

    size = np.maximum(1, _count(~TAILS[data], start, end) - (n - 1)).astype(float)
    letters = np.maximum(1, _count(LETTERS[data] & ~TAILS[data], start, end)).astype(float)
    share = lambda mask, of: _count(mask[data], start, end) / of
    symbols, digits, shouts = share(SYMBOLS, size), share(DIGITS, size), share(SHOUTS, size)
    pipes = _count(data == ord("|"), start, end) / n
    twin = np.zeros(len(w.hash), bool)
    twin[1:] = w.hash[1:] == w.hash[:-1]
    twin[first] = False
    twins = _count(twin, first, first + n) / n
    line = np.repeat(np.arange(len(n)), n)
    kinds = 1 - np.bincount(line, seen_before(line, w.hash), minlength=len(n)) / n
    new_row = np.ones(len(row), bool)
    new_row[1:] = row[1:] != row[:-1]
    marks = 1 - (_count(LETTERS[data] & ~TAILS[data], start, end) / size) - symbols - digits - shouts
    table = np.stack([
        np.ones(len(n)), np.minimum(1, 8 * symbols), np.minimum(1, 2 * pipes), share(CAPITALS, letters),
        np.minimum(1, 10 * shouts), np.minimum(1, 2 * digits), np.clip(4 * marks, 0, 1), np.minimum(1, 2 * twins), n < 3,
        np.where(n >= 20, np.clip(1 - 1.25 * kinds, 0, 1), 0), size / n > 12, repeated,
        new_row,
    ], axis=1).astype(float) if len(n) else np.zeros((0, len(FEATURES)))
    return Lines(row, n, table, repeated)


@dataclass
class Field:
    """Score of boilerplate over content of a line, and of a change of state."""

    weights: np.ndarray
    change: np.ndarray  # transition scores [from, to]


def prior() -> Field:
    return Field(np.array([PRIOR.get(f, 0.0) for f in FEATURES]), np.array([[0.5, -0.5], [-0.5, 0.5]]) * PRIOR_TRANSITION)


def _padded(row: np.ndarray, n_rows: int):
    """(line index or -1) by time and row, longest rows first."""
    n = np.bincount(row, minlength=n_rows)
    start = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    return order, n[order], start[order]


def viterbi(emission: np.ndarray, row: np.ndarray, n_rows: int, change: np.ndarray) -> np.ndarray:
    """Best states of every row; ``emission`` is the score of state 1 over state 0.  Ties go to state 0."""
    order, n, start = _padded(row, n_rows)
    state = np.zeros(len(emission), np.int8)
    if not len(emission):
        return state
    back = np.zeros((len(emission), 2), np.int8)
    active = int(np.searchsorted(-n, 0, side="left"))  # rows with a line
    v = np.zeros((active, 2))
    v[:, 1] = emission[start[:active]]
    finals = np.zeros(active, np.int8)
    for t in range(1, int(n[0]) + 1):
        more = int(np.searchsorted(-n, -t, side="left"))  # rows with a line t
        finals[more:active] = v[more:active, 1] > v[more:active, 0]
        if not more:
            break
        options = v[:more, :, None] + change
        best = options[:, 1] > options[:, 0]
        at = start[:more] + t
        back[at] = best
        v = np.where(best, options[:, 1], options[:, 0])
        v[:, 1] += emission[at]
        active = more
    now = finals.copy()
    for t in range(int(n[0]) - 1, -1, -1):
        live = int(np.searchsorted(-n, -t, side="left"))
        at = start[:live] + t
        state[at] = now[:live]
        if t:
            now[:live] = back[at, now[:live]]
    return state


def _sequences(row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    order, n, start = _padded(row, n_rows)
    steps = np.arange(int(n[0]))
    index = start[:, None] + steps
    return np.where(steps < n[:, None], index, 0), steps < n[:, None]


def fit(features: np.ndarray, row: np.ndarray, label: np.ndarray, rounds: int = 150, pull: float = 1.0) -> Field:
    """Maximum conditional likelihood with a Gaussian prior, by Adam; ``row`` numbers the sequences from 0."""
    field = prior()
    if not len(row) or len(np.unique(label)) < 2:
        return field
    index, mask = _sequences(row, int(row.max()) + 1)
    y = label[index].astype(int)
    pair = mask[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    theta = np.concatenate([field.weights, field.change.ravel()])
    centre, first, second = theta.copy(), np.zeros_like(theta), np.zeros_like(theta)
    # both labels weigh the same
    weight = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())) * len(label)
    scale = len(label)
    steps = index.shape[1]
    for k in range(1, rounds + 1):
        w, change = theta[: len(FEATURES)], theta[len(FEATURES):].reshape(2, 2)
        e = np.zeros((*index.shape, 2))
        e[..., 1] = (features @ w)[index]
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for t in range(1, steps):
            a[:, t] = np.logaddexp(a[:, t - 1, :1] + change[0], a[:, t - 1, 1:] + change[1]) + e[:, t]
        for t in range(steps - 2, -1, -1):
            nxt = e[:, t + 1] + b[:, t + 1]
            b[:, t] = np.where(mask[:, t + 1, None],
                               np.logaddexp(change[:, 0] + nxt[:, :1], change[:, 1] + nxt[:, 1:]), 0)
        total = np.logaddexp(*(a[:, 0] + b[:, 0]).T)
        p = np.exp(a[..., 1] + b[..., 1] - total[:, None])
        expected = np.zeros((2, 2))
        for i in (0, 1):
            for j in (0, 1):
                joint = np.exp(a[:, :-1, i] + change[i, j] + e[:, 1:, j] + b[:, 1:, j] - total[:, None])
                expected[i, j] = joint[pair].sum()
        error = np.zeros(len(label))
        error[index[mask]] = (y - p)[mask]
        grad = np.concatenate([features.T @ (error * weight), (seen - expected).ravel()]) / scale
        grad -= pull * (theta - centre) / scale
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad ** 2
        theta = theta + 0.1 * (first / (1 - 0.9 ** k)) / (np.sqrt(second / (1 - 0.999 ** k)) + 1e-8)
    return Field(theta[: len(FEATURES)], theta[len(FEATURES):].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on at most ``sample`` documents of each quality label; without labelled lines of both kinds, the prior.

    Rows that repeat count once, and of an id with several texts each is a document, so that no more rows than that are
    brought together whatever the ids.
    """
    known = labels.filter("doc_id is not null and quality is not null")
    chosen = None
    for value in (0, 1):
        part = known.filter(F.col("quality") == value).select("doc_id", "quality").distinct().orderBy(
            F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * sample rows of two numbers are broadcast
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).join(
        F.broadcast(chosen), "doc_id").select("h", "quality", "text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                lines = lines_of(words_of(block.column("text")))
                n = np.bincount(lines.row, minlength=block.num_rows)
                place = np.arange(len(lines.row)) - np.repeat(np.cumsum(n) - n, n)
                table = lines.features[place < FIT_LINES]
                yield pa.RecordBatch.from_arrays(
                    [block.column("h"), block.column("quality"), pa.array(np.minimum(n, FIT_LINES)),
                     list_array(table.ravel(), np.minimum(n, FIT_LINES) * len(FEATURES), pa.float64())],
                    names=["h", "quality", "n", "features"])

    lines = rows.mapInArrow(describe, "h long, quality int, n long, features array<double>").filter("n > 0").groupBy(
        "quality", "h").agg(F.first("n").alias("n"), F.first("features").alias("features"))
    first = F.row_number().over(Window.partitionBy("quality").orderBy("h"))
    got = lines.withColumn("place", first).filter(F.col("place") <= sample).select("h", "quality", "n", "features").toArrow().sort_by(
        [("h", "ascending"), ("quality", "ascending")])
    if not got.num_rows:
        return prior()
    n = got.column("n").to_numpy()
    flat = got.column("features").combine_chunks().flatten().to_numpy()
    return fit(flat.reshape(-1, len(FEATURES)), np.repeat(np.arange(len(n)), n),
               np.repeat(1 - got.column("quality").to_numpy(), n))


SCORES = ("struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long, "
          "base_failed: boolean, content_words: long, kept: boolean>")


def repeated_words(w: Words, size: int = 5) -> np.ndarray:
    """Per row: words in windows of ``size`` words that stand twice or more in it, the first time included."""
    at = np.flatnonzero(inside(w, size))
    key = mix(window_hashes(w.hash, size)[at] ^ mix(w.row()[at].astype(U64) + U64(1)))
    order = np.argsort(key, kind="stable")
    equal = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    edge = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + size, -1)
    return _count(np.cumsum(edge[:-1]) > 0, w.first[:-1], w.first[1:])


def score_block(w: Words, field: Field, share: float) -> list[np.ndarray]:
    n_rows = len(w.first) - 1
    per_row = lambda mask: _count(mask, w.offsets[:-1], w.offsets[1:])
    word_chars = per_row(~SPACE[w.data] & ~TAILS[w.data])
    symbols = per_row(SYMBOLS[w.data])
    lines = lines_of(w)
    dup = np.bincount(lines.row, lines.repeated, minlength=n_rows).astype(np.int64)
    repeat = repeated_words(w)
    n = w.n.astype(np.int64)
    failed = (n < 10) | (100 * repeat > 20 * n)
    state = viterbi(lines.features @ field.weights, lines.row, n_rows, field.change)
    content = np.bincount(lines.row, lines.n_words * (state == 0), minlength=n_rows).astype(np.int64)
    return [n, word_chars, symbols, dup, repeat, failed, content, ~failed & (content >= share * n)]


def scorer(field: Field, share: float = CONTENT_SHARE):
    names = [part.split(":")[0].strip() for part in SCORES[len("struct<"):-1].split(",")]

    @F.arrow_udf(SCORES)
    def score(texts: pa.Array) -> pa.Array:
        parts = [score_block(words_of(block.column("text")), field, share)
                 for block in blocks(pa.record_batch([texts], names=["text"]))]
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [
            np.zeros(0, bool if i in (5, 7) else np.int64) for i in range(len(names))]
        return pa.StructArray.from_arrays([pa.array(x) for x in columns], names)
    return score


def judge(docs: DataFrame, labels: DataFrame, share: float = CONTENT_SHARE) -> DataFrame:
    """``doc_id``, the base counts, ``content_words`` and the verdict ``kept`` of each row.

    ``base_failed`` is fewer than ten words, or more than a fifth of the words in repeated five-word windows; a text that
    passes is kept if lines decoded as content hold at least ``share`` of its words.  A null or empty text has no words
    and fails.  Ids, other columns and the order of rows play no part in a row's verdict; equal rows get equal ones.
    """
    field = train(docs, labels)
    return docs.select("doc_id", scorer(field, share)("text").alias("q")).select("doc_id", "q.*")


def retained(docs: DataFrame, labels: DataFrame, share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    return docs.filter(scorer(train(docs, labels), share)(docs["text"])["kept"])
