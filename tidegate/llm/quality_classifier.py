"""Quality from overlapping heuristics: their accuracies by expectation-maximisation, then a hashed linear scorer.

1. *Labellers.*  Each looks at one side of a text and votes good, bad or nothing.
2. *Label model.*  How often each combination of votes occurs is counted over the whole corpus; there are at most
   3^``len(LABELLERS)`` combinations, however many documents.  Expectation-maximisation on these counts estimates how
   often each labeller calls good and bad texts bad, given that labellers err independently; the posterior of a text is
   that of its votes.
3. *Scorer.*  A logistic model on hashed byte trigrams is fitted to the posteriors of at most ``SAMPLE`` documents that
   lean to either side (those with the smallest hash of the id), and scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm import ngrams
from tidegate.llm.common import written
from tidegate.llm.quality_rules import CAPITALS, DIGITS, LETTERS, SHOUTS, SYMBOLS, TAILS, _count, lines_of, repeated_words
from tidegate.llm.quality_rules import seen_before
from tidegate.llm.words import SPACE, Words, blocks, words_of

SAMPLE = 1_500
KEEP = 0.5
#: The posterior weighs as much as so many bytes of text: a few trigrams say little.
PRIOR_BYTES = 100
#: A labeller calls so many of the good texts bad at most.
FALSE_ALARMS = 0.01
NONE, BAD, GOOD = 0, 1, 2

LABELLERS = ("length", "symbols", "pipes", "capitals", "shouts", "twins", "repeats", "kinds", "word_length", "letters",
             "repeated_lines")


def _vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, NONE)).astype(np.int64)


def votes(w: Words) -> np.ndarray:
    """(rows, labellers) votes; a text without words gets a bad vote for its length and no others."""
    data, n = w.data, w.n
    some = np.maximum(n, 1)
    of = lambda mask: _count(mask, w.offsets[:-1], w.offsets[1:])
    chars = np.maximum(of(~SPACE[data] & ~TAILS[data]), 1)
    letters = of(LETTERS[data] & ~TAILS[data])
    capitals = of(CAPITALS[data]) / np.maximum(letters, 1)
    symbols, shouts, pipes = of(SYMBOLS[data]) / chars, of(SHOUTS[data]) / some, of(data == ord("|")) / some
    digits = of(DIGITS[data]) / chars
    twin = np.zeros(len(w.hash), bool)
    twin[1:] = w.hash[1:] == w.hash[:-1]
    twin[w.first[:-1][n > 0]] = False
    twins = _count(twin, w.first[:-1], w.first[1:]) / some
    repeats = repeated_words(w) / some
    kinds = 1 - _count(seen_before(w.row(), w.hash), w.first[:-1], w.first[1:]) / some
    length = chars / some
    lines = lines_of(w)
    n_lines = np.bincount(lines.row, minlength=len(n))
    again = np.bincount(lines.row, lines.repeated, minlength=len(n)) / np.maximum(n_lines, 1)
    long = n >= 20
    table = np.stack([
        _vote(n < 10, n >= 30),
        _vote(symbols > 0.05, symbols < 0.005),
        _vote(pipes > 0.2, np.zeros(len(n), bool)),
        _vote(capitals > 0.5, capitals < 0.15),
        _vote(shouts > 0.3, shouts < 0.02),
        _vote(twins > 0.1, twins < 0.02),
        _vote(repeats > 0.3, repeats < 0.1),
        _vote(long & (kinds < 0.2), long & (kinds > 0.35)),
        _vote((length < 2.5) | (length > 14), (length > 3) & (length < 10)),
        _vote((letters / chars < 0.7) | (digits > 0.2), letters / chars > 0.85),
        _vote((n_lines >= 4) & (again > 0.3), (n_lines >= 4) & (again < 0.1)),
    ], axis=1) if len(n) else np.zeros((0, len(LABELLERS)), np.int64)
    table[n == 0] = NONE
    table[n == 0, 0] = BAD
    return table


def packed(table: np.ndarray) -> np.ndarray:
    return table @ (3 ** np.arange(len(LABELLERS)))


def unpacked(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def label_model(patterns: np.ndarray, n: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good for each pattern, accuracy of each labeller where it votes), by EM.

    A labeller that does not find its fault says little, whether it votes good or nothing, so what counts is how often it
    votes bad on texts of either kind.  That rate is held to at most ``FALSE_ALARMS`` on good texts: junk comes in kinds
    that trip different labellers, and without the bound one kind would be a class and the others noise of the rest.
    """
    table, n = unpacked(patterns), n.astype(float)
    bad = (table == BAD).astype(float)
    p = np.where(bad.sum(axis=1) >= 2, 0.1, 0.9)
    for _ in range(rounds):
        hits = [((n * q) @ bad + 0.05) / ((n * q).sum() + 1) for q in (1 - p, p)]
        found, false = np.clip(hits[0], 0.02, 0.98), np.clip(hits[1], 1e-4, FALSE_ALARMS)
        share = np.clip((n * p).sum() / n.sum(), 0.01, 0.99)
        odds = (np.log(share / (1 - share)) + bad @ np.log(false / found) + (1 - bad) @ np.log((1 - false) / (1 - found)))
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    right = (n * p) @ (table == GOOD) + (n * (1 - p)) @ bad
    return p, right / np.maximum(n @ (table != NONE), 1)


def _pattern(column: str) -> F.Column:
    """The votes of a text as one number."""
    @F.arrow_udf("long")
    def pattern(texts: pa.Array) -> pa.Array:
        parts = [packed(votes(words_of(b.column("text")))) for b in blocks(pa.record_batch([texts], names=["text"]))]
        return pa.array(np.concatenate(parts) if parts else [], pa.int64())
    return pattern(column)


def classified(docs: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """``doc_id, votes_good, votes_bad, posterior, score, quality, kept`` of each row.

    ``posterior`` is the label model's, ``score`` the linear scorer's, ``quality`` their mean weighted by ``PRIOR_BYTES``
    and the text's bytes; a text is kept if its quality is at least ``keep``.  Null and empty texts have one bad vote,
    score and quality 0, and are not kept.  Where all posteriors lean to one side there is
    nothing to fit, and the score is the posterior.  Ids and other columns play no part in a verdict.
    """
    source = written(docs.select(F.xxhash64("doc_id", "text").alias("h"), F.col("text").isNotNull().alias("known"),
                                 _pattern("text").alias("pattern")), "votes")
    # one row for each combination of votes
    seen = source.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toArrow()
    patterns = seen.column("pattern").to_numpy()
    posterior, _ = label_model(patterns, seen.column("n").to_numpy()) if len(patterns) else (np.zeros(0), None)
    leaning = [patterns[(posterior < 0.5)], patterns[posterior >= 0.5]]
    weights = bias = None
    if all(len(x) for x in leaning):
        ids = source.filter("known")
        picked = reduce(DataFrame.unionByName, [
            ids.filter(_among("pattern", x)).groupBy("h", "pattern").agg(F.lit(1)).select("h", "pattern").orderBy("h").limit(sample)
            for x in leaning])

        def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks(batch):
                    w = words_of(block.column("text"))
                    yield pa.RecordBatch.from_arrays(
                        [block.column("h"), block.column("pattern"),
                         pa.array([x.astype(np.int32).tobytes() for x in ngrams.counts(w.offsets, w.data)], pa.binary())],
                        names=["h", "pattern", "counts"])

        got = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text").join(F.broadcast(picked), "h").select(
            "h", "pattern", "text").dropDuplicates(["h"]).mapInArrow(describe, "h long, pattern long, counts binary").toArrow().sort_by("h")
        rows = np.stack([np.frombuffer(x.as_buffer(), np.int32) for x in got.column("counts")]).astype(np.float32)
        rows /= np.maximum(rows.sum(axis=1, keepdims=True), 1)
        target = posterior[np.searchsorted(patterns, got.column("pattern").to_numpy())]
        good = target >= 0.5
        weight = np.where(good, 1 / max(1, good.sum()), 1 / max(1, (~good).sum()))
        w, b = ngrams.fit(rows, target, weight, "logistic")
        weights, bias = ngrams.whole(w)[None, :], np.array([b])

    @F.arrow_udf("struct<votes_good: int, votes_bad: int, posterior: double, score: double, quality: double>")
    def score(texts: pa.Array) -> pa.Array:
        parts = []
        for block in blocks(pa.record_batch([texts], names=["text"])):
            w = words_of(block.column("text"))
            table = votes(w)
            p = posterior[np.searchsorted(patterns, packed(table))]
            s = p if weights is None else 1 / (1 + np.exp(-np.clip(
                ngrams.scores(w.offsets, w.data, weights, bias)[:, 0], -40, 40)))
            size = np.diff(w.offsets)
            mixed = (size * s + PRIOR_BYTES * p) / (size + PRIOR_BYTES)
            parts.append(((table == GOOD).sum(axis=1), (table == BAD).sum(axis=1), p, np.where(w.n > 0, s, 0.0),
                          np.where(w.n > 0, mixed, 0.0)))
        columns = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0)] * 5
        return pa.StructArray.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), *[pa.float64()] * 3))],
            ["votes_good", "votes_bad", "posterior", "score", "quality"])

    return docs.select("doc_id", score("text").alias("s")).select(
        "doc_id", "s.*", (F.col("s.quality") >= keep).alias("kept"))


def _among(column: str, patterns: np.ndarray):
    """Membership in a set of vote combinations."""
    chosen = np.sort(patterns)

    @F.arrow_udf("boolean")
    def among(x: pa.Array) -> pa.Array:
        return pa.array(np.isin(x.to_numpy(), chosen))
    return among(column)
