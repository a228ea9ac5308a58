"""Language of every text: first the family, then one-versus-one linear support vector machines within it.

Features are hashed byte trigrams of the whole text, with ASCII capitals as small letters and ASCII marks as white space.
A family is chosen by one-versus-rest machines; within a family every pair of languages has a machine, and the language
with most wins (then the largest sum of margins, then the first name) is the answer.  Weights are fitted on at most
``SAMPLE`` documents of each language (those with the smallest hash of id and text), which is all that is brought together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm import ngrams
from tidegate.llm.common import written
from tidegate.llm.words import PLAIN, blocks, text_bytes

SAMPLE = 1_000
UNKNOWN = "und"
#: Families by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "austronesian": ("id", "jv", "ms", "tl"),
}


def family_of(lang: str, families: dict[str, tuple[str, ...]] = FAMILIES) -> str:
    return next((f for f, members in families.items() if lang.lower().split("-")[0] in members), lang)


class Model:
    """Machines as rows of one table: families first, then the pairs of each family."""

    def __init__(self, langs: list[str], families: dict[str, tuple[str, ...]] = FAMILIES):
        self.langs = sorted(langs)
        self.of = [family_of(x, families) for x in self.langs]
        self.families = sorted(set(self.of))
        self.members = [[i for i, f in enumerate(self.of) if f == name] for name in self.families]
        self.pairs = [p for m in self.members for p in combinations(m, 2)]
        self.weights = np.zeros((0, ngrams.SIZE), np.int64)
        self.bias = np.zeros(0)

    def fit(self, rows: np.ndarray, lang: np.ndarray) -> Model:
        family = np.array([self.families.index(f) for f in self.of])[lang]
        # two families need one machine, seen from either side
        tasks = [(np.ones(len(lang), bool), family == k) for k in range(self.n_family_machines)]
        tasks += [((lang == a) | (lang == b), lang == a) for a, b in self.pairs]
        found = []
        for chosen, yes in tasks:
            target = np.where(yes[chosen], 1.0, -1.0)
            weight = np.where(target > 0, 1 / max(1, (target > 0).sum()), 1 / max(1, (target < 0).sum()))
            found.append(ngrams.fit(rows[chosen], target, weight, "hinge"))
        self.weights = np.array([ngrams.whole(w) for w, _ in found]).reshape(-1, ngrams.SIZE)
        self.bias = np.array([b for _, b in found])
        return self

    @property
    def n_family_machines(self) -> int:
        return {1: 0, 2: 1}.get(len(self.families), len(self.families))

    def predict(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, score from 0 to 1) of each row."""
        n = len(offsets) - 1
        margins = ngrams.scores(offsets, data, self.weights, self.bias)
        k = self.n_family_machines
        family = np.zeros((n, len(self.families)))
        if k == 1:
            family[:, 0], family[:, 1] = margins[:, 0], -margins[:, 0]
        elif k:
            family = margins[:, :k]
        chosen = family.argmax(axis=1)
        trust = 1 / (1 + np.exp(-2 * np.clip(family.max(axis=1), -50, 50))) if k else np.ones(n)
        best, score = np.zeros(n, np.int64), np.zeros(n)
        for f, members in enumerate(self.members):
            rows = np.flatnonzero(chosen == f)
            wins, sums = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            weakest = np.full((len(rows), len(members)), np.inf)
            for j, (a, b) in enumerate(self.pairs):
                if a in members:
                    m = margins[rows, k + j]
                    for lang, side in ((a, m), (b, -m)):
                        i = members.index(lang)
                        wins[:, i] += side > 0
                        sums[:, i] += side
                        weakest[:, i] = np.minimum(weakest[:, i], side)
            top = np.lexsort((-np.arange(len(members))[None, :].repeat(len(rows), 0), sums, wins), axis=1)[:, -1]
            best[rows] = np.array(members)[top]
            low = weakest[np.arange(len(rows)), top]
            score[rows] = trust[rows] * np.where(np.isinf(low), 1, 1 / (1 + np.exp(-2 * np.clip(low, -50, 50))))
        return best, score


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets, data = text_bytes(column)
    return offsets, PLAIN[data]


def held_out() -> F.Column:
    """Documents that only test: crc32 of the id's text leaves 1 when divided by 3; never for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Machines for the languages of the learning documents (known id, text and language, not held out)."""
    known = docs.select("doc_id", "text", "lang", F.xxhash64("doc_id", "text").alias("h")).filter(
        "doc_id is not null and text is not null and lang is not null").filter(~held_out())
    # rows that repeat count once; counts of ranges of hashes tell how far the sample of each language reaches, so that
    # hardly more than the sample of a language meets in one task
    ids = written(known.groupBy("lang", "h").agg(F.shiftright("h", 50).alias("part")), "languages")
    ranges = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    reach = ids.groupBy("lang", "part").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(ranges), F.lit(0))).filter(F.col("before") < sample).groupBy("lang").agg(
        F.max("part").alias("reach"))
    near = ids.join(F.broadcast(reach), "lang").filter("part <= reach")
    order = Window.partitionBy("lang").orderBy("h")
    chosen = near.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample).select("lang", "h")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                table = [x.astype(np.int32) for x in ngrams.counts(*_features(block.column("text")))]
                yield pa.RecordBatch.from_arrays(
                    [block.column("h"), block.column("lang"), pa.array([x.tobytes() for x in table], pa.binary())],
                    names=["h", "lang", "counts"])

    got = known.select("h", "lang", "text").join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).mapInArrow(
        describe, "h long, lang string, counts binary").toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    names = got.column("lang").to_pylist()
    model = Model(sorted(set(names)))
    if not names:
        return model
    rows = np.stack([np.frombuffer(x.as_buffer(), np.int32) for x in got.column("counts")]).astype(np.float32)
    rows /= np.maximum(rows.sum(axis=1, keepdims=True), 1)
    return model.fit(rows, np.array([model.langs.index(x) for x in names]))


def predicted(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row.

    A null text, a text without a letter, and any text where nothing could be learned is ``und`` with score 0.  The
    prediction uses the text alone: equal texts get equal results whatever their other columns hold.
    """
    model = train(docs, sample)
    names = pa.array(model.langs, pa.string())

    @F.arrow_udf("struct<lang: string, score: double>")
    def guess(texts: pa.Array) -> pa.Array:
        langs, scores = [], []
        for block in blocks(pa.record_batch([texts], names=["text"])):
            best, score = model.predict(*_features(block.column("text")))
            langs += best.tolist()
            scores += score.tolist()
        return pa.StructArray.from_arrays([names.take(pa.array(langs, pa.int64())), pa.array(scores, pa.float64())],
                                          ["lang", "score"])

    known = F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    rows = docs.select("doc_id", held_out().alias("held_out"), known.alias("known"),
                       (guess("text") if model.langs else F.lit(None).cast("struct<lang: string, score: double>")).alias("g"))
    return rows.select(
        "doc_id", "held_out",
        F.when(F.col("known") & F.lit(bool(model.langs)), F.col("g.lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("known") & F.lit(bool(model.langs)), F.col("g.score")).otherwise(0.0).alias("score"))
