"""Documents that hold a benchmark item, whole, edited or paraphrased in part.

An alignment (Smith-Waterman, match +1, mismatch and gap -1) of score S has at most one run of matches more than it has
errors, so it matches at least S - 1 pairs of neighbouring words of the item.  No alignment of an item of three words or
more that reaches the threshold is lost on the way:

1. *Seeds*: pairs of neighbouring words of the items.  In how many documents each occurs is counted over the whole corpus.
2. *Rare seeds* of an item are its rarest ones, just so many that no alignment can reach the threshold without any of
   them, however often they occur.
3. Where a rare seed of an item stands, the words around it are looked at: if they hold as many of the item's seeds as the
   threshold implies, they are aligned with the item; the score is divided by the item's number of words.

Both passes only read the documents: nothing of their text is shuffled.  Items are taken in blocks of a fixed size, each
against all documents, so what a task holds does not grow with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.words import U64, Words, blocks, inside, window_hashes, words_of

SEED_WORDS = 2
THRESHOLD = 0.5
#: Items held by a task at once, and bytes of their text.
BLOCK_ITEMS = 20_000
BLOCK_TEXT = 16 << 20
#: Seeds of items looked up at once.
BLOCK_PLACES = 1 << 20


class Items:
    """Words and seeds of a block of benchmark items, in flat arrays."""

    def __init__(self, ids: list[int], words: Words, threshold: float = THRESHOLD):
        self.ids = np.array(ids, np.int64)
        self.words, self.first, self.n = words.hash, words.first, words.n
        self.width = np.minimum(self.n, SEED_WORDS)  # an item of one word is its own seed
        self.sizes = np.unique(self.width[self.n > 0]).tolist()
        row, at, seeds = words.row(), [np.zeros(0, np.int64)], [np.zeros(0, U64)]
        for size in self.sizes:
            ok = np.flatnonzero(inside(words, size))
            ok = ok[self.width[row[ok]] == size]
            at.append(ok)
            seeds.append(window_hashes(words.hash, size)[ok])
        at, seeds = np.concatenate(at), np.concatenate(seeds)
        order = np.argsort(at)
        self.item = row[at[order]].astype(np.int64)
        self.place = at[order] - self.first[self.item]
        self.seeds, self.which = np.unique(seeds[order], return_inverse=True)
        self.of = np.searchsorted(self.item, np.arange(len(self.ids) + 1))  # an item's places in ``which``
        least = np.ceil(threshold * self.n - 1e-9).astype(np.int64)
        self.slack = np.maximum(self.n - least, 0)  # errors that an alignment can have
        self.need = np.maximum(least - 1, 1)        # of an item's seeds in an alignment

    def keep_rare(self, documents: np.ndarray) -> None:
        """``documents``: in how many each of ``seeds`` occurs."""
        order = np.lexsort((self.place, documents[self.which], self.item))
        rank = np.arange(len(order)) - self.of[self.item[order]]
        live = order[rank <= (np.diff(self.of) - self.need)[self.item[order]]]
        live = live[np.argsort(self.which[live], kind="stable")]
        self.rare_item, self.rare_place = self.item[live], self.place[live]
        self.start = np.searchsorted(self.which[live], np.arange(len(self.seeds) + 1))


def find_seeds(w: Words, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(word position, seed number) of every seed of a block of documents."""
    pos, seed = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in items.sizes:
        g = window_hashes(w.hash, size)
        if len(g):
            at = np.minimum(np.searchsorted(items.seeds, g), len(items.seeds) - 1)
            hit = np.flatnonzero((items.seeds[at] == g) & inside(w, size))
            pos.append(hit)
            seed.append(at[hit])
    return np.concatenate(pos), np.concatenate(seed)


def local_score(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(best Smith-Waterman score, position after its last word in ``text``), a row of the table at a time."""
    j = np.arange(1, len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    best = end = 0
    for word in item:
        new = np.maximum(np.maximum(row[:-1] + np.where(text == word, 1, -1), row[1:] - 1), 0)
        row[1:] = np.maximum.accumulate(new + j) - j
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, number within the group) of the members of groups of ``count``."""
    group = np.repeat(np.arange(len(count)), count)
    return group, np.arange(len(group)) - (np.cumsum(count) - count)[group]


def windows(w: Words, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, first word, word after the last) of the stretches that may hold an item."""
    pos, seed = find_seeds(w, items)
    hit, k = spread(items.start[seed + 1] - items.start[seed])
    entry = items.start[seed[hit]] + k
    item, row = items.rare_item[entry], np.searchsorted(w.first, pos, side="right")[hit] - 1
    low = pos[hit] - items.rare_place[entry] - items.slack[item]
    high = np.minimum(low + items.n[item] + 2 * items.slack[item], w.first[row + 1])
    low = np.maximum(low, w.first[row])
    order = np.lexsort((high, low, item, row))
    row, item, low, high = row[order], item[order], low[order], high[order]
    new = np.ones(len(order), bool)  # ``high`` grows with ``low``
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1])
    last = np.roll(new, -1)
    row, item, low, high = row[new], item[new], low[new], high[last]
    at = np.sort(seed * (len(w.hash) + 1) + pos)
    keep = np.zeros(len(row), bool)
    size = np.diff(items.of)[item]
    cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(size) // BLOCK_PLACES)) + 1, len(row)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        group, k = spread(size[a:b])
        key = items.which[items.of[item[a:b]][group] + k] * (len(w.hash) + 1)
        end = (high - items.width[item] + 1)[a:b]
        held = np.searchsorted(at, key + low[a:b][group]) < np.searchsorted(at, key + end[group])
        keep[a:b] = np.bincount(group[held], minlength=b - a) >= items.need[item[a:b]]
    return row[keep], item[keep], low[keep], high[keep]


def align(w: Words, items: Items) -> list[tuple[int, int, float, int]]:
    """(row, item, score, end word) of the best alignment of every document and item that may reach the threshold."""
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for row, item, start, end in zip(*(x.tolist() for x in windows(w, items))):
        words = items.words[items.first[item]: items.first[item + 1]]
        score, last = local_score(words, w.hash[start:end])
        found = (score / len(words), start + last - int(w.first[row]))
        if (row, item) not in best or found[0] > best[row, item][0]:
            best[row, item] = found
    return [(r, it, s, e) for (r, it), (s, e) in best.items()]


def item_blocks(benchmark: DataFrame, threshold: float = THRESHOLD) -> Iterator[Items]:
    """The items in blocks of a fixed size; items without words can't be looked for."""
    rows = benchmark.filter("item_id is not null").select("item_id", F.lower("text").alias("text"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    n = max(1, -(-size.n // BLOCK_ITEMS), -(-size.b // BLOCK_TEXT))
    for i in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i).orderBy("item_id", "text").collect()
        yield Items([r.item_id for r in part], words_of(pa.array([r.text for r in part], pa.string()), plain=True), threshold)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, score, end_word`` of each document and item whose alignment scores ``threshold`` or more.

    ``score`` is the alignment's score over the item's number of words, ``end_word`` the number of words (in lower case,
    ASCII marks being white space) before the end of the best alignment in the document.  Null and empty texts match
    nothing; items without words or an id can't be looked for, items of one or two words are found as whole copies.
    Equal rows of ``docs`` give equal rows; other columns play no part.
    """
    source = docs.select("doc_id", F.lower("text").alias("text"))

    def found(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in blocks(batch):
                    hits = [x for x in align(words_of(block.column("text"), plain=True), items) if x[2] >= threshold]
                    row, item, score, end = zip(*hits) if hits else ((), (), (), ())
                    yield pa.RecordBatch.from_arrays(
                        [block.column("doc_id").take(pa.array(row, pa.int64())),
                         pa.array(items.ids[list(item)], pa.int64()),
                         pa.array(score, pa.float64()), pa.array(end, pa.int64())],
                        names=["doc_id", "item_id", "score", "end_word"])
        return source.mapInArrow(run, "doc_id long, item_id long, score double, end_word long")

    return reduce(DataFrame.unionByName, [found(rare(source, items)) for items in item_blocks(benchmark, threshold)])


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` in which no item was found, judged as in ``leaks``; all columns pass through."""
    def clean(items: Items):
        @F.arrow_udf("boolean")
        def verdict(texts: pa.Array) -> pa.Array:
            parts = []
            for block in blocks(pa.record_batch([texts], names=["text"])):
                bad = np.zeros(block.num_rows, bool)
                bad[[x[0] for x in align(words_of(block.column("text"), plain=True), items) if x[2] >= threshold]] = True
                parts.append(~bad)
            return pa.array(np.concatenate(parts) if parts else [], pa.bool_())
        return verdict

    source = docs.select(F.lower("text").alias("text"))
    text = F.lower(docs["text"])
    return reduce(lambda rows, items: rows.filter(clean(rare(source, items))(text)), item_blocks(benchmark, threshold), docs)


def rare(source: DataFrame, items: Items) -> Items:
    """The items with their rare seeds alone; the corpus is counted whole."""
    seeds = items.seeds

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(seeds), np.int64)
        for batch in batches:
            for block in blocks(batch):
                w = words_of(block.column("text"), plain=True)
                pos, seed = find_seeds(w, items)
                row = np.searchsorted(w.first, pos, side="right") - 1
                once = np.unique(row * max(1, len(seeds)) + seed)
                total += np.bincount(once % max(1, len(seeds)), minlength=len(seeds))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["seed", "n"])

    documents = np.zeros(len(seeds), np.int64)
    # at most one row for each seed of the block
    for r in source.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(
            F.sum("n").alias("n")).collect():
        documents[r.seed] = r.n
    items.keep_rare(documents)
    return items
