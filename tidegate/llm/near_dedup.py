"""Near duplicates by weighted Jaccard similarity of word shingles: BagMinHash signatures, bands, exact overlap.

*Signature.*  A text is a multiset of five-word shingles; a shingle's weight is how often it occurs.  The weight axis is
cut into the intervals (0, 1], (1, 2], (2, 4], (4, 8] and so on.  Every shingle and interval has a Poisson process in time
whose rate is the interval's width, and each of its points has a uniform weight coordinate and a uniform signature
component.  A point counts if its coordinate is at most the shingle's weight, so light shingles never look at the
intervals above them, and heavy ones share all lower intervals' points.  A component's value is the earliest time that
counts for it.  Two multisets agree in a component with the probability of their weighted Jaccard similarity.  Points are
drawn in order of time and only up to the time by which every component is filled.

*Candidates.*  ``BANDS`` bands of ``ROWS`` components: a pair of similarity 0.8 shares no band with probability 3e-5.

*Verification.*  Multiset overlap is counted exactly.  In each bucket the members are compared with one leader; what is
connected by then needs no further comparison.  Members of buckets that still hold several components are compared in
blocks of a bounded size, every pair that lies in different components: sizes and two upper bounds of the overlap rule
most of them out, the rest is counted, and a link joins two components, so that a block gives fewer links than it has
members.  No link between components is lost, and no bucket emits its pairs.  Texts with equal multisets are one
representative throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import components, list_array, written
from tidegate.llm.words import U64, Words, blocks, inside, mix, signed, span_hashes, window_hashes, words_of

SHINGLE_WORDS = 5
BANDS, ROWS = 26, 5
#: Similarity, as a fraction, so that the comparison is exact in whole numbers.
SIMILAR = (4, 5)
#: What is compared in one go: members of a bucket, bytes of their multisets; and cells of the first comparison.
BLOCK_ROWS = 4_096
BLOCK_BYTES = 16 << 20
CELLS = 256


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each shingle; a text of one to four words is one shingle of all of them."""
    at = np.flatnonzero(inside(w, SHINGLE_WORDS))
    row, h = w.row()[at], window_hashes(w.hash, SHINGLE_WORDS)[at]
    short = np.flatnonzero((w.n > 0) & (w.n < SHINGLE_WORDS))
    if len(short):
        row = np.concatenate([row, short])
        h = np.concatenate([h, span_hashes(w.hash, w.first[short], w.n[short], 0)])
    order = np.lexsort((h, row))
    return row[order], h[order]


def counted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, weight) of sorted shingles."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], h[first], np.diff(np.append(first, len(h)))


def _uniform(h: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((h >> U64(11)).astype(np.float64) + 1.0) * 2.0 ** -53


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n_rows: int, size: int) -> np.ndarray:
    """BagMinHash times, a line of ``size`` for each row; rows without shingles stay infinite."""
    out = np.full((n_rows, size), np.inf)
    if not len(row):
        return out
    # intervals (low, low + width] that the weight reaches into
    n_intervals = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    item = np.repeat(np.arange(len(row)), n_intervals)
    level = np.arange(len(item)) - np.repeat(np.cumsum(n_intervals) - n_intervals, n_intervals)
    low = np.where(level == 0, 0, 2.0 ** (level - 1))
    width = np.maximum(low, 1.0)
    line, top = row[item], weight[item]
    seed = mix(h[item] ^ mix(level.astype(U64), 0x2545F4914F6CDD1D))
    clock = np.zeros(len(item))
    total = np.bincount(row, weight, minlength=n_rows)
    horizon = size * (np.log(size) + 3) / np.maximum(total, 1)
    alive, step = np.arange(len(item)), 0
    waiting: list[np.ndarray] = []   # processes whose next point lies beyond the horizon, for rows that need more time
    while True:
        while len(alive):
            step += 1
            point = mix(seed[alive] + U64((step * 0x9E3779B97F4A7C15) & (2 ** 64 - 1)))
            clock[alive] += -np.log(_uniform(point)) / width[alive]
            on_time = clock[alive] <= horizon[line[alive]]
            alive, point = alive[on_time], point[on_time]
            more = mix(point, 0x632BE59BD9B4E019)
            counts = low[alive] + width[alive] * _uniform(more) <= top[alive]
            which = (mix(more, 0x8CB92BA72F3D8DD7)[counts] % U64(size)).astype(np.int64)
            np.minimum.at(out.reshape(-1), line[alive[counts]] * size + which, clock[alive[counts]])
        open_rows = np.flatnonzero(np.isinf(out).any(axis=1) & (total > 0))
        if not len(open_rows):
            return out
        # start these rows anew with twice the time: the same points come again, and more
        horizon[open_rows] *= 2
        again = np.isin(line, open_rows)
        alive, step = np.flatnonzero(again), 0
        clock[alive] = 0.0


def band_keys(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(times).view(U64).reshape(len(times), bands, rows)
    key = np.broadcast_to(mix(np.arange(bands, dtype=U64), 0x1B873593CC9E2D51), (len(times), bands)).copy()
    for i in range(rows):
        key = mix(key ^ bits[:, :, i])
    return key


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch):
            w = words_of(block.column("text"))
            row, h = shingles(w)
            n = np.bincount(row, minlength=block.num_rows)
            end = np.cumsum(n)
            bag = [blake2b(h[e - k: e].tobytes(), digest_size=16).digest() for e, k in zip(end.tolist(), n.tolist())]
            keys = band_keys(signatures(*counted(row, h), block.num_rows, BANDS * ROWS), BANDS, ROWS)
            keys = keys[n > 0]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("k"), pa.array(n), pa.array(bag, pa.binary()),
                 list_array(signed(keys.ravel()), np.where(n > 0, BANDS, 0), pa.int64())],
                names=["doc_id", "k", "n", "bag", "keys"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch):
            row, h = shingles(words_of(block.column("text")))
            n = np.bincount(row, minlength=block.num_rows)
            end = np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [block.column("node"), pa.array([h[e - k: e].tobytes() for e, k in zip(end.tolist(), n.tolist())],
                                                pa.binary())], names=["node", "bag"])


class Bags:
    """Sorted multisets of a run of rows, with two upper bounds of their overlaps.

    ``short`` is the top 16 bits of each entry, sorted as the entries are; ``copy`` numbers its equal values in a row;
    ``coarse`` counts entries in ``CELLS`` cells.
    """

    def __init__(self, column: pa.ChunkedArray):
        self.bag = [np.frombuffer(x.as_buffer(), U64) for x in column]
        self.n = np.array([len(x) for x in self.bag], np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.short = (np.concatenate(self.bag) >> U64(48)).astype(np.uint16)
        row, at = np.repeat(np.arange(len(self.bag)), self.n), np.arange(len(self.short))
        new = np.ones(len(at), bool)
        new[1:] = (self.short[1:] != self.short[:-1]) | (row[1:] != row[:-1])
        self.copy = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.int32)
        self.coarse = np.bincount(row * CELLS + self.short % CELLS, minlength=len(self.bag) * CELLS).reshape(
            -1, CELLS).astype(np.int32)

    def most_coarse(self, x: int, others: np.ndarray) -> np.ndarray:
        return np.minimum(self.coarse[x], self.coarse[others]).sum(axis=1)

    def most_short(self, x: int, others: np.ndarray) -> np.ndarray:
        have = np.bincount(self.short[self.first[x]: self.first[x] + self.n[x]], minlength=1 << 16)
        n = self.n[others]
        at = np.repeat(self.first[others] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        met = np.append(0, np.cumsum(have[self.short[at]] > self.copy[at]))
        ends = np.cumsum(n)
        return met[ends] - met[ends - n]


def _links(doc: np.ndarray, root: np.ndarray, block: np.ndarray, bags: Bags, start: int) -> list[tuple[int, int]]:
    """Links that join the components of one bucket's two blocks; rows ``start`` onwards of ``bags``."""
    up, down = SIMILAR
    component = np.unique(root, return_inverse=True)[1]
    one = (block == block[0]).all()
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    n, out = bags.n[start: start + len(doc)], []
    for x in left.tolist():
        y = right[right > x] if one else right
        y = y[(component[y] != component[x]) & (np.minimum(n[y], n[x]) * down >= np.maximum(n[y], n[x]) * up)]
        for bound in (bags.most_coarse, bags.most_short):
            if len(y):
                y = y[bound(start + x, start + y) * (up + down) >= up * (n[x] + n[y])]
        for z in y.tolist():
            if component[z] != component[x] and overlap(bags.bag[start + x], bags.bag[start + z]) * (up + down) >= up * (
                    n[x] + n[z]):
                component[component == component[z]] = component[x]
                out.append((min(doc[x], doc[z]), max(doc[x], doc[z])))
    return out


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and pair of blocks; what is held is two blocks of one bucket and a batch."""
    rest: list[pa.RecordBatch] = []

    def links(table: pa.Table) -> pa.RecordBatch:
        cols = {c: table.column(c).to_numpy() for c in ("key", "i", "j", "node", "root", "block")}
        edge = np.ones(table.num_rows, bool)
        edge[1:] = (np.diff(cols["key"]) != 0) | (np.diff(cols["i"]) != 0) | (np.diff(cols["j"]) != 0)
        starts = np.append(np.flatnonzero(edge), table.num_rows)
        bags = Bags(table.column("bag"))
        found = {p for s, e in zip(starts[:-1].tolist(), starts[1:].tolist())
                 for p in _links(*(cols[c][s:e] for c in ("node", "root", "block")), bags, s)}
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*rest, batch])
        same = np.ones(table.num_rows, bool)
        for c in ("key", "i", "j"):
            same &= table.column(c).to_numpy() == table.column(c)[-1].as_py()
        to = table.num_rows - int(same.sum())
        if to:
            yield links(table.slice(0, to))
        rest = table.slice(to).to_batches()
    if rest:
        yield links(pa.Table.from_batches(rest))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted multisets."""
    if not len(a) or not len(b):
        return 0
    # the k-th copy of a value in one meets the k-th in the other
    left, right = np.searchsorted(b, a), np.searchsorted(b, a, side="right")
    copy = np.arange(len(a)) - np.searchsorted(a, a)
    return int((copy < right - left).sum())


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up, down = SIMILAR
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("bag_a"), batch.column("bag_b"))):
            a, b = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
            both = overlap(a, b)
            keep.append(down * both >= up * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays(
            [c.filter(pa.array(keep, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], names=["a", "b"])


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    return written(
        pairs.join(bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
        .join(bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b")
        .select("a", "b", "bag_a", "bag_b").mapInArrow(_compare, "a long, b long"), "edges")


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_shingles`` of each row: the smallest id of the row's class of near duplicates.

    A class is a connected component of links between texts whose shingle multisets have a Jaccard similarity of 0.8 or
    more.  Null and empty texts have no shingles and stand alone; texts of one to four words are alike only if their
    words are equal.  Rows with a null id get a null class and link to nothing.  Rows with one id are one document, which
    links to whatever one of its texts links to.  Other columns play no part.
    """
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("k"))
    sketches = written(source.mapInArrow(_sketch, "doc_id long, k long, n long, bag binary, keys array<long>"), "sketches")
    known = sketches.filter("doc_id is not null and n > 0")
    # rows of one multiset have one size and one signature; its node is its smallest id, if that is no other multiset's
    heads = known.groupBy("bag").agg(
        F.min(F.struct("doc_id", "k")).alias("l"), F.max("doc_id").alias("last"), F.first("n").alias("n"),
        F.first("keys").alias("keys")).select("bag", "l.doc_id", "l.k", "last", "n", "keys")
    heads = written(heads, "multisets")
    several = written(heads.groupBy("doc_id").agg(F.count("*").alias("texts")).filter("texts > 1").select("doc_id"), "several")
    heads = written(heads.join(several.withColumn("shared", F.lit(True)), "doc_id", "left").withColumn(
        "node", F.when(F.col("shared"), F.xxhash64("bag")).otherwise(F.col("doc_id"))).drop("shared"), "heads")
    copies = known.select("bag", F.col("doc_id").alias("b")).join(
        heads.filter("doc_id < last").select("bag", F.col("doc_id").alias("a")), "bag").filter("a <> b").select("a", "b")
    members = heads.select(F.explode("keys").alias("key"), "node", "doc_id", "k", "n")
    full = written(members.groupBy("key").agg(
        F.min(F.struct("node", "n")).alias("l"), F.max("node").alias("last")).filter("l.node < last").select(
        "key", F.col("l.node").alias("leader"), F.col("l.n").alias("m")), "full")
    buckets = written(members.join(full, "key"), "buckets")
    bags = written(source.join(buckets.select("node", "doc_id", "k").distinct(), ["doc_id", "k"]).dropDuplicates(["node"])
                   .mapInArrow(_bags, "node long, bag binary"), "bags")
    sizes = f"least(n, m) * {SIMILAR[1]} >= greatest(n, m) * {SIMILAR[0]}"
    tried = written(buckets.filter("node <> leader").filter(sizes).select(
        F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "tried")
    edges = _verified(tried, bags)
    rooted = written(buckets.select("key", "node", "n").join(components(edges), "node", "left").withColumn(
        "root", F.coalesce("root", "node")), "rooted")
    mixed = written(rooted.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"), F.sum("n").alias("total")).filter(
        "low < high").select("key", F.greatest(F.ceil(F.col("size") / BLOCK_ROWS), F.ceil(F.col("total") * 8 / BLOCK_BYTES))
                             .alias("blocks")), "mixed")
    dealt = rooted.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "root", "block")
    crossed = written(dealt.join(bags, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(
        _cross, "a long, b long"), "crossed")
    edges = edges.unionByName(crossed)
    ids = written(heads.join(several, "doc_id", "left_semi").select("node", "doc_id"), "ids")  # none, if ids are unique
    for end in ("a", "b"):  # nodes of ids with several texts lead back to the id
        edges = edges.join(ids.withColumnsRenamed({"node": end, "doc_id": "id"}), end, "left").withColumn(
            end, F.coalesce("id", end)).drop("id")
    edges = edges.select("a", "b").filter("a <> b")
    roots = components(edges.unionByName(copies))
    return sketches.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").select(
        "doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.col("n").alias("n_shingles"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is their class's smallest, with all their columns; rows with a null id stay."""
    gone = classes(docs).filter("doc_id <> class_id").select("doc_id").distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    key = names[docs.columns.index("doc_id")]
    return docs.toDF(*names).join(gone, F.col(key) == F.col("doc_id"), "left_anti").toDF(*docs.columns)
