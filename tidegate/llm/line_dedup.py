"""Removal of lines that stand in many documents, with a levelled store of sorted runs of line keys.

A line's key is the line without white space at its ends and with ASCII capitals as small letters; the store holds the
first 128 bits of the key's SHA-256.  Documents come in batches, each made of whole documents:

1. The batch's keys are counted (documents, lines, largest id), combined before each shuffle, so a key costs one row
   however often it occurs.
2. They are merged with the store's runs, which are bucketed and sorted by key: only the batch is shuffled, once, whatever
   the number of runs.  Keys that no run holds (the anti side of the merge) become the batch's own run; the others are
   hits.  Runs are therefore disjoint.
3. When a level has ``fanout`` runs they are compacted into one of the next level, so there are few runs to merge with and
   each key is rewritten a logarithmic number of times.

At the end the hits, usually a small part, are added to the runs' counts, and lines whose key is common and whose document
is not the last to hold it are dropped.  A key that fills over a thousandth of all lines (at most a thousand keys do) is
broadcast to its lines; for all others the largest share of one task is bounded by that thousandth.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm.common import new_folder, written

BATCHES, FANOUT = 6, 3
#: A key with more than this share of all lines is joined by broadcast; no more than 1 / HOT_SHARE keys have it.
HOT_SHARE = 1e-3
WHITE = " \t\n\x0b\x0c\r"
#: Stands for a null id, which comes before all others.
NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), string.ascii_uppercase, string.ascii_lowercase)


def lines_of(text: Column) -> Column:
    """All lines of a text; a null or empty one has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineStore:
    """Line keys of all batches so far, in levels of runs; a run holds ``key, docs, lines, top`` of disjoint keys.

    ``add`` takes rows ``key, doc`` of whole documents, in any order of batches and ids; no document may be in two batches.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[list[DataFrame]] = []
        self.hits: list[DataFrame] = []
        self._tables: list[str] = []

    @property
    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _saved(self, df: DataFrame, *partition: str) -> DataFrame:
        """``df`` as files in the shared folder, bucketed and sorted by key."""
        name = f"tidegate_lines_{uuid.uuid4().hex}"
        writer = df.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key")
        if partition:
            writer = writer.partitionBy(*partition)
        writer.option("path", new_folder(self.spark, "line-run")).saveAsTable(name)
        self._tables.append(name)
        return self.spark.table(name)

    def add(self, batch: DataFrame) -> None:
        tally = (batch.groupBy("key", "doc").agg(F.count("*").alias("lines"))
                 .groupBy("key").agg(F.count("*").alias("docs"), F.sum("lines").alias("lines"), F.max("doc").alias("top")))
        held = F.lit(False)
        for i, run in enumerate(self.runs):
            tally = tally.join(run.select("key", F.lit(True).alias(f"held_{i}")), "key", "left")
            held = held | F.coalesce(F.col(f"held_{i}"), F.lit(False))
        parts = self._saved(tally.select("key", "docs", "lines", "top", held.alias("held")), "held")
        self.hits.append(parts.filter("held").drop("held"))
        self._push(0, parts.filter("not held").drop("held"))

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            runs, self.levels[level] = self.levels[level], []
            whole = runs[0]
            for other in runs[1:]:
                whole = whole.unionByName(other)
            self._push(level + 1, self._saved(whole.repartition(self.buckets, "key")))

    def common(self, min_docs: int) -> DataFrame:
        """``key, lines, top`` of keys that at least ``min_docs`` documents hold."""
        hits = self.hits[0]
        for other in self.hits[1:]:
            hits = hits.unionByName(other)
        more = hits.groupBy("key").agg(
            F.sum("docs").alias("more_docs"), F.sum("lines").alias("more_lines"), F.max("top").alias("later"))
        out = None
        for run in self.runs:  # the merge keeps each run where it lies
            part = run.join(more, "key", "left").filter(
                F.col("docs") + F.coalesce("more_docs", F.lit(0)) >= min_docs).select(
                "key", (F.col("lines") + F.coalesce("more_lines", F.lit(0))).alias("lines"), F.greatest("top", "later").alias("top"))
            out = part if out is None else out.unionByName(part)
        return out

    def close(self) -> None:
        """Take the runs' names out of the catalog; their files go with ``common.clear``."""
        for name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._tables.clear()


def _rows(docs: DataFrame) -> list[Column]:
    """Each row's id and a digest of its text, which together name the row."""
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc"),
            F.unhex(F.substring(F.sha2(F.coalesce(docs["text"], F.lit("")), 256), 1, 32)).alias("row")]


def _dropped(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """``doc, row, gone``: numbers of the lines that each text loses; texts that lose none have no row."""
    spark = docs.sparkSession
    rows = docs.select(*_rows(docs), "text")
    cuts = rows.agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    batch = sum((F.when(F.col("doc") > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    keys = (rows.select("doc", "row", batch.alias("batch"), F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
            .withColumn("line", line_key(F.col("line"))).filter(F.char_length("line") >= min_chars)
            .select("doc", "row", "batch", "at", F.unhex(F.substring(F.sha2("line", 256), 1, 32)).alias("key")))
    path = new_folder(spark, "lines")
    keys.write.partitionBy("batch").parquet(path)
    keys = spark.read.schema(keys.schema).parquet(path)
    store = LineStore(spark, fanout)
    for i in range(len(set(cuts)), -1, -1):
        store.add(keys.filter(F.col("batch") == i))
    common = written(store.common(min_docs), "common-lines")
    store.close()
    hot = F.col("lines") > HOT_SHARE * keys.count()
    often, rest = F.broadcast(common.filter(hot).drop("lines")), common.filter(~hot).drop("lines")
    gone = keys.join(often, "key").unionByName(keys.join(often, "key", "left_anti").join(rest, "key")).filter("doc < top")
    return gone.groupBy("doc", "row").agg(F.collect_set("at").alias("gone"))


def without_common_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = BATCHES,
                         fanout: int = FANOUT) -> DataFrame:
    """``docs`` with the lines that stay as ``text``, and ``n_lines`` (before) and ``n_dropped``; these names are replaced.

    Keys of at least ``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines but those
    of the largest id that holds them.  A null or empty text is one empty line.  Rows of one id are one document, and all of
    them keep its lines; rows without id are one document that comes before all others.  A text of which no line stays
    is empty.  Ties: none, ids decide.  An empty table gives an empty result.
    """
    gone = written(_dropped(docs, min_chars, min_docs, batches, fanout), "dropped-lines")
    lines = (docs.select(F.struct("*").alias("d"), *_rows(docs)).join(gone, ["doc", "row"], "left")
             .withColumn("lines", lines_of(F.col("d.text"))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    new = {
        "n_lines": F.size("lines").cast("long"),
        "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
        "text": F.when(F.col("gone").isNull(), F.coalesce("d.text", F.lit(""))).otherwise(
            F.array_join(F.transform(stay, lambda i: F.col("lines")[i]), "\n")),
    }
    names = [*docs.columns, *(c for c in new if c not in docs.columns)]
    return lines.select(*((new[c] if c in new else F.col(f"d.`{c}`")).alias(c) for c in names))


def digests(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of each row."""
    return without_common_lines(docs.select("doc_id", "text"), min_chars, min_docs, batches, fanout).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
