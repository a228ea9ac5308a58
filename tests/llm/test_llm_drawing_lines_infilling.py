"""Resampling, line dedup and infilling against brute force and SQL, on awkward rows, hot groups and an empty table."""

import math
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import pytest
from llm_brute import awkward
from oracle import compare, connect
from pyspark.sql import functions as F

from tidegate.llm import infilling, line_dedup, resampling
from tidegate.llm.common import written
from tidegate.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def key(row):
    return tuple((x is not None, x) for x in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def sha(text):
    return sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    return awkward(spark).cache()


@pytest.fixture(scope="module")
def sql():
    return connect(SF)


@pytest.mark.parametrize("name", ["op12_line_dedup", "op13_infilling"])
def test_queries_match_sql(spark, sql, name):
    ok, message = compare(spark, sql, name, QUERIES[name], ORACLES[name], SF)
    assert ok, message


# resampling

def features(text):
    w = WORD.findall((text or "").translate(SMALL))
    return w, [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]


def brute_draw(rows, target, share=25, min_words=20, buckets=10_000):
    def counts(texts):
        c = Counter(crc32(f.encode()) % buckets for t in texts for f in features(t)[1])
        return c, sum(c.values())
    (s, s_all), (t, t_all) = counts(x for _, x in rows), counts(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for doc, text in rows:
        w, f = features(text)
        weight = sum(gain[crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(sha(f"7:{'' if doc is None else doc}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc, len(f), weight, score, len(w), sha256((text or "").encode()).digest()))
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[5]))
    drawn = able[: len(able) * share // 100]
    rank, left = defaultdict(list), Counter()
    for i, r in enumerate(drawn):
        rank[r].append(i + 1)
    return [(*r[:4], rank[r].pop(0) if rank[r] else None) for r in out]


def test_resampling_matches_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_draw([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    got = QUERIES["op11_importance_resampling"](spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    same(got.collect(), want)


def test_resampling_awkward_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    target = spark.createDataFrame([("the quick brown fox",), (None,), ("",)], "text string")
    for share in (0, 25, 50, 100):
        same(resampling.resampled(odd, target, share).collect(),
             brute_draw(rows, ["the quick brown fox", None, ""], share))


def test_resampling_without_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resampled(none, none).collect() == []
    assert resampling.resampled(odd, none.select("text")).filter("rank is not null").count() > 0


def test_words_of_a_long_text_do_not_depend_on_its_pieces(monkeypatch):
    text = " ".join(f"Word{i} é{i}" for i in range(400)) + " " + "x" * 500 + "  , end"
    whole = [f for _, found in resampling.feature_buckets(text) for f in found]
    monkeypatch.setattr(resampling, "PIECE_BYTES", 50)
    assert sorted(f for _, found in resampling.feature_buckets(text) for f in found) == sorted(whole)
    assert len(whole) == 2 * 802 - 1


@pytest.mark.parametrize("shape", ["distinct", "tied", "equal", "sorted"])
def test_cutoff_is_the_exact_key(spark, shape):
    draw = random.Random(3)
    score = {"distinct": lambda i: draw.randrange(10 ** 9), "tied": lambda i: draw.randrange(3),
             "equal": lambda i: 5, "sorted": lambda i: i}[shape]
    rows = [(score(i), None if i % 50 == 0 else 4 if shape == "equal" and i % 3 else draw.randrange(400), b"r" * (i % 4))
            for i in range(2_000)]
    keys = written(spark.createDataFrame(rows, "score long, doc_id long, row binary").repartition(7), "keys")
    order = sorted(rows, key=resampling._order)
    for k in (1, 2, 499, 1_000, 1_999, 2_000):
        assert tuple(resampling.cutoff(keys, k, few=16)) == order[k - 1]
    assert resampling.cutoff(keys, 0) is None


# lines

def brute_lines(rows, least=20, docs=3):
    holders = defaultdict(set)
    lines = [(doc, (text or "").split("\n")) for doc, text in rows]
    line_key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(SMALL)
    low = lambda d: (d is not None, d or 0)
    for doc, ls in lines:
        for x in ls:
            if len(line_key(x)) >= least:
                holders[line_key(x)].add(low(doc))
    out = []
    for doc, ls in lines:
        kept = [x for x in ls if len(holders[line_key(x)]) < docs or low(doc) == max(holders[line_key(x)])]
        out.append((doc, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return out


def line_rows():
    draw, menu = random.Random(5), "Accept all cookies to go on reading"
    rows = []
    for i in range(300):
        lines = [f" {menu} \t" if draw.random() < 0.6 else f"own line of document number {i}"]
        lines += [f"shared line number {draw.randrange(60):04d} of many", "short", ""] * draw.randrange(4)
        lines += [menu.upper()] * draw.randrange(3) + ["é" * draw.choice([19, 20])]
        draw.shuffle(lines)
        rows.append((draw.choice([None, i, i, i, i // 2]), draw.choice(["\n", "\n", "\r\n"]).join(lines)))
    return rows + [(7, None), (8, ""), (9, "\n\n"), (None, None), (500, "\n".join([menu] * 3000)), (501, menu)] + [(77, menu)] * 40


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 2), (6, 3)])
def test_lines_match_brute_force(spark, batches, fanout):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    same(line_dedup.digests(docs, batches=batches, fanout=fanout).collect(), brute_lines(rows))


def test_lines_awkward_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    same(line_dedup.digests(odd, min_chars=3, min_docs=2).collect(), brute_lines(rows, 3, 2))
    clash = odd.withColumns({c: F.lit(c) for c in ("doc", "row", "gone", "lines", "d", "at", "key", "top", "batch")})
    kept = line_dedup.without_common_lines(clash, 3, 2)
    assert kept.columns == [*clash.columns, "n_lines", "n_dropped"]
    assert kept.filter("gone <> 'gone' or d <> 'd' or lines <> 'lines'").count() == 0 and kept.count() == len(rows)


def test_lines_without_rows(spark):
    assert line_dedup.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_store_holds_disjoint_levelled_runs(spark):
    draw, store, seen = random.Random(1), line_dedup.LineStore(spark, fanout=2), defaultdict(set)
    for batch in (3, 0, 2, 1, 4):  # in any order
        rows = [(bytes([draw.randrange(40)]), batch * 10 + draw.randrange(10)) for _ in range(60)]
        for k, doc in rows:
            seen[k].add(doc)
        store.add(spark.createDataFrame(rows, "key binary, doc long"))
    assert [len(level) for level in store.levels] == [1, 0, 1]
    keys = [bytes(r.key) for run in store.runs for r in run.collect()]
    assert sorted(keys) == sorted(seen)
    got = {bytes(r.key): r.top for r in store.common(4).collect()}
    assert got == {k: max(v) for k, v in seen.items() if len(v) >= 4}
    plan = store.runs[0].select("key", F.lit(1).alias("a")).hint("merge").join(store.runs[1], "key", "left")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    store.close()


# infilling

def brute_infilling(doc, text, rate=100, spm=50):
    text = text or ""
    units = UNIT.findall(text)
    n, h = len(units), sha(f"7:{'' if doc is None else doc}")
    h = [int(h[8 * i: 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc, n, form, len(p), len(m), sha(out), sha(text)


def test_infilling_awkward_rows(spark, odd):
    more = [(100 + i, t) for i, t in enumerate(
        ["a <P> b", "<S>", "x<M", "<\n<S\n>\nP>", "\n", "\n\n\n", "one", "a\nb", "a\r\nb c\x85d\n", "$1 \\1 \\\n\\E$\n",
         "\U0001f642\n漢\n" * 50])] + [(None, "no id\nat all\n")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for rate, spm in ((100, 50), (60, 0), (60, 100), (0, 50)):
        same(infilling.digests(docs, 7, rate, spm).collect(), [brute_infilling(*r, rate, spm) for r in rows])


def test_infilling_millions_of_lines(spark):
    rows = [(1, "a\n" * 1_500_000), (2, "x" * 3_000_000), (3, "\n" * 1_500_000 + "z"), (4, "ab\n" + "c" * 2_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(infilling.digests(docs).collect(), [brute_infilling(*r) for r in rows])


def test_infilling_keeps_other_columns_and_refuses_markers_that_overlap(spark, odd):
    clash = odd.withColumns({c: F.lit(1) for c in ("h", "output", "form", "digest", "pattern")})
    out = infilling.transformed(clash)
    assert set(out.columns) == {*clash.columns, "n", "prefix_chars", "middle_chars"} and out.count() == odd.count()
    assert infilling.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    for bad in (("<P>", "<P>x", "<M>"), ("ab", "ba", "cd"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            infilling.Markers(*bad)
    marks = infilling.Markers("$1\\", "^S.", "(M)")
    out = infilling.transformed(spark.createDataFrame([(1, "a\nb\nc\n"), (2, "d\n\ne")], "doc_id long, text string"), markers=marks)
    assert {r[0] for r in out.select(infilling.restored(F.col("output"), F.col("form"), marks)).collect()} == {"a\nb\nc\n", "d\n\ne"}
    assert out.filter("form = 'plain'").count() == 0
