"""Each operator against brute force, a round trip or held-out labels, and on the awkward table and an empty one."""

from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from llm_brute import awkward, base_counts, near_classes, substring_removal, words
from pyspark.sql import functions as F

from tidegate.llm import bpe, decontamination, html_extraction, language_id, near_dedup, quality_classifier
from tidegate.llm import quality_rules, sharding, substring_dedup, token_store
from tidegate.llm.common import components, new_folder
from tidegate.llm.html_blocks import blocks_of
from tidegate.llm.queries import QUERIES
from tidegate.llm.words import U64

SF = "/root/testdata/sf0.001"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def odd(spark):
    return awkward(spark).cache()


@pytest.fixture(scope="module")
def odd_rows(odd):
    return [(r.doc_id, r.text) for r in odd.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def doc_rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def key(row):
    return tuple((x is not None, x) for x in row)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


# 1

def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_blocks_decode_close_and_skip():
    found = blocks_of(page(
        "<p>a &amp; b&nbsp; c<p>d <b>e</b><br>f</p><script>var x='</p>';</script><!-- <p>no</p> --><ul><li>x<li>y</ul>"
        "<div title='1 > 0'>z</div> 1 < 2 <h2>end"))
    assert [b.text for b in found] == ["a & b c", "d e f", "x", "y", "z", "1 < 2", "end"]
    assert found[2].path[-1] == "li" and found[2].path[-2] == "ul"
    assert blocks_of(None) == blocks_of("") == blocks_of("<p> </p>") == []


@pytest.fixture(scope="module")
def made_pages():
    texts = [f"Sentence number {i} tells of things that happen in a place far away." for i in range(60)]
    return html_extraction.PageMaker(texts)


def test_lstm_gradients_match_differences(made_pages):
    net = html_extraction.Lstm(3)
    some = [p for p in made_pages.labelled(4) if p[0]]
    x = html_extraction.vectors([p for p, _ in some]).astype(float)
    n, y = np.array([len(p) for p, _ in some]), np.concatenate([np.array(v, float) for _, v in some])
    _, grad = net.step(x, n, y)
    rng = np.random.default_rng(0)
    for name in ("xf", "hf", "bb", "hb", "o", "c"):
        at = tuple(int(rng.integers(s)) for s in net.p[name].shape)
        old, sides = net.p[name][at], []
        for d in (1e-5, -1e-5):
            net.p[name][at] = old + d
            sides.append(net.step(x, n, y)[0])
        net.p[name][at] = old
        assert abs((sides[0] - sides[1]) / 2e-5 - grad[name][at]) < 1e-6


def test_main_text_of_pages(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet")
    extra = spark.createDataFrame([
        (-1, None, None), (-2, "u", ""), (None, "v", page("<nav><a href=1>x</a></nav><article><h1>Head</h1><p>Body of the "
         "text, long enough.</p><p>More of it &lt;here&gt;.</p></article><footer>&copy; foot</footer>"))],
        "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extraction.extracted(rows.unionByName(extra).withColumn("text", F.lit("x"))).collect()}
    assert got[-1].text == got[-2].text == "" and got[-1].n_chars == 0
    assert got[None].text == "Head\n\nBody of the text, long enough.\n\nMore of it <here>."
    for r in rows.collect():
        inner = r.html.partition("<article>")[2].partition("</article>")[0]
        want = "\n\n".join(b.text for b in blocks_of(inner))
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))
    assert html_extraction.extracted(rows.limit(0)).count() == 0


# 2

def test_label_model_finds_accuracies():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.85
    table = np.full((20_000, len(quality_classifier.LABELLERS)), quality_classifier.GOOD)
    for j in range(4):
        bad = np.where(good, rng.random(20_000) < 0.005, rng.random(20_000) < 0.7)
        table[bad, j] = quality_classifier.BAD
    patterns, n = np.unique(quality_classifier.packed(table), return_counts=True)
    posterior, accuracy = quality_classifier.label_model(patterns, n)
    p = posterior[np.searchsorted(patterns, quality_classifier.packed(table))]
    assert ((p >= 0.5) == good).mean() > 0.97
    assert accuracy[:4].min() > 0.9


def test_quality_classifier(spark, odd, docs, labels):
    known = {r.doc_id: r.quality for r in labels.collect()}
    got = quality_classifier.classified(docs).collect()
    long = {r.doc_id for r in docs.collect() if len(words(r.text)) >= 30}
    right = [r.kept == bool(known[r.doc_id]) for r in got if r.doc_id in known and r.doc_id in long]
    assert len(right) > 40 and sum(right) / len(right) > 0.95
    rows = quality_classifier.classified(odd).collect()
    assert len(rows) == odd.count()
    assert all(not r.kept and r.score == 0 for r in rows if r.doc_id in (4, 5, 6))
    assert len({(r.score, r.kept) for r in rows if r.doc_id == 9}) == 1
    assert quality_classifier.classified(odd.limit(0)).count() == 0


# 3

def test_substring_removal(odd, odd_rows, docs, doc_rows):
    same(substring_dedup.removal(docs, 50).collect(), substring_removal(doc_rows, 50))
    same(substring_dedup.removal(odd, 50).collect(), substring_removal(odd_rows, 50))
    same(substring_dedup.removal(odd, 8).collect(), substring_removal(odd_rows, 8))
    assert substring_dedup.removal(odd.limit(0)).count() == 0


def test_substring_texts_keep_other_columns(odd, odd_rows):
    want = {}
    for (doc, text), (_, _, n, digest) in zip(odd_rows, substring_removal(odd_rows, 50)):
        want.setdefault(doc, []).append((n, text, digest))
    got = substring_dedup.without_repeats(odd, 50)
    assert got.columns == odd.columns
    rows = got.collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert any(r.text == text if not n else sha256(r.text.encode()).hexdigest() == digest
                   for n, text, digest in want[r.doc_id])
    assert Counter(r.k for r in rows) == Counter(r.k for r in odd.collect())


def test_substring_random_texts(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["a", "b", "c"]
    rows = [(int(rng.integers(12)), " ".join(rng.choice(vocabulary, int(rng.integers(0, 40))))) for _ in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    same(substring_dedup.removal(frame, 6).collect(), substring_removal(rows, 6))


# 4

def test_quality_rules(odd, odd_rows, docs, doc_rows, labels):
    for frame, rows in ((docs, doc_rows), (odd, odd_rows)):
        got = quality_rules.judge(frame, labels).collect()
        assert sorted(map(str, [(r.doc_id, *tuple(r)[1:7]) for r in got])) == sorted(
            map(str, [(d, *base_counts(t)) for d, t in rows]))
        assert not any(r.kept and r.base_failed for r in got)
    known = {r.doc_id: r.quality for r in labels.collect()}
    right = [r.kept == bool(known[r.doc_id]) for r in quality_rules.judge(docs, labels).collect()
             if r.doc_id in known and not r.base_failed]
    assert sum(right) / len(right) > 0.97
    assert quality_rules.retained(odd, labels).columns == odd.columns
    assert quality_rules.judge(odd, labels.limit(0)).count() == odd.count()
    assert quality_rules.judge(odd.limit(0), labels).count() == 0


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(4)
    n = [1, 5, 3, 7, 2]
    row = np.repeat(np.arange(5), n)
    emission, change = rng.normal(size=len(row)), rng.normal(size=(2, 2))
    got = quality_rules.viterbi(emission, row, 6, change)
    for r in range(5):
        e = emission[row == r]
        score = {p: sum(e[t] * p[t] for t in range(len(p))) + sum(change[p[t], p[t + 1]] for t in range(len(p) - 1))
                 for p in product((0, 1), repeat=len(e))}
        assert tuple(got[row == r]) == max(score, key=score.get)


# 5

def test_words_one_by_one_give_the_ids_of_whole_texts():
    texts = ["éb ́c  Σας X y 's it's <|endoftext|> A\x1cB", "", "  ",
             "é ΑΣ ΣΑΣ. 가 ᅡ 漢字\U0001f642 x'll\n\t1234 a|b", "a b c\x85d"]
    rng = np.random.default_rng(3)
    pool = list("ab'Z1.́éΣ가 ​　\x1c\x85 \n\t")
    texts += ["".join(rng.choice(pool, 40)) for _ in range(300)]
    assert token_store.splits_at_spaces(WORD_BPE, texts)


def test_token_store(spark, odd, docs):
    tok = token_store.tokenizer(WORD_BPE)
    for frame in (docs, odd):
        folder = new_folder(spark, "test-tokens")
        token_store.write_tokens(frame, WORD_BPE, folder)
        got = sorted(token_store.read_tokens(spark, folder).collect(), key=lambda r: r.start)
        rows = sorted(((r.doc_id, r.text) for r in frame.collect()), key=key)
        start = 0
        for r, (doc, text) in zip(got, rows, strict=True):
            ids = tok.encode(text or "", add_special_tokens=False).ids + [token_store.END_ID]
            raw = np.array(ids, "<u4").tobytes()
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (doc, start, len(ids), crc32(raw), raw)
            start += len(ids)
    assert token_store.read_document(spark, folder, 7) == [
        tok.encode("one two", add_special_tokens=False).ids + [token_store.END_ID]]
    assert len(token_store.read_document(spark, folder, 9)) == 2 and token_store.read_document(spark, folder, 99) == []
    assert token_store.stored(odd.limit(0), WORD_BPE).count() == 0


# 6

def test_fisher_yates_is_a_uniform_permutation():
    orders = Counter(tuple(sharding.fisher_yates(4, 1, b)) for b in range(12_000))
    assert len(orders) == 24 and all(380 < n < 620 for n in orders.values())
    assert list(sharding.fisher_yates(0, 1, 0)) == [] and list(sharding.fisher_yates(1, 1, 0)) == [0]


def test_rows_without_text_fill_many_buckets(spark, monkeypatch):
    assert sharding.bucket_count(0, 0) == 1 and sharding.bucket_count(10, 100 << 20) == 7
    assert sharding.bucket_count(10_000_000, 0) == 77
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    seen = []
    monkeypatch.setattr(sharding, "bucket_starts", lambda c, f=sharding.bucket_starts: seen.append(c.count()) or f(c))
    frame = spark.range(1_000).selectExpr("id AS doc_id", "CAST(NULL AS string) AS text")
    got = sharding.shuffled(frame, shards=4).collect()
    assert seen[0] > 10 and sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(4) for i in range(250)]


def test_sharding(spark, odd, docs):
    for frame in (docs, odd):
        got = sharding.shuffled(frame, shards=8, bucket_bytes=64 << 10).collect()
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        sizes = [len(by.get(s, [])) for s in range(8)]
        assert sum(sizes) == frame.count() and max(sizes) - min(sizes) <= 1
        assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in frame.collect())
    again = sharding.shuffled(docs.repartition(7), shards=8, bucket_bytes=64 << 10).collect()
    first = sharding.shuffled(docs, shards=8, bucket_bytes=64 << 10).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in first}
    out = sharding.digest(odd).collect()
    text = {r.doc_id: r.text for r in odd.collect() if r.doc_id not in (None, 9, 14)}
    assert all((r.size, r.text_crc32) == (len((text[r.doc_id] or "").encode()) + 1, crc32((text[r.doc_id] or "").encode()))
               for r in out if r.doc_id in text)
    assert sharding.digest(docs.limit(0)).count() == 0


# 7

def slow_score(a, b):
    best, table = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = max(0, table[i][j] + (1 if a[i] == b[j] else -1), table[i][j + 1] - 1, table[i + 1][j] - 1)
            best = max(best, table[i + 1][j + 1])
    return best


def test_smith_waterman():
    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = rng.integers(0, 4, int(rng.integers(1, 15))), rng.integers(0, 4, int(rng.integers(0, 25)))
        assert decontamination.local_score(a, b)[0] == slow_score(a.tolist(), b.tolist())


def test_leaks(spark, odd, docs, benchmark):
    items = {r.item_id: r.text for r in benchmark.collect()}
    first, second = sorted(items)[:2]
    w = items[first].split()
    edited = " ".join("other" if i % 8 == 7 else x for i, x in enumerate(w))
    planted = [(1_001, "some words before " + items[first] + " and some after"), (1_002, edited.upper()),
               (1_003, " ".join(w[: len(w) // 3])), (1_004, None), (1_005, ""), (None, items[second])]
    planted += [(2_000 + i, f"page {i} holds " + items[second]) for i in range(60)]
    frame = spark.createDataFrame(planted, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.leaks(frame, benchmark).collect()}
    assert got[1_001, first] == 1.0 and got[1_002, first] >= 0.6 and (1_003, first) not in got
    assert got[None, second] == 1.0 and all((2_000 + i, second) in got for i in range(60))
    assert {d for d, _ in got} == {1_001, 1_002, None, *range(2_000, 2_060)}
    clean = decontamination.without_leaks(frame, benchmark)
    assert {r.doc_id for r in clean.collect()} == {1_003, 1_004, 1_005}
    assert decontamination.without_leaks(odd, benchmark).columns == odd.columns
    assert decontamination.leaks(docs.limit(0), benchmark).count() == 0
    assert decontamination.leaks(docs, benchmark.limit(0)).count() == 0
    # brute force over the table: every document and item, aligned whole
    plain = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split()
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, benchmark).collect()}
    code = defaultdict(lambda: len(code))
    coded = {i: np.array([code[x] for x in plain(t)]) for i, t in items.items()}
    for doc, text in ((r.doc_id, r.text) for r in docs.orderBy("doc_id").limit(80).collect()):
        d = np.array([code[x] for x in plain(text)])
        for i, a in coded.items():
            assert (decontamination.local_score(a, d)[0] / len(a) >= decontamination.THRESHOLD) == ((doc, i) in found)


def test_leaks_that_repeat(spark):
    """Many documents with one edit in common, with a part of an item or with short matching runs, against brute force."""
    rng = np.random.default_rng(11)
    stock = [f"s{i}" for i in range(12)]
    items = {i: [f"i{i}w{k}" for k in range(30)] for i in range(4)}
    items[3][:15] = [stock[k % 12] for k in range(15)]  # half of it in every other document too
    noise = lambda n: [f"x{k}" for k in rng.integers(0, 500, n)]
    texts = []
    for _ in range(60):
        texts.append(noise(20) + items[0][:14] + ["edit"] + items[0][15:] + noise(20))
        texts.append(noise(20) + items[1][:20] + noise(20))
        texts.append(noise(9) + [x for k, w in enumerate(items[2]) for x in ([w, "new"] if k % 3 == 2 else [w])] + noise(9))
        texts.append(stock + noise(5) + stock)
    texts += [items[3] + noise(5), items[3][:15], items[3][15:], items[3][16:], [x for w in items[0] for x in (w, "and")]]
    docs = spark.createDataFrame(list(enumerate(map(" ".join, texts))), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    code = defaultdict(lambda: len(code))
    coded = {i: np.array([code[x] for x in w]) for i, w in items.items()}
    for threshold in (0.5, 0.8):
        want = {}
        for d, w in enumerate(texts):
            for i, a in coded.items():
                score = decontamination.local_score(a, np.array([code[x] for x in w]))[0] / len(a)
                if score >= threshold:
                    want[d, i] = score
        got = {(r.doc_id, r.item_id): r.score for r in decontamination.leaks(docs, bench, threshold).collect()}
        assert got == want and len(want) >= (180 if threshold == 0.5 else 60)
        clean = {r.doc_id for r in decontamination.without_leaks(docs, bench, threshold).collect()}
        assert clean == set(range(len(texts))) - {d for d, _ in want}


def test_leaks_of_short_items(spark):
    bench = spark.createDataFrame([(1, "Zeta."), (2, "alpha beta"), (3, "one two three"), (4, "--"), (5, None)],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(1, "a zeta b"), (2, "alpha, beta; zeta"), (3, "alpha x beta"), (4, "x one two three y"),
                                  (5, "one two"), (6, "two y three"), (7, None), (8, "zeta")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.leaks(docs, bench).collect()}
    assert got == {(1, 1): 1, (2, 1): 1, (2, 2): 1, (4, 3): 1, (5, 3): 2 / 3, (8, 1): 1}
    assert {r.doc_id for r in decontamination.without_leaks(docs, bench).collect()} == {3, 6, 7}


# 8

def test_bagminhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 2 ** 63, 160).astype(U64)
        a, b = np.arange(90), np.r_[np.arange(60), np.arange(90, 150)]
        wa = rng.integers(1, 9, 160)
        wb = np.where(np.arange(160) < 60, np.maximum(1, wa + rng.integers(-2, 3, 160)), wa)
        both = np.minimum(wa[:60], wb[:60]).sum()
        truth = both / (wa[a].sum() + wb[b].sum() - both)
        a, b = a[np.argsort(pool[a])], b[np.argsort(pool[b])]
        s = near_dedup.signatures(np.r_[np.zeros(90, int), np.ones(120, int)], np.r_[pool[a], pool[b]],
                                  np.r_[wa[a], wb[b]], 2, 130)
        errors.append((s[0] == s[1]).mean() - truth)
    assert abs(np.mean(errors)) < 0.02


def test_near_classes(spark, odd, odd_rows, docs, doc_rows):
    for frame, rows in ((docs, doc_rows), (odd, odd_rows)):
        want = near_classes(rows)
        got = near_dedup.classes(frame).collect()
        assert len(got) == len(rows)
        assert all(r.class_id == want.get(r.doc_id) for r in got)
    kept = near_dedup.one_of_each(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {None, *(d for d, c in near_classes(odd_rows).items() if c == d)}
    assert near_dedup.classes(odd.limit(0)).count() == 0


def test_links_that_no_leader_shows(spark, monkeypatch):
    """A cloud of texts around the threshold, with small blocks, so that every step is used."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for d in range(60):
        w = list(base)
        for at in rng.integers(0, 150, int(rng.integers(1, 6))):
            w[at] = f"n{d}_{at}"
        rows.append((d, " ".join(w)))
    rows += [(100 + d, " ".join(base[:100] + [f"t{d}_{i}" for i in range(int(rng.integers(30, 60)))])) for d in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = near_classes(rows)
    assert {r.doc_id: r.class_id for r in near_dedup.classes(frame).collect()} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}


# 9

def test_pieces_encode_like_the_whole():
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    text = ("It's 12 o'clock éß  \n\n they'll  漢字 a1 b2\t  ..." + "x" * 50) * 60
    cut = list(bpe.pieces(text, 100))
    assert "".join(cut) == text and len(cut) > 10
    assert [i for p in cut for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    assert list(bpe.pieces("y" * 1_000, 100)) == ["y" * 1_000]


def test_byte_bpe(odd, docs):
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for frame in (docs, odd):
        got = bpe.digests(frame, RANKS, public_tokenizers.PATTERN).collect()
        want = []
        for r in frame.collect():
            ids = enc.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         sha256((r.text or "").encode()).hexdigest()))
        same(got, want)
    back = bpe.encoded(odd, RANKS, public_tokenizers.PATTERN).withColumn(
        "back", bpe.decoder(RANKS, public_tokenizers.PATTERN)("ids").cast("string"))
    assert all(r.back == (r.text or "") for r in back.collect())
    assert bpe.digests(odd.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# 10

def test_language(odd, docs):
    known = {r.doc_id: r.lang for r in docs.collect()}
    got = language_id.predicted(docs).collect()
    tested = [r.lang_pred == known[r.doc_id] for r in got if r.held_out]
    assert len(tested) > 40 and sum(tested) / len(tested) > 0.97
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    rows = language_id.predicted(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.lang_pred == "und" for r in rows if r.doc_id in (4, 5, 6, 11))
    assert all(not r.held_out for r in rows if r.doc_id is None)
    assert language_id.predicted(odd.limit(0)).count() == 0
    nothing = language_id.predicted(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_three_families_and_three_languages_in_one():
    model = language_id.Model(["da", "de", "en", "fi", "fr", "es"])
    assert model.families == ["germanic", "romance", "uralic"] and model.n_family_machines == 3
    assert len(model.pairs) == 4 and language_id.family_of("xx") == "xx"


def test_one_query_for_each_operator():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []
