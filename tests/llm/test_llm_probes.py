"""Input that broke operators before: white-space runs, words made to collide, repeated ids and rows, unclosed elements."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hashlib import sha256
from tokenizers import Tokenizer

from tidegate.llm import bpe, html_extraction, language_id, near_dedup, quality_classifier, quality_rules
from tidegate.llm import substring_dedup, token_store
from tidegate.llm.html_blocks import blocks_of
from tidegate.llm.words import span_hashes, window_hashes, words_of

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute_ids(enc, text):
    """Long white-space runs taken out by hand: one match, but for the last character ahead of something else."""
    ids, i = [], 0
    while i < len(text):
        j = i
        if text[i].isspace():
            while j < len(text) and text[j].isspace():
                j += 1
            if j - i > 1_000:
                end = j if j == len(text) else j - 1
                ids += enc._encode_single_piece(text[i:end])
                i = end
                continue
        while j < len(text) and not (text[j].isspace() and text[j: j + 1_001].isspace() and len(text[j: j + 1_001]) == 1_001):
            j += 1
        ids += enc.encode_ordinary(text[i:j])
        i = j
    return ids


@pytest.mark.parametrize("run", [" " * 2_000_000, "\n" * 2_000_000, " \n\t　" * 400_000])
@pytest.mark.parametrize("after", ["", "word and more", "'s", "!x", "é"])
def test_white_space_runs(run, after):
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    for before in ("", "start"):
        assert bpe.encode_text(enc, before + run + after) == brute_ids(enc, before + run + after)


def test_shorter_runs_equal_the_library(monkeypatch):
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "PIECE_CHARS", 64)
    monkeypatch.setattr(bpe, "_LONG_RUN", __import__("re").compile(f"[{bpe.SPACES}]{{16,}}"))
    draw = random.Random(2)
    for _ in range(300):
        text = "".join(draw.choice(["a", "é", "1", "!", "'s", " ", "\n", " " * 20, "\n" * 17, "\t \r" * 9, "\x1c" * 18]) for _ in range(60))
        assert bpe.encode_text(enc, text) == enc.encode_ordinary(text)


def test_white_space_runs_through_spark(spark):
    texts = [" " * 1_500_000 + "word", "\n" * 1_000_000]
    rows = bpe.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS,
                       public_tokenizers.PATTERN).collect()
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {i: sha256(t.encode()).hexdigest() for i, t in enumerate(texts)}


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_hashes_of_colliding_patterns_differ():
    words = [thue_morse(n, *p) for n in (512, 1_024, 2_048, 4_096) for p in ("ab", "ba")]
    w = words_of(pa.array([" ".join(words)]))
    assert len(set(w.hash.tolist())) == len(words)
    texts = [" ".join(thue_morse(4_096, *p)) for p in ("ab", "ba")]
    w = words_of(pa.array(texts))
    for which in (0, 1):
        assert len(set(span_hashes(w.hash, w.first[:-1], w.n, which).tolist())) == 2
        whole = window_hashes(w.hash, 4_096, which)
        assert whole[0] != whole[4_096]


def test_window_and_span_hashes_follow_the_words():
    draw = random.Random(4)
    texts = [" ".join(draw.choice(["a", "b", "word", "x" * 9, "y" * 17, "é" * 2_000]) for _ in range(draw.randrange(1, 90))) for _ in range(60)]
    w = words_of(pa.array(texts))
    names = [w.data[s:e].tobytes() for s, e in zip(w.start, w.end)]
    assert len(set(zip(names, w.hash.tolist()))) == len(set(names)) == len(set(w.hash.tolist()))
    for size in (1, 2, 5, 25, 50):
        for which in (0, 1):
            h = window_hashes(w.hash, size, which).tolist()
            keys = [tuple(names[i: i + size]) for i in range(len(h))]
            assert len(set(zip(keys, h))) == len(set(keys)) == len(set(h))
    start = np.array([draw.randrange(len(names)) for _ in range(500)])
    size = np.array([draw.randrange(1, min(80, len(names) - s) + 1) for s in start])
    for which in (0, 1):
        h = span_hashes(w.hash, start, size, which).tolist()
        keys = [tuple(names[s: s + n]) for s, n in zip(start, size)]
        assert len(set(zip(keys, h))) == len(set(keys)) == len(set(h))


def test_no_words_are_removed_or_stored_for_others(spark):
    a, b = thue_morse(2_048), thue_morse(2_048, "b", "a")
    texts = [" ".join([x] + [f"w{i}" for i in range(60)]) if i == 30 else " ".join([f"v{i}_{k}" if k != 30 else x for k in range(61)])
             for i, x in ((0, a), (0, b))]
    docs = spark.createDataFrame([(1, " ".join([f"w{k}" if k != 30 else a for k in range(61)])),
                                  (2, " ".join([f"w{k}" if k != 30 else b for k in range(61)]))], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.removal(docs).collect()] == [0, 0]
    assert token_store.splits_at_spaces(WORD_BPE, [a, b, *texts])


def test_special_tokens_as_an_untouched_tokenizer_has_them():
    plain = Tokenizer.from_file(WORD_BPE)
    texts = ["a <|endoftext|> b", "x<|endoftext|>y", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "<| endoftext |>"]
    flat, n = token_store.word_ids(WORD_BPE).ids(pa.record_batch([pa.array(texts)], names=["text"]))
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert flat.tolist() == [i for ids in want for i in ids] and n.tolist() == [len(ids) for ids in want]
    assert 49407 in want[0]


def test_classes_of_ids_with_several_texts(spark):
    words = [f"w{i}" for i in range(60)]
    near = [*words[:59], "z"]
    rows = [(3, " ".join(words)), (14, "quite another text of more than five words"), (14, " ".join(near)), (20, " ".join(near)),
            (14, "a third text that has nothing to do with the others")]
    want = {3: 3, 14: 3, 20: 3}
    for order in (rows, rows[::-1], [rows[i] for i in (2, 0, 4, 1, 3)]):
        got = near_dedup.classes(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert len(got) == 5 and {r.doc_id: r.class_id for r in got} == want


@pytest.fixture(scope="module")
def one_id(spark):
    text = "the cat sat on the mat and looked at the moon over the hills\nof a far away land"
    rows = [(1, text, "en", None)] * 3_000 + [(7, f"le chat numéro {i} dort sur la chaise", "fr", None) for i in range(3_000)]
    rows += [(i, f"the dog number {i} runs over the field", "en", None) for i in range(100, 160)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, x string").cache()


def test_language_sample_of_repeated_ids(spark, one_id, monkeypatch):
    seen = []
    fit = language_id.Model.fit
    monkeypatch.setattr(language_id.Model, "fit", lambda self, rows, y: (seen.append(len(rows)), fit(self, rows, y))[1])
    model = language_id.train(one_id, sample=20)
    assert model.langs == ["en", "fr"] and seen == [40]
    got = language_id.predicted(one_id, sample=20)
    assert got.filter("doc_id = 7 and lang_pred <> 'fr'").count() == 0


def test_rule_sample_of_repeated_ids(spark, one_id, monkeypatch):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (100, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    fit = quality_rules.fit
    monkeypatch.setattr(quality_rules, "fit", lambda f, line, y: (seen.append(len(set(line.tolist()))), fit(f, line, y))[1])
    quality_rules.train(one_id, labels, sample=10)
    assert seen == [12]   # ten of the texts of id 7, one of id 1, one of id 100


def test_page_sample_of_repeated_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(html_extraction.Lstm, "fit", lambda self, pages: self)
    monkeypatch.setattr(html_extraction, "PageMaker", lambda texts: (seen.append(len(texts)), type("P", (), {"labelled": lambda s, n: []})())[1])
    rows = [(None, None, "<p>one text of a page</p>")] * 3_000 + [(None, None, f"<p>page {i}</p>") for i in range(500)]
    html_extraction.train(spark.createDataFrame(rows, "page_id long, url string, html string"), sample=200)
    assert seen == [200]


def test_classifier_of_repeated_rows(spark, one_id):
    got = quality_classifier.classified(one_id, sample=10)
    assert got.count() == 6_060 and got.select("doc_id", "kept").filter("doc_id = 1").distinct().count() == 1


def texts(html):
    return [b.text for b in blocks_of(html)]


def test_unclosed_and_nested_elements():
    rest = "<p>article</p><p>more</p>"
    for start in ("<button>go", "<select><option>a", "<noscript>", "<svg><path d='x'>", "<object>", "<canvas>", "<template>"):
        assert texts(f"<body>{start}{rest}</body>")[-2:] == ["article", "more"], start
    for start in ("<script>var a = '<p>';", "<style>p{}", "<textarea>x", "<iframe>"):
        assert texts(f"<body><p>before</p>{start}{rest}") == ["before"], start
    assert texts(f"<p title=it's>one</p><p class='a>b' id=\"c'd\">two</p>{rest}") == ["one", "two", "article", "more"]
    assert texts(f"<p a=\"b'c\" d=e\"f>x</p>{rest}") == ["x", "article", "more"]
    assert texts(f"a<!-->b<!--->c<!-- <p>d</p> -->e{rest}") == ["abce", "article", "more"]
    assert texts(f"<p>a</p><svg><g><svg><text>in</text></svg><text>out</text></g></svg>{rest}") == ["a", "article", "more"]
    assert texts(f"<svg/><svg><svg/><text>in</text></svg>{rest}") == ["article", "more"]
    assert texts("<select>" * 3_000 + rest) == ["article", "more"]


def independent_blocks(html):
    """The same rules on the standard library's parser, for pages whose elements are closed."""
    from html.parser import HTMLParser

    from tidegate.llm.html_blocks import INLINE, RAW, VOID

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.parts, self.skip = [], [], 0

        def flush(self):
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.out.append(text)

        def handle_starttag(self, tag, attrs):
            if tag in RAW and tag != "head":
                if tag != "button":
                    self.flush()
                self.skip += 1
            elif not self.skip:
                if tag == "br":
                    self.parts.append(" ")
                elif tag not in INLINE:
                    self.flush()

        def handle_endtag(self, tag):
            if tag in RAW and tag != "head":
                self.skip -= 1
            elif not self.skip and tag not in INLINE and tag not in VOID:
                self.flush()

        def handle_data(self, data):
            if not self.skip:
                self.parts.append(data)

    body = html[html.lower().find("<body"):]
    reader = Reader()
    reader.feed(body)
    reader.close()
    reader.flush()
    return reader.out


def test_blocks_of_the_pages_equal_the_standard_parsers(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    assert len(pages) > 100
    wrong = [p for p in pages if texts(p) != independent_blocks(p)]
    assert len(wrong) == 0, (texts(wrong[0]), independent_blocks(wrong[0]))
