"""The pipeline against brute force of its stages, on cases planted in a copy of the small tables."""

import public_tokenizers
from llm_brute import base_counts, near_classes, substring_removal, words

import corpus_pipeline
from tidegate.llm import bpe
from tidegate.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_do_their_work(spark, tmp_path):
    docs = table(spark, SF, "documents")
    item = table(spark, SF, "benchmark").orderBy("item_id").first().text
    fresh = " ".join(f"Fresh{i} sentence{i} about{i} things." for i in range(30))
    passage = " ".join(f"shared{i}" for i in range(60))
    planted = [(90_001, fresh), (90_002, fresh.replace("about7 ", "around7 ")), (90_003, fresh), (90_004, item + " " + fresh[::-1]),
               (90_005, "A clean text of its own, with ordinary words and nothing wrong in any line of it at all."),
               (90_006, passage + " and then an end of one kind, told at some length by a patient narrator."),
               (90_007, "Another start which nobody else has written down before: " + passage), (90_008, None)]
    extra = spark.createDataFrame([(d, t, "en", "planted", len(t or "")) for d, t in planted], docs.schema)
    state = docs.unionByName(extra)
    before = state
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        state = written(stage(spark, state, SF), name)
        rows = {r.doc_id: r.text for r in state.collect()}
        given = [(r.doc_id, r.text) for r in before.collect()]
        if i + 1 < len(corpus_pipeline.STAGES):
            assert state.columns == docs.columns
        if name == "quality_rules":
            assert set(rows) <= {d for d, t in given if not base_counts(t)[5]} and 90_008 not in rows and 90_005 in rows
        if name == "near_dedup":
            assert set(rows) == {d for d, c in near_classes(given).items() if d == c}
            assert 90_001 in rows and not {90_002, 90_003} & set(rows)
        if name == "substring_dedup":
            want = {d: n for d, _, n, _ in substring_removal(given, 50)}
            assert all(len(words(rows[d])) == len(words(t)) - want[d] for d, t in given)
            assert want[90_007] == 60 and want[90_006] == 0
        if name == "decontamination":
            assert 90_004 not in rows and {90_001, 90_005, 90_006, 90_007} <= set(rows)
        if name == "byte_bpe":
            enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
            assert rows == dict(given)
            assert all(r.n_tokens == len(enc.encode_ordinary(r.text)) for r in state.collect())
        before = state
    assert len(corpus_pipeline.STAGES) == 5


def test_run_gives_the_rows_of_the_stages(spark):
    state = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        state = written(stage(spark, state, SF), name)
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == sorted((r.doc_id, r.n_tokens) for r in state.collect())
