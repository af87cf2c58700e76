"""Registered queries on the given tables: against their SQL, brute force or held-out rows."""

import hashlib
import importlib
import re

import numpy as np
import pytest

import corpus_pipeline
from eoframe.llm import sentencepiece
from eoframe.llm.queries import ORACLES, QUERIES
from test_pairs_and_spans import base_spans, jaccard_truth, normal

SF_SMALL, SF_CHECK = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
NAMES = ["op1_sentencepiece", "op2_pii", "op3_language_id", "op4_lm_scoring", "op5_jaccard_join", "op6_embedding_dedup",
         "op7_decontamination", "op8_substring_dedup", "op9_toxicity", "op10_sharding", "op11_token_counts",
         "op12_tokenizer_alignment", "op13_periodic_runs"]


def test_one_query_an_operator():
    assert sorted(QUERIES) == sorted(NAMES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_CHECK)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_components_equal_brute_force(spark):
    rows = documents(spark, SF_SMALL)
    got = QUERIES["op5_jaccard_join"](spark, SF_SMALL).collect()
    assert sorted(((False, r.doc_id), r.n_shingles, r.component_id) for r in got) == jaccard_truth(rows, 4, 85)


def test_pii_equals_plain_regex(spark):
    got = {r.doc_id: r for r in QUERIES["op2_pii"](spark, SF_CHECK).collect()}
    rows = documents(spark, SF_CHECK)
    assert len(got) == len(rows)
    for d, text in rows:
        want = base_spans(text)
        assert got[d].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_leaks_are_found_and_others_left(spark):
    items = {r.item_id: normal(r.text).strip() for r in spark.read.parquet(f"{SF_CHECK}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontamination"](spark, SF_CHECK).where("edits = 0").collect()}
    want = {(d, i) for d, t in documents(spark, SF_CHECK) for i, x in items.items() if x in normal(t)}
    assert got == want and want


def test_held_out_accuracy(spark):
    got = QUERIES["op3_language_id"](spark, SF_CHECK).join(
        spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    got = QUERIES["op9_toxicity"](spark, SF_CHECK).join(
        spark.read.parquet(f"{SF_CHECK}/labels.parquet"), "doc_id").where("held_out").collect()
    assert not any(r.predicted for r in got if not r.toxic)
    assert np.mean([r.predicted for r in got if r.toxic]) > 0.6


def test_ids_equal_the_library(spark):
    lib = importlib.import_module("sentencepiece").SentencePieceProcessor(model_file=sentencepiece.MODEL)
    got = {r.doc_id: r for r in QUERIES["op1_sentencepiece"](spark, SF_SMALL).collect()}
    for d, text in documents(spark, SF_SMALL):
        assert got[d].ids == lib.encode(text) and got[d].round_trip


def test_every_document_is_scored(spark):
    got = QUERIES["op4_lm_scoring"](spark, SF_SMALL).collect()
    rows = dict(documents(spark, SF_SMALL))
    assert {r.doc_id: r.n_tokens for r in got} == {d: len(t.split()) for d, t in rows.items()}
    assert all(r.log_prob < 0 for r in got if r.n_tokens)


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, before = docs.columns, None
    scores = {r.doc_id: r.predicted for r in QUERIES["op9_toxicity"](spark, SF_SMALL).collect()}
    items = [normal(r.text).strip() for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    lib = importlib.import_module("sentencepiece").SentencePieceProcessor(model_file=sentencepiece.MODEL)
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF_SMALL).persist()
        after = {r.doc_id: r for r in docs.collect()}
        assert name == "sentencepiece" or docs.columns == columns
        if name == "toxicity":
            assert set(after) == {d for d, p in scores.items() if not p}
        elif name == "jaccard_join":
            truth = jaccard_truth([(d, r.text) for d, r in before.items()], 5, 80)
            assert set(after) == {d for (_, d), _, c in truth if d == c}
        elif name == "decontamination":
            held = {d for d, r in before.items() if any(x in normal(r.text) for x in items)}
            assert held and not held & set(after) and len(after) >= len(before) - len(held) - 5
        elif name == "pii":
            assert set(after) == set(before)
            for d, r in after.items():
                assert (r.text == before[d].text) or re.search(r"<[A-Z]+>", r.text)
                assert not base_spans(r.text) and r.n_chars == len(r.text)
        else:
            assert all(r.ids == lib.encode(before[d].text) and r.round_trip for d, r in after.items())
        if name != "pii" and name != "sentencepiece":
            assert all(after[d] == before[d] for d in after)
