"""Callers' columns are left alone, whatever they are called; long lists of spans."""

import time

import pytest
from eoframe.llm import jaccard_join, periodic_runs, pii, sharding, token_counts, tokenizer_alignment
from pyspark.sql import functions as F

ODD = ["_id", "_key", "_spans", "_text", "_merged", "_none", "_row", "_n", "_shard", "row_", "id_", "key_", "none_", "hash_", "n_", "text_",
       "spans_", "wide_", "clean_", "row_no", "pretoken", "shard_", "slot_"]


@pytest.fixture
def odd(spark):
    rows = [(1, "mail a.b@c.org or 10.0.0.1 now, to all of the people there", 30), (2, "clean words that stay here as they are", 5),
            (3, None, None), (1, "mail a.b@c.org or 10.0.0.1 now, to all of the people there", 30)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({c: F.lit(f"own {c}") for c in ODD})


def untouched(df, besides=()):
    return all(r[c] == f"own {c}" for r in df.collect() for c in ODD if c not in besides)


def test_stages_leave_other_columns(odd):
    got = pii.redact(odd, length_col="n_chars")
    assert got.columns == odd.columns and untouched(got) and got.where("text like '%<EMAIL>%'").count() == 2
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and untouched(kept) and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    placed = sharding.assign_shards(odd, "doc_id", ["p", "q"], 11)
    assert placed.columns == [*odd.columns, "slot", "shard"] and untouched(placed)
    for name in ("Slot", "SHARD"):
        with pytest.raises(ValueError):
            sharding.assign_shards(odd.withColumn(name, F.lit(1)), "doc_id", ["p"], 3)


def test_new_operators_ignore_other_columns(odd):
    assert token_counts.count_tokens(odd).count() == 4 == periodic_runs.periodic_runs(odd).count()
    linked = tokenizer_alignment.linked_documents(odd)
    assert tokenizer_alignment.link_statistics(linked, tokenizer_alignment.pair_counts(linked)).count() == 4


def test_redaction_of_many_spans_is_linear(spark):
    def seconds(n):
        docs = spark.createDataFrame([(1, "é " + " ".join(f"user{i}@mail{i}.example.org" for i in range(n)) + " end")], "doc_id long, text string")
        t = time.perf_counter()
        text = pii.redact(docs).first().text
        assert text == "é " + " ".join(["<EMAIL>"] * n) + " end"
        return time.perf_counter() - t
    seconds(10)
    assert seconds(8000) < 3 * seconds(2000) + 5


def test_overlapping_spans_are_one(spark):
    docs = spark.createDataFrame([(1, "a@10.0.0.1.de +49 30 1234567 10.0.0.1@x.org"), (1, "a@10.0.0.1.de")], "doc_id long, text string")
    got = sorted(r.text for r in pii.redact(docs).collect())
    assert got[0].startswith("<EMAIL>") and "@" not in "".join(got) and "10.0" not in "".join(got)
