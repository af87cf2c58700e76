"""Sharding, toxicity, language, scores: rules, edge rows and brute-force comparisons."""

import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eoframe.llm import language_id, lm_scoring, sharding, toxicity
from eoframe.llm.common import text_bytes


@pytest.fixture
def table_of(spark):
    """DataFrame of (doc_id, text) with a clashing extra column."""
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame([(*r, "x") for r in rows], schema + ", row string")
    return make


def test_lookup_table_is_even_and_every_slot_claimed():
    owner = sharding.lookup_table([f"s{i}" for i in range(7)], 101)
    n = [owner.count(i) for i in range(7)]
    assert sum(n) == 101 and max(n) - min(n) <= 1


def test_lookup_table_moves_few_keys():
    names = [f"s{i}" for i in range(20)]
    a, b = sharding.lookup_table(names, 2003), sharding.lookup_table(names[:-1], 2003)
    assert sum(x != y for x, y in zip(a, b, strict=True)) < 2003 * 0.2


@pytest.mark.parametrize("shards,size", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_lookup_table_rejects(shards, size):
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, size)


def test_assign_keeps_all_rows(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (1, "a")], "k long, _x string")
    got = sharding.assign_shards(df, "k", ["p", "q"], 11).collect()
    assert len(got) == 3 and all(r.shard in ("p", "q") for r in got)
    assert sharding.assign_shards(df.limit(0), "k", ["p"], 3).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(df.withColumn("slot", F.lit(1)), "k", ["p"], 3)


def clause_marks(text):
    return toxicity.Matcher(toxicity.Grammar()).clause(text)


@pytest.mark.parametrize("text,marks", [
    ("what a day", 0), ("an idiot", 1), ("you are an idiot", 5), ("you stupid idiot", 7), ("not an idiot", 17),
    ("she said he is an idiot", 37), ("i will kill you", 8), ("not kill the lights", 16), ("kill the lights", 0)])
def test_clauses(text, marks):
    assert clause_marks(text) == marks


def test_composition_equals_the_parts_side_by_side():
    start, arcs = toxicity.compose(toxicity.PARTS)
    rnd = random.Random(3)
    for _ in range(300):
        word = [rnd.choice("IHYNRMO") for _ in range(rnd.randint(0, 12))]
        state, marks, alone = start, 0, 0
        for s in word:
            state, m = arcs[state, s]
            marks |= m
        for p in toxicity.PARTS:
            x = p.start
            for s in word:
                x, m = p.step(x, s)
                alone |= m
        assert marks == alone


def test_clause_bounds():
    m = toxicity.Matcher(toxicity.Grammar())
    text = "A nice day. You are an idiot! Bye"
    (a, b, _), = m.clauses(text)
    assert text[a:b] == " You are an idiot"
    assert m.clauses("idiotic") and not m.clauses("xidiot") and m.clauses(None) == [] and m.clauses("") == []


def test_toxicity_learns_from_labels_and_keeps_clean_rows(table_of, spark):
    rnd = random.Random(1)
    words = ["the", "of", "sun", "moon", "tree", "house", "stone", "river"]
    rows, labels = [], []
    for i in range(400):
        text = [rnd.choice(words) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            text[rnd.randrange(30)] = "zork" + rnd.choice(["a", "elo", "ix"])
        rows.append((i, " ".join(text) + "."))
        labels.append((i, 0, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "you are an idiot"), (0, rows[0][1]), (None, "fine")]
    docs = table_of(rows)
    grammar = toxicity.learn(docs.select("doc_id", "text"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert any(s.startswith("zork") or "zork".startswith(s) for s in grammar.notes["learnt"])
    got = toxicity.score_toxicity(docs, grammar).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == int(i % 4 == 0) for i in range(400))
    assert by[1000].predicted == by[1001].predicted == 0 and by[1002].predicted == 1
    kept = toxicity.drop_toxic(docs, grammar)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in by.items() if not r.predicted}
    assert toxicity.score_toxicity(docs.limit(0), grammar).count() == 0


def test_toxicity_seeds_of_one_class(table_of, spark):
    """A seed that only clean documents hold is no evidence, and one that only toxic ones hold is."""
    rows = [(i, f"{'you idiot ' if i < 20 else 'the moron '}{i} went there {i * 7}") for i in range(60)]
    docs = table_of(rows).select("doc_id", "text")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(60)], "doc_id long, toxic int")
    g = toxicity.learn(docs, labels)
    assert "moron" not in g.stems and "idiot" in g.stems
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, g).collect()}
    assert min(got[i] for i in range(20)) > max(got[i] for i in range(20, 60))


def test_toxicity_without_labels(table_of, spark):
    g = toxicity.learn(table_of([(1, "a b")]).select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert g.stems and g.base == toxicity.PRIOR_BASE


LANGS = {"aa": ["kalo", "mira", "tenu", "sola"], "bb": ["schrum", "gefft", "zwork", "pfurz"]}


def lang_rows(n=240, seed=2):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        k = rnd.choice(list(LANGS))
        out.append((i, " ".join(rnd.choice(LANGS[k]) for _ in range(12)), k))
    return out


def test_language_held_out_accuracy_and_edges(spark):
    rows = lang_rows()
    df = spark.createDataFrame([*rows, (900, None, "aa"), (901, "", None), (902, "123 !?", "bb"), (0, rows[0][1], None)],
                               "doc_id long, text string, lang string")
    m = language_id.learn(df)
    assert m.langs == ["aa", "bb"]
    got = language_id.predict(df, m).collect()
    assert len(got) == len(rows) + 4
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].lang_pred == k for i, _, k in rows]) > 0.98
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id.predict(df.limit(0), m).count() == 0


def test_language_never_learns_the_held_out_fold(spark):
    """A language that only held-out rows have is unknown to the model."""
    rows = [(i, "kalo mira", "zz") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(language_id.held_out())
    assert df.count() > 100 and language_id.learn(df) is None
    assert {r.lang_pred for r in language_id.predict(df.limit(5), None).collect()} == {"und"}


def test_character_grams_by_hand():
    letters = language_id.letter_table()
    counts, has = language_id.count_matrix(["Ab1", "", "é日"], letters)
    # Ab1 is "ab ": 2 letters, 2 pairs, 1 triple.
    assert counts.sum(1).tolist() == [5, 0, 3] and has.tolist() == [True, False, True]


def softmax(z):
    e = np.exp(np.array(z, float) - max(z))
    return e / e.sum()


def test_masked_scores_equal_brute_force(spark):
    docs = spark.createDataFrame([(1, "The cat sat on the mat"), (2, "a"), (3, None), (4, " \t"), (1, "The cat sat on the mat")],
                                 "doc_id long, text string")
    voc, flat = lm_scoring.learn(docs)
    w = lm_scoring.unflatten(flat.astype(float))
    got = lm_scoring.score(docs, voc, flat).collect()
    for r, text in zip(sorted(got, key=lambda r: r.doc_id), ["The cat sat on the mat"] * 2 + ["a", None, " \t"], strict=True):
        words = (text or "").lower().split()
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        h, _ = lm_scoring.token_hashes(data, np.array([0, len(data)]))
        ids = voc.of(h)
        total = 0.0
        for i, y in enumerate(ids):
            x = w["hidden"].copy()
            for c, o in enumerate(lm_scoring.OFFSETS):
                x += w["near"][c][ids[i + o] if 0 <= i + o < len(ids) else lm_scoring.IDS]
            x = np.maximum(x, 0)
            g, p = divmod(int(y), lm_scoring.SIZE)
            total += math.log(softmax(x @ w["class"] + w["class_bias"])[g])
            total += math.log(softmax(x @ w["place"][g] + w["place_bias"][g])[p])
        assert r.n_tokens == len(words) and abs(r.log_prob - total) < 1e-3
        assert (r.mean_log_prob is None) == (not words)


def test_training_prefers_the_corpus_order(spark):
    rnd = random.Random(4)
    chain = ["red", "fox", "ran", "over", "green", "hill"]
    rows = [(i, " ".join(chain * rnd.randint(20, 40))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    voc, flat = lm_scoring.learn(docs, rounds=8)
    test = spark.createDataFrame([(1, " ".join(chain * 5)), (2, " ".join(sorted(chain * 5)))], "doc_id long, text string")
    good, bad = (r.mean_log_prob for r in lm_scoring.score(test, voc, flat).orderBy("doc_id").collect())
    assert good > bad + 0.5


def test_scores_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scoring.score(docs, *lm_scoring.learn(docs)).count() == 0


@pytest.mark.parametrize("known", [1 << 20, 3000, 0])
def test_every_word_has_its_own_probability(spark, monkeypatch, known):
    # Documents of one word have the same neighbours: their probabilities add up to 1.
    monkeypatch.setattr(lm_scoring, "KNOWN", known)
    n = {f"w{i}": 1 + 9000 // (i + 1) for i in range(6000)}
    words = [w for w, k in n.items() for _ in range(k)]
    random.Random(6).shuffle(words)
    docs = spark.createDataFrame([(i, " ".join(words[i::200])) for i in range(200)], "doc_id long, text string")
    voc, flat = lm_scoring.learn(docs)
    assert (voc.rest is None) == (known >= 6000)
    got = lm_scoring.score(spark.createDataFrame([(w, w) for w in n] + [("two", "w5990 w5991 w5990")], "doc_id string, text string"),
                           voc, flat).collect()
    p = {r.doc_id: r.log_prob for r in got}
    assert len(got) == 6001 and abs(sum(math.exp(x) for w, x in p.items() if w != "two") - 1) < 1e-3
    h = {w: lm_scoring.token_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0] for w in n}
    alike = {}
    for w in n:
        alike.setdefault(int(voc.of(h[w])[0]), []).append(w)
    for same in alike.values():
        for w in same[1:]:
            assert abs(p[w] - p[same[0]] - math.log(n[w] / n[same[0]])) < 1e-6
    assert p["two"] < 2 * p["w5990"] / 3


def test_the_rounds_train_every_position_once(spark, monkeypatch):
    texts = ["a b c", "a", "a b", "x " * 100, "a " * 37, "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    calls = []
    monkeypatch.setattr(lm_scoring, "_round", lambda *a: calls.append(a) or a[2])
    lm_scoring.learn(docs)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    ids = [ids for c in calls for ids, _ in lm_scoring._positions([batch], c[1], *c[3:-1])]
    h, _ = lm_scoring.token_hashes(*text_bytes(pa.array([" ".join(texts)])))
    assert sorted(np.concatenate(ids)) == sorted(calls[0][1].of(h))


def test_ids_grow_with_the_corpus():
    assert [lm_scoring.grown(n) for n in (0, 10 ** 6, 1 << 24, 10 ** 8, 10 ** 10)] == [1, 1, 2, 2, 8]
    for times in (1, 2, 4):
        flat = np.arange(sum(int(np.prod(s)) for s in lm_scoring.shapes(times).values()))
        w = lm_scoring.unflatten(flat)
        assert {k: x.shape for k, x in w.items()} == lm_scoring.shapes(times) and w["place_bias"][-1, -1] == flat[-1]


def test_gradient_against_differences():
    rng = np.random.default_rng(0)
    flat = rng.normal(0, 0.3, sum(int(np.prod(s)) for s in lm_scoring.shapes().values()))
    ids, near = rng.integers(0, lm_scoring.IDS, 20), rng.integers(0, lm_scoring.IDS + 1, (20, len(lm_scoring.OFFSETS)))

    def loss(f):
        return -lm_scoring.log_probs(lm_scoring.unflatten(f), ids, near).mean()
    g = np.concatenate([x.ravel() for x in lm_scoring._gradient(lm_scoring.unflatten(flat), ids, near).values()])
    for at in np.argsort(-np.abs(g))[:12]:
        step = np.zeros_like(flat)
        step[at] = 1e-5
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-5 - g[at]) < 1e-4


@pytest.mark.parametrize("crowded", [False, True])
def test_word_lookup_equals_a_search(crowded):
    """Also of words that share their upper bits with others, and of none at all."""
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    if crowded:
        h = h >> np.uint64(14) | np.uint64(0xFFFC << 48)
    words, size = np.unique(h[:768]), lm_scoring.IDS
    voc = lm_scoring.Vocabulary(words, rng.permutation(len(words)))
    known = {int(w): int(i) for w, i in zip(words, voc.ids, strict=True)}
    other = [voc.kept + int(x) % (size - voc.kept) for x in h]
    assert voc.of(h).tolist() == [known.get(int(x), o) for x, o in zip(h, other, strict=True)]
    assert lm_scoring.Vocabulary(words[:0], words[:0].astype(int)).of(h).tolist() == other


def test_word_lookup_costs_no_search_a_token():
    """CPU time beside a sort of the same tokens: five times it with a search for each, once now."""
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 64, 1 << 18, dtype=np.uint64)
    voc = lm_scoring.Vocabulary(np.sort(rng.integers(0, 1 << 64, 3072, dtype=np.uint64)), np.arange(3072), 2)

    def cpu(f):
        took = []
        for _ in range(7):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)
    assert cpu(lambda: voc.of(h)) < 3 * cpu(lambda: np.sort(h))


def test_log_probs_of_scores_far_from_zero():
    rng = np.random.default_rng(6)
    flat = rng.normal(0, 0.3, sum(int(np.prod(s)) for s in lm_scoring.shapes().values()))
    w = lm_scoring.unflatten(flat)
    ids, near = rng.integers(0, lm_scoring.IDS, 50), rng.integers(0, lm_scoring.IDS + 1, (50, len(lm_scoring.OFFSETS)))
    expected = lm_scoring.log_probs(w, ids, near)
    for shift in (-1e4, 1e4):  # the same for all classes, and for all places: no probability changes
        moved = dict(w, class_bias=w["class_bias"] + shift, place_bias=w["place_bias"] - shift)
        assert np.allclose(lm_scoring.log_probs(moved, ids, near), expected)
