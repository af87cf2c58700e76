"""Periodic runs against a search of every start and period."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from eoframe.llm import periodic_runs as pr
from eoframe.llm.queries import QUERIES
from hypothesis import given, settings
from hypothesis import strategies as st

SF_SMALL = "/root/testdata/sf0.001"


def brute(words, power=4, least=6):
    """Runs as (start, length, period) by start, then period."""
    n, out = len(words), {}
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, power * q):
                out.setdefault((i, j + q), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def found(texts):
    ids = np.array([x for t in texts for x in t], np.int64)
    first = np.cumsum([0, *map(len, texts)])
    s, e, q = pr.runs_of(ids, first)
    out = [[] for _ in texts]
    for a, z, p in zip(s.tolist(), e.tolist(), q.tolist()):
        t = int(np.searchsorted(first, a, side="right")) - 1
        out[t].append((a - first[t], z - a, p))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=5))
def test_runs_of_few_letters(texts):
    assert found(texts) == [brute(t) for t in texts]


def test_runs_of_made_texts():
    rng = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            t = []
            while len(t) < 150:
                unit = [rng.randint(0, rng.choice([1, 3, 30])) for _ in range(rng.randint(1, 9))]
                t += (unit * rng.choice([1, 1, 4, 5, 9]))[:rng.randint(1, 90)]
            texts += [t] * rng.randint(1, 3)
        assert found(texts) == [brute(t) for t in texts]


def test_long_and_hard_texts():
    thue = [bin(i).count("1") & 1 for i in range(4096)]
    fibonacci, b = [0], [0, 1]
    while len(b) < 3000:
        fibonacci, b = b, b + fibonacci
    texts = [[7] * 20_000, [1, 2] * 5000 + [1], thue, b[:3000], thue[:300] * 5, [], [3], list(range(9000)), [1, 1, 1, 2] * 900]
    got = found(texts)
    assert got[0] == [(0, 20_000, 1)] and got[1] == [(0, 10_001, 2)] and got[5] == got[6] == got[7] == []
    for i in (2, 3, 4, 8):
        assert got[i] == brute(texts[i])


def test_derivation_spells_the_texts():
    rng = random.Random(2)
    texts = [[rng.randint(0, 4) for _ in range(rng.randint(0, 200))] for _ in range(20)]
    ids, first = np.array([x for t in texts for x in t]), np.cumsum([0, *map(len, texts)])
    d = pr.Derivation(ids, first)
    spelt = {}
    for r, s, e in zip(d.rule.tolist(), d.start.tolist(), d.end.tolist()):
        assert spelt.setdefault(r, ids[s:e].tolist()) == ids[s:e].tolist()
    assert len(d.rule) == sum(max(0, len(t) - 1) for t in texts)  # every border lies in one node
    assert len(set(zip(d.border.tolist()))) == len(d.rule)


def planted(doc_id, text):
    words, h = (text or "").split(), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return words


def truth(doc_id, words):
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = (None,) * 4
    for s, n, q in runs:
        if best[0] is None or n * best[2] > best[1] * q:
            best = (s, n, q, n * 1000 // q)
    return (doc_id, len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_odd_rows(spark):
    texts = ["a b " * 4, "a  b\ta\nb a b a b", "x" * 9, "", None, "ha " * 9 + "ho " * 9, "é ü " * 5, " \t ", "q w e r t y",
             "w " * 30_000, "very very very very very very good"]
    rows = [(i % 9 if i % 9 else None, t, "z", 0) for i, t in enumerate([*texts, *texts])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int")
    got = pr.digest(pr.periodic_runs(docs)).select(*COLUMNS).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(truth(d, (t or "").split())) for d, t, _, _ in rows)
    got = {r.collapsed for r in pr.periodic_runs(docs).collect()}
    assert {"a b", "x" * 9, "", "ha ho", "é ü", "w", "very good"} <= got
    assert pr.periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pr.periodic_runs(docs, power=2)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_periodic_runs"](spark, SF_SMALL)
    assert got.columns == COLUMNS
    want = sorted(repr(truth(d, planted(d, t))) for d, t in rows)
    assert sorted(map(repr, map(tuple, got.collect()))) == want
    assert sum(r.n_runs > 0 for r in got.collect()) > 5
