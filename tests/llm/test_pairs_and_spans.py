"""Near copies, repeated spans, leaks, personal data, pieces: against brute force."""

import hashlib
import importlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eoframe.llm import decontamination, embedding_dedup, jaccard_join, pii, sentencepiece, substring_dedup
from eoframe.llm.common import inside_windows, slices, split_words, text_bytes, window_hashes, word_hashes
from eoframe.llm.components import connected_components

@pytest.fixture
def table_of(spark):
    """DataFrame of (doc_id, text) with a clashing extra column."""
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame([(*r, "x") for r in rows], schema + ", row string")
    return make


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text, lower=False):
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text) if lower else text)


def union_find(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


# ---- word arrays

def test_word_arrays():
    texts = ["  Hello  w\tfoo", None, "", "foo Hello", "é à\x0bfoo", "x" * 70_000 + " foo"]
    data, off = text_bytes(pa.array(texts))
    w = split_words(data, off)
    got = [bytes(data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]
    assert got == [x for t in texts for x in words_of(t)]
    assert np.diff(w.first).tolist() == [len(words_of(t)) for t in texts]
    by = {}
    for x, h in zip(got, word_hashes(w).tolist(), strict=True):
        assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)


def test_windows_stay_in_their_document():
    first = np.array([0, 3, 3, 8])
    assert np.flatnonzero(inside_windows(first, 3)).tolist() == [0, 3, 4, 5]
    h = np.arange(20, dtype=np.uint64) % np.uint64(5)
    for k in (1, 2, 3, 7, 13, 20):
        v = window_hashes(h, k)
        assert len(v) == 20 - k + 1
        assert all((v[i] == v[j]) == (h[i:i + k].tolist() == h[j:j + k].tolist()) for i in range(len(v)) for j in range(len(v)))


def test_slices_cover_all():
    off = np.array([0, 5, 5, 100, 101, 130])
    for most, docs in ((1, 9), (30, 2), (1000, 3)):
        got = list(slices(off, most, docs))
        assert [a for a, _ in got] == [0] + [b for _, b in got][:-1] and got[-1][1] == 5


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (20, 21), (21, 20), (None, 4)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = union_find({x for e in edges if None not in e and e[0] != e[1] for x in e}, [e for e in edges if None not in e])
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- Jaccard

def shingles(text, k):
    w = words_of(text, True)
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def jaccard_truth(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    top = union_find(range(len(rows)), links)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top[i]] = min(least.get(top[i], d), d)
    return sorted(((d is None, d or 0), len(sets[i]), least.get(top[i]) if sets[i] else d) for i, (d, _) in enumerate(rows))


def near_copy_rows(seed, families=12, copies=7):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [rnd.choice(vocabulary) for _ in range(40)]
    rows = []
    for f in range(families):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([4, 8, 20, 60, 150]))]
        if f % 3 == 0:
            base = shared + base
        for _ in range(copies):
            text = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("k,percent,seed", [(4, 85, 1), (5, 80, 2), (2, 60, 3)])
def test_jaccard_components(table_of, k, percent, seed):
    rows = near_copy_rows(seed)
    rows += [(900, None), (901, ""), (902, " \t "), (903, "a b"), (904, "A  b"), (905, "a b c"), (0, rows[0][1]), (None, rows[3][1]),
             (906, "W1 " * 300)]
    got = jaccard_join.jaccard_components(table_of(rows), jaccard_join.Threshold(k, percent)).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id) for r in got) == jaccard_truth(rows, k, percent)


def test_jaccard_hub_with_distant_copies(table_of):
    """Copies that only the original links, each with its own edits; a hot common passage."""
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = [(50, " ".join(base))]
    for i in range(30):
        t = list(base)
        at = rnd.randrange(100)
        t[at:at + 3] = [f"x{i}a", f"x{i}b", f"x{i}c"]
        rows.append((100 + i, " ".join(t)))
    rows += [(300 + i, " ".join(base[:60] + [f"y{i}_{j}" for j in range(60)])) for i in range(30)]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(table_of(rows)).collect()}
    assert got == {d: c for (_, d), _, c in jaccard_truth(rows, 5, 80)}


def common_passage_rows():
    """Pairs of near copies; all texts share a half, and with it cells."""
    rows = []
    for i in range(40):
        t = [f"c{j}" for j in range(100)] + [f"y{i}_{j}" for j in range(100)]
        rows += [(10 + i, " ".join(t)), (100 + i, " ".join(t[:190] + [f"z{i}_{j}" for j in range(10)]))]
    return rows


@pytest.mark.parametrize("leaf", [5, 256])
def test_jaccard_common_passage(table_of, monkeypatch, leaf):
    """Points of a cell are written down only where it has several leaves: a cell of one is
    compared where it is packed."""
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    kept, real = [], jaccard_join.materialise

    def materialise(df):
        kept.append(real(df))
        return kept[-1]
    monkeypatch.setattr(jaccard_join, "materialise", materialise)
    rows = common_passage_rows()
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(table_of(rows)).collect()}
    assert got == {d: c for (_, d), _, c in jaccard_truth(rows, 5, 80)}
    assert any("slice" in df.columns for df in kept)
    written = sum(df.where("points is not null").count() for df in kept if "points" in df.columns)
    assert written == 0 if leaf == 256 else written > 1


@pytest.mark.parametrize("leaf", [3, 256])
def test_leaf_pairs_equal_all_pairs(spark, monkeypatch, leaf):
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    rnd, t = np.random.default_rng(9), jaccard_join.Threshold()
    base = rnd.integers(0, 3, (4, jaccard_join.GROUPS))
    point = {}
    for v in range(60):
        p = base[v % 4].copy()
        p[rnd.integers(0, len(p), rnd.integers(0, 60))] += 1
        point[v * 7 - 200] = p.astype(np.uint8)
    of = {v: int(rnd.integers(0, 30)) for v in point}
    cells = [(c, [int(v) for v in rnd.choice(list(point), n, replace=False)]) for c, n in enumerate((1, 2, 3, 4, 9, 30, 60), 5)]
    residual = spark.createDataFrame([(c, len(m), v, of[v], int(point[v].sum())) for c, m in cells for v in m],
                                     "cell long, rows long, vertex long, component long, n_shingles long")
    points = spark.createDataFrame([(v, bytearray(p.tobytes())) for v, p in point.items()], "vertex long, point binary")
    got = [tuple(r) for r in jaccard_join._leaf_pairs(residual, points, t).collect()]
    size = {v: int(p.sum()) for v, p in point.items()}
    want = {(a, b) for _, m in cells for a in m for b in m if a < b and of[a] != of[b]
            and min(size[a], size[b]) * 100 >= max(size[a], size[b]) * t.percent
            and jaccard_join.far_apart(point[a], point[b]) <= t.differ(size[a] + size[b])}
    assert len(want) > 20 and sorted(got) == sorted(want)


def test_keep_one(table_of):
    rows = [(5, "a b c d e f g"), (3, "A b c d e f g"), (7, "other words are here in this text"), (8, None), (9, ""), (3, "A b c d e f g"),
            (None, "q r s t u v")]
    docs = table_of(rows)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["3", "7", "8", "9", "None"]
    assert jaccard_join.keep_one(docs.limit(0)).count() == 0


def test_points_bound_the_difference():
    rnd = random.Random(5)
    for _ in range(50):
        a = " ".join(rnd.choice("abcdefgh") for _ in range(80))
        b = " ".join(rnd.choice("abcdefgh") for _ in range(80))
        data, off = text_bytes(pa.array([a, b]))
        doc, value = jaccard_join.shingle_sets(data, off, 3)
        p = jaccard_join.points(doc, value, 2)
        assert jaccard_join.far_apart(p[0], p[1]) <= len(shingles(a, 3) ^ shingles(b, 3))


def test_wide_points_bound_the_difference():
    """Long sets have wider points; those of two widths are compared at the smaller one."""
    rnd, t = random.Random(6), jaccard_join.Threshold()
    base = [f"w{rnd.randrange(400)}" for _ in range(2060)]
    texts = [" ".join(x) for x in (base, base[:2040], base[:1700], base[1000:], base[:1030], base[:1010],
                                   [f"w{rnd.randrange(400)}" for _ in range(2060)], ["w1"])]
    doc, value = jaccard_join.shingle_sets(*text_bytes(pa.array(texts)), t.k)
    n = np.bincount(doc)
    point = jaccard_join.points(doc, value, len(n))
    assert {256, 512, 1024} == {len(x) for x in point}
    sets = [shingles(x, t.k) for x in texts]
    for i in range(len(sets)):
        for j in range(len(sets)):
            w = min(len(point[i]), len(point[j]))
            far = jaccard_join.far_apart(*jaccard_join.folded([point[i].tobytes(), point[j].tobytes()], w))
            assert far <= len(sets[i] ^ sets[j])
    i, j = (x.ravel() for x in np.indices((len(n), len(n))))
    near = jaccard_join.near_points(i, j, point, n, point, n, t)
    linked = np.array([100 * len(sets[a] & sets[b]) >= t.percent * len(sets[a] | sets[b]) for a, b in zip(i, j, strict=True)])
    assert near[linked].all() and linked[i != j].any()


def test_points_of_long_unrelated_texts_are_far_apart():
    rnd, t = np.random.default_rng(3), jaccard_join.Threshold()
    n = np.full(12, 9000)
    doc = np.repeat(np.arange(12), 9000)
    value = rnd.integers(0, 1 << 63, len(doc)).astype(np.uint64) * np.uint64(2)
    point = jaccard_join.points(doc, value, 12)
    i, j = np.triu_indices(12, 1)
    assert not jaccard_join.near_points(i, j, point, n, point, n, t).any()


def test_unrelated_texts_share_no_cells():
    """Not even those with a few more shingles than a level's least, whose blocks are emptiest."""
    rnd, t = np.random.default_rng(4), jaccard_join.Threshold()
    size = np.repeat(np.arange(30, 900, 10), 3)
    doc = np.repeat(np.arange(len(size)), size)
    value = rnd.integers(0, 1 << 63, len(doc)).astype(np.uint64) * np.uint64(2)
    order = np.lexsort((value, doc))
    cell, of = jaccard_join.cells(doc, value[order], size, t)
    pairs = {(int(c), int(d)) for c, d in zip(cell, of, strict=True)}
    assert len(pairs) - len({c for c, _ in pairs}) < len(size) / 10


def test_labels_take_later_links(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "v long, component long")
    links = spark.createDataFrame([(2, 6), (9, 4), (12, 11)], "a long, b long")
    got = {r.v: r.component for r in jaccard_join._joined(labels, links).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 8: 4, 9: 4, 4: 4, 12: 11, 11: 11}
    assert jaccard_join._joined(labels, links.limit(0)) is labels


# ---- repeated spans

def spans_truth(rows, n):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), {}
    for i in order:
        w = words_of(rows[i][1])
        cut, own = [False] * len(w), []
        for s in range(len(w) - n + 1):
            key = tuple(w[s:s + n])
            if key in seen:
                cut[s:s + n] = [True] * n
            seen.add(key)
            own.append(key)
        out[i] = (len(w), sum(cut), " ".join(x for x, c in zip(w, cut, strict=True) if not c))
    return sorted((str(rows[i][0]), *v) for i, v in out.items())


@pytest.mark.parametrize("n,seed", [(20, 1), (20, 2), (8, 3)])
def test_repeated_spans(table_of, n, seed):
    rnd = random.Random(seed)
    passages = [[f"p{i}_{j}" for j in range(rnd.randint(n, 4 * n))] for i in range(5)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rnd.randint(0, 6)):
            text += [rnd.choice("abcdefghij") for _ in range(rnd.randint(0, n))]
            if rnd.random() < 0.7:
                p = rnd.choice(passages)
                a = rnd.randint(0, 5)
                text += p[a:len(p) - rnd.randint(0, 5)]
        rows.append((rnd.choice([i, 1000 - i]) + (i << 11), rnd.choice([" ", "\n", " \t"]).join(text)))
    rows += [(2, "la " * 90), (1, "la lo " * 60), (3, None), (4, ""), (5, " \n"), (6, rows[0][1]), (None, rows[1][1])]
    got = substring_dedup.remove_repeats(table_of(rows), window=n).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == spans_truth(rows, n)


def test_repeated_rows_of_one_id(table_of):
    text = " ".join(f"w{i}" for i in range(30))
    got = substring_dedup.remove_repeats(table_of([(1, text), (1, text)])).collect()
    assert [r.n_removed for r in got] == [0, 0]  # equal rows are one occurrence
    got = substring_dedup.remove_repeats(table_of([(1, text), (1, "x " + text)])).collect()
    assert sorted(r.n_removed for r in got) == [0, 30]
    assert substring_dedup.remove_repeats(table_of([(1, text)]).limit(0)).count() == 0


# ---- leaks

def least_edits(a, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def normal(text):
    data, off = text_bytes(pa.array([text]))
    return bytes(decontamination.normal_form(data, off)[0])


@pytest.mark.parametrize("size", [9, 30, 90, 200])
def test_leaks_against_full_alignment(size):
    rnd = random.Random(size)
    for _ in range(25):
        item = "".join(rnd.choice("abcde ") for _ in range(size)).strip() or "abcdefghi"
        leak = list(item)
        for _ in range(rnd.randint(0, size // 8)):
            p = rnd.randrange(len(leak))
            leak[p:p + 1] = rnd.choice([["x"], ["x", "y"], []])
            leak = leak or ["a"]
        text = "".join(rnd.choice("abcdefg ") for _ in range(40)) + "".join(leak) + "".join(rnd.choice("abcdefg ") for _ in range(40))
        items = decontamination.Items([(1, item)], decontamination.Q, decontamination.RATE)
        if not items.ids:
            continue
        data, off = text_bytes(pa.array([text]))
        x, ends, _ = decontamination.normal_form(data, off)
        found = decontamination.search(items, x, ends)
        want = least_edits(bytes(items.text[0]), bytes(x))
        assert bool(found) == (want <= items.k[0])
        assert not found or min(f[4] for f in found) == want


def test_contamination_rows(table_of, spark):
    item = "The quick brown fox jumps over the lazy dog while it rains"
    rows = [(1, "Intro. " + item + " and more"), (2, "xx THE QUICK,, brown fox jumps over\nthe lazy dog while it rains!"), (3, "clean text"),
            (4, None), (5, ""), (1, item), (6, "é" + item.replace("lazy", "lazyy") + "É"), (7, "ab cd"), (8, "abcd")]
    bench = spark.createDataFrame([(10, item, 0), (11, None, 0), (12, "", 0), (13, "ab", 0)], "item_id long, text string, doc_id long")
    docs = table_of(rows)
    got = decontamination.find_contamination(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 10), (1, 10), (2, 10), (6, 10), (7, 13)]
    texts = {d: t for d, t in rows}
    for r in got:
        if r.item_id == 10 and r.doc_id == 2:
            assert texts[2][r.start:r.end].startswith("THE QUICK") and texts[2][r.start:r.end].endswith("rains")
    small = decontamination.find_contamination(docs, bench, block_bytes=1)  # an item a block
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, got))
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 8]
    assert decontamination.find_contamination(docs.limit(0), bench).count() == 0
    assert decontamination.find_contamination(docs, bench.limit(0)).count() == 0


def test_many_items_and_a_full_batch_of_short_documents(spark):
    rnd = random.Random(11)
    items = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24)) for _ in range(70_000)]
    texts = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(30)) for _ in range(10_000)]
    leaks = {0: 69_999, 7_000: 5, 8_000: 60_000, 9_000: 69_998, 9_999: 69_997}
    for d, i in leaks.items():
        texts[d] = f"see {items[i]} here"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontamination.find_contamination(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.edits) for r in got) == sorted((d, i, 0) for d, i in leaks.items())
    kept = {r.doc_id for r in decontamination.drop_contaminated(docs, bench).select("doc_id").collect()}
    assert kept == set(range(10_000)) - set(leaks)


# ---- personal data

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_plain_regex(table_of):
    rnd = random.Random(5)
    texts = [None, "", "a@b.com_x@c.de", "1.2.3.4.5.6.7.8", "999.1.1.1 10.0.0.1", "é+1 (234) 555-6789 x", "4111 1111 1111 1111", "+12",
             "a@b..c", "x\x01y a@b.c \x02", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "5" * 20000, "a" * 50000, "@@a@b.c@d.e", "00000255.1.1.1",
             "99999999999999999999.1.1.1", "+1+2 345 678 901 2", "1 " * 9000, "😀 a@b.cc 日本 1.1.1.1"]
    texts += ["".join(rnd.choice("a1.@+- (é09_") for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    texts += ["".join(rnd.choice("0123456789 -.+") for _ in range(rnd.randint(10, 60))) for _ in range(200)]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, "1.1.1.1")]
    got = pii.find_pii(table_of(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base_spans("1.1.1.1" if r.doc_id is None else texts[r.doc_id])
        assert r.base == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in KINDS]
        assert {x for x in r.base.split(",") if x} <= set(r.spans.split(","))
    assert pii.find_pii(table_of(rows).limit(0)).count() == 0


def test_secrets_after_an_equals_sign_and_long_ones(table_of):
    rnd = random.Random(8)
    long = "".join(rnd.choice("abcdefABCDEF0123456789+/") for _ in range(4000))
    late = "abcdefgh" * 20 + "123456"
    token = "Zk3v9Qw81LmX20pT7b"
    texts = [f"password={token}", f"x api_key={token};", f"https://h.org/?token={token}&v=1", f"AWS_SECRET_ACCESS_KEY={token} y",
             f"a ={token}== b", f'token = "{token}"', f"key={long}", f"one {long}= end", f"token={late}", f"my_service_key_v2={token}"]
    want = [{token}, {token}, {token}, {token}, {token + "=="}, {token}, {long}, {long + "="}, {late}, {token, "my_service_key_v2"}]
    rows = list(enumerate(texts))
    spans = pii.proposed(table_of(rows).withColumn("row_id", F.col("doc_id")))
    got = {}
    for r in spans.where(F.col("kind") == list(pii.KINDS).index("secret")).collect():
        assert texts[r.doc_id][r.start:r.end] == r.match
        got.setdefault(r.doc_id, set()).add(r.match)
    assert [got.get(i) for i, _ in rows] == want
    clean = [(100 + i, f"abcdefghijklmnopqr{i % 10} mail{i}@x.org") for i in range(40)]
    found = {r.doc_id: r.spans for r in pii.find_pii(table_of(rows + clean)).collect()}
    for i, text in rows[:9]:
        secret = next(iter(want[i]))
        assert f"secret:{text.index(secret)}:{text.index(secret) + len(secret)}" in found[i].split(",") or i == 7


def test_redaction(spark):
    rows = [(1, "mail a.b@c.org or 10.0.0.1 now", 30), (2, "clean", 5), (3, None, None), (1, "other x@y.zz", 12), (4, "é 10.0.0.1 a@b.cc", 17)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("kind", F.lit(1)).withColumn("key", F.lit(2))
    got = pii.redact(docs, length_col="n_chars")
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text or "", r.n_chars) for r in got.collect()) == [
        (1, "mail <EMAIL> or <IP> now", 24), (1, "other <EMAIL>", 13), (2, "clean", 5), (3, "", None), (4, "é <IP> <EMAIL>", 14)]
    assert pii.redact(docs.limit(0)).count() == 0


def test_trees_run_on_the_jvm_only(table_of):
    plan = pii.find_pii(table_of([(1, "a@b.cc")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- pieces

sp = importlib.import_module("sentencepiece")


def sample_texts():
    rnd = random.Random(2)
    letters = "aabbccdeeéß  ..,,thinger\n\t0123①日本語😀ing the ion"
    return (["", " ", "  a", "a  ", "\n", " \n x", "<s> </s> <0x41>", "▁a▁▁b"]
            + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(1500)]
            + [" ".join(rnd.choice(["the", "nation", "aaaa", "aaaaaaa", "ababab", "Internationalization", "été", "…", "====="])
                        for _ in range(10)) for _ in range(200)])


def test_bpe_ids_equal_the_library():
    enc = sentencepiece.Encoder(sentencepiece.Model.load(sentencepiece.MODEL))
    lib = sp.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    texts = sample_texts()
    data, off = text_bytes(pa.array(texts))
    ids, ends = enc.encode(data, off)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [lib.encode(t) for t in texts]
    back, be = enc.decode(ids, ends)
    assert [bytes(back[a:b]).decode() for a, b in zip(be[:-1], be[1:], strict=True)] == [t.replace("▁", " ") for t in texts]


def test_unigram_is_the_best_segmentation():
    model = sentencepiece.Model(["<unk>", "a", "b", "ab", "ba", "aba", "▁", "▁a", "c"],
                                [0, -2.0, -2.5, -3.0, -3.5, -5.9, -1.0, -2.2, -9.0], [2] + [1] * 8)
    enc = sentencepiece.Encoder(model)
    score = dict(zip(model.pieces, model.scores, strict=True))

    def best(text):
        if not text:
            return 0.0
        return max(score.get(text[:k], -19.0 if k == 1 else -1e9) + best(text[k:]) for k in range(1, min(3, len(text)) + 1))
    rnd = random.Random(1)
    for _ in range(200):
        text = "▁" + "".join(rnd.choice("abcz") for _ in range(rnd.randint(0, 9)))
        ids = enc.viterbi(text)
        got = sum(model.scores[i] if i else 0 for i in ids)
        z = len(re.findall("z", text))
        assert abs(got - 19.0 * z - best(text)) < 1e-9


def test_encode_and_decode_rows(table_of):
    rows = [(1, "Hello world"), (2, None), (3, ""), (1, "Hello world"), (None, " x "), (4, "y" * 30_000)]
    got = sentencepiece.encode(table_of(rows))
    out = got.collect()
    assert len(out) == 6 and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    back = {r.doc_id: r.text for r in sentencepiece.decode(got).collect()}
    assert back == {d: t or "" for d, t in rows}
    assert sentencepiece.encode(table_of(rows).limit(0)).count() == 0


# ---- vectors

def test_embedding_links(spark):
    rng = np.random.default_rng(3)
    rows, nan, inf = [], float("nan"), float("inf")
    for c in range(6):
        centre = rng.standard_normal(12)
        for _ in range(25):
            rows.append((len(rows), (centre + rng.normal(0, 0.25, 12)).tolist(), c % 2))
    rows += [(len(rows) + i, rng.standard_normal(12).tolist(), i % 3) for i in range(100)]
    rows += [(900 + i, rows[0][1], 0) for i in range(5)]
    odd = [(1000, None, 0), (1001, [0.0] * 12, 0), (1002, [nan] + [1.0] * 11, 0), (1003, [inf] + [1.0] * 11, 0), (1004, [], 0),
           (1005, [None] + [1.0] * 11, 0), (1006, rows[0][1], None), (1007, [1.0, 2.0], 0), (1008, [2.0, 4.0], 0), (1009, [1e300] * 2, 0)]
    df = spark.createDataFrame([(*r, "z") for r in rows + odd], "vec_id long, embedding array<double>, label int, block string")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, 0.93).collect()}
    fine = rows + [r for r in odd if r[0] in (1007, 1008, 1009)]
    unit = {v: np.array(x) / np.abs(x).max() / np.linalg.norm(np.array(x) / np.abs(x).max()) for v, x, _ in fine}
    links = [(a, b) for i, (a, x, p) in enumerate(fine) for b, y, q in fine[:i] if p == q and len(x) == len(y) and unit[a] @ unit[b] >= 0.93]
    top = union_find([v for v, *_ in rows + odd], links)
    n = {v: 0 for v, *_ in rows + odd}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert len(links) > 500
    assert {v: (r.n_links, r.component_id, r.kept) for v, r in got.items()} == {v: (n[v], top[v], top[v] == v) for v in n}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_kept_text_hash_of_nothing(table_of):
    r = substring_dedup.remove_repeats(table_of([(1, None)])).select(F.sha2("kept", 256).alias("h")).first()
    assert r.h == hashlib.sha256(b"").hexdigest()
