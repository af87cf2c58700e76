"""Token counts and cross-tokenizer alignment against the libraries."""

import hashlib
import importlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from eoframe.llm import pretokens, sentencepiece, token_counts, tokenizer_alignment
from eoframe.llm.common import text_bytes
from eoframe.llm.queries import QUERIES

SF_SMALL, SF_CHECK = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
BITS = ["a", "s", "t", "re", "ve", "ll", "d", "m", "'", "'", "’", " ", " ", "  ", "\n", "\t", "\r\n", "1", "٣", "½", "!",
        "…", "é", "日", "　", " ", " ", "😀", "<|endoftext|>", "<|endof", "Z", "_", "́", "​", "\x85", "𝟘"]


@pytest.fixture(scope="module")
def lib():
    return importlib.import_module("tokenizers").Tokenizer.from_file(token_counts.TOKENIZER)


def made_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", None]


def test_pretokens_are_the_librarys(lib):
    texts = made_texts(4000)
    pre = pretokens.PreTokenizer(token_counts.source_of(token_counts.TOKENIZER), True)
    data, offsets = text_bytes(pa.array(texts))
    start, end, first = pre.split(data, offsets)
    raw = data.tobytes()
    for i, t in enumerate(texts):
        want = []
        for part in re.split(r"(<\|endoftext\|>)", t or ""):
            if part == "<|endoftext|>":
                want.append(part.encode())
            elif part:
                want += [part[a:b].encode() for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(part)]
        assert [raw[start[j]:end[j]] for j in range(first[i], first[i + 1])] == want, t


def test_length_table_is_exact():
    words = [b"", b"a", b"aa", b"a\0", b"a" * 8, b"a" * 9, b"a" * 16, *(f"w{i}".encode() for i in range(3000))]
    t = token_counts.LengthTable.build(words[1:], list(range(1, 200)) * 20)
    data = b"".join(words)
    size = np.array([len(w) for w in words])
    k1, k2 = pretokens.keys(np.frombuffer(data, np.uint8), np.cumsum(size) - size, size)
    assert t.lookup(k1, k2, size).tolist() == [0, *[i % 199 + 1 for i in range(len(words) - 1)]]
    other = [f"x{i}".encode() for i in range(3000)] + [b"\0", b"a\0\0"]
    size = np.array([len(w) for w in other])
    k1, k2 = pretokens.keys(np.frombuffer(b"".join(other), np.uint8), np.cumsum(size) - size, size)
    assert not t.lookup(k1, k2, size).any()


def test_summary_keeps_the_heavy():
    rng = np.random.default_rng(1)
    held, truth = {}, Counter()
    for _ in range(40):
        part = Counter(f"{int(x)}".encode() for x in rng.zipf(1.3, 2000))
        truth += part
        held = token_counts.merge_summary(held, part, 200)
        assert len(held) <= 200
    slack = sum(truth.values()) / 200
    assert all(truth[p] - slack <= held.get(p, 0) <= truth[p] for p in truth)


def test_counts_are_the_librarys(spark, lib):
    long = "ab " * 40_000 + "x" * 30_000
    rows = [(i % 50, t, "n") for i, t in enumerate([*made_texts(600, 5), long, "<|endoftext|>" * 3, " a" * 1024, " a" * 1025])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    want = sorted((d, len((t or "").encode()), n, n > 1024) for d, t, _ in rows
                  for n in [len(lib.encode(t or "", add_special_tokens=False).ids)])
    for frequent in (None, [], [b" a", b"<|endoftext|>"]):
        got = token_counts.count_tokens(docs, frequent=frequent).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
        assert all(r.n_looked_up <= r.n_pretokens for r in got) and (frequent == [] or any(r.n_looked_up for r in got))
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_count_query(spark, lib):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_token_counts"](spark, SF_SMALL)
    assert sorted(map(tuple, got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())) == sorted(
        (d, len((t or "").encode()), n, n > 1024) for d, t in rows for n in [len(lib.encode(t or "", add_special_tokens=False).ids)])


def cuts(text, lib, sp, decoder):
    """(ids, byte lengths) of both tokenizers for a text, plainly; none if the bytes differ."""
    raw = (" " + text).encode() if text else b""
    if not raw:
        return [], [], [], []
    a = lib.encode(" " + text, add_special_tokens=False).ids
    a_bytes = [decoder(i) for i in a]
    b = sp.encode(text)
    b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return [], [], [], []
    return a, [len(x) for x in a_bytes], b, [len(x) for x in b_bytes]


def alignment_truth(rows, lib, sp, decoder):
    """The contract's columns by plain loops."""
    docs, counts = [], Counter()
    for d, text in rows:
        a, a_len, b, b_len = cuts(text, lib, sp, decoder)
        ends_a = {int(e): i for i, e in enumerate(np.cumsum(a_len))}
        ends_b = {int(e): i for i, e in enumerate(np.cumsum(b_len))}
        common = sorted(ends_a.keys() & ends_b.keys())
        groups, links, i, j = [], [], 0, 0
        for e in common:
            groups.append((a[i:ends_a[e] + 1], b[j:ends_b[e] + 1]))
            i, j = ends_a[e] + 1, ends_b[e] + 1
            links.append((a[i - 1], b[j - 1]))
        counts.update(links)
        docs.append((d, a, b, groups, links))
    top = {}
    for (x, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for d, a, b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(counts[p] == top[p[1]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def plain_lib(lib):
    own = importlib.import_module("tokenizers").Tokenizer.from_file(token_counts.TOKENIZER)
    own.encode_special_tokens = True
    pre = pretokens.PreTokenizer(token_counts.source_of(token_counts.TOKENIZER), False)
    pieces = tokenizer_alignment.byte_level_pieces(pre)
    sp = importlib.import_module("sentencepiece").SentencePieceProcessor(model_file=sentencepiece.MODEL)
    return own, sp, pieces.__getitem__


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("frequent", [1, 20, 1 << 18])
def test_alignment_equals_plain_loops(spark, plain_lib, frequent):
    texts = [*made_texts(300, 9), "a ▁b", "▁", " ", "  two  spaces ", "word " * 3000, "\u0000x", "日本語 " * 40, None, ""]
    rows = [(i % 200, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, row_no int, times int")
    linked = tokenizer_alignment.linked_documents(docs)
    got = tokenizer_alignment.link_statistics(linked, tokenizer_alignment.pair_counts(linked), frequent)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=repr) == alignment_truth(rows, *plain_lib)


def test_overlaps_of_groups(spark, plain_lib):
    rows = [(i, t) for i, t in enumerate(made_texts(60, 4))]
    got = tokenizer_alignment.align(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        text = rows[r.doc_id][1]
        a, a_len, b, b_len = cuts(text, *plain_lib)
        assert (r.a_ids, r.b_ids) == (a, b)
        a_end, b_end = np.cumsum(a_len).tolist(), np.cumsum(b_len).tolist()
        want = [(i, j, min(x, y) - max(x - n, y - m), x == y) for i, (x, n) in enumerate(zip(a_end, a_len))
                for j, (y, m) in enumerate(zip(b_end, b_len)) if max(x - n, y - m) < min(x, y)]
        assert [tuple(o) for o in r.overlaps] == want
        assert r.a_group == [sum(e in b_end for e in a_end[:i]) for i in range(len(a))]
    empty = spark.createDataFrame([], "doc_id long, text string")
    linked = tokenizer_alignment.linked_documents(empty)
    assert tokenizer_alignment.link_statistics(linked, tokenizer_alignment.pair_counts(linked)).count() == 0


def test_alignment_query(spark, plain_lib):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_tokenizer_alignment"](spark, SF_SMALL)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == alignment_truth(rows, *plain_lib)
