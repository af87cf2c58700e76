"""Language identification by sparse multinomial logistic regression.

A text's features are its character 1- to 3-grams (letters lower-cased, everything else
a space), hashed into DIM slots, as log(1 + count) times inverse document frequency,
scaled to unit length. Document frequencies cover every document of the training fold.
The weights are trained by follow-the-regularised-leader with L1 and L2 penalties on a
bounded sample of labelled rows (``sample_rows``, shared evenly by the languages), which
leaves most of them zero; a temperature fitted on a part of the sample that the weights
have not seen makes the scores probabilities.

Language, source and id are never inputs of a prediction. A null text, or one without
letters, is ``und`` with score 0, and so is every text if no labelled row exists.
Languages are ordered by name, so ties go to the first. Repeated rows are each
predicted; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, slices, table, text_bytes
from .registry import register

DIM = 8192
ORDERS = (1, 2, 3)
SAMPLE_ROWS = 6_000
STEP = 1 << 20      # bytes of text made into features at once
UNKNOWN = "und"

_U = np.uint64


def letter_table() -> np.ndarray:
    """Code point -> itself, or a space if it is no letter."""
    t = np.full(0x110000, 32, np.uint32)
    letters = [c for c in range(0x20000) if chr(c).isalpha()]
    t[letters] = letters
    t[0x20000:0x32000] = np.arange(0x20000, 0x32000)  # ideographs
    return t


def count_matrix(texts: list[str], letters: np.ndarray):
    """(counts, any): hashed n-gram counts, a row per text, and whether it has letters."""
    low = [t.lower() for t in texts]
    ends = np.cumsum([len(t) for t in low])
    code = letters[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.repeat(np.arange(len(low)), np.diff(np.concatenate([[0], ends])))
    has = np.bincount(doc[code != 32], minlength=len(low)) > 0
    out = np.zeros(len(low) * DIM, np.int64)
    base = doc * DIM
    key = np.zeros(len(code), np.uint64)
    wide = code.astype(np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        key = (key[:m] * _U(0x9E3779B97F4A7C15)) + wide[n - 1:]
        if n not in ORDERS:
            continue
        inside = doc[:m] == doc[n - 1:]
        if n == 1:
            inside &= code != 32
        slot = ((key + _U(n)) * _U(0xD6E8FEB86659FD93) >> _U(64 - DIM.bit_length() + 1)).astype(np.int64)
        out += np.bincount((base[:m] + slot)[inside], minlength=len(out))
    return out.reshape(len(low), DIM), has


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts.astype(np.float32)) * idf
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(size, 1e-12)


def _chunks(column):
    """(from, to, texts) over an Arrow string column, bounded in bytes."""
    _, offsets = text_bytes(column)
    for lo, hi in slices(offsets, STEP):
        yield lo, hi, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


@dataclass
class Model:
    """Small: DIM numbers a language."""

    langs: list[str]
    weights: np.ndarray      # DIM x languages, mostly zero
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return weighted(counts, self.idf) @ self.weights.astype(np.float32) + self.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train_ftrl(rows, y: np.ndarray, classes: int, alpha=2.0, beta=1.0, l1=0.1, l2=0.01, epochs=4, seed=7):
    """FTRL-proximal on sparse rows (slots, values). Returns (weights, bias)."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))
    penalty = np.full((DIM + 1, 1), l1)
    penalty[DIM] = 0.0  # the bias

    def weight(at):
        zz, nn = z[at], n[at]
        w = -(zz - np.sign(zz) * penalty[at]) / ((beta + np.sqrt(nn)) / alpha + l2)
        return np.where(np.abs(zz) <= penalty[at], 0.0, w)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, DIM), np.append(x, 1.0)
            w = weight(at)
            p = _softmax((x @ w)[None])[0]
            p[y[i]] -= 1.0
            g = x[:, None] * p
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
    w = weight(np.arange(DIM + 1))
    return w[:DIM], w[DIM]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.1), np.log(20), 107))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model of the training fold; None without labelled rows."""
    fold = (docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                        F.col(f"`{lang_col}`").cast("string").alias("lang"))
            .where("doc_id is not null and text is not null and lang is not null").where(~held_out()))
    sizes = {r["lang"]: r["n"] for r in fold.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)

    def frequencies(batches):
        import pyarrow as pa

        letters, df, n = letter_table(), np.zeros(DIM, np.int64), 0
        for b in batches:
            for _, _, texts in _chunks(b.column(0)):
                counts, _ = count_matrix(texts, letters)
                df += (counts > 0).sum(0)
                n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array(np.append(df, n))], ["slot", "n"])

    df = np.zeros(DIM + 1)
    for r in fold.select("text").mapInArrow(frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        df[r["slot"]] = r["n"]
    idf = (np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1).astype(np.float32)

    share = max(1, sample_rows // len(langs))
    cut = F.element_at(F.create_map(*[F.lit(v) for k in langs for v in (k, int((1 << 30) * min(1.0, share / sizes[k])))]),
                       F.col("lang"))
    sample = fold.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < cut)

    def sparse(batches):
        import pyarrow as pa

        letters = letter_table()
        for b in batches:
            for lo, hi, texts in _chunks(b.column(1)):
                x = weighted(count_matrix(texts, letters)[0], idf)
                row, slot = np.nonzero(x)
                ends = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo),
                    pa.ListArray.from_arrays(ends, pa.array(slot.astype(np.int16))),
                    pa.ListArray.from_arrays(ends, pa.array(x[row, slot].astype(np.float32)))],
                    ["doc_id", "lang", "slots", "values"])

    kind = fold.schema["doc_id"].dataType.simpleString()
    got = (sample.select("doc_id", "text", "lang")
           .mapInArrow(sparse, f"doc_id {kind}, lang string, slots array<smallint>, values array<float>")
           .orderBy("doc_id", F.xxhash64("slots", "values")).toArrow())
    rows = [(np.asarray(s.values, np.int64), np.asarray(v.values, float))
            for s, v in zip(got.column("slots"), got.column("values"), strict=True)]
    y = np.array([langs.index(x) for x in got.column("lang").to_pylist()], np.int64)
    test = np.arange(len(rows)) % 6 == 5
    train = np.flatnonzero(~test) if (~test).any() else np.arange(len(rows))
    w, bias = train_ftrl([rows[i] for i in train], y[train], len(langs))
    seen = np.flatnonzero(test)
    z = np.array([rows[i][1] @ w[rows[i][0]] + bias for i in seen]).reshape(len(seen), len(langs))
    return Model(langs, w, bias, idf, fit_temperature(z, y[seen]))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), a row per row of docs."""
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        letters = letter_table()
        for b in batches:
            for lo, hi, texts in _chunks(b.column(1)):
                best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if model:
                    counts, has = count_matrix(texts, letters)
                    p = _softmax(model.logits(counts).astype(float) / model.temperature)
                    best = [model.langs[k] if h else UNKNOWN for k, h in zip(p.argmax(1), has, strict=True)]
                    score = np.where(has, p.max(1), 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(best, pa.string()), pa.array(score)],
                                                 ["doc_id", "lang_pred", "score"])
    return docs.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


@register("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
