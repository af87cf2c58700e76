"""Language-model scores by masked pseudo-likelihood.

Every token is predicted from the tokens on both sides of it (never from itself) by a
small window network, and a document's score is the sum of these conditional log
probabilities.

Tokens are words, A-Z lower-cased. The most frequent words of the whole corpus have ids
of their own, the others share hashed ones; beyond a document's ends stands a padding
token. The number of ids grows with the square root of the corpus's tokens. The network
adds one embedding per neighbour, applies a rectifier, and predicts the token in two
steps, its class and then its place in the class, so a prediction costs two small
softmaxes instead of one over all ids. Where words share an id, a third factor is the
word's part of all tokens of that id, from counts of the whole corpus: the probabilities
of all words of the corpus add up to 1, whatever the context. The counts of the KNOWN
most frequent words travel to the tasks, the others are joined by the word's hash. A
word that the corpus lacks counts as seen once.

Training is data-parallel: word counts over all documents start the output biases;
then, in each round, every task trains the same starting weights on its own documents
and the weights are averaged, block by block, in proportion to the positions seen. Every
position of every document is trained on once: the rounds share the positions out. What
is gathered is one set of weights a task and the corpus's word counts, so it grows with
the input (a task has PER_ID tokens an id, so the weights do not outgrow it); what
reaches the driver is one set of weights and KNOWN counts.

Null and empty texts have no tokens, log_prob 0 and a null mean. Repeated rows are each
scored; an empty table trains nothing and gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, materialise, mix, slices, split_words, table, text_bytes, two_columns, word_hashes
from .registry import register

CLASSES, SIZE = 32, 32        # ids are CLASSES * SIZE; both double as the corpus grows
KNOWN = 1 << 20               # words whose counts travel to the tasks
WIDTH = 16                    # of the hidden layer
OFFSETS = (-2, -1, 1, 2)
ROUNDS = 2
PER_ID = 256                  # tokens of a training task, for each id
BATCH = 1024
BLOCK = 2048                  # weights in a row that travels
CACHED = 1 << 14              # weights moved at a time: all numbers of a step stay in cache

IDS = CLASSES * SIZE
_U = np.uint64


def shapes(times: int = 1) -> dict[str, tuple[int, ...]]:
    """times: how often CLASSES and SIZE are taken."""
    classes, size = times * CLASSES, times * SIZE
    return {"near": (len(OFFSETS), classes * size + 1, WIDTH), "hidden": (WIDTH,), "class": (WIDTH, classes),
            "class_bias": (classes,), "place": (classes, WIDTH, size), "place_bias": (classes, size)}


def grown(tokens: int) -> int:
    """How often CLASSES and SIZE are taken: at most sqrt(tokens) ids, and IDS at least."""
    times = 1
    while (2 * times) ** 4 * IDS ** 2 <= tokens:
        times *= 2
    return times


def unflatten(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at, times = {}, 0, 1
    while sum(int(np.prod(shape)) for shape in shapes(times).values()) < len(flat):
        times *= 2
    for name, shape in shapes(times).items():
        n = int(np.prod(shape))
        out[name] = flat[at:at + n].reshape(shape)
        at += n
    return out


@dataclass
class Vocabulary:
    """Hashes of the words with ids of their own, sorted, with their ids; of the others,
    the tokens of each shared id, and the known words' hashes, sorted, with their counts.
    ``rest`` has (word, n) of all further words; it stays on the driver."""

    hashes: np.ndarray
    ids: np.ndarray
    times: int = 1
    shared: np.ndarray | None = None
    known: np.ndarray | None = None
    counts: np.ndarray | None = None
    rest: DataFrame | None = None

    @property
    def size(self) -> int:
        return self.times ** 2 * IDS

    @property
    def kept(self) -> int:
        return self.size * 3 // 4

    def of(self, h: np.ndarray) -> np.ndarray:
        out = self.kept + (h % _U(self.size - self.kept)).astype(np.int64)
        if not len(self.hashes):
            return out
        # Hashes are spread evenly: few share their upper bits, and those stand together.
        upper = self.hashes >> _U(48)
        first = np.searchsorted(upper, np.arange((1 << 16) + 1, dtype=np.uint64))
        top = (h >> _U(48)).astype(np.int64)
        at, end = first.take(top), first.take(top + 1)
        look = np.flatnonzero(at < end)
        while len(look):
            place = at.take(look)
            same = self.hashes.take(place) == h.take(look)
            out[look[same]] = self.ids.take(place[same])
            at[look] += 1
            look = look[~same & (place + 1 < end.take(look))]
        return out

    def parts(self, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log part of each token in its id's tokens, the tokens that are not known and
        whose count is taken as 1)."""
        out, at = np.zeros(len(h)), np.flatnonzero(ids >= self.kept)
        if not len(at):
            return out, at
        word, back = np.unique(h[at], return_inverse=True)
        n, found = np.ones(len(word)), np.zeros(len(word), bool)
        if len(self.known):
            place = np.minimum(np.searchsorted(self.known, word), len(self.known) - 1)
            found = self.known[place] == word
            n = np.where(found, self.counts[place], 1)
        out[at] = np.log(n)[back] - np.log(np.maximum(self.shared, 1))[ids[at] - self.kept]
        return out, at[~found[back]]


def token_hashes(data: np.ndarray, offsets: np.ndarray):
    w = split_words(lower_ascii(data), offsets)
    return word_hashes(w), w.first


def neighbours(ids: np.ndarray, first: np.ndarray, outside: int = IDS) -> np.ndarray:
    """len(ids) x len(OFFSETS): the ids around each token, the padding id outside."""
    out = np.full((len(ids), len(OFFSETS)), outside, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for c, o in enumerate(OFFSETS):
        a, b = max(0, -o), len(ids) - max(0, o)
        if a < b:
            same = doc[a:b] == doc[a + o:b + o]
            out[a:b, c] = np.where(same, ids[a + o:b + o], outside)
    return out


def _hidden(w, near):
    h = w["near"][0].take(near[:, 0], axis=0)
    for c in range(1, len(OFFSETS)):
        h += w["near"][c].take(near[:, c], axis=0)
    h += w["hidden"]
    return np.maximum(h, 0, out=h)


def _less_largest(z):
    """z without the largest of each row, in place."""
    z -= np.maximum.reduceat(z.ravel(), np.arange(0, z.size, z.shape[1]))[:, None]
    return z


def _exp(z):
    """exp(z), each row divided by its largest, in place; and the rows' sums."""
    np.exp(_less_largest(z), out=z)
    return z, z.sum(1)


def _by_class(w, ids, near):
    """Positions in the order of their classes: (order, hidden layer, classes, places,
    ranges of the classes that occur, place scores)."""
    classes, size = w["place_bias"].shape
    group = ids // size
    order = np.argsort(group.astype(np.uint16) if classes < 1 << 16 else group, kind="stable")
    h, group, place = _hidden(w, near.take(order, axis=0)), group.take(order), ids.take(order) % size
    cuts = np.searchsorted(group, np.arange(classes + 1)).tolist()
    ranges = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
    z = np.empty((len(h), size), h.dtype)
    for k, a, b in ranges:
        h[a:b].dot(w["place"][k], out=z[a:b])
    z += w["place_bias"].take(group, axis=0)
    return order, h, group, place, ranges, z


def log_probs(w: dict[str, np.ndarray], ids: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Log probability of each id given its neighbours."""
    out = np.empty(len(ids))
    for s in range(0, len(ids), 1 << 13):
        order, h, group, place, _, z = _by_class(w, ids[s:s + (1 << 13)], near[s:s + (1 << 13)])
        row, got = np.arange(len(h)), np.zeros(len(h))
        for at, y in ((group, h @ w["class"] + w["class_bias"]), (place, z)):
            got += _less_largest(y)[row, at]
            got -= np.log(np.exp(y, out=y).sum(1))
        out[s + order] = got
    return out


def _gradient(w, ids, near):
    g, rows, values = _gradients(w, ids, near)
    g["near"] = np.zeros_like(w["near"])
    g["near"].reshape(-1, values.shape[1])[rows] = values
    return {name: g[name] for name in w}


def _gradients(w, ids, near):
    """(gradients of all weights but the embeddings, rows of the embeddings that occur,
    their gradients)."""
    n, row = len(ids), np.arange(len(ids))
    order, h, group, place, ranges, z = _by_class(w, ids, near)
    g = {"place": np.zeros_like(w["place"]), "place_bias": np.zeros_like(w["place_bias"])}
    p = h @ w["class"]
    p += w["class_bias"]
    p, total = _exp(p)
    p /= total[:, None] * n
    p[row, group] -= 1 / n
    g["class"], g["class_bias"] = h.T @ p, p.sum(0)
    dh = p @ w["class"].T
    z, total = _exp(z)
    z /= total[:, None] * n
    z[row, place] -= 1 / n
    back = np.empty_like(dh)
    for k, a, b in ranges:
        part = z[a:b]
        h[a:b].T.dot(part, out=g["place"][k])
        part.dot(w["place"][k].T, out=back[a:b])
    dh += back
    g["place_bias"][[k for k, _, _ in ranges]] = np.add.reduceat(z, [a for _, a, _ in ranges], axis=0)
    dh *= h > 0
    g["hidden"] = dh.sum(0)
    # One row of the embeddings for each offset and id around.
    key = (near.take(order, axis=0) + np.arange(len(OFFSETS)) * w["near"].shape[1]).T.ravel()
    by = np.argsort(key.astype(np.uint16) if w["near"][..., 0].size <= 1 << 16 else key, kind="stable")
    key = key.take(by)
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    length = np.diff(np.append(start, len(by)))
    # Longest first: rows with a second, a third and so on position stand at the front.
    front = np.argsort((len(by) - length).astype(np.uint16 if len(by) < 1 << 16 else np.int64), kind="stable")
    start, length, sums = start.take(front), length.take(front), dh.take(by % n, axis=0)
    rows, values = key.take(start), sums.take(start, axis=0)
    ends = np.searchsorted(-length, -np.arange(33)).tolist()  # rows of more than so many
    long = ends[32]
    for k, (a, many) in enumerate(zip(start[:long].tolist(), length[:long].tolist(), strict=True)):
        values[k] = sums[a:a + many].sum(0)
    for more, end in enumerate(ends[1:32], 1):
        if end == long:
            break
        values[long:end] += sums.take(start[long:end] + more, axis=0)
    return g, rows, values


def train(flat: np.ndarray, batches, rate: float) -> tuple[np.ndarray, int]:
    """Adam from the given weights over (ids, near) batches: (weights, positions). Rows of
    the embeddings move, and their moments fade, in the batches where they occur."""
    flat = flat.astype(np.float32).copy()
    w = unflatten(flat)
    cut = w["near"].size  # the embeddings come first
    table = w["near"].reshape(-1, WIDTH)
    m, v, seen = np.zeros_like(flat), np.zeros_like(flat), 0
    m_table, v_table = m[:cut].reshape(-1, WIDTH), v[:cut].reshape(-1, WIDTH)

    def move(x, m, v, g, step):
        m *= 0.9
        m += np.float32(0.1) * g
        v *= 0.99
        g *= g
        g *= 0.01
        v += g
        np.sqrt(v, out=g)
        g *= 1 / math.sqrt(1 - 0.99 ** step)
        g += 1e-7
        np.divide(m, g, out=g)
        g *= rate / (1 - 0.9 ** step)
        x -= g

    for step, (ids, near) in enumerate(batches, 1):
        g, rows, values = _gradients(w, ids, near)
        rest = np.concatenate([g[name].ravel() for name in w if name != "near"])
        for a in range(0, len(rest), CACHED):
            b = cut + a + CACHED
            move(flat[cut + a:b], m[cut + a:b], v[cut + a:b], rest[a:a + CACHED], step)
        x, mx, vx = (held.take(rows, axis=0) for held in (table, m_table, v_table))
        move(x, mx, vx, values, step)
        table[rows], m_table[rows], v_table[rows] = x, mx, vx
        seen += len(ids)
    return flat, seen


def _positions(batches, vocabulary: Vocabulary, phase: int, rounds: int):
    """Training batches: one in ``rounds`` positions of every document. Each position has
    its turn in one phase below ``rounds``."""
    held_ids, held_near, held = [], [], 0
    for b in batches:
        data, offsets = text_bytes(b.column(0))
        for lo, hi in slices(offsets):
            h, first = token_hashes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
            if not len(h):
                continue
            ids = vocabulary.of(h)
            start = np.repeat(first[:-1], np.diff(first))
            pick = np.flatnonzero((np.arange(len(ids)) - start + (mix(h[start]) % _U(rounds)).astype(np.int64)) % rounds == phase)
            held_ids.append(ids[pick])
            held_near.append(neighbours(ids, first, vocabulary.size).take(pick, axis=0))
            held += len(pick)
            if held >= 64 * BATCH:
                yield from _shuffled(held_ids, held_near)
                held_ids, held_near, held = [], [], 0
    if held:
        yield from _shuffled(held_ids, held_near)


def _shuffled(ids, near):
    ids, near = np.concatenate(ids), np.concatenate(near)
    order = np.random.default_rng(len(ids)).permutation(len(ids))
    for s in range(0, len(ids), BATCH):
        yield ids.take(order[s:s + BATCH]), near.take(order[s:s + BATCH], axis=0)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): hashes and counts of all words of the corpus."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, offsets = text_bytes(b.column(0))
            got = [token_hashes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])[0] for lo, hi in slices(offsets)]
            if got:
                word, n = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])
    return (docs.where("text is not null").select("text").mapInArrow(run, "word bigint, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")))


def learn(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Vocabulary, np.ndarray]:
    """(vocabulary, weights) of all documents (doc_id, text)."""
    counts = materialise(word_counts(docs))
    # A row for each count that occurs: with n tokens fewer than sqrt(2 n).
    often = sorted(((r["n"], r["words"]) for r in counts.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    tokens, words, cut = sum(n * k for n, k in often), 0, math.inf
    for n, k in often:
        if words + k > KNOWN:
            break
        words, cut = words + k, n
    vocabulary = Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), grown(tokens))
    size, kept, times = vocabulary.size, vocabulary.kept, vocabulary.times
    # Bounded by the model: the ids' words, a row a shared id, KNOWN words.
    shared = F.lit(kept) + F.pmod(F.pmod("word", F.lit(size - kept)) + F.when(F.col("word") < 0, (1 << 64) % (size - kept))
                                  .otherwise(0), F.lit(size - kept))
    top = counts.orderBy(F.desc("n"), "word").limit(kept).collect()
    slots = counts.groupBy(shared.alias("id")).agg(F.sum("n").alias("n")).collect()
    h = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    ids = np.arange(len(h))
    order = np.argsort(h)
    n = np.full(size, 0.5)
    for r in slots:
        n[r["id"]] += r["n"]
    for k, r in enumerate(top):
        n[k] += r["n"]
        n[kept + int(np.uint64(h[k]) % _U(size - kept))] -= r["n"]
    known = (counts.where(F.col("n") >= cut) if words else counts.limit(0)).select("word", "n").toArrow()
    word, seen = known["word"].to_numpy().view(np.uint64), known["n"].to_numpy().astype(float)
    by = np.argsort(word)
    vocabulary = Vocabulary(h[order], ids[order], times, n[kept:] - 0.5, word[by], seen[by],
                            counts.where(F.col("n") < cut) if words < sum(k for _, k in often) else None)
    n = np.maximum(n, 0.5).reshape(times * CLASSES, times * SIZE)
    rng = np.random.default_rng(1)
    start = {name: rng.normal(0, 0.1, shape) for name, shape in shapes(times).items()}
    start["hidden"] = np.full(WIDTH, 0.1)
    start["class_bias"] = np.log(n.sum(1) / n.sum())
    start["place_bias"] = np.log(n / n.sum(1, keepdims=True))
    flat = np.concatenate([start[k].ravel() for k in shapes(times)]).astype(np.float32)
    texts = docs.where("text is not null").select("text").coalesce(max(1, tokens // (PER_ID * size)))
    small = Vocabulary(vocabulary.hashes, vocabulary.ids, times)
    for k in range(rounds if len(top) else 0):
        flat = _round(texts, small, flat, k, rounds, 0.01 / (1 + k))
    return vocabulary, flat


def _round(texts: DataFrame, vocabulary: Vocabulary, flat: np.ndarray, phase: int, rounds: int, rate: float) -> np.ndarray:
    """One pass: every task trains from ``flat``; the mean of what they end with."""
    blocks = -(-len(flat) // BLOCK)

    def work(batches):
        import pyarrow as pa

        got, seen = train(flat, _positions(batches, vocabulary, phase, rounds), rate)
        if seen:
            got = np.append(got, np.zeros(blocks * BLOCK - len(got), np.float32)).reshape(blocks, BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), pa.array(np.full(blocks, float(seen))),
                                              pa.array([x.tobytes() for x in got], pa.binary())], ["block", "seen", "weights"])

    def mean(batches):
        """Rows of one block after the other; only one block is held."""
        import pyarrow as pa

        at, total, seen, out = None, 0.0, 0.0, []
        for b in batches:
            for block, n, raw in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if block != at:
                    if at is not None:
                        out.append((at, (total / seen).astype(np.float32).tobytes()))
                    at, total, seen = block, 0.0, 0.0
                total, seen = total + n * np.frombuffer(raw, np.float32).astype(float), seen + n
        if at is not None:
            out.append((at, (total / seen).astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())],
                                         ["block", "weights"])

    rows = (texts.mapInArrow(work, "block int, seen double, weights binary")
            .repartition("block").sortWithinPartitions("block", "seen", "weights")
            .mapInArrow(mean, "block int, weights binary").collect())
    if not rows:
        return flat
    return np.concatenate([np.frombuffer(bytes(r["weights"]), np.float32) for r in sorted(rows, key=lambda r: r["block"])])[:len(flat)]


def score(docs: DataFrame, vocabulary: Vocabulary, flat: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob), a row per row of docs."""
    docs = two_columns(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    local = replace(vocabulary, rest=None)

    def run(batches):
        import pyarrow as pa

        w = unflatten(flat)
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for lo, hi in slices(offsets):
                h, first = token_hashes(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                ids = local.of(h)
                part, other = local.parts(h, ids)
                total = np.concatenate([[0.0], np.cumsum(log_probs(w, ids, neighbours(ids, first, local.size)) + part)])
                sums = total[first[1:]] - total[first[:-1]]
                # The words whose counts are still to come, once a document.
                doc = np.searchsorted(first, other, side="right") - 1
                other = other[order := np.lexsort((h[other], doc))]
                doc, word = doc[order], h[other]
                new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1]))[:len(doc)])
                ends = pa.array(np.searchsorted(doc[new], np.arange(hi - lo + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    b.column(2).slice(lo, hi - lo), b.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(sums),
                    pa.ListArray.from_arrays(ends, pa.array(word[new].view(np.int64))),
                    pa.ListArray.from_arrays(ends, pa.array(np.diff(np.append(new, len(doc))), pa.int64()))],
                    ["row", "doc_id", "n_tokens", "log_prob", "words", "times"])
    got = (docs.withColumn("row", F.monotonically_increasing_id())
           .mapInArrow(run, f"row bigint, doc_id {kind}, n_tokens bigint, log_prob double, words array<bigint>, times array<bigint>"))
    if vocabulary.rest is not None:
        got = materialise(got)
        pairs = got.select("row", F.explode(F.arrays_zip("words", "times")).alias("p")).select("row", "p.words", "p.times")
        more = (pairs.join(vocabulary.rest, F.col("words") == F.col("word"))
                .groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("more")))
        got = got.join(more, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    return got.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
                      .alias("mean_log_prob"))


@register("op4_lm_scoring")
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = two_columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    return score(docs, *learn(docs))
