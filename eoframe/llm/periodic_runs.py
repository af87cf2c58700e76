"""Periodic runs of words, found on a grammar.

A run is a stretch of consecutive words of one text with smallest period q and a length
of at least ``max(least, power * q)`` that no neighbouring word extends. The texts of a
batch are compressed together: words become ids, and Re-Pair replaces pairs of
neighbouring symbols that occur at least twice by a new symbol, the most frequent ones
first; in one round every pair is replaced where no more frequent pair overlaps it, until
none is left. What remains of a text, its start rule, is halved into a balanced tree. So
every word position lies between the two sides of some rule, and each run, seen from the
lowest derivation node that contains it whole, crosses the border between that node's two
sides.

For each rule the runs that cross its border are computed once, on one of its places:
such a run has at least two periods on one side, so its period is one of the lengths at
which a square starts or ends at the border. Squares are proposed by hashes and each
proposed stretch is compared and extended word by word. Stretches are then translated to
all places the rule derives; one that touches its rule's end is part of a longer one
found higher up, so of the intervals of one period those that no other contains are kept.

A text is handled in one task, in memory proportional to its words; nothing is shuffled.
Null and empty texts have no words and no runs and collapse to an empty text. Repeated
rows are each handled; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, mix, slices, split_words, table, text_bytes, two_columns, word_hashes
from .pretokens import KEY_BYTES, keys
from .registry import register

LEAST = 6     # words
POWER = 4     # periods
_BLOCK = 1 << 21
_U = np.uint64


def word_ids(w: Words) -> np.ndarray:
    """A number per word, equal exactly for equal words."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    _, at, ids = np.unique(word_hashes(w), return_index=True, return_inverse=True)
    size = w.end - w.start
    k1, k2 = keys(w.data, w.start, size)
    rep = at[ids]
    same = (size == size[rep]) & (k1 == k1[rep]) & (k2 == k2[rep])
    raw = w.data.tobytes()
    for i in np.flatnonzero(same & (size > KEY_BYTES)).tolist():
        r = rep[i]
        if raw[w.start[i]:w.end[i]] != raw[w.start[r]:w.end[r]]:
            same[i] = False
    if same.all():
        return ids
    known: dict[bytes, int] = {}  # two words share a hash
    return np.array([known.setdefault(raw[s:e], len(known)) for s, e in
                     zip(w.start.tolist(), w.end.tolist(), strict=True)], np.int64)


class Derivation:
    """Nodes of all texts' derivation trees: rule, first word, border, end."""

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        n = len(ids)
        self.sym = ids.astype(np.int64)
        self.at = np.arange(n + 1)          # first word of each symbol, and the end
        self.text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.next_rule = int(ids.max()) + 1 if n else 0
        self.found: list[tuple[np.ndarray, ...]] = []
        self.terminals = self.next_rule
        maybe = np.ones(n, bool)            # may the pair that starts here occur twice?
        while len(self.sym) > 1:
            picked, rule = self._pairs(maybe)
            if not len(picked):
                break
            maybe = self._replace(picked, rule, maybe)
        while True:                          # start rules
            here = np.arange(len(self.sym)) - np.searchsorted(self.text, self.text)
            here = np.flatnonzero(here % 2 == 0)
            here = here[here + 1 < len(self.sym)]
            here = here[self.text[here] == self.text[here + 1]]
            if not len(here):
                break
            self._replace(here, self.next_rule + np.arange(len(here)), np.zeros(len(self.sym), bool))
        self.rule, self.start, self.border, self.end = (
            np.concatenate(x) if self.found else np.zeros(0, np.int64) for x in (zip(*self.found) if self.found else [()] * 4))

    def _pairs(self, maybe: np.ndarray):
        """Pairs to replace in this round and their new symbols."""
        sym = self.sym
        pos = np.flatnonzero(maybe[:-1] & (self.text[:-1] == self.text[1:]))
        twin = sym[pos] == sym[pos + 1]
        if twin.any():
            # Of a row of equal symbols every second pair counts, from the row's start.
            new = np.ones(len(sym), bool)
            new[1:] = (sym[1:] != sym[:-1]) | (self.text[1:] != self.text[:-1])
            row = np.maximum.accumulate(np.where(new, np.arange(len(sym)), 0))
            pos = pos[~(twin & ((pos - row[pos]) % 2 == 1))]
        key, which, n = np.unique(sym[pos] << 31 | sym[pos + 1], return_inverse=True, return_counts=True)
        again = n[which] >= 2
        maybe[pos[~again]] = False
        pos, which = pos[again], which[again]
        rank = np.zeros(len(sym) + 2, np.int64)
        order = n << 31 | (mix(key.astype(np.uint64)) & _U(0x7FFFFFFF)).astype(np.int64)
        rank[pos + 1] = order[which]
        top = (rank[pos + 1] > rank[pos]) & (rank[pos + 1] >= rank[pos + 2])
        pos, which = pos[top], which[top]
        often = np.bincount(which, minlength=len(key)) >= 2
        pos, which = pos[often[which]], which[often[which]]
        return pos, self.next_rule + (np.cumsum(often) - 1)[which]

    def _replace(self, pos: np.ndarray, rule: np.ndarray, maybe: np.ndarray) -> np.ndarray:
        self.found.append((rule, self.at[pos], self.at[pos + 1], self.at[pos + 2]))
        self.next_rule = int(rule.max()) + 1
        self.sym[pos] = rule
        maybe[pos] = True
        maybe[pos[pos > 0] - 1] = True
        keep = np.ones(len(self.sym), bool)
        keep[pos + 1] = False
        self.sym, self.text, maybe = self.sym[keep], self.text[keep], maybe[keep]
        self.at = self.at[np.append(keep, True)]
        return maybe


def square_candidates(ids: np.ndarray, start, border, end, power: int, least: int):
    """(rule, side, period): lengths at which a square seems to start (side 0) or end
    (side 1) at a rule's border. No square that belongs to a run is left out."""
    n = len(ids)
    if not n:
        return np.zeros((3, 0), np.int64)
    value = mix(ids.astype(np.uint64) + _U(1))
    base = _U(0x9E3779B97F4A7C55)
    powers = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n, base)]))
    inverse = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n, _U(pow(int(base), -1, 1 << 64)))]))
    acc = np.concatenate([[_U(0)], np.cumsum(value * powers[:-1])])
    size = end - start
    out = []
    for side, room in ((0, end - border), (1, border - start)):
        most = np.where(size >= least, np.minimum(size // power, room // 2), 0)
        stop = np.cumsum(most)
        for lo in range(0, int(stop[-1]) if len(stop) else 0, _BLOCK):
            hi = min(lo + _BLOCK, int(stop[-1]))
            a, z = np.searchsorted(stop, [lo, hi - 1], side="right")
            bound = np.clip(stop[a:z + 1], lo, hi)
            rule = np.repeat(np.arange(a, z + 1), np.diff(np.concatenate([[lo], bound])))
            q = np.arange(lo, hi) - (stop[rule] - most[rule]) + 1
            for near in (0, 1):  # the first and the last word of one period
                b = border[rule]
                if side == 0:
                    same = ids[b + near * (q - 1)] == ids[b + near * (q - 1) + q]
                else:
                    same = ids[b - 1 - near * (q - 1)] == ids[b - 1 - near * (q - 1) - q]
                rule, q = rule[same], q[same]
            x = border[rule] - 2 * q * side
            same = (acc[x + q] - acc[x]) * inverse[x] == (acc[x + 2 * q] - acc[x + q]) * inverse[x + q]
            out.append(np.stack([rule[same], np.full(same.sum(), side), q[same]]))
    return np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)


def stretch(ids: np.ndarray, at: int, q: int, lo: int, hi: int) -> tuple[int, int]:
    """The longest stretch of period q inside lo:hi that holds at:at + q, word by word."""
    i, step = at, 64
    while i + q < hi:
        k = min(hi - q, i + step)
        wrong = ids[i:k] != ids[i + q:k + q]
        j = int(wrong.argmax())
        if wrong[j]:
            hi = i + j + q
            break
        i, step = k, 2 * step
    j, step = at, 64
    while j > lo:
        k = max(lo, j - step)
        wrong = (ids[k:j] != ids[k + q:j + q])[::-1]
        m = int(wrong.argmax())
        if wrong[m]:
            lo = j - m
            break
        j, step = k, 2 * step
    return lo, hi


def crossing_runs(ids, start, border, end, power: int, least: int):
    """(rule, first, end, period) of the stretches with enough periods that cross or touch
    each rule's border, inside the rule's own words."""
    rule, side, period = square_candidates(ids, start, border, end, power, least)
    order = np.lexsort((period, side, rule))
    out, group, held = [], None, []
    for r, d, q in zip(rule[order].tolist(), side[order].tolist(), period[order].tolist(), strict=True):
        if (r, d) != group:
            group, held, b = (r, d), [], int(border[r])
        low = b - 2 * q if d else b
        # A square inside a stretch whose period divides its own is that stretch again.
        if any(q % p == 0 and s <= low and low + 2 * q <= e for p, s, e in held):
            continue
        s, e = stretch(ids, low, q, int(start[r]), int(end[r]))
        if e - s >= 2 * q:
            held.append((q, s, e))
            if e - s >= max(least, power * q):
                out.append((r, s, e, q))
    return np.array(out, np.int64).reshape(-1, 4).T


def runs_of(ids: np.ndarray, first: np.ndarray, power: int = POWER, least: int = LEAST):
    """(start, end, period) of all runs of some texts, by start, then period."""
    d = Derivation(ids, first)
    if not len(d.rule):
        return (np.zeros(0, np.int64),) * 3
    rules, rep = np.unique(d.rule, return_index=True)
    which, s, e, q = crossing_runs(ids, d.start[rep], d.border[rep], d.end[rep], power, least)
    # All places of the rules that have some.
    busy = np.zeros(d.next_rule, bool)
    busy[rules[which]] = True
    nodes = np.flatnonzero(busy[d.rule])
    nodes = nodes[np.argsort(d.rule[nodes], kind="stable")]
    lo = np.searchsorted(d.rule[nodes], rules[which])
    n = np.searchsorted(d.rule[nodes], rules[which], side="right") - lo
    each = np.repeat(np.arange(len(which)), n)
    place = nodes[np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + lo[each]]
    shift = d.start[place] - d.start[rep][which[each]]
    return maximal(s[each] + shift, e[each] + shift, q[each])


def maximal(s, e, q):
    """Of the intervals of one period those that no other contains, by start, then period."""
    order = np.lexsort((-e, s, q))
    s, e, q = s[order], e[order], q[order]
    lift = q * (int(e.max()) + 1 if len(e) else 1)  # periods apart, in rising order
    reach = np.maximum.accumulate(e + lift) if len(e) else e
    keep = np.ones(len(s), bool)
    keep[1:] = (e + lift)[1:] > reach[:-1]
    s, e, q = s[keep], e[keep], q[keep]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  power: int = POWER, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row: runs by start, then period; collapsed is
    the text's words without those that some run holds after its first period."""
    if power < 3 or least < 1:
        raise ValueError("a run needs at least three periods")
    docs = two_columns(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for lo, hi in slices(offsets):
                w = split_words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                s, e, q = runs_of(word_ids(w), w.first, power, least)
                text = np.searchsorted(w.first, s, side="right") - 1
                runs = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(s - w.first[text]), pa.array(e - s), pa.array(q)], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), pa.array(np.diff(w.first)), runs,
                    pa.array(joined(w, covered(len(w.start), s + q, e)), pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
    return docs.mapInArrow(run, f"doc_id {kind}, n_words bigint, "
                                "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    step = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def joined(w: Words, dropped: np.ndarray) -> list[bytes]:
    """Per text, its words that stay, with one space between them."""
    stay = np.flatnonzero(~dropped)
    size = w.end[stay] - w.start[stay] + 1
    total = np.concatenate([[0], np.cumsum(size)])
    # Each word with the byte after it, which then becomes a space.
    source = np.concatenate([w.data, np.zeros(1, np.uint8)])
    out = source[np.repeat(w.start[stay] - total[:-1], size) + np.arange(total[-1])]
    out[total[1:] - 1] = 32
    ends = total[np.searchsorted(stay, w.first)]
    raw = out.tobytes()
    return [raw[a:z - 1] if z > a else b"" for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where every text whose id's crc32 is divisible by ten becomes
    periodic from some word on, as the query's contract says. A null id plants nothing."""
    docs = two_columns(docs, "doc_id", "text")

    def plant(doc_id, text):
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        words = (text or b"").split()
        if h % 10 or not words:
            return text
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column(1).cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(
                [plant(d, t) for d, t in zip(b.column(0).to_pylist(), texts, strict=True)], pa.binary()).cast(pa.string())],
                ["doc_id", "text"])
    return docs.mapInArrow(run, docs.schema)


def digest(runs: DataFrame) -> DataFrame:
    """The query's columns of periodic_runs: number, strongest run, hashes."""
    better = lambda best, x: F.when(
        best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    lines = F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"),
                                                      x["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return (runs.withColumn("best", F.aggregate("runs", none, better))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
                    F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


@register("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))))
