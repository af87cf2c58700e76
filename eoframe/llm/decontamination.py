"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are brought to a normal form: UTF-8 bytes with A-Z and the
capitals of Latin-1 lower-cased and each run of other ASCII characters than letters and
digits as one space. A document holds an item of ``m`` bytes when some stretch of it is
within ``k = floor(rate * m)`` byte edits of the item (smaller where the lemma would
say nothing, see ``budget``).

Such a stretch keeps at least ``m - q + 1 - k * q`` of the item's q-grams, on diagonals
(document position minus item position) that differ by at most ``k``. So:

1. every position of every document is looked up in the set of the items' q-grams, and
   only neighbourhoods dense in hits go on;
2. hits are counted per item and diagonal band; bands are ``2 * (k + 1)`` wide and
   overlap by half, so one of them holds the whole alignment;
3. bands that reach the bound are verified by a banded alignment with free ends in the
   document.

The items are the query set. They travel to the tasks in blocks of at most
``block_bytes``, one pass over the documents a block, whatever their number. Documents
are never shuffled.

Null and empty texts and items match nothing; items shorter than q bytes are matched
exactly, as whole words; repeated rows are each reported; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_rows, slices, table, text_bytes, two_columns
from .registry import register

Q = 8
RATE = 0.08
BLOCK_BYTES = 4 << 20

_U = np.uint64
_TABLE_BITS = 21


def _normal_table() -> np.ndarray:
    t = np.full(256, 32, np.uint8)
    for a, b in ((48, 58), (97, 123), (128, 256)):
        t[a:b] = np.arange(a, b)
    t[65:91] = np.arange(97, 123)
    return t


_NORMAL = _normal_table()


def normal_form(data: np.ndarray, offsets: np.ndarray):
    """(bytes, offsets, kept): normal forms of some texts, one after the other; kept
    marks the bytes of the input that are left."""
    x = _NORMAL[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    if len(lead):
        c = x[lead]
        x[lead] = c + ((c >= 0x80) & (c <= 0x9E) & (c != 0x97)).astype(np.uint8) * np.uint8(32)
    space = x == 32
    kept = np.ones(len(x), bool)
    kept[1:] = ~(space[1:] & space[:-1])
    first = offsets[:-1]
    kept[first[first < len(x)]] = True
    total = np.zeros(len(x) + 1, np.int64)
    np.cumsum(kept, out=total[1:])
    return x[kept], total[offsets], kept


def grams(x: np.ndarray, q: int = Q) -> np.ndarray:
    """Each q bytes (at most 8) as one integer."""
    n = len(x) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.append(x, np.zeros(8, np.uint8))
    out = np.ndarray((n,), "<u8", padded.tobytes(), strides=(1,))
    return out & _U((1 << 8 * q) - 1) if q < 8 else out.copy()


def _slot(g: np.ndarray) -> np.ndarray:
    h = g * _U(0x9E3779B97F4A7C15)
    h >>= _U(64 - _TABLE_BITS)
    return h.view(np.int64)


def budget(m: int, q: int, rate: float) -> tuple[int, int]:
    """(k, shared): the edits allowed for m bytes and the q-grams that they leave; k is
    lowered until at least a fifth of the q-grams, and two, are left."""
    k = int(rate * m)
    while k and m - q + 1 - k * q < max(2, (m - q + 1) // 5):
        k -= 1
    return k, m - q + 1 - k * q


class Items:
    """A block of benchmark items, indexed by q-gram. Built once in a task."""

    def __init__(self, rows: list[tuple[int, str]], q: int, rate: float):
        self.q, self.ids, self.text, self.short = q, [], [], []
        for item, text in rows:
            raw = np.frombuffer(text.encode(), np.uint8)
            x, _, _ = normal_form(raw, np.array([0, len(raw)]))
            x = np.frombuffer(bytes(x).strip(), np.uint8)
            if len(x) >= q:
                self.ids.append(item)
                self.text.append(x)
            elif len(x):
                self.short.append((item, bytes(x)))
        both = [budget(len(x), q, rate) for x in self.text]
        self.k = np.array([b[0] for b in both], np.int64)
        self.shared = np.array([b[1] for b in both], np.int64)
        self.size = np.array([len(x) for x in self.text], np.int64)
        g = [grams(x, q) for x in self.text]
        flat = np.concatenate(g) if g else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(g)), [len(v) for v in g]) if g else np.zeros(0, np.int64)
        pos = np.concatenate([np.arange(len(v)) for v in g]) if g else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.item, self.pos = item[order], pos[order]
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.seen = np.zeros(1 << _TABLE_BITS, bool)
        self.seen[_slot(self.keys)] = True
        # An alignment has at least `shared` hits among at most size + k gram starts, so of
        # the stretches of `reach` starts that tile them one has its share.
        self.reach = int(min(64, (self.size + self.k).min())) if len(self.ids) else 1
        tiles = -(-(self.size + self.k) // self.reach)
        self.dense = int((-(-self.shared // tiles)).min()) if len(self.ids) else 1

    def hits(self, x: np.ndarray) -> np.ndarray:
        """Positions whose q-gram is some item's, in neighbourhoods dense enough."""
        g = grams(x, self.q)
        if not len(g) or not len(self.ids):
            return np.zeros(0, np.int64), g
        hit = self.seen[_slot(g)]
        n, reach = len(hit), self.reach
        total = np.zeros(n + reach + 1, np.int32)
        np.cumsum(hit, out=total[1:n + 1])
        total[n + 1:] = total[n]
        full = (total[reach:n + reach] - total[:n]) >= self.dense
        if not full.any():
            return np.zeros(0, np.int64), g
        # All within the longest alignment of such a stretch stay.
        far = int((self.size + 2 * self.k).max()) + reach
        near = np.zeros(n + 2 * far + 1, np.int32)
        np.cumsum(full, out=near[far + 1:far + n + 1])
        near[far + n + 1:] = near[far + n]
        at = np.flatnonzero(hit & (near[2 * far + 1:] > near[:n]))
        slot = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        return at[self.keys[slot] == g[at]], g

    @property
    def docs(self) -> int:
        """Documents that may be searched at once: the keys of regions() stay in 63 bits."""
        return max(1, (1 << 28) // max(1, len(self.ids)))

    def regions(self, x: np.ndarray, off: np.ndarray):
        """(document, item, diagonal of the band's start) of bands that reach the bound."""
        at, g = self.hits(x)
        if not len(at):
            return np.zeros((0, 3), np.int64)
        slot = np.searchsorted(self.keys, g[at])
        n = self.first[slot + 1] - self.first[slot]
        entry = np.repeat(self.first[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        at = np.repeat(at, n)
        item = self.item[entry]
        doc = np.searchsorted(off, at, side="right") - 1
        diagonal = at - self.pos[entry] - off[doc] + self.size[item]  # not negative
        half = self.k[item] + 1
        found = []
        for shift in (0, 1):
            band = (diagonal + shift * half) // (2 * half)
            key = (doc * len(self.ids) + item) * (1 << 34) + band
            uniq, count = np.unique(key, return_counts=True)
            pair, band = uniq >> 34, uniq & ((1 << 34) - 1)
            item_, doc_ = pair % len(self.ids), pair // len(self.ids)
            ok = count >= self.shared[item_]
            start = band * 2 * (self.k[item_] + 1) - shift * (self.k[item_] + 1) - self.size[item_]
            found.append(np.stack([doc_, item_, start], 1)[ok])
        return np.concatenate(found)


def banded_alignment(a: np.ndarray, text: np.ndarray, start: int, width: int, k: int):
    """Least edits between ``a`` and a stretch of ``text`` whose path stays on the
    diagonals start - k .. start + width + k, as (edits, from, to), or None above k.

    Row i of the table holds the cells of these diagonals; cell j of row i is text
    position i + low + j. Only numpy work along the band, a step a byte of ``a``.
    """
    low, w = start - k, width + 2 * k + 1
    big = len(a) + 1
    cols = np.arange(w)
    pos = low + cols
    cost = np.where((pos >= 0) & (pos <= len(text)), 0, big).astype(np.int64)
    origin = pos.copy()
    drop, after = np.full(w, big + 1), np.zeros(w, np.int64)
    padded = np.zeros(len(a) + w + 2, np.uint8)  # text bytes at low .. low + len(a) + w
    lo, hi = max(low, 0), min(low + len(a) + w, len(text))
    if lo < hi:
        padded[lo - low:hi - low] = text[lo:hi]
    for i in range(1, len(a) + 1):
        here = padded[i - 1:i - 1 + w]  # the text byte that the diagonal step consumes
        step = cost + (here != a[i - 1])
        come = origin
        drop[:-1] = cost[1:] + 1  # a's byte is left out
        better = drop < step
        step = np.where(better, drop, step)
        after[:-1] = origin[1:]
        come = np.where(better, after, come)
        valid = (pos + i >= 0) & (pos + i <= len(text))
        step = np.where(valid, step, big)
        # Left-out text bytes: a running minimum of step - column.
        slope = step - cols
        run = np.minimum.accumulate(slope)
        source = np.maximum.accumulate(np.where(slope == run, cols, 0))
        cost = np.where(valid, run + cols, big)
        origin = come[source]
        if cost.min() > k:
            return None
    j = int(np.argmin(cost))
    return (int(cost[j]), int(origin[j]), int(low + j + len(a))) if cost[j] <= k else None


def search(items: Items, x: np.ndarray, off: np.ndarray):
    """Verified (document, item, from, to, edits) in normal-form positions of x."""
    out = []
    best: dict[tuple[int, int], list] = {}
    for doc, item, start in items.regions(x, off):
        text, a, k = x[off[doc]:off[doc + 1]], items.text[item], int(items.k[item])
        low = max(int(start) - k, 0)
        at = bytes(text[low:int(start) + 3 * k + 2 + len(a)]).find(bytes(a))
        if at >= 0:  # the alignment without edits needs no table
            got = (0, low + at, low + at + len(a))
        else:
            got = banded_alignment(a, text, int(start), 2 * (k + 1), k)
        if got:
            best.setdefault((int(doc), int(item)), []).append(got)
    for (doc, item), found in best.items():
        end = -1
        for edits, a, b in sorted(found, key=lambda f: (f[1], f[0])):
            if a < end:  # the same stretch, seen from the other band
                if edits < out[-1][4]:
                    out[-1] = (doc, items.ids[item], off[doc] + a, off[doc] + b, edits)
                    end = b
                continue
            out.append((doc, items.ids[item], off[doc] + a, off[doc] + b, edits))
            end = b
    for doc in range(len(off) - 1) if items.short else ():
        text = b" " + bytes(x[off[doc]:off[doc + 1]]) + b" "
        for item, short in items.short:
            at = text.find(b" " + short + b" ")
            while at >= 0:
                out.append((doc, item, off[doc] + at, off[doc] + at + len(short), 0))
                at = text.find(b" " + short + b" ", at + 1)
    return out


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The items in blocks; the driver holds one block at a time."""
    rows, size = [], 0
    for r in benchmark.where("text is not null").orderBy("doc_id").toLocalIterator():
        rows.append((r["doc_id"], r["text"]))
        size += len(r["text"])
        if size >= block_bytes:
            yield rows
            rows, size = [], 0
    yield rows


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text", q: int = Q, rate: float = RATE,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start, end, edits): a row per stretch of a document that holds
    an item; start and end are code points of the text, end exclusive."""
    docs = two_columns(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    items = two_columns(benchmark, item_col, item_text_col)
    item_kind = items.schema["doc_id"].dataType

    def one(rows):
        def run(batches):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_type

            index = Items(rows, q, rate)
            for b in batches:
                data, offsets = text_bytes(b.column(1))
                found = []
                for lo, hi in slices(offsets, docs=index.docs):
                    part = data[offsets[lo]:offsets[hi]]
                    local = offsets[lo:hi + 1] - offsets[lo]
                    x, off, kept = normal_form(part, local)
                    for doc, item, start, end, edits in search(index, x, off):
                        raw = part[local[doc]:local[doc + 1]]
                        source = np.flatnonzero(kept[local[doc]:local[doc + 1]])
                        a, z = source[start - off[doc]], source[end - 1 - off[doc]] + 1
                        points = (raw & 0xC0) != 0x80  # first bytes of code points
                        found.append((lo + doc, item, int(points[:a].sum()), int(points[:z].sum()), edits))
                cols = list(zip(*found, strict=True)) if found else [()] * 5
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], to_arrow_type(item_kind)),
                    pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32()),
                ], ["doc_id", "item_id", "start", "end", "edits"])
        return docs.mapInArrow(run, f"doc_id {kind}, item_id {item_kind.simpleString()}, start bigint, end bigint, "
                                    "edits int")

    return reduce(DataFrame.unionAll, [one(rows) for rows in _blocks(items, block_bytes)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", q: int = Q, rate: float = RATE,
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, all columns, without the rows that hold a benchmark item."""
    def clean(rows):
        def keep():
            index = Items(rows, q, rate)

            def wanted(texts):
                data, offsets = text_bytes(texts)
                out = np.ones(len(texts), bool)
                for lo, hi in slices(offsets, docs=index.docs):
                    x, off, _ = normal_form(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                    out[[lo + f[0] for f in search(index, x, off)]] = False
                return out
            return wanted
        return keep
    for rows in _blocks(two_columns(benchmark, item_col, item_text_col), block_bytes):
        docs = filter_rows(docs, text_col, clean(rows))
    return docs


@register("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "end", F.col("edits").cast("long").alias("edits"))
