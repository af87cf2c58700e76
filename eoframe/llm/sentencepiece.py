"""SentencePiece encoding and decoding.

The model file (a path, never copied) gives pieces, scores and the model's kind. An
Aho-Corasick automaton over the pieces reads a text once; at each position its output
links list the pieces that end there, longest first, and each relaxes the best score of
that position:

* unigram models: the sum of the pieces' scores;
* BPE models: the only segmentation that the merges produce. A piece may follow
  another only when merging the two together leaves the border between them, so at each
  position at most one piece, with the last piece of the prefix before it, has a finite
  score. Summed scores of a BPE file would give other ids than the model was made with.

BPE files give the ids that the library gives for them, unigram files those of the best
entry of its n-best list.

Pieces hold the space mark only at their start, so a text falls apart at spaces, and
between characters that stand together in no piece. Those parts repeat: a batch encodes each
different part once, and parts seen before are kept in a bounded table. Characters
without a piece become their UTF-8 bytes' pieces, or the unknown id where the model has
no byte pieces.

Null and empty texts have no ids; a null text decodes to an empty one. Repeated rows are
each encoded; an empty table gives an empty result; other columns are ignored. Texts of
any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import sys
import types
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, slices, table, text_bytes, two_columns, word_hashes
from .registry import register

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
KEPT_PARTS = 400_000   # parts kept by a task

_UNIGRAM, _BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of a protobuf message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out
    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7)
            n = varint() if n is None else n
            yield key >> 3, data[at:at + n]
            at += n


@dataclass
class Model:
    """What encoding needs of a model file."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]        # 1 normal, 2 unknown, 3 control, 4 user, 5 unused, 6 byte
    model_type: int = _UNIGRAM
    dummy_prefix: bool = True
    squeeze: bool = True
    digest: str = ""        # of the file

    @classmethod
    def load(cls, path: str) -> Model:
        import struct

        with open(path, "rb") as f:
            data = f.read()
        m = cls([], [], [], digest=hashlib.sha256(data).hexdigest())
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                m.pieces.append(piece.get(1, b"").decode())
                m.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                m.kinds.append(piece.get(3, 1))
            elif number == 2:
                m.model_type = dict(_fields(value)).get(3, _UNIGRAM)
            elif number == 3:
                norm = dict(_fields(value))
                if norm.get(2):
                    raise ValueError("models with a character map are not supported")
                m.dummy_prefix, m.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        if m.model_type not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models")
        if any(SPACE in p.lstrip(SPACE) for p, k in zip(m.pieces, m.kinds, strict=True) if k in (1, 4)):
            raise ValueError("pieces that hold a space after a letter are not supported")
        return m


class Merges:
    """The merges of a BPE model: which pieces they can produce, from which two parts, and
    which borders they leave alone."""

    def __init__(self, model: Model):
        normal = [i for i, k in enumerate(model.kinds) if k in (1, 4)]
        self.id = {model.pieces[i]: i for i in normal}
        order = sorted((i for i in normal if len(model.pieces[i]) > 1), key=lambda i: -model.scores[i])
        self.rank = dict.fromkeys(normal, -1) | {i: n for n, i in enumerate(order)}
        self.pieces, self.parts, self.memo = model.pieces, {}, {}
        for i in normal:
            symbols = self._merge(self.pieces[i], stop=2)
            if len(symbols) == 2 and all(s in self.id for s in symbols):
                self.parts[i] = (self.id[symbols[0]], self.id[symbols[1]])
        # Pieces that merging their own characters does not give back are never produced.
        self.produced = {i for i in normal if len(self.pieces[i]) == 1
                         or (i in self.parts and len(self._merge(self.pieces[i])) == 1)}

    def _merge(self, text: str, stop: int = 1) -> list[str]:
        s = list(text)
        while len(s) > stop:
            best, at = None, -1
            for j in range(len(s) - 1):
                i = self.id.get(s[j] + s[j + 1])
                if i is not None and (best is None or self.rank[i] < best):
                    best, at = self.rank[i], j
            if best is None:
                break
            s[at:at + 2] = [s[at] + s[at + 1]]
        return s

    def border(self, a: int, b: int) -> bool:
        """Do a and b stay apart when their characters stand together? The merges that
        made them are undone from the last one; at no moment may the two symbols at the
        border have had an earlier merge open."""
        got = self.memo.get((a, b))
        if got is not None:
            return got
        x, y, limit, ok = a, b, float("inf"), True
        while True:
            i = self.id.get(self.pieces[x] + self.pieces[y])
            if i is not None and self.rank[i] < limit:
                ok = False
                break
            if self.rank[x] > self.rank[y]:
                limit, x = self.rank[x], self.parts[x][1]
            elif self.rank[y] >= 0:
                limit, y = self.rank[y] + 1, self.parts[y][0]  # equal merges go left first
            else:
                break
        if len(self.memo) < 2_000_000:
            self.memo[a, b] = ok
        return ok


class Encoder:
    """Encodes and decodes in a task."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.unk = next((i for i, k in enumerate(model.kinds) if k == 2), 0)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == 6}
        self.merges = Merges(model) if model.model_type == _BPE else None
        usable = [i for i, k in enumerate(model.kinds) if k in (1, 4)]
        if self.merges:
            usable = [i for i in usable if i in self.merges.produced]
        self.find = ahocorasick.Automaton()
        joined, self.single = np.ones((256, 256), bool), set()
        joined[:128, :128] = False
        for i in usable:
            p = model.pieces[i]
            self.find.add_word(p, (len(p), i))
            if len(p) == 1:
                self.single.add(p)
            for a, b in zip(p, p[1:]):
                if a < "\x80" and b < "\x80":
                    joined[ord(a), ord(b)] = True
                elif a == SPACE and b < "\x80":
                    joined[32, ord(b)] = True
        joined[32, 32] = True
        self.find.make_automaton()
        self.unk_score = min((model.scores[i] for i in usable), default=0.0) - 10.0
        #: Of two bytes in a row: may a piece hold both? (Spaces stand for their mark.)
        self.joined = joined.ravel()
        self.seen: dict[bytes, np.ndarray] = {}
        flat = [self._bytes_of(i) for i in range(len(model.pieces))]
        self.piece_end = np.cumsum([0, *map(len, flat)])
        self.piece_bytes = np.frombuffer(b"".join(flat), np.uint8)

    def _bytes_of(self, i: int) -> bytes:
        kind, piece = self.model.kinds[i], self.model.pieces[i]
        if kind == 6:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == 3 else b" \xe2\x81\x87 " if kind == 2 else piece.replace(SPACE, " ").encode()

    def _unknown(self, c: str) -> list[int]:
        return [self.byte[b] for b in c.encode()] if self.byte else [self.unk]

    def viterbi(self, text: str) -> list[int]:
        """Ids of one part, with its spaces as marks."""
        n, scores = len(text), self.model.scores
        last_id, back = [-1] * (n + 1), [0] * (n + 1)
        if self.merges:
            # The automaton gives the pieces that end at a position longest first.
            reached, border, memo, single = [True] + [False] * n, self.merges.border, self.merges.memo, self.single
            for last, (size, i) in self.find.iter(text):
                p = last + 1
                if reached[p]:
                    continue
                s = p - size
                if not reached[s]:
                    for q in range(s, 0, -1):  # a character without a piece before it
                        if reached[q]:
                            break
                    for q in range(q + 1 if reached[q] else 1, s + 1):
                        if not reached[q] and reached[q - 1] and text[q - 1] not in single:
                            reached[q], back[q] = True, q - 1
                    if not reached[s]:
                        continue
                before = last_id[s]
                if before >= 0:
                    ok = memo.get((before, i))
                    if not (border(before, i) if ok is None else ok):
                        continue
                reached[p], last_id[p], back[p] = True, i, s
            for q in range(1, n + 1):
                if not reached[q]:
                    reached[q], back[q] = True, q - 1
        else:
            low = float("-inf")
            best = [0.0] + [low] * n
            ends: list[list] = [[] for _ in range(n + 1)]
            for last, found in self.find.iter(text):
                ends[last + 1].append(found)
            for p in range(1, n + 1):
                for size, i in ends[p]:
                    got = best[p - size] + scores[i]
                    if got > best[p]:
                        best[p], last_id[p], back[p] = got, i, p - size
                if text[p - 1] not in self.single and best[p - 1] + self.unk_score > best[p]:
                    best[p], last_id[p], back[p] = best[p - 1] + self.unk_score, -1, p - 1
        out, p = [], n
        while p > 0:
            s = back[p]
            out.append([last_id[p]] if last_id[p] >= 0 else self._unknown(text[s:p]))
            p = s
        ids = [i for part in reversed(out) for i in part]
        if not self.byte:  # neighbouring unknown characters are one id
            ids = [i for j, i in enumerate(ids) if i != self.unk or j == 0 or ids[j - 1] != self.unk]
        return ids

    def part(self, raw: bytes) -> np.ndarray:
        got = self.seen.get(raw)
        if got is None:
            got = np.array(self.viterbi(raw.decode("utf-8", "replace").replace(" ", SPACE)), np.int32)
            if len(self.seen) >= KEPT_PARTS:
                self.seen.clear()
            self.seen[raw] = got
        return got

    def prepared(self, data: np.ndarray, offsets: np.ndarray):
        """Texts as the model wants them: a space before each (the dummy prefix); spaces
        squeezed where the model does that."""
        if self.model.squeeze:
            texts = [b" ".join(x for x in bytes(data[a:b]).split(b" ") if x)
                     for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            data = np.frombuffer(b"".join(texts), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        mark = SPACE.encode()
        if mark in data.tobytes():  # a mark in the text itself is a space to the model
            texts = [bytes(data[a:b]).replace(mark, b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            data = np.frombuffer(b"".join(texts), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        n = np.diff(offsets)
        if not self.model.dummy_prefix:
            return data, offsets
        first = offsets[:-1][n > 0]
        return np.insert(data, first, 32), offsets + np.concatenate([[0], np.cumsum(n > 0)])

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """(ids, offsets of ids) of some texts."""
        data, offsets = self.prepared(data, offsets)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        pair = data[:-1].astype(np.uint16)
        pair <<= np.uint16(8)
        pair |= data[1:]
        new = np.ones(len(data), bool)
        new[1:] = ~self.joined[pair] | ((data[1:] == 32) & (data[:-1] != 32))
        edges = offsets[:-1]
        new[edges[edges < len(data)]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(data))
        first = np.searchsorted(start, offsets)
        h = word_hashes(Words(data, start, end, first, offsets))
        _, at, which = np.unique(h, return_index=True, return_inverse=True)
        raw = data.tobytes()
        parts = [self.part(raw[s:e]) for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        size = np.array([len(p) for p in parts], np.int64)
        flat, begin = np.concatenate(parts), np.cumsum(size) - size
        n = size[which]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(begin[which] - total[:-1], n) + np.arange(total[-1])]
        return ids, total[first]

    def decode(self, ids: np.ndarray, offsets: np.ndarray):
        """(bytes, offsets) of the texts of some id lists; the dummy prefix goes."""
        n = (self.piece_end[1:] - self.piece_end[:-1])[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        data = self.piece_bytes[np.repeat(self.piece_end[ids] - total[:-1], n) + np.arange(total[-1])]
        ends = total[offsets]
        if self.model.dummy_prefix:
            first = ends[:-1][np.diff(ends) > 0]
            first = first[data[first] == 32]
            gone = np.zeros(len(data) + 1, np.int64)
            gone[first + 1] = 1
            data = np.delete(data, first)
            ends = ends - np.cumsum(gone)[ends]
        return data, ends


def kept_encoder(model: Model) -> Encoder:
    """This worker process's encoder of the model: tasks that follow each other in one
    process share the merges and the parts seen so far (at most KEPT_PARTS)."""
    held = sys.modules.setdefault("_kept_sentencepiece", types.ModuleType("_kept_sentencepiece")).__dict__
    if held.get("digest") != model.digest:
        held.update(digest=model.digest, encoder=Encoder(model))
    return held["encoder"]


def encode(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) per row; round_trip: decoding gives the text."""
    model = Model.load(model_path)  # some hundred kB, whatever the data
    docs = two_columns(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        enc = kept_encoder(model)
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for lo, hi in slices(offsets):
                part, local = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
                ids, ends = enc.encode(part, local)
                back, back_ends = enc.decode(ids, ends)
                same = np.diff(back_ends) == np.diff(local)
                if len(back) == len(part) and same.all():
                    wrong = np.concatenate([[0], np.cumsum(back != part)])[local]
                    same = np.diff(wrong) == 0
                else:
                    same &= np.array([bytes(back[a:z]) == bytes(part[c:d]) for a, z, c, d in
                                      zip(back_ends[:-1], back_ends[1:], local[:-1], local[1:], strict=True)], bool)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)),
                    pa.array(np.diff(ends)), pa.array(same),
                ], ["doc_id", "ids", "n_tokens", "round_trip"])
    return docs.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens bigint, round_trip boolean")


def decode(tokens: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of id lists; bytes that are no UTF-8 become replacement characters."""
    model = Model.load(model_path)
    tokens = tokens.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        enc = kept_encoder(model)
        for b in batches:
            lists = b.column(1)
            sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            data, ends = enc.decode(ids, np.concatenate([[0], np.cumsum(sizes)]))
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([bytes(data[a:z]).decode("utf-8", "replace")
                                       for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.string())], ["doc_id", "text"])
    return tokens.mapInArrow(run, f"doc_id {kind}, text string")


@register("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
