"""Pre-tokens of byte-level BPE tokenizers, found for a whole Arrow batch at once.

The tokenizer file's text (never copied into the repository) is read on the driver and
shipped; the library builds its tokenizer from it once in a worker process. Its
byte-level rule cuts a text into runs of letters, of digits and of other characters, each
with one space before it, into white space, and into English contractions. Which kind a
character is of is asked of the library, once a character.
"""

from __future__ import annotations

import hashlib
import os
import sys
import types

import numpy as np

from .common import mix

_U = np.uint64
_LETTER, _DIGIT, _OTHER, _BLANK, _UNKNOWN = range(5)
KEPT_PRETOKENS = 300_000   # in a worker's cache
LONGEST_KEPT = 64          # bytes; longer pre-tokens are encoded each time
KEY_BYTES = 16             # pre-tokens up to this size have an exact key
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


class PreTokenizer:
    """The library's tokenizer of one file with a vectorised form of its splitting."""

    def __init__(self, source: str, specials: bool):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(source)
        pre = spec.get("pre_tokenizer") or {}
        if (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) != ("ByteLevel", False, True) \
                or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files without normaliser and added prefix space")
        added = [t for t in spec.get("added_tokens", [])]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens that take white space or whole words only are not supported")
        self.tok = Tokenizer.from_str(source)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = not specials
        self.special = [t["content"].encode() for t in added] if specials else []
        self.kind = np.full(0x110000, _UNKNOWN, np.uint8)
        self.kind[:128] = [self._ask(chr(c)) for c in range(128)]
        self.counts: dict[bytes, int] = {}
        self.ids: dict[bytes, bytes] = {}

    def _ask(self, c: str) -> int:
        for kind, start in ((_LETTER, "a"), (_DIGIT, "1"), (_OTHER, "!")):
            if len(self.tok.pre_tokenizer.pre_tokenize_str(start + c)) == 1:
                return kind
        return _BLANK

    def kinds(self, data: np.ndarray) -> np.ndarray:
        """Kind of the character that each byte belongs to."""
        out = self.kind[data]
        high = np.flatnonzero(data >= 128)
        if not len(high):
            return out
        lead = high[data[high] >= 0xC0]
        b = np.concatenate([data, np.zeros(3, np.uint8)])
        first, second, third, fourth = (b[lead + i].astype(np.int64) for i in range(4))
        second, third, fourth = second & 63, third & 63, fourth & 63
        code = np.where(first < 0xE0, (first & 31) << 6 | second,
                        np.where(first < 0xF0, (first & 15) << 12 | second << 6 | third,
                                 (first & 7) << 18 | second << 12 | third << 6 | fourth))
        for c in np.unique(code[self.kind[code] == _UNKNOWN]).tolist():
            self.kind[c] = self._ask(chr(c))
        out[lead] = self.kind[code]
        rest = high[data[high] < 0xC0]
        at = rest - 1
        for _ in range(2):
            at = np.where((data[at] & 0xC0) == 0x80, at - 1, at)
        out[rest] = out[at]
        return out

    def split(self, data: np.ndarray, offsets: np.ndarray):
        """(start, end, first): byte spans of the pre-tokens, and per text its first one."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        edges, held = offsets[offsets < n], []
        if self.special:
            held = self._special_spans(data, offsets)
            edges = np.concatenate([edges, [x for x in sum(held, ()) if x < n]]).astype(np.int64)
        kind = self.kinds(data)
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = kind[1:] != kind[:-1]
        edge = np.zeros(n + 1, bool)
        edge[edges] = edge[n] = True
        new |= edge[:-1]
        # White space before something else gives up its last character: a space joins
        # what follows, any other stands alone.
        after = np.flatnonzero(new & ~edge[:-1])
        after = after[(kind[after - 1] == _BLANK) & (kind[after] != _BLANK)]
        last = after - 1
        for _ in range(3):
            last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
        new[last] = True
        new[after[data[last] == 32]] = False
        # Contractions: an apostrophe that starts a pre-token, and the letters after it.
        quote = np.flatnonzero((data == 39) & new)
        quote = quote[quote + 1 < n]
        b = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two = b[quote + 1], b[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & ~edge[quote + 1]
        longer = (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
        longer &= ~edge[quote + 1] & ~edge[np.minimum(quote + 2, n)]
        for found, size in ((quote[short], 2), (quote[longer], 3)):
            new[found + 1] = False
            stop = found + size
            new[stop[stop < n]] = True
        for a, z in held:
            new[a + 1:z] = False
        start = np.flatnonzero(new)
        return start, np.append(start[1:], n), np.searchsorted(start, offsets)

    def _special_spans(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        import re

        raw = data.tobytes()
        if not any(s in raw for s in self.special):
            return []
        find = re.compile(b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        return [m.span() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
                for m in find.finditer(raw, a, z)]

    def encode_each(self, pretokens: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(pretokens), 10_000):
            part = [p.decode() for p in pretokens[i:i + 10_000]]
            out += [e.ids for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def lengths(self, pretokens: list[bytes]) -> np.ndarray:
        """Number of tokens of each, through the worker's cache."""
        got = [self.counts.get(p) for p in pretokens]
        missing = [i for i, x in enumerate(got) if x is None]
        if missing:
            new = list({pretokens[i] for i in missing})
            found = {p: len(x) for p, x in zip(new, self.encode_each(new), strict=True)}
            for i in missing:
                got[i] = found[pretokens[i]]
            if len(self.counts) + len(found) > KEPT_PRETOKENS:
                self.counts.clear()
            self.counts.update((p, x) for p, x in list(found.items())[:KEPT_PRETOKENS] if len(p) <= LONGEST_KEPT)
        return np.array(got, np.int64)

    def token_ids(self, data: np.ndarray, offsets: np.ndarray):
        """(ids, offsets of ids) of some texts; each different pre-token is encoded once."""
        start, end, first = self.split(data, offsets)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        size = end - start
        k1, k2 = keys(data, start, size)
        short = size <= KEY_BYTES
        _, at, which = np.unique(np.where(short, slot_hash(k1, k2, size), _U(0)), return_index=True, return_inverse=True)
        same = (k1 == k1[at][which]) & (k2 == k2[at][which]) & (size == size[at][which]) & short
        # Long ones, and those whose hash belongs to another, go one by one.
        single = np.flatnonzero(~same)
        picked = np.concatenate([at, single])
        which[single] = len(at) + np.arange(len(single))
        raw = data.tobytes()
        parts = self._parts([raw[s:e] for s, e in zip(start[picked].tolist(), end[picked].tolist(), strict=True)])
        n = np.array([len(p) for p in parts], np.int64) // 4
        flat, begin = np.frombuffer(b"".join(parts), np.int32).astype(np.int64), np.cumsum(n) - n
        total = np.concatenate([[0], np.cumsum(n[which])])
        ids = flat[np.repeat(begin[which] - total[:-1], n[which]) + np.arange(total[-1])]
        return ids, total[first]

    def _parts(self, pretokens: list[bytes]) -> list[bytes]:
        """The ids of each, four bytes an id, through the worker's cache."""
        new = list({p for p in pretokens if p not in self.ids})
        found = dict(zip(new, (np.array(x, np.int32).tobytes() for x in self.encode_each(new)), strict=True))
        out = [self.ids[p] if p in self.ids else found[p] for p in pretokens]
        if len(self.ids) + len(found) > KEPT_PRETOKENS:
            self.ids.clear()
        self.ids.update((p, x) for p, x in list(found.items())[:KEPT_PRETOKENS] if len(p) <= LONGEST_KEPT)
        return out


def keys(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes of each span as two integers, zeros after its end."""
    padded = np.concatenate([data, np.zeros(KEY_BYTES, np.uint8)])
    eight = np.ndarray(len(data) + 9, dtype="<u8", buffer=padded, strides=(1,))
    return (eight[start] & _MASK[np.minimum(size, 8)],
            eight[start + 8 * (size > 8)] & _MASK[np.clip(size - 8, 0, 8)])


def slot_hash(k1: np.ndarray, k2: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(k1 ^ mix(k2 + size.astype(np.uint64) * _U(0x9E3779B97F4A7C55)))


def kept(name: str, make):
    """One object a worker process, shared by the tasks that follow each other in it."""
    held = sys.modules.setdefault("_kept_pretokens", types.ModuleType("_kept_pretokens")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def kept_pretokenizer(source: str, specials: bool = True) -> PreTokenizer:
    digest = hashlib.sha256(source.encode()).hexdigest()
    return kept(f"{digest}-{specials}", lambda: PreTokenizer(source, specials))
