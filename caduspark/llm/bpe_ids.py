"""Token ids of whole texts by a byte-level BPE of a tokenizers file, a word at a time.

Byte-level BPE never merges across its pre-tokens, and a pre-token never crosses the border between white
space and the next word, but for one space before the word.  So a text is cut into such units with numpy;
each distinct unit is encoded once and kept in a bounded cache.  Texts with white space beyond
ASCII, and files of another kind, are encoded whole by the tokenizers library.  Tests hold the ids against
tokenizers on whole texts.
"""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa

from caduspark.llm import textnum

_ODD_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Units kept in the cache of one Python worker (some 50 bytes each).
CACHE = 1_000_000
PIECE = 2 << 20


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE writes each byte as one printable letter."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    spare = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + i): b for i, b in enumerate(spare)}


class Encoder:
    def __init__(self, path: str):
        self.path, self.core = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and model["type"] == "BPE":
            letters = _byte_letters()
            ranks = {}
            special = {t["content"] for t in spec.get("added_tokens", [])}
            for token, i in model["vocab"].items():
                if token not in special and all(c in letters for c in token):
                    ranks[bytes(letters[c] for c in token)] = i
            pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            order = [model["vocab"][a + b] for a, b in pairs]
            if order == sorted(order) and all(bytes([b]) in ranks for b in range(256)):
                import tiktoken

                pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
                self.core = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._clear()

    @cached_property
    def whole(self):
        """The library's own tokenizer; some 30 MB, so it is read only where a text needs it."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = True
        return out

    def _clear(self) -> None:
        """The cache: sorted unit hashes, the entry of each, and each entry's ids in one pool."""
        self.keys, self.entries = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.sizes, self.pool, self.filled = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, np.uint32), 0

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        """Entries of sorted hashes; -1 for new ones."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int64)
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[place] == hashes, self.entries[place], -1)

    def _ids(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after another, ids of each)."""
        ids = [self.core.encode_ordinary(u.decode("utf-8", "replace")) for u in units]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        return np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum())), sizes

    def _add(self, hashes: np.ndarray, units: list[bytes]) -> np.ndarray:
        """Entries of new units."""
        k, n = len(self.keys), len(hashes)
        flat, sizes = self._ids(units)
        total = len(flat)
        while k + n > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts] * 2), np.concatenate([self.sizes] * 2)
        while self.filled + total > len(self.pool):
            self.pool = np.concatenate([self.pool] * 2)
        self.pool[self.filled : self.filled + total] = flat
        self.sizes[k : k + n] = sizes
        self.starts[k : k + n] = self.filled + np.cumsum(sizes) - sizes
        self.filled += total
        entries = np.arange(k, k + n)
        keys = np.concatenate([self.keys, hashes])
        order = np.argsort(keys, kind="stable")  # merges two sorted runs
        self.keys, self.entries = keys[order], np.concatenate([self.entries, entries])[order]
        return entries

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, textnum.Words]:
        words = textnum.Words(data, offsets)
        n = np.diff(words.first)
        text = np.repeat(np.arange(len(n)), n)
        before = np.concatenate([[0], words.end])[:-1]
        head = np.zeros(len(text), bool)
        head[words.first[:-1][n > 0]] = True
        before = np.where(head, offsets[text], before)
        spaced = (words.start > before) & (data[np.maximum(words.start - 1, 0)] == 0x20)
        begin = words.start - spaced
        gap = begin - before
        one = np.flatnonzero(~spaced & (gap > 1))  # the last white space stands alone
        some = np.flatnonzero(gap > 0)
        some_end = begin[some] - (~spaced & (gap > 1))[some]
        tail = np.where(n > 0, np.concatenate([words.end, [0]])[np.maximum(words.first[1:] - 1, 0)], offsets[:-1])
        left = np.flatnonzero(tail < offsets[1:])
        starts = np.concatenate([begin, before[some], begin[one] - 1, tail[left]])
        ends = np.concatenate([words.end, some_end, begin[one], offsets[1:][left]])
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order], words

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids of each text)."""
        raw = data.tobytes()
        if self.core is None or _ODD_SPACE.search(raw):
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
            got = [self.whole.encode(t, add_special_tokens=False).ids for t in texts] if self.core is None else None
            if got is None:
                got = [
                    self.whole.encode(t, add_special_tokens=False).ids if _ODD_SPACE.search(raw[a:b]) else self.core.encode_ordinary(t)
                    for t, a, b in zip(texts, offsets[:-1], offsets[1:])
                ]
            counts = np.array([len(g) for g in got], np.int64)
            return np.fromiter((i for g in got for i in g), np.uint32, int(counts.sum())), counts
        starts, ends, words = self._units(data, offsets)
        return self._gather(raw, starts, ends, words, offsets)

    def _gather(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, words: textnum.Words, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units that cover the texts in order: distinct units are encoded once."""
        hashes = words.of_bytes(starts, ends)
        known, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(known) > CACHE:
            self._clear()
        entry = self._known(known)
        new = np.flatnonzero(entry < 0)
        if len(new):
            entry[new] = self._add(known[new], [raw[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
        place = entry[inverse]
        sizes = self.sizes[place].astype(np.int64)
        total = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.starts[place] - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)]
        unit_of = np.searchsorted(starts, offsets)
        ends_at = np.concatenate([[0], total])
        return ids, ends_at[unit_of[1:]] - ends_at[unit_of[:-1]]


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    return Encoder(path)


def encode_array(path: str, texts: pa.Array):
    """(first row, row after the last, ids, counts) of pieces of a column."""
    for lo, hi, data, offsets in textnum.pieces(texts, PIECE):
        ids, counts = encoder(path).encode(data, offsets)
        yield lo, hi, ids, counts
