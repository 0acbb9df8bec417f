"""Whole texts as numpy arrays: words, word hashes and hashes of word windows, without a loop over words.

A word is a maximal run of bytes other than space and \\t..\\r, i.e. [^\\x20\\x09-\\x0D]+ of the UTF-8 text.
Window hashes are polynomial sums modulo 2**64 over mixed word hashes; equal word sequences always agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything but ASCII letters and digits and the bytes of other characters parts terms.
TERM_SPACE = np.array([not (chr(i).isalnum() or i >= 128) for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Texts are handled in pieces of about this many bytes (a longer text is one piece, hashed slab by slab).
CHUNK = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240501))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or of its inverse."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        step = pow(base, -1, 2**64) if inverse else base
        have = np.ones(size, np.uint64)
        done = 1
        while done < size:
            more = min(done, size - done)
            have[done : done + more] = have[:more] * np.uint64(pow(step, done, 2**64))
            done += more
        if size <= 2 * CHUNK:
            _powers[(base, inverse)] = have
    return have[:n]


def sums(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i, with a leading zero."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def span(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end], the same wherever the values stand."""
    inverse = powers(base, len(prefix), True)
    return mix((prefix[end] - prefix[start]) * inverse[start])


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE[0], slab: int = 2 * CHUNK) -> np.ndarray:
    """Hash of data[start[i]:end[i]] for spans in order of their starts.

    Prefix sums are taken slab by slab, so a text of any length needs eight bytes a byte for one slab only.
    """
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + slab)))
        low, high = int(start[i]), int(end[i:j].max())
        prefix = sums(BYTE[data[low:high]], base)
        out[i:j] = span(prefix, start[i:j] - low, end[i:j] - low, base)
        i = j
    return out


def fold(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals U+00C0..U+00DE in lower case."""
    out = LOWER[data]
    second = np.flatnonzero(data == 0xC3) + 1
    second = second[second < len(data)]
    capital = (data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)
    out[second[capital]] += 32
    return out


def bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word in bytes, and first[i]..first[i+1], the words of text i; space marks the bytes that part words."""
    n = len(data)
    solid = ~space[data]
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    head[inner] = solid[inner]
    tail = solid.copy()
    tail[:-1] &= ~solid[1:]
    before = inner[inner > 0] - 1
    tail[before] = solid[before]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return start, end, np.searchsorted(start, offsets)


class Words:
    """The words of some texts: starts, ends (bytes), hash, and first[i]..first[i+1] the words of text i.

    lower folds ASCII and Latin-1 capitals; space marks the bytes that part words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = SPACE):
        self.data, self.offsets = fold(data) if lower else data, offsets
        self.start, self.end, self.first = bounds(self.data, offsets, space)
        self.hash = spans(self.data, self.start, self.end) + (self.end - self.start).astype(np.uint64)
        self._sums: dict[int, np.ndarray] = {}

    def of_bytes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of bytes start..end-1, in order of their starts."""
        return mix(spans(self.data, start, end) + (end - start).astype(np.uint64))

    def prefix(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(words longer than size bytes, hash of their first size bytes)."""
        which = np.flatnonzero(self.end - self.start > size)
        start = self.start[which]
        return which, mix(spans(self.data, start, start + size) + np.uint64(size << 20))

    def window(self, start: np.ndarray, end: np.ndarray, which: int = 1) -> np.ndarray:
        """Hash of words start..end-1; which picks one of several independent hashes."""
        base = _BASE[1]
        if which not in self._sums:
            self._sums[which] = sums(mix(self.hash + np.uint64(which * 0x632BE59BD9B4E019 % 2**64)), base)
        return span(self._sums[which], start, end, base)


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of about size bytes; null is an empty text."""
    yield from pieces(batch.column(batch.schema.get_field_index(column)), size)


def pieces(text: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As chunks, of one string or binary column."""
    if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type):
        kind = np.int64
    else:
        kind = np.int32
    if not len(text):
        return
    buffers = text.buffers()
    offsets = np.frombuffer(buffers[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    if text.null_count:
        lengths = np.where(np.asarray(text.is_valid()), lengths, 0)
        if int(lengths.sum()) != offsets[-1] - offsets[0]:  # nulls with bytes behind them: compact first
            data = np.concatenate([data[a : a + k] for a, k in zip(offsets[:-1], lengths)] or [data[:0]])
            offsets = np.concatenate([[0], np.cumsum(lengths)])
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, len(text))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """values cut into lists of the given lengths."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))
