"""Hits and redactions of a whole Arrow batch of texts, with the spans that finditer() of the patterns would give.

Texts are joined by a character that no pattern can match.  Masks over the characters leave the few places where a pattern
may begin, and only there the pattern itself is tried, in order and never inside its last match.  Work is done on slices of
bounded length.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from caduspark.functions import detect, fixed, redact

KINDS = [kind for kind, *_ in fixed.PATTERNS]
COMPILED = {kind: re.compile(pattern.replace("(?iu)", ""), re.I if pattern.startswith("(?iu)") else 0) for kind, pattern, *_ in fixed.PATTERNS}
SOURCES = ["regex", "regex+normalized", "regex+base64", "custom"]
_HIT = pa.struct([("phi_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("confidence", pa.float64()), ("source", pa.string())])
_CONFIDENCE = np.array([c for _, _, c, _ in fixed.PATTERNS])

#: Between texts: not in any pattern's classes, no word character, and it ends a URL.
_BETWEEN = "<"
_PAD = 16
#: Characters of the texts that one pass looks at.
_SLICE = 1 << 18

# Characters beyond ASCII stand for one of four kinds: word, digit, space, other.
_PROXY = np.zeros(0x110000, np.uint8)
_PROXY[:128] = np.arange(128)
_known = set(map(chr, range(128)))
_TOKEN = re.compile("[A-Za-z0-9+/]{12,}={0,2}")


def _table(test: Callable[[str], bool], beyond: tuple[int, ...] = ()) -> bytes:
    return bytes(test(chr(i)) if i < 128 else i in beyond for i in range(256))


def _of(chars: str) -> bytes:
    return _table(lambda c: c in chars)


def _alnum(c: str) -> bool:
    return c.isascii() and c.isalnum()


_DIGIT = _table(str.isdecimal, (129,))
_WORD = _table(lambda c: c.isalnum() or c == "_", (128, 129))
_GAP = _table(lambda c: c.isspace() or c in "-.", (130,))
_LOCAL = _table(lambda c: _alnum(c) or c in "._%+-")
_BASE64 = _table(lambda c: _alnum(c) or c in "+/")
_MONTHS = [_of("".join({m[i] for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()})) for i in range(3)]
_DASH_SPACE, _TWO_NINE, _OPENS = _of("- "), _of("23456789"), _of("+1(23456789")


def _padded(text: str) -> bytes:
    if text.isascii():
        codes = text.encode()
    else:
        for c in set(text) - _known:
            _PROXY[ord(c)] = 129 if c.isdecimal() else 128 if c.isalnum() else 130 if c.isspace() else 131
            _known.add(c)
        codes = _PROXY[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].tobytes()
    pad = _BETWEEN.encode() * _PAD
    return pad + codes + pad


def _places(mask: np.ndarray) -> list[int]:
    return np.flatnonzero(mask).tolist()


class _Masks:
    """Masks of one text: mask(k) tells of each place what the character k after it is."""

    def __init__(self, text: str):
        self.n, self.codes = len(text), _padded(text)
        self.x = np.frombuffer(self.codes, np.uint8)
        self.lower = self.x | 32

    def whole(self, table: bytes) -> np.ndarray:
        return np.frombuffer(self.codes.translate(table), np.bool_)

    def shifted(self, mask: np.ndarray) -> Callable[[int], np.ndarray]:
        return lambda k: mask[_PAD + k : _PAD + k + self.n]

    def among(self, table: bytes) -> Callable[[int], np.ndarray]:
        return self.shifted(self.whole(table))

    def letter(self, char: str) -> Callable[[int], np.ndarray]:
        return self.shifted((self.lower if char.isalpha() else self.x) == ord(char))


def _tried(pattern: re.Pattern, text: str, starts: list[int]) -> list[tuple[int, int]]:
    out, end, match = [], 0, pattern.match
    for s in starts:
        if s >= end and (m := match(text, s)):
            end = m.end()
            out.append((s, end))
    return out


def _emails(pattern: re.Pattern, text: str, masks: _Masks, word: np.ndarray) -> list[tuple[int, int]]:
    """A match begins at the first word boundary of the run before an @ that the last match leaves."""
    local = masks.whole(_LOCAL)
    ats = np.flatnonzero((masks.x[_PAD:-_PAD] == 64) & local[_PAD - 1 : -_PAD - 1])
    if not len(ats):
        return []
    others = np.flatnonzero(~local) - _PAD
    runs = others[np.searchsorted(others, ats) - 1] + 1
    edges = np.append(np.flatnonzero(word[1:] != word[:-1]) + 1 - _PAD, masks.n)
    out, end = [], 0
    for at, run in zip(ats.tolist(), edges[np.searchsorted(edges, runs)].tolist()):
        if run < end:
            run = int(edges[np.searchsorted(edges, end)])
        if run < at and (m := pattern.match(text, run)):
            end = m.end()
            out.append((run, end))
    return out


def _found(text: str, kinds: list[str]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(place of the pattern, spans of its matches) of a joined text."""
    masks = _Masks(text)
    word = masks.whole(_WORD)
    w, d = masks.shifted(word), masks.among(_DIGIT)
    fresh, dash, dot = ~w(-1), masks.letter("-"), masks.letter(".")
    head = fresh & d(0)
    for place, kind in enumerate(KINDS):
        if kind not in kinds:
            continue
        pattern = COMPILED[kind]
        if kind == "EMAIL":
            yield place, _emails(pattern, text, masks, word)
            continue
        if kind == "SSN":
            gap = masks.among(_DASH_SPACE)
            starts = _places(head & d(1) & d(2) & gap(3) & d(4) & d(5) & gap(6) & d(7))
        elif kind == "PHONE":
            gap = masks.among(_GAP)
            four = d(0) & d(1) & d(2) & d(3)
            tail = np.zeros(masks.n + 2 * _PAD, bool)
            t = masks.shifted(tail)
            f = np.zeros(masks.n + 2 * _PAD, bool)
            f[_PAD:-_PAD] = four & ~w(4)
            last = masks.shifted(f)
            tail[_PAD:-_PAD] = d(0) & d(1) & d(2) & (last(3) | gap(3) & last(4))
            core = masks.among(_TWO_NINE)(0) & d(1) & d(2) & (t(3) | gap(3) & t(4) | masks.letter(")")(3) & (t(4) | gap(4) & t(5)))
            near = np.unique((np.flatnonzero(core)[:, None] - np.arange(5)).ravel())
            near = near[near >= 0]
            starts = near[(w(0) != w(-1))[near] & masks.among(_OPENS)(0)[near]].tolist()
        elif kind == "IP_ADDRESS":
            starts = _places(head & (dot(1) | dot(2) | dot(3)))
        elif kind == "URL":
            slash = masks.letter("/")
            at = np.flatnonzero(masks.letter(":")(0) & slash(1) & slash(2))
            starts = np.sort(np.concatenate([at - 5, at - 4]))
            starts = starts[starts >= 0].tolist()
        elif kind == "DATE":
            slash, months = masks.letter("/"), [masks.among(t) for t in _MONTHS]
            starts = _places(head & (dash(4) & dash(7) | slash(1) | slash(2)) | fresh & months[0](0) & months[1](1) & months[2](2))
        elif kind == "MRN":
            starts = _places(fresh & masks.letter("m")(0) & (masks.letter("r")(1) & masks.letter("n")(2) | masks.letter("e")(1) & masks.letter("d")(2)))
        elif kind == "NPI":
            starts = _places(fresh & masks.letter("n")(0) & masks.letter("p")(1))
        elif kind == "DEA":
            starts = _places(fresh & masks.letter("d")(0) & masks.letter("e")(1) & masks.letter("a")(2))
        elif kind == "ZIP":
            starts = _places(head & d(4) & dash(5) & d(6))
        else:  # a pattern without a mask of its own is tried everywhere
            starts = range(masks.n)
        yield place, _tried(pattern, text, starts)


@dataclass
class Hits:
    """Hits of a list of texts by column: number of the text, type, span, span of the value, confidence, source."""

    text: np.ndarray
    place: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray
    confidence: np.ndarray
    source: np.ndarray

    def take(self, rows: np.ndarray) -> Hits:
        return Hits(*[getattr(self, f.name)[rows] for f in fields(self)])

    @staticmethod
    def joined(parts: list[Hits]) -> Hits:
        return Hits(*[np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(Hits)])

    def bounds(self, n: int) -> np.ndarray:
        """Where each text's hits begin, if they are in order of the texts."""
        return np.searchsorted(self.text, np.arange(n + 1))


def raw(texts: list[str], kinds: list[str] | None = None) -> Hits:
    """All hits, unmerged; a text's hits are in order of the patterns."""
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    found = list(_found(_BETWEEN.join(texts), KINDS if kinds is None else kinds)) if texts else []
    spans = np.array([s for _, pairs in found for s in pairs], np.int64).reshape(-1, 2)
    place = np.repeat(np.array([p for p, _ in found], np.int64), np.array([len(pairs) for _, pairs in found], np.int64))
    text = np.searchsorted(offsets, spans[:, 0], "right") - 1
    start, end = spans[:, 0] - offsets[text], spans[:, 1] - offsets[text]
    out = Hits(text, place, start, end, start, end, _CONFIDENCE[place], np.zeros(len(place), np.int64))
    return out.take(np.argsort(text, kind="stable"))


def merged(hits: Hits) -> Hits:
    """Each island of overlapping spans becomes one hit: their union, and all else of the surer, else longer, one, from left to right."""
    h = hits.take(np.lexsort((-hits.confidence, hits.start - hits.end, hits.start, hits.text)))
    if not len(h.text):
        return h
    reach = h.end + h.text * (wide := int(h.end.max()) + 1)
    first = np.ones(len(reach), bool)
    first[1:] = (h.start + h.text * wide)[1:] >= np.maximum.accumulate(reach)[:-1]
    heads = np.flatnonzero(first)
    sizes = np.diff(np.append(heads, len(first)))
    out = h.take(heads)
    for i in range(1, int(sizes.max())):
        at = np.flatnonzero(sizes > i)
        new = heads[at] + i
        wins = (h.confidence[new] > out.confidence[at]) | (h.confidence[new] == out.confidence[at]) & (h.end[new] - h.start[new] > out.end[at] - out.start[at])
        for name in ("place", "first", "last", "confidence", "source"):
            getattr(out, name)[at[wins]] = getattr(h, name)[new[wins]]
        out.end[at] = np.maximum(out.end[at], h.end[new])
    return out


def _back(hits: Hits, canon: dict[int, list[tuple[int, int, int, int]]]) -> Hits:
    """Hits of canonical texts as hits of the texts they came from; canon holds the changed pieces of each changed text."""
    bounds = hits.bounds(max(canon, default=-1) + 1)
    for i, pieces in canon.items():
        begins = [p[0] for p in pieces]

        def place(at: int, side: int) -> int:
            j = bisect_right(begins, at) - 1
            if j < 0:
                return at + side
            new, stop, begin, end = pieces[j]
            return (begin, end)[side] if at < stop else at - stop + end + side

        for row in range(bounds[i], bounds[i + 1]):
            hits.start[row], hits.end[row] = place(int(hits.start[row]), 0), place(int(hits.end[row]) - 1, 1)
            hits.first[row], hits.last[row], hits.source[row] = hits.start[row], hits.end[row], 1
    return hits


def _encoded(texts: list[str]) -> Hits:
    """Whole base64 tokens whose decoded text holds identifiers."""
    text = _BETWEEN.join(texts)
    mask = run = _Masks(text).whole(_BASE64)
    for step in (1, 2, 4, 4):  # runs of 2, 4, 8 and 12 characters
        run = run[:-step] & run[step:]
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    tokens, plain = [], []
    for at in _places(run[_PAD : _PAD + len(text)] & ~mask[_PAD - 1 : _PAD - 1 + len(text)]):
        m = _TOKEN.match(text, at)
        if len(m[0]) % 4 or len(m[0]) > 4096:
            continue
        try:
            inner = base64.b64decode(m[0], validate=True).decode()
        except (binascii.Error, UnicodeDecodeError):
            continue
        if inner and inner.isprintable():
            tokens.append(m.span())
            plain.append(inner)
    hits = merged(raw(plain))
    spans = np.array(tokens, np.int64).reshape(-1, 2)[hits.text]
    which = np.searchsorted(offsets, spans[:, 0], "right") - 1
    start, end = spans[:, 0] - offsets[which], spans[:, 1] - offsets[which]
    return Hits(which, hits.place, start, end, start, end, np.minimum(hits.confidence, 0.95), np.full(len(which), 2))


def scanned(texts: list[str], encoded: bool, merge: bool = True) -> Hits:
    """Hits of texts, disguised ones and base64 tokens included; unmerged where others are to join them."""
    plain, canon = list(texts), {}
    for i, t in enumerate(texts):
        if not t.isascii() or "%" in t:
            plain[i], pieces = detect.normal_pieces(t)
            if pieces:
                canon[i] = pieces
    hits = Hits.joined([_back(merged(raw(plain)), canon), *([_encoded(texts)] if encoded else [])])
    return merged(hits) if merge else hits.take(np.argsort(hits.text, kind="stable"))


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    """The texts, nulls as empty ones, in slices of bounded length."""
    part, size = [], 0
    for t in texts.to_pylist():
        part.append(t or "")
        size += len(part[-1])
        if size >= _SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


#: A pattern of one's own: type, Python pattern, confidence.
Own = tuple[str, str, float]


def merged_with(texts: list[str], own: tuple[Own, ...]) -> Hits:
    """Merged hits of the patterns and, after them, of patterns of one's own, whose types are numbered on from KINDS."""
    parts = [raw(texts)]
    for place, (_, pattern, confidence) in enumerate(own, len(KINDS)):
        run = re.compile(pattern)
        found = np.array([(i, *m.span()) for i, t in enumerate(texts) for m in run.finditer(t)], np.int64).reshape(-1, 3)
        i, start, end = found.T
        parts.append(Hits(i, np.full(len(i), place), start, end, start, end, np.full(len(i), float(confidence)), np.full(len(i), len(SOURCES) - 1)))
    return merged(Hits.joined(parts))


def _values(hits: Hits, texts: list[str]) -> list[str]:
    return [texts[i][a:b] for i, a, b in zip(hits.text.tolist(), hits.first.tolist(), hits.last.tolist())]


def arrow(hits: Hits, texts: list[str], kinds: list[str] = KINDS) -> pa.Array:
    """A list of hits a text."""
    columns = [
        pa.array(kinds).take(pa.array(hits.place)),
        pa.array(hits.start.astype(np.int32)),
        pa.array(hits.end.astype(np.int32)),
        pa.array(_values(hits, texts), pa.string()),
        pa.array(hits.confidence),
        pa.array(SOURCES).take(pa.array(hits.source)),
    ]
    return pa.ListArray.from_arrays(pa.array(hits.bounds(len(texts)).astype(np.int32)), pa.StructArray.from_arrays(columns, fields=list(_HIT)))


def hits_of(texts: pa.Array, find: Callable[[list[str]], Hits], kinds: list[str] = KINDS) -> pa.Array:
    parts = [arrow(find(part), part, kinds) for part in _slices(texts)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(_HIT))


def replacement(kind: str, value: str, mode: str, salt: str) -> str:
    if mode == "REDACT":
        return f"[REDACTED:{kind}]"
    if mode == "SUPPRESS":
        return ""
    if mode == "PSEUDONYMIZE":
        return f"{fixed.PSEUDONYM_PREFIX.get(kind, kind.lower())}_{hashlib.sha256(f'{salt}|{kind}|{value}'.encode()).hexdigest()[:8]}"
    if kind == "DATE":
        return next((y for t in value.replace("/", "-").split("-") if re.fullmatch("[0-9]{4}", y := t.strip(" "))), "[DATE_YEAR_UNKNOWN]")
    if kind == "ZIP":
        digits = re.sub("[^0-9]", "", value)
        return digits[:3] + "**" if len(digits) >= 3 else "[ZIP]"
    return f"[{kind}]"


def redacted(texts: pa.Array, find: Callable[[list[str]], Hits], mode: str, overrides: dict[str, str] | None, salt: str) -> pa.Array:
    """Each text with its merged hits replaced; null stays null."""
    modes = [(overrides or {}).get(kind, mode) for kind in KINDS]
    fixed_ones = [replacement(kind, "", m, salt) if m in ("REDACT", "SUPPRESS") or m == "GENERALIZE" and kind not in ("DATE", "ZIP") else None for kind, m in zip(KINDS, modes)]
    out: list[str] = []
    for part in _slices(texts):
        hits = find(part)
        pieces: list[list[str]] = [[] for _ in part]
        ends = [0] * len(part)
        columns = (hits.text, hits.place, hits.start, hits.end, hits.first, hits.last)
        for i, place, start, end, first, last in zip(*[c.tolist() for c in columns]):
            text, new = part[i], fixed_ones[place]
            if new is None:
                new = replacement(KINDS[place], text[first:last], modes[place], salt)
            pieces[i] += (text[ends[i] : start], new)
            ends[i] = end
        out += ["".join(p) + text[end:] if p else text for p, text, end in zip(pieces, part, ends)]
    return pa.array(out, pa.string(), mask=texts.is_null().to_numpy(zero_copy_only=False))


def _column(find: Callable[[list[str]], Hits], text: Column, kinds: list[str] = KINDS) -> Column:
    @F.arrow_udf(detect.HIT)
    def run(texts: pa.Array) -> pa.Array:
        return hits_of(texts, find, kinds)

    return run(text)


def raw_column(text: Column, kinds: list[str] | None = None) -> Column:
    """detect.raw_hits() of a whole column; not for use inside higher-order functions."""
    return _column(lambda texts: raw(texts, kinds), text)


def merged_column(text: Column, own: tuple[Own, ...] = ()) -> Column:
    """detect.regex_hits() of a whole column, with patterns of one's own beside the others."""
    return _column(lambda texts: merged_with(texts, own), text, KINDS + [kind for kind, *_ in own])


def scanned_column(text: Column, encoded: bool, merge: bool = True) -> Column:
    """scanned() of a whole column."""
    return _column(lambda texts: scanned(texts, encoded, merge), text)


def redacted_column(text: Column, mode: str, overrides: dict[str, str] | None = None, salt: str = "session", scan: bool | None = None) -> Column:
    """Texts with their pattern hits replaced, or with those of scanned() where scan tells whether to look into base64."""
    redact.check(mode, overrides)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return redacted(texts, (lambda t: merged(raw(t))) if scan is None else (lambda t: scanned(t, scan)), mode, overrides, salt)

    return run(text)
