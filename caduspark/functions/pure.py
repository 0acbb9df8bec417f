"""The scan of one text in plain Python, for JSON of any shape and for tests of the column expressions."""

from __future__ import annotations

import re
from functools import reduce
from itertools import accumulate, pairwise

from caduspark.functions import fixed
from caduspark.functions.detect import normalize_text

#: A text without any of these has no hit; a pattern needs its literals, and most need a digit.
_MAY = re.compile(r"\d|@|://|mrn|record", re.I)
_SOME_DIGIT = re.compile(r"\d")
_NEEDS = {kind: needs for kind, _, _, needs in fixed.PATTERNS}
_DIGITLESS = {"EMAIL", "URL", "MRN"}
_COMPILED = [(kind, re.compile(pattern.replace("(?iu)", ""), re.I if pattern.startswith("(?iu)") else 0), c) for kind, pattern, c, _ in fixed.PATTERNS]


def _union(first: tuple, second: tuple) -> tuple:
    """One hit over both spans, with type, value, confidence and source of the surer, else longer, one."""
    surer = max(first, second, key=lambda h: (h[4], h[2] - h[1], h is first))
    return (surer[0], first[1], max(first[2], second[2]), *surer[3:])


def merged(hits: list[tuple]) -> list[tuple]:
    """(type, start, end, value, confidence, source) hits: each island of overlapping spans becomes one."""
    hits = sorted(hits, key=lambda x: (x[1], x[1] - x[2], -x[4]))
    reach = [0, *accumulate((h[2] for h in hits), max)]
    cuts = [i for i, h in enumerate(hits) if h[1] >= reach[i]] + [len(hits)]
    return [reduce(_union, hits[a:b]) for a, b in pairwise(cuts)] if hits else []


def hits_of(text: str) -> list[tuple]:
    if not _MAY.search(text):
        return []
    digit = _SOME_DIGIT.search(text) is not None
    able = [x for x in _COMPILED if (digit or x[0] in _DIGITLESS) and all(need in text for need in _NEEDS[x[0]])]
    return merged([(kind, m.start(), m.end(), m[0], c, "regex") for kind, pattern, c in able for m in pattern.finditer(text)])


def scanned(text: str) -> list[tuple]:
    """Hits of the canonical form, mapped back to the text."""
    if text.isascii() and "%" not in text:
        return hits_of(text)
    normal, starts, ends = normalize_text(text)
    if normal == text:
        return hits_of(text)
    found = hits_of(normal)
    return merged([(k, starts[a], ends[b - 1], text[starts[a] : ends[b - 1]], c, s + "+normalized") for k, a, b, _, c, s in found])


def redact_text(text: str) -> str:
    return redact_with(text, scanned(text))


def redact_with(text: str, hits: list[tuple]) -> str:
    out, at = [], 0
    for kind, start, end, *_ in hits:
        out += [text[at:start], f"[REDACTED:{kind}]"]
        at = end
    return "".join([*out, text[at:]])
