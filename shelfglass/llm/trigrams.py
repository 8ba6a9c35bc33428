"""Boolean trigram queries that every match of a regular expression must satisfy.

A query is ``True`` (no condition), a trigram, or ``("and" | "or", [queries])``. Trigrams are
three lower-cased ASCII bytes; a text with a match contains the trigrams the query asks for.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser as parser

import numpy as np

_MOST_STRINGS = 64


def _both(kind: str, parts: list):
    """Join queries; ``True`` vanishes from an "and" and swallows an "or"."""
    if kind == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif not parts or any(p is True for p in parts):
        return True
    return parts[0] if len(parts) == 1 else (kind, parts)


def of_strings(strings: set[str]):
    """The query of an alternation of literal strings."""
    options = []
    for s in sorted(strings):
        raw = s.lower().encode()
        grams = {raw[i:i + 3] for i in range(len(raw) - 2)}
        options.append(_both("and", sorted(grams)))
    return _both("or", options)


def _literals(item) -> set[str] | None:
    """All strings one parsed item matches, if they are few."""
    kind, arg = item
    if kind is op.LITERAL:
        return {chr(arg)}
    if kind is op.IN:
        if any(k is not op.LITERAL for k, _ in arg) or len(arg) > 8:
            return None
        return {chr(v) for _, v in arg}
    if kind is op.SUBPATTERN:
        return _strings(arg[3])
    if kind is op.BRANCH:
        sets = [_strings(x) for x in arg[1]]
        return None if any(s is None for s in sets) else set().union(*sets)
    if kind is op.MAX_REPEAT and arg[1] == 1:
        inner = _strings(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    if kind is op.MAX_REPEAT and arg[0] == arg[1] and arg[0] <= 8:
        inner = _strings(arg[2])
        return inner and {s * arg[0] for s in inner} if inner and len(inner) == 1 else None
    return None


def _strings(items) -> set[str] | None:
    out = {""}
    for item in items:
        more = _literals(item)
        if more is None or len(out) * len(more) > _MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _query(items):
    parts, run = [], {""}
    for item in items:
        more = _literals(item)
        if more is not None and len(run) * len(more) <= _MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        parts.append(of_strings(run))
        run = {""} if more is None else more
        if more is None:
            kind, arg = item
            if kind is op.SUBPATTERN:
                parts.append(_query(arg[3]))
            elif kind is op.BRANCH:
                parts.append(_both("or", [_query(x) for x in arg[1]]))
            elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] >= 1:
                parts.append(_query(arg[2]))
    parts.append(of_strings(run))
    return _both("and", parts)


def derive(pattern: str, flags: int = 0):
    """The Boolean trigram query of ``pattern``; ``True`` if it has no mandatory trigram."""
    return _query(parser.parse(pattern, flags))


def trigrams_of(query) -> set[bytes]:
    if query is True:
        return set()
    if isinstance(query, bytes):
        return {query}
    return set().union(*(trigrams_of(q) for q in query[1]))


class TrigramIndex:
    """Inverted index over a shard of texts: trigram to the sorted positions of its texts."""

    def __init__(self, texts: list[bytes], trigrams: list[bytes]):
        self.n = len(texts)
        self.slot = {t: i for i, t in enumerate(trigrams)}
        # Texts are joined by a zero byte, which no listed trigram contains.
        raw = np.frombuffer(b"\0\0".join(texts).lower(), np.uint8).astype(np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, self.n) + 2)
        table = np.zeros(1 << 24, np.uint16)
        for t, i in self.slot.items():
            table[t[0] << 16 | t[1] << 8 | t[2]] = i + 1
        if len(raw) < 3:
            found = at = np.empty(0, np.int64)
        else:
            hit = table[raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]]
            at = np.flatnonzero(hit)
            found = hit[at].astype(np.int64) - 1
            at = np.searchsorted(ends, at, side="right")
        keys = np.unique(found * max(1, self.n) + at)
        slots = keys // max(1, self.n)
        bounds = np.searchsorted(slots, np.arange(len(trigrams) + 1))
        self.postings = [keys[a:b] - i * self.n
                         for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]

    def candidates(self, query) -> np.ndarray:
        """Positions of the texts that satisfy ``query``, by merging postings."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[self.slot[query]]
        kind, parts = query
        lists = sorted((self.candidates(q) for q in parts), key=len)
        out = lists[0]
        for other in lists[1:]:
            if kind == "and":
                out = np.intersect1d(out, other, assume_unique=True)
            else:
                out = np.union1d(out, other)
        return out


def compiled(pattern: str, ignore_case: bool) -> re.Pattern:
    """ASCII case rules only, so that no letter outside A-Z folds into the pattern."""
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if ignore_case else 0))
