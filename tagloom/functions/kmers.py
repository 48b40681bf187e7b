"""k-mers of texts as numbers, for many texts at once. A number stands for one k-mer only where that was checked; else a Clash is raised."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np

#: Characters of texts that are held as one table of which has which k-mers.
BATCH = 1 << 17
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Clash(ValueError):
    """Two k-mers have one number."""


class Text:
    """numbers and kmers (rows of code points) by place; known: those without the unknown character."""

    def __init__(self, s: str, k: int, unknown: str) -> None:
        try:
            codes = np.frombuffer(s.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            codes = np.frombuffer(s.encode("utf-32-le"), np.uint32)
        n = max(len(codes) - k + 1, 0)
        self.length, self.numbers = len(codes), _windows(codes, k)
        self.kmers = np.lib.stride_tricks.sliding_window_view(codes, k) if n else np.zeros((0, k), np.uint8)
        unknown_before = np.concatenate(([0], np.cumsum(codes == ord(unknown))))
        self.known = unknown_before[k:] == unknown_before[: len(unknown_before) - k] if n else np.zeros(0, bool)


def _windows(codes: np.ndarray, k: int) -> np.ndarray:
    """A number for each k codes in a row, from those of windows of half the width; where k is no power of two, of two that overlap."""
    out, width, factor = codes.astype(np.uint64), 1, FACTOR
    step = lambda at: out[: len(out) - at] * factor + out[at:]
    while 2 * width <= k and len(out) > width:
        out, width = step(width), 2 * width
        factor = np.uint64(pow(int(FACTOR), width, 1 << 64))
    return (step(k - width) if width < k else out) if len(codes) >= k else np.zeros(0, np.uint64)


def _by_number(text: Text, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of places their order by number, the places in that order, and which of them are the first of their k-mer."""
    order = np.argsort(text.numbers[at])
    at = at[order]
    first = np.ones(len(at), bool)
    first[1:] = text.numbers[at[1:]] != text.numbers[at[:-1]]
    again = np.flatnonzero(~first)
    if (text.kmers[at[again]] != text.kmers[at[again - 1]]).any():
        raise Clash
    return order, at, first


class Fragments:
    """The distinct k-mers of each piece of `fragment` code points, the last one shorter, that has at least `least`."""

    def __init__(self, s: str, k: int, fragment: int, least: int, unknown: str) -> None:
        text, parts = Text(s, k, unknown), []
        for start in range(0, text.length, fragment):
            end = min(start + fragment, text.length)
            if end - start >= least:
                _, at, first = _by_number(text, start + np.flatnonzero(text.known[start : max(end - k + 1, start)]))
                parts.append(at[first])
        self.sizes = np.array([len(p) for p in parts], np.int64)
        at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.numbers, self.kmers = text.numbers[at], text.kmers[at]


class Sets:
    """Which of some texts has which k-mers."""

    def __init__(self, texts: Sequence[str], k: int, unknown: str) -> None:
        text = Text("".join(texts), k, unknown)
        ends = np.cumsum([len(t) for t in texts])
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[: len(text.numbers)]
        at = np.flatnonzero(text.known & (np.arange(len(text.numbers)) + k <= ends[owner]))
        order, places, first = _by_number(text, at)
        self.numbers, self.kmers = text.numbers[places[first]], text.kmers[places[first]]
        self.has = np.zeros((len(self.numbers), len(texts)), np.uint8)
        self.has[np.cumsum(first) - 1, owner[at[order]]] = 1

    def shared(self, own: Fragments) -> np.ndarray:
        """How many k-mers of each fragment each text has."""
        out, start = np.zeros((len(own.sizes), self.has.shape[1]), np.int64), 0
        if not len(self.numbers):
            return out
        at = np.minimum(np.searchsorted(self.numbers, own.numbers), len(self.numbers) - 1)
        hit = self.numbers[at] == own.numbers
        if (self.kmers.take(at[hit], 0) != own.kmers[hit]).any():
            raise Clash
        for f, size in enumerate(own.sizes):
            rows = self.has.take(at[start : start + size][hit[start : start + size]], 0)
            if len(rows):
                out[f] = np.add.reduceat(rows, np.arange(0, len(rows), 255), 0).sum(0, dtype=np.int64)  # 255 bytes of 1 add up to a byte
            start += size
        return out


def unless_clash(f: Callable, *args: Any) -> Any:
    """What f gives; None after a clash."""
    try:
        return f(*args)
    except Clash:
        return None


def plain(s: str, texts: Sequence[str], k: int, fragment: int, least: int, unknown: str) -> tuple[np.ndarray, np.ndarray]:
    """sizes and shared by sets of strings, for texts whose numbers clash."""
    grams = lambda s: {g for g in (s[p : p + k] for p in range(len(s) - k + 1)) if unknown not in g}
    parts = [grams(part) for part in (s[at : at + fragment] for at in range(0, len(s), fragment)) if len(part) >= least]
    sets = [grams(t) for t in texts]
    return np.array([len(p) for p in parts], np.int64), np.array([[len(p & there) for there in sets] for p in parts], np.int64).reshape(len(parts), len(sets))
