"""Byte-level BPE by a tree of halves: texts are a monoid, and so are their encodings.

Two trees do the work. A text is halved until LEAF characters are left; a leaf
is cut by the pattern. Joining neighbours cuts the characters around the seam
anew, from the last piece of the left that no character beyond the seam can
have influenced, until a cut falls on one that the right already has: the
pattern's next match depends on where it starts only, so all later pieces
stand. Pieces so found, and long ones, are encoded by the second tree: bytes
are halved until SHORT are left, and neighbours are joined by encoding a window
of tokens on both sides of the seam anew, which grows on a side until its
outermost token comes out as it went in.

Why that proves the tokens outside: let ranks be such that each token, encoded
alone by merges of ranks that never fall, gives itself (`Ranks.orderly` looks at every
one of them). Then merges happen in the order of their ranks on any bytes: a
merge that had a lower rank than one before it would join parts X Y | Z whose
bytes are a token T, but merges up to T's rank make T of just these bytes. So
tokens that encode themselves and whose every two neighbours encode as
themselves are an encoding: the first merge over some border would also have
happened with only that border's two tokens. The window keeps all pairs
of neighbours outside of it, and inside they are an encoding. Where ranks
aren't orderly the window is the whole piece.

Decoding is the same tree upside down: bytes of tokens, concatenated in pairs.

A document is a row, encoded by the task that reads it; nothing is shuffled.
Null texts count as empty and have no tokens. Rows with equal or null doc_id
are all kept. An empty table gives no rows. Other columns play no part. Memory:
one batch of texts, or the longest text, and KNOWN pieces that recur.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .tokens import batched

DEFAULT = "byte_bpe_50k.tiktoken"
LEAF, SHORT = 2048, 24
#: Pieces that a worker remembers, and how long the longest of them may be.
KNOWN, LONGEST_KEPT = 500_000, 32
#: Characters beyond its end that decide a match of the pattern: one to end a run, one more after white space, and three from its start for an apostrophe's letters.
REACH = 3

NONE = np.iinfo(np.int64).max


class Ranks:
    """Tokens by rank, and the rank of each two tokens that make one."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.token = {r: t for t, r in self.rank.items()}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        keys, ranks = [], []
        for token, r in self.rank.items():
            for cut in range(1, len(token)):
                x, y = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if x is not None and y is not None:
                    keys.append(x << 32 | y)
                    ranks.append(r)
        order = np.argsort(keys)
        self.keys, self.ranks = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        self.pair = dict(zip(keys, ranks, strict=True))

    def _pairs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of the token that x and y make, NONE where they make none."""
        key = (x << 32) | y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (x >= 0) & (y >= 0), self.ranks[at], NONE)

    def merge(self, pieces: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """Encodes short pieces, all at once: in each round every piece merges its leftmost pair of least rank.

        Also whether ranks never fell from round to round in each piece."""
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
        grew = np.ones(len(pieces), bool)
        lengths = np.array([len(p) for p in pieces], np.int64)
        for length in np.unique(lengths).tolist():
            of_length = np.flatnonzero(lengths == length)
            for begin in range(0, len(of_length), 4096):
                rows = of_length[begin : begin + 4096]
                ids = self.byte[np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8).reshape(len(rows), length)]
                ids = np.c_[ids, np.full((len(rows), 2), -1)]  # always a pair that makes nothing at the end
                pairs = self._pairs(ids[:, :-1], ids[:, 1:])
                last = np.full(len(rows), -1)
                while True:
                    at = pairs.argmin(1)
                    best = pairs[np.arange(len(rows)), at]
                    on = np.flatnonzero(best < NONE)
                    if len(on) < len(rows):
                        for i in np.flatnonzero(best == NONE).tolist():
                            found[rows[i]] = ids[i][ids[i] >= 0]
                        if not len(on):
                            break
                        rows, ids, pairs, at, best, last = rows[on], ids[on], pairs[on], at[on], best[on], last[on]
                    grew[rows[best < last]] = False
                    last = best
                    here = np.arange(ids.shape[1])[None, :]
                    ids = np.where(here <= at[:, None], ids, np.c_[ids[:, 1:], np.full(len(ids), -1)])
                    pairs = np.where(here[:, :-1] <= at[:, None], pairs, np.c_[pairs[:, 1:], np.full(len(ids), NONE)])
                    k = np.arange(len(ids))
                    ids[k, at] = best
                    pairs[k, at] = self._pairs(best, ids[k, at + 1])
                    left = np.maximum(at - 1, 0)
                    pairs[k, left] = np.where(at > 0, self._pairs(ids[k, left], best), pairs[k, left])
        return found, grew

    @cached_property
    def orderly(self) -> bool:
        """Whether each token, encoded alone, gives itself by merges of ranks that never fall."""
        tokens = list(self.rank)
        ids, grew = self.merge(tokens)
        return bool(grew.all()) and all(len(x) == 1 and x[0] == self.rank[t] for x, t in zip(ids, tokens, strict=True))

    def short(self, piece: bytes) -> list[int]:
        """One piece, as merge does."""
        if len(piece) > 4 * SHORT:
            return self._long(piece)
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        get = self.pair.get
        pairs = [get(x << 32 | y, NONE) for x, y in zip(ids, ids[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == NONE:
                break
            at = pairs.index(best)
            ids[at : at + 2] = [best]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = get(best << 32 | ids[at + 1], NONE)
            if at:
                pairs[at - 1] = get(ids[at - 1] << 32 | best, NONE)
        return ids

    def _long(self, piece: bytes) -> list[int]:
        """The same with a heap of pairs by rank and place, for windows that had to grow."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n, get = len(ids), self.pair.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, x, y) for i, (x, y) in enumerate(zip(ids, ids[1:], strict=False)) if (r := get(x << 32 | y, NONE)) < NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue  # one of the two has been merged since
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(rank << 32 | ids[k], NONE)) < NONE:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := get(ids[h] << 32 | rank, NONE)) < NONE:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return [x for x in ids if x >= 0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings."""
        if not left or not right:
            return left or right
        x = y = 1
        if not self.orderly:
            x, y = len(left), len(right)
        while True:
            window = self.bytes(left[-x:]) + self.bytes(right[:y])
            ids = self.short(window)
            left_stands = x == len(left) or ids[0] == left[-x]
            right_stands = y == len(right) or ids[-1] == right[y - 1]
            if left_stands and right_stands:
                return [*left[:-x], *ids, *right[y:]]
            x = x if left_stands else min(len(left), 4 * x)
            y = y if right_stands else min(len(right), 4 * y)

    def encode(self, piece: bytes) -> list[int]:
        """By halves."""
        if len(piece) <= SHORT:
            return self.short(piece)
        half = len(piece) // 2
        return self.join(self.encode(piece[:half]), self.encode(piece[half:]))

    def bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Coder:
    """ids(texts): the ids of each text, encoded by halves, as little-endian unsigned 32-bit bytes; text(raw): the bytes that they stand for."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = Ranks(path)
        self.cut = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        top = max(self.ranks.token)
        self.sizes = np.zeros(top + 1, np.int64)
        for r, t in self.ranks.token.items():
            self.sizes[r] = len(t)

    def _raw(self, ids: list[int] | np.ndarray) -> bytes:
        return np.asarray(ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        raw = self.known.get(piece)
        if raw is None:
            raw = self._raw(self.ranks.encode(piece.encode()))
            if len(piece) <= LONGEST_KEPT:
                self.known[piece] = raw
        return raw

    def _leaves(self, text: str) -> list[str]:
        if len(text) <= LEAF:
            return [text]
        half = len(text) // 2
        return [*self._leaves(text[:half]), *self._leaves(text[half:])]

    def seam(self, left: list[str], right: list[str]) -> tuple[int, list[str], int]:
        """How many pieces of the left stand, the pieces between, and the first piece of the right that stands."""
        stand, chars = len(left), 0
        while stand and chars < REACH:  # a piece whose end is REACH before the seam is none of what follows
            stand -= 1
            chars += len(left[stand])
        window, at = "".join(left[stand:]), 0
        taken, end = 0, len(window)  # pieces of the right in the window, and where the last of them ends
        between: list[str] = []
        borders = {end: 0}
        while True:
            whole = taken == len(right)
            if not whole:  # the window grows by the right's pieces, twice as many each time
                more = right[taken : taken + max(4, taken)]
                for p in more:
                    end += len(p)
                    taken += 1
                    borders[end] = taken
                window += "".join(more)
                whole = taken == len(right)
            for m in self.cut.finditer(window, at):
                if not whole and m.end() + REACH > len(window):
                    break  # what follows may change it
                between.append(m[0])
                at = m.end()
                if at in borders:
                    return stand, between, borders[at]
            if whole:
                return stand, between, len(right)

    def _join(self, left: tuple[list[str], list[bytes]], right: tuple[list[str], list[bytes]]) -> tuple[list[str], list[bytes]]:
        stand, between, first = self.seam(left[0], right[0])
        if between == [left[0][-1] + right[0][0]]:  # a piece lay over the seam: its halves are encoded already
            ids = [self._raw(self.ranks.join(*(np.frombuffer(raw, "<u4").tolist() for raw in (left[1][-1], right[1][0]))))]
        else:
            ids = list(map(self._piece, between))
        return [*left[0][:stand], *between, *right[0][first:]], [*left[1][:stand], *ids, *right[1][first:]]

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KNOWN:
            self.known = {p: raw for p, raw in self.known.items() if len(p) <= 6}
        leaves = [[self.cut.findall(leaf) for leaf in self._leaves(t)] for t in texts]
        fresh = list({p for text in leaves for leaf in text for p in leaf}.difference(self.known))
        in_bytes = [p.encode() for p in fresh]
        at_once = [i for i, b in enumerate(in_bytes) if len(b) <= SHORT]
        found, _ = self.ranks.merge([in_bytes[i] for i in at_once])
        known, passing = self.known, []
        for i, x in zip(at_once, found, strict=True):
            known[fresh[i]] = self._raw(x)
        for p, b in zip(fresh, in_bytes, strict=True):
            if len(b) > SHORT:
                known[p] = self._raw(self.ranks.encode(b))
                if len(p) > LONGEST_KEPT:
                    passing.append(p)
        out = []
        for text in leaves:
            level = [(pieces, list(map(known.__getitem__, pieces))) for pieces in text]
            out.append(b"".join(self._up(level, 0, len(level))[1]))
        for p in passing:
            known.pop(p, None)
        return out

    def _up(self, level: list[tuple[list[str], list[bytes]]], i: int, j: int) -> tuple[list[str], list[bytes]]:
        if j - i == 1:
            return level[i]
        half = (i + j) // 2
        return self._join(self._up(level, i, half), self._up(level, half, j))

    def text(self, raw: bytes) -> bytes:
        """By halves."""
        if len(raw) <= 4 * LEAF:
            return self.ranks.bytes(np.frombuffer(raw, "<u4").tolist())
        half = len(raw) // 8 * 4
        return self.text(raw[:half]) + self.text(raw[half:])


_coders: dict[tuple[str, str], Coder] = {}


def coder(path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Coder:
    """One per Python worker, file and pattern."""
    key = path or public_tokenizers.path(DEFAULT), pattern
    if key not in _coders:
        _coders[key] = Coder(*key)
    return _coders[key]


def encode(docs: DataFrame, with_ids: bool = True, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of doc_id, text; and if asked for ids (little-endian unsigned 32-bit) and decoded (the bytes of the ids)."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if with_ids else 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            texts = batch.column(1)
            sizes = texts.to_pylist()
            for i, j in batched(sizes, 1_000_000):
                raws = own.ids([t or "" for t in sizes[i:j]])
                decoded = [own.text(r) for r in raws]
                hashed = [pa.array([hashlib.sha256(x).hexdigest() for x in column]) for column in (raws, decoded)]
                columns = [batch.column(0).slice(i, j - i), pa.array([len(r) // 4 for r in raws], pa.int64()), *hashed]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(raws, pa.binary()), pa.array(decoded, pa.binary())] if with_ids else [])], names=names)

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * with_ids)


def op13_bytepair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
