"""Static range asymmetric numeral system over 32-bit ids, in numpy.

A segment holds the ids of whole documents. Its frequency table is shared by
all of its blocks of BLOCK ids; within a block LANES interleaved coders take
turns, so id t belongs to lane t mod LANES. All blocks and lanes of a segment
are coded at once, one id of each lane a step.

A coder's state lies in [2**31, 2**63) and sheds or takes 32 bits at a time.
The checkpoint of a block is where its words begin and the states with which
decoding starts; with these and the table each block decodes on its own. A
crc32 of each block's ids guards it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 18
LANES = 32
BLOCK = 32_768
MAGIC = b"TLR1"
_LOW = np.uint64(1 << 31)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Positive integers in proportion to counts (all positive), with sum 2**SCALE."""
    total = 1 << SCALE
    if len(counts) > total:
        raise ValueError("more symbols than slots")
    f = np.maximum(1, np.floor(counts * ((total - len(counts)) / counts.sum()))).astype(np.int64)
    rest = total - int(f.sum())
    if rest > 0:
        f[np.argmax(f)] += rest
    while rest < 0:  # take what is too much from the largest
        order = np.argsort(-f, kind="stable")[: -rest]
        order = order[f[order] > 1]
        f[order] -= 1
        rest = total - int(f.sum())
    return f


def _varints(values: np.ndarray) -> bytes:
    out = bytearray()
    for v in values.tolist():
        while v >= 128:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def _unvarints(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    out = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max(initial=0)) + 1):
        at = starts + k
        ok = at <= ends
        out[ok] |= (b[at[ok]].astype(np.int64) & 127) << (7 * k)
    return out


def encode(ids: np.ndarray) -> bytes:
    """A segment: header, table, checkpoints, words."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n = len(ids)
    if n == 0:
        return MAGIC + struct.pack("<QII", 0, 0, 0)
    if int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
        place = np.zeros(int(symbols[-1]) + 1, np.int64)
        place[symbols] = np.arange(len(symbols))
        index = place[ids]
    else:
        symbols, index, counts = np.unique(ids, return_inverse=True, return_counts=True)
    freq = frequencies(counts)
    cum = np.cumsum(freq) - freq
    nb = -(-n // BLOCK)
    steps = -(-min(n, BLOCK) // LANES)
    grid = np.full(nb * BLOCK, -1, np.int64)
    grid[:n] = index
    grid = grid.reshape(nb, BLOCK)[:, : steps * LANES].reshape(nb, steps, LANES)
    freq64, cum64 = freq.astype(np.uint64), cum.astype(np.uint64)
    state = np.full((nb, LANES), _LOW)
    shed = np.zeros((steps, nb, LANES), bool)
    words = np.zeros((steps, nb, LANES), np.uint32)
    scale, word = np.uint64(SCALE), np.uint64(32)
    for t in range(steps - 1, -1, -1):
        at = grid[:, t, :]
        live = at >= 0
        f = freq64[at]
        full = live & (state >= f << np.uint64(63 - SCALE))
        shed[t] = full
        words[t][full] = state[full].astype(np.uint32)
        state = np.where(full, state >> word, state)
        q = state // f
        state = np.where(live, (q << scale) + (state - q * f) + cum64[at], state)
    streams = [words[:, b, :][shed[:, b, :]] for b in range(nb)]
    table = _varints(np.c_[np.diff(symbols, prepend=0), freq].reshape(-1))
    crcs = np.array([zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].tobytes()) for b in range(nb)], "<u4")
    return b"".join([
        MAGIC, struct.pack("<QII", n, nb, len(table)), table, crcs.tobytes(),
        np.array([len(s) for s in streams], "<u4").tobytes(), state.astype("<u8").tobytes(), *(s.astype("<u4").tobytes() for s in streams),
    ])


def decode(raw: bytes) -> np.ndarray:
    """The ids of a segment; every block is checked against its crc32."""
    if raw[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n, nb, size = struct.unpack_from("<QII", raw, 4)
    if n == 0:
        return np.zeros(0, np.uint32)
    at = 4 + struct.calcsize("<QII")
    pairs = _unvarints(raw[at : at + size]).reshape(-1, 2)
    at += size
    symbols, freq = np.cumsum(pairs[:, 0]), pairs[:, 1]
    cum = np.cumsum(freq) - freq
    crcs = np.frombuffer(raw, "<u4", nb, at)
    lengths = np.frombuffer(raw, "<u4", nb, at + 4 * nb).astype(np.int64)
    at += 8 * nb
    state = np.frombuffer(raw, "<u8", nb * LANES, at).reshape(nb, LANES).astype(np.uint64)
    words = np.r_[np.frombuffer(raw, "<u4", int(lengths.sum()), at + 8 * nb * LANES), np.zeros(LANES, np.uint32)].astype(np.uint64)
    slots = np.repeat(np.arange(len(freq)), freq)
    freq64, cum64, ids32 = freq.astype(np.uint64), cum.astype(np.uint64), symbols.astype(np.uint32)
    steps = -(-min(n, BLOCK) // LANES)
    out = np.zeros((nb, steps, LANES), np.uint32)
    where = (np.cumsum(lengths) - lengths)[:, None]
    left = np.minimum(BLOCK, n - np.arange(nb) * BLOCK)[:, None]
    lanes = np.arange(LANES)[None, :]
    mask, scale, word = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    for t in range(steps):
        live = t * LANES + lanes < left
        slot = state & mask
        at = slots[slot.astype(np.int64)]
        out[:, t, :] = ids32[at]
        nxt = freq64[at] * (state >> scale) + slot - cum64[at]
        take = live & (nxt < _LOW)
        rank = np.cumsum(take, axis=1)
        source = np.minimum(where + rank - 1, len(words) - 1)
        nxt = np.where(take, (nxt << word) | words[source], nxt)
        state = np.where(live, nxt, state)
        where = where + rank[:, -1:]
    ids = np.concatenate([out[b].reshape(-1)[: int(left[b, 0])] for b in range(nb)])
    for b in range(nb):
        if zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) != int(crcs[b]):
            raise ValueError(f"block {b} is damaged")
    return ids
