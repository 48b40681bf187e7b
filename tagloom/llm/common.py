"""What the text operators share: tables, scratch tables, byte kernels and bounded broadcasts.

A text is handled as UTF-8 bytes in numpy. `chunks` walks an Arrow column in
runs of whole documents of about half a megabyte, so memory follows the longest
document and never the batch.
"""

from __future__ import annotations

import ctypes
import os
import sys
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..storage import materialize, release, scratch, small

__all__ = ["materialize", "release", "scratch", "small"]

CHUNK_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Letters and digits of ASCII, and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: All but the space and the control characters 9 to 13.
NONSPACE = np.ones(256, bool)
NONSPACE[32] = NONSPACE[9:14] = False

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def single_threaded() -> None:
    """Keeps the matrix products of this process on one core, as Spark runs a task for each core already; threads that wait for work would burn the others."""
    if not os.path.exists("/proc/self/maps"):
        return
    with open("/proc/self/maps") as maps:
        paths = {line.split()[-1] for line in maps if "openblas" in line}
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


@cache
def keep_freed() -> None:
    """Lets this process use memory of up to 32 MB that it has freed again, in place of giving it back and taking it anew with each array."""
    if option := getattr(ctypes.CDLL(None), "mallopt", None):
        option(-1, 1 << 25)  # M_TRIM_THRESHOLD
        option(-3, 1 << 23)  # M_MMAP_THRESHOLD


def give_back() -> None:
    """Freed memory of this process goes back to the system; the allocator would keep it for a worker that may be idle from now on."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Run, words: bool = False) -> Run:
    """run, before which a worker forgets the words that it remembers from encoding (unless `words`), and after which it gives back what it has freed.

    Spark's workers go from task to task and stage to stage, and an executor's limit counts what all of them hold."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = sys.modules.get("tagloom.llm.tokens")
        if tokens and not words:
            tokens.forget()
        yield from run(batches)
        give_back()

    return tidied


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and each text's bounds; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) of runs of whole texts, about `size` bytes each."""
    data, bounds = utf8(column)
    at, n = 0, len(bounds) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        end = min(end, n)
        yield at, end, data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


def spans(data: np.ndarray, bounds: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of each maximal run of word bytes; runs end with their document."""
    inside = word_bytes[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    edge = bounds[:-1]
    before[edge[edge < len(data)]] = False
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[bounds[1:]] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 4096), np.uint64(base))
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= 4 * CHUNK_BYTES:
            _powers[key] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which slice_hash takes the hash of any slice."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_P, len(data)), out=sums[1:])
    return sums


def slice_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes have equal hashes wherever they stand."""
    inverse = _power(_PINV, len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(words: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, position of the first word) of all k consecutive words of one document.

    A document of 1 to k-1 words gives its whole sequence as one shingle."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    length = np.diff(np.r_[first, n])
    at = np.flatnonzero(docs[: n - k + 1] == docs[k - 1 :]) if n >= k else np.zeros(0, np.int64)
    full = np.zeros(len(at), np.uint64)
    for j in range(k):
        full = mix(full * np.uint64(0x9FB21C651E98DF25) + words[at + j])
    short = [(int(s), int(m)) for s, m in zip(first[length < k], length[length < k], strict=True)]
    extra = []
    for s, m in short:
        h = np.zeros(1, np.uint64)
        for j in range(m):
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + words[s + j : s + j + 1])
        extra.append(mix(h + np.uint64(m))[0])
    where = np.array([s for s, _ in short], np.int64)
    return np.r_[full, np.array(extra, np.uint64)], docs[np.r_[at, where]], np.r_[at, where]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
