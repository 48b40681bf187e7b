"""Packing into windows by the online sum-of-squares rule.

Each task packs the documents of its partition as they come. A document's full
windows are cut off first. The rest, shorter than a window, goes into one of
the open windows or a new one: of all fill levels h, held in a level array N
with the number of windows open at each, it takes the one for which the sum of
squares of N after the placement is smallest; a window that is full leaves the
array. Ties go to the fullest level.

When the open windows hold HELD ids, and at the end, the rule's left-overs are
flushed: their pieces are laid end to end and cut at window borders, and what
remains is cut into sequences whose lengths are powers of two. So no sequence
needs padding, and memory is bounded whatever the lengths are.

Null texts count as empty and consist of the end id. Rows with equal or null
doc_id are packed one by one; an empty table gives no pieces; other columns
play no part. Sequence ids are unique over all tasks: the task's number times
2**33 and a running number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy
from .tokens import batched, encoder

WINDOW = 2048
END = 1
HELD = 1 << 22

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


class Packer:
    """add() places one document; rows collects the pieces of finished windows."""

    def __init__(self, window: int = WINDOW, first_id: int = 0, held: int = HELD) -> None:
        self.window, self.most = window, held
        self.level = np.zeros(window + 1, np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]  # by level: windows as lists of pieces
        self.held = 0
        self.next_id = first_id
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, raw, total in pieces:
            n = len(raw) // 4
            self.rows.append((key, start, n, zlib.crc32(raw), total, self.next_id, offset))
            offset += n
        self.next_id += 1

    def best(self, size: int) -> int:
        """The level, 0 for a new window, that leaves the least sum of squares."""
        n, b = self.level, self.window
        change = np.empty(b - size + 1, np.int64)
        change[: b - size] = 2 * n[size:b] + 1  # one more window at level h + size
        change[b - size] = 0  # or a full one, which isn't counted
        change[1:] += 1 - 2 * n[1 : b - size + 1]  # one less at level h
        change[1:][n[1 : b - size + 1] == 0] = np.iinfo(np.int64).max
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def add(self, key: int | None, raw: bytes) -> None:
        total, step = len(raw) // 4, self.window * 4
        at = 0
        while len(raw) - at >= step:
            self._emit([(key, at // 4, raw[at : at + step], total)])
            at += step
        if at == len(raw):
            return
        rest = (key, at // 4, raw[at:], total)
        size = total - at // 4
        h = self.best(size)
        if h:
            pieces = self.open[h].pop()
            self.level[h] -= 1
            pieces.append(rest)
        else:
            pieces = [rest]
        self.held += size
        if h + size == self.window:
            self._emit(pieces)
            self.held -= self.window
        else:
            self.open[h + size].append(pieces)
            self.level[h + size] += 1
            if self.held >= self.most:
                self.flush()

    def flush(self) -> None:
        left = [p for windows in reversed(self.open) for pieces in windows for p in pieces]
        lengths, rest = [], self.held
        while rest:
            lengths.append(self.window if rest >= self.window else 1 << (rest.bit_length() - 1))
            rest -= lengths[-1]
        pieces: list[tuple] = []
        lengths.reverse()
        room = lengths.pop() if lengths else 0
        for key, start, raw, total in left:
            at = 0
            while at < len(raw):
                n = min(room, (len(raw) - at) // 4)
                pieces.append((key, start + at // 4, raw[at : at + 4 * n], total))
                at += 4 * n
                room -= n
                if room == 0:
                    self._emit(pieces)
                    pieces, room = [], lengths.pop() if lengths else 0
        self.level[:] = 0
        self.open = [[] for _ in range(self.window + 1)]
        self.held = 0


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END, tokenizer: str | None = None) -> DataFrame:
    """One row for each piece of a document; a document's pieces cover each of its ids once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        packer = Packer(window, TaskContext.get().partitionId() << 33)

        def done() -> pa.RecordBatch:
            columns = zip(*packer.rows, strict=True) if packer.rows else [[]] * 7
            out = pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=NAMES)
            packer.rows = []
            return out

        for batch in batches:
            keys, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in batched(values):
                for key, raw in zip(keys[i:j], coder.ids([t or "" for t in values[i:j]]), strict=True):
                    packer.add(key, raw + end)
                yield done()
        packer.flush()
        yield done()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run, words=True), SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
