"""Token ids of documents in binary files: static range asymmetric numeral system.

Documents are dealt out by ranges of doc_id and sorted within each; every task
encodes its texts and writes segments of whole documents, each with one
frequency table that its interleaved blocks share (see rans.py). The files are
Parquet files with one segment a row, as Spark's own writer reaches every
store and commits whole tasks only; a segment carries the ids and token counts
of its documents. Reading decodes segment by segment, blocks on their own.

The position of a document in the whole stream comes from sums in two steps:
within a segment and over segments of a file part when writing, and over the
parts, one row each, when reading.

Null texts count as empty and consist of the end id. Rows with equal or null
doc_id are all kept, nulls first, equal ids in the order of their text. An
empty table gives files without segments. Other columns play no part.
Memory: one segment, of SEGMENT ids or one document if that is longer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .common import scratch, table
from .tokens import batched, encoder

END = 2
SEGMENT = 1 << 21

SEGMENTS = "part int, segment int, first_start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def write(docs: DataFrame, path: str, end_id: int = END, tokenizer: str | None = None) -> None:
    """Writes the ids of doc_id, text to a new folder, in ascending order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        coder = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        ids: list[int | None] = []
        texts: list[bytes] = []
        held, segment, first = 0, 0, 0

        def segment_row() -> pa.RecordBatch:
            payload = rans.encode(np.frombuffer(b"".join(texts), "<u4"))
            row = [[part], [segment], [first], [held], [ids], [[len(t) // 4 for t in texts]], [payload]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["part", "segment", "first_start", "n_ids", "doc_ids", "lengths", "payload"])

        for batch in batches:
            keys, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in batched(values):
                for key, raw in zip(keys[i:j], coder.ids([t or "" for t in values[i:j]]), strict=True):
                    if held and held + len(raw) // 4 + 1 > SEGMENT:
                        yield segment_row()
                        ids, texts, segment, first, held = [], [], segment + 1, first + held, 0
                    ids.append(key)
                    texts.append(raw + end)
                    held += len(raw) // 4 + 1
        if texts:
            yield segment_row()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SEGMENTS).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit) of every document of a folder."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each file part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                before, doc_ids, lengths, payload = (batch.column(c)[row].as_py() for c in range(4))
                ids = rans.decode(payload)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                for at in range(0, len(doc_ids), 2000):
                    s, e = starts[at : at + 2000], ends[at : at + 2000]
                    raws = [ids[i:j].astype("<u4").tobytes() for i, j in zip(s.tolist(), e.tolist(), strict=True)]
                    columns = [pa.array(doc_ids[at : at + 2000], pa.int64()), pa.array(s + before), pa.array(e - s), pa.array([zlib.crc32(r) for r in raws], pa.int64()), *([pa.array(raws, pa.binary())] if with_ids else [])]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    rows = files.join(F.broadcast(before) if _few(parts) else before, "part").select((F.col("before") + F.col("first_start")).alias("before"), "doc_ids", "lengths", "payload")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def _few(parts: DataFrame, most: int = 200_000) -> bool:
    """Whether the parts, which are counted, are few enough to send to all."""
    return parts.limit(most + 1).count() <= most


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
