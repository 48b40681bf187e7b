"""Quality classifier by compression.

Two zstandard dictionaries are built, one from texts labelled good and one
from texts labelled bad. A text is cut into pieces of a few kilobytes, each
piece is compressed with either dictionary, and the normalised difference of
the two summed sizes, (bad - good) / (bad + good), goes through a logistic
curve fitted to labelled texts that the dictionaries have not seen. A second
input of the curve is how far the size without any dictionary falls below that
of ordinary prose: a word repeated over and over is small under either.

Training takes a bounded sample of the labelled rows: at most `max_rows` of
each label, in the order of a hash of their id, of texts of at most
`max_chars` characters. Scoring reads whole texts, needs no shuffle and holds
one batch at a time.

Null and empty texts score as the curve does at a difference of 0. Rows with
a null label and labels other than 0 and 1 are not learned from; of several
label rows of a document the least label counts. Rows with a null doc_id are
scored, and not learned from. Repeated documents are scored one by one. With no
row of either label, every score is 0.5. Other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import table, tidy

PIECE = 4096
DICTIONARY = 256 * 1024
LEVEL = 3
#: Bytes of a frame that holds nothing, and compressed bytes for each byte of ordinary prose.
OVERHEAD, USUAL = 6, 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]

    @property
    def learned(self) -> bool:
        return any(self.weights)

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return [*out, zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)]

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b, c = self.weights
        return 1 / (1 + np.exp(-np.clip(a * x[:, 0] + b * x[:, 1] + c, -30, 30)))


def features(text: bytes, compressors: list[zstandard.ZstdCompressor]) -> tuple[float, float]:
    """The normalised difference of the two sizes, and how far the size without a dictionary falls short of that of ordinary prose."""
    if not text:
        return 0.0, 0.0
    good, bad, plain = (sum(len(c.compress(text[i : i + PIECE])) - OVERHEAD for i in range(0, len(text), PIECE)) for c in compressors)
    return (bad - good) / max(1, bad + good), max(0.0, USUAL - plain / len(text))


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[i : i + 1024] for t in texts for i in range(0, len(t), 1024)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: the text itself
        return b"\n".join(texts)[-DICTIONARY:] or b"\n" * 8


def fit(rows: list[tuple[str, int]]) -> Model:
    """Learns from (text, label) rows: two of three build the dictionaries, the third sets the curve."""
    texts = {y: [t.encode() for t, label in rows if label == y and t] for y in (1, 0)}
    if not texts[1] or not texts[0]:
        return Model(b"\n" * 8, b"\n" * 8, (0.0, 0.0, 0.0))
    build = {y: [t for i, t in enumerate(ts) if i % 3 or len(ts) < 3] for y, ts in texts.items()}
    model = Model(_dictionary(build[1]), _dictionary(build[0]), (0.0, 0.0, 0.0))
    tools = model.compressors()
    held = [(features(t, tools), y) for y, ts in texts.items() for i, t in enumerate(ts) if i % 3 == 0 or len(ts) < 3]
    x, y = np.array([[*f, 1.0] for f, _ in held]), np.array([v for _, v in held], float)
    scale = np.r_[x[:, :2].std(axis=0) + 1e-9, 1.0]
    z, w = x / scale, np.zeros(3)
    for _ in range(60):  # Newton's method with a little ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        v = p * (1 - p) + 1e-9
        step = np.linalg.solve((z * v[:, None]).T @ z + np.diag([0.1, 0.1, 1e-3]), z.T @ (p - y) + np.array([0.1, 0.1, 1e-3]) * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = tuple(float(a) for a in w / scale)
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, max_chars: int = 20_000) -> Model:
    """labels: doc_id, label. Ids are compared as text-hashed longs; the picked ids have a fixed bound."""
    usable = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    picked = None
    for y in (0, 1):
        part = usable.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        picked = part if picked is None else picked.union(part)
    rows = (
        docs.select("doc_id", "text")
        .where(F.length("text") <= max_chars)
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.max("text").alias("text"))
        .select("doc_id", "text", "label")
        .toPandas()
        .sort_values("doc_id")
    )
    return fit(list(zip(rows["text"], rows["label"].astype(int), strict=True)))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """All columns of docs, and the score of the column text; a column of docs with the name of the score is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(column)
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = sent.value.compressors()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            x = np.array([features(t.as_py() or b"", tools) for t in texts.cast(pa.large_binary())], float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.score(x))], [*batch.schema.names, column])

    return docs.mapInArrow(tidy(run), schema)


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    seen = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(seen)
    return train(docs, labels)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model(spark, docs, sf_dir)
    scored = score(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )
