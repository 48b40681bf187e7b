"""A corpus in five stages: quality, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents. The table that a stage
returns has to be written before the next stage is called: the next one
deletes the intermediate tables of the one before it.

In all stages a row is judged by what it holds: rows that repeat doc_id and
text have one result, rows of one doc_id and different texts have one each,
rows with a null doc_id are judged like others, and further columns, whatever
their names, are dropped. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import op1_decontamination, op6_packing, op8_jaccard, op9_suffix, op10_quality
from tagloom.llm.common import materialize, release, small, table, tidy
from tagloom.storage import drop, live

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_QUALITY = 0.7

#: The classifier and the packing are not expressible in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: set[str] = set()


def stage(function: Stage) -> Stage:
    """The stage, which first deletes what the stage before has left in the shared folder."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(_left & live())
        before = live()
        out = function(spark, docs.select(*COLUMNS), sf_dir)
        _left.clear()
        _left.update(live() - before)
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go.

    Null and empty texts are scored like others. Without labels of both kinds there is no classifier, and all stay."""
    model = op10_quality.quality_model(spark, docs, sf_dir)
    if not model.learned:
        return docs
    return op10_quality.score(docs, model, "_score").where(F.col("_score") >= MIN_QUALITY).select(*COLUMNS)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8, one row stays: that of the least doc_id, a null one last.

    Of rows that repeat doc_id and text one stays; among different texts of one doc_id the least hash of the text decides. Null texts
    and texts without words are in no group and stay."""
    groups = op8_jaccard.join(docs, k=5, percent=80).where("root IS NOT NULL")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    rows = materialize(groups.select("root", row.alias("row")))
    several = rows.groupBy("root").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("root", "first")
    marked = rows.join(small(several, 200_000), "root").groupBy("row", "first").agg(F.count("*").alias("n"))
    verdict = materialize(marked.select("row", F.when(F.col("row") == F.col("first"), 1).otherwise(0).alias("kept"), "n").where("kept = 0 OR n > 1"))
    release(rows)
    same = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    judged = docs.withColumn("_row", same).join(small(verdict.select(F.col("row").alias("_verdict"), "kept"), 200_000), F.col("_row").eqNullSafe(F.col("_verdict")), "left")
    alone = judged.where("kept IS NULL").select(*COLUMNS)
    if verdict.where("kept = 1").isEmpty():
        return alone
    twice = judged.where("kept = 1").dropDuplicates(["_row"]).select(*COLUMNS)
    return alone.union(twice)


@stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that an earlier document has, in a run of 50 or more, are cut out; a character goes only if all of its bytes do.

    Rows with a null doc_id are kept whole, as they are neither before nor after others, and so are null and shorter texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends")), strict=True):
                if starts:
                    raw = text.encode()
                    inner = [(_up(raw, a), _down(raw, b)) for a, b in zip(starts, ends, strict=True)]
                    inner = [(a, b) for a, b in inner if a < b]
                    text = op9_suffix.cut_out(raw, [a for a, _ in inner], [b for _, b in inner]).decode()
                texts.append(text)
            columns = {c: batch.column(c) for c in COLUMNS}
            columns["text"] = pa.array(texts, pa.string())
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = docs.withColumn("n_chars", F.col("n_chars").cast("long")).schema
    return op9_suffix.with_repeats(docs).mapInArrow(tidy(run), schema)


def _up(raw: bytes, at: int) -> int:
    """The first character border at or after a position."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def _down(raw: bytes, at: int) -> int:
    """The last character border at or before a position."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go. Null and empty texts hold none."""
    hits = op1_decontamination.contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    dirty = materialize(hits.select(F.col("uid").alias("_uid")).distinct())
    return docs.withColumn("_row", op1_decontamination.row_key()).join(small(dirty, 200_000), F.col("_row") == F.col("_uid"), "left_anti").select(*COLUMNS)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 ids. Null and empty texts are one end id."""
    return op6_packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminate", decontaminate),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, function) in enumerate(STAGES[:-1]):
        kept = materialize(function(spark, docs, sf_dir))
        if i:
            release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
