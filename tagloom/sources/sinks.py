"""Writers: tables with fixed places, by band, in chunks, resumable; sequences and models."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators.calibrate import Ridge
from ..storage import materialize


def write_tsv(df: DataFrame, path: str, places: int = 4, partition_by: Sequence[str] = ()) -> None:
    cols = [F.round(f.name, places).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema]
    writer = df.select(*cols).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path, sep="\t", header=True)


def chunked(df: DataFrame, order: Sequence[str], chunks: int) -> DataFrame:
    """A chunk number for each row of a work list: chunks of about the same number of successive rows, the first ones a row longer.

    Rows are dealt by ranges of their order and written once, so that each keeps its range; places come from counts of the ranges, one row each."""
    dealt = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_part")  # a row for each range
    before = sizes.select("_part", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    numbered = dealt.join(before, "_part").withColumn("_at", place)
    short, longer = F.floor(F.col("_all") / chunks), F.col("_all") % chunks
    in_longer = F.floor(F.col("_at") / (short + 1))
    chunk = F.when(F.col("_at") < longer * (short + 1), in_longer).otherwise(longer + F.floor((F.col("_at") - longer * (short + 1)) / F.greatest(short, F.lit(1))))
    return numbered.withColumn("chunk", chunk.cast("int")).select(*df.columns, "chunk")


def remaining(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def merge_results(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows, with those of new in place of rows of old with equal keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def write_fasta(sequences: DataFrame, path: str, ident: str = "contig_id", seq: str = "seq", width: int = 80) -> None:
    lines = F.regexp_replace(F.col(seq), f"(.{{{width}}})(?=.)", "$1\n")
    sequences.select(F.concat(F.lit(">"), F.col(ident), F.lit("\n"), lines)).write.mode("overwrite").text(path)


def model_row(spark: SparkSession, model: Ridge, name: str) -> DataFrame:
    return spark.createDataFrame([(name, json.dumps(asdict(model)))], "name string, model string")


def write_model(spark: SparkSession, text: str, path: str) -> None:
    """A model's JSON as one file in a folder of any store that Spark reaches."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
