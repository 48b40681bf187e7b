"""Readers: delimited tables, strata folders, sequences, alignments, reports, matrices, models.

Schemas are given, never inferred; numbers that can't be read become null, and
NaN becomes null at the door.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .. import schemas
from ..functions.columns import clean


def read_tsv(spark: SparkSession, paths: str | Sequence[str], schema: StructType, header: bool = True) -> DataFrame:
    """All columns are read as text and tried as their type, so 'NA' or 'inf' never fail a job; infinity stays."""
    raw = StructType([StructField(f.name, StringType()) for f in schema])
    df = spark.read.csv(paths if isinstance(paths, str) else list(paths), sep="\t", header=header, schema=raw, enforceSchema=True)
    cols = []
    for f in schema:
        c = F.col(f.name).try_cast(f.dataType)
        cols.append((clean(c) if isinstance(f.dataType, DoubleType) else c).alias(f.name))
    return df.select(*cols)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, schemas.ACCESSION_MAP, header=False)


def read_strata(spark: SparkSession, path: str) -> DataFrame:
    """A folder of files for one pair each; query and reference come from the name q__r.* where the file has none."""
    raw = StructType([StructField(f.name, StringType()) for f in schemas.STRATA_FILE])
    df = spark.read.csv(path, sep="\t", header=True, schema=raw).withColumn("_name", F.split(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.strata)?\.tsv$", 1), "__"))
    hist = F.transform(F.split("hist", ","), lambda x: x.try_cast("long"))
    n = [F.coalesce(F.try_element_at(hist, F.lit(i + 1)), F.lit(0).cast("long")).alias(f"n{i}") for i in range(3)]
    return df.select(
        F.coalesce("query", F.try_element_at("_name", F.lit(1))).alias("query"), F.coalesce("reference", F.try_element_at("_name", F.lit(2))).alias("reference"), "enzyme",
        *[F.col(c).try_cast("int").alias(c) for c in ("tag_len", "body_len")], *n, F.col("n_miss").try_cast("long").alias("n_miss"),
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """genome_id (from the file name), contig_id, record (from 0), seq (upper case); compressed files too. A record is a row."""
    lines = spark.read.text(path, lineSep=">").select("value", F.regexp_replace("_metadata.file_name", r"\.(fasta|fna|fa)(\.gz)?$", "").alias("genome_id"), F.monotonically_increasing_id().alias("at")).where("value <> ''")
    head, body = F.split("value", "\n", 2)[0], F.split("value", "\n", 2)[1]
    rows = lines.select("genome_id", F.split(F.trim(head), r"\s")[0].alias("contig_id"), F.upper(F.regexp_replace(F.coalesce(body, F.lit("")), r"\s", "")).alias("seq"), "at")
    return rows.withColumn("record", F.row_number().over(Window.partitionBy("genome_id").orderBy("at")) - 1).drop("at")


def fasta_index(sequences: DataFrame) -> DataFrame:
    """Length and first record of each genome."""
    return sequences.groupBy("genome_id").agg(F.sum(F.length("seq")).alias("length"), F.min_by("contig_id", "record").alias("first_id"))


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """The twelve columns, and the optional tags cg and NM."""
    parts = F.split("value", "\t")
    df = spark.read.text(path).where("value <> ''").select(parts.alias("p"))
    tag = lambda prefix: F.substring_index(F.try_element_at(F.filter(F.slice("p", 13, 1000), lambda t: t.startswith(prefix)), F.lit(1)), ":", -1)
    return df.select(*[F.try_element_at("p", F.lit(i + 1)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schemas.PAF)], tag("cg:Z:").alias("cigar"), tag("NM:i:").try_cast("long").alias("nm"))


def read_coords(spark: SparkSession, path: str) -> DataFrame:
    df = read_tsv(spark, path, schemas.COORDS, header=False)
    return df.withColumn("reverse", F.col("q_start") > F.col("q_end"))


def read_diff(spark: SparkSession, path: str, side: str, least: int = 1000) -> DataFrame:
    """Events of a difference file: gaps by the sign of the difference, seen from the query or the reference, and duplications."""
    p = F.split("value", "\t")
    at = lambda i, t="long": F.try_element_at(p, F.lit(i)).try_cast(t)
    df = spark.read.text(path).select(at(1, "string").alias("name"), at(2, "string").alias("type"), at(3).alias("start"), at(4).alias("end"), at(5).alias("len"), at(7).alias("diff"))
    longer, shorter = ("Insertion", "Deletion") if side == "query" else ("Deletion", "Insertion")
    size = F.when(F.col("type") == "GAP", F.abs("diff")).otherwise(F.abs("len"))
    kind = F.when((F.col("type") == "GAP") & (F.col("diff") > 0), longer).when((F.col("type") == "GAP") & (F.col("diff") < 0), shorter).when(F.col("type").isin("DUP", "BRK"), longer)
    return df.select("name", kind.alias("sv_type"), F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end"), size.alias("size")).where(F.col("sv_type").isNotNull() & (F.col("size") >= least))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Aligned shares and mean identities of the 1-to-1 blocks of alignment reports; one row a file."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    block = F.regexp_extract("value", r"(?ms)^1-to-1.*?(?=^M-to-M|\z)", 0)
    identity = lambda g: F.nullif(F.regexp_extract(block, r"AvgIdentity\s+([\d.]+)\s+([\d.]+)", g), F.lit("")).try_cast("double")
    aligned = lambda g: F.nullif(F.regexp_extract("value", r"AlignedBases\s+\d+\(([\d.]+)%\)\s+\d+\(([\d.]+)%\)", g), F.lit("")).try_cast("double")
    return text.select("file", identity(1).alias("id_ref"), identity(2).alias("id_qry"), ((identity(1) + identity(2)) / 2).alias("ani"), aligned(1).alias("af_ref"), aligned(2).alias("af_qry"))


def read_triangle(spark: SparkSession, path: str) -> DataFrame:
    """Edges (a, b, ani) of a lower triangle: a line for each name with the values for all names before it."""
    lines = spark.read.text(path).where("value <> '' AND instr(value, '\t') > 0 OR value RLIKE '^[^0-9]'").select(F.split("value", "\t").alias("p"), F.monotonically_increasing_id().alias("at"))
    numbered = lines.withColumn("i", F.size("p") - 1).select("i", F.element_at("p", 1).alias("name"), "p")
    cells = numbered.select("i", F.col("name").alias("a"), F.posexplode(F.slice("p", 2, 1 << 30)).alias("j", "v"))
    return cells.join(numbered.select(F.col("i").alias("j"), F.col("name").alias("b")), "j").select("a", "b", clean(F.col("v").try_cast("double")).alias("ani"))


def read_accessions(df: DataFrame, column: str) -> DataFrame:
    """Values that look like run accessions, numbered in order."""
    found = df.where(F.col(column).rlike(r"^[SED]RR\d+$")).select(F.col(column).alias("sra_run")).distinct()
    number = F.row_number().over(Window.orderBy("sra_run"))  # a sample sheet
    return found.select(F.concat(F.lit("isolate_"), F.lpad(number.cast("string"), 3, "0")).alias("isolate"), "sra_run")


def read_model(spark: SparkSession, path: str) -> dict:
    """A model file as a dictionary; a model is one small document."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_model_text(spark: SparkSession, path: str) -> str:
    """The JSON of `write_model`, for trees_from_json or linear_from_json."""
    parts = [r[0] for r in spark.read.text(path, wholetext=True).limit(2).collect() if r[0].strip()]
    if len(parts) != 1:
        raise ValueError(f"one model was expected in {path}")
    return parts[0]
