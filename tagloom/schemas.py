"""Explicit schemas of the tables that are read and written."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

_KINDS = {"string": StringType(), "double": DoubleType(), "int": IntegerType(), "long": LongType()}


def ddl(text: str) -> StructType:
    """A schema from 'name type, ...', without a session."""
    return StructType([StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in text.split(", "))])


# Column names and order of the exchanged tables.
PAIR_FEATURES = ddl(
    "query string, reference string, ani double, ani_uniform double, af_query double, af_reference double, std_err double, synteny_blocks int, "
    "synteny_score double, breakpoint_count int, het_shape double, retention double, ani_from_loss double, ani_from_hist double, enzyme_spread double, "
    "enzyme_chi2 double, per_enzyme string, n_anchors int, n_chains int, n_tags int, max_block_anchors int, mean_block_anchors double, flag string, "
    "ani_gated double, gate string, ani_upper95 double"
)
STRATA_FILE = ddl("query string, reference string, enzyme string, tag_len int, body_len int, n_miss long, hist string")
ACCESSION_MAP = ddl("accession string, seqid string")
TRUTH = ddl("query string, reference string, anim_ani double, anim_aligned_query double, anim_aligned_ref double")
PAIRS = ddl("query string, reference string")
PAF = ddl("q string, qlen long, qs long, qe long, strand string, r string, rlen long, rs long, re long, nmatch long, alnlen long, mapq int")
COORDS = ddl("r_start long, r_end long, q_start long, q_end long, len1 long, len2 long, ident double, len_r long, len_q long, cov_r double, cov_q double, tag_r string, tag_q string")
