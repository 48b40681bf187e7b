import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import tags
from tagloom.plans import api

PANEL = [tags.Enzyme("e1", 24, (((8, "CG"), (14, "A")),)), tags.Enzyme("e2", 20, (((6, "GA"), (12, "C")),))]


@pytest.fixture(scope="module")
def sequences(spark):
    r = np.random.default_rng(4)
    base = r.choice(list("ACGT"), 40_000)
    near = base.copy()
    at = r.choice(len(base), 800, replace=False)  # exactly 2 % of all bases
    near[at] = [{"A": "C", "C": "G", "G": "T", "T": "A"}[x] for x in near[at]]
    other = r.choice(list("ACGT"), 40_000)
    rows = [("g1", "c", "".join(base)), ("g2", "c", "".join(near)), ("g3", "c", "".join(other))]
    return spark.createDataFrame(rows, "genome_id string, contig_id string, seq string")


def test_triangle_finds_the_pair_and_its_identity(spark, sequences):
    out = api.triangle(api.sketch(sequences, PANEL), PANEL).collect()
    assert [(r["a"], r["b"]) for r in out] == [("g1", "g2")]
    assert out[0]["ani_gated"] == pytest.approx(0.98, abs=0.004) and out[0]["flag"] == "ok"


def test_search_and_database(spark, sequences, tmp_path):
    s = api.sketch(sequences, PANEL)
    api.db_add(s.where("genome_id <> 'g2'"), str(tmp_path / "db"))
    api.db_add(s, str(tmp_path / "db"))
    db = api.db_open(spark, str(tmp_path / "db"))
    assert db.count() == s.count()
    hits = api.search(s.where("genome_id = 'g1'"), db, PANEL).collect()
    assert [(r["a"], r["b"], r["rank"]) for r in hits] == [("g1", "g2", 1)]


def test_self_is_one(spark, sequences):
    s = api.sketch(sequences.where("genome_id = 'g1'"), PANEL)
    twin = s.withColumn("genome_id", F.lit("g9"))
    pairs = spark.createDataFrame([("g1", "g9")], "a string, b string")
    assert api.dist(s.union(twin), pairs, PANEL).first()["ani_uniform"] > 0.9999
    synteny, calls = api.struct(s.union(twin), pairs, PANEL)
    assert synteny.first()["breakpoint_count"] == 0 and calls.count() == 0


#: Motifs on either strand.
BOTH = [tags.Enzyme("e1", 24, (((8, "CG"), (14, "A")), ((9, "T"), (14, "CG")))), tags.Enzyme("e2", 20, (((6, "GA"), (12, "C")), ((7, "G"), (12, "TC"))))]


def turned(x):
    return x[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def strange(spark):
    """Sequences whose partners differ in strand, repeats or order."""
    r = np.random.default_rng(8)
    text = lambda n: "".join(r.choice(list("ACGT"), n))
    base, block = text(60_000), text(6_000)
    repeats = "".join(text(3_000) + block for _ in range(12)) + text(20_000)
    inverted = base[:20_000] + turned(base[20_000:40_000]) + base[40_000:]
    deleted = base[:25_000] + base[33_000:]
    rows = [("base", base), ("turned", turned(base)), ("rep", repeats), ("rep2", repeats), ("inverted", inverted), ("deleted", deleted), ("far", text(60_000))]
    return spark.createDataFrame([(g, "c", s) for g, s in rows], "genome_id string, contig_id string, seq string")


def test_strands_and_repeats(spark, strange):
    s = api.sketch(strange, BOTH)
    pairs = spark.createDataFrame([("base", "turned"), ("rep", "rep2"), ("base", "far")], "a string, b string")
    lengths = strange.select("genome_id", F.length("seq").alias("length"))
    got = {(r["a"], r["b"]): r for r in api.dist(s, pairs, BOTH, lengths).collect()}
    for pair in (("base", "turned"), ("rep", "rep2")):
        assert got[pair]["ani_gated"] > 0.9999 and got[pair]["flag"] == "ok", pair
    assert got["base", "turned"]["af_query"] > 0.98 and got["base", "turned"]["af_reference"] > 0.98
    assert (got["base", "far"]["flag"], got["base", "far"]["ani_gated"]) == ("BELOW_DETECTION", None)
    assert {(r["a"], r["b"]) for r in api.screen_pairs(s).collect()} >= {("base", "turned"), ("rep", "rep2"), ("base", "inverted")}


def test_structural_calls_from_sequences(spark, strange):
    s = api.sketch(strange, BOTH)
    pairs = spark.createDataFrame([("base", "turned"), ("base", "inverted"), ("base", "deleted"), ("deleted", "base")], "a string, b string")
    synteny, calls = api.struct(s, pairs, BOTH)
    breaks = {(r["a"], r["b"]): r["breakpoint_count"] for r in synteny.collect()}
    got = {(r["a"], r["b"]): (r["sv_type"], r["size"]) for r in calls.collect()}
    assert breaks["base", "turned"] == 0 and ("base", "turned") not in got
    assert breaks["base", "inverted"] == 2 and calls.count() == 3
    kind, size = got["base", "inverted"]
    assert kind == "Inversion" and abs(size - 20_000) < 2_500
    assert got["base", "deleted"][0] == "Insertion" and abs(got["base", "deleted"][1] - 8_000) < 2_000
    assert got["deleted", "base"][0] == "Deletion" and abs(got["deleted", "base"][1] - 8_000) < 2_000
