"""Short contigs without a chain: placed by unique anchors, counted with their tails."""

import numpy as np
import pytest

from tagloom.operators import chains, tags
from tagloom.plans import api

PANEL = [tags.Enzyme("e1", 24, (((8, "CG"), (14, "A")),)), tags.Enzyme("e2", 20, (((6, "GA"), (12, "CG")),))]


def changed(r, x, share):
    out = x.copy()
    at = np.flatnonzero(r.random(len(x)) < share)
    out[at] = [{"A": "C", "C": "G", "G": "T", "T": "A"}[c] for c in out[at]]
    return out


@pytest.fixture(scope="module")
def results(spark):
    """A genome against its partner, whole and in pieces that are too short for many chains, half of them turned round."""
    r = np.random.default_rng(12)
    base = r.choice(list("ACGT"), 60_000)
    near = np.concatenate([changed(r, part, share) for part, share in zip(np.split(base, 6), (0.005, 0.03, 0.01, 0.05, 0.002, 0.02), strict=True)])
    turned = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    cut = ["".join(near[i : i + 250]) for i in range(0, 60_000, 250)]
    rows = [("whole", "c", "".join(near)), ("ref", "c", "".join(base))] + [("pieces", f"c{i}", turned(x) if i % 2 else x) for i, x in enumerate(cut)]
    both = [tags.Enzyme(e.name, e.length, e.patterns + tuple(tuple(sorted((e.length - o - len(m), m[::-1].translate(str.maketrans("ACGT", "TGCA"))) for o, m in p)) for p in e.patterns)) for e in PANEL]
    s = api.sketch(spark.createDataFrame(rows, "genome_id string, contig_id string, seq string"), both)
    pairs = spark.createDataFrame([("whole", "ref"), ("pieces", "ref")], "a string, b string")
    lengths = spark.createDataFrame([(g, 60_000) for g in ("whole", "pieces", "ref")], "genome_id string, length long")
    return {on: {x["a"]: x for x in api.dist(s, pairs, both, lengths, on).collect()} for on in (True, False)}


def test_a_broken_genome_keeps_its_identity(results):
    whole, pieces, without = results[True]["whole"], results[True]["pieces"], results[False]["pieces"]
    assert tuple(results[False]["whole"])[:2] == tuple(whole)[:2] and results[False]["whole"]["ani_gated"] == pytest.approx(whole["ani_gated"], abs=1e-12)  # one long contig: nothing to place
    assert abs(pieces["ani_gated"] - whole["ani_gated"]) < 0.002
    assert abs(pieces["ani_gated"] - whole["ani_gated"]) < abs(without["ani_gated"] - whole["ani_gated"])
    assert pieces["n_tags"] > without["n_tags"] and pieces["af_query"] > without["af_query"]
    assert pieces["n_chains"] == without["n_chains"]  # order is told by chains only


def brute_place(anchors):
    """The largest subset of unique anchors in one order, by trying them all."""
    best = None
    places = sorted({(a["r_contig"], a["reverse"]) for a in anchors})
    for contig, reverse in places:
        own = sorted((a for a in anchors if (a["r_contig"], a["reverse"]) == (contig, reverse) and a["unique"]), key=lambda a: (a["q_pos"], a["r_pos"]))
        for mask in range(1, 1 << len(own)):
            sub = [a for i, a in enumerate(own) if mask >> i & 1]
            y = [-a["r_pos"] if reverse else a["r_pos"] for a in sub]
            good = all(a["q_pos"] < b["q_pos"] for a, b in zip(sub, sub[1:], strict=False)) and all(a < b for a, b in zip(y, y[1:], strict=False))
            if len(sub) >= 2 and good and min(a["distance"] for a in sub) <= 1:
                key = (-len(sub), contig, reverse)
                best = key if best is None or key[0] < best[0] else best
    return best


def test_placing_equals_trying_all_subsets():
    r = np.random.default_rng(3)
    for _ in range(60):
        n = int(r.integers(0, 9))
        q = np.sort(r.choice(600, n, replace=False))
        anchors = [{"q_pos": int(p), "r_pos": int(1000 + p + (0 if r.random() < 0.7 else r.integers(-40, 40))), "r_contig": str(r.choice(["x", "y"])), "reverse": bool(r.random() < 0.2), "distance": int(r.integers(0, 3)), "unique": bool(r.random() < 0.85)} for p in q]
        col = lambda c, kind: np.array([a[c] for a in anchors], kind)  # noqa: B023, E731
        at = chains.place_contig(col("q_pos", int), col("r_pos", int), col("reverse", bool), col("r_contig", object), col("distance", int), col("unique", bool))
        want = brute_place(anchors)
        assert (at is None) == (want is None)
        if at is not None:
            assert len(at) == -want[0] and all(anchors[i]["unique"] for i in at)


def test_fewer_mismatches_win_ties_and_two_mismatches_alone_place_nothing():
    q, r = np.array([10, 10, 90, 90]), np.array([110, 510, 190, 590])
    same = dict(reverse=np.zeros(4, bool), unique=np.ones(4, bool))
    where = np.array(["x", "y", "x", "y"], object)
    assert chains.place_contig(q, r, r_contig=where, distance=np.array([2, 1, 1, 1]), **same).tolist() == [1, 3]
    assert chains.place_contig(q, r, r_contig=where, distance=np.array([1, 1, 1, 1]), **same).tolist() == [0, 2]  # then the first contig
    assert chains.place_contig(q, r, r_contig=where, distance=np.array([2, 2, 2, 2]), **same) is None


def test_tails_go_to_the_next_anchor_within_reach(spark):
    schema = "a string, b string, q_contig string, r_contig string, reverse boolean, chain int, n_anchors long, q_start long, q_end long, r_start long, r_end long, hits array<struct<enzyme:string,q_pos:long,distance:int>>"
    placed = [("g", "h", "c1", "r", False, -1, 2, 100, 200, 1100, 1200, []), ("g", "h", "c2", "r", True, -1, 2, 100, 200, 5100, 5200, []), ("g", "h", "c3", "s", False, -1, 2, 30, 60, 30, 60, [])]
    rows = [("g", "h", "d", "r", False, 0, 9, 0, 900, 100, 1000, []), ("g", "h", "d", "r", False, 1, 9, 0, 900, 5250, 5900, [])]
    reach = spark.createDataFrame([("g", "h", 100.0)], "a string, b string, reach double")
    got = {r["q_contig"]: (r["q_start"], r["q_end"]) for r in chains.with_tails(spark.createDataFrame(placed, schema), spark.createDataFrame(rows, schema), ["a", "b"], reach).collect()}
    # c1: a chain ends 100 below, nothing near above; c2 is turned, so the chain 50 above lies to its left
    assert got == {"c1": (1, 200), "c2": (51, 200), "c3": (30, 60)}


def test_votes_need_two_unique_anchors(spark):
    rows = [("g", "h", "c", "r", False, 10, 10, "e", 2, True), ("g", "h", "c", "r", False, 20, 20, "e", 1, True), ("g", "h", "c", "r", False, 30, 30, "e", 0, False), ("g", "h", "c", "s", False, 10, 10, "e", 0, True)]
    df = spark.createDataFrame(rows, "a string, b string, q_contig string, r_contig string, reverse boolean, q_pos long, r_pos long, enzyme string, distance int, unique boolean")
    assert [tuple(r) for r in chains.votes(df, ["a", "b"]).collect()] == [("g", "h", "c", "r", False, 2, 3, 1)]
