"""Two-sided screen, fragment identity, batches, chunks, aligned bases and flags against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import assign, chains, metrics, tags
from tagloom.plans import api
from tagloom.sources import sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sides_meet_but_no_pair_within_a_side_is_made(spark):
    r = np.random.default_rng(5)
    sets = {i: set(map(str, r.integers(0, 40, 8))) for i in range(40)} | {i: {"p", "q", "r", "s"} for i in range(40, 70)}
    left = [i for i in sets if i % 3 == 0] + [1]
    right = [i for i in sets if i % 3] + [0]
    frame = lambda ids: spark.createDataFrame([(i, t) for i in ids for t in [*sets[i], *sets[i]]], "id long, tag string")
    want = sorted((a, b, n, n / min(len(sets[a]), len(sets[b]))) for a in left for b in right if a != b and (n := len(sets[a] & sets[b])) >= 3)
    assert rows(tags.screen_sides(frame(left), frame(right), "id", ["tag"])) == want


def test_search_takes_no_database_pair(spark):
    r = np.random.default_rng(6)
    panel = [tags.Enzyme("e1", 24, (((8, "CG"), (14, "A")),))]
    base = r.choice(list("ACGT"), 20_000)
    genomes = {"q": base}
    for i in range(4):
        near = base.copy()
        at = r.choice(len(base), 200 * (i + 1), replace=False)
        near[at] = r.choice(list("ACGT"), len(at))
        genomes[f"d{i}"] = near
    genomes["far"] = r.choice(list("ACGT"), 20_000)
    s = api.sketch(spark.createDataFrame([(g, "c", "".join(x)) for g, x in genomes.items()], "genome_id string, contig_id string, seq string"), panel)
    seen = []
    real = api.dist
    api.dist = lambda both, pairs, *a: seen.append(rows(pairs)) or real(both, pairs, *a)
    try:
        cells = {(c["query"], c["target"]): c["ani_gated"] for c in api.search_matrix(s.where("genome_id = 'q'"), s.where("genome_id <> 'q'"), panel).collect()}
    finally:
        api.dist = real
    assert seen == [[("q", f"d{i}") for i in range(4)]]  # the database is not compared with itself
    assert sorted(cells) == [("q", x) for x in ("d0", "d1", "d2", "d3", "far")] and cells["q", "far"] is None
    told = [cells["q", f"d{i}"] for i in range(4)]
    assert told == sorted(told, reverse=True) and told[0] > 0.99


def test_fragments_are_held_against_the_whole_partner(spark):
    r = np.random.default_rng(7)
    base = "".join(r.choice(list("ACGT"), 8000))
    near = "".join(c if x > 0.01 else "N" if x < 0.002 else "ACGT"[("ACGT".index(c) + 1) % 4] for c, x in zip(base, r.random(8000), strict=True))
    seqs = {"a": base, "b": near[1500:] + near[:1500], "c": base[:600], "d": "", "e": None, "f": base[:3000] + "".join(r.choice(list("ACGT"), 900))}
    pairs = [(x, y) for x in seqs for y in seqs if x != y]

    def plain(x, y, k=16):
        x, y = seqs[x] or "", seqs[y] or ""
        cut = lambda s: {g for g in (s[i : i + k] for i in range(len(s) - k + 1)) if "N" not in g}
        parts, whole = [p for p in (x[i : i + 3000] for i in range(0, len(x), 3000)) if len(p) >= 700], cut(y)
        good = [len(cut(p) & whole) / len(cut(p)) for p in parts if len(cut(p) & whole) >= 50]
        return (len(good), len(good) / len(parts), np.mean(good) ** (1 / k)) if good else (0, 0.0, 0.0)

    got = tags.kmer_identity(spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(list(seqs.items()), "id string, s string"), "id", "s")
    found = {(r["a"], r["b"]): (r["fragments"], r["aligned"], r["identity"]) for r in got.collect()}
    assert len(found) == 30 and found["a", "b"][0] == 3 and found["f", "a"][1] == 0.5
    for p in pairs:
        assert found[p] == pytest.approx(plain(*p), abs=1e-12)


def test_rooms_are_those_of_a_plain_search():
    r = np.random.default_rng(8)
    for most in (5, 50, 500):
        sizes = sorted(r.integers(1, int(1.3 * most), 700).tolist(), reverse=True) + r.integers(1, most, 300).tolist()
        tree, room = assign.Rooms(most), []
        for n in sizes:
            at = next((i for i, x in enumerate(room) if n <= x), len(room))
            room += [most] if at == len(room) else []
            room[at] -= n
            assert tree.put(n) == at


@pytest.mark.parametrize("n, chunks", [(0, 3), (1, 3), (10, 3), (11, 4), (100, 7), (3, 5)])
def test_chunks_of_successive_rows(spark, n, chunks):
    r = np.random.default_rng(n)
    ids = r.permutation(n).tolist()
    df = spark.createDataFrame([(f"k{i:04d}", i) for i in ids], "k string, v long").repartition(3)
    got = [c for _, _, c in sorted(tuple(x) for x in sinks.chunked(df, ["k"], chunks).collect())]
    assert got == [i for i, part in enumerate(np.array_split(np.arange(n), chunks)) for _ in part]


def test_spans_are_moved_out_by_half_the_exact_median_gap(spark):
    span = "a string, q_contig string, q_start long, q_end long"
    tag = "a string, q_contig string, pos long"
    spans = spark.createDataFrame([("p", "c", 100, 200), ("p", "c", 210, 300), ("p", "d", 5, 50), ("p", "lone", 7, 7)], span)
    places = spark.createDataFrame([("p", "c", x) for x in (0, 10, 30, 60, 100)] + [("p", "d", x) for x in (0, 8)] + [("p", "lone", 7)], tag)
    # gaps of c: 10 20 30 40, median 25, half 12; of d: 8, half 4; lone has none
    assert rows(chains.aligned(spans, places, ["a"], "q")) == [("p", (312 - 88) + (54 - 1) + 0)]


def test_flags_that_do_harm(spark):
    data = [("g", 1.0, True), ("g", -3.0, False), ("g", 5.0, None), ("g", None, True), ("h", 2.0, False), ("i", 4.0, True), ("i", 1.0, False)]
    df = spark.createDataFrame(data, "g string, e double, f boolean")
    assert rows(metrics.kept_and_flagged(df, ["g"], F.col("e"), F.col("f"))) == [("g", 4.0, 2, 1.0, 1, True), ("h", 2.0, 1, None, 0, False), ("i", 1.0, 1, 4.0, 1, False)]


@pytest.mark.parametrize("most", [10, 1_000_000])
def test_running_totals_in_ranges(spark, most):
    from tagloom.operators import ranking

    r = np.random.default_rng(2)
    data = [(k, float(v), int(r.integers(1, 5))) for k, n in (("a", 700), ("b", 5), (None, 90)) for v in r.permutation(n)]
    df = spark.createDataFrame(data, "k string, v double, c long")
    got = {(x["k"], x["v"]): x["t"] for x in ranking.keyed_running_total(df, ["k"], "v", "c", "t", most).collect()}
    for k in ("a", "b", None):
        own = sorted((v, c) for g, v, c in data if g == k)
        assert [got[k, v] for v, _ in own] == np.cumsum([c for _, c in own]).tolist()
    one = df.where("k = 'a'").select("v", "c")
    assert sorted(x["t"] for x in ranking.running_total(one, "v", "c", "t", most).collect()) == sorted(got["a", v] for k, v, _ in data if k == "a")


def test_medians_ranks_and_trimmed_means_are_exact(spark):
    from tagloom.operators import ranking

    r = np.random.default_rng(3)
    data = [(k, float(v)) for k, n in (("a", 20_001), ("b", 1000), ("c", 2), ("d", 1), (None, 4)) for v in np.round(r.normal(size=n), 2)] + [("e", None), ("a", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {x["k"]: x["median"] for x in ranking.medians(df, ["k"], "v").collect()}
    assert got == {k: pytest.approx(np.median([v for g, v in data if g == k and v is not None])) for k in ("a", "b", "c", "d", None)}
    sums = {x["k"]: x for x in metrics.consensus(df.where("k IN ('b', 'c')").withColumns({"w": F.lit(1.0), "t": F.lit(0.0)}), "k", "v", "w", "t").collect()}
    own = sorted(v for g, v in data if g == "b")
    assert sums["b"]["trimmed"] == pytest.approx(np.mean(own[100:-100]), abs=1e-6) and sums["b"]["median"] == pytest.approx(np.median(own), abs=1e-6)


def test_only_the_middle_is_counted_by_value(spark, monkeypatch):
    """of many distinct values only those of the buckets in the middle are grouped by value."""
    from tagloom.operators import ranking
    from tagloom.operators.features import Feature, FeatureSet

    seen = []
    inner = ranking.middles
    counting = lambda values, keys: seen.append(values.count()) or inner(values, keys)
    monkeypatch.setattr(ranking, "middles", counting)
    monkeypatch.setattr(metrics, "middles", counting)
    r = np.random.default_rng(5)
    x = np.r_[r.normal(0, 30, 4_000), r.lognormal(3, 2, 2_001), [0.0, -0.0, 1e300, -1e300]]
    df = spark.createDataFrame([(float(v), "p" if i % 3 else "q", None if i % 7 else float(i)) for i, v in enumerate(x)], "a double, d string, gap double").withColumn("truth", F.lit(0.5))
    built = FeatureSet((Feature("a", "a"), Feature("g", "gap"), Feature("z", "gap", fill=0.0)), "a", "truth").learn(df)
    assert built.features[0].median == np.median(x) and built.features[1].median == np.median(np.arange(0, len(x), 7)) and built.features[2].median is None
    rows = {(g["dim"], g["value"]): g for g in metrics.metric_stack(df, ["d"], ["a"], "truth").collect()}
    d = np.where(np.arange(len(x)) % 3, "p", "q")
    for key, on in ((("overall", "all"), d != ""), (("d", "p"), d == "p"), (("d", "q"), d == "q")):
        e = np.abs(x[on] - 0.5)
        assert rows[key]["n"] == len(e) and rows[key]["median_abs_err"] == round(float(np.median(e)), 6) and rows[key]["within_1_0"] == round(float(np.mean(e <= 1)), 6)
    assert len(seen) == 2 and max(seen) < len(x) / 20


def test_buckets_rise_with_values(spark):
    from tagloom.operators import ranking

    values = [float("-inf"), -1e9, -3.0, -1e-9, 0.0, 1e-12, 0.001, 2.0, 2.5, 1e30, float("inf"), float("nan")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").orderBy("v").select(ranking.bucket(F.col("v"))).collect()]
    assert got == sorted(got) and len(set(got)) >= 8


def test_two_sides_join_in_blocks(spark, monkeypatch):
    """a tag of many classes and a class of many copies are in several blocks, and no pair is lost or made twice."""
    from tagloom.operators import tags

    monkeypatch.setattr(tags, "BLOCK", 3)
    sets = {f"{side}{i}": {"hot1", "hot2", "hot3", *([] if i < 10 else [f"t{i}"])} for side in "lr" for i in range(20)}
    frame = lambda side: spark.createDataFrame([(n, t) for n, own in sets.items() if n[0] == side for t in own], "id string, tag string")
    found = tags.screen_sides(frame("l"), frame("r"), "id", ["tag"])
    got = sorted((x["a"], x["b"], x["shared"]) for x in found.collect())
    assert got == sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a[0] == "l" and b[0] == "r")
    assert "_i" in found._jdf.queryExecution().optimizedPlan().toString() and "_at" in found._jdf.queryExecution().optimizedPlan().toString()
