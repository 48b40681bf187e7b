import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import columns as C
from tagloom.functions.likelihood import Strata, binomial_upper, fit_all, fit_pairs
from tagloom.operators import calibrate, chains, graph, intervals, joins, metrics, ranking, tags
from tagloom.sources import readers, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_golden_pair():
    # One published mosaic pair: counts by enzyme, and the estimates that were printed for it.
    k, b = np.array([[32, 27, 32, 27]]), np.array([[26, 20, 26, 21]])
    n = np.array([[[789, 369, 200], [231, 108, 34], [1073, 588, 295], [298, 152, 59]]])
    f = {c: float(v[0]) for c, v in fit_all(Strata(k, b, n, np.array([[548, 162, 843, 265]]))).items()}
    expected = {"ani_uniform": 0.966034, "ani": 0.956253, "retention": 0.7686, "ani_from_loss": 0.957167, "ani_from_hist": 0.974441, "std_err": 0.0005032, "enzyme_spread": 0.008044}
    for c, v in expected.items():
        assert f[c] == pytest.approx(v, abs=5e-5), c
    assert f["het_shape"] == pytest.approx(1.154, abs=2e-3) and f["enzyme_chi2"] == pytest.approx(6.26, abs=0.01)
    assert f["n_tags"] == 6014 and f["supported"]


# Six more published pairs, as found with 0, 1 and 2 differences and not found for AlfI, AloI, BcgI and FalI, and what was printed for them:
# ani_uniform, ani, retention, ani_from_loss, ani_from_hist.
PUBLISHED = [
    ([80, 69, 62, 735, 38, 47, 27, 279, 161, 131, 143, 1704, 48, 41, 31, 235], (89.7241, 82.4991, 0.2687, 88.9275, 95.0472)),
    ([23, 18, 20, 201, 9, 10, 9, 90, 30, 40, 29, 434, 66, 76, 69, 532], (89.3795, 84.5477, 0.2753, 88.6654, 94.0587)),
    ([23, 21, 22, 201, 10, 8, 5, 83, 34, 33, 29, 447, 60, 77, 58, 522], (89.2896, 83.4329, 0.2698, 88.5058, 94.3902)),
    ([374, 512, 331, 652, 125, 136, 66, 167, 534, 764, 523, 999, 169, 195, 112, 285], (95.0143, 95.0143, 0.6404, 95.0849, 94.8768)),
    ([1947, 44, 1, 15, 502, 13, 0, 5, 2804, 80, 0, 20, 711, 11, 2, 8], (99.8935, 99.8935, 0.9935, 99.8717, 99.8988)),
    ([889, 384, 109, 465, 249, 74, 19, 121, 1345, 480, 146, 700, 356, 109, 35, 244], (97.4294, 96.0217, 0.8317, 96.1509, 98.3162)),
]


@pytest.mark.parametrize("counts, printed", PUBLISHED)
def test_published_pairs(counts, printed):
    x = np.array(counts, float).reshape(1, 4, 4)
    f = fit_all(Strata(np.array([[32, 27, 32, 27]]), np.array([[26, 20, 26, 21]]), x[..., :3], x[..., 3]))
    for name, value in zip(("ani_uniform", "ani", "retention", "ani_from_loss", "ani_from_hist"), printed, strict=True):
        assert f[name][0] * (1 if name == "retention" else 100) == pytest.approx(value, abs=6e-5), name


def test_derivatives_are_those_of_the_likelihood():
    from tagloom.functions.likelihood import _gamma_slopes

    r = np.random.default_rng(1)
    shape = (5, 3)
    k, b = np.full(shape, 32.0), r.integers(18, 24, shape).astype(float)
    s = Strata(k, b, r.integers(1, 300, (*shape, 3)).astype(float), r.integers(1, 300, shape).astype(float), r.integers(0, 3, shape), r.integers(0, 3, shape))
    a, e = r.uniform(0.7, 0.99, 5), 1e-6
    for renormalised in (False, True):
        f = lambda x: -s.loss(s.log_found(x), renormalised)  # noqa: B023, E731
        first, second = s.score(a, renormalised)
        assert np.allclose((f(a + e) - f(a - e)) / (2 * e), first, rtol=1e-5, atol=1e-2)
        assert np.allclose((s.score(a + e, renormalised)[0] - s.score(a - e, renormalised)[0]) / (2 * e), second, rtol=1e-5)
    d, q = r.uniform(0.01, 0.3, 5), r.uniform(0.2, 50, 5)
    g = lambda d, q: -s.loss(s.log_found_gamma(d, q))
    by_d, by_d2, by_q = _gamma_slopes(s, d, q)
    up, down = np.exp(e), np.exp(-e)
    assert np.allclose((g(d * up, q) - g(d * down, q)) / (2 * e), by_d, rtol=1e-4, atol=1e-2)
    assert np.allclose((g(d, q * up) - g(d, q * down)) / (2 * e), by_q, rtol=1e-4, atol=1e-2)
    assert np.allclose((_gamma_slopes(s, d * up, q)[0] - _gamma_slopes(s, d * down, q)[0]) / (2 * e), by_d2, rtol=1e-4, atol=1e-2)


@pytest.mark.parametrize("k, n", [(0, 7), (1, 7), (6, 7), (50, 120), (999, 1000), (3, 2000)])
def test_binomial_limit_is_exact(k, n):
    p = float(binomial_upper(np.array([k]), np.array([n]))[0])
    tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
    assert tail == pytest.approx(0.05, rel=1e-6)


def test_binomial_limit_of_many_trials():
    p = binomial_upper(np.array([500_000, 10, 99_999_990]), np.array([1_000_000, 100_000_000, 100_000_000]))
    assert p[0] == pytest.approx(0.5 + 1.6449 * 0.0005, abs=1e-6) and p[1] == pytest.approx(16.96e-8, rel=1e-3) and p[2] < 1


def drawn_sites(seed, d2, d3, a=None, d=None, shape=None, tags=40_000):
    """Tags of 10 site and 22 body places, site places changed base by base; rates by tag if d is given."""
    r = np.random.default_rng(seed)
    keep = np.exp(-r.gamma(shape, d / shape, tags)) if d else np.full(tags, a)
    change = 1 - keep[:, None]
    body = (r.random((tags, 22)) < change).sum(1)
    exact = (r.random((tags, 10 - d2 - d3)) < change).any(1)
    u2, u3 = r.random((tags, d2)) / change, r.random((tags, d3)) / change
    lost = exact | ((u2 >= 1 / 3) & (u2 < 1)).any(1) | ((u3 >= 2 / 3) & (u3 < 1)).any(1)
    m = body + (u2 < 1 / 3).sum(1) + (u3 < 2 / 3).sum(1)
    found = [int(((m == i) & ~lost).sum()) for i in range(3)]
    one = np.ones((1, 1))
    return Strata(32 * one, 22 * one, np.array([[found]], float), np.array([[tags - sum(found)]], float), d2 * one, d3 * one)


@pytest.mark.parametrize("d2, d3", [(0, 0), (2, 0), (0, 3), (2, 1)])
def test_drawn_site_classes_are_recovered(d2, d3):
    for a in (0.9, 0.97, 0.995):
        draws = [drawn_sites(seed, d2, d3, a, tags=10_000) for seed in range(9)]
        f = fit_all(Strata(*(np.concatenate([getattr(x, c) for x in draws]) for c in ("k", "b", "n", "miss", "d2", "d3"))))
        off = (f["ani_uniform"] - a) / f["std_err"]
        assert np.abs(off).max() < 4 and abs(off.mean()) < 1  # in standard errors
    mixed = drawn_sites(9, d2, d3, d=0.08, shape=1.5)
    f = fit_all(mixed)
    assert f["supported"][0] and f["ani"][0] == pytest.approx((1 + 0.08 / 1.5) ** -1.5, abs=0.003)


def test_site_columns_of_some_pairs_leave_the_others_as_they_are(spark):
    plain = [("p", "e1", 32, 26, 50, 10, 2, 20), ("p", "e2", 27, 20, 40, 9, 1, 30), ("q", "e1", 32, 26, 90, 4, 0, 5)]
    schema = "pair string, enzyme string, tag_len int, body_len int, n0 long, n1 long, n2 long, n_miss long"
    with_sites = [(*r, 0, 0) for r in plain] + [("r", "e1", 32, 22, 70, 12, 3, 9, 2, 1), ("s", "e1", 32, 22, 70, 12, 3, 9, None, None)]
    want = {r["pair"]: r for r in fit_pairs(spark.createDataFrame(plain, schema), ["pair"]).collect()}
    got = {r["pair"]: r for r in fit_pairs(spark.createDataFrame(with_sites, schema + ", d2 int, d3 int"), ["pair"]).collect()}
    for pair, row in want.items():
        for a, b in zip(row, got[pair], strict=True):
            assert a == b or a == pytest.approx(b, rel=1e-6, abs=1e-9)
    assert got["r"]["ani_uniform"] != pytest.approx(got["s"]["ani_uniform"], abs=1e-6)


def test_binomial_limit_ends():
    u = binomial_upper(np.array([0, 10, 0]), np.array([20, 10, 0]))
    assert u[0] == pytest.approx(1 - 0.05 ** (1 / 20)) and u[1] == 1 and math.isnan(u[2])


def test_fits_without_tags_are_null(spark):
    df = spark.createDataFrame([("p", "e", 32, 26, 0, 0, 0, 0)], "pair string, enzyme string, tag_len int, body_len int, n0 int, n1 int, n2 int, n_miss int")
    r = fit_pairs(df, ["pair"]).first()
    assert r["n_tags"] == 0 and r["ani"] is None and r["ani_upper95"] is None


def test_gate_boundary(spark):
    df = spark.createDataFrame([(95.0, 90.0, 1.0, 95.0), (95.1, 90.0, 1.0, 95.0), (1.0, 1.0, float("inf"), 9.0), (float("nan"), 1.0, 1.0, 9.0), (1.0, 1.0, 1.0, float("nan"))], "loss double, hist double, shape double, ani double")
    g = [r[0] for r in df.select(C.gate(*map(F.col, ("loss", "hist", "shape", "ani")))).collect()]
    assert g == ["gamma", "uniform_fallback", "uniform", "gamma", "none"]


def test_hamming_and_packing(spark):
    df = spark.createDataFrame([("ACGTA", "GCGTC"), ("AAAAA", "TTTTT")], "a string, b string")
    r = rows(df.select(C.hamming(F.col("a"), F.col("b")), C.packed_distance(C.packed(F.col("a")), C.packed(F.col("b"))).cast("int")))
    assert r == [(2, 2), (5, 5)]


def test_digest_finds_overlaps_and_ends(spark):
    e = tags.Enzyme("x", 6, (((1, "a"), (3, "a")),))
    text = "xaxaxaxaxx"
    expected = [(p, text[p : p + 6]) for p in range(len(text) - 5) if text[p + 1] == "a" and text[p + 3] == "a"]
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, s string")
    assert [(r["pos"], r["tag"]) for r in tags.digest(df, ["id"], "s", [e]).collect()] == expected
    assert sorted(r["tag"] for r in tags.digest_strings(df, "id", "s", e).collect()) == sorted(t for _, t in expected)


def test_tolerant_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("ACGT"), 12)) for _ in range(40)} | {"ACGTACGTACGT", "ACGTACGTACGA", "TCGTACGTACGA"})
    df = spark.createDataFrame([(w,) for w in words], "tag string")
    found = {(r["a_tag"], r["b_tag"], r["distance"]) for r in tags.tolerant_pairs(df, df, [], "tag", 2, 12).collect()}
    dist = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    assert found == {(a, b, dist(a, b)) for a in words for b in words if dist(a, b) <= 2}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 10), (10, 9)], "a long, b long")
    assert rows(graph.connected_components(e)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 7), (8, 8), (9, 8), (10, 8)]
    assert graph.connected_components(e.limit(0)).count() == 0


def test_intervals(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 10, 12), (1, 5, 6), (1, 20, 25), (2, 3, 3)], "k int, s long, e long")
    assert rows(intervals.union_length(df, ["k"], "s", "e")) == [(1, 17, 2)]
    assert [tuple(r)[2:] for r in intervals.islands(df.where("k = 1"), ["k"], "s", "e", 5).orderBy("island").collect()] == [(3, 0, 12), (1, 20, 25)]


def test_multiset_difference(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "i int, t string")
    b = spark.createDataFrame([("x",), ("z",)], "t string")
    assert rows(intervals.multiset_difference(a, b, ["t"], ["i"]).select("i", "t")) == [(2, "x"), (3, "y")]


def test_top_hit_ties_and_nulls(spark):
    df = spark.createDataFrame([("q", "b", 1.0), ("q", "a", 1.0), ("q", "c", None), ("r", "c", 0.5)], "query string, target string, ani double")
    assert rows(ranking.top_hit(df, "query", "target", "ani")) == [("q", "a", 1.0), ("r", "c", 0.5)]


def test_running_total(spark):
    df = spark.range(1, 101).select(F.col("id").alias("k"), F.lit(2).alias("v"))
    assert {r["k"]: r["s"] for r in ranking.running_total(df, "k", "v", "s", 7).collect()} == {k: 2 * k for k in range(1, 101)}


def test_round_robin_caps(spark):
    df = spark.createDataFrame([("b", "x", "e1", 1), ("b", "x", "e1", 2), ("b", "x", "e2", 3), ("b", "y", "e1", 4)], "band string, bin string, ent string, o int")
    got = [(r["bin"], r["o"]) for r in ranking.round_robin_capped(df, "band", "bin", ["ent"], "o", 3, 1).collect()]
    assert got == [("x", 1), ("x", 3)]


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(0)
    p, t = rng.normal(size=50), rng.normal(size=50)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(p, t, strict=True)] + [("g", None, 1.0)], "g string, p double, t double")
    r = metrics.grouped_errors(df, "g", "p", "t").where("g = 'g'").first()
    assert (r["n"], r["mae"]) == (50, pytest.approx(np.abs(p - t).mean(), abs=1e-6)) and r["r"] == pytest.approx(np.corrcoef(p, t)[0, 1], abs=1e-6)


def test_chain_of_inverted_block(spark):
    q = list(range(0, 300, 10))
    r = q[:10] + q[19:9:-1] + q[20:]
    data = [("p", "c", "d", 10 <= i < 20, a, b) for i, (a, b) in enumerate(zip(q, r, strict=True))]
    df = spark.createDataFrame(data, "pair string, q_contig string, r_contig string, reverse boolean, q_pos long, r_pos long")
    c = chains.chains(df, ["pair"])
    s = chains.synteny(c, ["pair"]).first()
    assert s["n_chains"] >= 2 and s["breakpoint_count"] == s["n_chains"] - 1
    assert "Inversion" in {x["sv_type"] for x in chains.structural_calls(c, ["pair"], 1000).collect()}


def test_ridge_matches_normal_equations(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2)) * [3, 0.5] + [1, 2]
    y = x @ [0.5, -2] + 1 + rng.normal(size=200) * 0.01
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")
    med = calibrate.medians_of(df, ["a", "b"])
    m = calibrate.sums(df, ["a", "b"], "y", [], med)[()]
    model = calibrate.solve(m, ["a", "b"], med, 0.5)
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose(model.coefficients, np.linalg.solve(z.T @ z + 0.5 * np.eye(2), z.T @ (y - y.mean())))
    pred = np.array([r[0] for r in df.select(model.column()).collect()])
    assert calibrate.squared_error(m, model) == pytest.approx(((pred - y) ** 2).sum(), rel=1e-6)


def test_readers(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">c1 first\nACGT\nacg\n>c2\nTT\n")
    assert [(r["contig_id"], r["seq"]) for r in readers.read_fasta(spark, str(tmp_path / "g.fa")).orderBy("record").collect()] == [("c1", "ACGTACG"), ("c2", "TT")]
    (tmp_path / "q__r.strata.tsv").write_text("query\treference\tenzyme\ttag_len\tbody_len\tn_miss\thist\n\t\tAlfI\t32\t26\t5\t1,2\n")
    assert tuple(readers.read_strata(spark, str(tmp_path / "q__r.strata.tsv")).first()) == ("q", "r", "AlfI", 32, 26, 1, 2, 0, 5)
    (tmp_path / "t.tsv").write_text("query\treference\tanim_ani\tanim_aligned_query\tanim_aligned_ref\na\tb\tNA\tnan\t1.5\n")
    from tagloom.schemas import TRUTH

    assert tuple(readers.read_tsv(spark, str(tmp_path / "t.tsv"), TRUTH).first()) == ("a", "b", None, None, 1.5)
    (tmp_path / "x.paf").write_text("q\t10\t0\t9\t+\tr\t20\t1\t9\t8\t9\t60\tNM:i:1\tcg:Z:8=1X\n")
    r = readers.read_paf(spark, str(tmp_path / "x.paf")).first()
    assert (r["q"], r["nmatch"], r["cigar"], r["nm"]) == ("q", 8, "8=1X", 1)


def test_resume(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c")], "k int, v string")
    assert rows(sinks.merge_results(old, new, ["k"])) == [(1, "a"), (2, "c")]
    assert rows(sinks.remaining(old, new, ["k"])) == [(1, "a")]


def test_pairs_without_order(spark):
    df = spark.createDataFrame([("b", "a", 1), ("a", "a", 2)], "x string, y string, n int")
    assert rows(joins.unordered(df, "x", "y")) == [("a", "b", 1)]
    ex = spark.createDataFrame([("a", "b")], "x string, y string")
    assert joins.exclude_pairs(df, ex, "x", "y").count() == 1


def test_round_robin_caps_behind_one_entity_of_many_rows(spark):
    rows = [("b", "p", 7, o) for o in range(5000)] + [("b", "p", 100 + o, 5000 + o) for o in range(50)] + [("b", "q", 7, 9000), ("b", "q", 300, 9001)]
    got = ranking.round_robin_capped(spark.createDataFrame(rows, "band string, bin string, ent long, o long").repartition(5), "band", "bin", ["ent"], "o", 10, 2).collect()
    assert [r["o"] for r in got] == [0, 9000, 5000, 9001, *range(5001, 5007)]


@pytest.mark.parametrize("seed", range(3))
def test_round_robin_caps_two_columns(spark, seed):
    r = np.random.default_rng(seed)
    rows = [("b", "pq"[o % 2], 1 if o < 2000 else int(r.integers(1, 30)), int(r.integers(1, 40)) if o % 3 else 2, o) for o in range(3000)]
    df = spark.createDataFrame(rows, "band string, bin string, e long, f long, o long").repartition(4)
    used, out, queues = {}, [], [[x for x in rows if x[1] == b] for b in "pq"]
    while len(out) < 12 and any(queues):
        for q in queues:
            while q and len(out) < 12:
                x = q.pop(0)
                if all(used.get(n, 0) < 2 for n in {x[2], x[3]}):
                    used |= {n: used.get(n, 0) + 1 for n in {x[2], x[3]}}
                    out.append(x[4])
                    break
    assert [x["o"] for x in ranking.round_robin_capped(df, "band", "bin", ["e", "f"], "o", 12, 2).collect()] == out


def test_screen_keeps_keys_of_many_carriers(spark):
    r = np.random.default_rng(4)
    sets = {i: {"p", "q", "r", "s"} for i in range(60)} | {i: {"p", "q", "r", *map(str, r.integers(0, 30, 5))} for i in range(60, 75)} | {90: {"p", "z"}}
    df = spark.createDataFrame([(i, t) for i, s in sets.items() for t in [*s, *s]], "id long, tag string").repartition(3)
    want = [(a, b, n, n / min(len(sets[a]), len(sets[b]))) for a in sets for b in sets if a < b and (n := len(sets[a] & sets[b])) >= 3]
    assert rows(tags.screen(df, "id", ["tag"])) == sorted(want)


def test_site_classes():
    from tagloom.functions.likelihood import SiteStrata, Strata

    one = np.ones((1, 1))
    n, miss = np.array([[[50.0, 10.0, 2.0]]]), np.array([[20.0]])
    a = np.array([0.97])
    plain, classed = Strata(32 * one, 26 * one, n, miss), SiteStrata(6 * one, 26 * one, 0 * one, 0 * one, n, miss)
    assert np.allclose(plain.log_found(a), classed.log_found(a))
    found = SiteStrata(4 * one, 3 * one, 2 * one, 1 * one, np.zeros((1, 1, 9)), miss)
    p = np.exp(found.log_found(a)).sum()
    assert p == pytest.approx(0.97**4 * (0.97 + 0.03 / 3) ** 2 * (0.97 + 0.03 * 2 / 3))


def test_boosted_trees_as_columns(spark):
    from tagloom.operators import calibrate

    r = np.random.default_rng(3)
    rows = [(float(a), float(b) if i % 9 else None, float(3 * (a > 0.4) + 2 * (b > 0.7))) for i, (a, b) in enumerate(r.random((400, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    model = calibrate.boosted(df, ["a", "b"], "y", [(1, 2, 0.5), (2, 8, 0.5)], 2)
    assert model["depth"] == 2
    out = df.select("y", calibrate.boosted_column(model).alias("p")).collect()
    assert np.mean([(x["y"] - x["p"]) ** 2 for x in out]) < 0.2 * np.var([x["y"] for x in out])
    assert calibrate.prefer(1.0, 0.99) == "B" and calibrate.prefer(1.0, 0.999) == "A"


def test_cv_over_seeds_and_logistic(spark):
    from tagloom.operators import calibrate, mixture

    rows = [(float(i), 2.0 * i + 1 + (i % 3 - 1) * 0.1) for i in range(300)]
    got = calibrate.multi_seed_cv(spark.createDataFrame(rows, "x double, y double"), ["x"], "y", [1, 2], 5, 0.01).collect()
    assert {r["seed"] for r in got} == {1, 2} and all(r["n"] == 300 and r["mae"] < 0.2 for r in got)
    x = np.linspace(0, 10, 9)
    assert mixture.fit_logistic([(v, 1 / (1 + np.exp(-(v - 4) / 1.5)), 5.0) for v in x]) == pytest.approx((4, 1.5), rel=1e-3)


def test_exact_quantiles_with_null_keys(spark):
    from tagloom.operators import ranking

    r = np.random.default_rng(1)
    rows = [(k, float(v) if v < 90 else None) for k in ("a", "b", None) for v in r.integers(0, 100, 200)]
    got = {x["k"]: x["quantiles"] for x in ranking.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0, 0.25, 0.5, 1]).collect()}
    for k in ("a", "b", None):
        assert got[k] == pytest.approx(np.quantile([v for q, v in rows if q == k and v is not None], [0, 0.25, 0.5, 1]).tolist())
    assert ranking.quantiles(spark.createDataFrame([], "k string, v double"), [], "v", [0.5]).collect() == []
