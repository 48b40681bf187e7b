import numpy as np
import pytest

from tagloom.functions import likelihood
from tagloom.functions.likelihood import Strata
from tagloom.operators import mixture
from tagloom.operators.mixture import GRID, Tilt

GEOMETRY = ((32, 26), (27, 20), (32, 26), (27, 21))


def expected(vs, ws, tags=(3000, 1000, 4000, 2500), tilt=None):
    """Strata of the expected counts of components at divergences vs, one pair."""
    k, b = (np.array([[g[i] for g in GEOMETRY]], float) for i in (0, 1))
    empty = Strata(k, b, np.zeros((1, 4, 3)), np.zeros((1, 4)))
    w = np.array(ws) * (tilt.coverage(np.array(vs)) if tilt else 1)
    p = (mixture.outcomes(empty, np.array([vs])) * (w / w.sum())).sum(-1).reshape(1, 4, 4) * np.array(tags)[None, :, None]
    return Strata(k, b, p[..., :3], p[..., 3])


def drawn(seed, pairs):
    r = np.random.default_rng(seed)
    parts = []
    for _ in range(pairs):
        e = expected(r.uniform(0.002, 0.4, 2), (w := r.uniform(0.2, 0.8), 1 - w))
        n = np.stack([r.multinomial(int(t), p / p.sum()) for t, p in zip(e.total[0], np.concatenate([e.n, e.miss[..., None]], -1)[0], strict=True)])
        parts.append((e.k[0], e.b[0], n[:, :3], n[:, 3]))
    return Strata(*(np.stack(x).astype(float) for x in zip(*parts, strict=True)))


def test_mixture_recovers_two_rates():
    k, b = np.array([[32.0]]), np.array([[26.0]])
    p = [np.exp(Strata(k, b, np.zeros((1, 1, 3)), np.zeros((1, 1))).log_found(np.array([a])))[0, 0] for a in (0.999, 0.93)]
    found = 5000 * p[0] + 5000 * p[1]
    s = Strata(k, b, found[None, None, :], np.array([[10_000 - found.sum()]]))
    w, loglik = mixture.fit(s)
    assert w.sum() == pytest.approx(1) and np.isfinite(loglik[0])
    assert w[0][mixture.GRID < 0.01].sum() == pytest.approx(0.5, abs=0.05)


def test_grid_with_tilt_and_aligned_fraction():
    s = drawn(1, 6)
    free, free_loglik = mixture.fit(s)
    flat, flat_loglik = mixture.fit(s, tilt=Tilt(middle=1e9))  # covers all alike
    assert np.allclose(free, flat, atol=1e-9) and np.allclose(free_loglik, flat_loglik)
    tilted, tilted_loglik = mixture.fit(s, tilt=Tilt())
    assert np.allclose(tilted_loglik, free_loglik)  # the sample's weights are the same, the genome's are not
    assert (tilted @ GRID > free @ GRID).all()
    cover = tilted @ Tilt().coverage(GRID)
    want = np.array([0.5, 0.6, 0.7, 0.8, np.nan, 2.0])
    bound, bound_loglik = mixture.fit(s, tilt=Tilt(), aligned=want)
    got = bound @ Tilt().coverage(GRID)
    assert np.allclose(got[:4], want[:4], atol=1e-6)
    assert got[4] == pytest.approx(cover[4]) and got[5] <= Tilt().coverage(np.zeros(1))[0]
    assert (bound_loglik <= free_loglik + 0.5).all() and np.allclose(bound.sum(1), 1) and (bound >= 0).all()
    same, same_loglik = mixture.fit(s, tilt=Tilt(), aligned=cover)
    assert np.allclose(same_loglik, free_loglik, atol=1e-2)  # its own coverage costs nothing


def test_constrained_weights_are_the_best_of_a_dense_search():
    """Three grid points and one constraint leave one free weight."""
    s, grid = expected([0.01, 0.3], [0.6, 0.4]), np.array([0.005, 0.08, 0.35])
    w, loglik = mixture.fit(s, grid, 20_000, 1e-15, Tilt(), np.array([0.75]))
    pi = Tilt().coverage(grid)
    best = -np.inf
    for first in np.linspace(0, 1, 4001):
        # w0 + w1 + w2 = 1 and pi w = 0.75
        w2 = (0.75 - first * pi[0] - (1 - first) * pi[1]) / (pi[2] - pi[1])
        x = np.array([first, 1 - first - w2, w2])
        if (x >= 0).all():
            u = x * pi / (x * pi).sum()
            best = max(best, mixture.log_likelihood(mixture.counts(s), (mixture.kernel(s, grid) * u).sum(-1))[0])
    assert loglik[0] == pytest.approx(best, abs=2e-3)


def test_polytope_search_finds_minima_of_many_problems():
    middles = np.random.default_rng(0).normal(size=(20, 3))
    f = lambda x: ((x - middles[:, None]) ** 2 * np.array([1, 10, 100])).sum(-1) + 0.1 * ((x - middles[:, None]) ** 4).sum(-1)
    x, y = mixture.downhill(f, np.zeros((20, 3)), tolerance=1e-14)
    assert np.allclose(x, middles, atol=1e-4) and (y < 1e-9).all()


@pytest.mark.parametrize(("vs", "w"), [((0.01, 0.25), 0.7), ((0.25, 0.01), 0.3), ((0.004, 0.06), 0.5)])
def test_two_components_recover_planted_ones(vs, w):
    f = mixture.fit_two(expected(vs, (w, 1 - w)))
    low = min(vs)
    assert f["v1"][0] == pytest.approx(low, rel=0.02) and f["v2"][0] == pytest.approx(max(vs), rel=0.02)
    assert f["w"][0] == pytest.approx(w if vs[0] == low else 1 - w, abs=0.01)
    tilted = mixture.fit_two(expected(vs, (w, 1 - w), tilt=Tilt()), Tilt())
    assert tilted["w"][0] == pytest.approx(w if vs[0] == low else 1 - w, abs=0.01)


def test_two_components_are_at_least_as_likely_as_one():
    s = drawn(3, 12)
    one = likelihood.fit_all(s)
    two = mixture.fit_two(s)
    assert (two["loglik"] >= one["loglik_uniform"] - 1e-6).all() and (two["v1"] <= two["v2"]).all()


def test_tilted_gamma_without_tilt_is_the_closed_form():
    s = drawn(4, 8)
    for d, shape in ((0.002, 0.1), (0.05, 0.15), (0.1, 0.5), (0.05, 1.0), (0.2, 3.0), (0.08, 40.0), (0.05, 199.0)):
        d_, shape_ = np.full(8, d), np.full(8, shape)
        lp = np.exp(s.log_found_gamma(d_, shape_))
        want = np.concatenate([lp, 1 - lp.sum(-1, keepdims=True)], -1).reshape(8, -1)
        got, covered = mixture.tilted_gamma(s, d_, shape_, None)
        assert np.allclose(got, want, atol=2e-7) and np.allclose(covered, 1, atol=1e-7), (d, shape)
    f, g = mixture.fit_tilted_gamma(s), likelihood.fit_all(s)
    assert (f["loglik"] >= g["loglik_gamma"] - 1e-3).all()
    assert np.allclose(f["ani"], likelihood.gamma(s)[0], atol=3e-3)


def test_tilted_gamma_equals_a_plain_sum():
    s, tilt, d, shape = drawn(5, 1), Tilt(), 0.1, 0.7
    v = np.exp(np.linspace(np.log(1e-30), np.log(20), 400_001))
    density = np.exp(shape * np.log(shape / d) + shape * np.log(v) - shape * v / d - likelihood._ln_gamma(np.array([shape + 1]))[0] + np.log(shape)) * np.log(v[1] / v[0])
    cover = tilt.coverage(v)
    got, covered = mixture.tilted_gamma(s, np.array([d]), np.array([shape]), tilt)
    assert covered[0] == pytest.approx((density * cover).sum(), abs=1e-6)
    k, b = s.k[0, 0], s.b[0, 0]
    zero = (density * cover * np.exp(-v * k)).sum() / (density * cover).sum()
    two = (density * cover * (v * b) ** 2 / 2 * np.exp(-v * k)).sum() / (density * cover).sum()
    assert got[0, 0] == pytest.approx(zero, abs=1e-6) and got[0, 2] == pytest.approx(two, abs=1e-6)


def test_more_components_never_lose_and_meet_the_grid():
    s = drawn(6, 6)
    found = mixture.fit_components(s)
    for a, b in zip(found, found[1:], strict=False):
        assert (b["loglik"] >= a["loglik"] - 1e-9).all()
    one = likelihood.fit_all(s)
    assert np.allclose(found[0]["ani"], one["ani_uniform"], atol=1e-9) and np.allclose(found[0]["loglik"], one["loglik_uniform"])
    assert (found[3]["loglik"] >= mixture.fit(s, most=5000)[1] - 0.6).all()
    assert all(np.allclose(f["w"].sum(1), 1) for f in found)


def test_pairs_without_tags():
    s = Strata(*(np.zeros((2, 1)) + x for x in (32, 26)), np.zeros((2, 1, 3)), np.zeros((2, 1)))
    assert np.isnan(mixture.fit_two(s)["ani"]).all() and np.isnan(mixture.fit_tilted_gamma(s)["ani"]).all()
    assert all(np.isnan(f["ani"]).all() for f in mixture.fit_components(s))


def strata_rows(s, af=None):
    return [(i, f"e{j}", int(s.k[i, j]), int(s.b[i, j]), *map(float, s.n[i, j]), float(s.miss[i, j]), af[i] if af else None) for i in range(len(s.k)) for j in range(s.k.shape[1])]


SCHEMA = "pair long, enzyme string, tag_len int, body_len int, n0 double, n1 double, n2 double, n_miss double, af double"


def test_models_as_tables(spark):
    s = drawn(7, 5)
    df = spark.createDataFrame(strata_rows(s, [0.5, 0.6, 0.7, 0.8, 0.9]), SCHEMA)
    fits = mixture.compare(mixture.models(df, ["pair"]), ["pair"], "gamma", 3.841).toPandas()
    assert len(fits) == 30 and (fits.groupby("pair")["chosen"].sum() == 1).all()
    for _, of_pair in fits.groupby("pair"):
        ll = of_pair.set_index("model")["loglik"]
        assert ll["uniform"] <= ll["two"] + 1e-6 <= ll["three"] + 2e-6 <= ll["four"] + 3e-6
        bics = -2 * of_pair["loglik"] + of_pair["parameters"] * np.log(of_pair["n_tags"])
        assert np.allclose(bics, of_pair["bic"]) and of_pair.loc[bics.idxmin(), "chosen"]
        assert np.allclose(of_pair["lrt"], np.maximum(2 * (of_pair["loglik"] - ll["gamma"]), 0))
    bound = {r["pair"]: r for r in mixture.fit_pairs(df, ["pair"], Tilt(), "af").collect()}
    assert all(bound[i]["coverage"] == pytest.approx(a, abs=1e-6) for i, a in enumerate([0.5, 0.6, 0.7, 0.8, 0.9]))
    two = {r["pair"]: r for r in mixture.two_pairs(df, ["pair"]).collect()}
    assert all(two[i]["loglik"] == pytest.approx(x, abs=1e-6) for i, x in enumerate(mixture.fit_two(s)["loglik"]))
    assert mixture.tilted_gamma_pairs(df, ["pair"], Tilt(), "af", 100.0).count() == 5
