"""Mixtures of divergence: over a fixed grid, with free components, with gamma-distributed rates; all with an optional coverage tilt; and the choice between them.

A tag's region has divergence v, and each of its bases is the same with
probability exp(-v). What is seen are tags in chains, and regions of high
divergence get fewer chains: with the tilt a region counts by its coverage
(`coverage`, a falling logistic curve), so weights of the whole genome differ
from those of the sample, and their coverage is the aligned fraction.

All pairs of a batch are fitted at once; a fit's cost is array operations over
pairs, strata and grid or components. Pairs without tags get no estimate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import likelihood
from ..functions.likelihood import Strata, arrays, ascend, by_pair

# The grid of divergences, none and 70 in equal ratios; the middle and scale of the coverage curve.
GRID = np.concatenate([[0.0], np.geomspace(1e-4, 0.8, 70)])
MIDDLE, SCALE = 0.20, 0.06
#: Pairs of one array.
BATCH = 256


@dataclass(frozen=True)
class Tilt:
    """How coverage falls with divergence."""

    middle: float = MIDDLE
    scale: float = SCALE

    def coverage(self, v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip((v - self.middle) / self.scale, -700, 700)))


def counts(s: Strata) -> np.ndarray:
    """By pair: the tags of each outcome (0, 1, 2 differences, not found, of each stratum in turn)."""
    return np.concatenate([s.n, s.miss[..., None]], axis=-1).reshape(len(s.n), -1)


def outcomes(s: Strata, v: np.ndarray) -> np.ndarray:
    """Probabilities of the outcomes by pair, outcome and last axis of v, divergences of shape (pairs, any number)."""
    if not s.classed:
        k, b, x, m = s.k[..., None, None], s.b[..., None, None], v[:, None, None, :], s.m[:, None]
        choose = np.stack([likelihood._choose(s.b, i) for i in s.m.tolist()], -1)[..., None]
        with np.errstate(divide="ignore", invalid="ignore"):
            changed = np.where(m == 0, 0.0, m * np.log(-np.expm1(-x)))
        p = np.where(m <= b, choose, 0.0) * np.exp(np.minimum(changed - (k - m) * x, 0.0))
        p = np.concatenate([p, np.maximum(1 - p.sum(2, keepdims=True), 0)], 2)
        return p.reshape(len(p), -1, v.shape[1])
    parts = []
    for j in range(v.shape[1]):
        p = s.found(np.exp(-v[:, j]))[0]
        parts.append(np.concatenate([p, np.maximum(1 - p.sum(-1, keepdims=True), 0)], axis=-1).reshape(len(p), -1))
    return np.stack(parts, axis=-1)


def kernel(s: Strata, grid: np.ndarray = GRID) -> np.ndarray:
    """Probability of each outcome by pair, outcome and grid point."""
    return outcomes(s, np.broadcast_to(grid, (len(s.k), len(grid))))


def log_likelihood(n: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n * np.log(np.maximum(p, 1e-300)), 0).sum(-1)


def multiplier(r: np.ndarray, h: np.ndarray, steps: int = 80) -> np.ndarray:
    """mu with sum of r h / (1 + mu h) = 0 by pair, where h takes both signs; the sum falls with mu between the poles."""

    def slope(mu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        below = 1 + mu[:, None] * h
        part = np.divide(r * h, below, out=np.zeros_like(r), where=below != 0)
        return part.sum(1), -np.divide(part * h, below, out=np.zeros_like(r), where=below != 0).sum(1)

    return ascend(slope, -1 / h.max(1), -1 / h.min(1), steps)


def fit(s: Strata, grid: np.ndarray = GRID, most: int = 200, tolerance: float = 1e-10, tilt: Tilt | None = None, aligned: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the whole genome over the grid and log-likelihood of each pair, by an interior point; pairs that have settled are no longer updated.

    With a tilt the sample's weights u are fitted, and the genome's are those divided by coverage. With the aligned fraction of each pair (NaN: free)
    the genome's weights have just that coverage: sum(u / coverage) = 1 / aligned, which is h u = 0 with h = 1 / coverage - 1 / aligned. Fractions
    that no weights can have are moved to the nearest that some have.

    The likelihood is concave in u. A step is Newton's on the optimality conditions with u z = mu, where z >= 0 are the bounds' multipliers: as the
    likelihood depends on u by the few outcomes only, its system has a row for each outcome and each constraint. A pair has settled where the gap
    u z, which bounds what the log-likelihood can still gain, is below `tolerance` for each tag."""
    n = counts(s)
    total = n.sum(1)
    k = kernel(s, grid)
    pi = tilt.coverage(grid) if tilt else np.ones(len(grid))
    g = len(grid)
    u = np.full((len(n), g), 1 / g)
    want = np.full(len(n), np.nan) if aligned is None or tilt is None else np.asarray(aligned, float)
    edge = 1e-6 * (pi.max() - pi.min())
    h = 1 / pi - 1 / np.clip(want, pi.min() + edge, pi.max() - edge)[:, None]
    bound = np.isfinite(want)
    h = np.where(bound[:, None], h / np.abs(np.where(bound[:, None], h, 1.0)).max(1, keepdims=True), 0.0)
    if bound.any():  # weights inside the bounds that meet the constraint: equal on either side of it
        low, high = h < 0, h > 0
        down, up = np.where(low, h, 0).sum(1) / np.maximum(low.sum(1), 1), np.where(high, h, 0).sum(1) / np.maximum(high.sum(1), 1)
        on_low = np.divide(up, up - down, out=np.full_like(up, 0.5), where=up > down)[:, None]
        start = np.where(low, on_low / np.maximum(low.sum(1), 1)[:, None], np.where(high, (1 - on_low) / np.maximum(high.sum(1), 1)[:, None], 1e-12))
        u[bound] = start[bound]
    active = np.flatnonzero(total > 0)
    z = np.ones_like(u)
    y = np.zeros((len(n), 2))
    y[:, 0] = 1.0
    for _ in range(most):
        if not len(active):
            break
        ua, za, ya, ka, ha, free = u[active], z[active], y[active], k[active], h[active], ~bound[active]
        f = n[active] / total[active][:, None]  # the likelihood is that of one tag, so gaps are, too
        p = np.maximum((ka @ ua[..., None])[..., 0], 1e-300)
        rise = ((f / p)[:, None] @ ka)[:, 0]
        lines = np.stack([np.ones_like(ua), ha], 1)  # sum(u) = 1 and h u = 0
        miss = np.stack([1 - ua.sum(1), -(ha * ua).sum(1)], 1)
        gap = (ua * za).sum(1)
        dual = rise - (ya[:, None] @ lines)[:, 0] + za  # nothing at the best weights
        mu = 0.1 * gap / g
        for corrected in (False, True):
            # z du + u dz = target - u z;  -W du + dz - lines' dy = -dual, with W = S' S and S = diag(sqrt(f) / p) K
            centre = (0 if not corrected else mu[:, None] - moved[0] * moved[1]) - ua * za
            d = ua / za
            right = dual + centre / ua  # (W + z / u) du + lines' dy = right
            # with t = S du: t = S d (right - S' t - lines' dy)
            rows = np.concatenate([ka * (np.sqrt(f) / p)[..., None], lines], 1)
            o = ka.shape[1]
            a = rows @ (d[:, None] * rows).transpose(0, 2, 1)
            a[:, np.arange(o), np.arange(o)] += 1
            a[free, o + 1, o + 1] = 1.0
            b = (rows @ (d * right)[..., None])[..., 0]
            b[:, o:] -= miss
            b[free, o + 1] = 0.0
            scale = np.maximum(np.diagonal(a, axis1=1, axis2=2), 1e-300) ** -0.5
            a *= scale[:, :, None] * scale[:, None]
            a[:, np.arange(o + 2), np.arange(o + 2)] += 1e-14
            t = np.linalg.solve(a, (b * scale)[..., None])[..., 0] * scale
            du = d * (right - (t[:, None] @ rows)[:, 0])
            dz = (centre - za * du) / ua
            longest = lambda x, dx: np.minimum(1.0, (0.995 / np.maximum((-dx / x).max(1), 1e-300)))
            su, sz = longest(ua, du), longest(za, dz)
            if not corrected:
                left = ((ua + su[:, None] * du) * (za + sz[:, None] * dz)).sum(1)
                mu = gap / g * np.clip(left / gap, 1e-2, 1.0) ** 3
                moved = (du, dz)
        step = np.minimum(su, sz)[:, None]
        u[active], z[active] = np.maximum(ua + step * du, 1e-18), np.maximum(za + step * dz, 1e-18)
        y[active] = ya + step * t[:, o:]
        off = np.maximum(np.abs(dual).max(1), np.abs(miss).max(1))
        active = active[~((gap < tolerance) & (off < 1e-8) | (gap < 1e-14))]
    u /= u.sum(1, keepdims=True)
    p = np.maximum((k @ u[..., None])[..., 0], 1e-300)
    loglik = np.where(total > 0, (n * np.log(p)).sum(1), -np.inf)
    w = u / pi
    return w / w.sum(1, keepdims=True), loglik


def downhill(f: Callable[..., np.ndarray], start: np.ndarray, spread: float = 0.5, steps: int = 400, tolerance: float = 1e-8, parts: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The polytope search of Nelder and Mead for many problems at once. f takes (problems, points, dimensions) and gives (problems, points); start is (problems, dimensions).

    In each step every problem reflects its worst corner; which of expanding, contracting or shrinking follows is decided problem by problem.
    With `parts` f takes the numbers of its problems, too, and is asked about those only that need a value."""

    def asked(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        if parts:
            return f(x, at)
        full = np.zeros((len(start), *x.shape[1:]))
        full[at] = x
        return f(full)[at]

    n, d = start.shape
    x = np.repeat(start[:, None], d + 1, 1)
    x[:, np.arange(1, d + 1), np.arange(d)] += spread
    at = np.arange(n)
    y = asked(x, at)
    for _ in range(steps):
        order = y.argsort(1, kind="stable")
        x, y = np.take_along_axis(x, order[..., None], 1), np.take_along_axis(y, order, 1)
        if (y[:, -1] - y[:, 0] < tolerance).all():
            break
        middle = x[:, :-1].mean(1)
        away = middle - x[:, -1]
        tries = np.stack([middle + c * away for c in (1.0, 2.0, 0.5, -0.5)], 1)  # reflected, expanded, contracted outside and inside
        t = np.full((n, 4), np.inf)
        t[:, 0] = asked(tries[:, :1], at)[:, 0]
        best, second, worst = y[:, 0], y[:, -2], y[:, -1]
        then = np.where(t[:, 0] < best, 1, np.where(t[:, 0] < second, 0, np.where(t[:, 0] < worst, 2, 3)))  # what is tried next, if anything
        if (more := np.flatnonzero(then)).size:
            t[more, then[more]] = asked(tries[more, then[more]][:, None], more)[:, 0]
        take = np.where(then == 1, np.where(t[:, 1] < t[:, 0], 1, 0), np.where(then == 0, 0, np.where(then == 2, np.where(t[:, 2] <= t[:, 0], 2, -1), np.where(t[:, 3] < worst, 3, -1))))
        moved = take >= 0
        x[moved, -1], y[moved, -1] = tries[at[moved], take[moved]], t[at[moved], take[moved]]
        if not moved.all():
            still = np.flatnonzero(~moved)
            x[still] = x[still, :1] + 0.5 * (x[still] - x[still, :1])
            y[still] = asked(x[still], still)
    best = y.argmin(1)
    return x[at, best], y[at, best]


def _repeated(s: Strata, times: int) -> Strata:
    """Each pair so many times in a row."""
    return Strata(*(np.repeat(x, times, 0) for x in (s.k, s.b, s.n, s.miss, s.d2, s.d3)))


def _of(s: Strata, at: np.ndarray) -> Strata:
    """The pairs of these numbers."""
    return Strata(*(x[at] for x in (s.k, s.b, s.n, s.miss, s.d2, s.d3)))


#: Where the searches start: divergence of both components and the first's weight; mean rate and shape.
TWO_STARTS = ((0.003, 0.03, 0.5), (0.01, 0.15, 0.75), (0.03, 0.3, 0.5), (0.06, 0.08, 0.5), (0.02, 0.5, 0.5))
GAMMA_STARTS = ((0.02, 0.5), (0.05, 2.0), (0.15, 1.0), (0.3, 50.0))


def _pseudo(aligned: np.ndarray | None, trials: float, cover: np.ndarray) -> np.ndarray | float:
    """Log-likelihood of an aligned fraction seen in so many trials."""
    if aligned is None or not trials:
        return 0.0
    c = np.clip(cover, 1e-6, 1 - 1e-6)
    a = np.asarray(aligned, float)
    return np.where(np.isfinite(a), trials * (np.nan_to_num(a) * np.log(c) + (1 - np.nan_to_num(a)) * np.log(1 - c)), 0.0)


def fit_two(s: Strata, tilt: Tilt | None = None, aligned: np.ndarray | None = None, trials: float = 0.0) -> dict[str, np.ndarray]:
    """v1 <= v2, w (the genome's share of v1), ani and loglik of two components, from every start at once.

    With a tilt, aligned fractions (NaN: unknown) count as seen in `trials` trials."""
    p, starts = len(s.k), len(TWO_STARTS)
    many = _repeated(s, starts)
    n = counts(many)
    fractions = None if aligned is None else np.repeat(np.asarray(aligned, float), starts)

    def unpacked(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = np.exp(np.clip(theta[..., :2], np.log(1e-9), np.log(5.0)))
        w = 1 / (1 + np.exp(-np.clip(theta[..., 2], -40, 40)))
        return v, np.stack([w, 1 - w], -1)

    def objective(theta: np.ndarray, at: np.ndarray) -> np.ndarray:
        out, own, seen = np.empty(theta.shape[:2]), _of(many, at), n[at]
        for j in range(theta.shape[1]):
            v, w = unpacked(theta[:, j])
            cover = tilt.coverage(v) if tilt else np.ones_like(v)
            covered = (w * cover).sum(1)
            u = w * cover / np.maximum(covered, 1e-300)[:, None]
            out[:, j] = -(log_likelihood(seen, (outcomes(own, v) * u[:, None]).sum(-1)) + (_pseudo(None if fractions is None else fractions[at], trials, covered) if tilt else 0.0))
        return out

    start = np.tile([(np.log(a), np.log(b), np.log(w / (1 - w))) for a, b, w in TWO_STARTS], (p, 1))
    theta, value = downhill(objective, start, parts=True)
    best = value.reshape(p, starts).argmin(1) + starts * np.arange(p)
    v, w = unpacked(theta[best])
    order = v.argsort(1, kind="stable")  # a component takes its weight along
    v, w = np.take_along_axis(v, order, 1), np.take_along_axis(w, order, 1)
    some = s.total.sum(-1) > 0
    nan = lambda x: np.where(some, x, np.nan)
    return {"v1": nan(v[:, 0]), "v2": nan(v[:, 1]), "w": nan(w[:, 0]), "ani": nan((w * np.exp(-v)).sum(1)), "loglik": nan(-value[best])}


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)
#: Below this number of expected changes a tag is taken to be without any but for a first-order term.
_FEW = 1e-4


def _lower_gamma(shape: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The share of a gamma distribution (of scale 1) below a small x, by its series."""
    term = np.exp(shape * np.log(np.maximum(x, 1e-300)) - x - likelihood._ln_gamma(shape + 1))
    total = term.copy()
    for j in range(1, 12):
        term = term * x / (shape + j)
        total = total + term
    return total


def tilted_gamma(s: Strata, d: np.ndarray, shape: np.ndarray, tilt: Tilt | None) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the outcomes, and the genome's coverage, where v is gamma-distributed with mean d over the genome and a tag with v has Poisson changes.

    The rate x = v / d is integrated over its logarithm by Gauss and Legendre between points beyond which its density is nothing; what lies
    left of where a tag has hardly any change is added in closed form. Without a tilt these are the probabilities of `log_found_gamma`."""
    free = s.b + s.d2 / 3 + 2 * s.d3 / 3
    a, rate = shape[:, None], d[:, None]
    wide, deep = np.sqrt(80 / a), 40 / a
    hi = np.minimum(wide, np.log1p(deep + np.log1p(deep) + 1))
    x0 = np.minimum(_FEW / (rate * s.k.max(1)[:, None]), 1.0)
    lo = np.maximum(-np.minimum(wide * (1 + wide / 5), 1 + deep), np.log(x0))
    lo = np.minimum(lo, hi - 1e-3)
    t = (hi + lo) / 2 + (hi - lo) / 2 * _NODES
    x = np.exp(t)
    density = np.exp(a * np.log(a) - likelihood._ln_gamma(a + 1) + np.log(a) + a * t - a * x) * (hi - lo) / 2 * _WEIGHTS
    v = rate * x
    cover = tilt.coverage(v) if tilt else np.ones_like(v)
    at_none = float(tilt.coverage(np.zeros(1))[0]) if tilt else 1.0
    small = np.exp(lo)
    below, below_x = _lower_gamma(a, a * small)[:, 0], _lower_gamma(a + 1, a * small)[:, 0]  # share, and mean, of rates left of lo
    covered = (density * cover).sum(1) + at_none * below
    lam, lost = v[:, None, :] * free[..., None], np.exp(-v[:, None, :] * s.k[..., None])
    parts, factorial = [], 1.0
    for m in range(len(s.m)):
        factorial *= max(m, 1)
        inside = ((density * cover)[:, None] * lam**m / factorial * lost).sum(-1)
        first = at_none * (below[:, None] - rate * s.k * below_x[:, None] if m == 0 else rate * free * below_x[:, None] if m == 1 else 0.0)
        parts.append(np.where(m <= s.b + s.d2 + s.d3, inside + first, 0.0) / covered[:, None])
    p = np.stack(parts, -1)
    p = np.concatenate([p, np.maximum(1 - p.sum(-1, keepdims=True), 0)], -1)
    return p.reshape(len(p), -1), covered


def fit_tilted_gamma(s: Strata, tilt: Tilt | None = None, aligned: np.ndarray | None = None, trials: float = 0.0) -> dict[str, np.ndarray]:
    """d, shape, ani and loglik of gamma-distributed rates seen through the coverage tilt; from every start at once."""
    p, starts = len(s.k), len(GAMMA_STARTS)
    many = _repeated(s, starts)
    n = counts(many)
    fractions = None if aligned is None else np.repeat(np.asarray(aligned, float), starts)
    unpacked = lambda theta: (np.exp(np.clip(theta[..., 0], np.log(1e-6), 0.0)), np.exp(np.clip(theta[..., 1], np.log(likelihood.SHAPE_LOW) - likelihood.SHAPE_REACH, np.log(likelihood.SHAPE_HIGH) + likelihood.SHAPE_REACH)))

    def objective(theta: np.ndarray, at: np.ndarray) -> np.ndarray:
        out, own, seen = np.empty(theta.shape[:2]), _of(many, at), n[at]
        for j in range(theta.shape[1]):
            probabilities, covered = tilted_gamma(own, *unpacked(theta[:, j]), tilt)
            out[:, j] = -(log_likelihood(seen, probabilities) + (_pseudo(None if fractions is None else fractions[at], trials, covered) if tilt else 0.0))
        return out

    theta, value = downhill(objective, np.tile(np.log(GAMMA_STARTS), (p, 1)), steps=300, parts=True)
    best = value.reshape(p, starts).argmin(1) + starts * np.arange(p)
    d, shape = unpacked(theta[best])
    some = s.total.sum(-1) > 0
    nan = lambda x: np.where(some, x, np.nan)
    return {"d": nan(d), "shape": nan(shape), "ani": nan((1 + d / shape) ** -shape), "loglik": nan(-value[best])}


def _polished(s: Strata, n: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """v, w and log-likelihood after a search downhill from there."""
    c = v.shape[1]

    def unpacked(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = np.exp(np.clip(np.concatenate([np.zeros_like(theta[..., :1]), theta[..., c:]], -1), -40, 40))
        return np.exp(np.clip(theta[..., :c], np.log(1e-9), np.log(5.0))), share / share.sum(-1, keepdims=True)

    def objective(theta: np.ndarray, at: np.ndarray) -> np.ndarray:
        own, seen = _of(s, at), n[at]
        parts = [unpacked(theta[:, j]) for j in range(theta.shape[1])]
        return np.stack([-log_likelihood(seen, (outcomes(own, a) * b[:, None]).sum(-1)) for a, b in parts], 1)

    safe = np.maximum(w, 1e-9)
    theta, value = downhill(objective, np.c_[np.log(np.maximum(v, 1e-9)), np.log(safe[:, 1:] / safe[:, :1])], 0.2, 120 * c, 1e-7, True)
    return *unpacked(theta), -value


def fit_components(s: Strata, most: int = 4, rounds: int = 30, grid: np.ndarray = GRID) -> list[dict[str, np.ndarray]]:
    """For 1, 2, ... most components: v and w (pairs, components), ani and loglik.

    Each further component starts at the divergence towards which the likelihood rises fastest (the greatest directional derivative over the grid),
    with the best of some weights; then expectation-maximisation moves all weights and divergences, a component's divergence being the one-rate fit
    to its share of the counts, and a search downhill ends the way. For two components `fit_two` counts where it does better. So the likelihood
    never falls from one number of components to the next."""
    n = counts(s)
    total = n.sum(1)
    some = total > 0
    width = len(s.m) + 1
    dense = kernel(s, grid)
    first = likelihood.uniform(s)[0]
    v, w = -np.log(np.clip(np.nan_to_num(first, nan=0.9), 1e-9, 1 - 1e-9))[:, None], np.ones((len(n), 1))
    found = []
    for number in range(1, most + 1):
        if number > 1:
            p = np.maximum((outcomes(s, v) * w[:, None]).sum(-1), 1e-300)
            rise = np.einsum("pog,po->pg", dense, n / p)
            new = grid[rise.argmax(1)]
            extra = outcomes(s, new[:, None])[..., 0]
            shares = np.array([0.0, 0.002, 0.01, 0.05, 0.2, 0.4, 0.6])
            gain = np.stack([log_likelihood(n, (1 - e) * p + e * extra) for e in shares], 1)
            share = np.where(gain.argmax(1) == 0, 1e-4, shares[gain.argmax(1)])[:, None]
            v, w = np.c_[v, new], np.c_[w * (1 - share), share]
        k = outcomes(s, v)
        value = log_likelihood(n, (k * w[:, None]).sum(-1))
        for _ in range(rounds if number > 1 else 0):
            p = np.maximum((k * w[:, None]).sum(-1), 1e-300)
            share = k * w[:, None] * (n / p)[..., None]  # expected tags by outcome and component
            w_new = share.sum(1) / np.maximum(total, 1)[:, None]
            v_new = v.copy()
            for c in range(v.shape[1]):
                own = share[..., c].reshape(len(n), -1, width)
                part = Strata(s.k, s.b, own[..., :-1], own[..., -1], s.d2, s.d3)
                a = np.exp(-v[:, c])
                reach = 0.2 * (1 - a) + 1e-4
                v_new[:, c] = -np.log(ascend(part.score, np.maximum(a - reach, 0.3), np.minimum(a + reach, 1 - 1e-9), 8))
            k_new = outcomes(s, v_new)
            value_new = log_likelihood(n, (k_new * w_new[:, None]).sum(-1))
            up = value_new >= value
            v, w, k = np.where(up[:, None], v_new, v), np.where(up[:, None], w_new, w), np.where(up[:, None, None], k_new, k)
            gain, value = np.where(up, value_new - value, 0), np.where(up, value_new, value)
            if (gain < 1e-7).all():
                break
        if number > 1:
            others = [_polished(s, n, v, w)]
            if number == 2:
                two = fit_two(s)
                others.append((np.nan_to_num(np.c_[two["v1"], two["v2"]]), np.nan_to_num(np.c_[two["w"], 1 - two["w"]]), np.nan_to_num(two["loglik"], nan=-np.inf)))
            for v_other, w_other, value_other in others:
                up = value_other > value
                v, w, value = np.where(up[:, None], v_other, v), np.where(up[:, None], w_other, w), np.where(up, value_other, value)
            worse = value < np.nan_to_num(found[-1]["loglik"])  # a component that helps nothing has no weight
            w = np.where(worse[:, None], np.c_[found[-1]["w"], np.zeros(len(n))], w)
            v = np.where(worse[:, None], np.c_[found[-1]["v"], v[:, -1]], v)
            value = np.where(worse, found[-1]["loglik"], value)
        found.append({"v": v, "w": w, "ani": np.where(some, (w * np.exp(-v)).sum(1), np.nan), "loglik": np.where(some, value, np.nan)})
    return found


def _batches(strata: DataFrame, pair: list[str], fitted: Callable[[Strata, pd.DataFrame], pd.DataFrame], columns: str, more: Sequence[str] = ()) -> DataFrame:
    """pair and what `fitted` gives for a batch of pairs; more: columns of the strata that are the same in all rows of a pair."""
    grouped = by_pair(strata, pair)
    if more:
        grouped = grouped.join(strata.groupBy(*pair).agg(*[F.first(c, ignorenulls=True).cast("double").alias(c) for c in more]), pair)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), BATCH):
                part = pdf.iloc[at : at + BATCH].reset_index(drop=True)
                yield fitted(arrays(part["rows"]), part)

    kinds = ", ".join(f"`{c}` {strata.schema[c].dataType.simpleString()}" for c in pair)
    return grouped.mapInPandas(run, f"{kinds}, {columns}")


def fit_pairs(strata: DataFrame, pair: list[str], tilt: Tilt | None = None, aligned: str | None = None) -> DataFrame:
    """strata as for the one-rate fits. pair, ani_mixture (mean identity over the genome), coverage, loglik_mixture, weights over GRID.

    aligned: a column of the strata with the pair's aligned fraction, which the weights then have under the tilt."""

    def fitted(s: Strata, part: pd.DataFrame) -> pd.DataFrame:
        w, loglik = fit(s, tilt=tilt, aligned=part[aligned].to_numpy(float) if aligned else None)
        cover = w @ tilt.coverage(GRID) if tilt else np.ones(len(w))
        return part[pair].assign(ani_mixture=w @ np.exp(-GRID), coverage=cover, loglik_mixture=loglik, weights=list(w))

    return _batches(strata, pair, fitted, "ani_mixture double, coverage double, loglik_mixture double, weights array<double>", [aligned] if aligned else [])


def two_pairs(strata: DataFrame, pair: list[str], tilt: Tilt | None = None, aligned: str | None = None, trials: float = 0.0) -> DataFrame:
    """pair, v1, v2, w, ani, loglik of two components; no estimate is null."""
    fitted = lambda s, part: part[pair].assign(**fit_two(s, tilt, part[aligned].to_numpy(float) if aligned else None, trials))
    return _batches(strata, pair, fitted, "v1 double, v2 double, w double, ani double, loglik double", [aligned] if aligned else []).replace(float("nan"), None, ["v1", "v2", "w", "ani", "loglik"])


def tilted_gamma_pairs(strata: DataFrame, pair: list[str], tilt: Tilt | None = None, aligned: str | None = None, trials: float = 0.0) -> DataFrame:
    """pair, d, shape, ani, loglik of gamma-distributed rates seen through the tilt; no estimate is null."""
    fitted = lambda s, part: part[pair].assign(**fit_tilted_gamma(s, tilt, part[aligned].to_numpy(float) if aligned else None, trials))
    return _batches(strata, pair, fitted, "d double, shape double, ani double, loglik double", [aligned] if aligned else []).replace(float("nan"), None, ["d", "shape", "ani", "loglik"])


#: Models and their numbers of free parameters; the grid's is counted as its points that hold weight, less one.
MODELS = {"uniform": 1, "gamma": 2, "two": 3, "three": 5, "four": 7}


def models(strata: DataFrame, pair: list[str]) -> DataFrame:
    """In long form pair, model, parameters, loglik, ani, n_tags of one rate, gamma-distributed rates, two, three and four components, and the grid."""

    def fitted(s: Strata, part: pd.DataFrame) -> pd.DataFrame:
        g = likelihood.gamma(s)
        own = likelihood.fit_all(s, g)
        w, grid_loglik = fit(s)
        rows = {"uniform": (own["ani_uniform"], own["loglik_uniform"]), "gamma": (g[0], own["loglik_gamma"])}
        rows |= {name: (f["ani"], f["loglik"]) for name, f in zip(("two", "three", "four"), fit_components(s)[1:], strict=True)}
        out = [part[pair].assign(model=m, parameters=MODELS[m], loglik=ll, ani=a, n_tags=own["n_tags"]) for m, (a, ll) in rows.items()]
        held = 2 * (w > 1e-3).sum(1) - 1
        return pd.concat([*out, part[pair].assign(model="grid", parameters=held, loglik=grid_loglik, ani=w @ np.exp(-GRID), n_tags=own["n_tags"])])

    return _batches(strata, pair, fitted, "model string, parameters int, loglik double, ani double, n_tags long").where("n_tags > 0")


def compare(fits: DataFrame, pair: list[str], null: str, critical: float) -> DataFrame:
    """fits: pair, model, parameters, loglik, n_tags. Adds bic; lrt, twice the gain over the pair's null model; supported, whether that exceeds critical; and chosen, the least bic (ties: fewer parameters, then name)."""
    of_pair = Window.partitionBy(*pair)
    base = F.max(F.when(F.col("model") == null, F.col("loglik"))).over(of_pair)
    rows = fits.withColumn("bic", bic(F.col("loglik"), F.col("parameters"), F.greatest(F.col("n_tags"), F.lit(2))))
    rows = rows.withColumn("lrt", F.greatest(2 * (F.col("loglik") - base), F.lit(0.0)))
    rows = rows.withColumn("supported", (F.col("model") != null) & supported(base, F.col("loglik"), critical))
    return rows.withColumn("chosen", F.row_number().over(of_pair.orderBy("bic", "parameters", "model")) == 1)


def bic(loglik: Column, parameters: int | Column, n: Column) -> Column:
    return -2 * loglik + parameters * F.log(n)


def supported(null: Column, full: Column, critical: float) -> Column:
    """Whether twice the gain in log-likelihood exceeds a critical value."""
    return F.greatest(2 * (full - null), F.lit(0.0)) > critical


def fit_logistic(points: Sequence[tuple[float, float, float]], steps: int = 50) -> tuple[float, float]:
    """(middle, scale) of 1 / (1 + exp(-(x - middle) / scale)) through (x, y, weight): Gauss-Newton from a straight line through the logits, on a handful of bins."""
    x, y, w = (np.array(c, float) for c in zip(*points, strict=True))
    logit = np.log(np.clip(y, 1e-3, 1 - 1e-3) / (1 - np.clip(y, 1e-3, 1 - 1e-3)))
    b, a = np.polyfit(x, logit, 1, w=np.sqrt(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -40, 40)))
        j = (p * (1 - p))[:, None] * np.c_[np.ones_like(x), x]
        step = np.linalg.solve((j * w[:, None]).T @ j + 1e-9 * np.eye(2), (j * w[:, None]).T @ (y - p))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-10:
            break
    return float(-a / b), float(1 / b)
