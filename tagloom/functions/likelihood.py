"""Similarity from tag outcomes: one-rate and gamma-rate likelihoods, moment inversion, agreement and bounds.

A stratum (pair, enzyme) has tags of k bases, b of which are free, counts
n[m] of tags found with m differences, and n_miss not found. Where the
recognition site has places that two (d2) or three (d3) of the four bases fit,
a change there may leave the tag to be found, with one difference more. All
fits of an Arrow batch are made at once: numpy arrays over pairs and strata, so
the work of a task is a few hundred array operations whatever the number of
pairs. Maxima are roots of derivatives, found within brackets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOW, HIGH = 0.5, 0.999999
# Bounds of the shape, the shape that stands for one rate, and the 95 % point of chi-squared with one degree.
SHAPE_LOW, SHAPE_HIGH, SHAPE_ONE_RATE, LRT_CRITICAL = 0.1, 200.0, 1e6, 3.841
# Shapes are told at a resolution, of so many equal steps of their logarithm between the bounds and then of finer steps, so many on each side, that reach so far.
SHAPE_STEPS, SHAPE_FINE_STEPS, SHAPE_REACH = 48, 12, 0.35

FITS = (
    "ani_uniform double, std_err double, ani double, het_shape double, lrt double, supported boolean, retention double, "
    "ani_from_loss double, ani_from_hist double, enzyme_spread double, enzyme_chi2 double, n_tags long, ani_upper95 double, loglik_uniform double, loglik_gamma double"
)
_FIT_NAMES = [c.split()[0] for c in FITS.split(", ")]

_TINY = 1e-300


def _choose(n: np.ndarray, m: int) -> np.ndarray:
    out = np.ones_like(n, float)
    for j in range(m):
        out = out * np.maximum(n - j, 0) / (j + 1)
    return out


class Strata:
    """Arrays over pairs (rows) and strata (columns, padded with empty ones) and differences m.

    Of the k places d2 and d3 fit two and three bases, and what b, d2 and d3 leave must not change."""

    def __init__(self, k: np.ndarray, b: np.ndarray, n: np.ndarray, miss: np.ndarray, d2: np.ndarray | None = None, d3: np.ndarray | None = None) -> None:
        self.k, self.b, self.n, self.miss = k.astype(float), b.astype(float), n.astype(float), miss.astype(float)
        self.d2, self.d3 = (np.zeros_like(self.k) if d is None else d.astype(float) for d in (d2, d3))
        self.total = self.n.sum(-1) + self.miss
        self.m = np.arange(n.shape[-1])
        self.classed = bool(self.d2.any() or self.d3.any())

    def columns(self) -> Strata:
        """Every stratum as a pair of its own."""
        flat = lambda x: x.reshape(-1, 1, *x.shape[2:])
        return Strata(*(flat(x) for x in (self.k, self.b, self.n, self.miss, self.d2, self.d3)))

    def found(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of m differences at identity a (by pair) and its first two derivatives by a.

        Changes in the body and at both kinds of site places are independent, so their counts are convolved; each factor is
        C(count, m) ((1 - a) fit)^m a^(count - m), whose logarithm is easily derived."""
        a = np.clip(a, 1e-9, 1 - 1e-12)[:, None]
        log_a, log_c = np.log(a), np.log1p(-a)

        def factor(count: np.ndarray, fit: float, at_most: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            out = []
            for m in range(at_most + 1):
                p = _choose(count, m) * np.exp(m * (log_c + np.log(fit)) + (count - m) * log_a)
                slope, bend = (count - m) / a - m / (1 - a), -(count - m) / a**2 - m / (1 - a) ** 2
                out.append((p, p * slope, p * (slope**2 + bend)))
            return out

        times = lambda x, y: (x[0] * y[0], x[1] * y[0] + x[0] * y[1], x[2] * y[0] + 2 * x[1] * y[1] + x[0] * y[2])
        top = len(self.m) - 1
        sites = self.d2 + self.d3
        (must,) = factor(self.k - self.b - sites, 1.0, 0)
        terms = [times(x, must) for x in factor(self.b, 1.0, top)]
        if self.classed:
            for count, fit in ((self.d2, 1 / 3), (self.d3, 2 / 3)):
                other = factor(count, fit, top)
                terms = [tuple(sum(parts) for parts in zip(*(times(terms[i], other[m - i]) for i in range(m + 1)), strict=True)) for m in range(top + 1)]
        return tuple(np.stack([t[i] for t in terms], -1) for i in range(3))

    def log_found(self, a: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log(self.found(a)[0])

    def log_found_gamma(self, d: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Log-probability of m differences where the rate of a tag is gamma-distributed with mean d. A change at a site place keeps the tag with its share of fitting bases,
        so these places count as part of the body by that share, and all k places share the tag's rate."""
        return self._gamma(d, shape)[0]

    def _gamma(self, d: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same, its derivatives by ln d (first and second) and by ln shape (first)."""
        d, s, m = d[:, None, None], shape[:, None, None], self.m
        k, free = self.k[..., None], (self.b + self.d2 / 3 + 2 * self.d3 / 3)[..., None]
        steps = np.arange(max(len(m) - 1, 0))
        pad = lambda x: np.concatenate([np.zeros_like(x[..., :1]), np.cumsum(x, -1)], -1)[..., : len(m)]
        ones = np.ones((*s.shape[:2], len(steps)))
        rise, rise_slope = pad(np.log(s + steps) * ones) if len(steps) else np.zeros_like(s), pad(ones / (s + steps)) if len(steps) else np.zeros_like(s)
        factorial = np.cumsum(np.r_[0, np.log(np.arange(1, len(m)))])
        dk = d * k
        with np.errstate(divide="ignore", invalid="ignore"):
            lp = np.where(m == 0, 0.0, m * np.log(free * d)) - factorial + rise - s * np.log1p(dk / s) - m * np.log(s + dk)
        lp = np.where(m <= (self.b + self.d2 + self.d3)[..., None], lp, -np.inf)
        share = dk / (s + dk)
        by_d, by_d2 = m - (s + m) * share, -(s + m) * share * (1 - share)
        by_s = s * (rise_slope - np.log1p(dk / s) + 1 - (s + m) / (s + dk))
        return lp, by_d, by_d2, by_s + np.zeros_like(lp)

    def loss(self, lp: np.ndarray, renormalised: bool = False) -> np.ndarray:
        """Negative log-likelihood by pair; renormalised: of the differences alone, given that a tag is found."""
        found = np.exp(lp).sum(-1)
        seen = np.where(self.n > 0, self.n * np.where(np.isfinite(lp), lp, 0), 0).sum(-1)
        if renormalised:
            return -(seen - self.n.sum(-1) * np.log(np.maximum(found, _TINY))).sum(-1)
        return -(seen + np.where(self.miss > 0, self.miss * np.log(np.maximum(1 - found, _TINY)), 0)).sum(-1)

    def score(self, a: np.ndarray, renormalised: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivative of the log-likelihood by a."""
        p, p1, p2 = self.found(a)
        safe = np.maximum(p, _TINY)
        first = np.where(self.n > 0, self.n * p1 / safe, 0).sum(-1)
        second = np.where(self.n > 0, self.n * (p2 / safe - (p1 / safe) ** 2), 0).sum(-1)
        s, s1, s2 = p.sum(-1), p1.sum(-1), p2.sum(-1)
        if renormalised:
            seen, s = self.n.sum(-1), np.maximum(s, _TINY)
            return (first - seen * s1 / s).sum(-1), (second - seen * (s2 / s - (s1 / s) ** 2)).sum(-1)
        miss = self.miss > 0
        lost = np.where(miss, np.maximum(1 - s, 1e-150), 1.0)  # whose square is no overflow
        return (first - np.where(miss, self.miss * s1 / lost, 0)).sum(-1), (second - np.where(miss, self.miss * (s2 / lost + (s1 / lost) ** 2), 0)).sum(-1)

    def retention(self, a: np.ndarray) -> np.ndarray:
        p = self.found(a)[0].sum(-1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return (self.total * p).sum(-1) / self.total.sum(-1)


class SiteStrata(Strata):
    """Strata by the number of site places that must not change."""

    def __init__(self, exact: np.ndarray, b: np.ndarray, d2: np.ndarray, d3: np.ndarray, n: np.ndarray, miss: np.ndarray) -> None:
        super().__init__(exact + b + d2 + d3, b, n, miss, d2, d3)


def ascend(slope: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray | None]], low: np.ndarray, high: np.ndarray, steps: int = 60) -> np.ndarray:
    """Where the slope goes from positive to negative between low and high, for all pairs at once; an end if it doesn't.

    slope gives a function's first derivative and, for steps of Newton's, its second (else None: halving). A step that leaves the
    bracket, or follows one that didn't halve it, is replaced by halving."""
    lo, hi = low.astype(float).copy(), high.astype(float).copy()
    least = 1e-13 * (1 + np.abs(lo)) * np.minimum(1, hi - lo)
    x, halve = (lo + hi) / 2, np.zeros(len(lo), bool)
    for _ in range(steps):
        first, second = slope(x)
        width = hi - lo
        lo, hi = np.where(first > 0, x, lo), np.where(first > 0, hi, x)
        middle = (lo + hi) / 2
        if second is None:
            x = middle
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            new = x - first / second
        inside = (second < 0) & (new >= lo) & (new <= hi) & ~halve
        halve = (hi - lo > 0.5 * width) & inside
        settled = (inside & (np.abs(new - x) <= least)) | (hi - lo <= least)
        x = np.where(inside, new, middle)
        if settled.all():
            break
    return x


def uniform(s: Strata) -> tuple[np.ndarray, np.ndarray]:
    """Identity and its standard error under one rate."""
    some = s.total.sum(-1) > 0
    a = ascend(s.score, np.full(len(some), LOW), np.full(len(some), HIGH))
    bend = -s.score(a)[1]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(some, a, np.nan), np.where(some & (bend > 0), bend**-0.5, np.nan)


def _gamma_slopes(s: Strata, d: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Derivatives of the log-likelihood by ln d (two) and by ln shape (one)."""
    lp, by_d, by_d2, by_s = s._gamma(d, shape)
    p = np.exp(lp)
    lost = np.maximum(1 - p.sum(-1), _TINY)
    miss = s.miss > 0
    part = lambda g: (np.where(s.n > 0, s.n * g, 0).sum(-1) - np.where(miss, s.miss * (p * g).sum(-1) / lost, 0)).sum(-1)
    first, by_shape = part(by_d), part(by_s)
    in_lost = (p * by_d).sum(-1) / lost
    second = np.where(s.n > 0, s.n * by_d2, 0).sum(-1) - np.where(miss, s.miss * ((p * (by_d**2 + by_d2)).sum(-1) / lost + in_lost**2), 0)
    return first, second.sum(-1), by_shape


def best_rate(s: Strata, shape: np.ndarray) -> np.ndarray:
    """The mean rate of greatest likelihood for a shape of each pair."""
    log_d = ascend(lambda u: _gamma_slopes(s, np.exp(u), shape)[:2], np.full(len(shape), np.log(1e-6)), np.zeros(len(shape)))
    return np.exp(log_d)


def gamma(s: Strata) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Identity, shape, likelihood ratio against one rate, whether gamma-distributed rates are supported, and the log-likelihood.

    The likelihood at the best mean rate is a function of the shape, whose slope is the partial one (the mean rate adds nothing at
    its best). A few shapes tell between which of them the greatest maximum lies, and the slope's root there is the shape. It is
    told at a fixed resolution: of the steps on both sides of the root the likelier one, first of the wide steps, then of the finer ones from there."""
    n = len(s.total)

    def height(log_shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = best_rate(s, np.exp(log_shape))
        return -s.loss(s.log_found_gamma(d, np.exp(log_shape))), d

    low, high = np.log(SHAPE_LOW), np.log(SHAPE_HIGH)
    posts = np.linspace(low, high, 10)
    top = np.stack([height(np.full(n, x))[0] for x in posts]).argmax(0)
    below, above = np.r_[low - SHAPE_REACH, posts][top], np.r_[posts, high + SHAPE_REACH][top + 1]
    root = ascend(lambda x: (_gamma_slopes(s, best_rate(s, np.exp(x)), np.exp(x))[2], None), below, above, 36)

    def told(start: np.ndarray, step: float, least: int, most: int) -> np.ndarray:
        under = start + step * np.clip(np.floor((root - start) / step), least, most - 1)
        return np.where(height(under)[0] >= height(under + step)[0], under, under + step)

    wide = told(np.full(n, low), (high - low) / SHAPE_STEPS, 0, SHAPE_STEPS)
    log_shape = told(wide, SHAPE_REACH / SHAPE_FINE_STEPS, -SHAPE_FINE_STEPS, SHAPE_FINE_STEPS)
    shape, (value, d) = np.exp(log_shape), height(log_shape)
    one = np.full(n, SHAPE_ONE_RATE)
    lrt = np.maximum(2 * (value + s.loss(s.log_found_gamma(best_rate(s, one), one))), 0)
    supported = (lrt > LRT_CRITICAL) & (shape < SHAPE_HIGH * 0.99)
    return (1 + d / shape) ** -shape, np.where(supported, shape, np.inf), lrt, supported, value


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight; x >= 1."""
    shift, y = np.zeros_like(x), x.astype(float)
    for _ in range(8):
        shift, y = shift + np.log(y), y + 1
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction (modified Lentz), which is taken on the side where it converges fast."""
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore"):
        front = np.exp(_ln_gamma(a + b) - _ln_gamma(a) - _ln_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    keep = lambda v: np.where(np.abs(v) < 1e-30, 1e-30, v)
    c, d = np.ones_like(x), 1 / keep(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / keep(1 + even * d), keep(1 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / keep(1 + odd * d), keep(1 + odd / c)
        h = h * d * c
        if (np.abs(d * c - 1) < 1e-14).all():
            break
    return np.where(swap, 1 - front * h, front * h)


def binomial_upper(k: np.ndarray, n: np.ndarray, alpha: float = 0.05) -> np.ndarray:
    """Upper one-sided exact limit of a share: 1 - alpha ** (1 / n) at 0, 1 at k >= n, NaN without trials."""
    k, n = k.astype(float), n.astype(float)
    out = np.where(n == 0, np.nan, 1.0)
    open_ = (n > 0) & (k < n)
    if open_.any():
        x, t = k[open_], n[open_]
        out[open_] = ascend(lambda p: (_beta_share(t - x, x + 1, 1 - p) - alpha, None), x / t, np.ones(len(x)))  # the chance of at most k falls with p
    return out


def upper_bound(s: Strata, alpha: float = 0.05) -> np.ndarray:
    """Identity at which the expected share of found tags meets its upper limit; LOW and 1 at the ends."""
    found, total = s.n.sum((-1, -2)), s.total.sum(-1)
    p = binomial_upper(found, total, alpha)
    n = len(total)
    low, high = s.retention(np.full(n, LOW)), s.retention(np.full(n, HIGH))
    a = ascend(lambda x: (p - s.retention(x), None), np.full(n, LOW), np.full(n, HIGH))
    return np.where(total == 0, np.nan, np.where((p >= 1) | (p >= high), 1.0, np.where(p <= low, LOW, a)))


def fit_all(s: Strata, of_gamma: tuple[np.ndarray, ...] | None = None) -> dict[str, np.ndarray]:
    """Every estimate of a pair, identities as fractions. retention is the share of tags that is expected at the one-rate identity. of_gamma: what `gamma` gives, if known."""
    n = len(s.total)
    a, se = uniform(s)
    g, shape, lrt, supported, value = of_gamma or gamma(s)
    total = s.total.sum(-1)
    some = total > 0
    with np.errstate(invalid="ignore", divide="ignore"):
        kept = s.n.sum((-1, -2)) / total
    ends = np.full(n, LOW), np.full(n, HIGH)
    from_loss = ascend(lambda x: (kept - s.retention(x), None), *ends)
    from_hist = ascend(lambda x: s.score(x, True), *ends)
    e, e_se = (x.reshape(s.k.shape) for x in uniform(s.columns()))
    w = 1 / e_se**2
    ok = np.isfinite(e) & np.isfinite(w)
    known = np.isfinite(e)
    with np.errstate(all="ignore"):
        spread = np.where(known.any(1), np.where(known, e, -np.inf).max(1) - np.where(known, e, np.inf).min(1), np.nan)
        mean = np.where(ok, e * w, 0).sum(1) / np.where(ok, w, 0).sum(1)
        q = np.where(ok, w * (e - mean[:, None]) ** 2, 0).sum(1)
        chi2 = np.where(ok.sum(1) > 1, q / (ok.sum(1) - 1), np.nan)
    nan = lambda x: np.where(some, x, np.nan)
    at = np.nan_to_num(a, nan=LOW)
    return {
        "ani_uniform": a, "std_err": se, "ani": nan(np.where(supported, g, a)), "het_shape": nan(shape), "lrt": nan(lrt), "supported": supported & some, "retention": nan(s.retention(at)),
        "ani_from_loss": nan(from_loss), "ani_from_hist": nan(from_hist), "enzyme_spread": nan(spread), "enzyme_chi2": nan(chi2), "n_tags": total.astype(np.int64), "ani_upper95": upper_bound(s),
        "loglik_uniform": nan(-s.loss(s.log_found(at))), "loglik_gamma": nan(value),
    }


#: Columns of a stratum; those after the dots of a fit's docstring may be missing and count as 0.
_COUNTS, _SITES = ("tag_len", "body_len", "n0", "n1", "n2", "n_miss"), ("d2", "d3")


#: Tasks of fits for each core.
TASKS = 3


def by_pair(strata: DataFrame, pair: list[str]) -> DataFrame:
    """pair and rows, one for each enzyme of the panel, in order of their names.

    Fits cost much for few bytes, so pairs are dealt by a number of tasks that goes with the cores, not by size."""
    row = F.struct("enzyme", *[F.col(c).cast("double").alias(c) for c in _COUNTS], *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in strata.columns else F.lit(0.0)).alias(c) for c in _SITES])
    return strata.repartition(TASKS * strata.sparkSession.sparkContext.defaultParallelism, *pair).groupBy(*pair).agg(F.sort_array(F.collect_list(row)).alias("rows"))


def arrays(rows: pd.Series) -> Strata:
    """The strata of a batch of pairs, padded to the longest."""
    names = (*_COUNTS, *_SITES)
    x = np.zeros((len(rows), max(len(r) for r in rows), len(names)))
    x[..., :2] = (2, 2)
    for i, of_pair in enumerate(rows):
        for j, r in enumerate(of_pair):
            x[i, j] = [r[c] for c in names]
    return Strata(x[..., 0], x[..., 1], x[..., 2:5], x[..., 5], x[..., 6], x[..., 7])


def fit_pairs(strata: DataFrame, pair: list[str]) -> DataFrame:
    """strata: pair, enzyme, tag_len, body_len, n0, n1, n2, n_miss ... d2, d3 (places of the site that two and three bases fit). One row of fits a pair; no estimate is null, an infinite shape stays.

    A pair without site places has the plain likelihood, whatever the other pairs of its batch have: a place of count 0 is a factor of 1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at : at + 1024]
                fits = pd.DataFrame(fit_all(arrays(part["rows"])))
                yield pd.concat([part[pair].reset_index(drop=True), fits], axis=1)[[*pair, *_FIT_NAMES]]

    kinds = ", ".join(f"`{c}` {strata.schema[c].dataType.simpleString()}" for c in pair)
    fitted = by_pair(strata, pair).mapInPandas(run, f"{kinds}, {FITS}")
    return fitted.select(*pair, *[F.when(~F.isnan(c), F.col(c)).alias(c) if c not in ("supported", "n_tags") else F.col(c) for c in _FIT_NAMES])
