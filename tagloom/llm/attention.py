"""A small causal self-attention model over subword ids, in numpy.

Ids are mapped to LEAVES leaves: frequent ids have their own, the others share
a few, within which an id's probability is its smoothed share of the training
counts. Leaves are arranged in SIDE classes of SIDE leaves by how they follow
other leaves; the model gives a distribution over classes and, within the
right class, one over its leaves, so a token costs two small softmaxes.

Both softmaxes weigh counts of the training text: what followed this beginning
of a word (the ids since its first one, hashed into CELLS cells), and with it,
as if seen a few times more, what follows the last leaf or class. Attention
raises or lowers these weights by what it sees further back. In training a
target's own occurrence is taken out of the counts.

One attention layer with a residual, then one hidden layer. Windows of WIDTH
inputs overlap: the last STRIDE positions of each are scored, the others are
context, so every id of a document is scored once. Positions before the start
of the document are masked; nothing crosses documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import _P, _PINV, _power, keep_freed, mix, single_threaded

SIDE = 32
LEAVES = SIDE * SIDE
SHARED = 64  # leaves for ids without one of their own
WIDTH, STRIDE = 32, 24
SIZE, HIDDEN = 16, 32
START = LEAVES  # the input before the first id
CELL_BITS = 16
CELLS = 1 << CELL_BITS
#: How often the distribution after the last leaf or class counts as seen, beside the counts of a word's beginning: for each kind of follower, and besides.
KINDS, BESIDES = 3.0, 3.0


@dataclass
class Model:
    leaf: np.ndarray  # by id
    within: np.ndarray  # by id: log of its share of its leaf
    weights: dict[str, np.ndarray]
    begins: np.ndarray  # by id: whether it begins a word


def share_leaves(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """leaf (not yet arranged in classes) and within, from the counts of the training ids."""
    n_ids = len(counts)
    order = np.argsort(-counts, kind="stable")
    own = min(LEAVES - SHARED, max(1, n_ids - 1))
    leaf = np.zeros(n_ids, np.int64)
    leaf[order[:own]] = np.arange(own)
    rest = order[own:]  # by falling count, in shared leaves of about equal weight
    mass = np.cumsum(counts[rest] + 0.1)
    leaf[rest] = own + np.minimum(SHARED - 1, (mass / mass[-1] * SHARED).astype(np.int64))
    smooth = counts + 0.1
    total = np.bincount(leaf, smooth, LEAVES)
    return leaf, np.log(smooth / total[leaf])


def places(follows: np.ndarray) -> np.ndarray:
    """The place of each leaf in its class, from how often each leaf follows each leaf or the start."""
    pairs = follows[:LEAVES].astype(np.float32)
    rows, cols = pairs.sum(1) + 1, pairs.sum(0) + 1
    lift = np.log1p(pairs * (pairs.sum() + 1) / rows[:, None] / cols[None, :])
    both = np.c_[lift.T, lift].astype(np.float32)
    both -= both.mean(0)
    _, vectors = np.linalg.eigh(both @ both.T)
    axes = vectors[:, ::-1][:, :5]
    groups = [np.arange(LEAVES)]
    for level in range(5):  # median splits along the main axes
        halves = []
        for g in groups:
            g = g[np.argsort(axes[g, level], kind="stable")]
            halves += [g[: len(g) // 2], g[len(g) // 2 :]]
        groups = halves
    place = np.empty(LEAVES, np.int64)
    place[np.concatenate(groups)] = np.arange(LEAVES)
    return place


def arranged(follows: np.ndarray, place: np.ndarray) -> np.ndarray:
    """follows in the order of the places."""
    out = np.empty_like(follows)
    out[np.ix_(np.r_[place, START], place)] = follows
    return out


def followers(leaves: np.ndarray) -> np.ndarray:
    """The cell (last leaf or START, next leaf) of each position of a document, as one number."""
    return np.r_[START, leaves[:-1]] * LEAVES + leaves


def contexts(ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each position of a document a hash of the ids before it, from the last one that begins a word on."""
    n = len(ids)
    at = np.arange(n)
    first = np.r_[0, np.maximum.accumulate(np.where(begins[ids], at, 0))[:-1]]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * _power(_P, n), out=sums[1:])
    return mix((sums[:n] - sums[first]) * _power(_PINV, n)[first] + (at - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def cell1(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def cell2(h: np.ndarray, cls: np.ndarray) -> np.ndarray:
    return (((h ^ cls.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def context_cells(leaves: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The cells of the two tables of counts, the second behind the first, that the positions of a document count in."""
    cls, sub = leaves // SIDE, leaves % SIDE
    return np.r_[cell1(h) * SIDE + cls, (CELLS + cell2(h, cls)) * SIDE + sub]


def context_counts(counts: np.ndarray) -> dict[str, np.ndarray]:
    """The two tables, from how often each cell of context_cells was met."""
    n1, n2 = counts.astype(np.float32).reshape(2, CELLS, SIDE)
    return {"n1": n1, "n2": n2, "k1": (BESIDES + KINDS * (n1 > 0).sum(1)).astype(np.float32), "k2": (BESIDES + KINDS * (n2 > 0).sum(1)).astype(np.float32)}


_at = np.arange(WIDTH)
_gap = _at[None, :] - _at[WIDTH - STRIDE :, None]
BIAS = np.where(_gap > 0, -1e9, 0.15 * _gap).astype(np.float32)


def windows(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (START where there is none, -1 beyond), targets and which targets count, of one document's leaves."""
    n = len(stream)
    k = -(-n // STRIDE)
    at = np.arange(k)[:, None] * STRIDE + (np.arange(WIDTH) - (WIDTH - STRIDE))[None, :]
    padded = np.r_[np.full(WIDTH, -1), START, stream, np.zeros(STRIDE, np.int64)]
    x = padded[at + WIDTH]
    t_at = at[:, WIDTH - STRIDE :]
    return x, np.minimum(t_at, n - 1), t_at < n


SAFE = 60.0  # exponentials up to it neither overflow nor vanish in float32


def _flat(a: np.ndarray) -> np.ndarray:
    return a.reshape(-1, a.shape[-1])


def forward(w: dict[str, np.ndarray], x: np.ndarray) -> dict[str, np.ndarray]:
    """What backward needs. Products run over all positions at once, but for those within a window."""
    shape = len(x), STRIDE, SIZE
    c = {"x": np.where(x < 0, START, x)}
    e = c["e"] = w["E"].take(c["x"], axis=0)
    own = c["own"] = _flat(e[:, WIDTH - STRIDE :])
    q = c["q"] = (own @ (w["Wq"] * np.float32(SIZE**-0.5))).reshape(shape)
    kv = (_flat(e) @ np.c_[w["Wk"], w["Wv"]]).reshape(len(x), WIDTH, 2 * SIZE)
    k, v = c["k"], c["v"] = kv[..., :SIZE], kv[..., SIZE:]
    s = c["a"] = q @ k.transpose(0, 2, 1)
    far = s.size and not (s.min() > -SAFE and s.max() < SAFE)
    s += BIAS
    first = np.flatnonzero(x[:, 0] < 0)
    if len(first):
        s[first] += np.where(x[first] < 0, np.float32(-1e9), np.float32(0))[:, None, :]
    if far:
        s -= s.max(-1, keepdims=True)
    np.exp(s, out=s)
    s /= (_flat(s) @ np.ones(WIDTH, np.float32)).reshape(len(x), STRIDE, 1)
    m = c["m"] = _flat(s @ v)
    h = c["h"] = m @ w["Wo"]
    h += own
    u = c["u"] = h @ w["W1"]
    u += w["b1"]
    np.maximum(u, 0, out=u)
    z = u @ w["W2"]
    z += h
    c["z"] = z.reshape(shape)
    return c


ONES = np.ones(SIDE, np.float32)


def _level(x: np.ndarray) -> None:
    """Subtracts the largest of each row where some value is too far from 0 for exp."""
    if x.size and not (x.min() > -SAFE and x.max() < SAFE):
        x -= x.max(-1, keepdims=True)


def tables(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What forward derives from one input only, for every input at once: an input has no place of its own in the model."""
    e = w["E"]
    q, k = e @ w["Wq"] * np.float32(SIZE**-0.5), e @ w["Wk"]
    largest = float(np.sqrt((q**2).sum(1).max() * (k**2).sum(1).max()))
    return {"own": np.c_[e, q], "context": np.c_[k, e @ w["Wv"] @ w["Wo"]], "level": np.array(largest < SAFE)}


def outputs(w: dict[str, np.ndarray], known: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """forward's z, from tables and without what backward needs."""
    at = np.where(x < 0, START, x)
    own, context = known["own"].take(at[:, WIDTH - STRIDE :], axis=0), known["context"].take(at, axis=0)
    s = own[..., SIZE:] @ context[..., :SIZE].transpose(0, 2, 1)
    s += BIAS
    first = np.flatnonzero(x[:, 0] < 0)
    if len(first):
        s[first] += np.where(x[first] < 0, np.float32(-1e9), np.float32(0))[:, None, :]
    if not known["level"]:
        s -= s.max(-1, keepdims=True)
    np.exp(s, out=s)
    m = s @ context[..., SIZE:]
    m /= (s.reshape(-1, WIDTH) @ np.ones(WIDTH, np.float32)).reshape(*s.shape[:2], 1)
    h = (m + own[..., :SIZE]).reshape(-1, SIZE)
    u = h @ w["W1"]
    u += w["b1"]
    np.maximum(u, 0, out=u)
    h += u @ w["W2"]
    return h.reshape(*s.shape[:2], SIZE)


def heads(w: dict[str, np.ndarray], z: np.ndarray, t: np.ndarray, last: np.ndarray, h: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log-probabilities of target leaves; with grads, those of the head and, as the second value, of z, and without the targets' own counts."""
    cls, sub = t // SIDE, t % SIDE
    n = np.arange(len(t))
    p1 = z @ w["C1"]
    _level(p1)
    np.exp(p1, out=p1)
    cell = cell1(h)
    seen = w["p1"].take(last, axis=0)
    seen *= w["k1"].take(cell)[:, None]
    seen += w["n1"].take(cell, axis=0)
    if grads is not None:
        seen[n, cls] -= 1
    p1 *= seen
    total = p1 @ ONES
    lp = np.log(p1[n, cls] / total)
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    cuts = np.searchsorted(cls[order], np.arange(SIDE + 1))
    zs, subs = z.take(order, axis=0), sub[order]
    p2 = np.empty((len(t), SIDE), z.dtype)
    for c in range(SIDE):
        a, b = cuts[c], cuts[c + 1]
        if a < b:
            np.matmul(zs[a:b], w["C2"][c].T, out=p2[a:b])
    _level(p2)
    np.exp(p2, out=p2)
    cell = cell2(h, cls)[order]
    seen = w["p2"].take((cls * (SIDE + 1) + last // SIDE)[order], axis=0)
    seen *= w["k2"].take(cell)[:, None]
    seen += w["n2"].take(cell, axis=0)
    if grads is not None:
        seen[n, subs] -= 1
    p2 *= seen
    total2 = p2 @ ONES
    lp[order] += np.log(p2[n, subs] / total2)
    if grads is None:
        return lp, None
    p1 /= total[:, None]
    p1[n, cls] -= 1
    grads["C1"] = z.T @ p1
    dz = p1 @ w["C1"].T
    p2 /= total2[:, None]
    p2[n, subs] -= 1
    grads["C2"] = np.zeros_like(w["C2"])
    ds = np.empty_like(zs)
    for c in range(SIDE):
        a, b = cuts[c], cuts[c + 1]
        grads["C2"][c] = p2[a:b].T @ zs[a:b]
        ds[a:b] = p2[a:b] @ w["C2"][c]
    dz[order] += ds
    return lp, dz


def backward(w: dict[str, np.ndarray], c: dict[str, np.ndarray], dz: np.ndarray, g: dict[str, np.ndarray]) -> None:
    n, shape, dz = len(dz), dz.shape, _flat(dz)
    g["W2"] = c["u"].T @ dz
    du = dz @ w["W2"].T
    du *= c["u"] > 0
    g["W1"], g["b1"] = c["h"].T @ du, np.ones(len(du), np.float32) @ du
    dh = du @ w["W1"].T
    dh += dz
    g["Wo"] = c["m"].T @ dh
    dm = dh @ w["Wo"].T
    mean = np.einsum("ij,ij->i", dm, c["m"])  # of the gradients of a row's shares
    dm = dm.reshape(shape)
    ds = dm @ c["v"].transpose(0, 2, 1)
    ds -= mean.reshape(n, STRIDE, 1)
    ds *= c["a"]
    dkv = np.empty((n, WIDTH, 2 * SIZE), np.float32)
    np.matmul(ds.transpose(0, 2, 1), c["q"], out=dkv[..., :SIZE])
    np.matmul(c["a"].transpose(0, 2, 1), dm, out=dkv[..., SIZE:])
    dq = _flat(ds @ c["k"])
    dq *= np.float32(SIZE**-0.5)
    g["Wq"] = c["own"].T @ dq
    g["Wk"], g["Wv"] = np.split(_flat(c["e"]).T @ _flat(dkv), 2, axis=1)
    de = (_flat(dkv) @ np.c_[w["Wk"], w["Wv"]].T).reshape(n, WIDTH, SIZE)
    dh += dq @ w["Wq"].T
    de[:, WIDTH - STRIDE :] += dh.reshape(shape)
    cells = c["x"].reshape(-1, 1) * SIZE + np.arange(SIZE)
    g["E"] = np.bincount(cells.ravel(), de.ravel(), w["E"].size).astype(np.float32).reshape(w["E"].shape)


def after(follows: np.ndarray) -> dict[str, np.ndarray]:
    """Smoothed shares: of classes after each leaf, and of a class's leaves after each class."""
    n1 = follows.reshape(LEAVES + 1, SIDE, SIDE).sum(2)
    all1 = (n1.sum(0) + 0.5) / (n1.sum() + 0.5 * SIDE)
    p1 = (n1 + 5 * all1) / (n1.sum(1, keepdims=True) + 5)
    n2 = np.concatenate([follows[:LEAVES].reshape(SIDE, SIDE, SIDE, SIDE).sum(1), follows[LEAVES].reshape(1, SIDE, SIDE)]).transpose(1, 0, 2)
    all2 = (n2.sum(1, keepdims=True) + 0.5) / (n2.sum((1, 2), keepdims=True) + 0.5 * SIDE)
    p2 = (n2 + 10 * all2) / (n2.sum(2, keepdims=True) + 10)
    return {"p1": p1.astype(np.float32), "p2": p2.astype(np.float32).reshape(-1, SIDE)}


def gradients(w: dict[str, np.ndarray], x: np.ndarray, t: np.ndarray, on: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], int]:
    """Sums of the gradients over all targets that count, and their number."""
    single_threaded()
    keep_freed()
    c = forward(w, x)
    z = c["z"][on]
    g: dict[str, np.ndarray] = {}
    _, d = heads(w, z, t[on], c["x"][:, WIDTH - STRIDE :][on], h[on], g)
    dz = np.zeros_like(c["z"])
    dz[on] = d
    backward(w, c, dz, g)
    return g, len(z)


class Learner:
    """Weights and the running moments of their gradients."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.weights = {k: rng.normal(0, s, shape).astype(np.float32) for k, s, shape in (
            ("E", 0.3, (LEAVES + 1, SIZE)), ("Wq", 0.3, (SIZE, SIZE)), ("Wk", 0.3, (SIZE, SIZE)), ("Wv", 0.2, (SIZE, SIZE)), ("Wo", 0.1, (SIZE, SIZE)),
            ("W1", 0.3, (SIZE, HIDDEN)), ("b1", 0.0, (HIDDEN,)), ("W2", 0.1, (HIDDEN, SIZE)), ("C1", 0.1, (SIZE, SIDE)), ("C2", 0.1, (SIDE, SIDE, SIZE)),
        )}
        self.first, self.second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        self.step = 0

    def learn(self, g: dict[str, np.ndarray], n: int, rate: float) -> None:
        self.step += 1
        w, first, second, step = self.weights, self.first, self.second, self.step
        for k in w:
            grad = g[k] / n
            first[k] += 0.1 * (grad - first[k])
            second[k] += 0.01 * (grad * grad - second[k])
            w[k] -= (rate / (1 - 0.9**step)) * first[k] / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)


def begin(x: np.ndarray, t: np.ndarray, live: np.ndarray, h: np.ndarray, fixed: dict[str, np.ndarray], steps: int = 1200, batch: int = 128, seed: int = 7) -> Learner:
    """A learner after `steps` small steps over windows."""
    rng = np.random.default_rng(seed)
    learner = Learner(rng)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), batch)
        learner.learn(*gradients(learner.weights | fixed, x[pick], t[pick], live[pick], h[pick]), 0.02 * min(1, step / 20) * (1 - 0.9 * step / steps))
    return learner


def train(streams: list[np.ndarray], n_ids: int, begins: np.ndarray | None = None, steps: int = 1200, batch: int = 128, seed: int = 7) -> Model:
    """streams: the ids of documents, each with its end. Without begins each id is a word."""
    begins = np.ones(n_ids, bool) if begins is None else begins
    streams = [s for s in streams if len(s)] or [np.zeros(1, np.int64)]
    leaf, within = share_leaves(sum(np.bincount(s, minlength=n_ids) for s in streams))
    follows = np.bincount(np.concatenate([followers(leaf[s]) for s in streams]), minlength=(LEAVES + 1) * LEAVES).reshape(LEAVES + 1, LEAVES)
    place = places(follows)
    leaf = place[leaf]
    counts = np.bincount(np.concatenate([context_cells(leaf[s], contexts(s, begins)) for s in streams]), minlength=2 * CELLS * SIDE)
    fixed = after(arranged(follows, place)) | context_counts(counts)
    parts = [windows(leaf[s]) + (leaf[s], contexts(s, begins)) for s in streams]
    x, t, live, h = (np.concatenate(c) for c in zip(*((x, own[at], live, h[at]) for x, at, live, own, h in parts), strict=True))
    return Model(leaf.astype(np.int32), within.astype(np.float32), begin(x, t, live, h, fixed, steps, batch, seed).weights | fixed, begins)


def score(model: Model, streams: list[np.ndarray], at_once: int = 128) -> np.ndarray:
    """Log10-probability of each stream of ids; at_once windows stay in a core's cache."""
    single_threaded()
    keep_freed()
    out = np.zeros(len(streams))
    parts = []
    for i, s in enumerate(streams):
        if len(s):
            leaves = model.leaf[s]
            out[i] = model.within[s].sum(dtype=np.float64)
            x, at, live = windows(leaves)
            parts.append((x, leaves[at], live, contexts(s, model.begins)[at], np.full(len(x), i)))
    if not parts:
        return out
    x, t, live, h, who = map(np.concatenate, zip(*parts, strict=True))
    known = tables(model.weights)
    sums = np.zeros(len(x))
    for a in range(0, len(x), at_once):
        part, on = x[a : a + at_once], live[a : a + at_once]
        z, last = outputs(model.weights, known, part), part[:, WIDTH - STRIDE :]
        every, _ = heads(model.weights, _flat(z), t[a : a + at_once].ravel(), last.ravel(), h[a : a + at_once].ravel())
        sums[a : a + at_once] = np.where(on, every.reshape(on.shape), 0).sum(1, dtype=float)  # few positions are no targets
    return (out + np.bincount(who, sums, len(out))) / np.log(10)
