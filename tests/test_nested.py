"""Nested calibration against a plain loop over rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import nested

FEATURES = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(2000, 3)) * [1, 20, 0.1] + [0, 5, 0]
    band = r.choice(["b1", "b2", "b3", "b4"], 2000, p=[0.5, 0.2, 0.2, 0.1])
    y = x @ [2, 0.1, 5] + (band == "b2") * 0.5 + r.normal(size=2000)
    rows = [(i, *[None if r.random() < 0.1 else float(v) for v in row], float(t) if i % 50 else None, b) for i, (row, t, b) in enumerate(zip(x, y, band, strict=True))]
    rows += [(5000 + i, *rows[1][1:]) for i in range(30)]  # equal rows but for their key
    return spark.createDataFrame(rows, "id long, x1 double, x2 double, x3 double, y double, band string").withColumn("pred_of_another", F.lit(1))


def plain(rows, seed, features, alphas, folds):
    """By held-out band the predictions of its rows."""
    rows = [r for r in rows if r["y"] is not None]
    out = {}
    for held in sorted({r["band"] for r in rows}):
        train = [r for r in rows if r["band"] != held]
        x = np.array([[np.nan if r[f] is None else r[f] for f in features] for r in train])
        y, fold = np.array([r["y"] for r in train]), np.array([r[f"fold{seed}"] for r in train])
        med = np.nanmedian(x, 0)
        x = np.where(np.isnan(x), med, x)
        mean, scale = x.mean(0), x.std(0)
        z = (x - mean) / scale

        def ridge(z, y, a):
            m, t = z.mean(0), y.mean()
            w = np.linalg.solve((z - m).T @ (z - m) + a * np.eye(len(m)), (z - m).T @ (y - t))
            return w, t - w @ m

        def score(a):
            got = []
            for f in range(folds):
                w, c = ridge(z[fold != f], y[fold != f], a)
                t = y[fold == f]
                got.append(1 - ((z[fold == f] @ w + c - t) ** 2).sum() / ((t - t.mean()) ** 2).sum())
            return np.mean(got)

        best = max(alphas, key=score)
        w, c = ridge(z, y, best)
        for r in rows:
            if r["band"] == held:
                v = np.array([np.nan if r[f] is None else r[f] for f in features])
                out[r["id"]] = float((np.where(np.isnan(v), med, v) - mean) / scale @ w + c)
    return out


def test_holdouts_equal_a_plain_loop(table):
    seeds = [3, 8]
    rows = table.select("*", *[nested.fold_of(F.lit(s), ["id"]).alias(f"fold{s}") for s in seeds]).collect()
    found = nested.band_holdouts(table, FEATURES, "y", "band", ["id"], seeds)
    predicted = found.predictions(table).collect()
    assert len(predicted) == 2 * len(rows)
    for s in seeds:
        want = plain(rows, s, FEATURES, nested.ALPHAS, nested.FOLDS)
        got = {r["id"]: r["pred"] for r in predicted if r["seed"] == s}
        for i, p in want.items():
            assert got[i] == pytest.approx(p, abs=1e-8)


def test_folds_are_runs_of_a_seeded_order_and_part_equal_rows(table):
    rows = table.select("id", nested.fold_of(F.lit(1), ["id"]).alias("f"), F.xxhash64(F.lit(1), "id").alias("h")).collect()
    ordered = sorted(rows, key=lambda r: r["h"] % (1 << 64))
    assert [r["f"] for r in ordered] == sorted(r["f"] for r in rows)
    sizes = np.bincount([r["f"] for r in rows], minlength=5)
    assert sizes.min() > 300 and len({r["f"] for r in rows if r["id"] >= 5000}) > 1


def test_errors_and_the_variant_rule(spark, table):
    c = nested.choose(table, ["x1"], FEATURES, "y", "band", ["id"], [0, 1])
    assert c.variant == "B" and c.by_seed == {0: "B", 1: "B"} and c.model.features == FEATURES
    back = nested.choose(table, FEATURES, ["x1"], "y", "band", ["id"], [0])
    assert back.variant == "A" and back.model.coefficients == pytest.approx(c.model.coefficients)
    rows = {(r["experiment"], r["seed"], r["band"]): r for r in c.table.collect()}
    assert len(rows) == 2 * 3 * 5
    assert rows["B", "mean", "all"]["mae"] == pytest.approx((rows["B", "0", "all"]["mae"] + rows["B", "1", "all"]["mae"]) / 2)
    p = [r for r in nested.band_holdouts(table, FEATURES, "y", "band", ["id"], [0]).predictions(table).collect() if r["y"] is not None]
    assert rows["B", "0", "all"]["n"] == len(p) and rows["B", "0", "all"]["mae"] == pytest.approx(np.mean([abs(r["pred"] - r["y"]) for r in p]))
    one = table.where("band = 'b1'")
    alone = nested.band_holdouts(one, FEATURES, "y", "band", ["id"], [0])
    assert not alone.held and 0 in alone.whole
    assert not nested.band_holdouts(table.limit(0), FEATURES, "y", "band", ["id"], [0]).whole
