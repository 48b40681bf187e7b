"""Nested calibration: hold-outs by band over seeded orders, penalties chosen by folds inside, the variant rule, and the final model.

One pass gives the sums of products by seed, band and fold of values and of
their gaps. Every training set is a sum of such cells, and with gaps apart from
values each can be filled by medians of its own: the model of a band knows
nothing of that band, its medians included. All that leaves the executors is
sums and medians, whose size depends on seeds, bands, folds and features.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calibrate import Ridge, prefer
from .ranking import counted_quantiles

# Penalties that are tried, folds inside, orders, and the share of the first variant's error below which the second is taken.
ALPHAS, FOLDS, SEEDS, FACTOR = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0), 5, (0, 1, 2, 3, 4), 0.995


def fold_of(seed: Column, keys: Sequence[str], folds: int = FOLDS) -> Column:
    """The run of a seeded order in which a row stands: rows in order of a hash of their keys, cut into runs of equal width. Rows of other keys fall apart, whatever else they share."""
    share = F.shiftrightunsigned(F.xxhash64(seed, *keys), 11) / F.lit(float(1 << 53))
    return F.least(F.floor(share * folds), F.lit(folds - 1)).cast("int")


def medians_by_holdout(df: DataFrame, features: Sequence[str], target: str, band: str) -> dict[str | None, list[float]]:
    """Exact medians of the features over all rows but a band's, for each band, and over all (None): one job. Values are counted by band first."""
    long = df.where(F.col(target).isNotNull()).select(F.col(band).alias("_band"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)])).alias("e"))
    counts = long.where("e.v IS NOT NULL AND NOT isnan(e.v)").groupBy("_band", F.col("e.i").alias("i"), F.col("e.v").alias("_v")).agg(F.count("*").alias("_c"))
    bands = sorted((r[0] for r in df.select(band).distinct().collect()), key=str)  # a row for each band
    held = F.array(*[F.lit(str(b)) for b in bands], F.lit(None).cast("string"))
    spread = counts.withColumn("held", F.explode(held)).where("held IS NULL OR NOT (held <=> CAST(_band AS string))")
    summed = spread.groupBy("held", "i", "_v").agg(F.sum("_c").alias("_c"))
    rows = counted_quantiles(summed, ["held", "i"], [0.5]).collect()  # a row for each band and feature
    out: dict[str | None, list[float]] = {b: [0.0] * len(features) for b in [*map(str, bands), None]}
    for r in rows:
        out[r["held"]][r["i"]] = float(r["quantiles"][0])
    return out


def cells(df: DataFrame, features: Sequence[str], target: str, band: str, keys: Sequence[str], seeds: Sequence[int], folds: int) -> dict[tuple[int, str, int], np.ndarray]:
    """By (seed, band, fold) the matrix of sums of products of 1, values (0 for gaps), gaps (1 for gaps) and target."""
    rows = df.where(F.col(target).isNotNull()).withColumn("_seed", F.explode(F.array(*map(F.lit, seeds)))).withColumn("_fold", fold_of(F.col("_seed"), keys, folds))
    value = [F.col(f).cast("double") for f in features]
    gap = [v.isNull() | F.isnan(v) for v in value]
    cols = [F.lit(1.0), *[F.when(g, 0.0).otherwise(v) for v, g in zip(value, gap, strict=True)], *[g.cast("double") for g in gap], F.col(target).cast("double")]
    n = len(cols)
    flat = rows.select("_seed", F.col(band).cast("string").alias("_band"), "_fold", *[c.alias(f"_{i}") for i, c in enumerate(cols)])
    at = [(i, j) for i in range(n) for j in range(i, n)]
    sums = flat.groupBy("_seed", "_band", "_fold").agg(*[F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"s{i}_{j}") for i, j in at])
    out = {}
    for r in sums.collect():  # a row for each seed, band and fold
        m = np.zeros((n, n))
        for i, j in at:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        out[r["_seed"], r["_band"], r["_fold"]] = m
    return out


def filled(m: np.ndarray, medians: Sequence[float]) -> np.ndarray:
    """Sums of products of 1, features with their gaps filled, and target."""
    f = len(medians)
    t = np.zeros((2 * f + 2, f + 2))
    t[0, 0] = t[-1, -1] = 1
    for i, v in enumerate(medians):
        t[1 + i, 1 + i], t[1 + f + i, 1 + i] = 1, v
    return t.T @ m @ t


def fit(m: np.ndarray, features: Sequence[str], medians: Sequence[float], mean: np.ndarray, scale: np.ndarray, alpha: float) -> Ridge:
    """Ridge on features standardised by a given mean and scale, around the rows' own mean; the intercept isn't shrunk."""
    n = m[0, 0]
    own, ty = m[0, 1:-1] / n, m[0, -1] / n
    z = (m[1:-1, 1:-1] - n * np.outer(own, own)) / np.outer(scale, scale)
    zy = (m[1:-1, -1] - n * own * ty) / scale
    w = np.linalg.solve(z + alpha * np.eye(len(own)), zy)
    return Ridge(list(features), list(medians), mean.tolist(), scale.tolist(), w.tolist(), float(ty - w @ ((own - mean) / scale)), alpha)


def explained(m: np.ndarray, model: Ridge) -> float:
    """The share of the target's variance around its own mean that the model explains on the rows behind m."""
    w = np.array(model.coefficients) / np.array(model.scales)
    v = np.r_[model.intercept - w @ np.array(model.means), w, -1.0]
    around = m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
    return 1 - float(v @ m @ v) / around if around > 0 else 0.0


def chosen(by_fold: Sequence[np.ndarray], features: Sequence[str], medians: Sequence[float], alphas: Sequence[float] = ALPHAS) -> Ridge:
    """The penalty that explains most, in the mean over folds left out in turn, fitted to all; features are standardised once, over all folds. Ties: the first."""
    parts = [p for p in by_fold if p[0, 0] > 0]
    total = np.sum(parts, axis=0)
    mean = total[0, 1:-1] / total[0, 0]
    scale = np.sqrt(np.maximum(np.diag(total)[1:-1] / total[0, 0] - mean**2, 0))
    scale[scale < 1e-12] = 1.0
    gains = [np.mean([explained(p, fit(total - p, features, medians, mean, scale, a)) for p in parts]) if len(parts) > 1 else 0.0 for a in alphas]
    return fit(total, features, medians, mean, scale, alphas[int(np.argmax(gains))])


@dataclass
class Nested:
    """Models by (seed, held-out band), and by seed of all rows."""

    features: list[str]
    band: str
    held: dict[tuple[int, str], Ridge] = field(default_factory=dict)
    whole: dict[int, Ridge] = field(default_factory=dict)

    def predictions(self, df: DataFrame, name: str = "pred") -> DataFrame:
        """df for each seed (column seed), with the prediction of the model that hasn't seen the row's band; null where there is none."""
        spark = df.sparkSession
        rows = [(s, b, m.intercept, m.medians, m.means, m.scales, m.coefficients) for (s, b), m in self.held.items()]
        kinds = "seed int, _held string, _intercept double, _medians array<double>, _means array<double>, _scales array<double>, _weights array<double>"
        table = F.broadcast(spark.createDataFrame(rows, kinds))  # a row for each seed and band
        values = F.array(*[F.when(F.isnan(F.col(f).cast("double")), None).otherwise(F.col(f).cast("double")) for f in self.features])
        long = df.withColumn("_x", values).withColumn("seed", F.explode(F.array(*map(F.lit, sorted({s for s, _ in self.held})))))
        joined = long.join(table, (long["seed"] == table["seed"]) & long[self.band].cast("string").eqNullSafe(table["_held"]), "left").drop(table["seed"])
        total = F.col("_intercept")
        for i in range(len(self.features)):  # term by term, which Spark compiles, where functions over arrays are interpreted for each row
            at = lambda c, i=i: F.get(c, F.lit(i))
            total = total + (F.coalesce(at("_x"), at("_medians")) - at("_means")) / at("_scales") * at("_weights")
        return joined.withColumn(name, total).drop("_x", "_held", "_intercept", "_medians", "_means", "_scales", "_weights")


def band_holdouts(df: DataFrame, features: Sequence[str], target: str, band: str, keys: Sequence[str], seeds: Sequence[int] = SEEDS, alphas: Sequence[float] = ALPHAS, folds: int = FOLDS) -> Nested:
    """keys: columns that tell rows apart. Rows without a target don't count; a band that holds all rows has no model, nor has an empty table."""
    return _from_sums(medians_by_holdout(df, features, target, band), cells(df, features, target, band, keys, seeds, folds), features, band, seeds, alphas, folds)


def _from_sums(medians: dict[str | None, list[float]], of: dict[tuple[int, str, int], np.ndarray], features: Sequence[str], band: str, seeds: Sequence[int], alphas: Sequence[float], folds: int) -> Nested:
    bands = sorted({b for _, b, _ in of}, key=str)
    out = Nested(list(features), band)
    for s in seeds:
        for held in [*bands, None]:
            own = medians[None if held is None else str(held)]
            parts = [[filled(m, own) for (t, b, g), m in of.items() if t == s and g == f and (held is None or b != held)] for f in range(folds)]
            sums = [np.sum(p, axis=0) for p in parts if p]
            if sums:
                model = chosen(sums, features, own, alphas)
                if held is None:
                    out.whole[s] = model
                else:
                    out.held[s, held] = model
    return out


def errors(predicted: DataFrame, target: str, band: str, experiment: str) -> DataFrame:
    """experiment, seed, band (and all), n, mae, rmse, bias, r by seed, and their means over seeds (seed 'mean')."""
    e = F.col("pred") - F.col(target)
    rows = predicted.where(F.col("pred").isNotNull() & F.col(target).isNotNull()).select("seed", e.alias("e"), "pred", F.col(target).alias("y"), F.explode(F.array(F.col(band).cast("string"), F.lit("all"))).alias("band"))
    by_seed = rows.groupBy("seed", "band").agg(F.count("*").cast("double").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"), F.corr("pred", "y").alias("r"))
    means = by_seed.groupBy("band").agg(*[F.avg(c).alias(c) for c in ("n", "mae", "rmse", "bias", "r")]).select(F.lit("mean").alias("seed"), "band", "n", "mae", "rmse", "bias", "r")
    return by_seed.select(F.col("seed").cast("string").alias("seed"), "band", "n", "mae", "rmse", "bias", "r").union(means).select(F.lit(experiment).alias("experiment"), "*")


@dataclass
class Choice:
    """What the variant rule took (A or B), what it would take for each seed, the errors behind it, and the model of all rows of the first seed."""

    variant: str
    by_seed: dict[int, str]
    table: DataFrame
    model: Ridge


def choose(df: DataFrame, a: Sequence[str], b: Sequence[str], target: str, band: str, keys: Sequence[str], seeds: Sequence[int] = SEEDS, alphas: Sequence[float] = ALPHAS, folds: int = FOLDS, factor: float = FACTOR) -> Choice:
    """Both feature lists held out by band over all seeds; the second is taken only if its error over all rows, in the first seed's order, is below factor times the first's."""
    spark, every = df.sparkSession, list(dict.fromkeys([*a, *b]))
    medians, of = medians_by_holdout(df, every, target, band), cells(df, every, target, band, keys, seeds, folds)  # one pass each for both lists
    nested = {}
    for name, features in (("A", a), ("B", b)):
        at = [every.index(f) for f in features]
        rows = [0, *[1 + i for i in at], *[1 + len(every) + i for i in at], 1 + 2 * len(every)]
        nested[name] = _from_sums({k: [v[i] for i in at] for k, v in medians.items()}, {k: m[np.ix_(rows, rows)] for k, m in of.items()}, features, band, seeds, alphas, folds)
    tables = [errors(n.predictions(df), target, band, name) for name, n in nested.items()]
    found = tables[0].union(tables[1])
    table = spark.createDataFrame(found.collect(), found.schema)  # a row for each list, seed and band; made once
    overall = {(r["experiment"], r["seed"]): r["mae"] for r in table.where("band = 'all'").collect()}  # two rows for each seed
    by_seed = {s: prefer(overall.get(("A", str(s)), 0.0), overall.get(("B", str(s)), 0.0), factor) for s in seeds}
    variant = by_seed[seeds[0]]
    return Choice(variant, by_seed, table, nested[variant].whole[seeds[0]])
