"""Ridge regression from sufficient statistics, hold-outs by band, and model scoring as columns.

All that leaves the executors is one row of sums for each band and fold: its
size depends on the number of features alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import quantiles

ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)


@dataclass
class Ridge:
    features: list[str]
    medians: list[float]
    means: list[float]
    scales: list[float]
    coefficients: list[float]
    intercept: float
    alpha: float

    def column(self) -> Column:
        """Impute, standardise and sum: an expression, whatever the size of the table."""
        out = F.lit(self.intercept)
        for f, d, m, s, c in zip(self.features, self.medians, self.means, self.scales, self.coefficients, strict=True):
            out = out + F.lit(c) * (F.coalesce(F.col(f).cast("double"), F.lit(d)) - F.lit(m)) / F.lit(s)
        return out


def sums(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str], medians: Sequence[float]) -> dict[tuple, np.ndarray]:
    """For each group the matrix of sums of products of (1, features, target), by one aggregation."""
    cols = [F.lit(1.0), *[F.coalesce(F.col(f).cast("double"), F.lit(m)) for f, m in zip(features, medians, strict=True)], F.col(target).cast("double")]
    n = len(cols)
    cells = [(i, j) for i in range(n) for j in range(i, n)]
    rows = df.where(F.col(target).isNotNull()).groupBy(*by).agg(*[F.sum(cols[i] * cols[j]).alias(f"_{i}_{j}") for i, j in cells]).collect()  # a row for each group
    out = {}
    for r in rows:
        m = np.zeros((n, n))
        for i, j in cells:
            m[i, j] = m[j, i] = r[f"_{i}_{j}"]
        out[tuple(r[b] for b in by)] = m
    return out


def medians_of(df: DataFrame, features: Sequence[str]) -> list[float]:
    rows = [quantiles(df, [], f, [0.5]).first() for f in features]
    return [float(r["quantiles"][0] or 0.0) if r else 0.0 for r in rows]


def solve(m: np.ndarray, features: Sequence[str], medians: Sequence[float], alpha: float) -> Ridge:
    """Standardised with population deviations; the intercept isn't shrunk."""
    n = m[0, 0]
    mean, ty = m[0, 1:-1] / n, m[0, -1] / n
    cov, cy = m[1:-1, 1:-1] - n * np.outer(mean, mean), m[1:-1, -1] - n * mean * ty
    scale = np.sqrt(np.maximum(np.diag(cov) / n, 0))
    scale[scale < 1e-12] = 1.0
    z = cov / np.outer(scale, scale)
    w = np.linalg.solve(z + alpha * np.eye(len(mean)), cy / scale)
    return Ridge(list(features), list(medians), mean.tolist(), scale.tolist(), w.tolist(), float(ty), alpha)


def squared_error(m: np.ndarray, model: Ridge) -> float:
    """Sum of squared errors on the rows behind a matrix of sums."""
    w = np.array(model.coefficients) / model.scales
    v = np.r_[model.intercept - w @ np.array(model.means), w, -1.0]
    return float(v @ m @ v)


def cross_validated(by_fold: list[np.ndarray], features: Sequence[str], medians: Sequence[float], alphas: Sequence[float] = ALPHAS) -> Ridge:
    """The alpha with the least error over folds left out in turn, refitted on all; all from the folds' sums."""
    total = np.sum(by_fold, axis=0)
    def error(a: float) -> float:
        return sum(squared_error(f, solve(total - f, features, medians, a)) for f in by_fold)
    return solve(total, features, medians, min(alphas, key=error) if len(by_fold) > 1 else 1.0)


def band_holdout(df: DataFrame, features: Sequence[str], target: str, band: str, folds: int = 5) -> tuple[dict[str, Ridge], Ridge]:
    """A model for each band, fitted without it, and one of all; one pass over the table."""
    medians = medians_of(df, features)
    fold = F.pmod(F.xxhash64(*features, target), F.lit(folds))
    parts = sums(df.withColumn("_fold", fold), features, target, [band, "_fold"], medians)
    bands = sorted({b for b, _ in parts}, key=str)
    group = lambda keep: [np.sum([m for (b, f), m in parts.items() if f == i and keep(b)] or [np.zeros((len(features) + 2,) * 2)], axis=0) for i in range(folds)]
    usable = lambda g: [m for m in g if m[0, 0] > 0]
    models = {b: cross_validated(usable(group(lambda x, b=b: x != b)), features, medians) for b in bands if usable(group(lambda x, b=b: x != b))}
    return models, cross_validated(usable(group(lambda x: True)), features, medians)


def by_band(models: dict[str, Ridge], band: str) -> Column:
    out = F.lit(None).cast("double")
    for b, m in models.items():
        out = F.when(F.col(band) == b, m.column()).otherwise(out)
    return out


def tree(node: dict, fill: dict[str, float] | None = None) -> Column:
    """A tree as nested conditions: {feature, threshold, left, right} or {value}; `<=` goes left, null goes right unless it is filled."""
    if "value" in node and "feature" not in node:
        return F.lit(float(node["value"]))
    x = F.col(node["feature"])
    x = F.coalesce(x.cast("double"), F.lit(float(fill[node["feature"]]))) if fill else x
    return F.when(x <= node["threshold"], tree(node["left"], fill)).otherwise(tree(node["right"], fill))


def forest(trees: Sequence[dict], initial: float, rate: float) -> Column:
    out = F.lit(float(initial))
    for t in trees:
        out = out + F.lit(float(rate)) * tree(t)
    return out


def multi_seed_cv(df: DataFrame, features: Sequence[str], target: str, seeds: Sequence[int], folds: int = 5, alpha: float = 10.0) -> DataFrame:
    """seed, n, mae of predictions by models that have not seen the row's fold; folds are dealt by a seeded hash of the row.

    One pass makes the sums of all seeds and folds, another the errors."""
    medians = medians_of(df, features)
    fold = F.pmod(F.xxhash64(F.col("_seed"), *features, target), F.lit(folds))
    long = df.withColumn("_seed", F.explode(F.array(*map(F.lit, seeds)))).withColumn("_fold", fold)
    parts = sums(long, features, target, ["_seed", "_fold"], medians)
    pred = F.lit(None).cast("double")
    for s in seeds:
        total = np.sum([m for (k, _), m in parts.items() if k == s], axis=0)
        for f in range(folds):
            rest = total - parts.get((s, f), 0)
            if np.ndim(rest) and rest[0, 0] > 0:
                pred = F.when((F.col("_seed") == s) & (F.col("_fold") == f), solve(rest, features, medians, alpha).column()).otherwise(pred)
    return long.where(F.col(target).isNotNull()).groupBy(F.col("_seed").alias("seed")).agg(F.count("*").alias("n"), F.avg(F.abs(pred - F.col(target))).alias("mae"))


def prefer(mae_a: float, mae_b: float, factor: float = 0.995) -> str:
    """The second variant only if its error is below `factor` times the first's."""
    return "B" if mae_b < factor * mae_a else "A"


#: Depth, number of trees and learning rate of the boosted models that are tried.
GRID = ((2, 20, 0.1), (3, 20, 0.1), (3, 40, 0.05), (4, 20, 0.1), (3, 20, 0.2))

#: Rows of a task that grows trees.
TASK_ROWS = 50_000


def boosted(df: DataFrame, features: Sequence[str], target: str, grid: Sequence[tuple[int, int, float]] = GRID, folds: int = 3, seed: int = 0) -> dict:
    """Boosted trees as {initial, trees: [{weight, tree}], features, depth, rate}: the setting with the least squared error over folds, refitted on all rows.

    Nulls are filled by medians, which the result holds."""
    medians = medians_of(df, features)
    filled = df.where(F.col(target).isNotNull()).select(*[F.coalesce(F.col(f).cast("double"), F.lit(m)).alias(f) for f, m in zip(features, medians, strict=True)], F.col(target).cast("double").alias("_y"))
    tasks = max(1, -(-filled.count() // TASK_ROWS))  # not by cores, as Spark's candidate splits depend on the tasks; a file's few bytes are many rows, which each tree reads again
    rows = VectorAssembler(inputCols=list(features), outputCol="_x").transform(filled.repartition(tasks)).withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), *features, "_y"), F.lit(folds)))
    fit = lambda part, depth, n, rate: GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol="_p", maxDepth=depth, maxIter=n, stepSize=rate, seed=seed).fit(part)
    error = lambda setting: sum(fit(rows.where(F.col("_fold") != f), *setting).transform(rows.where(F.col("_fold") == f)).agg(F.coalesce(F.sum((F.col("_p") - F.col("_y")) ** 2), F.lit(0.0))).first()[0] for f in range(folds))
    best = min(grid, key=error) if len(grid) > 1 else grid[0]
    model = fit(rows, *best)
    trees = [{"weight": w, "tree": parse_tree(t.toDebugString, features)} for w, t in zip(model.treeWeights, model.trees, strict=True)]
    return {"initial": 0.0, "trees": trees, "features": list(features), "medians": medians, "depth": best[0], "rate": best[2]}


def parse_tree(text: str, features: Sequence[str]) -> dict:
    """A tree of {feature, threshold, left, right} and {value} from Spark's description of it."""
    lines = [line.strip() for line in text.splitlines()[1:] if line.strip()]
    at = 0

    def node() -> dict:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict:"):
            return {"value": float(line.split(":")[1])}
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        left = node()
        at += 1  # Else
        return {"feature": features[int(m[1])], "threshold": float(m[2]), "left": left, "right": node()}

    return node()


def boosted_column(model: dict) -> Column:
    """The prediction of what `boosted` gives, nulls filled by its medians."""
    fill = dict(zip(model["features"], model["medians"], strict=True)) if model["medians"] else None
    out = F.lit(float(model["initial"]))
    for t in model["trees"]:
        out = out + F.lit(float(t["weight"])) * tree(t["tree"], fill)
    return out


def trees_json(model: dict) -> str:
    """What `boosted` gives as text: meta (number of trees, depth, learning rate, initial value, feature names, medians) and trees of nodes, leaves {type, value} and
    splits {type, feature, feature_name, threshold, left, right} that name their children by number. A prediction is the initial value and the rate times the sum of the leaves."""
    names, rate = list(model["features"]), float(model["rate"])

    def nodes(root: dict, weight: float) -> list[dict]:
        out: list[dict] = []

        def add(node: dict) -> int:
            at = len(out)
            if "value" in node and "feature" not in node:
                out.append({"type": "leaf", "value": float(node["value"]) * weight / rate})
                return at
            split = {"type": "split", "feature": names.index(node["feature"]), "feature_name": node["feature"], "threshold": float(node["threshold"])}
            out.append(split)
            split["left"], split["right"] = add(node["left"]), add(node["right"])
            return at

        add(root)
        return out

    meta = {"n_estimators": len(model["trees"]), "max_depth": int(model["depth"]), "learning_rate": rate, "init_value": float(model["initial"]), "feature_names": names, "imputer_medians": list(model["medians"])}
    return json.dumps({"meta": meta, "trees": [{"nodes": nodes(t["tree"], float(t["weight"]))} for t in model["trees"]]}, indent=2)


def trees_from_json(text: str) -> dict:
    """A model for `boosted_column` from that text, whoever wrote it; without medians nulls go right."""
    data = json.loads(text)
    meta, names = data["meta"], list(data["meta"]["feature_names"])

    def node(nodes: list[dict], at: int, above: frozenset[int] = frozenset()) -> dict:
        if at in above or not 0 <= at < len(nodes):
            raise ValueError("the nodes of a tree have to lead from the first to leaves")
        n = nodes[at]
        if n["type"] == "leaf":
            return {"value": float(n["value"])}
        return {"feature": names[n["feature"]], "threshold": float(n["threshold"]), "left": node(nodes, n["left"], above | {at}), "right": node(nodes, n["right"], above | {at})}

    rate = float(meta["learning_rate"])
    trees = [{"weight": rate, "tree": node(t["nodes"], 0)} for t in data["trees"]]
    return {"initial": float(meta["init_value"]), "trees": trees, "features": names, "medians": meta.get("imputer_medians"), "depth": int(meta["max_depth"]), "rate": rate}


def linear_json(model: Ridge, name: str, rows: int, error: float) -> str:
    """A linear model as text, with the number of rows it was fitted to and its mean absolute error on them."""
    told = {"name": name, "feature_names": model.features, "means": model.means, "scales": model.scales, "coefficients": model.coefficients, "intercept": model.intercept, "imputer_medians": model.medians, "training_n": rows, "training_mae": error}
    return json.dumps(told | {"alpha": model.alpha}, indent=2)


def linear_from_json(text: str) -> Ridge:
    m = json.loads(text)
    return Ridge(m["feature_names"], m["imputer_medians"], m["means"], m["scales"], m["coefficients"], m["intercept"], float(m.get("alpha", float("nan"))))
