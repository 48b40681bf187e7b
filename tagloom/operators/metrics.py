"""Error metrics and statistics over groups, all by one aggregation each."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, small
from .ranking import bucket, keyed_running_total, matched, middle_buckets, middles, quantiles, running_total


def error_columns(pred: str, truth: str) -> dict[str, Column]:
    """n, mae, rmse, bias, r of pred against truth; rows with a null on either side don't count."""
    e = F.col(pred) - F.col(truth)
    both = e.isNotNull()
    return {
        "n": F.count(F.when(both, 1)),
        "mae": F.avg(F.abs(e)),
        "rmse": F.sqrt(F.avg(e * e)),
        "bias": F.avg(e),
        "r": F.corr(F.when(both, F.col(pred)), F.when(both, F.col(truth))),
    }


def r_squared(pred: str, truth: str) -> Column:
    """1 - SSE / SST, null where all truths are equal."""
    p, t = F.col(pred).cast("double"), F.col(truth).cast("double")
    n = F.count(F.when((p - t).isNotNull(), 1))
    t = F.when(p.isNotNull(), t)
    sst = F.sum(t * t) - F.sum(t) * F.sum(t) / F.nullif(n, F.lit(0))
    return 1 - F.sum((p - t) * (p - t)) / F.nullif(sst, F.lit(0.0))


def grouped_errors(df: DataFrame, group: str, pred: str, truth: str, min_n: int = 1, places: int = 6) -> DataFrame:
    """The metrics by group and, as group 'all', over everything; groups of fewer than min_n rows are left out."""
    cols = [c.alias(k) for k, c in error_columns(pred, truth).items()]
    out = df.groupingSets([[F.col(group)], []], F.col(group)).agg(*cols, F.grouping(F.col(group)).alias("_all"))
    label = F.when(F.col("_all") == 1, "all").otherwise(F.col(group).cast("string")).alias(group)
    return out.where(F.col("n") >= min_n).select(label, "n", *[F.round(c, places).alias(c) for c in ("mae", "rmse", "bias", "r")])


def metric_stack(df: DataFrame, dims: list[str], tools: list[str], truth: str, within: tuple[float, ...] = (0.1, 0.5, 1.0), places: int = 6) -> DataFrame:
    """For every tool, over everything and by each value of each dimension: mean, median and signed error, and the share within bounds.

    One pass adds up cells of all dimensions, tool and bucket of the error, which give all but the medians. These are exact: a second pass counts
    the errors of the buckets that hold a group's middle, so no row is written out for each group and no group's errors meet in one task."""
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tool"), (F.col(t).cast("double") - F.col(truth)).alias("e")) for t in tools])).alias("x")
    rows = df.select(*dims, each).where("x.e IS NOT NULL").select(*dims, "x.tool", "x.e", F.abs("x.e").alias("_v")).withColumn("_b", bucket(F.col("_v")))
    groups = F.explode(F.array(F.struct(F.lit("overall").alias("dim"), F.lit("all").alias("value")), *[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])).alias("g")
    by_group = lambda x: x.select(groups, *[c for c in x.columns if c not in dims]).select("g.dim", "g.value", *[c for c in x.columns if c not in dims])
    keys, bounds = ["dim", "value", "tool"], [f"within_{w}".replace(".", "_") for w in within]
    sums = [F.count("*").alias("_c"), F.sum("_v").alias("mae"), F.sum("e").alias("bias"), *[F.sum((F.col("_v") <= w).cast("double")).alias(b) for w, b in zip(within, bounds, strict=True)]]
    cells = by_group(materialize(rows.groupBy(*dims, "tool", "_b").agg(*sums)))
    out = cells.groupBy(*keys).agg(F.sum("_c").alias("n"), *[(F.sum(c) / F.sum("_c")).alias(c) for c in ("mae", "bias", *bounds)])
    needed = small(middle_buckets(cells, keys))
    near = matched(rows, small(needed.select("tool", "_b").distinct()), ["tool", "_b"]).drop("e")
    medians = middles(matched(by_group(near), needed, [*keys, "_b"]), keys).withColumnRenamed("median", "median_abs_err")
    numbers = ["mae", "median_abs_err", "bias", *bounds]
    return matched(out, medians, keys).select(*keys, "n", *[F.round(c, places).alias(c) for c in numbers])


def feature_correlations(df: DataFrame, features: list[str], target: str, min_n: int = 30, places: int = 6) -> DataFrame:
    """Pearson's r of each feature with the target over complete rows."""
    long = df.select(target, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("s")).select(target, "s.*")
    long = long.where(F.col("x").isNotNull() & F.col(target).isNotNull())
    return long.groupBy("feature").agg(F.count("*").alias("n"), F.round(F.corr("x", target), places).alias("r")).where(F.col("n") >= min_n)


def spearman(df: DataFrame, x: str, y: str, group: str, min_n: int = 2, places: int = 6) -> DataFrame:
    """Rank correlation with shared ranks for ties, over rows without nulls.

    Ranks are those of distinct values, by their counts in ranges, so a group of any size is no single task."""
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(group).alias("_g"), F.col(x).alias("_x"), F.col(y).alias("_y"))

    def ranks(side: str) -> DataFrame:
        counts = full.groupBy("_g", side).agg(F.count("*").alias("_c"))
        told = keyed_running_total(counts, ["_g"], side, "_c", "_upto")
        return told.select("_g", side, (F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2).alias(f"_r{side}"))

    ranked = matched(matched(full, ranks("_x"), ["_g", "_x"]), ranks("_y"), ["_g", "_y"])
    return ranked.groupBy(F.col("_g").alias(group)).agg(F.count("*").alias("n"), F.round(F.corr("_r_x", "_r_y"), places).alias("rho")).where(F.col("n") >= min_n)


def auc(df: DataFrame, label: str, score: str, places: int = 6) -> DataFrame:
    """The chance that a row labelled 1 scores above one labelled 0, ties counting half.

    Ranks come from counts of distinct scores, so equal scores are one row; the running sum is taken
    within ranges of scores and over one row for each range."""
    values = df.where(F.col(score).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("c"), F.sum(label).alias("p"))
    ranked = running_total(values, "s", "c", "below")
    mean_rank = F.col("below") - F.col("c") + (F.col("c") + 1) / 2.0
    out = ranked.agg(F.sum("p").alias("n_pos"), F.sum(F.col("c") - F.col("p")).alias("n_neg"), F.sum(F.col("p") * mean_rank).alias("w"))
    u = F.col("w") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0
    return out.select("n_pos", "n_neg", F.round(F.try_divide(u, (F.col("n_pos") * F.col("n_neg")).cast("double")), places).alias("auc"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of all pairs of values with margins 'all'."""
    out = df.cube(a, b).agg(F.count("*").alias("n"), F.grouping(a).alias("_a"), F.grouping(b).alias("_b"))
    return out.select(F.when(F.col("_a") == 1, "all").otherwise(F.col(a)).alias(a), F.when(F.col("_b") == 1, "all").otherwise(F.col(b)).alias(b), "n")


def consensus(df: DataFrame, key: str, value: str, weight: str, truth: str, trim: float = 0.1, places: int = 6) -> DataFrame:
    """Mean, weighted mean, median and trimmed mean of the values of a key, and the value nearest to its truth (the least one of ties).

    Median and trimmed mean come from counts of distinct values and their running totals, in ranges where a key has very many."""
    grouped = df.groupBy(key).agg(
        F.count("*").alias("n"),
        F.avg(value).alias("mean"),
        F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight).cast("double")).alias("weighted"),
        F.min_by(F.col(value).cast("double"), F.struct(F.round(F.abs(F.col(value) - F.col(truth)), 9), F.col(value).cast("double"))).alias("oracle"),
    )
    counts = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    upto = matched(keyed_running_total(counts, [key], "_v", "_c", "_upto"), counts.groupBy(key).agg(F.sum("_c").alias("_n")), [key])
    cut = F.floor(F.col("_n") * trim)
    kept = F.greatest(F.least(F.col("_upto"), F.col("_n") - cut) - F.greatest(F.col("_upto") - F.col("_c"), cut), F.lit(0))
    holds = lambda place: (F.col("_upto") > place) & (F.col("_upto") - F.col("_c") <= place)
    middle = [F.max(F.when(holds(f((F.col("_n") - 1) / 2)), F.col("_v"))) for f in (F.floor, F.ceil)]
    ordered = upto.groupBy(key).agg(((middle[0] + middle[1]) / 2).alias("median"), (F.sum(F.col("_v") * kept) / F.sum(kept)).alias("trimmed"))
    return matched(grouped, ordered, [key], "left").select(key, "n", *[F.round(c, places).alias(c) for c in ("mean", "weighted", "median", "trimmed", "oracle")])


def rule_sweep(df: DataFrame, rules: dict[str, Callable[[Column], Column]], cuts: Sequence[float], switched: str, kept: str, truth: str, places: int = 6) -> DataFrame:
    """For each family of rules and each cut: how many rows take the switched estimate, and the error that results. rules: a condition for a cut."""
    long = df.select("*", F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(float(c)).alias("cut"), F.coalesce(rule(F.lit(float(c))), F.lit(False)).alias("on")) for f, rule in rules.items() for c in cuts])).alias("r"))
    e = F.abs(F.when(F.col("r.on"), F.col(switched)).otherwise(F.col(kept)) - F.col(truth))
    return long.groupBy(F.col("r.family").alias("family"), F.col("r.cut").alias("cut")).agg(F.count("*").alias("n"), F.sum(F.col("r.on").cast("int")).alias("n_switched"), F.round(F.avg(e), places).alias("mae"))


def coverage(df: DataFrame, group: str, upper: str, truth: str, places: int = 6) -> DataFrame:
    """The share of rows whose truth is at most its upper bound, rows without either counting as not covered, and the median of bound less truth."""
    share = df.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(F.col(truth) <= F.col(upper), F.lit(False)).cast("double")), places).alias("covered"))
    gap = quantiles(df.select(group, (F.col(upper) - F.col(truth)).alias("_gap")), [group], "_gap", [0.5]).select(F.col(group).alias("_group"), F.round(F.col("quantiles")[0], places).alias("median_gap"))
    return share.join(gap, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")


def spread(df: DataFrame, keys: Sequence[str], value: str, places: int = 6) -> DataFrame:
    """Number, median, least and greatest value by keys."""
    ends = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    middle = quantiles(df, keys, value, [0.5]).select(*[F.col(k).alias(f"_{k}") for k in keys], F.round(F.col("quantiles")[0], places).alias("median"))
    return ends.join(middle, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])


def with_mean(df: DataFrame, keys: Sequence[str], repeat: str, value: str, places: int = 6) -> DataFrame:
    """The rows, with the repeat as text, and a row 'mean' over the repeats of each key."""
    base = df.select(*keys, F.col(repeat).cast("string").alias(repeat), F.round(value, places).alias(value))
    return base.union(df.groupBy(*keys).agg(F.lit("mean").alias(repeat), F.round(F.avg(value), places).alias(value)).select(*keys, repeat, value))


def decomposed(df: DataFrame, keys: Sequence[str], pred: str, truth: str, places: int = 6) -> DataFrame:
    """For each group: bias, deviation around it, and its share of the summed absolute error."""
    e = df.select(*keys, (F.col(pred) - F.col(truth)).alias("_e")).where("_e IS NOT NULL")
    total = e.agg(F.sum(F.abs("_e")).alias("_total"))
    out = e.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_e").alias("bias"), F.stddev_pop("_e").alias("deviation"), F.sum(F.abs("_e")).alias("_own"))
    return out.join(F.broadcast(total)).select(*keys, "n", F.round("bias", places).alias("bias"), F.round("deviation", places - 1).alias("deviation"), F.round(F.try_divide("_own", "_total"), places).alias("share"))  # one row of totals


def kept_and_flagged(df: DataFrame, groups: Sequence[str], error: Column, flag: Column) -> DataFrame:
    """groups, kept_mae, n_kept, flagged_mae, n_flagged, inverted: errors of kept and flagged rows, and whether the flag does harm as flagged rows are the better ones.

    A null flag keeps; null errors don't count; without flagged or kept rows nothing is inverted."""
    rows = df.select(*groups, F.abs(error).alias("_e"), F.coalesce(flag, F.lit(False)).alias("_f")).where(F.col("_e").isNotNull())
    kept, flagged = (F.avg(F.when(c, F.col("_e"))) for c in (~F.col("_f"), F.col("_f")))
    out = rows.groupBy(*groups).agg(kept.alias("kept_mae"), F.sum((~F.col("_f")).cast("long")).alias("n_kept"), flagged.alias("flagged_mae"), F.sum(F.col("_f").cast("long")).alias("n_flagged"))
    return out.withColumn("inverted", F.coalesce(F.col("flagged_mae") < F.col("kept_mae"), F.lit(False)))
