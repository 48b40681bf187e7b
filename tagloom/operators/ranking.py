"""Ranks, top rows, samples and running totals."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, small


def average_rank(partition: Sequence[str], by: str) -> Column:
    """Ranks from 1 by rising value; equal values share the mean of their ranks."""
    over = Window.partitionBy(*partition)
    return F.rank().over(over.orderBy(by)) + (F.count("*").over(Window.partitionBy(*partition, by)) - 1) / 2.0


def top_k(df: DataFrame, partition: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark keeps k rows a group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col(rank) <= k)


def top_hit(df: DataFrame, query: str, target: str, score: str) -> DataFrame:
    """The best target of each query, the least name of ties; by partial aggregation."""
    best = F.min(F.struct((-F.col(score)).alias("_s"), F.col(target)))
    return df.where(F.col(score).isNotNull()).groupBy(query).agg(best.alias("_b")).select(query, F.col(f"_b.{target}").alias(target), (-F.col("_b._s")).alias(score))


def top_hit_with_fallback(df: DataFrame, query: str, target: str, score: str, coverage: str, least: float) -> DataFrame:
    """The best score among rows with enough coverage, else the row with the most coverage."""
    key = lambda c: F.struct((-F.col(c)).alias("_s"), F.col(target), F.col(score).alias("_v"))
    good = F.min(F.when(F.col(coverage) >= least, key(score)))
    out = df.groupBy(query).agg(good.alias("_g"), F.min(key(coverage)).alias("_f"))
    pick = F.coalesce("_g", "_f")
    return out.select(query, pick[target].alias(target), pick["_v"].alias(score), F.when(F.col("_g").isNotNull(), "score").otherwise("coverage").alias("chosen_by"))


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in the given order."""
    return top_k(df, keys, order, 1, "_rn").drop("_rn")


def quantile_bins(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """Bins between exact quantiles, (low, high] with the least value in the first; equal edges are merged.

    The edges are one row, so the join with them sends a constant amount."""
    points = [i / bins for i in range(bins + 1)]
    edges = quantiles(df, [], value, points).select(F.array_distinct("quantiles").alias("_edges"))
    above = sum((F.when(F.col(value) > F.get("_edges", F.lit(i)), 1).otherwise(0) for i in range(bins + 1)), F.lit(0))
    return df.join(F.broadcast(edges)).withColumn(name, F.when(F.col(value).isNotNull(), F.greatest(above, F.lit(1)) - 1)).drop("_edges")


def round_robin(df: DataFrame, bin_: str, order: Sequence[Column], k: int) -> DataFrame:
    """k rows taken in turn from the bins: first of each bin, then second of each, and so on."""
    ranked = top_k(df, [bin_], order, k, "turn")
    return ranked.orderBy("turn", bin_).limit(k)


def round_robin_capped(df: DataFrame, band: str, bin_: str, entities: Sequence[str], order: str, k: int, cap: int) -> DataFrame:
    """As round_robin within each band, but no entity is taken more than cap times; null is an entity. Sequential by nature: a band is one task;
    only rows that may be taken or stand before such a row are sent there.

    At most m * k / cap entities of m columns are ever used up. So of the rows of a bin with the same entities in all columns only the first
    cap can be taken; of those with the same entities in j of them, others used up refuse (m - j) times as many as j + 1 leave, and cap are taken."""
    columns = [band, bin_, *entities, order]
    few, by, m = df.select(*columns), [F.col(order), *[F.col(e) for e in entities]], len(entities)
    most = cap
    for j in range(m, 0, -1):
        for same in combinations(entities, j):
            few = top_k(few, [band, bin_, *same], by, most, "_rn").drop("_rn")
        most = (cap if j > 1 else k) + m * k // cap * (m - j + 1) * most
    few = top_k(few, [band, bin_], by, most, "_rn").drop("_rn")
    schema = few.schema

    def take(pdf):  # noqa: ANN001, ANN202
        used: dict = {}
        queues = [deque(g.sort_values([order, *entities]).to_dict("records")) for _, g in pdf.groupby(bin_, sort=True)]
        out = []
        while len(out) < k and any(queues):
            for q in queues:
                while q:
                    row = q.popleft()
                    names = {None if row[e] != row[e] else row[e] for e in entities}
                    if all(used.get(n, 0) < cap for n in names):
                        for n in names:
                            used[n] = used.get(n, 0) + 1
                        out.append(row)
                        break
                if len(out) == k:
                    break
        return type(pdf)(out, columns=columns)

    return few.groupBy(band).applyInPandas(take, schema)


def stratified_sample(df: DataFrame, stratum: str, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """n rows of each stratum in the order of a seeded hash of their keys: the same rows on every run and layout."""
    return top_k(df, [stratum], [F.xxhash64(F.lit(seed), *keys), *map(F.col, keys)], n, "_rn").drop("_rn")


def even_pick(df: DataFrame, order: Sequence[str], step: int, partition: Sequence[str]) -> DataFrame:
    """Every step-th row of each group in order, beginning with the first."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where((F.col("_rn") - 1) % step == 0).drop("_rn")


#: Rows that one range of a running total may have before they are dealt out, and into how many ranges.
MOST_IN_ORDER, RANGES, STEP = 1_000_000, 1024, 16


def running_total(df: DataFrame, order: str, value: str, name: str, most: int = MOST_IN_ORDER) -> DataFrame:
    """Inclusive running sum in the order of a column with distinct values.

    Beyond `most` rows they are dealt by ranges; sums run within a range and over one row for each range, so no task sees all rows."""
    return keyed_running_total(df, [], order, value, name, most)


def matched(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """df with the other columns of side, which has one row at most for each key; null keys are equal. Without keys side is one row at most."""
    if not keys:
        return df.join(F.broadcast(side), how=how, on=F.lit(True))
    renamed = side.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[c for c in side.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return df.join(renamed, same, how).drop(*[f"_key{i}" for i in range(len(keys))])


def keyed_running_total(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, most: int = MOST_IN_ORDER) -> DataFrame:
    """As running_total within each key (which may be null): a key of more than `most` rows is dealt by ranges, so no task sees all of its rows."""
    points = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    edges = df.groupBy(*keys).agg(F.percentile_approx(order, points, 10 * RANGES).alias("_edges"), F.count("*").alias("_rows")).where(F.col("_rows") > most).select(*keys, "_rows", F.array_sort(F.array_distinct("_edges")).alias("_edges"))
    every = lambda values, n: F.transform(F.sequence(F.least(n, F.size(values)), F.size(values), n), lambda i: F.get(values, i - 1))
    step = F.greatest(F.floor(F.lit(RANGES * most / 4) / F.col("_rows")), F.lit(1)).cast("int")  # ranges of about a quarter of `most`, as each row meets the edges
    edges = edges.select(*keys, every(F.col("_edges"), step).alias("_edges")).withColumn("_coarse", every(F.col("_edges"), F.lit(STEP)))
    below = lambda values: F.size(F.filter(values, lambda e: F.col(order) > e))
    first = below("_coarse") * STEP  # the range is looked for among every STEP-th edge, then among the STEP edges there
    part = F.when(F.col("_edges").isNull(), F.lit(0)).otherwise(first + below(F.slice("_edges", first + 1, STEP)))
    # A row of edges stands for over `most` rows, so the edges are few; a join by a few keys would leave all rows to as many tasks.
    ranged = matched(df, F.broadcast(edges), keys, "left").withColumn("_part", part).drop("_edges", "_coarse").repartition(*keys, "_part")  # once for both that follow
    sums = ranged.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    before = sums.select(*keys, "_part", (F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_sum")).alias("_before"))  # at most RANGES rows of a key
    within = ranged.withColumn("_within", F.sum(value).over(Window.partitionBy(*keys, "_part").orderBy(order)))
    both = matched(within, before, [*keys, "_part"])
    return both.withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """keys, n and quantiles (an array), interpolated between neighbours: exact, from counts of distinct values dealt by ranges. Nulls don't count."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    return counted_quantiles(counted, keys, points)


def counted_quantiles(counted: DataFrame, keys: Sequence[str], points: Sequence[float]) -> DataFrame:
    """As quantiles, from keys, _v and _c: each value once with how often it occurs."""
    ranked = keyed_running_total(counted, keys, "_v", "_c", "_upto")
    joined = matched(ranked, counted.groupBy(*keys).agg(F.sum("_c").alias("_size")), keys)
    place = [(F.col("_size") - 1) * F.lit(float(p)) for p in points]
    ends = [(F.min(F.when(F.col("_upto") > F.floor(h), F.col("_v"))).alias(f"_l{i}"), F.min(F.when(F.col("_upto") > F.ceil(h), F.col("_v"))).alias(f"_h{i}")) for i, h in enumerate(place)]
    out = joined.groupBy(*keys).agg(F.first("_size").alias("_size"), *[c for pair in ends for c in pair])
    between = [F.col(f"_l{i}") + (h - F.floor(h)) * (F.col(f"_h{i}") - F.col(f"_l{i}")) for i, h in enumerate(place)]
    return out.where("_size IS NOT NULL").select(*keys, F.col("_size").alias("n"), F.array(*between).alias("quantiles"))


#: Buckets to a factor of e, and what a value counts as beside 1, in a logarithmic scale that holds values of both signs.
PER_E, UNIT = 1024, 1024.0


def bucket(value: Column) -> Column:
    """A whole number that never falls as the value rises; NaN stands with infinity. Values far from 0 share one if they differ by about a thousandth."""
    scaled = F.floor(F.signum(value) * F.log1p(F.abs(value) * UNIT) * PER_E)
    return F.when(F.isnan(value), F.lit((1 << 63) - 1)).otherwise(scaled)


def middle_buckets(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, _b, _n, _ahead: the one or two buckets of each key that hold its middle, with the rows of the key and those before the bucket. counts: keys, _b, _c; a small table."""
    over = Window.partitionBy(*keys)
    told = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c"))
    told = told.withColumn("_n", F.sum("_c").over(over)).withColumn("_ahead", F.sum("_c").over(over.orderBy("_b")) - F.col("_c"))  # a row for each bucket
    holds = lambda place: (F.col("_ahead") <= place) & (F.col("_ahead") + F.col("_c") > place)
    return materialize(told.where(holds(F.floor((F.col("_n") - 1) / 2)) | holds(F.ceil((F.col("_n") - 1) / 2))).select(*keys, "_b", "_n", "_ahead"))


def middles(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and median, from all values (_v) of the middle buckets: keys, _b, _n, _ahead, _v."""
    counts = values.groupBy(*keys, "_b", "_n", "_ahead", "_v").agg(F.count("*").alias("_c"))
    upto = keyed_running_total(counts, [*keys, "_b"], "_v", "_c", "_upto").withColumn("_upto", F.col("_upto") + F.col("_ahead"))
    holds = lambda place: (F.col("_upto") > place) & (F.col("_upto") - F.col("_c") <= place)
    middle = [F.max(F.when(holds(f((F.col("_n") - 1) / 2)), F.col("_v"))) for f in (F.floor, F.ceil)]
    return upto.groupBy(*keys).agg(((middle[0] + middle[1]) / 2).alias("median"))


def medians(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys and the exact median of each, by two passes: counts by buckets of values, then the values of the buckets in the middle only. Nulls don't count."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_b", bucket(F.col("_v")))
    needed = middle_buckets(rows.groupBy(*keys, "_b").agg(F.count("*").alias("_c")), keys)
    return middles(matched(rows, small(needed), [*keys, "_b"]), keys)


def random_subset(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a seeded hash of their keys."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def shuffled(df: DataFrame, keys: Sequence[str], seed: int = 0) -> DataFrame:
    """All rows in the order of a seeded hash of their keys."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)
