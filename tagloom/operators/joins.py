"""Joins by meaning: lookups in several roles, unordered pairs, exclusions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, key: str, dimension: DataFrame, dim_key: str, value: str, name: str, keep_unmatched: bool = True) -> DataFrame:
    """df with a value of a dimension under a new name; unmatched rows have null or, if not kept, go."""
    side = dimension.select(F.col(dim_key).alias("_key"), F.col(value).alias(name))
    return df.join(side, F.col(key) == F.col("_key"), "left" if keep_unmatched else "inner").drop("_key")


def unordered(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs with the lesser side first, without pairs of one thing with itself."""
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b), *[c for c in df.columns if c not in (a, b)])


def both_ways(df: DataFrame, a: str, b: str) -> DataFrame:
    """Every pair in either order."""
    rest = [c for c in df.columns if c not in (a, b)]
    return df.select(a, b, *rest).union(df.select(F.col(b).alias(a), F.col(a).alias(b), *rest))


def exclude_pairs(df: DataFrame, excluded: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose pair, in either order, isn't excluded."""
    return df.join(both_ways(excluded.select(a, b), a, b).distinct(), [a, b], "left_anti")


def stitch(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row for each key of any table with the columns of all: one aggregation in place of a chain of full joins."""
    union = tables[0]
    for t in tables[1:]:
        union = union.unionByName(t, allowMissingColumns=True)
    return union.groupBy(*keys).agg(*[F.first(c, ignorenulls=True).alias(c) for c in union.columns if c not in keys])


def star(df: DataFrame, dimensions: Sequence[tuple[DataFrame, str]], defaults: dict[str, object]) -> DataFrame:
    """df with the columns of each dimension, joined to the left by its key, and defaults where there is no match."""
    for side, key in dimensions:
        df = df.join(side, key, "left")
    return df.fillna(defaults)


def one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str], order_a: Sequence[str], order_b: Sequence[str]) -> DataFrame:
    """Rows of equal keys, each used once: the first of a with the first of b, the second with the second, and so on."""
    number = lambda df, order: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return number(a, order_a).join(number(b, order_b), [*keys, "_n"]).drop("_n")
