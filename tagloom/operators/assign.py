"""Assignment of contigs and bins: majorities, length statistics, classes."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def n50(df: DataFrame, group: str, length: str) -> DataFrame:
    """The length at which the lengths of a group, longest first, sum to half of its total.

    Lengths are counted first, so a group's running sum goes over its distinct lengths."""
    counts = df.groupBy(group, length).agg((F.count("*") * F.first(length)).alias("_bp"))
    over = Window.partitionBy(group).orderBy(F.desc(length))
    run = F.sum("_bp").over(over.rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("_run", run).withColumn("_all", F.sum("_bp").over(Window.partitionBy(group))).where("2 * _run >= _all").groupBy(group).agg(F.max(length).alias("n50"))


def majority(df: DataFrame, key: str, target: str, weight: str, places: int = 6) -> DataFrame:
    """The target with the largest sum for each key, the least target of ties, and the share of the others."""
    sums = df.groupBy(key, target).agg(F.sum(weight).alias("_bp"))
    best = sums.groupBy(key).agg(F.min(F.struct((-F.col("_bp")).alias("n"), F.col(target).alias("t"))).alias("_m"), F.sum("_bp").alias("_total"))
    top, total = -F.col("_m.n"), F.col("_total")
    return best.select(key, F.col("_m.t").alias("majority"), top.alias("majority_bp"), (total - top).alias("other_bp"), F.round(F.try_divide(total - top, total) * 100, places).alias("contam_pct"))


class Rooms:
    """Free room of batches, the first with enough of it found in a tree of maxima."""

    def __init__(self, most: int) -> None:
        self.most, self.used, self.leaves = most, 0, 1
        self.tree = [0, most]  # the root is 1, the children of i are 2 i and 2 i + 1; unused batches have all their room

    def put(self, n: int) -> int:
        if n > self.most:  # a batch of its own, without room for others
            at, room = self.used, 0
        else:
            if self.tree[1] < n or self.used >= self.leaves:
                self._grow()
            at = 1
            while at < self.leaves:
                at = 2 * at if self.tree[2 * at] >= n else 2 * at + 1
            room, at = self.tree[at] - n, at - self.leaves
        while at >= self.leaves:
            self._grow()
        self.used = max(self.used, at + 1)
        i = at + self.leaves
        self.tree[i] = room
        while i > 1:
            i //= 2
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])
        return at

    def _grow(self) -> None:
        """Twice as many batches."""
        level = self.tree[self.leaves :] + [self.most] * self.leaves
        levels = [level]
        while len(levels[0]) > 1:
            below = levels[0]
            levels.insert(0, [max(below[i], below[i + 1]) for i in range(0, len(below), 2)])
        self.leaves, self.tree = 2 * self.leaves, [0, *[x for part in levels for x in part]]


def first_fit_decreasing(df: DataFrame, keys: Sequence[str], item: str, size: str, most: int) -> DataFrame:
    """df: keys, item, size. Items of a key, the largest and then the least name first, go into the first batch with room; larger ones than a batch get one of their own.

    Sequential by nature: the items of a key, one row each, are one task, in as many steps as a tree of the batches' room is deep."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*keys, item, size))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([size, item], ascending=[False, True])
        rooms = Rooms(most)
        return pdf.assign(batch=[rooms.put(n) for n in pdf[size].tolist()])

    return df.select(*keys, item, size).groupBy(*keys).applyInPandas(run, f"{kinds}, batch int")
