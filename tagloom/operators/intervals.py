"""Intervals, nearest matches, islands and order breaks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_length(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Length of the union of half-open intervals by key; intervals that touch are merged."""
    over = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(over.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.where(F.col(start) < F.col(end)).withColumn("_reach", reach)
    new = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce("_reach", start)))
    merged = (F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))).cast("int")
    return flagged.withColumn("_new", new).withColumn("_isle", merged).groupBy(*keys).agg(F.sum("_new").alias("covered"), F.sum("_isle").alias("n_islands"))


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: float) -> DataFrame:
    """Runs of intervals whose next start lies at most gap beyond the run's reach."""
    over = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(over.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    numbered = df.withColumn("_new", begins).withColumn("island", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.count("*").alias("n"), F.min(start).alias("first"), F.max(end).alias("last"))


def _cells(low: Column, high: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))


def points_in_spans(points: DataFrame, spans: DataFrame, on: Sequence[str], pos: str, low: str, high: str, tolerance: float, width: float) -> DataFrame:
    """Pairs of points and spans with low - tolerance <= pos <= high + tolerance, by equal cells of the line: no theta join."""
    p = points.withColumn("_cell", F.floor(F.col(pos) / width))
    s = spans.withColumn("_cell", _cells(F.col(low) - tolerance, F.col(high) + tolerance, width))
    return p.join(s, [*on, "_cell"]).where((F.col(pos) >= F.col(low) - tolerance) & (F.col(pos) <= F.col(high) + tolerance)).drop("_cell")


def overlaps(a: DataFrame, b: DataFrame, on: Sequence[str], a_span: tuple[str, str], b_span: tuple[str, str], width: float) -> DataFrame:
    """Pairs of overlapping spans with the length of the overlap in `overlap`; each pair once, in the cell where the overlap begins."""
    left = a.withColumn("_cell", _cells(F.col(a_span[0]), F.col(a_span[1]), width))
    right = b.withColumn("_cell", _cells(F.col(b_span[0]), F.col(b_span[1]), width))
    begin, end = F.greatest(a_span[0], b_span[0]), F.least(a_span[1], b_span[1])
    return left.join(right, [*on, "_cell"]).where((end > begin) & (F.floor(begin / width) == F.col("_cell"))).withColumn("overlap", end - begin).drop("_cell")


def best_overlap(pairs: DataFrame, key: Sequence[str], other: str) -> DataFrame:
    """The longest overlap of each key, the least other of ties."""
    best = F.min(F.struct((-F.col("overlap")).alias("_o"), F.col(other)))
    return pairs.groupBy(*key).agg(best.alias("_b")).select(*key, F.col(f"_b.{other}").alias(other), (-F.col("_b._o")).alias("overlap"))


def nearest(pairs: DataFrame, key: Sequence[str], other: str, distance: Column) -> DataFrame:
    """The other row at the least distance from each key, the least other of ties."""
    best = F.min(F.struct(distance.alias("_d"), F.col(other)))
    return pairs.groupBy(*key).agg(best.alias("_b")).select(*key, F.col(f"_b.{other}").alias(other), F.col("_b._d").alias("distance"))


def multiset_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a left after each row of b has taken one with equal keys, the first in order."""
    numbered = a.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    taken = b.groupBy(*keys).agg(F.count("*").alias("_taken"))
    return numbered.join(taken, list(keys), "left").where(F.col("_n") > F.coalesce("_taken", F.lit(0))).drop("_n", "_taken")


def order_breaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], track: str, position: str) -> DataFrame:
    """By key: rows, and how often the position falls back while the track stays, or the track changes."""
    over = Window.partitionBy(*keys).orderBy(*order)
    last_track, last = F.lag(track).over(over), F.lag(position).over(over)
    turn = F.when(last_track.isNull(), 0).when(last_track != F.col(track), 0).when(F.col(position) < last, 1).otherwise(0)
    switch = F.when(last_track.isNotNull() & (last_track != F.col(track)), 1).otherwise(0)
    return df.withColumn("_b", turn).withColumn("_s", switch).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("_b").alias("n_breaks"), F.sum("_s").alias("n_switches"))


def two_axis_clusters(df: DataFrame, keys: Sequence[str], gap: float) -> DataFrame:
    """df: keys, r_start, r_end, q_start, q_end. Blocks in the order of r_start (then r_end, q_start, q_end) join the last cluster if they begin
    within `gap` of its reach on both axes, else begin one. Sequential by nature: the blocks of a key are one task, which reads them in order
    and holds the last cluster only."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)
    sides = ["r_start", "r_end", "q_start", "q_end"]
    names, width = [*keys, *sides, "n_blocks"], len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []
        made = lambda done: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((*k, *v) for k, *v in done), strict=True), types, strict=True)], names=names)
        key, last, whole = None, None, False
        for batch in batches:
            types = [*batch.schema.types[:width], *[pa.int64()] * 5]
            done = []
            columns = [c.to_pylist() for c in batch.columns]
            for own, r0, r1, q0, q1 in zip(zip(*columns[:width], strict=True), *columns[width:], strict=True):
                given = r0 is not None and r1 is not None and q0 is not None and q1 is not None
                low, high = (q0, q1) if not given or q0 <= q1 else (q1, q0)
                if own == key and given and whole and r0 - last[2] <= gap and low - last[4] <= gap:
                    if r1 > last[2]:
                        last[2] = r1
                    if low < last[3]:
                        last[3] = low
                    if high > last[4]:
                        last[4] = high
                    last[5] += 1
                else:
                    if last is not None:
                        done.append(last)
                    key, last, whole = own, [own, r0, r1, low, high, 1], given  # a block with a gap is a cluster by itself
            if done:
                yield made(done)
        if last is not None:
            yield made([last])

    rows = df.select(*keys, *[F.col(c).cast("long").alias(c) for c in sides])
    return rows.repartition(*keys).sortWithinPartitions(*keys, *[F.asc_nulls_last(c) for c in sides]).mapInArrow(run, f"{kinds}, r_start long, r_end long, q_start long, q_end long, n_blocks long")


def block_coverage(spans: DataFrame, keys: Sequence[str], start: str, end: str, width: int) -> DataFrame:
    """keys, block, covered: the share of each block of `width` that the union of the spans covers; blocks without any don't appear."""
    cells = spans.where(F.col(start) < F.col(end)).withColumn("block", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    low, high = F.greatest(F.col(start), F.col("block") * width), F.least(F.col(end), (F.col("block") + 1) * width)
    pieces = cells.select(*keys, "block", low.alias("_s"), high.alias("_e"))
    return union_length(pieces, [*keys, "block"], "_s", "_e").select(*keys, "block", (F.col("covered") / width).alias("covered"))


def binned_mean(df: DataFrame, x: str, y: str, low: float, high: float, bins: int, least: int = 3) -> DataFrame:
    """bin, n, x, y: means over equal bins of x, of those with at least `least` rows; the upper end is in the last bin."""
    number = F.least(F.floor((F.col(x) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    inside = df.where((F.col(x) >= low) & (F.col(x) <= high)).withColumn("bin", number)
    return inside.groupBy("bin").agg(F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y")).where(F.col("n") >= least)
