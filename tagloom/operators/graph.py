"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, release
from .ranking import keyed_running_total


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b of any one orderable type. Gives node, component (the least node reachable) of every node of an edge, loops included.

    Rounds group and join by node only, and go on until nothing changes, which takes about the logarithm of the longest
    path. Each round's edges go to the shared folder, and the edges of the round before go from there; their number never grows."""
    given = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    current = given.where("u <> v")
    before = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(down.select("u", F.col("m").alias("v")))
        after = materialize(stars.distinct())
        if before is not None:
            release(current)
        current = after
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = stars.union(centres)
    loops = given.where("u = v").select(F.col("u").alias("node"))
    if loops.isEmpty():
        release(given)
        return found
    return found.union(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))


def label_by_size(members: DataFrame, prefix: str = "sp", digits: int = 4) -> DataFrame:
    """Names components by falling size, the least node first among equals: prefix0001, prefix0002, ..."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    kinds = sizes.groupBy("size").agg(F.count("*").alias("c"))  # a row for each size
    before = kinds.select(F.col("size").alias("_size"), (F.sum("c").over(Window.orderBy(F.desc("size"))) - F.col("c")).alias("_before"))
    ranked = keyed_running_total(sizes.withColumn("_one", F.lit(1)), ["size"], "component", "_one", "_own").join(F.broadcast(before), F.col("size") == F.col("_size"))  # fewer rows than the root of twice the nodes
    named = ranked.select("component", "size", F.concat(F.lit(prefix), F.lpad((F.col("_before") + F.col("_own")).cast("string"), digits, "0")).alias("label"))
    return members.join(named, "component")
