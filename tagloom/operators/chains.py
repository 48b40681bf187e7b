"""Collinear chaining of anchors, order statistics and structural calls.

Gap cost, predecessor window and the least number of anchors are parameters of
this library, chosen on its own simulated sequences.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import points_in_spans, union_length
from .ranking import quantiles
from .tags import strata

GAP_COST, LOOK_BACK, LEAST_ANCHORS, MOST_GAP, WINDOW = 0.01, 50, 4, 50_000, 500
# A contig is short below so many tags for each anchor that a chain needs; a short contig is placed by at least so many anchors of one order, one of which differs by at most so many bases.
SHORT_TAGS, LEAST_UNIQUE, NEAR = 8, 2, 1
# The chance with which a chain may be broken by bad luck, and the least number of skipped tags that break it.
BREAK_ALPHA, BREAK_FLOOR = 1e-6, 5


def chain_group(
    q: np.ndarray, r: np.ndarray, reverse: bool, gap_cost: float = GAP_COST, look_back: int = LOOK_BACK, least: int = LEAST_ANCHORS, most_gap: int = MOST_GAP, index: np.ndarray | None = None, most_skips: float | None = None, most_shift: int | None = None
) -> np.ndarray:
    """Chain number (0 the best, -1 none) of anchors sorted by (q, r); each step looks back at a bounded number of anchors.

    The score of a chain is its anchors less gap_cost for each base by which its gaps differ; chains are taken greedily,
    the highest score and then the first anchor first. A chain breaks at gaps of over most_gap bases or, if most_skips is
    given, where more than so many tags of the query (by index) are passed over; and where the gaps on both sides differ by most_shift or more."""
    n = len(q)
    x, y = q.tolist(), (-r if reverse else r).tolist()
    at_tag = None if most_skips is None else index.tolist()
    score, back = [1.0] * n, [-1] * n
    for i in range(1, n):
        xi, yi, most, best = x[i], y[i], 0.0, -1
        for j in range(max(0, i - look_back), i):
            dq, dy = xi - x[j], yi - y[j]
            if dq <= 0 or dy <= 0 or ((dq > most_gap or dy > most_gap) if at_tag is None else at_tag[i] - at_tag[j] - 1 > most_skips):
                continue
            shift = abs(dq - dy)
            if most_shift is not None and shift >= most_shift:
                continue
            gain = score[j] - gap_cost * min(shift, 1000)
            if gain > most:
                most, best = gain, j
        if best >= 0:
            score[i], back[i] = 1 + most, best
    out, number = [-1] * n, 0
    for end in sorted(range(n), key=lambda i: -score[i]):
        path, i = [], end
        while i >= 0 and out[i] < 0:
            path.append(i)
            i = back[i]
        if len(path) >= least:
            for i in path:
                out[i] = number
            number += 1
    return np.array(out, np.int64)


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[list]]]:
    """The first `width` columns' values and the other columns of each run of rows that are equal in them; runs go on over batches."""
    key, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        rows = list(zip(*columns[:width], strict=True))
        at = 0
        while at < len(rows):
            end = at + 1
            while end < len(rows) and rows[end] == rows[at]:
                end += 1
            part = [c[at:end] for c in columns[width:]]
            if key == rows[at]:
                held = [x + y for x, y in zip(held, part, strict=True)]
            else:
                if key is not None:
                    yield key, held
                key, held = rows[at], part
            at = end
    if key is not None:
        yield key, held


def chains(anchors: DataFrame, pair: Sequence[str], least: int = LEAST_ANCHORS, window: int = WINDOW, most_shift: int | None = None) -> DataFrame:
    """anchors: pair, q_contig, r_contig, reverse, q_pos, r_pos; and if chains are to break by skipped tags q_index and most_skips (null: by bases);
    and if hits are wanted enzyme and distance. One row for each chain: its spans, number of anchors, and as hits the query tags within its span
    with their least distance among matches at most `window` bases from where the chain's own anchors place them.

    Repeats are filtered before, so one group is a pair of contigs in one direction and fits a task."""
    keys = [*pair, "q_contig", "r_contig", "reverse"]
    kinds = ", ".join(f"`{c}` {anchors.schema[c].dataType.simpleString()}" for c in keys)
    given = [c for c in ("q_index", "most_skips", "enzyme", "distance") if c in anchors.columns]
    hit = "array<struct<enzyme:string,q_pos:long,distance:int>>"
    own = f"{kinds}, chain int, n_anchors long, q_start long, q_end long, r_start long, r_end long, hits {hit}"
    rows = anchors.select(*keys, "q_pos", "r_pos", *given)

    def of_group(key: tuple, columns: dict[str, list]) -> list[tuple]:
        q, r = np.array(columns["q_pos"], np.int64), np.array(columns["r_pos"], np.int64)
        skips = columns["most_skips"][0] if "most_skips" in given else None
        number = chain_group(q, r, bool(key[-1]), least=least, index=np.array(columns["q_index"]) if "q_index" in given else None, most_skips=None if skips is None or skips != skips else float(skips), most_shift=most_shift)
        found = []
        for c in range(number.max(initial=-1) + 1):
            at = np.flatnonzero(number == c)
            hits: dict[tuple[str, int], int] = {}
            if "distance" in given:
                inside = np.flatnonzero((q >= q[at[0]]) & (q <= q[at[-1]]))
                inside = inside[np.abs(r[inside] - np.interp(q[inside], q[at], r[at])) <= window]
                for i in inside.tolist():
                    e, p, d = columns["enzyme"][i], columns["q_pos"][i], columns["distance"][i]
                    hits[e, p] = min(d, hits.get((e, p), d))
            listed = [{"enzyme": e, "q_pos": p, "distance": d} for (e, p), d in hits.items()]
            found.append((*key, c, len(at), int(q[at].min()), int(q[at].max()), int(r[at].min()), int(r[at].max()), listed))
        return found

    names = [*keys, "chain", "n_anchors", "q_start", "q_end", "r_start", "r_end", "hits"]
    found_types = [pa.int32(), *[pa.int64()] * 5, pa.list_(pa.struct([("enzyme", pa.string()), ("q_pos", pa.int64()), ("distance", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        types = [*first.schema.types[: len(keys)], *found_types]
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        out: list[tuple] = []
        for key, columns in _groups(chain((first,), batches), len(keys)):
            out += of_group(key, dict(zip(("q_pos", "r_pos", *given), columns, strict=True)))
            if len(out) >= 10_000:
                yield made(out)
                out = []
        if out:
            yield made(out)

    last = ["enzyme"] if "enzyme" in given else []
    return rows.repartition(*keys).sortWithinPartitions(*keys, "q_pos", "r_pos", *last).mapInArrow(run, own)


def enough(anchors: DataFrame, pair: Sequence[str], least: int) -> DataFrame:
    """Anchors of pairs that have at least so many."""
    n = F.count("*").over(Window.partitionBy(*pair))
    return anchors.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def short_contigs(query_tags: DataFrame, chain_rows: DataFrame, pair: Sequence[str], least: int = LEAST_ANCHORS) -> DataFrame:
    """pair and q_contig of contigs without a chain that have fewer than SHORT_TAGS * least tags. query_tags: pair, enzyme, q_contig, q_pos."""
    counted = query_tags.groupBy(*pair, "q_contig").agg(F.count("*").alias("n")).where(F.col("n") < SHORT_TAGS * least)
    return counted.select(*pair, "q_contig").join(chain_rows.select(*pair, "q_contig").distinct(), [*pair, "q_contig"], "left_anti")


def votes(anchors: DataFrame, pair: Sequence[str]) -> DataFrame:
    """pair, q_contig, r_contig, reverse, n_unique, mismatches, nearest: the unique anchors by which a contig may lie there, if they are enough. anchors: these and distance, unique."""
    of_place = anchors.where("unique").groupBy(*pair, "q_contig", "r_contig", "reverse")
    found = of_place.agg(F.count("*").alias("n_unique"), F.sum("distance").alias("mismatches"), F.min("distance").alias("nearest"))
    return found.where((F.col("n_unique") >= LEAST_UNIQUE) & (F.col("nearest") <= NEAR))


def place_contig(q: np.ndarray, r: np.ndarray, reverse: np.ndarray, r_contig: np.ndarray, distance: np.ndarray, unique: np.ndarray) -> np.ndarray | None:
    """Which anchors place a short contig: of all groups of unique anchors in one order the largest, then the one with the fewest mismatches, then by
    reference contig, direction and place. At least LEAST_UNIQUE, one of them with at most NEAR mismatches; else None."""
    best, chosen = None, None
    for contig, turned in sorted(set(zip(r_contig[unique].tolist(), reverse[unique].tolist(), strict=True))):
        own = np.flatnonzero(unique & (r_contig == contig) & (reverse == turned))
        own = own[np.lexsort((r[own], q[own]))]
        number = chain_group(q[own], r[own], bool(turned), least=LEAST_UNIQUE)
        for c in range(number.max(initial=-1) + 1):
            at = own[number == c]
            if distance[at].min() <= NEAR:
                key = (-len(at), int(distance[at].sum()), contig, turned, int(q[at[0]]))
                if best is None or key < best:
                    best, chosen = key, at
    return chosen


def rescue(anchors: DataFrame, query_tags: DataFrame, chain_rows: DataFrame, pair: Sequence[str], reach: DataFrame, least: int = LEAST_ANCHORS, window: int = WINDOW) -> DataFrame:
    """Short contigs without a chain, placed by their unique anchors: rows as `chains` gives them, with q_start and q_end moved out over counted tails.

    anchors: pair, q_contig, r_contig, reverse, q_pos, r_pos, enzyme, distance, unique (the tag occurs once in each genome). reach: pair and reach, the
    bases of the reference within which an anchor beyond a contig's outermost one has to follow, from whatever contig: then a chain of the
    unbroken genome would have gone on, and the tail's tags that lie before that anchor are counted. Rows count in strata and aligned
    bases only; they are no chains. A group is a contig of fewer than SHORT_TAGS * least tags."""
    wanted = votes(anchors, pair).select(*pair, "q_contig").distinct().join(short_contigs(query_tags, chain_rows, pair, least), [*pair, "q_contig"], "left_semi")
    kinds = ", ".join(f"`{c}` {anchors.schema[c].dataType.simpleString()}" for c in (*pair, "q_contig", "r_contig"))
    columns = [*pair, "q_contig", "r_contig", "reverse", "chain", "n_anchors", "q_start", "q_end", "r_start", "r_end", "hits"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["q_pos", "r_pos", "r_contig", "reverse", "enzyme"])
        q, r, distance = (pdf[c].to_numpy(np.int64) for c in ("q_pos", "r_pos", "distance"))
        reverse, r_contig, unique, enzyme = pdf["reverse"].to_numpy(bool), pdf["r_contig"].to_numpy(), pdf["unique"].to_numpy(bool), pdf["enzyme"].to_numpy()
        at = place_contig(q, r, reverse, r_contig, distance, unique)
        if at is None:
            return pd.DataFrame([], columns=columns)
        turned, sign = bool(reverse[at[0]]), -1 if reverse[at[0]] else 1
        expected = np.interp(q, q[at], r[at].astype(float))
        expected = np.where(q < q[at[0]], r[at[0]] + sign * (q - q[at[0]]), np.where(q > q[at[-1]], r[at[-1]] + sign * (q - q[at[-1]]), expected))
        inside = np.flatnonzero((r_contig == r_contig[at[0]]) & (reverse == turned) & (np.abs(r - expected) <= window))
        hits: dict[tuple[str, int], int] = {}
        for i in inside.tolist():
            hits[enzyme[i], int(q[i])] = min(int(distance[i]), hits.get((enzyme[i], int(q[i])), 99))
        listed = [{"enzyme": e, "q_pos": p, "distance": d} for (e, p), d in hits.items()]
        return pd.DataFrame([(*pdf[[*pair, "q_contig"]].iloc[0], r_contig[at[0]], turned, -1, len(at), q[at].min(), q[at].max(), r[at].min(), r[at].max(), listed)], columns=columns)

    schema = f"{kinds}, reverse boolean, chain int, n_anchors long, q_start long, q_end long, r_start long, r_end long, hits array<struct<enzyme:string,q_pos:long,distance:int>>"
    own = anchors.join(wanted, [*pair, "q_contig"], "left_semi").select(*pair, "q_contig", "r_contig", "reverse", "q_pos", "r_pos", "enzyme", "distance", "unique")
    placed = own.groupBy(*pair, "q_contig").applyInPandas(run, schema)
    return with_tails(placed, chain_rows, pair, reach)


def with_tails(placed: DataFrame, chain_rows: DataFrame, pair: Sequence[str], reach: DataFrame) -> DataFrame:
    """placed with q_start and q_end moved out as far as the tails go: to the next end of a chain or placed contig on the reference, if that is at most reach away."""
    ends = lambda df: df.select(*pair, "r_contig", F.explode(F.array("r_start", "r_end")).alias("_at"))
    marks = ends(chain_rows).union(ends(placed)).distinct().select(*pair, "r_contig", "_at", F.lit(1).alias("_mark"), F.lit(None).cast("string").alias("_who"))
    who = F.to_json(F.struct("q_contig"))
    asked = placed.select(*pair, "r_contig", F.explode(F.array("r_start", "r_end")).alias("_at"), F.lit(0).alias("_mark"), who.alias("_who"))
    over = Window.partitionBy(*pair, "r_contig").orderBy("_at")
    mark = F.when(F.col("_mark") == 1, F.col("_at"))
    near = marks.union(asked).withColumn("_before", F.max(mark).over(over.rangeBetween(Window.unboundedPreceding, -1))).withColumn("_after", F.min(mark).over(over.rangeBetween(1, Window.unboundedFollowing)))
    found = near.where("_mark = 0").groupBy(*pair, "r_contig", "_who", "_at").agg(F.first("_before").alias("_before"), F.first("_after").alias("_after"))
    rows = placed.withColumn("_who", who)
    low = found.select(*pair, "r_contig", "_who", F.col("_at").alias("r_start"), "_before")
    high = found.select(*pair, "r_contig", "_who", F.col("_at").alias("r_end"), "_after")
    rows = rows.join(low, [*pair, "r_contig", "_who", "r_start"]).join(high, [*pair, "r_contig", "_who", "r_end"]).join(reach, list(pair), "left")
    far = lambda gap: F.when(gap <= F.col("reach"), F.greatest(gap - 1, F.lit(0))).otherwise(F.lit(0))
    below, above = far(F.col("r_start") - F.col("_before")), far(F.col("_after") - F.col("r_end"))
    left, right = F.when(F.col("reverse"), above).otherwise(below), F.when(F.col("reverse"), below).otherwise(above)
    return rows.withColumn("q_start", F.greatest(F.col("q_start") - left, F.lit(0)).cast("long")).withColumn("q_end", (F.col("q_end") + right).cast("long")).select(*placed.columns)


def chain_strata(query_tags: DataFrame, chain_rows: DataFrame, pair: Sequence[str], width: int = 50_000) -> DataFrame:
    """query_tags: pair, enzyme, q_contig, q_pos. Strata of the tags within chains: each tag counts once, for the chain of most anchors that it lies in."""
    own = ["r_contig", "reverse", "chain"]
    spans = chain_rows.select(*pair, "q_contig", *own, "n_anchors", "q_start", "q_end")
    inside = points_in_spans(query_tags.select(*pair, "enzyme", "q_contig", "q_pos"), spans, [*pair, "q_contig"], "q_pos", "q_start", "q_end", 0, width)
    largest = F.min(F.struct((-F.col("n_anchors")).alias("size"), *own)).alias("best")
    owned = inside.groupBy(*pair, "enzyme", "q_contig", "q_pos").agg(largest).select(*pair, "enzyme", "q_contig", "q_pos", *[F.col(f"best.{c}").alias(c) for c in own])
    hits = chain_rows.select(*pair, "q_contig", *own, F.explode("hits").alias("h")).select(*pair, "q_contig", *own, "h.*")
    return strata(owned, hits, pair, ["q_contig", "q_pos", *own])


def aligned(chain_rows: DataFrame, tags: DataFrame, pair: Sequence[str], side: str) -> DataFrame:
    """pair and covered: the bases of a side (q or r) within chains, whose ends are moved out by half the median gap between tags of the contig.

    tags: pair, contig and pos of that side's usable tags; spans are merged within a contig."""
    contig = f"{side}_contig"
    over = Window.partitionBy(*pair, contig).orderBy("pos")
    gaps = tags.select(*pair, contig, (F.lead("pos").over(over) - F.col("pos")).alias("gap"))
    half = quantiles(gaps, [*pair, contig], "gap", [0.5]).select(*pair, contig, (F.col("quantiles")[0] / 2).cast("long").alias("half"))
    spans = chain_rows.join(half, [*pair, contig], "left").select(*pair, contig, F.greatest(F.lit(0), F.col(f"{side}_start") - F.coalesce("half", F.lit(0))).alias("s"), (F.col(f"{side}_end") + F.coalesce("half", F.lit(0))).alias("e"))
    return union_length(spans, [*pair, contig], "s", "e").groupBy(*pair).agg(F.sum("covered").alias("covered"))


def synteny(chain_rows: DataFrame, pair: Sequence[str], places: int = 6) -> DataFrame:
    """Breakpoints = chains - chained contigs; score = (anchors - chains) / (anchors - 1)."""
    out = chain_rows.groupBy(*pair).agg(F.count("*").alias("n_chains"), F.countDistinct("q_contig").alias("n_contigs"), F.sum("n_anchors").alias("k"), F.max("n_anchors").alias("max_block_anchors"))
    return out.select(
        *pair, "n_chains", "max_block_anchors", F.round(F.col("k") / F.col("n_chains"), places).alias("mean_block_anchors"), (F.col("n_chains") - F.col("n_contigs")).alias("breakpoint_count"),
        F.round(F.try_divide((F.col("k") - F.col("n_chains")).cast("double"), (F.col("k") - 1).cast("double")), places).alias("synteny_score"),
    )


def structural_calls(chain_rows: DataFrame, pair: Sequence[str], least: int = 1000) -> DataFrame:
    """Calls between chains that follow each other on the query: a chain against the pair's main direction is an inversion, another contig or a
    step back a translocation, and gaps that differ by `least` or more an insertion or deletion, unless a third chain lies in the reference's gap."""
    plain = chain_rows.drop("hits")
    main = plain.groupBy(*pair, "reverse").agg(F.sum("n_anchors").alias("k")).groupBy(*pair).agg(F.max(F.struct(F.col("k"), (~F.col("reverse")).alias("forward"))).alias("m")).select(*pair, (~F.col("m.forward")).alias("main"))
    over = Window.partitionBy(*pair, "q_contig").orderBy("q_start", "q_end", "chain", "r_contig", "reverse", "r_start", "r_end")
    before = {c: F.lag(c).over(over) for c in ("r_contig", "reverse", "q_end", "r_start", "r_end", "n_anchors")}
    rows = plain.join(main, list(pair)).select("*", *[c.alias(f"p_{k}") for k, c in before.items()])
    dq = F.col("q_start") - F.col("p_q_end")
    dr = F.when(F.col("reverse"), F.col("p_r_start") - F.col("r_end")).otherwise(F.col("r_start") - F.col("p_r_end"))
    same = (F.col("r_contig") == F.col("p_r_contig")) & (F.col("reverse") == F.col("p_reverse"))
    kind = (
        F.when(F.col("reverse") != F.col("main"), "Inversion").when(F.col("p_r_contig").isNull(), None).when(F.col("r_contig") != F.col("p_r_contig"), "Translocation").when(same & (dr < -F.lit(least)), "Translocation")
        .when(same & (dq - dr >= least), "Insertion").when(same & (dr - dq >= least), "Deletion")
    )
    indel = kind.isin("Insertion", "Deletion")
    size = F.when(indel, F.abs(dq - dr)).otherwise(F.col("q_end") - F.col("q_start"))
    low, high = F.least("p_r_end", "r_end"), F.greatest("p_r_start", "r_start")
    calls = rows.select(
        *pair, kind.alias("sv_type"), "q_contig", F.coalesce("p_q_end", "q_start").alias("q_start"), F.when(indel, F.col("q_start")).otherwise(F.col("q_end")).alias("q_end"), "r_contig", size.alias("size"),
        F.col("p_n_anchors").alias("support_left"), F.col("n_anchors").alias("support_right"), F.when(indel, low).alias("_low"), F.when(indel, high).alias("_high"),
    ).where(F.col("sv_type").isNotNull())
    third = plain.select(*pair, "r_contig", F.col("r_start").alias("_s"), F.col("r_end").alias("_e"))
    guarded = calls.join(third, [calls[c] == third[c] for c in (*pair, "r_contig")] + [(third["_s"] > calls["_low"]) & (third["_e"] < calls["_high"])], "left_anti")
    return guarded.drop("_low", "_high")


def break_length(p: Column) -> Column:
    """Skipped tags beyond which a chain is taken to end, where a tag is found with probability p: chance alone skips as many with probability BREAK_ALPHA."""
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.greatest(F.lit(float(BREAK_FLOOR)), F.log(F.lit(BREAK_ALPHA)) / F.log1p(-q))
