"""The workflow as functions: sketch, screen, search, triangle, dist, struct, panel and a growing database."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.likelihood import fit_pairs
from ..operators import chains, metrics, ranking, tags
from ..storage import materialize, release

# Bases of a tag that screen it, the least identity of a hit, the share of found tags below which no identity is told, and breaks of order for each anchor.
WINDOW, LEAST_ANI, LEAST_RETENTION, MOST_BREAKS = 18, 0.8, 0.2, 0.5


def sketch(sequences: DataFrame, panel: Sequence[tags.Enzyme] = tags.PANEL) -> DataFrame:
    """sequences: genome_id, contig_id, seq. genome_id, contig_id, enzyme, pos, tag: the table that all else starts from."""
    return tags.digest(sequences, ["genome_id", "contig_id"], "seq", panel)


def db_add(sketches: DataFrame, path: str) -> None:
    """Appends sketches to a database; a genome that is there already is left as it is."""
    spark = sketches.sparkSession
    try:
        known = spark.read.parquet(path).select("genome_id").distinct()
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    new = sketches if known is None else sketches.join(known, "genome_id", "left_anti")
    new.write.mode("append").parquet(path)


def db_open(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _screen_keys(sketches: DataFrame) -> DataFrame:
    """A tag's key is the lesser strand of the WINDOW bases in the middle of its lesser strand."""
    middle = F.substring(F.col("_tag"), F.floor((F.length("_tag") - WINDOW) / 2).cast("int") + 1, F.lit(WINDOW))
    return sketches.withColumn("_tag", C.canonical(F.col("tag"))).select("genome_id", "enzyme", C.canonical(middle).alias("key"))


def screen_pairs(sketches: DataFrame, least_shared: int = 3, least_containment: float = 0.001) -> DataFrame:
    """a, b of genomes worth a comparison: enough distinct keys in common."""
    return tags.screen(_screen_keys(sketches), "genome_id", ["enzyme", "key"], least_shared, least_containment).select("a", "b")


def usable(sketches: DataFrame, pairs: DataFrame, most_copies: int = 5) -> tuple[DataFrame, DataFrame]:
    """The tags of a (q_contig, q_pos) and of b (r_contig, r_pos) of each pair, without those that either genome has more than most_copies times, on both strands together."""
    own = sketches.withColumn("_key", C.canonical(F.col("tag")))
    repeats = own.groupBy("genome_id", "enzyme", "_key").agg(F.count("*").alias("n")).where(F.col("n") > most_copies).select("genome_id", "enzyme", "_key")
    barred = pairs.join(repeats.withColumnRenamed("genome_id", "a"), "a").select("a", "b", "enzyme", "_key").union(pairs.join(repeats.withColumnRenamed("genome_id", "b"), "b").select("a", "b", "enzyme", "_key")).distinct()

    def side(genome: str, contig: str, pos: str) -> DataFrame:
        of_pair = pairs.join(own.withColumnsRenamed({"genome_id": genome, "contig_id": contig, "pos": pos}), genome)
        return of_pair.join(barred, ["a", "b", "enzyme", "_key"], "left_anti").select("a", "b", "enzyme", contig, pos, "tag")

    return side("a", "q_contig", "q_pos"), side("b", "r_contig", "r_pos")


def matches(query: DataFrame, reference: DataFrame, panel: Sequence[tags.Enzyme] = tags.PANEL, tolerance: int = 2) -> DataFrame:
    """Places of tags of a and b, on either strand, that differ in at most `tolerance` bases; reverse tells that b's tag stands on the other strand.

    query and reference: what `usable` gives."""
    strands = F.explode(F.array(F.struct(F.col("tag"), F.lit(False).alias("reverse")), F.struct(C.reverse_complement(F.col("tag")).alias("tag"), F.lit(True).alias("reverse")))).alias("s")
    both = reference.select("a", "b", "enzyme", "r_contig", "r_pos", strands).select("a", "b", "enzyme", "r_contig", "r_pos", "s.*")
    out = None
    for e in panel:
        x, y = (df.where(F.col("enzyme") == e.name) for df in (query, both))
        found = tags.tolerant_pairs(x, y, ["a", "b", "enzyme"], "tag", tolerance, e.length)
        found = found.select("a", "b", "enzyme", F.col("a_q_contig").alias("q_contig"), F.col("a_q_pos").alias("q_pos"), F.col("b_r_contig").alias("r_contig"), F.col("b_r_pos").alias("r_pos"), F.col("b_reverse").alias("reverse"), "distance")
        out = found if out is None else out.union(found)
    return out


def _fits(counted: DataFrame, panel: Sequence[tags.Enzyme]) -> DataFrame:
    length, body = F.lit(None).cast("int"), F.lit(None).cast("int")
    for e in panel:
        length, body = F.when(F.col("enzyme") == e.name, e.length).otherwise(length), F.when(F.col("enzyme") == e.name, e.body).otherwise(body)
    return fit_pairs(counted.withColumn("tag_len", length).withColumn("body_len", body), ["a", "b"])


def uniques(query: DataFrame, reference: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchors with unique: whether the tag occurs once, on both strands together, in each genome."""
    once = lambda df, contig, pos: df.withColumn("_key", C.canonical(F.col("tag"))).groupBy("a", "b", "enzyme", "_key").agg(F.count("*").alias("_n"), F.first(contig).alias(contig), F.first(pos).alias(pos)).where("_n = 1").select("a", "b", "enzyme", contig, pos)
    of_query = once(query, "q_contig", "q_pos").withColumn("_q", F.lit(True))
    of_reference = once(reference, "r_contig", "r_pos").withColumn("_r", F.lit(True))
    joined = anchors.join(of_query, ["a", "b", "enzyme", "q_contig", "q_pos"], "left").join(of_reference, ["a", "b", "enzyme", "r_contig", "r_pos"], "left")
    return joined.withColumn("unique", F.coalesce("_q", F.lit(False)) & F.coalesce("_r", F.lit(False))).drop("_q", "_r")


def chained(sketches: DataFrame, pairs: DataFrame, panel: Sequence[tags.Enzyme] = tags.PANEL, most_shift: int | None = None, short_contigs: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables of the pairs' chains, of the short contigs that are placed without one, and of their usable query and reference tags; chains in two passes.

    The first chains break at long gaps. The identity fitted to the tags within them tells how often a tag is found, and
    the second chains break where more tags are skipped than chance explains, and with most_shift where that many bases are gained or lost."""
    query, reference = (materialize(t) for t in usable(sketches, pairs))
    over = Window.partitionBy("a", "b", "q_contig").orderBy("q_pos", "enzyme")
    index = query.select("a", "b", "enzyme", "q_contig", "q_pos", F.row_number().over(over).alias("q_index"))
    anchors = materialize(matches(query, reference, panel).join(index, ["a", "b", "enzyme", "q_contig", "q_pos"]))
    first = chains.chains(anchors, ["a", "b"])
    found = _fits(chains.chain_strata(query, first, ["a", "b"]), panel).select("a", "b", chains.break_length(F.col("retention")).alias("most_skips"))
    limits = materialize(found)
    rows = materialize(chains.chains(anchors.join(limits, ["a", "b"], "left"), ["a", "b"], most_shift=most_shift))
    if short_contigs:
        spans = reference.groupBy("a", "b", "r_contig").agg((F.max("r_pos") - F.min("r_pos")).alias("bases"), (F.count("*") - 1).alias("gaps")).groupBy("a", "b").agg((F.sum("bases") / F.sum("gaps")).alias("spacing"))
        reach = spans.join(limits, ["a", "b"], "left").select("a", "b", ((F.coalesce("most_skips", F.lit(float(chains.BREAK_FLOOR))) + 1) * F.coalesce("spacing", F.lit(0.0))).alias("reach"))
        short = chains.short_contigs(query, rows, ["a", "b"])
        near = anchors.join(short, ["a", "b", "q_contig"], "left_semi").drop("q_index")
        placed = materialize(chains.rescue(uniques(query, reference, near), query, rows, ["a", "b"], reach))
    else:
        placed = rows.limit(0)
    release(anchors, limits)
    return rows, placed, query, reference


def dist(sketches: DataFrame, pairs: DataFrame, panel: Sequence[tags.Enzyme] = tags.PANEL, lengths: DataFrame | None = None, short_contigs: bool = True) -> DataFrame:
    """Fits, gate, flag and gated identity of each pair, from the tags of a within chains; with lengths (genome_id, length) also the aligned fraction of both genomes.

    With short_contigs the tags of contigs too short for a chain count where unique anchors place them. A pair without either has no identity and is BELOW_DETECTION."""
    rows, placed, query, reference = chained(sketches, pairs, panel, short_contigs=short_contigs)
    spans = rows.unionByName(placed)
    fits = pairs.select("a", "b").distinct().join(_fits(chains.chain_strata(query, spans, ["a", "b"]), panel), ["a", "b"], "left")
    order = chains.synteny(rows, ["a", "b"]).join(rows.groupBy("a", "b").agg(F.sum("n_anchors").alias("n_anchors")), ["a", "b"])
    fits = fits.join(order, ["a", "b"], "left")
    gate = C.gate(F.col("ani_from_loss") * 100, F.col("ani_from_hist") * 100, F.col("het_shape"), F.col("ani"))
    out = fits.withColumn("gate", gate)
    broken = (F.col("gate") == "uniform_fallback") | (F.col("breakpoint_count") > MOST_BREAKS * F.col("n_anchors"))
    out = out.withColumn("flag", F.when(F.coalesce(F.col("retention") < LEAST_RETENTION, F.lit(True)), "BELOW_DETECTION").when(F.coalesce(broken, F.lit(False)), "INCONSISTENT").otherwise("ok"))
    out = out.withColumn("ani_gated", C.gated(F.col("gate"), F.col("ani"), F.col("ani_uniform")))
    if lengths is None:
        return out
    for genome, side, tag_rows, name in (("a", "q", query, "af_query"), ("b", "r", reference, "af_reference")):
        places = tag_rows.select("a", "b", f"{side}_contig", F.col(f"{side}_pos").alias("pos"))
        share = chains.aligned(spans, places, ["a", "b"], side).join(pairs.join(lengths.withColumnRenamed("genome_id", genome), genome).select("a", "b", "length"), ["a", "b"])
        out = out.join(share.select("a", "b", F.least(F.lit(1.0), F.col("covered") / F.col("length")).alias(name)), ["a", "b"], "left")
    return out


def triangle(sketches: DataFrame, panel: Sequence[tags.Enzyme] = tags.PANEL) -> DataFrame:
    """All pairs that pass the screen; a pair that isn't there was screened out."""
    return dist(sketches, screen_pairs(sketches), panel)


def search(queries: DataFrame, database: DataFrame, panel: Sequence[tags.Enzyme] = tags.PANEL, least: float = LEAST_ANI) -> DataFrame:
    """Database genomes of at least that gated identity to each query, best first (rank 1); self-matches are left out.

    Queries are screened against the database only, and only genomes of screened pairs are compared."""
    wanted = materialize(tags.screen_sides(_screen_keys(queries), _screen_keys(database), "genome_id", ["enzyme", "key"]).select("a", "b"))
    named = wanted.select(F.explode(F.array("a", "b")).alias("genome_id")).distinct()
    known = queries.select("genome_id").distinct()
    both = queries.select(*database.columns).unionByName(database.join(known, "genome_id", "left_anti")).join(named, "genome_id", "left_semi")
    hits = dist(both, wanted, panel).where(F.col("ani_gated") >= least)
    return ranking.top_k(hits, ["a"], [F.desc("ani_gated"), F.asc("b")], 1 << 30)


def search_matrix(queries: DataFrame, database: DataFrame, panel: Sequence[tags.Enzyme] = tags.PANEL) -> DataFrame:
    """query, target, ani_gated for every query and every database genome but itself; null where the screen left the pair out or nothing was found."""
    hits = search(queries, database, panel, 0.0).select(F.col("a").alias("query"), F.col("b").alias("target"), "ani_gated")
    rows = queries.select(F.col("genome_id").alias("query")).distinct()
    columns = database.select(F.col("genome_id").alias("target")).distinct()
    cells = rows.crossJoin(columns).where("query <> target")  # the cells are the result
    return cells.join(hits, ["query", "target"], "left")


def struct(sketches: DataFrame, pairs: DataFrame, panel: Sequence[tags.Enzyme] = tags.PANEL, least: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Synteny statistics and structural calls of each pair, from its chains."""
    rows, _, _, _ = chained(sketches, pairs, panel, least, short_contigs=False)
    return chains.synteny(rows, ["a", "b"]), chains.structural_calls(rows, ["a", "b"], least)


def subset_errors(strata: DataFrame, truth: DataFrame, subsets: dict[str, Sequence[str]]) -> DataFrame:
    """subset and the error of the gated identity against the truth (query, reference, anim_ani in percent) of each subset of enzymes, all in one job.

    A stratum is sent once for each subset that has its enzyme, and all subsets are fitted side by side."""
    holding = {e: [name for name, own in subsets.items() if e in own] for own in subsets.values() for e in own}
    of = F.create_map(*[x for e, names in sorted(holding.items()) for x in (F.lit(e), F.array(*map(F.lit, names)))])
    long = strata.where(F.col("enzyme").isin(*holding)).withColumn("subset", F.explode(F.element_at(of, F.col("enzyme"))))
    fits = fit_pairs(long, ["subset", "query", "reference"])
    gate = C.gate(F.col("ani_from_loss") * 100, F.col("ani_from_hist") * 100, F.col("het_shape"), F.col("ani"))
    told = fits.withColumn("pred", C.gated(gate, F.col("ani"), F.col("ani_uniform")) * 100).join(truth, ["query", "reference"])
    return told.groupBy("subset").agg(*[c.alias(k) for k, c in metrics.error_columns("pred", "anim_ani").items()])


def panel_errors(strata: DataFrame, truth: DataFrame, enzymes: Sequence[str]) -> DataFrame:
    """Error of the gated identity against the truth (query, reference, anim_ani in percent) with a subset of the enzymes."""
    return subset_errors(strata, truth, {"all": enzymes}).drop("subset")


def greedy_panel(strata: DataFrame, truth: DataFrame, names: Sequence[str], size: int) -> list[str]:
    """Enzymes added one at a time, each the one with the least mean error (ties: the least name); one job for each, over all candidates."""
    chosen: list[str] = []
    while len(chosen) < min(size, len(names)):
        rest = [n for n in names if n not in chosen]
        errors = {r["subset"]: r["mae"] for r in subset_errors(strata, truth, {n: [*chosen, n] for n in rest}).select("subset", "mae").collect()}  # a row for each candidate
        chosen.append(min(rest, key=lambda n: (errors.get(n) is None, errors.get(n), n)))
    return chosen
