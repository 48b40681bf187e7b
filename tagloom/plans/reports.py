"""Queries on filters, derived columns, summaries, samples and merges of measured pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import assign, calibrate, chains, intervals, joins, metrics, ranking
from .catalog import _GATE, _SPANS, MEASURED, measured, query, read, spans

_E = "abs(t2 - truth)"


@query("""SELECT p_partkey, p_brand FROM part WHERE p_brand IS NOT NULL AND p_retailprice / 15 > 60 AND p_size < 25""")
def quality_filter(spark, d):
    p = read(spark, d, "part")
    return C.quality_filter(p, F.col("p_retailprice") / 15, F.col("p_size"), ["p_brand"], 60, 25).select("p_partkey", "p_brand")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 40 AND least(l_discount * 100, l_tax * 100) >= 3""")
def range_window(spark, d):
    keep = C.window(F.col("l_quantity"), 10, 40) & (F.least(F.col("l_discount") * 100, F.col("l_tax") * 100) >= 3)
    return read(spark, d, "lineitem").where(keep).select("l_orderkey", "l_linenumber")


@query("""SELECT band, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN l_quantity BETWEEN 1 AND 20 THEN '1-20' END, CASE WHEN l_quantity BETWEEN 20 AND 40 THEN '20-40' END], lambda x: x IS NOT NULL)) AS band FROM lineitem) GROUP BY 1""")
def inclusive_bands(spark, d):
    bands = C.bands_inclusive(F.col("l_quantity"), [1, 20, 40])
    return read(spark, d, "lineitem").select(F.explode(bands).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


@query("""SELECT CAST(floor(o_totalprice / 250.25) AS BIGINT) AS fine, CAST(trunc((o_totalprice - 5000) / 10000.5) AS BIGINT) AS coarse, count(*) AS n FROM orders GROUP BY 1, 2""")
def fine_bins(spark, d):
    p = F.col("o_totalprice")
    return read(spark, d, "orders").groupBy(C.floor_bin(p, 250.25).alias("fine"), C.truncated_bin(p, 5000, 10000.5).alias("coarse")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT median(CASE WHEN l_linenumber <> 3 THEN l_tax END) AS med FROM lineitem) SELECT l_orderkey, l_linenumber, round(coalesce(CASE WHEN l_linenumber <> 3 THEN l_tax END, med), 6) AS by_median,
  round(coalesce(CASE WHEN l_linenumber <> 3 THEN l_tax END, l_discount), 6) AS by_column FROM lineitem, m""")
def fill_missing(spark, d):
    holed = read(spark, d, "lineitem").withColumn("x", F.when(F.col("l_linenumber") != 3, F.col("l_tax")))
    median = ranking.quantiles(holed, [], "x", [0.5]).select(F.col("quantiles")[0].alias("med"))
    return holed.join(F.broadcast(median)).select("l_orderkey", "l_linenumber", F.round(F.coalesce("x", "med"), 6).alias("by_median"), F.round(F.coalesce("x", "l_discount"), 6).alias("by_column"))  # one row of medians


@query(f"""WITH {MEASURED} SELECT l_orderkey, l_linenumber, round(abs(t3 - t2), 10) AS gap, round(truth / greatest(l_quantity, 5), 10) AS per_unit, round(least(t1, t2, t3), 10) AS least FROM measured""")
def derived_diagnostics(spark, d):
    m = measured(spark, d)
    return m.select("l_orderkey", "l_linenumber", F.round(F.abs(F.col("t3") - F.col("t2")), 10).alias("gap"), F.round(C.ratio(F.col("truth"), F.col("l_quantity"), 5), 10).alias("per_unit"), F.round(F.least("t1", "t2", "t3"), 10).alias("least"))


@query("""WITH u AS (SELECT max(l_discount) AS d, max(l_quantity) AS q FROM lineitem) SELECT l_orderkey, l_linenumber, round(CASE WHEN d <= 1.5 THEN l_discount * 100 ELSE l_discount END, 6) AS discount, round(CASE WHEN q <= 1.5 THEN l_quantity * 100 ELSE l_quantity END, 6) AS quantity FROM lineitem, u""")
def percent_units(spark, d):
    return C.as_percent(read(spark, d, "lineitem"), {"l_discount": "discount", "l_quantity": "quantity"}).select("l_orderkey", "l_linenumber", F.round("discount", 6).alias("discount"), F.round("quantity", 6).alias("quantity"))


@query("""SELECT CASE WHEN l_tax >= 0.06 THEN 'strict' WHEN l_tax >= 0.03 THEN 'low' ELSE 'verylow' END AS tier, count(*) AS n FROM lineitem GROUP BY 1""")
def aligned_fraction_tier(spark, d):
    return read(spark, d, "lineitem").groupBy(C.fraction_tier(F.col("l_tax"), 0.06, 0.03).alias("tier")).agg(F.count("*").alias("n"))


_FAMILIES = {
    "retention": ("l_discount < cut / 100", lambda cut: F.col("l_discount") < cut / 100),
    "shape": ("l_quantity < 5 * cut", lambda cut: F.col("l_quantity") < 5 * cut),
    "anchors": ("l_linenumber < cut", lambda cut: F.col("l_linenumber") < cut),
    "error": ("l_tax * 100 > cut", lambda cut: F.col("l_tax") * 100 > cut),
}


@query(f"""WITH {MEASURED.replace("p_brand,", "p_brand, ")}, rules AS (SELECT unnest([2.0, 4.0, 6.0]) AS cut), long AS ({" UNION ALL ".join(f"SELECT '{k}' AS family, cut, CASE WHEN {sql} THEN t1 ELSE t2 END - truth AS e, {sql} AS switched FROM measured, rules" for k, (sql, _) in _FAMILIES.items())})
  SELECT family, cut, count(*) AS n, CAST(sum(CASE WHEN switched THEN 1 ELSE 0 END) AS BIGINT) AS n_switched, round(avg(abs(e)), 6) AS mae FROM long GROUP BY 1, 2""")
def gate_families(spark, d):
    return metrics.rule_sweep(measured(spark, d), {k: rule for k, (_, rule) in _FAMILIES.items()}, [2.0, 4.0, 6.0], "t1", "t2", "truth")


@query(f"""WITH {MEASURED}, x AS (SELECT *, 2 * l_quantity * l_discount AS lrt, l_quantity * 100 AS n_tags FROM measured) SELECT rule, count(*) AS n, CAST(sum(CAST(g AS INTEGER)) AS BIGINT) AS n_gamma, round(avg(abs(CASE WHEN g THEN t2 ELSE t1 END - truth)), 6) AS mae FROM (
  SELECT t1, t2, truth, unnest(['lrt', 'bic']) AS rule, unnest([lrt > 3.841, lrt > ln(n_tags)]) AS g FROM x) GROUP BY 1""")
def lrt_bic_gate(spark, d):
    x = measured(spark, d).withColumn("lrt", 2 * F.col("l_quantity") * F.col("l_discount")).withColumn("n_tags", F.col("l_quantity") * 100)
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), v.alias("g")) for k, v in (("lrt", C.lrt_gate(F.col("lrt"))), ("bic", C.bic_gate(F.col("lrt"), F.col("n_tags"))))])
    long = x.select("t1", "t2", "truth", F.explode(rules).alias("r")).select("t1", "t2", "truth", "r.*")
    return long.groupBy("rule").agg(F.count("*").alias("n"), F.sum(F.col("g").cast("int")).alias("n_gamma"), F.round(F.avg(F.abs(F.when(F.col("g"), F.col("t2")).otherwise(F.col("t1")) - F.col("truth"))), 6).alias("mae"))


@query("""SELECT s_suppkey, n_name AS nation, coalesce(n_lines, 0) AS n_lines, coalesce(acct, 'unknown') AS acct FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey
  LEFT JOIN (SELECT l_suppkey, count(*) AS n_lines FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_suppkey = s_suppkey LEFT JOIN (SELECT c_custkey, c_mktsegment AS acct FROM customer WHERE c_acctbal > 0) ON c_custkey = s_suppkey""")
def star_join(spark, d):
    lines = read(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n_lines"))
    accounts = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_mktsegment").alias("acct"))
    names = read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    return joins.star(read(spark, d, "supplier"), [(names, "s_nationkey"), (lines, "s_suppkey"), (accounts, "s_suppkey")], {"n_lines": 0, "acct": "unknown"}).select("s_suppkey", "nation", "n_lines", "acct")


@query("""SELECT o_orderkey, c_mktsegment, CAST(toxic AS DOUBLE) AS toxic FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN labels ON doc_id = o_orderkey""")
def inner_then_left(spark, d):
    truth = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    extra = read(spark, d, "labels").select(F.col("doc_id").alias("o_orderkey"), "toxic")
    return read(spark, d, "orders").join(truth, "o_custkey").join(extra, "o_orderkey", "left").select("o_orderkey", "c_mktsegment", F.col("toxic").cast("double").alias("toxic"))


@query("""WITH a AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view'), b AS (SELECT event_id AS other, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click')
  SELECT event_id, other, user_id FROM a JOIN b USING (user_id, n)""")
def one_to_one_match(spark, d):
    e = read(spark, d, "events")
    views, clicks = e.where("event_type = 'view'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'").select(F.col("event_id").alias("other"), "user_id", F.col("ts").alias("ts2"))
    return joins.one_to_one(views, clicks, ["user_id"], ["ts", "event_id"], ["ts2", "other"]).select("event_id", "other", "user_id")


@query("""SELECT l_returnflag, count(*) AS n, round(sum(CASE WHEN l_discount <= l_tax THEN 1 ELSE 0 END) / count(*), 6) AS covered, round(median(l_tax - l_discount), 6) AS median_gap FROM lineitem GROUP BY 1""")
def bound_coverage(spark, d):
    return metrics.coverage(read(spark, d, "lineitem"), "l_returnflag", "l_tax", "l_discount")


@query("""SELECT o_custkey, count(*) AS n, round(median(o_totalprice), 6) AS median, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1""")
def summary_over_repeats(spark, d):
    return metrics.spread(read(spark, d, "orders"), ["o_custkey"], "o_totalprice")


@query("""SELECT l_returnflag AS tool, CAST(l_linenumber AS VARCHAR) AS seed, round(avg(l_discount), 6) AS mae FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT tool, 'mean', round(avg(mae), 6) FROM (SELECT l_returnflag AS tool, l_linenumber, avg(l_discount) AS mae FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def mean_over_seeds(spark, d):
    base = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("tool"), F.col("l_linenumber").alias("seed")).agg(F.avg("l_discount").alias("mae"))
    return metrics.with_mean(base, ["tool"], "seed", "mae")


@query("""SELECT 'nations' AS what, count(DISTINCT x) AS n FROM (SELECT s_nationkey AS x FROM supplier UNION ALL SELECT c_nationkey FROM customer) UNION ALL SELECT 'customers', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'parts', count(DISTINCT l_partkey) FROM lineitem""")
def distinct_sets(spark, d):
    both = read(spark, d, "supplier").select(F.col("s_nationkey").alias("x")).union(read(spark, d, "customer").select("c_nationkey"))
    out = None
    for name, values in (("nations", both), ("customers", read(spark, d, "orders").select("o_custkey")), ("parts", read(spark, d, "lineitem").select("l_partkey"))):
        row = values.distinct().agg(F.lit(name).alias("what"), F.count("*").alias("n"))
        out = row if out is None else out.union(row)
    return out


@query("""SELECT CAST(floor(l_quantity) AS BIGINT) // 5 AS bin, count(*) AS n FROM lineitem GROUP BY 1""")
def histogram(spark, d):
    return read(spark, d, "lineitem").groupBy(F.floor(F.floor("l_quantity") / 5).alias("bin")).agg(F.count("*").alias("n"))


@query("""SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, round(median(l_quantity), 6) AS median, max(l_quantity) AS most, min(l_quantity) AS least FROM lineitem GROUP BY 1, 2""")
def describe(spark, d):
    return metrics.spread(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


@query("""SELECT o_orderpriority, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 END), 0) AS BIGINT) AS f, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN 1 END), 0) AS BIGINT) AS o, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN 1 END), 0) AS BIGINT) AS p FROM orders GROUP BY 1""")
def pivot_summary(spark, d):
    wide = read(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return wide.select("o_orderpriority", *[F.col(c).alias(c.lower()) for c in "FOP"])


@query("""SELECT s_name, split_part(s_name, '#', 1) AS kind, CAST(regexp_extract(s_name, '#0*([0-9]+)$', 1) AS BIGINT) AS number FROM supplier""")
def name_parts(spark, d):
    return read(spark, d, "supplier").select("s_name", F.split("s_name", "#")[0].alias("kind"), F.regexp_extract("s_name", r"#0*([0-9]+)$", 1).cast("long").alias("number"))


@query("""SELECT p_partkey, split_part(l, ';', 1) AS domain, split_part(l, ';', 2) AS phylum, nullif(split_part(l, ';', 3), '') AS class FROM (SELECT p_partkey, p_type || ';' || p_brand || ';' || CASE WHEN p_size > 25 THEN p_name ELSE '' END AS l FROM part)""")
def taxonomy_split(spark, d):
    lineage = F.concat_ws(";", "p_type", "p_brand", F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(""))
    return read(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in C.taxonomy(lineage, ["domain", "phylum", "class"]).items()])


@query("""SELECT l_orderkey, l_linenumber, round(1.0 / (1.0 + exp(-(l_quantity - 25) / 5.0)), 10) AS logistic, round(CASE l_linenumber % 4 WHEN 0 THEN 1.0 WHEN 1 THEN sqrt(l_quantity) WHEN 2 THEN 1 + sin(l_discount * 10) ELSE 1 - 0.5 * least(abs(l_quantity - 25), 10) / 10 END, 10) AS weight,
  round(1 - l_linenumber / l_quantity, 10) AS sdi, round(l_tax * (1 - 0.3 * (1 - l_linenumber / l_quantity)), 10) AS composite FROM lineitem""")
def weights_and_composites(spark, d):
    strategy = F.element_at(F.array(*map(F.lit, C.WEIGHTS)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    weight = C.weight(strategy, F.col("l_quantity"), F.col("l_discount") * 10, F.col("l_quantity") - 25)
    sdi = C.sdi(F.col("l_linenumber"), F.col("l_quantity"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.logistic(F.col("l_quantity"), 25, 5), 10).alias("logistic"), F.round(weight, 10).alias("weight"), F.round(sdi, 10).alias("sdi"), F.round(C.composite(F.col("l_tax"), sdi), 10).alias("composite"))


@query()
def two_axis_clusters(spark, d):
    """Lines of a part as blocks: the order is one axis, the price the other."""
    rows = read(spark, d, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("r_start"), (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("r_end"), F.floor("l_extendedprice").alias("q_start"), F.floor(F.col("l_extendedprice") + F.col("l_quantity")).alias("q_end"))
    return intervals.two_axis_clusters(rows, ["l_suppkey"], 50)


@query()
def first_fit_batches(spark, d):
    """Customers of a nation, as large as their orders, in batches of at most 50 orders."""
    sizes = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("size")).join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return assign.first_fit_decreasing(sizes, ["c_nationkey"], "c_custkey", "size", 50)


@query("""WITH n AS (SELECT l_suppkey, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1) SELECT s_suppkey, coalesce(CAST(first AS VARCHAR), s_name) AS name FROM supplier LEFT JOIN n ON l_suppkey = s_suppkey""")
def key_remap(spark, d):
    """A supplier goes by its first line, as a genome by the first record of its file."""
    first = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("first"))
    return read(spark, d, "supplier").join(first, "s_suppkey", "left").select("s_suppkey", F.coalesce("first", "s_name").alias("name"))


@query("""WITH a AS (SELECT l_suppkey, count(*) AS n_lines FROM lineitem WHERE l_tax > 0.05 GROUP BY 1), b AS (SELECT l_suppkey, max(l_quantity) AS most FROM lineitem WHERE l_discount > 0.05 GROUP BY 1), c AS (SELECT l_suppkey, min(l_quantity) AS least FROM lineitem WHERE l_linenumber > 5 GROUP BY 1)
  SELECT l_suppkey, n_lines, most, least FROM a FULL JOIN b USING (l_suppkey) FULL JOIN c USING (l_suppkey)""")
def stitched_tables(spark, d):
    line = read(spark, d, "lineitem")
    parts = [line.where("l_tax > 0.05").groupBy("l_suppkey").agg(F.count("*").alias("n_lines")), line.where("l_discount > 0.05").groupBy("l_suppkey").agg(F.max("l_quantity").alias("most")), line.where("l_linenumber > 5").groupBy("l_suppkey").agg(F.min("l_quantity").alias("least"))]
    return joins.stitch(parts, ["l_suppkey"])


@query(f"""WITH {MEASURED}, s AS (SELECT CASE WHEN l_discount < 0.03 THEN 'low' WHEN l_discount < 0.07 THEN 'mid' ELSE 'high' END AS slice, t2 - truth AS e, {_GATE.replace("l_linenumber", "l_linenumber")} AS gate FROM measured)
  SELECT slice, gate, count(*) AS n, round(avg(e), 6) AS bias, round(sqrt(avg(e * e) - avg(e) * avg(e)), 5) AS deviation, round(sum(abs(e)) / (SELECT sum(abs(t2 - truth)) FROM measured), 6) AS share FROM s GROUP BY 1, 2""")
def error_decomposition(spark, d):
    m = measured(spark, d).withColumn("shape", F.when(F.col("l_linenumber") == 1, float("inf")).otherwise(1.0))
    discount = F.col("l_discount")
    m = m.withColumn("slice", F.when(discount < 0.03, "low").when(discount < 0.07, "mid").otherwise("high")).withColumn("gate", C.gate(F.col("t3") * 10, F.col("t2") * 10, F.col("shape"), F.col("t1")))
    return metrics.decomposed(m, ["slice", "gate"], "t2", "truth")


@query(f"""WITH {_SPANS}, c AS (SELECT user_id, unnest(range(s // 3600, (e - 1) // 3600 + 1)) AS block, s, e FROM spans WHERE s < e), p AS (SELECT user_id, block, greatest(s, block * 3600) AS s, least(e, (block + 1) * 3600) AS e FROM c),
  r AS (SELECT *, max(e) OVER (PARTITION BY user_id, block ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p) SELECT user_id, block, round(sum(greatest(0, e - greatest(s, coalesce(reach, s)))) / 3600, 6) AS covered FROM r GROUP BY 1, 2""")
def block_coverage(spark, d):
    return intervals.block_coverage(spans(spark, d), ["user_id"], "s", "e", 3600).withColumn("covered", F.round("covered", 6))


@query("""SELECT bin, n, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT CAST(least(floor((l_quantity - 0) / (50 - 0) * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(l_quantity) AS x, avg(l_discount) AS y FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1) WHERE n >= 3""")
def binned_mean(spark, d):
    return intervals.binned_mean(read(spark, d, "lineitem"), "l_quantity", "l_discount", 0, 50, 10).select("bin", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def multi_seed_cv(spark, d):
    m = measured(spark, d).withColumn("y", F.col("t2") - F.col("truth"))
    scores = calibrate.multi_seed_cv(m, ["l_quantity", "l_discount", "l_tax"], "y", [1, 2, 3, 4, 5])
    return metrics.with_mean(scores, [], "seed", "mae")


@query()
def gbrt_train(spark, d):
    """Parts' prices from their number and size by boosted trees, as an expression on the whole table."""
    part = read(spark, d, "part")
    model = calibrate.boosted(part, ["p_partkey", "p_size"], "p_retailprice", [(2, 5, 0.3), (3, 5, 0.3)], 2)
    return part.select("p_partkey", F.round(calibrate.boosted_column(model), 6).alias("pred"))


@query(f"""WITH {MEASURED}, x AS (SELECT band, abs(t2 - truth) AS e, l_discount > 0.08 AS f FROM measured), g AS (SELECT band, avg(e) FILTER (NOT f) AS kept, count(*) FILTER (NOT f) AS n_kept, avg(e) FILTER (f) AS flagged, count(*) FILTER (f) AS n_flagged FROM x GROUP BY 1)
  SELECT band, round(kept, 6) AS kept_mae, n_kept, round(flagged, 6) AS flagged_mae, n_flagged, coalesce(flagged < kept, false) AS inverted FROM g""")
def inversion_check(spark, d):
    """Whether a flag takes out the better rows of a band."""
    out = metrics.kept_and_flagged(measured(spark, d), ["band"], F.col("t2") - F.col("truth"), F.col("l_discount") > 0.08)
    return out.withColumns({c: F.round(c, 6) for c in ("kept_mae", "flagged_mae")})


_BLOCKS = """blocks AS (SELECT l_suppkey, l_linestatus AS q_contig, l_returnflag AS r_contig, l_linenumber % 3 = 0 AS reverse, CAST(l_linenumber AS INTEGER) AS chain, CAST(l_quantity AS BIGINT) AS n_anchors, l_orderkey * 100 AS q_start,
  l_orderkey * 100 + CAST(l_quantity AS BIGINT) AS q_end, l_partkey * 50 AS r_start, l_partkey * 50 + CAST(floor(l_extendedprice / 100) AS BIGINT) AS r_end FROM lineitem)"""


def line_blocks(spark, d):
    """Lines of a supplier as chains: by order on the query, by part on the reference, every third line turned."""
    q = F.col("l_quantity").cast("long")
    return read(spark, d, "lineitem").select(
        "l_suppkey", F.col("l_linestatus").alias("q_contig"), F.col("l_returnflag").alias("r_contig"), (F.col("l_linenumber") % 3 == 0).alias("reverse"), F.col("l_linenumber").cast("int").alias("chain"), q.alias("n_anchors"),
        (F.col("l_orderkey") * 100).alias("q_start"), (F.col("l_orderkey") * 100 + q).alias("q_end"), (F.col("l_partkey") * 50).alias("r_start"), (F.col("l_partkey") * 50 + F.floor(F.col("l_extendedprice") / 100)).alias("r_end"),
    )


@query(f"""WITH {_BLOCKS}, sides AS (SELECT l_suppkey, reverse, sum(n_anchors) AS k FROM blocks GROUP BY 1, 2), main AS (SELECT l_suppkey, arg_max(reverse, (k, NOT reverse)) AS main FROM sides GROUP BY 1),
  o AS (SELECT b.*, main, lag(r_contig) OVER w AS pc, lag(reverse) OVER w AS pr, lag(q_end) OVER w AS pqe, lag(r_start) OVER w AS prs, lag(r_end) OVER w AS pre, lag(n_anchors) OVER w AS pn FROM blocks b JOIN main USING (l_suppkey) WINDOW w AS (PARTITION BY l_suppkey, q_contig ORDER BY q_start, q_end, chain, r_contig, reverse, r_start, r_end)),
  g AS (SELECT *, q_start - pqe AS dq, CASE WHEN reverse THEN prs - r_end ELSE r_start - pre END AS dr, r_contig = pc AND reverse = pr AS same FROM o),
  c AS (SELECT *, CASE WHEN reverse <> main THEN 'Inversion' WHEN pc IS NULL THEN NULL WHEN r_contig <> pc THEN 'Translocation' WHEN same AND dr < -1000 THEN 'Translocation' WHEN same AND dq - dr >= 1000 THEN 'Insertion' WHEN same AND dr - dq >= 1000 THEN 'Deletion' END AS sv_type FROM g),
  s AS (SELECT *, sv_type IN ('Insertion', 'Deletion') AS indel, least(pre, r_end) AS low, greatest(prs, r_start) AS high FROM c WHERE sv_type IS NOT NULL)
  SELECT l_suppkey, sv_type, q_contig, coalesce(pqe, q_start) AS q_start, CASE WHEN indel THEN q_start ELSE q_end END AS q_end, r_contig, CASE WHEN indel THEN abs(dq - dr) ELSE q_end - q_start END AS size, coalesce(pn, 0) AS support_left, n_anchors AS support_right FROM s
  WHERE NOT (indel AND EXISTS (SELECT 1 FROM blocks t WHERE t.l_suppkey = s.l_suppkey AND t.r_contig = s.r_contig AND t.r_start > s.low AND t.r_end < s.high))""")
def structural_calls_of_blocks(spark, d):
    """Inversions, translocations, insertions and deletions between blocks that move."""
    return chains.structural_calls(line_blocks(spark, d), ["l_suppkey"], 1000).fillna(0, ["support_left"])


@query(f"""WITH {_BLOCKS} SELECT l_suppkey, count(*) AS n_chains, max(n_anchors) AS max_block_anchors, round(sum(n_anchors) / count(*), 6) AS mean_block_anchors, count(*) - count(DISTINCT q_contig) AS breakpoint_count,
  round((sum(n_anchors) - count(*)) / (sum(n_anchors) - 1), 6) AS synteny_score FROM blocks GROUP BY 1""")
def synteny_of_blocks(spark, d):
    return chains.synteny(line_blocks(spark, d), ["l_suppkey"])
