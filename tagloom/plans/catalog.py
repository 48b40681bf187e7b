"""Every query by name, and the SQL that gives the same rows.

Lines of orders stand for measured pairs: the list price is the truth, three
ways to price a line are tools that estimate it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import assign, intervals, joins, metrics, ranking
from ..storage import small

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def measured(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", "p_brand")
    line = read(spark, d, "lineitem")
    price, q = F.col("l_extendedprice") / 1000, F.col("l_quantity")
    band = F.when(q <= 10, "b1").when(q <= 20, "b2").when(q <= 30, "b3").when(q <= 40, "b4").otherwise("b5")
    return line.join(part, "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "p_brand", band.alias("band"),
        (F.col("p_retailprice") * q / 1000).alias("truth"), price.alias("t1"), (price * (1 - F.col("l_discount"))).alias("t2"), (price * (1 + F.col("l_tax"))).alias("t3"),
    )


MEASURED = """measured AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, p_brand,
  CASE WHEN l_quantity <= 10 THEN 'b1' WHEN l_quantity <= 20 THEN 'b2' WHEN l_quantity <= 30 THEN 'b3' WHEN l_quantity <= 40 THEN 'b4' ELSE 'b5' END AS band,
  p_retailprice * l_quantity / 1000 AS truth, l_extendedprice / 1000 AS t1, l_extendedprice / 1000 * (1 - l_discount) AS t2, l_extendedprice / 1000 * (1 + l_tax) AS t3
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query(f"""WITH {MEASURED} SELECT CASE WHEN grouping(band) = 1 THEN 'all' ELSE band END AS band, count(*) AS n, round(avg(abs(t2 - truth)), 6) AS mae, round(sqrt(avg((t2 - truth) * (t2 - truth))), 6) AS rmse,
  round(avg(t2 - truth), 6) AS bias, round(corr(t2, truth), 6) AS r FROM measured GROUP BY GROUPING SETS ((band), ()) HAVING count(*) >= 5""")
def metrics_by_band(spark, d):
    return metrics.grouped_errors(measured(spark, d), "band", "t2", "truth", 5)


@query(f"""WITH {MEASURED} SELECT p_brand, count(*) AS n, round(1 - sum((t2 - truth) * (t2 - truth)) / (sum(truth * truth) - sum(truth) * sum(truth) / count(*)), 6) AS r2 FROM measured GROUP BY p_brand HAVING count(*) >= 2""")
def metrics_r2_by_group(spark, d):
    return measured(spark, d).groupBy("p_brand").agg(F.count("*").alias("n"), F.round(metrics.r_squared("t2", "truth"), 6).alias("r2")).where("n >= 2")


_STACK = " UNION ALL ".join(f"SELECT '{t}' AS tool, {t} - truth AS e, l_returnflag, band FROM measured" for t in ("t1", "t2", "t3"))


@query(f"""WITH {MEASURED}, long AS ({_STACK}) SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' WHEN grouping(band) = 0 THEN 'band' ELSE 'overall' END AS dim,
  CASE WHEN grouping(l_returnflag) = 0 THEN l_returnflag WHEN grouping(band) = 0 THEN band ELSE 'all' END AS value, tool, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(median(abs(e)), 6) AS median_abs_err,
  round(avg(e), 6) AS bias, round(avg(CAST(abs(e) <= 0.1 AS DOUBLE)), 6) AS within_0_1, round(avg(CAST(abs(e) <= 0.5 AS DOUBLE)), 6) AS within_0_5, round(avg(CAST(abs(e) <= 1.0 AS DOUBLE)), 6) AS within_1_0
  FROM long GROUP BY GROUPING SETS ((tool), (tool, l_returnflag), (tool, band))""")
def metric_stack_unpivot(spark, d):
    return metrics.metric_stack(measured(spark, d), ["l_returnflag", "band"], ["t1", "t2", "t3"], "truth")


@query(f"""WITH {MEASURED}, long AS (SELECT t2 - truth AS y, unnest(['l_quantity', 'l_discount', 'l_tax', 't1']) AS feature, unnest([l_quantity, l_discount, l_tax, t1]) AS x FROM measured)
  SELECT feature, count(*) AS n, round(corr(x, y), 6) AS r FROM long GROUP BY feature HAVING count(*) >= 30""")
def feature_corr(spark, d):
    return metrics.feature_correlations(measured(spark, d).withColumn("y", F.col("t2") - F.col("truth")), ["l_quantity", "l_discount", "l_tax", "t1"], "y")


@query("""WITH r AS (SELECT o_orderpriority AS g, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2.0 AS ry FROM orders)
  SELECT g AS o_orderpriority, count(*) AS n, round(corr(CAST(rx AS DOUBLE), CAST(ry AS DOUBLE)), 6) AS rho FROM r GROUP BY g""")
def spearman_by_group(spark, d):
    return metrics.spearman(read(spark, d, "orders"), "o_totalprice", "o_custkey", "o_orderpriority")


@query("""WITH x AS (SELECT quality, n_chars FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL AND quality IN (0, 1)), r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS k FROM x)
  SELECT CAST(sum(quality) AS BIGINT) AS n_pos, CAST(sum(1 - quality) AS BIGINT) AS n_neg, round((sum(CASE WHEN quality = 1 THEN CAST(k AS DOUBLE) ELSE 0 END) - sum(quality) * (sum(quality) + 1) / 2.0) / (sum(quality) * sum(1 - quality)), 6) AS auc FROM r""")
def auc_rank(spark, d):
    return metrics.auc(read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id"), "quality", "n_chars")


@query("""WITH e AS (SELECT list_distinct(quantile_cont(o_totalprice, [0.0, 0.25, 0.5, 0.75, 1.0])) AS q FROM orders), b AS (SELECT o_totalprice AS v, greatest(len(list_filter(q, lambda x: o_totalprice > x)), 1) - 1 AS bin FROM orders, e)
  SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 4) AS mean FROM b GROUP BY bin""")
def qcut_summary(spark, d):
    binned = ranking.quantile_bins(read(spark, d, "orders"), "o_totalprice", 4)
    v = "o_totalprice"
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.min(v), 6).alias("low"), F.round(F.max(v), 6).alias("high"), F.round(F.avg(v), 4).alias("mean"))


@query(f"""WITH {MEASURED}, t AS (SELECT quantile_cont(l_discount, 0.85) AS q FROM measured) SELECT CASE WHEN l_discount > q THEN 'flagged' ELSE 'kept' END AS part, count(*) AS n, round(avg(abs(t2 - truth)), 6) AS mae FROM measured, t GROUP BY 1""")
def quantile_flag(spark, d):
    m = measured(spark, d)
    t = ranking.quantiles(m, [], "l_discount", [0.85]).select(F.col("quantiles")[0].alias("q"))
    part = F.when(F.col("l_discount") > F.col("q"), "flagged").otherwise("kept")
    return m.join(F.broadcast(t)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("t2") - F.col("truth"))), 6).alias("mae"))


@query("""SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'all' ELSE l_returnflag END AS l_returnflag, CASE WHEN grouping(l_linestatus) = 1 THEN 'all' ELSE l_linestatus END AS l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def crosstab_margins(spark, d):
    return metrics.crosstab(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query(f"""WITH {MEASURED} SELECT band, round(avg(least(abs(t1 - truth), abs(t2 - truth))), 6) AS oracle_mae, round(avg(abs(t1 - truth)), 6) AS mae1, round(avg(abs(t2 - truth)), 6) AS mae2 FROM measured GROUP BY band""")
def oracle_best_of_two(spark, d):
    e = {t: F.abs(F.col(t) - F.col("truth")) for t in ("t1", "t2")}
    return measured(spark, d).groupBy("band").agg(F.round(F.avg(F.least(*e.values())), 6).alias("oracle_mae"), F.round(F.avg(e["t1"]), 6).alias("mae1"), F.round(F.avg(e["t2"]), 6).alias("mae2"))


_GATE = """CASE WHEN t1 IS NULL THEN 'none' WHEN abs(t3 - t2) * 10 > 5 THEN 'uniform_fallback' WHEN l_linenumber = 1 THEN 'uniform' ELSE 'gamma' END"""


@query(f"""WITH {MEASURED} SELECT {_GATE} AS gate, count(*) AS n, round(avg(CASE WHEN {_GATE} = 'uniform_fallback' THEN t1 ELSE t2 END), 6) AS ani_gated FROM measured GROUP BY 1""")
def gate_rule(spark, d):
    m = measured(spark, d).withColumn("shape", F.when(F.col("l_linenumber") == 1, float("inf")).otherwise(1.0))
    g = m.withColumn("gate", C.gate(F.col("t3") * 10, F.col("t2") * 10, F.col("shape"), F.col("t1")))
    return g.withColumn("v", C.gated(F.col("gate"), F.col("t2"), F.col("t1"))).groupBy("gate").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("ani_gated"))


@query(f"""WITH {MEASURED}, rules AS (SELECT unnest([0.0, 1.0, 2.0, 5.0, 10.0]) AS cut) SELECT cut, count(*) AS n, CAST(sum(CASE WHEN abs(t3 - t2) * 10 > cut THEN 1 ELSE 0 END) AS BIGINT) AS n_switched,
  round(avg(abs(CASE WHEN abs(t3 - t2) * 10 > cut THEN t1 ELSE t2 END - truth)), 6) AS mae FROM measured, rules GROUP BY cut""")
def gate_sweep(spark, d):
    swept = measured(spark, d).withColumn("cut", F.explode(F.array(*map(F.lit, (0.0, 1.0, 2.0, 5.0, 10.0)))))  # a fixed number of rules
    switch = F.abs(F.col("t3") - F.col("t2")) * 10 > F.col("cut")
    return swept.groupBy("cut").agg(F.count("*").alias("n"), F.sum(F.when(switch, 1).otherwise(0)).alias("n_switched"), F.round(F.avg(F.abs(F.when(switch, F.col("t1")).otherwise(F.col("t2")) - F.col("truth"))), 6).alias("mae"))


@query("""SELECT CASE WHEN l_discount IS NULL OR l_discount < 0.02 THEN 'BELOW_DETECTION' WHEN l_tax > 0.06 OR l_linenumber > 5 THEN 'INCONSISTENT' ELSE 'ok' END AS flag, count(*) AS n FROM lineitem GROUP BY 1""")
def flag_precedence(spark, d):
    f = C.flag(F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber"), 0.02, 0.06, 5)
    return read(spark, d, "lineitem").groupBy(f.alias("flag")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN p_retailprice IS NULL OR p_size IS NULL THEN 'NA' WHEN p_retailprice / 15 > 90 AND p_size < 5 THEN 'HQ' WHEN p_retailprice / 15 >= 50 AND p_size < 10 THEN 'MQ' ELSE 'LQ' END AS tier, count(*) AS n FROM part GROUP BY 1""")
def quality_tier(spark, d):
    return read(spark, d, "part").groupBy(C.quality_tier((F.col("p_retailprice") / 15).cast("string"), F.col("p_size").cast("string")).alias("tier")).agg(F.count("*").alias("n"))


@query("""SELECT c.n_name AS customer_nation, s.n_name AS supplier_nation, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = l_suppkey
  LEFT JOIN nation c ON c.n_nationkey = c_nationkey LEFT JOIN nation s ON s.n_nationkey = s_nationkey GROUP BY 1, 2""")
def role_dim_lookup(spark, d):
    nation = small(read(spark, d, "nation").select("n_nationkey", "n_name"), 10_000)
    pairs = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    pairs = pairs.join(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "left").join(read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey", "left")
    counted = pairs.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("n"))
    return joins.lookup(joins.lookup(counted, "c_nationkey", nation, "n_nationkey", "n_name", "customer_nation"), "s_nationkey", nation, "n_nationkey", "n_name", "supplier_nation").groupBy("customer_nation", "supplier_nation").agg(F.sum("n").alias("n"))


@query("""WITH a AS (SELECT least(c_nationkey, c_custkey % 25) AS x, greatest(c_nationkey, c_custkey % 25) AS y, count(*) AS n FROM customer WHERE c_nationkey <> c_custkey % 25 GROUP BY 1, 2),
  b AS (SELECT least(s_nationkey, s_suppkey % 25) AS x, greatest(s_nationkey, s_suppkey % 25) AS y, count(*) AS n FROM supplier WHERE s_nationkey <> s_suppkey % 25 GROUP BY 1, 2)
  SELECT CAST(coalesce(a.x, b.x) AS BIGINT) AS x, CAST(coalesce(a.y, b.y) AS BIGINT) AS y, coalesce(a.n, 0) AS n_customers, coalesce(b.n, 0) AS n_suppliers FROM a FULL JOIN b ON a.x = b.x AND a.y = b.y""")
def full_outer_unordered_pair(spark, d):
    a = joins.unordered(read(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("x"), (F.col("c_custkey") % 25).alias("y")), "x", "y").groupBy("x", "y").agg(F.count("*").alias("n_customers"))
    b = joins.unordered(read(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("x"), (F.col("s_suppkey") % 25).alias("y")), "x", "y").groupBy("x", "y").agg(F.count("*").alias("n_suppliers"))
    return a.join(b, ["x", "y"], "full").fillna(0, ["n_customers", "n_suppliers"])


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1""")
def semi_intersection(spark, d):
    hit = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").join(hit, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') GROUP BY 1""")
def anti_exclusion(spark, d):
    excluded = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").join(excluded, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM r WHERE rn = 1 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def resume_dedupe_last(spark, d):
    done = read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    last = read(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("last"))
    return last.join(done, "o_custkey", "left_anti").select("o_custkey", "last.o_orderkey", F.round("last.o_totalprice", 2).alias("o_totalprice"))


_HITS = "hits AS (SELECT l_partkey, l_suppkey, max(l_extendedprice) AS ani, sum(l_quantity) AS af FROM lineitem GROUP BY 1, 2)"


def hits(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_extendedprice").alias("ani"), F.sum("l_quantity").alias("af"))


@query(f"""WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY ani DESC, l_suppkey) AS rn FROM hits) SELECT l_partkey, l_suppkey, ani FROM r WHERE rn = 1""")
def top_hit(spark, d):
    return ranking.top_hit(hits(spark, d), "l_partkey", "l_suppkey", "ani")


@query(f"""WITH {_HITS}, g AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE WHEN af >= 40 THEN 0 ELSE 1 END, CASE WHEN af >= 40 THEN ani ELSE af END DESC, l_suppkey) AS rn FROM hits)
  SELECT l_partkey, l_suppkey, ani, CASE WHEN af >= 40 THEN 'score' ELSE 'coverage' END AS chosen_by FROM g WHERE rn = 1""")
def top_hit_with_fallback(spark, d):
    return ranking.top_hit_with_fallback(hits(spark, d), "l_partkey", "l_suppkey", "ani", "af", 40)


@query(f"""WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY ani DESC, l_suppkey) AS rank FROM hits) SELECT l_partkey, l_suppkey, ani, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def top3_alternates(spark, d):
    return ranking.top_k(hits(spark, d), ["l_partkey"], [F.desc("ani"), F.asc("l_suppkey")], 3).drop("af")


@query(f"""WITH {MEASURED}, g AS (SELECT l_partkey, count(*) AS n, avg(t2) AS mean, sum(t2 * l_quantity) / sum(l_quantity) AS weighted, median(t2) AS median, arg_min(t2, row(round(abs(t2 - truth), 9), t2)) AS oracle, list_sort(list(t2)) AS v FROM measured GROUP BY 1)
  SELECT l_partkey, n, round(mean, 3) AS mean, round(weighted, 3) AS weighted, round(median, 3) AS median,
  round(list_avg(v[CAST(floor(n * 0.1) AS INTEGER) + 1 : n - CAST(floor(n * 0.1) AS INTEGER)]), 3) AS trimmed, round(oracle, 3) AS oracle FROM g""")
def consensus_estimators(spark, d):
    return metrics.consensus(measured(spark, d), "l_partkey", "t2", "l_quantity", "truth", places=3)


@query("""WITH r AS (SELECT source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS run, sum(n_chars) OVER (PARTITION BY source) AS total FROM documents WHERE n_chars > 0)
  SELECT source, max(n_chars) AS n50 FROM r WHERE 2 * run >= total GROUP BY source""")
def n50_by_source(spark, d):
    return assign.n50(read(spark, d, "documents").where("n_chars > 0"), "source", "n_chars")


@query("""WITH s AS (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS bp FROM lineitem GROUP BY 1, 2), m AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY bp DESC, l_returnflag) AS rn, sum(bp) OVER (PARTITION BY l_suppkey) AS total FROM s)
  SELECT l_suppkey, l_returnflag AS majority, bp AS majority_bp, total - bp AS other_bp, round((total - bp) / total * 100, 6) AS contam_pct FROM m WHERE rn = 1""")
def majority_assignment(spark, d):
    return assign.majority(read(spark, d, "lineitem"), "l_suppkey", "l_returnflag", "l_quantity")


_SPANS = "spans AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + CAST(floor(abs(value) * 60) AS BIGINT) AS e FROM events)"


def spans(spark: SparkSession, d: str) -> DataFrame:
    s = F.unix_timestamp("ts")
    return read(spark, d, "events").select("event_id", "user_id", "event_type", s.alias("s"), (s + F.floor(F.abs("value") * 60)).alias("e"))


@query(f"""WITH {_SPANS}, r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans WHERE s < e)
  SELECT user_id, CAST(sum(greatest(0, e - greatest(s, coalesce(reach, s)))) AS BIGINT) AS covered, CAST(sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) AS BIGINT) AS n_islands FROM r GROUP BY 1""")
def interval_union_length(spark, d):
    return intervals.union_length(spans(spark, d), ["user_id"], "s", "e")


@query(f"""WITH {_SPANS}, r AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r)
  SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(s) AS first, max(e) AS last FROM i GROUP BY 1, 2""")
def island_clusters(spark, d):
    return intervals.islands(spans(spark, d), ["user_id"], "s", "e", 3600)


@query(f"""WITH {_SPANS} SELECT a.event_type, count(*) AS n_pairs, count(DISTINCT p.event_id) AS n_points FROM spans a JOIN spans p ON a.user_id = p.user_id AND a.event_id <> p.event_id AND p.s BETWEEN a.s - 600 AND a.e + 600 GROUP BY 1""")
def point_in_span_tol(spark, d):
    s = spans(spark, d)
    points = s.select("user_id", F.col("event_id").alias("point"), F.col("s").alias("pos"))
    found = intervals.points_in_spans(points, s, ["user_id"], "pos", "s", "e", 600, 3600).where("point <> event_id")
    return found.groupBy("event_type").agg(F.count("*").alias("n_pairs"), F.countDistinct("point").alias("n_points"))


@query(f"""WITH {_SPANS}, o AS (SELECT a.event_id, b.event_id AS other, least(a.e, b.e) - greatest(a.s, b.s) AS overlap FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND least(a.e, b.e) > greatest(a.s, b.s)),
  r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY overlap DESC, other) AS rn FROM o) SELECT event_id, other, overlap FROM r WHERE rn = 1""")
def best_overlap(spark, d):
    s = spans(spark, d)
    other = s.select("user_id", F.col("event_id").alias("other"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return intervals.best_overlap(intervals.overlaps(s, other, ["user_id"], ("s", "e"), ("s2", "e2"), 3600).where("event_id <> other"), ["event_id"], "other")


@query(f"""WITH {_SPANS}, p AS (SELECT a.event_id, b.event_id AS other, abs(b.s - (a.s + a.e) / 2.0) AS d FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND b.s BETWEEN a.s - 3600 AND a.e + 3600),
  r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, other) AS rn FROM p) SELECT event_id, other, CAST(d AS DOUBLE) AS distance FROM r WHERE rn = 1""")
def nearest_match(spark, d):
    s = spans(spark, d)
    points = s.select("user_id", F.col("event_id").alias("other"), F.col("s").alias("pos"))
    found = intervals.points_in_spans(points, s, ["user_id"], "pos", "s", "e", 3600, 7200).where("other <> event_id")
    return intervals.nearest(found, ["event_id"], "other", F.abs(F.col("pos") - (F.col("s") + F.col("e")) / 2.0))


@query("""WITH a AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type <> 'purchase'), b AS (SELECT user_id, count(*) AS taken FROM events WHERE event_type = 'purchase' GROUP BY 1)
  SELECT event_id, user_id FROM a LEFT JOIN b USING (user_id) WHERE n > coalesce(taken, 0)""")
def multiset_anti(spark, d):
    """Events that are left after each purchase of the user has taken one; every event is on one of the sides."""
    e = read(spark, d, "events").select("event_id", "user_id", "event_type")
    return intervals.multiset_difference(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'"), ["user_id"], ["event_id"]).select("event_id", "user_id")


@query("""WITH l AS (SELECT user_id, event_type, value, lag(event_type) OVER w AS t, lag(value) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN t = event_type AND value < v THEN 1 ELSE 0 END) AS BIGINT) AS n_breaks, CAST(sum(CASE WHEN t <> event_type THEN 1 ELSE 0 END) AS BIGINT) AS n_switches FROM l GROUP BY 1""")
def collinearity_breaks(spark, d):
    return intervals.order_breaks(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", "value")


@query("""SELECT a.label, count(*) AS n_pairs, min(a.vec_id * 1000000 + b.vec_id) AS first_pair FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1""")
def band_pairs_self_join(spark, d):
    """What the pairs of each label come to, without making them: their number, and the pair of the two least ids."""
    e = read(spark, d, "embeddings").select("label", "vec_id")
    sizes = e.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label", F.floor(F.col("n") * (F.col("n") - 1) / 2).alias("n_pairs"))
    least = ranking.top_k(e, ["label"], [F.asc("vec_id")], 2).groupBy("label").agg((F.min("vec_id") * 1000000 + F.max("vec_id")).alias("first_pair"))
    return sizes.join(least, "label")


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS turn FROM orders) SELECT o_orderkey, o_orderpriority, CAST(turn AS INTEGER) AS turn FROM r ORDER BY turn, o_orderpriority LIMIT 200""")
def roundrobin_stratified(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ranking.round_robin(o, "o_orderpriority", [F.desc("o_totalprice"), F.asc("o_orderkey")], 200).drop("o_totalprice")


@query()
def roundrobin_capped(spark, d):
    o = read(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey", "o_orderkey")
    return ranking.round_robin_capped(o, "o_orderstatus", "o_orderpriority", ["o_custkey"], "o_orderkey", 100, 2)


@query("""SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE (rn - 1) % 5 = 0""")
def even_spaced_pick(spark, d):
    return ranking.even_pick(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 5, ["o_custkey"]).drop("o_orderdate")


@query("""SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS n_priorities FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 2""")
def groups_with_children(spark, d):
    g = read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("n_priorities"))
    return g.where("n_priorities >= 2")


@query("""SELECT 'union' AS part, count(*) AS n FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer) UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)
  UNION ALL SELECT 'difference', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)""")
def set_operations(spark, d):
    o, c = read(spark, d, "orders").select(F.col("o_custkey").alias("k")), read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    parts = {"union": o.union(c).distinct(), "intersect": o.intersect(c), "difference": c.subtract(o)}
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
        out = row if out is None else out.union(row)
    return out


from . import domain, fits, models, reports  # noqa: E402, F401  register their queries
