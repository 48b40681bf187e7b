"""Queries on tags, pairs, fits, chains, graphs and models. A document plays a contig, its text the sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.likelihood import fit_pairs
from ..operators import calibrate, chains, graph, metrics, mixture, ranking, tags
from ..storage import materialize, release
from .catalog import MEASURED, measured, query, read

_TAGS = """tags AS (SELECT doc_id, p AS pos, substr(text, p + 1, 24) AS tag FROM (SELECT doc_id, text, unnest(range(0, length(text) - 23)) AS p FROM documents WHERE length(text) >= 24)
  WHERE substr(text, p + 5, 2) = 'an' AND substr(text, p + 13, 1) = 'e')"""
_SCREEN = f"""{_TAGS}, dt AS (SELECT DISTINCT doc_id, tag FROM tags), sizes AS (SELECT doc_id, count(*) AS size FROM dt GROUP BY 1),
  shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM dt x JOIN dt y ON x.tag = y.tag AND x.doc_id < y.doc_id GROUP BY 1, 2 HAVING count(*) >= 3),
  pairs AS (SELECT a, b, shared, shared / least(m.size, n.size) AS containment FROM shared JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE shared / least(m.size, n.size) >= 0.001)"""


def document_tags(spark: SparkSession, d: str) -> DataFrame:
    """With places; one scan where the rows lie."""
    return tags.digest(read(spark, d, "documents"), ["doc_id"], "text", [tags.TEXT_ENZYME])


def document_tag_strings(spark: SparkSession, d: str) -> DataFrame:
    """Without places; native."""
    return tags.digest_strings(read(spark, d, "documents"), "doc_id", "text", tags.TEXT_ENZYME)


def class_pairs(t: DataFrame, like: DataFrame) -> DataFrame:
    """a, b: pairs of classes (like: id, rep; of one tag set each) whose documents pass the screen, in either order as far as a member of a comes before one of b; materialized. t: doc_id, tag."""
    pairs, own = (materialize(x) for x in tags.screen_classes(t, "doc_id", ["tag"]))
    inside = own.join(like.withColumnRenamed("rep", "_like"), "id").select("rep", F.col("_like").alias("id")).distinct()
    of_like = tags.expanded(pairs.select("x", "y"), inside).where("x <> y OR _p <= _q").select(F.col("_p").alias("x"), F.col("_q").alias("y"))
    wanted = materialize(tags.directed(of_like, like).toDF("a", "b"))
    release(pairs, own)
    return wanted


def of_copies(rows: DataFrame, like: DataFrame) -> DataFrame:
    """rows of pairs a, b of classes for each pair of their documents, which are the contigs too."""
    wide = tags.expanded(rows.withColumnsRenamed({"a": "x", "b": "y"}), like).where("_p < _q")
    names = {"a": "_p", "b": "_q", "q_contig": "_p", "r_contig": "_q"}
    return wide.select(*[F.col(names.get(c, c)).alias(c) for c in rows.columns])


def screened(spark: SparkSession, d: str) -> DataFrame:
    return tags.screen(document_tag_strings(spark, d), "doc_id", ["tag"])


@query(f"WITH {_TAGS} SELECT doc_id, pos, tag FROM tags")
def digest_tags(spark, d):
    return document_tags(spark, d).select("doc_id", "pos", "tag")


@query(f"WITH {_TAGS}, o AS (SELECT doc_id, tag, count(*) AS n FROM tags GROUP BY 1, 2) SELECT doc_id, pos, tag, n AS occurrence FROM tags JOIN o USING (doc_id, tag) WHERE n <= 5")
def tag_repeat_filter(spark, d):
    return tags.drop_repeats(document_tags(spark, d), ["doc_id", "tag"]).select("doc_id", "pos", "tag", "occurrence")


@query(f"WITH {_SCREEN} SELECT a, b, shared, round(containment, 6) AS containment FROM pairs")
def screen_pairs(spark, d):
    return screened(spark, d).withColumn("containment", F.round("containment", 6))


@query(f"""WITH {_SCREEN}, hits AS (SELECT a AS query, b AS target, shared, containment FROM pairs UNION ALL SELECT b, a, shared, containment FROM pairs),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY containment DESC, target) AS rn FROM hits) SELECT query, target, round(1 + ln(containment) / 24, 6) AS similarity FROM r WHERE rn = 1""")
def search_best_first(spark, d):
    p = screened(spark, d)
    hits = p.select(F.col("a").alias("query"), F.col("b").alias("target"), "containment").union(p.select("b", "a", "containment"))
    return ranking.top_hit(hits, "query", "target", "containment").select("query", "target", F.round(1 + F.log("containment") / 24, 6).alias("similarity"))


@query(f"""WITH {_SCREEN} SELECT a, b, m.size AS size_a, n.size AS size_b, round(containment, 6) AS containment FROM pairs JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b""")
def triangle_matrix(spark, d):
    """The cells of the triangle of all documents in long form; a pair that isn't there was screened out."""
    sizes = document_tag_strings(spark, d).groupBy("doc_id").agg(F.countDistinct("tag").alias("size"))
    named = lambda c: sizes.select(F.col("doc_id").alias(c), F.col("size").alias(f"size_{c}"))
    return screened(spark, d).join(named("a"), "a").join(named("b"), "b").select("a", "b", "size_a", "size_b", F.round("containment", 6).alias("containment"))


@query(f"""WITH {_TAGS}, t AS (SELECT DISTINCT tag FROM tags) SELECT x.tag AS a_tag, y.tag AS b_tag, list_sum(list_transform(range(1, 25), lambda i: CASE WHEN x.tag[i] <> y.tag[i] THEN 1 ELSE 0 END))::INTEGER AS distance
  FROM t x JOIN t y ON x.tag < y.tag WHERE list_sum(list_transform(range(1, 25), lambda i: CASE WHEN x.tag[i] <> y.tag[i] THEN 1 ELSE 0 END)) <= 2""")
def pigeonhole_pairs(spark, d):
    t = document_tag_strings(spark, d).select("tag").distinct()
    return tags.tolerant_pairs(t, t, [], "tag", 2, 24, once=True)


_BASES = "translate(lower(coalesce(text, '')), 'etaoinshrdlucmfwypvbgkjqxz', 'ACGTACGTACGTACGTACGTACGTAC')"


@query(f"""WITH s AS (SELECT doc_id, regexp_replace({_BASES}, '[^ACGT]', '', 'g') AS s FROM documents) SELECT doc_id, length(s) AS n, md5(least(s, reverse(translate(s, 'ACGT', 'TGCA')))) AS canonical_md5, round((length(s) - length(replace(replace(s, 'G', ''), 'C', ''))) / nullif(length(s), 0), 6) AS gc FROM s""")
def reverse_complement_canonical(spark, d):
    s = F.regexp_replace(F.translate(F.lower(F.coalesce("text", F.lit(""))), "etaoinshrdlucmfwypvbgkjqxz", "ACGTACGTACGTACGTACGTACGTAC"), "[^ACGT]", "")
    return read(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", F.length("s").cast("long").alias("n"), F.md5(C.canonical(F.col("s"))).alias("canonical_md5"), F.round(C.gc_fraction(F.col("s")), 6).alias("gc"))


@query(f"""WITH {_SCREEN}, w AS (SELECT DISTINCT doc_id, kmer FROM (SELECT doc_id, substr(text, p + 1, 16) AS kmer FROM (SELECT doc_id, text, unnest(range(0, length(text) - 15)) AS p FROM documents WHERE length(text) >= 16)) WHERE NOT contains(kmer, 'N')),
  c AS (SELECT doc_id, i AS fragment, substr(text, i * 3000 + 1, 3000) AS part FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 2999) // 3000)) AS i FROM documents WHERE length(text) >= 700)),
  f AS (SELECT DISTINCT doc_id, fragment, substr(part, p + 1, 16) AS kmer FROM (SELECT doc_id, fragment, part, unnest(range(0, length(part) - 15)) AS p FROM c WHERE length(part) >= 700) WHERE NOT contains(substr(part, p + 1, 16), 'N')),
  s AS (SELECT doc_id, fragment, count(*) AS size FROM f GROUP BY 1, 2), t AS (SELECT doc_id, count(*) AS n FROM c WHERE length(part) >= 700 GROUP BY 1),
  sh AS (SELECT a, b, x.fragment, count(*) AS shared FROM pairs JOIN f x ON x.doc_id = a JOIN w y ON y.doc_id = b AND y.kmer = x.kmer GROUP BY 1, 2, 3 HAVING count(*) >= 50),
  g AS (SELECT a, b, count(*) AS fragments, avg(shared / size) AS share FROM sh JOIN s ON s.doc_id = a AND s.fragment = sh.fragment GROUP BY 1, 2)
  SELECT a, b, coalesce(fragments, 0) AS fragments, round(coalesce(fragments / n, 0), 6) AS aligned, round(coalesce(pow(share, 1.0 / 16), 0), 6) AS identity FROM pairs LEFT JOIN g USING (a, b) LEFT JOIN t ON t.doc_id = a""")
def kmer_fragment_identity(spark, d):
    """Pairs of distinct texts, then written out for their copies."""
    docs = read(spark, d, "documents")
    t = materialize(document_tag_strings(spark, d).select("doc_id", "tag").distinct())  # texts are scanned for tags once
    texts = materialize(tags.classes_of(docs, "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)))
    wanted = class_pairs(t, texts)
    release(t)
    told = materialize(tags.kmer_identity(wanted, docs, "doc_id", "text").withColumnsRenamed({"a": "x", "b": "y"}))
    release(wanted)
    wide = tags.expanded(told, texts).where("_p < _q").select(F.col("_p").alias("a"), F.col("_q").alias("b"), "fragments", "aligned", "identity")
    return wide.withColumns({c: F.round(c, 6) for c in ("aligned", "identity")})


@query(f"""WITH {_TAGS}, dt AS (SELECT DISTINCT doc_id, tag FROM tags), sizes AS (SELECT doc_id, count(*) AS size FROM dt GROUP BY 1), l AS (SELECT doc_id FROM documents WHERE source = 'src0'), r AS (SELECT doc_id FROM documents WHERE source <> 'src0'),
  shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM dt x JOIN dt y ON x.tag = y.tag WHERE x.doc_id IN (FROM l) AND y.doc_id IN (FROM r) GROUP BY 1, 2 HAVING count(*) >= 3)
  SELECT a, b, shared, round(shared / least(m.size, n.size), 6) AS containment FROM shared JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE shared / least(m.size, n.size) >= 0.001""")
def screen_two_sides(spark, d):
    """Documents of one source as queries against the others as a database: no pair within either is made."""
    docs = read(spark, d, "documents")
    side = lambda where: tags.digest_strings(docs.where(where), "doc_id", "text", tags.TEXT_ENZYME)
    return tags.screen_sides(side("source = 'src0'"), side("source <> 'src0'"), "doc_id", ["tag"]).withColumn("containment", F.round("containment", 6))


@query(f"""WITH {_SCREEN}, m AS (SELECT a, b, x.tag, min(list_sum(list_transform(range(1, 25), lambda i: CASE WHEN x.tag[i] <> y.tag[i] THEN 1 ELSE 0 END))) AS d FROM pairs JOIN dt x ON x.doc_id = a JOIN dt y ON y.doc_id = b GROUP BY 1, 2, 3)
  SELECT a, b, CAST(count(*) FILTER (d = 0) AS BIGINT) AS n0, CAST(count(*) FILTER (d = 1) AS BIGINT) AS n1, CAST(count(*) FILTER (d = 2) AS BIGINT) AS n2, CAST(count(*) FILTER (d > 2) AS BIGINT) AS n_miss FROM m GROUP BY 1, 2""")
def strata_counts(spark, d):
    """Counted for pairs of distinct tag sets, then written out for their copies. Only tags that the other side lacks are compared with tolerance."""
    t = document_tag_strings(spark, d).distinct()
    classes, own = (materialize(x) for x in tags.screen_classes(t, "doc_id", ["tag"]))
    pairs = tags.directed(classes, own).toDF("a", "b")
    keys = ["a", "b", "enzyme"]
    mine = pairs.join(t.withColumnRenamed("doc_id", "a"), "a")
    theirs = pairs.join(t.withColumnRenamed("doc_id", "b"), "b")
    marked = materialize(mine.join(theirs.withColumn("distance", F.lit(0)), [*keys, "tag"], "left"))
    exact, lacking = marked.where("distance = 0"), marked.where("distance IS NULL").drop("distance")
    near = tags.tolerant_pairs(lacking, theirs.join(lacking.select(*keys).distinct(), keys, "left_semi"), keys, "tag", 2, 24).select(*keys, F.col("a_tag").alias("tag"), "distance")
    told = materialize(tags.strata(marked.drop("distance"), exact.unionByName(near), ["a", "b"], ["tag"]).drop("enzyme").withColumnsRenamed({"a": "x", "b": "y"}))
    release(classes, marked)
    return tags.expanded(told, own).where("_p < _q").select(F.col("_p").alias("a"), F.col("_q").alias("b"), "n0", "n1", "n2", "n_miss")


def line_strata(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a supplier as tags, a return flag as enzyme, the quantity as number of differences."""
    q, e = F.col("l_quantity"), F.col("l_returnflag")
    n = [F.sum(F.when((q > lo) & (q <= hi), 1).otherwise(0)).alias(c) for c, lo, hi in (("n0", 0, 30), ("n1", 30, 42), ("n2", 42, 46), ("n_miss", 46, 1000))]
    return read(spark, d, "lineitem").groupBy("l_suppkey", e.alias("enzyme")).agg(*n).withColumn("tag_len", F.when(F.col("enzyme") == "A", 32).otherwise(27)).withColumn("body_len", F.when(F.col("enzyme") == "A", 26).when(F.col("enzyme") == "N", 20).otherwise(21))


_STRATA = """st AS (SELECT l_suppkey, l_returnflag AS e, CASE l_returnflag WHEN 'A' THEN 32.0 ELSE 27.0 END AS k, CASE l_returnflag WHEN 'A' THEN 26.0 WHEN 'N' THEN 20.0 ELSE 21.0 END AS b,
  count(*) FILTER (l_quantity > 0 AND l_quantity <= 30) * 1.0 AS n0, count(*) FILTER (l_quantity > 30 AND l_quantity <= 42) * 1.0 AS n1, count(*) FILTER (l_quantity > 42 AND l_quantity <= 46) * 1.0 AS n2, count(*) FILTER (l_quantity > 46) * 1.0 AS miss FROM lineitem GROUP BY 1, 2)"""
_P = "(pow(a, k) + b * (1 - a) * pow(a, k - 1) + b * (b - 1) / 2 * pow(1 - a, 2) * pow(a, k - 2))"
_DP = "(k * pow(a, k - 1) + b * ((k - 1) * (1 - a) * pow(a, k - 2) - pow(a, k - 1)) + b * (b - 1) / 2 * ((k - 2) * pow(1 - a, 2) * pow(a, k - 3) - 2 * (1 - a) * pow(a, k - 2)))"
_SCORE = f"(n0 * k / a + n1 * ((k - 1) / a - 1 / (1 - a)) + n2 * ((k - 2) / a - 2 / (1 - a)) - miss * {_DP} / (1 - {_P}))"


def _bisection(above: str) -> str:
    return f"""it(l_suppkey, step, lo, hi) AS (SELECT DISTINCT l_suppkey, 0, CAST(0.5 AS DOUBLE), CAST(0.999999 AS DOUBLE) FROM st UNION ALL
  SELECT l_suppkey, step + 1, CASE WHEN up THEN a ELSE lo END, CASE WHEN up THEN hi ELSE a END FROM (SELECT l_suppkey, step, lo, hi, a, {above} AS up FROM (SELECT l_suppkey, step, lo, hi, (lo + hi) / 2 AS a FROM it WHERE step < 50) JOIN st USING (l_suppkey) GROUP BY 1, 2, 3, 4, 5))"""


@query(f"WITH RECURSIVE {_STRATA}, {_bisection(f'sum({_SCORE}) > 0')} SELECT l_suppkey, round((lo + hi) / 2, 4) AS ani_uniform FROM it WHERE step = 50")
def uniform_mle(spark, d):
    return fit_pairs(line_strata(spark, d), ["l_suppkey"]).select("l_suppkey", F.round("ani_uniform", 4).alias("ani_uniform"))


@query(f"WITH RECURSIVE {_STRATA}, {_bisection(f'sum((n0 + n1 + n2 + miss) * {_P}) < sum(n0 + n1 + n2)')} SELECT l_suppkey, round((lo + hi) / 2, 4) AS ani_from_loss FROM it WHERE step = 50")
def loss_inversion(spark, d):
    return fit_pairs(line_strata(spark, d), ["l_suppkey"]).select("l_suppkey", F.round("ani_from_loss", 4).alias("ani_from_loss"))


@query()
def gamma_mle(spark, d):
    fits = fit_pairs(line_strata(spark, d), ["l_suppkey"])
    return fits.select("l_suppkey", *[F.round(c, 4).alias(c) for c in ("ani", "std_err", "lrt", "retention", "enzyme_spread", "enzyme_chi2")], "supported", "n_tags")


_ANI_UPPER = f"""WITH RECURSIVE {_STRATA}, c AS (SELECT l_suppkey, CAST(sum(n0 + n1 + n2) AS BIGINT) AS x, CAST(sum(n0 + n1 + n2 + miss) AS BIGINT) AS n FROM st GROUP BY 1),
  terms AS (SELECT l_suppkey, x, n, list_transform(range(0, x + 1), lambda j: lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)) AS ln_choose FROM c WHERE x < n),
  lim(l_suppkey, step, lo, hi) AS (SELECT l_suppkey, 0, x / n, CAST(1 AS DOUBLE) FROM terms UNION ALL
    SELECT l_suppkey, step + 1, CASE WHEN tail > 0.05 THEN p ELSE lo END, CASE WHEN tail > 0.05 THEN hi ELSE p END FROM (SELECT l_suppkey, step, lo, hi, p,
      list_sum(list_transform(range(0, x + 1), lambda j: exp(ln_choose[j + 1] + j * ln(p) + (n - j) * ln(1 - p)))) AS tail FROM (SELECT *, (lo + hi) / 2 AS p FROM lim WHERE step < 50) JOIN terms USING (l_suppkey))),
  top AS (SELECT c.l_suppkey, coalesce((lo + hi) / 2, 1.0) AS p FROM c LEFT JOIN lim ON lim.l_suppkey = c.l_suppkey AND step = 50),
  {_bisection(f'sum((n0 + n1 + n2 + miss) * {_P}) < max(p) * sum(n0 + n1 + n2 + miss)').replace("JOIN st USING (l_suppkey)", "JOIN st USING (l_suppkey) JOIN top USING (l_suppkey)")},
  ends AS (SELECT l_suppkey, sum((n0 + n1 + n2 + miss) * {_P.replace("a, k", "0.999999, k").replace("1 - a", "1 - 0.999999")}) / sum(n0 + n1 + n2 + miss) AS high, sum((n0 + n1 + n2 + miss) * {_P.replace("a, k", "0.5, k").replace("1 - a", "1 - 0.5")}) / sum(n0 + n1 + n2 + miss) AS low FROM st GROUP BY 1)
  SELECT l_suppkey, round(CASE WHEN p >= 1 OR p >= high THEN 1.0 WHEN p <= low THEN 0.5 ELSE (lo + hi) / 2 END, 4) AS ani_upper95 FROM it JOIN top USING (l_suppkey) JOIN ends USING (l_suppkey) WHERE step = 50"""


@query(_ANI_UPPER)
def ani_upper95(spark, d):
    return fit_pairs(line_strata(spark, d), ["l_suppkey"]).select("l_suppkey", F.round("ani_upper95", 4).alias("ani_upper95"))


def document_chains(spark: SparkSession, d: str, fewest: int = 1) -> tuple[DataFrame, DataFrame]:
    """Chains of the places of tags that two screened documents share, and classes (id, rep) of documents that have equal tags at equal places; both materialized.

    Chains are made for pairs a, b of classes. Tags of at most five places in a document count; pairs whose anchors are too few for `fewest` chains are left out."""
    t = materialize(document_tags(spark, d).select("doc_id", "pos", "tag"))  # texts are scanned once
    listed = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("_all"))
    like = materialize(tags.classes_of(listed, "doc_id", F.sha2(F.to_json("_all"), 256)))
    wanted = class_pairs(t, like)
    placed = tags.drop_repeats(t, ["doc_id", "tag"]).select("doc_id", "pos", "tag")
    x = wanted.join(placed.select(F.col("doc_id").alias("a"), F.col("pos").alias("q_pos"), "tag"), "a")
    anchors = x.join(placed.select(F.col("doc_id").alias("b"), F.col("pos").alias("r_pos"), "tag"), ["b", "tag"]).select("a", "b", F.col("a").alias("q_contig"), F.col("b").alias("r_contig"), F.lit(False).alias("reverse"), "q_pos", "r_pos")
    rows = materialize(chains.chains(chains.enough(anchors, ["a", "b"], fewest * 3), ["a", "b"], 3))
    release(t, wanted)
    return rows, like


@query()
def chain_blocks(spark, d):
    return of_copies(*document_chains(spark, d))


@query()
def breakpoints_synteny(spark, d):
    rows, like = document_chains(spark, d)
    return of_copies(chains.synteny(rows, ["a", "b"]), like)


@query()
def sv_calls(spark, d):
    """A pair with one chain has no call, so pairs have to have anchors for two."""
    rows, like = document_chains(spark, d, 2)
    return of_copies(chains.structural_calls(rows, ["a", "b"], 50), like)


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS a, CAST(-1 - c_nationkey AS BIGINT) AS b FROM customer), two AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(a, b) AS (SELECT a, a FROM two UNION SELECT r.a, two.b FROM r JOIN two ON r.b = two.a),
  c AS (SELECT a AS node, min(b) AS component FROM r GROUP BY 1), s AS (SELECT component, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, component) AS rn FROM c GROUP BY 1)
  SELECT node, component, size, 'sp' || lpad(CAST(rn AS VARCHAR), 4, '0') AS label FROM c JOIN s USING (component)""")
def connected_components(spark, d):
    """Customers and their nations."""
    e = read(spark, d, "customer").select(F.col("c_custkey").alias("a"), (-1 - F.col("c_nationkey")).cast("long").alias("b"))
    return graph.label_by_size(graph.connected_components(e)).select("node", "component", "size", "label")


@query()
def connected_components_whole(spark, d):
    """Parts and suppliers of all lines. Keys begin with 0, so suppliers begin with -1."""
    e = read(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), (-1 - F.col("l_suppkey")).alias("b"))
    return graph.label_by_size(graph.connected_components(e.distinct())).select("node", "component", "size", "label")


FEATURES = ["l_quantity", "l_discount", "l_tax"]


@query()
def ridge_band_holdout(spark, d):
    m = measured(spark, d).withColumn("y", F.col("t2") - F.col("truth"))
    models, _ = calibrate.band_holdout(m, FEATURES, "y", "band")
    return metrics.grouped_errors(m.withColumn("pred", calibrate.by_band(models, "band")), "band", "pred", "y")


_MODEL = calibrate.Ridge(FEATURES, [25.0, 0.05, 0.04], [25.5, 0.05, 0.04], [14.4, 0.03, 0.026], [0.8, -1.5, 0.25], 2.0, 1.0)


@query(f"""WITH {MEASURED} SELECT band, round(avg(2.0 + 0.8 * (coalesce(l_quantity, 25.0) - 25.5) / 14.4 - 1.5 * (coalesce(l_discount, 0.05) - 0.05) / 0.03 + 0.25 * (coalesce(l_tax, 0.04) - 0.04) / 0.026), 6) AS score FROM measured GROUP BY 1""")
def linear_score(spark, d):
    return measured(spark, d).groupBy("band").agg(F.round(F.avg(_MODEL.column()), 6).alias("score"))


_TREES = [
    {"feature": "p_size", "threshold": 20, "left": {"feature": "p_retailprice", "threshold": 1200, "left": {"value": 1.0}, "right": {"value": 2.5}}, "right": {"value": -1.0}},
    {"feature": "p_retailprice", "threshold": 1000, "left": {"value": 0.5}, "right": {"feature": "p_size", "threshold": 35, "left": {"value": -0.25}, "right": {"value": 3.0}}},
]


@query("""SELECT p_partkey, round(10.0 + 0.1 * CASE WHEN p_size <= 20 THEN CASE WHEN p_retailprice <= 1200 THEN 1.0 ELSE 2.5 END ELSE -1.0 END + 0.1 * CASE WHEN p_retailprice <= 1000 THEN 0.5 ELSE CASE WHEN p_size <= 35 THEN -0.25 ELSE 3.0 END END, 6) AS pred FROM part""")
def gbrt_infer(spark, d):
    return read(spark, d, "part").select("p_partkey", F.round(calibrate.forest(_TREES, 10.0, 0.1), 6).alias("pred"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS e, CAST(l_linenumber AS BIGINT) AS x FROM lineitem)
  SELECT l_orderkey, l_linenumber, round(CASE WHEN x % 3 = 0 THEN e / (e + 2 * x) WHEN x % 3 = 1 THEN (e + x - x) / (e + x) ELSE e / (e + x) END, 6) AS identity FROM p""")
def cigar_identity(spark, d):
    e, x = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    cigar = F.when(x % 3 == 0, F.concat(e.cast("string"), F.lit("="), x.cast("string"), F.lit("X"), x.cast("string"), F.lit("I5S"))).otherwise(F.concat((e + x).cast("string"), F.lit("M")))
    nm = F.when(x % 3 == 1, x)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.cigar_identity(cigar, e, e + x, nm), 6).alias("identity"))


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1""")
def str_map_parse(spark, d):
    pairs = F.str_to_map(F.translate("props", '{}" ', ""), F.lit(","), F.lit(":"))
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.element_at(pairs, "k").try_cast("long")).alias("k_sum"))




@query()
def mixture_npmle(spark, d):
    return mixture.fit_pairs(line_strata(spark, d), ["l_suppkey"]).select("l_suppkey", F.round("ani_mixture", 4).alias("ani_mixture"), F.round("loglik_mixture", 2).alias("loglik_mixture"))
