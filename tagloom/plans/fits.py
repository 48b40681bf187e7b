"""Queries on likelihoods: site places, bounds, mixtures and the choice between models, and votes of short contigs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.likelihood import fit_pairs
from ..operators import chains, mixture, tags
from .catalog import query, read
from .domain import _STRATA, _bisection, line_strata

_SITES = {"A": (2, 0), "N": (0, 1), "R": (0, 0)}  # places of a site that two and three bases fit, by flag


def site_strata(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i: reduce(lambda out, kv: F.when(F.col("enzyme") == kv[0], kv[1][i]).otherwise(out), _SITES.items(), F.lit(0))
    return line_strata(spark, d).withColumns({"d2": at(0), "d3": at(1)})


def _site_loglik(a: str) -> str:
    """SQL of a stratum's log-likelihood at identity a: changes in the body, at places that two and at places that three bases fit."""

    def term(count: str, fit: str, m: int) -> str:
        choose = ("1.0", count, f"{count} * ({count} - 1) / 2")[m]
        return f"({choose} * pow((1 - {a}) * {fit}, {m}) * pow({a}, {count} - {m}))"

    site = ["(" + " + ".join(f"{term('d2', '1.0 / 3', i)} * {term('d3', '2.0 / 3', m - i)}" for i in range(m + 1)) + ")" for m in range(3)]
    p = [f"(pow({a}, k - b - d2 - d3) * (" + " + ".join(f"{term('b', '1.0', i)} * {site[m - i]}" for i in range(m + 1)) + "))" for m in range(3)]
    return f"(n0 * ln({p[0]}) + n1 * ln({p[1]}) + n2 * ln({p[2]}) + miss * ln(1 - {p[0]} - {p[1]} - {p[2]}))"


_SITE_STRATA = _STRATA.replace("st AS (SELECT", "st AS (SELECT CASE l_returnflag WHEN 'A' THEN 2.0 ELSE 0.0 END AS d2, CASE l_returnflag WHEN 'N' THEN 1.0 ELSE 0.0 END AS d3,").replace("GROUP BY 1, 2)", "GROUP BY ALL)")


@query(f"WITH RECURSIVE {_SITE_STRATA}, {_bisection(f'sum({_site_loglik("(a + 1e-7)")} - {_site_loglik("(a - 1e-7)")}) > 0')} SELECT l_suppkey, round((lo + hi) / 2, 4) AS ani_uniform FROM it WHERE step = 50")
def site_class_mle(spark, d):
    """One rate where some places of the site may change and leave the tag to be found."""
    return fit_pairs(site_strata(spark, d), ["l_suppkey"]).select("l_suppkey", F.round("ani_uniform", 4).alias("ani_uniform"))


_PLAIN = _site_loglik("a").replace("d2", "0.0").replace("d3", "0.0")
_SLOPE = f"sum({_site_loglik('(a + 1e-7)')} - {_site_loglik('(a - 1e-7)')}) > 0".replace("d2", "0.0").replace("d3", "0.0")


@query(f"""WITH RECURSIVE {_STRATA}, long AS (SELECT l_suppkey, 'one' AS model, '' AS part, k, b, n0, n1, n2, miss FROM st UNION ALL SELECT l_suppkey, 'each', e, k, b, n0, n1, n2, miss FROM st),
  it(l_suppkey, model, part, step, lo, hi) AS (SELECT DISTINCT l_suppkey, model, part, 0, CAST(0.5 AS DOUBLE), CAST(0.999999 AS DOUBLE) FROM long UNION ALL
    SELECT l_suppkey, model, part, step + 1, CASE WHEN up THEN a ELSE lo END, CASE WHEN up THEN hi ELSE a END FROM (SELECT l_suppkey, model, part, step, lo, hi, a, {_SLOPE} AS up
      FROM (SELECT *, (lo + hi) / 2 AS a FROM it WHERE step < 50) JOIN long USING (l_suppkey, model, part) GROUP BY 1, 2, 3, 4, 5, 6, 7)),
  fits AS (SELECT l_suppkey, model, count(DISTINCT part) AS parameters, sum({_PLAIN}) AS loglik, CAST(sum(n0 + n1 + n2 + miss) AS BIGINT) AS n_tags FROM (SELECT *, (lo + hi) / 2 AS a FROM it WHERE step = 50) JOIN long USING (l_suppkey, model, part) GROUP BY 1, 2),
  bics AS (SELECT *, -2 * loglik + parameters * ln(n_tags) AS bic, max(CASE WHEN model = 'one' THEN loglik END) OVER (PARTITION BY l_suppkey) AS base FROM fits)
  SELECT l_suppkey, model, CAST(parameters AS INTEGER) AS parameters, n_tags, round(loglik, 3) AS loglik, round(bic, 3) AS bic, round(greatest(2 * (loglik - base), 0), 3) AS lrt, model <> 'one' AND 2 * (loglik - base) > 5.991 AS supported,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY bic, parameters) = 1 AS chosen FROM bics""")
def enzyme_rates_choice(spark, d):
    """One identity for all enzymes of a pair against one for each, by likelihood ratio and by BIC, from their fits."""
    rows = line_strata(spark, d)
    one = fit_pairs(rows, ["l_suppkey"]).select("l_suppkey", F.lit("one").alias("model"), F.lit(1).alias("parameters"), F.col("loglik_uniform").alias("loglik"), "n_tags")
    each = fit_pairs(rows.withColumn("part", F.col("enzyme")), ["l_suppkey", "part"]).groupBy("l_suppkey").agg(F.count("*").cast("int").alias("parameters"), F.sum("loglik_uniform").alias("loglik"), F.sum("n_tags").alias("n_tags"))
    fits = one.unionByName(each.withColumn("model", F.lit("each")))
    out = mixture.compare(fits, ["l_suppkey"], "one", 5.991)  # 95 % of chi-squared with two degrees
    return out.select("l_suppkey", "model", "parameters", "n_tags", *[F.round(c, 3).alias(c) for c in ("loglik", "bic", "lrt")], "supported", "chosen")


def _rounded(df: DataFrame, places: dict[str, int]) -> DataFrame:
    return df.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in df.columns])


@query()
def model_choice(spark, d):
    """One rate, gamma-distributed rates, two to four components and the grid for each pair; the last against gamma as the null."""
    fits = mixture.models(line_strata(spark, d), ["l_suppkey"])
    out = mixture.compare(fits, ["l_suppkey"], "gamma", 20.0)
    return _rounded(out, {"loglik": 2, "ani": 4, "bic": 2, "lrt": 2})


@query()
def mixture_two(spark, d):
    return _rounded(mixture.two_pairs(line_strata(spark, d), ["l_suppkey"]), {"v1": 3, "v2": 3, "w": 2, "ani": 3, "loglik": 2})


def _with_share(spark: SparkSession, d: str) -> DataFrame:
    """Strata with the share of tags found as the aligned fraction of the pair."""
    rows = line_strata(spark, d)
    share = rows.groupBy("l_suppkey").agg((F.sum(F.col("n0") + F.col("n1") + F.col("n2")) / F.sum(F.col("n0") + F.col("n1") + F.col("n2") + F.col("n_miss"))).alias("aligned"))
    return rows.join(share, "l_suppkey")


@query()
def mixture_tilted(spark, d):
    """Grid weights of the whole genome, whose coverage is the aligned fraction."""
    fits = mixture.fit_pairs(_with_share(spark, d), ["l_suppkey"], mixture.Tilt(), "aligned").drop("weights")
    return _rounded(fits, {"ani_mixture": 3, "coverage": 6, "loglik_mixture": 1})


@query()
def gamma_tilted(spark, d):
    return _rounded(mixture.tilted_gamma_pairs(_with_share(spark, d), ["l_suppkey"], mixture.Tilt(), "aligned", 200.0), {"d": 3, "shape": 2, "ani": 3, "loglik": 2})


_LINES = """lines AS (SELECT doc_id, i, list_sum(list_transform(parts[:i], lambda s: length(s) + 1)) - length(parts[i]) - 1 AS start, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"""


@query(f"""WITH {_LINES}, t AS (SELECT doc_id, i, start + p AS pos, substr(line, p + 1, 24) AS tag FROM (SELECT doc_id, i, start, line, unnest(range(0, length(line) - 23)) AS p FROM lines WHERE length(line) >= 24) WHERE substr(line, p + 5, 2) = 'an' AND substr(line, p + 13, 1) = 'e'),
  u AS (SELECT doc_id, tag, min(i) AS i FROM t GROUP BY 1, 2 HAVING count(*) = 1), f AS (SELECT tag, min(doc_id) AS b, arg_min(i, doc_id) AS r_contig FROM u GROUP BY 1)
  SELECT u.doc_id AS a, b, CAST(u.i AS INTEGER) AS q_contig, CAST(r_contig AS INTEGER) AS r_contig, count(*) AS n_unique FROM u JOIN f ON f.tag = u.tag AND f.b <> u.doc_id GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2""")
def short_contig_votes(spark, d):
    """Lines as contigs: where a document's line may lie in the first document with the same tag, by tags that each of the two has once."""
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("i", F.col("i") + 1)
    own = tags.digest(lines, ["doc_id", "i"], "line", [tags.TEXT_ENZYME])
    once = own.groupBy("doc_id", "tag").agg(F.count("*").alias("n"), F.first("i").alias("i")).where("n = 1")
    first = once.groupBy("tag").agg(F.min(F.struct("doc_id", "i")).alias("f")).select("tag", F.col("f.doc_id").alias("b"), F.col("f.i").alias("r_contig"))
    shared = once.withColumnsRenamed({"doc_id": "a", "i": "q_contig"}).join(first, "tag").where("a <> b")
    anchors = shared.select("a", "b", "q_contig", "r_contig", F.lit(False).alias("reverse"), F.lit(0).alias("distance"), F.lit(True).alias("unique"))
    return chains.votes(anchors, ["a", "b"]).select("a", "b", "q_contig", "r_contig", "n_unique")
