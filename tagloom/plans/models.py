"""Queries on calibration: nested hold-outs, declared features, models that go through a file, and choices of enzymes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.likelihood import fit_pairs
from ..operators import calibrate, nested
from ..operators.features import Feature, FeatureSet
from ..sources import readers, sinks
from ..storage import scratch
from . import api
from .catalog import MEASURED, measured, query, read
from .domain import line_strata


@query()
def nested_calibration(spark, d):
    """Errors of two feature lists, held out by band over five orders, and which of them the rule takes."""
    rows = measured(spark, d).withColumn("y", F.col("t2") - F.col("truth"))
    c = nested.choose(rows, ["l_quantity", "l_discount"], ["l_quantity", "l_discount", "l_tax"], "y", "band", ["l_orderkey", "l_linenumber"])
    return c.table.select("experiment", "seed", "band", "n", *[F.round(x, 6).alias(x) for x in ("mae", "rmse", "bias", "r")], (F.col("experiment") == c.variant).alias("taken"))


DECLARED = FeatureSet(
    (
        Feature("quantity", "q", high=40.0),
        Feature("discount", "disc", fill="l_tax", low=0.01),
        Feature("tax", "l_tax", fill=0.0),
        Feature("price_log", "price", low=0.0, log1p=True),
    ),
    "t1",
    "truth",
)


@query(f"""WITH {MEASURED}, g AS (SELECT *, CASE WHEN l_linenumber <> 2 THEN l_quantity END AS q, CASE WHEN l_linenumber <> 3 THEN l_discount END AS disc, CASE WHEN l_returnflag <> 'R' THEN t1 * 1000 END AS price FROM measured),
  m AS (SELECT median(q) AS mq, median(price) AS mp FROM g)
  SELECT l_orderkey, l_linenumber, round(least(coalesce(q, mq), 40), 6) AS quantity, round(greatest(coalesce(disc, l_tax), 0.01), 6) AS discount, round(coalesce(l_tax, 0), 6) AS tax, round(ln(1 + greatest(coalesce(price, mp), 0)), 6) AS price_log, round(truth - t1, 6) AS y FROM g, m""")
def feature_builder(spark, d):
    """Declared features with gaps filled by medians, another column or a constant, bounded and logged; target = reference - raw."""
    rows = measured(spark, d).withColumns({"q": F.when(F.col("l_linenumber") != 2, F.col("l_quantity")), "disc": F.when(F.col("l_linenumber") != 3, F.col("l_discount")), "price": F.when(F.col("l_returnflag") != "R", F.col("t1") * 1000)})
    built = DECLARED.learn(rows).training(rows, ["l_orderkey", "l_linenumber"])
    return built.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in (*DECLARED.names, "y")])


@query()
def gbrt_from_file(spark, d):
    """Boosted trees trained on all parts, written as JSON, read again and scored; `agrees` compares with the model before writing."""
    parts = read(spark, d, "part").withColumn("y", F.col("p_retailprice") - 10 * F.col("p_size"))
    model = calibrate.boosted(parts, ["p_size", "p_retailprice"], "y", [(3, 10, 0.1)])
    path = scratch(spark)
    sinks.write_model(spark, calibrate.trees_json(model), path)
    again = calibrate.trees_from_json(readers.read_model_text(spark, path))
    before, after = calibrate.boosted_column(model), calibrate.boosted_column(again)
    return parts.select("p_partkey", F.round(after, 4).alias("pred"), (F.abs(before - after) <= 1e-9 * (1 + F.abs(before))).alias("agrees"))


@query()
def panel_subsets(spark, d):
    """Every subset of enzymes against the identity that all of them give: one job for all subsets."""
    rows = line_strata(spark, d).withColumn("query", F.col("l_suppkey").cast("string")).withColumn("reference", F.lit("all"))
    truth = fit_pairs(rows, ["query", "reference"]).select("query", "reference", (F.col("ani_uniform") * 100).alias("anim_ani"))
    subsets = {"A": ["A"], "N": ["N"], "R": ["R"], "A+N": ["A", "N"], "A+R": ["A", "R"], "N+R": ["N", "R"], "A+N+R": ["A", "N", "R"]}
    out = api.subset_errors(rows, truth, subsets)
    return out.select("subset", *[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes if c != "subset"])
