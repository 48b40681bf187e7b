"""Divergence of each source's words from its language and from the other sources, from deduplicated count columns.

A task counts words and documents by language, source and term before anything
is shuffled. Terms in enough documents of their language are kept, each with
its sparse vector of (source, count). Terms with the same vector are one
column with a multiplicity; every pair of sources is evaluated once for each
distinct column, times its multiplicity. A column's zeros are not written out:
with f(x, y) the value of a term that occurs x and y times in a pair i, j, the
sum over all V terms is

    V f(0, 0) + [f(x, 0) - f(0, 0) over terms of i] + [f(0, y) - f(0, 0) over terms of j]
              + [f(x, y) - f(x, 0) - f(0, y) + f(0, 0) over terms of both],

so only pairs of sources that share a column meet in it; the middle sums need
the number of terms by source and count, not the terms.

All arithmetic is in whole numbers; shares are divided in three steps of a
thousand each, which is exact for up to 9e15 words and smoothing together.
Null text, lang and source count as ''. A group without kept terms has count 0
everywhere; without any kept term in a language all pair values are 0 and no
term rows exist. Repeated rows count as often as they occur, whatever their
doc_id, null or not. An empty table gives no rows. Other columns play no part.
Ties in value go by the item's UTF-8 bytes. Memory of a task: its counts, sent
on whenever there are MOST_HELD of them, and one batch of texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, small, table, utf8

LEAST_DOCS, TOP, UNIT, SMOOTHING = 10, 10, 1_000_000_000, 2
MOST_HELD = 400_000

_WORD = re.compile(rb"[a-z\x80-\xff]+")


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs: sums of a part of the documents each; every group also has rows without a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in words.items():
                terms = list(n)
                size = len(terms) + 1
                columns = [pa.array([lang] * size), pa.array([source] * size), pa.array([*terms, None], pa.binary()).cast(pa.string()), pa.array([*n.values(), 0], pa.int64()), pa.array([*map(d.__getitem__, terms), 0], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            words.clear()

        held = 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data, bounds = utf8(batch.column(2))
            raw, bounds = data.tobytes().lower(), bounds.tolist()  # lower() of bytes touches A-Z only
            for i, (lang, source) in enumerate(zip(langs, sources, strict=True)):
                n, d = words.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                found = _WORD.findall(raw[bounds[i] : bounds[i + 1]])
                n.update(found)
                d.update(set(found))
                held += len(n) - before
                if held > MOST_HELD:
                    yield from flushed()
                    held = 0
        yield from flushed()

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*text).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * count / total), exact; count at most total."""
    whole, left = F.lit(0).cast("long"), count
    for _ in range(3):
        left = left * 1000
        whole = whole * 1000 + F.call_function("div", left, total)
        left = left % total
    return whole + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank of every group of documents (text, lang, source)."""
    # one shuffle by term serves the counts by source and the vectors
    by_source = counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vectors = by_source.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("column"))
    terms = materialize(vectors.where(F.col("docs") >= least_docs).select("lang", "term", "column"))
    columns = materialize(terms.groupBy("lang", "column").agg(F.count("*").alias("times")))

    entries = columns.select("lang", "times", F.explode("column").alias("e")).select("lang", "times", "e.source", "e.n")
    histogram = materialize(entries.groupBy("lang", "source", "n").agg(F.sum("times").alias("times")))  # terms by source and count
    kept_terms = columns.groupBy("lang").agg(F.sum("times").alias("v"))
    sums = histogram.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("total"))
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sized = occurring.join(sums, ["lang", "source"], "left").join(kept_terms, "lang", "left")
    total = F.coalesce("total", F.lit(0)) + SMOOTHING * F.coalesce("v", F.lit(0))
    groups = materialize(sized.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), total.alias("total"), F.when(total > 0, share(F.lit(SMOOTHING).cast("long"), total)).alias("zero")))

    def of(prefix: str) -> DataFrame:
        return small(groups.select("lang", *[F.col(c).alias(f"{prefix}{c}") for c in ("source", "total", "zero")]))

    zero = lambda x, y: apart(F.col(x), F.col(y))
    both = columns.select("lang", "times", "column", F.posexplode("column").alias("at", "i")).where(F.col("at") + 1 < F.size("column"))
    both = both.select("lang", "times", F.col("i.source").alias("i_source"), F.col("i.n").alias("i_n"), F.explode(F.slice("column", F.col("at") + 2, F.size("column"))).alias("j"))
    both = both.select("lang", "times", "i_source", "i_n", F.col("j.source").alias("j_source"), F.col("j.n").alias("j_n"))
    both = both.join(of("i_"), ["lang", "i_source"]).join(of("j_"), ["lang", "j_source"])
    both = both.withColumns({"p": share(F.col("i_n") + SMOOTHING, F.col("i_total")), "q": share(F.col("j_n") + SMOOTHING, F.col("j_total"))})
    both = both.select("lang", "i_source", "j_source", (F.col("times") * (zero("p", "q") - zero("p", "j_zero") - zero("i_zero", "q") + zero("i_zero", "j_zero"))).alias("value"))
    both = both.groupBy("lang", "i_source", "j_source").agg(F.sum("value").alias("value"))

    # each group's terms against the zeros of the others; the groups of a language meet here, as each pair is a row of the result
    others = groups.select("lang", F.col("source").alias("j_source"), F.col("zero").alias("j_zero"))
    alone = histogram.withColumnRenamed("source", "i_source").join(of("i_"), ["lang", "i_source"])
    alone = alone.select("lang", "i_source", "times", share(F.col("n") + SMOOTHING, F.col("i_total")).alias("p"), "i_zero").join(small(others), "lang").where(F.col("i_source") != F.col("j_source"))
    alone = alone.select("lang", F.least("i_source", "j_source").alias("i_source"), F.greatest("i_source", "j_source").alias("j_source"), (F.col("times") * (zero("p", "j_zero") - zero("i_zero", "j_zero"))).alias("value"))
    alone = alone.groupBy("lang", "i_source", "j_source").agg(F.sum("value").alias("value"))

    left = groups.select("lang", F.col("source").alias("i_source"), "v", F.col("zero").alias("i_zero"))
    all_pairs = left.join(small(others), "lang").where(F.col("i_source") < F.col("j_source"))
    neither = all_pairs.select("lang", "i_source", "j_source", F.when(F.col("v") > 0, F.col("v") * zero("i_zero", "j_zero")).otherwise(F.lit(0)).alias("value"))
    once = neither.unionByName(both).unionByName(alone).groupBy("lang", "i_source", "j_source").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("i_source").alias("source"), F.col("j_source").alias("item")), F.struct(F.col("j_source").alias("source"), F.col("i_source").alias("item")))).alias("s")
    pairs = once.select("lang", sides, "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    whole = histogram.groupBy("lang").agg(F.sum(F.col("n") * F.col("times")).alias("all")).join(kept_terms, "lang").select("lang", (F.col("all") + SMOOTHING * F.col("v")).alias("whole"))
    in_all = F.aggregate("column", F.lit(0).cast("long"), lambda s, e: s + e["n"])
    rated = terms.join(small(whole), "lang").select("lang", "term", share(in_all + SMOOTHING, F.col("whole")).alias("q"), F.explode("column").alias("e")).select("lang", "term", "q", F.col("e.source").alias("source"), F.col("e.n").alias("n"))
    rated = rated.join(of("").drop("zero"), ["lang", "source"]).withColumn("p", share(F.col("n") + SMOOTHING, F.col("total"))).where("p > q")
    rated = rated.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    out = ranked(pairs).unionByName(ranked(rated).where(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
  words AS (SELECT rid, lang, source, unnest(words) AS term FROM docs),
  kept AS MATERIALIZED (SELECT lang, term FROM words GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 10),
  counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
  v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
  groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
  n AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM groups g LEFT JOIN counts USING (lang, source) GROUP BY 1, 2),
  p AS MATERIALIZED (SELECT k.lang, k.term, n.source, coalesce(c.c, 0) AS c, CAST(1 + (1000000000 * (CAST(coalesce(c.c, 0) AS HUGEINT) + 2)) // (n.n + 2 * v.v) AS HUGEINT) AS p
    FROM kept k JOIN v USING (lang) JOIN n USING (lang) LEFT JOIN counts c ON c.lang = k.lang AND c.term = k.term AND c.source = n.source),
  q AS (SELECT lang, term, CAST(1 + (1000000000 * (CAST(s AS HUGEINT) + 2)) // (total + 2 * v) AS HUGEINT) AS q FROM (SELECT lang, term, sum(c) AS s, sum(sum(c)) OVER (PARTITION BY lang) AS total FROM counts GROUP BY 1, 2) JOIN v USING (lang)),
  pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source AS i, y.source AS j, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s
    ON s.lang = a.lang AND s.i = a.source AND s.j = b.source),
  terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms)) WHERE part = 'pair' OR rank <= 10"""
