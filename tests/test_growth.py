"""Steps whose cost has to grow no faster than their input."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import kmers, likelihood
from tagloom.functions.likelihood import Strata
from tagloom.llm import op5_lm
from tagloom.operators import calibrate, chains, intervals, mixture, nested, ranking, tags
from tagloom.plans import catalog, domain  # noqa: F401



def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chains_of_many_pairs_share_python_calls(spark):
    """A pair whose anchors go over several batches is still one group, and no pair is a Python call of its own."""
    rows = [(a, a + 1, "c", "d", False, 100 * i, 100 * i + 7 * a) for a in range(6) for i in range(5)] + [(9, 10, "c", "d", True, 100 * i, 900 - 100 * i) for i in range(8)]
    anchors = spark.createDataFrame(rows, "a long, b long, q_contig string, r_contig string, reverse boolean, q_pos long, r_pos long")
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        found = chains.chains(anchors, ["a", "b"], 3)
        got = sorted(tuple(r)[:-1] for r in found.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    want = [(a, a + 1, "c", "d", False, 0, 5, 0, 400, 7 * a, 400 + 7 * a) for a in range(6)] + [(9, 10, "c", "d", True, 0, 8, 0, 700, 200, 900)]
    assert got == sorted(want)
    assert "FlatMapGroups" not in plan(found)

def test_clusters_of_a_key_hold_one_cluster_only(spark):
    rows = [(1, 0, 9, 5, 1), (1, 5, 6, 30, 2), (1, 20, 25, 9, 12), (1, 21, None, 0, 1), (1, 200, 210, 9, 12), (2, 0, 5, 0, 5)]
    df = spark.createDataFrame(rows, "k long, r_start long, r_end long, q_start long, q_end long")
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        found = intervals.two_axis_clusters(df, ["k"], 50)
        got = sorted(found.collect(), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, 25, 1, 30, 3), (1, 21, None, 0, 1, 1), (1, 200, 210, 9, 12, 1), (2, 0, 5, 0, 5, 1)], key=str)
    assert "FlatMapGroups" not in plan(found)


def test_grid_weights_are_the_most_likely_at_once():
    """No direction towards a grid point raises the likelihood of a tag by over 1e-8, with few solves; bound weights keep their coverage."""
    r = np.random.default_rng(5)
    k, b = np.tile([32.0, 27, 27], (40, 1)), np.tile([26.0, 20, 21], (40, 1))
    n = np.stack([r.multinomial(200, r.dirichlet([6, 3, 1, 1]), 3) for _ in range(40)]).astype(float)
    n[0] = 0
    s = Strata(k, b, n[..., :3], n[..., 3])
    w, loglik = mixture.fit(s)
    p = (mixture.kernel(s) @ w[..., None])[..., 0]
    rise = np.einsum("po,pog->pg", mixture.counts(s) / np.maximum(p, 1e-300), mixture.kernel(s)) / 600
    assert rise[1:].max() <= 1 + 1e-8 and np.isneginf(loglik[0]) and np.allclose(w.sum(1), 1)
    want = np.linspace(0.3, 0.9, 40)
    tied, tied_loglik = mixture.fit(s, tilt=mixture.Tilt(), aligned=want)
    assert np.allclose(tied[1:] @ mixture.Tilt().coverage(mixture.GRID), want[1:], atol=1e-8) and (tied_loglik[1:] <= loglik[1:] + 1e-6).all()


def test_fits_are_dealt_by_cores(spark):
    """Pairs of few bytes are not left to one task."""
    rows = [(i, e, 32.0, 26.0, 60.0, 20.0, 8.0, 12.0) for i in range(400) for e in ("A", "N")]
    grouped = likelihood.by_pair(spark.createDataFrame(rows, "p long, enzyme string, tag_len double, body_len double, n0 double, n1 double, n2 double, n_miss double"), ["p"])
    per_task = [r["count"] for r in grouped.groupBy(F.spark_partition_id().alias("t")).count().collect()]
    assert len(per_task) >= spark.sparkContext.defaultParallelism and sum(per_task) == 400


def test_screen_joins_frequent_keys_in_blocks_and_by_rare_keys_first(spark, monkeypatch):
    monkeypatch.setattr(tags, "BLOCK", 3)
    r = np.random.default_rng(2)
    sets = {i: set(r.choice(["hot1", "hot2", *map(str, range(12))], r.integers(1, 9), False).tolist()) for i in range(40)} | {i: {"hot1", "hot2", f"own{i}"} for i in range(40, 60)}
    rows = spark.createDataFrame([(i, t) for i, s in sets.items() for t in sorted(s)], "id long, tag string")
    for least in (1, 2, 3):
        got = {(x["a"], x["b"]): x["shared"] for x in tags.screen(rows, "id", ["tag"], least, 0.0).collect()}
        assert got == {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least}
    joined = plan(tags.screen(rows, "id", ["tag"]))
    assert "_i" in joined and "_j" in joined


def test_tolerant_join_tries_few_pairs_of_tags_that_begin_alike(spark):
    r = np.random.default_rng(4)
    df = spark.createDataFrame([("ACGTACGT" + "".join(r.choice(list("ACGT"), 16)),) for _ in range(200)], "tag string")
    tried = tags.tolerant_pairs(df, df, [], "tag", 2, 24, F.lit(0)).count()  # all that are made have distance 0
    assert 200 <= tried < 2000


def test_tolerant_join_compares_few_tried_pairs_by_place(spark):
    """Shared parts are looked up and a bounded edit distance goes before the comparison by place; shifted tags, which it lets through, are none."""
    r = np.random.default_rng(9)
    base = ["".join(r.choice(list("ab dé木😀"), 24)) for _ in range(12)]
    changed = lambda s, n: "".join("x" if i in r.choice(24, n, False) else c for i, c in enumerate(s))
    words = sorted({*base, *(changed(s, n) for s in base for n in (1, 1, 2, 2, 3)), *(s[1:] + "q" for s in base)})
    df = spark.createDataFrame([(w,) for w in words], "tag string")
    found = tags.tolerant_pairs(df, df, [], "tag", 2, 24, once=True)
    want = {(x, y): d for x in words for y in words if x < y and (d := sum(p != q for p, q in zip(x, y, strict=True))) <= 2}
    got = found.collect()
    assert {(x["a_tag"], x["b_tag"]): x["distance"] for x in got} == want and len(got) == len(want) > 30
    joined = next(line for line in plan(found).splitlines() if "Join " in line)
    assert joined.index("levenshtein") < joined.index("arrays_zip")


def test_strata_and_fragment_identities_are_made_for_classes_and_written_out_for_copies(spark, tmp_path):
    """Ten copies and two near copies: no tag or k-mer is shuffled for a pair of copies, and every pair has its row."""
    r = np.random.default_rng(3)
    word = lambda: "".join(r.choice(list("abcdxyz"), 4)) + "an" + "".join(r.choice(list("abcdxyz"), 6)) + "e" + "".join(r.choice(list("abcdxyz"), 11))
    base = "".join(word() for _ in range(40))
    texts = [base] * 10 + [base[:300] + "q" + base[301:], base[:600]] + ["".join(word() for _ in range(40)), None]
    spark.createDataFrame([(20 - i, t, "src0") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    text = {20 - i: t or "" for i, t in enumerate(texts)}
    tag = {i: {m[1] for m in re.finditer(tags.TEXT_ENZYME.regexes()[0], t)} for i, t in text.items()}
    pairs = [(a, b) for a in text for b in text if a < b and len(tag[a] & tag[b]) >= 3]
    want = {}
    for a, b in pairs:
        n = [min(sum(x != y for x, y in zip(s, u, strict=True)) for u in tag[b]) for s in tag[a]]
        want[a, b] = (*(n.count(m) for m in range(3)), sum(m > 2 for m in n))
    got = catalog.QUERIES["strata_counts"](spark, str(tmp_path)).collect()
    assert {(x["a"], x["b"]): tuple(x)[2:] for x in got} == want and len(got) == len(pairs) == 66
    found = catalog.QUERIES["kmer_fragment_identity"](spark, str(tmp_path))
    identity = {(x["a"], x["b"]): tuple(x)[2:] for x in found.collect()}
    assert sorted(identity) == sorted(pairs) and identity[11, 20] == (1, 1.0, 1.0) and identity[9, 20] == (0, 0.0, 0.0) and 0.9 < identity[10, 20][2] < 1
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    some = spark.createDataFrame(pairs, "a long, b long")
    assert "kmer" not in plan(tags.kmer_identity(some, docs, "doc_id", "text"))


def test_texts_of_like_pairs_are_shuffled_once_a_block(spark, monkeypatch):
    """All pairs of 30 like texts ship each text once for each side of a block, however many pairs it has; counts are those of plain sets, also where numbers of k-mers clash."""
    r = np.random.default_rng(8)
    letters = lambda n: "".join(r.choice(list("abcd efNé木😀"), n, p=[0.2, 0.2, 0.15, 0.1, 0.2, 0.05, 0.05, 0.01, 0.02, 0.01, 0.01]))
    base = letters(5000)
    texts = {i: base[: 5000 - 90 * i] + letters(60 * i) for i in range(30)} | {30: None, 31: "short", 32: letters(900)}
    pairs = [(a, b) for a in range(33) for b in range(a + 1, 33)]
    seqs, some = spark.createDataFrame(list(texts.items()), "id long, t string"), spark.createDataFrame(pairs, "a long, b long")
    monkeypatch.setattr(tags, "KMER_BLOCK", 11)
    blocks, names = tags.text_blocks(some, seqs, "id", "t")
    assert blocks.count() <= 33 * 2 * blocks.select(*names).distinct().count() ** 0.5 < len(pairs)
    grams = lambda s: {g for g in (s[p : p + 16] for p in range(len(s) - 15)) if "N" not in g}
    want = {}
    for a, b in pairs:
        s, there = texts[a] or "", grams(texts[b] or "")
        parts = [grams(s[p : p + 3000]) for p in range(0, len(s), 3000) if len(s[p : p + 3000]) >= 700]
        found = [len(p & there) / len(p) for p in parts if len(p & there) >= 50]
        want[a, b] = (len(found), round(len(found) / len(parts), 9) if parts else 0.0, round((sum(found) / len(found)) ** (1 / 16), 9) if found else 0.0)
    told = lambda: {(x["a"], x["b"]): (x["fragments"], round(x["aligned"], 9), round(x["identity"], 9)) for x in tags.kmer_identity(some, seqs, "id", "t").collect()}
    assert told() == want and len({v for v in want.values()}) > 30
    for all_texts in ([base], [texts[i] or "" for i in range(33)]):
        sets, own = kmers.Sets(all_texts, 16, "N"), kmers.Fragments(base, 16, 3000, 700, "N")
        sizes, counts = kmers.plain(base, all_texts, 16, 3000, 700, "N")
        assert sizes.tolist() == own.sizes.tolist() == [len(grams(p)) for p in (base[:3000], base[3000:])]
        assert sets.shared(own).tolist() == counts.tolist() == [[len(grams(p) & grams(t)) for t in all_texts] for p in (base[:3000], base[3000:])]
    monkeypatch.setattr(kmers, "FACTOR", np.uint64(0))
    with pytest.raises(kmers.Clash):
        kmers.Sets([base], 16, "N")
    assert kmers.unless_clash(kmers.Fragments, base, 16, 3000, 700, "N") is None


def test_calls_are_made_once_for_copies_and_only_where_two_chains_may_be(spark, tmp_path, monkeypatch):
    """Copies and rearranged texts: calls, chains and synteny are those of each pair of documents by itself, but chains are made for classes."""
    r = np.random.default_rng(11)
    word = lambda: "".join(r.choice(list("abcdxyz"), 4)) + "an" + "".join(r.choice(list("abcdxyz"), 6)) + "e" + "".join(r.choice(list("abcdxyz"), 11))
    a, b, c = ("".join(word() for _ in range(8)) for _ in range(3))
    texts = [a + b + c, a + c + b, b + a + c, a + "q" * 1200 + b + c, a[:24 * 4], None]
    rows = [(i, texts[at]) for i, at in enumerate([0, 1, 0, 2, 3, 1, 4, 5, 0, 3, 4, 2])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t = domain.document_tags(spark, str(tmp_path)).select("doc_id", "pos", "tag")
    kept = tags.drop_repeats(t, ["doc_id", "tag"])
    of = lambda who, contig, pos: kept.select(F.col("doc_id").alias(who), F.col("doc_id").alias(contig), F.col("pos").alias(pos), "tag")
    pairs = tags.screen(t, "doc_id", ["tag"]).select("a", "b")
    anchors = pairs.join(of("a", "q_contig", "q_pos"), "a").join(of("b", "r_contig", "r_pos"), ["b", "tag"]).withColumn("reverse", F.lit(False))
    blocks = chains.chains(anchors, ["a", "b"], 3)
    listed = lambda df: sorted(map(tuple, df.select(*sorted(set(df.columns) - {"hits"})).collect()), key=str)
    got, want = catalog.QUERIES["sv_calls"](spark, str(tmp_path)), chains.structural_calls(blocks, ["a", "b"], 50)
    assert got.columns == want.columns and listed(got) == listed(want) and {x["sv_type"] for x in got.collect()} == {"Translocation", "Insertion", "Deletion"}
    assert listed(catalog.QUERIES["chain_blocks"](spark, str(tmp_path))) == listed(blocks)
    assert listed(catalog.QUERIES["breakpoints_synteny"](spark, str(tmp_path))) == listed(chains.synteny(blocks, ["a", "b"]))
    made, like = domain.document_chains(spark, str(tmp_path), 2)
    assert {x["rep"] for x in like.collect()} == {0, 1, 3, 4, 6} and made.select("a", "b").distinct().count() < 20 < pairs.count() and not made.where("a = 6 OR b = 6").count()


def test_expanding_joins_a_class_of_many_members_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(tags, "BLOCK", 3)
    own = spark.createDataFrame([(i, 0 if i < 20 else i) for i in range(22)], "id long, rep long")
    got = sorted(tuple(x) for x in tags.expanded(spark.createDataFrame([(0, 0), (0, 20), (21, 0)], "x long, y long"), own).select("_p", "_q").collect())
    assert got == sorted([(a, b) for a in range(20) for b in range(20)] + [(a, 20) for a in range(20)] + [(21, b) for b in range(20)])


def test_running_totals_in_ranges_hold_for_any_number_of_edges(spark):
    """Edges are looked for in two steps, and their rows are sent to all tasks rather than a key's rows to one."""
    r = np.random.default_rng(6)
    values = [(k, float(v), int(c)) for k, size in (("a", 700), ("b", 90), (None, 300)) for v, c in zip(r.permutation(size) / 7, r.integers(1, 9, size), strict=True)]
    df = spark.createDataFrame(values, "k string, v double, c long")
    for most in (1, 40, 250, 1000):
        out = ranking.keyed_running_total(df, ["k"], "v", "c", "upto", most)
        got = {(x["k"], x["v"]): x["upto"] for x in out.collect()}
        assert got == {(k, v): sum(n for q, w, n in values if q == k and w <= v) for k, v, _ in values}
    text = plan(out)
    assert "_coarse" in text and text.count("_within") and "BroadcastHashJoin" in text


def test_both_feature_lists_are_summed_in_one_pass_and_errors_are_made_once(spark, monkeypatch):
    calls = []
    whole = nested.cells
    monkeypatch.setattr(nested, "cells", lambda *a, **k: calls.append(a[1]) or whole(*a, **k))
    r = np.random.default_rng(7)
    df = spark.createDataFrame([(i, "pqr"[i % 3], float(r.normal()), float(r.normal()) if i % 5 else None, float(r.normal())) for i in range(240)], "i long, band string, u double, v double, y double")
    got = nested.choose(df, ["v"], ["u", "v"], "y", "band", ["i"], seeds=(0, 1))
    assert calls == [["v", "u"]]
    for name, features in (("A", ["v"]), ("B", ["u", "v"])):
        held = nested.band_holdouts(df, features, "y", "band", ["i"], (0, 1))
        predicted = held.predictions(df)
        assert "transform(" not in plan(predicted) and "lambda" not in plan(predicted)
        want = {(x["seed"], x["band"]): x["mae"] for x in nested.errors(predicted, "y", "band", name).collect()}
        told = {(x["seed"], x["band"]): x["mae"] for x in got.table.where(F.col("experiment") == name).collect()}
        assert told.keys() == want.keys() and all(abs(told[k] - want[k]) < 1e-9 for k in want)


def test_rows_of_trees_are_dealt_by_number(spark, monkeypatch):
    monkeypatch.setattr(calibrate, "TASK_ROWS", 10)
    seen = []
    usual = calibrate.GBTRegressor.fit
    monkeypatch.setattr(calibrate.GBTRegressor, "fit", lambda self, part, *a: seen.append(part.rdd.getNumPartitions()) or usual(self, part, *a))
    df = spark.createDataFrame([(float(i % 7), float(i)) for i in range(95)], "x double, y double").coalesce(1)
    calibrate.boosted(df, ["x"], "y", [(1, 1, 0.1)])
    assert seen == [10]


def test_attention_learns_from_every_window(spark, monkeypatch):
    """The gradients of all rounds together have as many targets as the training ids."""
    seen = []
    usual = op5_lm.summed_gradients
    monkeypatch.setattr(op5_lm, "summed_gradients", lambda *a, **k: seen.append(usual(*a, **k)) or seen[-1])
    docs = spark.createDataFrame([(i, f"some words of text number {i} " * (3 + i % 40)) for i in range(60)], "doc_id long, text string")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", op5_lm.training(F.col("doc_id")).alias("train"))
    coded = op5_lm.materialize(op5_lm.code(rows))
    op5_lm.fit(coded)
    assert sum(n for _, n in seen) == coded.where("train").agg(F.sum(F.length("ids") / 2)).first()[0]
    op5_lm.release(coded)
