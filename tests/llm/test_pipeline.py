"""The five stages on a small table, each judged on its own input."""

import numpy as np
import pytest

import corpus_pipeline as cp
from tagloom.llm.tokens import encoder

r = np.random.default_rng(3)
WORDS = [a + b for a in ("th", "on", "er", "an", "re", "in", "ed", "st") for b in ("e", "and", "ing", "or", "is", "at", "ou")]


def prose(n):
    return " ".join(r.choice(WORDS, n)).capitalize() + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    bench = prose(40)
    base, shared = prose(120), prose(70)
    texts = [prose(100) for _ in range(120)] + [" ".join(w.upper() + "!!" for w in prose(60).split()) for _ in range(60)]
    texts += [base, base, base.replace(WORDS[3], WORDS[4], 1), prose(50) + "\n" + bench + "\n" + prose(50), shared + "\n" + prose(80), prose(80) + "\n" + shared, "", None]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        out = cp.materialize(stage(spark, docs, folder))
        assert tuple(out.columns) == cp.COLUMNS
        kept[name] = {x["doc_id"]: x["text"] for x in out.collect()}
        docs = out
    assert len([i for i in kept["quality"] if i < 120]) >= 118 and not [i for i in kept["quality"] if 120 <= i < 180]
    assert {180, 181, 182} & set(kept["near_duplicates"]) == {180}
    cut = kept["repeated_passages"]
    assert len(cut[185]) < len(kept["near_duplicates"][185]) - 200 and cut[184] == kept["near_duplicates"][184] and cut[0] == kept["quality"][0]
    assert set(cut) - set(kept["decontaminate"]) == {183}
    e = encoder()
    pieces = cp.packing(spark, docs, folder).collect()
    total = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    assert total == {i: (len(e._whole(t)) // 4 if t else 0) + 1 for i, t in kept["decontaminate"].items()}
    assert sum(p["length"] for p in pieces) == sum(total.values())


def test_run(spark, folder):
    assert cp.run(spark, folder).count() > 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, _id int, starts int, score int"


def odd_table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t else None, 1, 2, 3) for i, t in texts], ODD)


def test_near_duplicates_judges_rows(spark, folder):
    base, other = prose(90), prose(70)
    near = base.replace(WORDS[3], WORDS[4], 1) + " end"
    rows = [(5, base), (5, base), (None, base), (None, near), (7, near), (7, other), (9, other), (9, prose(40)), (None, None), (3, None), (4, ""), (None, "")]
    out = cp.near_duplicates(spark, odd_table(spark, rows), folder)
    assert tuple(out.columns) == cp.COLUMNS
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    assert got == sorted([(5, base), (7, other), (9, rows[7][1]), (0, ""), (3, ""), (4, ""), (0, "")])


def test_decontamination_judges_rows(spark, folder):
    bench = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    clean = prose(50)
    rows = [(1, clean), (1, bench), (None, "so " + bench), (None, clean), (2, None), (3, "")]
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in cp.decontaminate(spark, odd_table(spark, rows), folder).collect())
    assert got == sorted([(1, clean), (0, clean), (2, ""), (3, "")])


def test_repeated_passages_judges_rows(spark, folder):
    long = prose(40)
    rows = [(2, long), (2, long), (None, long), (3, long), (1, None), (4, ""), (5, "short")]
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in cp.repeated_passages(spark, odd_table(spark, rows), folder).collect())
    assert got == sorted([(2, long), (2, long), (0, long), (3, ""), (1, ""), (4, ""), (5, "short")])


def test_stages_on_empty_tables(spark, folder, tmp_path):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, folder).count() == 0, name


def test_quality_without_labels_keeps_all(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert cp.quality(spark, docs, str(tmp_path)).count() == docs.count()


def test_workers_get_small_batches_and_forget_words(spark):
    def sizes(batches):
        for batch in batches:
            yield batch.from_pydict({"n": [batch.nbytes]})

    rows = spark.range(40, numPartitions=1).selectExpr("repeat(char(97 + id % 26), 1000000) AS text")
    found = [x["n"] for x in cp.materialize(rows.mapInArrow(sizes, "n long")).collect()]
    assert sum(found) >= 40_000_000 and max(found) <= 8_000_000

    coder = encoder()
    before = coder.ids(["some words of a text"])
    seen = []

    def run(batches):
        seen.append((len(coder.known), len(coder.marks)))
        yield from batches

    assert list(cp.tidy(run, words=True)(iter([1, 2]))) == [1, 2] and seen[0][0] > 0
    assert list(cp.tidy(run)(iter([3]))) == [3] and seen[1] == (0, 0)
    assert coder.ids(["some words of a text"]) == before
