"""Models through files, choices of enzymes, declared features and workbooks."""

import io
import json
import math
import zipfile
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import columns as C
from tagloom.functions.likelihood import fit_pairs
from tagloom.operators import calibrate
from tagloom.operators.features import Feature, FeatureSet
from tagloom.plans import api
from tagloom.sources import readers, sheets, sinks


def test_boosted_trees_through_a_file(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(i, float(a), float(b) if i % 9 else None, float(3 * (a > 0.4) + 2 * (b > 0.7))) for i, (a, b) in enumerate(r.random((300, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    model = calibrate.boosted(df, ["a", "b"], "y", [(3, 6, 0.3)])
    sinks.write_model(spark, calibrate.trees_json(model), str(tmp_path / "m"))
    again = calibrate.trees_from_json(readers.read_model_text(spark, str(tmp_path / "m")))
    both = df.select(calibrate.boosted_column(model).alias("x"), calibrate.boosted_column(again).alias("y")).collect()
    assert len(both) == 300 and all(p["x"] == pytest.approx(p["y"], rel=1e-12) for p in both)
    assert again["features"] == ["a", "b"] and again["medians"] == model["medians"] and len({p["x"] for p in both}) > 3


def test_trees_of_another_writer(spark):
    nodes = [{"type": "split", "feature": 1, "feature_name": "b", "threshold": 2.0, "left": 2, "right": 1}, {"type": "leaf", "value": 10.0}, {"type": "split", "feature": 0, "feature_name": "a", "threshold": 0.5, "left": 3, "right": 4}, {"type": "leaf", "value": -1.0}, {"type": "leaf", "value": 4.0}]
    meta = {"n_estimators": 2, "max_depth": 2, "learning_rate": 0.5, "init_value": 7.0, "feature_names": ["a", "b"]}
    model = calibrate.trees_from_json(json.dumps({"meta": meta, "trees": [{"nodes": nodes}, {"nodes": [{"type": "leaf", "value": 1.0}]}]}))
    df = spark.createDataFrame([(0.5, 2.0), (0.6, 2.0), (0.0, 2.1), (None, 1.0), (0.0, None)], "a double, b double")
    assert [r[0] for r in df.select(calibrate.boosted_column(model)).collect()] == [7 - 0.5 + 0.5, 7 + 2 + 0.5, 7 + 5 + 0.5, 7 + 2 + 0.5, 7 + 5 + 0.5]
    nodes[2]["left"] = 0
    with pytest.raises(ValueError, match="leaves"):
        calibrate.trees_from_json(json.dumps({"meta": meta, "trees": [{"nodes": nodes}]}))


def test_linear_models_through_text():
    m = calibrate.Ridge(["a"], [1.5], [2.0], [0.5], [-1.25], 3.0, 10.0)
    text = calibrate.linear_json(m, "one", 12, 0.5)
    assert calibrate.linear_from_json(text) == m and json.loads(text)["training_n"] == 12


STRATA = "query string, reference string, enzyme string, tag_len int, body_len int, n0 long, n1 long, n2 long, n_miss long"


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(6)
    rows = [(f"q{i}", "r", e, 32, 26, *(int(x) for x in r.multinomial(200, [0.5 + b, 0.2, 0.1 - b / 2, 0.2 - b / 2]))) for i in range(6) for e, b in (("e1", 0.0), ("e2", 0.05), ("e3", 0.15))]
    truth = [(f"q{i}", "r", 97.0 + 0.1 * i) for i in range(5)]
    return spark.createDataFrame(rows, STRATA), spark.createDataFrame(truth, "query string, reference string, anim_ani double")


def test_all_subsets_in_one_job_equal_each_alone(spark, panel):
    strata, truth = panel
    subsets = {"+".join(c): list(c) for n in (1, 2, 3) for c in combinations(["e1", "e2", "e3"], n)}
    got = {r["subset"]: r for r in api.subset_errors(strata, truth, subsets).collect()}
    for name, own in subsets.items():
        alone = fit_pairs(strata.where(F.col("enzyme").isin(own)), ["query", "reference"])
        gate = C.gate(F.col("ani_from_loss") * 100, F.col("ani_from_hist") * 100, F.col("het_shape"), F.col("ani"))
        told = alone.withColumn("p", C.gated(gate, F.col("ani"), F.col("ani_uniform")) * 100).join(truth, ["query", "reference"]).select(F.avg(F.abs(F.col("p") - F.col("anim_ani")))).first()[0]
        assert got[name]["mae"] == pytest.approx(told, abs=1e-9) and got[name]["n"] == 5
    best = min(("e1", "e2", "e3"), key=lambda e: got[e]["mae"])
    second = min((e for e in ("e1", "e2", "e3") if e != best), key=lambda e: got["+".join(sorted([best, e]))]["mae"])
    seen = []
    real = api.subset_errors
    api.subset_errors = lambda *a: seen.append(a) or real(*a)
    try:
        assert api.greedy_panel(strata, truth, ["e1", "e2", "e3"], 2) == [best, second]
    finally:
        api.subset_errors = real
    assert [len(a[2]) for a in seen] == [3, 2]  # one job for each enzyme added, over all candidates


def test_declared_features(spark):
    rows = [(1, 10.0, None, 5.0, 99.0, 98.0), (2, None, 0.5, 7.0, 97.0, 96.5), (3, 30.0, float("nan"), None, 96.0, 95.0), (4, 1000.0, 0.2, 1.0, None, 1.0), (5, -4.0, 3.0, None, 95.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, ref double, raw double")
    declared = FeatureSet((Feature("a_log", "a", low=0.0, log1p=True), Feature("b", "b", fill="c", high=1.0), Feature("c", "c", fill=2.0), Feature("b_then_a", "b", fill="a_log")), "raw", "ref").learn(df)
    assert [f.median for f in declared.features] == [20.0, 0.5, None, 0.5]  # of rows 1 to 3
    got = {r["id"]: r for r in declared.training(df, ["id"]).collect()}
    assert sorted(got) == [1, 2, 3] and [got[i]["y"] for i in (1, 2, 3)] == [1.0, 0.5, 1.0]
    assert got[1]["a_log"] == pytest.approx(math.log(11)) and got[2]["a_log"] == pytest.approx(math.log(21))
    assert (got[1]["b"], got[2]["b"], got[3]["b"]) == (1.0, 0.5, 0.5) and got[3]["c"] == 2.0
    assert got[1]["b_then_a"] == got[1]["a_log"]
    scored = {r["id"]: r for r in declared.scoring(df, ["id"]).collect()}
    assert len(scored) == 5 and scored[5]["a_log"] == 0.0 and all(scored[i]["a_log"] == got[i]["a_log"] for i in got)


def workbook(cells, shared=(), more=""):
    """A workbook of one sheet 'data' (and an empty one) from {row: {reference: (type, value)}}."""
    rows = "".join(f'<row r="{r}">' + "".join(f'<c r="{ref}" t="{t}">' + (f"<is><t>{v}</t></is>" if t == "inlineStr" else f"<v>{v}</v>") + "</c>" for ref, (t, v) in cs.items()) + "</row>" for r, cs in cells.items())
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="notes" sheetId="1" r:id="rId1"/><sheet name="data" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="t" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="t" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData>{rows}</sheetData>{more}</worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si>{s}</si>" for s in shared) + "</sst>")
    return out.getvalue()


SHARED = ("<t>Sample </t>", "<r><t>spe</t></r><r><t>cies</t></r>", "<t>E. coli</t>")


def test_workbooks_with_late_headers_and_merged_cells(spark, tmp_path):
    cells = {
        1: {"B1": ("inlineStr", "A title")},
        3: {"B3": ("s", 0), "C3": ("n", 12), "D3": ("s", 1)},
        4: {"B4": ("inlineStr", "s1"), "D4": ("s", 2)},
        5: {"B5": ("str", "s2"), "C5": ("n", 3.25)},  # D4:D5 are merged
        7: {"B7": ("inlineStr", " "), "D7": ("e", "#REF!")},  # nothing in it
        8: {"AA8": ("b", 1)},
    }
    (tmp_path / "one.xlsx").write_bytes(workbook(cells, SHARED, '<mergeCells count="1"><mergeCell ref="D4:D5"/></mergeCells>'))
    (tmp_path / "two.xlsx").write_bytes(workbook({2: {"A2": ("inlineStr", "other")}}))
    got = sheets.read_sheets(spark, str(tmp_path / "*.xlsx"), ["species", "Sample"])
    assert got.columns == ["file", "sheet", "row", "species", "Sample"]
    rows = sorted((r["file"].rsplit("/", 1)[1], *tuple(r)[1:]) for r in got.collect())
    assert rows == [("one.xlsx", "data", 4, "E. coli", "s1"), ("one.xlsx", "data", 5, None, "s2"), ("one.xlsx", "data", 8, None, None)]
    assert sheets.read_sheets(spark, str(tmp_path / "one.xlsx"), ["Sample"], "notes").count() == 0
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    with pytest.raises(Exception, match="bad.xlsx is no workbook"):
        sheets.read_sheets(spark, str(tmp_path / "bad.xlsx"), ["a"]).collect()


def test_column_numbers():
    assert [sheets.column_number(x) for x in ("A1", "Z9", "AA7", "BC12")] == [0, 25, 26, 54]
