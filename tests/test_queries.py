"""Every query with SQL gives the rows of its SQL on the small tables."""

import hashlib
import os

import duckdb
import pytest

from tagloom.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def cells(frame, columns):
    out = []
    for row in frame[columns].astype(object).itertuples(index=False, name=None):
        out.append(tuple(None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, db, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), db.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got, sorted(got.columns)) == cells(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_components_of_all_lines(spark, db):
    edges = db.sql("SELECT DISTINCT l_partkey, -1 - l_suppkey FROM lineitem").fetchall()
    least = {n: n for e in edges for n in e}
    while True:
        before = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    got = catalog.QUERIES["connected_components_whole"](spark, DATA).collect()
    assert {r["node"]: r["component"] for r in got} == least and len(got) == len(least)
    assert db.sql("SELECT count(DISTINCT l_partkey) + count(DISTINCT l_suppkey) FROM lineitem").fetchall() == [(len(got),)]


def test_bases_of_long_texts(spark, tmp_path):
    text = "the quick one " * 9000
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (r,) = catalog.QUERIES["reverse_complement_canonical"](spark, str(tmp_path)).collect()
    s = "".join(c for c in text.translate(str.maketrans("etaoinshrdlucmfwypvbgkjqxz", "ACGTACGTACGTACGTACGTACGTAC")) if c in "ACGT")
    canonical = min(s, s[::-1].translate(str.maketrans("ACGT", "TGCA")))
    assert len(text) > 100_000 and (r["n"], r["canonical_md5"]) == (len(s), hashlib.md5(canonical.encode()).hexdigest())


def test_first_fit_batches(spark, db):
    got = {}
    for r in catalog.QUERIES["first_fit_batches"](spark, DATA).collect():
        got.setdefault(r["c_nationkey"], []).append((r["c_custkey"], r["size"], r["batch"]))
    sizes = {}
    for nation, customer, n in db.sql("SELECT c_nationkey, c_custkey, count(*) FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2").fetchall():
        sizes.setdefault(nation, []).append((customer, n))
    for nation, items in sizes.items():
        want, room = [], []
        for customer, n in sorted(items, key=lambda x: (-x[1], x[0])):
            at = next((i for i, r in enumerate(room) if n <= r), len(room))
            room += [50] if at == len(room) else []
            room[at] -= n
            want.append((customer, n, at))
        assert sorted(got[nation]) == sorted(want)


def test_two_axis_clusters(spark, db):
    got = {}
    for r in catalog.QUERIES["two_axis_clusters"](spark, DATA).collect():
        got.setdefault(r["l_suppkey"], []).append(tuple(r)[1:])
    rows = {}
    for key, *block in db.sql("SELECT l_suppkey, l_orderkey, l_orderkey + CAST(l_quantity AS BIGINT), CAST(floor(l_extendedprice) AS BIGINT), CAST(floor(l_extendedprice + l_quantity) AS BIGINT) FROM lineitem").fetchall():
        rows.setdefault(key, []).append(tuple(block))
    for key, blocks in rows.items():
        want = []
        for r0, r1, q0, q1 in sorted(blocks):
            if want and r0 - want[-1][1] <= 50 and q0 - want[-1][3] <= 50:
                a, b, c, e, n = want[-1]
                want[-1] = (a, max(b, r1), min(c, q0), max(e, q1), n + 1)
            else:
                want.append((r0, r1, q0, q1, 1))
        assert sorted(got[key]) == sorted(want)
