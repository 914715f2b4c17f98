"""Every registered query of the library runs; those with SQL give what it gives."""

import os

import pytest

from fieldlens.plans import catalog

DATA = os.environ.get("FIELDLENS_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    return v if v is None or isinstance(v, (str, bool)) else round(float(v), 6)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    rows = df.collect()
    assert rows
    if name in catalog.oracle_sql():
        out = duck.execute(catalog.oracle_sql()[name])
        names = [c[0] for c in out.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(names)
        want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in out.fetchall()), key=str)
        assert sorted((tuple(plain(r[c]) for c in order) for r in rows), key=str) == want


def test_entry_without_llm(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
