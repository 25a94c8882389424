"""Each query against its SQL on the smallest test tables."""

import os

import pytest

from curatrix.queries import ORACLE, QUERIES, flagship

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    got = _sorted(tuple(r[c] for c in columns) for r in df.collect())
    if name in ORACLE:
        found = sql.execute(ORACLE[name])
        names = [d[0] for d in found.description]
        types = {d[0]: str(d[1]) for d in found.description}
        assert sorted(names) == columns and {c: TYPES[t] for c, t in df.dtypes} == types
        at = [names.index(c) for c in columns]
        want = _sorted(tuple(r[i] for i in at) for r in found.fetchall())
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert all(x == (pytest.approx(y, rel=1e-9, abs=1e-9) if isinstance(x, float) and y is not None else y) for x, y in zip(a, b, strict=True)), (a, b)


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0


def test_package_is_shipped_where_it_is_not_on_the_path(spark, monkeypatch):
    from curatrix import session

    monkeypatch.setenv("PYTHONPATH", "")
    session.ship(spark)
    assert any("curatrix_package" in p for p in spark.sparkContext._python_includes)
    session.ship(spark)
    assert sum("curatrix_package" in p for p in spark.sparkContext._python_includes) == 1
