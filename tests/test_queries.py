"""Every query with SQL gives the same rows as the SQL on the small tables; the others run."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CORE = {k: f for m in entry._modules() if ".llm." not in m.__name__ for k, f in m.QUERIES.items()}
SQL = entry.oracle_sql()


def norm(v):
    if v is None or isinstance(v, float) and v != v:
        return "N"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return str(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    df = CORE[name](spark, DATA)
    rows = df.collect()
    if name not in SQL:
        return
    r = duck.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(r.columns)
    a = sorted(tuple(norm(x[c]) for c in cols) for x in rows)
    at = [r.columns.index(c) for c in cols]
    assert a == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "rrf"]
