"""Every registered query of the library that has a DuckDB twin agrees with it, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from octetlake.plans import catalog, formats  # noqa: F401 formats registers its queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, bytes | bytearray):
        return bytes(v).hex()
    return str([norm(x) for x in v]) if isinstance(v, list | tuple) else str(v)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p}{'/*' if os.path.isdir(p) else ''}')")
    return c


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_twin(name, spark, sf_dir, con):
    got = catalog.QUERIES[name](spark, sf_dir).toArrow()
    cols = sorted(got.column_names)
    cur = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    assert sorted(tuple(norm(r[c]) for c in cols) for r in got.to_pylist()) == sorted(tuple(norm(r[c]) for c in cols) for r in want)


def test_every_twin_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
