"""The driver's contract, and every query with SQL against DuckDB on the smallest tables."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from tests.conftest import ROOT

sys.path.insert(0, ROOT)
from colloquy.plans import registry

CORE, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    df = CORE[name](spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(SQL[name])
    at = [x[0] for x in cur.description]
    assert sorted(at) == cols
    theirs = sorted(repr([plain(r[at.index(c)]) for c in cols]) for r in cur.fetchall())
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == theirs


def test_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns[:2] == ["rec_id", "n_speech"] and df.count() > 0


def test_rest_imports_without_llm():
    code = "import sys; sys.modules['colloquy.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith(('p3_', 'p8_')) for n in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0
