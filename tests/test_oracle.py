"""Every registered query of the library proper against its SQL, at the smallest scale."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from lanternlake import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return str(v)
    return v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    rows = Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    text = catalogue.oracle_sql().get(name)
    if text is None:
        assert sum(rows.values()) > 0
        return
    found = db.execute(text)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    assert rows == want
