"""Every query against its SQL on the driver's smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from chronolore import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    rows = got.collect()
    assert len({c.lower() for c in got.columns}) == len(got.columns)
    if name not in registry.ORACLE_SQL:
        return
    cursor = db.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    assert sorted(columns) == sorted(got.columns)
    order = [columns.index(c) for c in got.columns]
    assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(plain(w[i]) for i in order) for w in want)
