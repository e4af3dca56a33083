"""Every query of the catalogue against its SQL."""

import math
from pathlib import Path

import duckdb
import pytest

from marlstone.plans.catalogue import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canon(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    out = db.execute(ORACLE[name])
    names = [d[0] for d in out.description]
    assert sorted(df.columns) == sorted(names)
    assert canon(df.select(names).collect()) == canon(out.fetchall())
