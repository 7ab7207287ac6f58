"""Every query against its SQL equivalent."""

import glob
import os

import duckdb
import pytest

from wardline.plans.catalog import QUERIES
from wardline.plans.oracles import ORACLES

from conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _canonical(table):
    table = table.select(sorted(table.column_names))
    types = [(f.name, str(f.type).replace("large_", "")) for f in table.schema]
    rows = sorted(zip(*[c.to_pylist() for c in table.columns]), key=lambda r: [(v is None, str(v)) for v in r])
    return types, rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    types, rows = _canonical(QUERIES[name](spark, SF).toArrow())
    assert rows
    if name in ORACLES:
        expected_types, expected = _canonical(duck.execute(ORACLES[name]).to_arrow_table())
        assert types == expected_types
        assert rows == expected
