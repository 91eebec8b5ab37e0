"""Every query with SQL gives the rows of its SQL; the others give rows."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from conftest import SMALL
from textloom.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    frame = QUERIES[name](spark, SMALL)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    if name in ORACLES:
        found = tables.execute(ORACLES[name])
        assert got == rows([c[0] for c in found.description], found.fetchall())
    else:
        assert got
