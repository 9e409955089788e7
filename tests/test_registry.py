"""Every registered query has a name, runs from the driver's tables, and equals its SQL twin."""

from __future__ import annotations

import math
import os
from pathlib import Path

import pytest

from folioscan import catalog

DATA = Path(os.environ.get("FOLIOSCAN_DATA", "/root/testdata/sf0.001"))
ORACLES = catalog.oracle_sql()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return [plain(y) for y in x] if isinstance(x, list) else x


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in DATA.iterdir():
        c.sql(f"create view {t.stem} as select * from '{t}'")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(columns).collect())
    twin = duck.sql(ORACLES[name])
    assert sorted(twin.columns) == columns
    assert got == sorted(repr([plain(v) for v in r]) for r in twin.select(*[f'"{c}"' for c in columns]).fetchall())


def test_oracles_name_queries():
    assert set(ORACLES) <= set(catalog.queries())
