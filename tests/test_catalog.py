"""Each query that has SQL gives the rows of its SQL."""

import math

import duckdb
import pytest

from kilnlog.plans import catalog
from tests.conftest import SMALL

TABLES = "events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SMALL)
    rows = df.collect()
    assert rows or name == "stream_prompt"
    if name in catalog.oracle_sql():
        cursor = duck.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()), key=repr)
        assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in rows), key=repr) == want
