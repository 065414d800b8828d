"""Every registered query beside its SQL, over the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from millrace.plans import increments, registry, reports  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return db


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return str(value).removesuffix(" 00:00:00") if hasattr(value, "year") else value


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_its_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, SF)
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = sorted(found.columns)
    told = [d[0] for d in cursor.description]
    assert sorted(told) == names
    want = Counter(tuple(plain(r[told.index(c)]) for c in names) for r in cursor.fetchall())
    assert Counter(tuple(plain(r[c]) for c in names) for r in found.collect()) == want
