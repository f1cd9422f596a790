"""Every registered query against its SQL on the smallest data."""

import math

import pytest

from pageloom.plans.queries import ORACLE_SQL, QUERIES


def plain(v):
    if v is None:
        return ("",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return ("",) if isinstance(v, float) and math.isnan(v) else ("n", round(float(v), 5) + 0.0)
    return ("s", str(v))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    cursor = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0
