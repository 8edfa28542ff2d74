"""Every query of the library against its SQL, with column names, at the smallest size."""

import math
from pathlib import Path

import duckdb
import pytest

from quire.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "events pages documents labels".split()
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test data here")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return f"{value:.9g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_is_its_sql(spark, sql, name):
    found = registry.QUERIES[name](spark, DATA)
    wanted = sql.execute(registry.ORACLES[name])
    columns = sorted(c[0] for c in wanted.description)
    assert sorted(found.columns) == columns
    order = [[c[0] for c in wanted.description].index(c) for c in columns]
    expected = sorted(tuple(plain(r[i]) for i in order) for r in wanted.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in found.select(*columns).collect()) == expected


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_plans_prune_and_push(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_id), EqualTo(event_id,7)]" in plan(registry.QUERIES["point_lookup"](spark, DATA))
    assert "TakeOrderedAndProject" in plan(registry.QUERIES["recent_topk"](spark, DATA))
    assert "html" not in plan(registry.QUERIES["document_id"](spark, DATA))
