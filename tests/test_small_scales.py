"""Folds of scales that are printed differently by Java and by SQL."""

import duckdb
import pytest

from quire.plans import registry


@pytest.mark.parametrize("name", ["pane_fold", "pane_fold_stream"])
def test_small_scales_are_texts_as_in_sql(spark, tmp_path, name):
    values = ", ".join(f"({e}, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL {e} HOUR, {u}, 'purchase', {v}, '{{\"k\": 1}}')" for e, u, v in ((1, 2, 0.01), (4, 2, 0.02), (7, 13, 0.04), (10, 13, 500.5), (13, 24, 0.05)))
    found = duckdb.connect()
    found.execute(f"CREATE TABLE events AS SELECT e::BIGINT AS event_id, t AS ts, u::BIGINT AS user_id, k AS event_type, v::DOUBLE AS value, p AS props FROM (VALUES {values}) x(e, t, u, k, v, p)")
    found.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    cursor = found.execute(f"SELECT doc_id, original_scale_value, companion_scale_value FROM ({registry.ORACLES[name]}) ORDER BY doc_id")
    rows = registry.QUERIES[name](spark, str(tmp_path)).select("doc_id", "original_scale_value", "companion_scale_value").orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == cursor.fetchall() == [("13", "10.01", "10.01"), ("2", "0.0004", "0.0004"), ("24", "0.001", "0.001")]
