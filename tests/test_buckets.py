"""The bucketed table: commits against plain dictionaries, what they read and write, and what a failed one leaves."""

import random
from pathlib import Path

import pytest
from pyspark.sql import types as T

from quire.operators import library as B
from quire.sources import buckets as K
from quire.sources.buckets import BucketedTable, CommitConflict

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.StringType()), T.StructField("n", T.IntegerType())])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, made):
    return spark.createDataFrame(made, SCHEMA)


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_size for p in Path(folder).rglob("*.parquet")}


def test_upserts_and_updates_are_those_of_a_dictionary(spark, tmp_path):
    table, plain, rng = BucketedTable(spark, str(tmp_path / "t"), "id", SCHEMA, 8, 3), {}, random.Random(1)
    assert table.rows().count() == 0 and table.version() == 0
    for turn in range(9):
        keys = rng.sample(range(40), 6) + ([None] if turn % 4 == 0 else [])
        if turn % 3 == 2:
            table.update(frame(spark, [(k, None, turn) for k in keys]), ["n"])
            plain |= {k: (k, plain[k][1], turn) for k in keys if k in plain}
        else:
            table.upsert(frame(spark, [(k, f"{turn}", None) for k in keys]))
            plain |= {k: (k, f"{turn}", None) for k in keys}
        assert rows(table.rows()) == sorted(plain.values(), key=repr)
    assert table.version() == 9 and max(map(len, table._manifest()["parts"].values())) <= 3
    again = BucketedTable(spark, str(tmp_path / "t"), "id", SCHEMA, 99)
    assert again.buckets == 8 and rows(again.rows()) == rows(table.rows())
    table.expire()
    assert rows(table.rows()) == sorted(plain.values(), key=repr) and table.versions() == [8, 9]


def test_same_rows_as_the_joins(spark, tmp_path):
    old, new = frame(spark, [(i, "old", i) for i in range(60)]), frame(spark, [(i, "new", -i) for i in range(50, 70)])
    table = BucketedTable(spark, str(tmp_path / "t"), "id", SCHEMA, 16)
    table.upsert(old)
    table.update(new, ["n"])
    assert rows(table.rows()) == rows(B.partial_update(old, new, ["n"]))
    table.upsert(new)
    assert rows(table.rows()) == rows(B.upsert(old, new))


def test_a_commit_writes_and_a_read_opens_what_it_touches(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), "id", SCHEMA, 32)
    table.upsert(frame(spark, [(i, "x" * 50, i) for i in range(4000)]))
    before = files(tmp_path)
    table.update(frame(spark, [(7, None, 1), (9999, None, 1)]), ["n"])
    written = {k: v for k, v in files(tmp_path).items() if k not in before}
    assert len(written) == 1 and sum(written.values()) < sum(before.values()) / 20
    few = frame(spark, [(7, None, None), (8, None, None)])
    found = table.having(few)
    opened = {p.split("/")[-2] for p in found.inputFiles()}
    assert opened == {f"bucket={b}" for b in table.touched(few)} and len(opened) <= 2
    assert rows(found) == [(7, "x" * 50, 1), (8, "x" * 50, 8)]


def test_previous_views_open_only_hit_buckets(spark, tmp_path):
    kind = "id long, page_number int, relative_offset_y double, scale_value string, scale double, rotation int, split_mode string, sync_enabled boolean"
    library = spark.createDataFrame([(i, i, 0.5, "page-fit", 2.0, 90, "single", False) for i in range(300)], kind)
    table = BucketedTable(spark, str(tmp_path / "t"), "id", library.schema, 32)
    table.upsert(library)
    opened = spark.createDataFrame([(5, 10), (1000, 10)], "id long, page_count int")
    found = B.with_previous(opened, table.having(opened))
    assert rows(found) == rows(B.with_previous(opened, library))
    scanned = {p for p in found.inputFiles() if str(tmp_path) in p}
    assert 0 < len(scanned) <= 2 < len(files(tmp_path))


def test_a_failed_commit_leaves_the_version_before(spark, tmp_path, monkeypatch):
    table = BucketedTable(spark, str(tmp_path / "t"), "id", SCHEMA, 4)
    table.upsert(frame(spark, [(1, "a", 1)]))
    held = table.rows()
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|zero"):
        table.upsert(frame(spark, [(1, "b", 0)]).selectExpr("id", "x", "cast(1 / n as int) as n"))
    monkeypatch.setattr(BucketedTable, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.upsert(frame(spark, [(1, "b", 2)]))
    monkeypatch.undo()
    assert table.version() == 1 and rows(table.rows()) == rows(held) == [(1, "a", 1)]
    table.upsert(frame(spark, [(1, "c", 3)]))
    table.expire(1)
    assert rows(table.rows()) == [(1, "c", 3)] and rows(table.rows(version=2)) == [(1, "c", 3)]


def test_of_two_commits_of_one_version_one_wins(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), "id", SCHEMA, 4)
    table.upsert(frame(spark, [(1, "a", 1)]))
    other = BucketedTable(spark, str(tmp_path / "t"), "id", SCHEMA)
    other.version = lambda: 0  # it began before
    other._manifest = lambda version=None: {"parts": {}, "notes": {}}
    with pytest.raises(CommitConflict):
        other.upsert(frame(spark, [(1, "b", 2)]))
    assert rows(table.rows()) == [(1, "a", 1)] and K.COMMITS == 8
    assert not [p for p in (tmp_path / "t" / "versions").iterdir() if p.name.startswith("_")]


def test_old_versions_can_be_read(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), "id", SCHEMA, 4)
    first = table.upsert(frame(spark, [(1, "a", 1)]), {"batch": 3})
    table.upsert(frame(spark, [(1, "b", 2), (2, "c", 3)]))
    assert rows(table.rows(version=first)) == [(1, "a", 1)] and table.notes() == {"batch": 3}
