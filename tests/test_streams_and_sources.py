"""Streams against batches, and sources against what was written."""

import json
import random
import sqlite3
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_operators import made_events

from quire.operators.events import coalesce_scrolls, fold_panes, suppress_echoes
from quire.operators.library import recent
from quire.schemas import LIBRARY, PANE_EVENT
from quire.sources.files import browser_files, parse_store, pdf_files, read_store, register_sqlite, write_store
from quire.streaming.states import END, coalesced_frames, debounced_saves, end_stream, fold_stream, late_rows, recent_after, save_views, state_table, states, without_echoes


def write(spark, events, folder):
    spark.createDataFrame([tuple(e.values()) for e in events], PANE_EVENT).coalesce(1).write.mode("append").parquet(str(folder))


def test_stream_ends_in_the_batch_state(spark, tmp_path):
    events, lists = made_events(9, 90), []
    library = spark.createDataFrame([(d, d, "t", 12, datetime(2024, 1, 1), 1, 0.0, "x", 1.0, 0, "single", True, datetime(2024, 1, 1)) for d in ("d0", "other")], LIBRARY)
    now = F.lit("2025-01-01").cast("timestamp")
    for i in range(6):
        write(spark, events[15 * i : 15 * i + 15], tmp_path / "in")
        stream = spark.readStream.schema(PANE_EVENT).parquet(str(tmp_path / "in"))
        refreshed = lambda found, n: lists.append((n, [r["id"] for r in recent_after(library, found, now).collect()]))
        fold_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), 12, buckets=8, commits=2, after=refreshed).awaitTermination()
    whole = {r["doc_id"]: r["state"] for r in fold_panes(spark.createDataFrame([tuple(e.values()) for e in events], PANE_EVENT), F.lit(12)).collect()}
    of = lambda: {r["doc_id"]: r["state"] for r in states(spark, str(tmp_path / "out")).collect()}
    streamed = of()
    assert streamed == whole and [n for n, _ in lists] == list(range(6)) and lists[-1][1] == ["d0", "other"]
    saved = {r["id"]: r for r in save_views(library, states(spark, str(tmp_path / "out")), now).collect()}
    assert saved["d0"]["page_number"] == streamed["d0"]["original"]["page_number"] and saved["d0"]["updated_at"].year == 2025
    assert saved["other"]["page_number"] == 1 and len(saved) == 2
    assert [r["id"] for r in recent_after(library, states(spark, str(tmp_path / "out")), now).collect()] == ["d0", "other"]
    # A batch whose end was lost is run again and changes nothing.
    (tmp_path / "check" / "commits" / "5").unlink()
    (tmp_path / "check" / "commits" / ".5.crc").unlink(missing_ok=True)
    fold_stream(spark.readStream.schema(PANE_EVENT).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), 12).awaitTermination()
    table = state_table(spark, str(tmp_path / "out"))
    assert of() == whole and table.version() == 6 and max(map(len, table._manifest()["parts"].values())) <= 2


def test_a_batch_opens_and_writes_the_buckets_of_its_documents(spark, tmp_path):
    many = [{**e, "doc_id": f"d{n}"} for n in range(200) for e in made_events(n, 2, 1)]
    write(spark, many, tmp_path / "in")
    run = lambda: fold_stream(spark.readStream.schema(PANE_EVENT).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), 12, buckets=32).awaitTermination()
    run()
    files = lambda: {str(p) for p in (tmp_path / "out" / "data").rglob("*.parquet")}
    before, few = files(), [e for e in many if e["doc_id"] in ("d3", "d77")]
    table = state_table(spark, str(tmp_path / "out"))
    batch = spark.createDataFrame([tuple(e.values()) for e in few], PANE_EVENT)
    assert len(table.having(batch).inputFiles()) == len(table.touched(batch)) <= 2 < len(before)
    write(spark, few, tmp_path / "in")
    run()
    assert len(files() - before) == len(table.touched(batch))
    assert {r["doc_id"] for r in states(spark, str(tmp_path / "out")).collect()} == {e["doc_id"] for e in many}


def replay(spark, tmp_path, rows, kind, seed, files, end=True, per=1):
    """A stream of rows in shuffled files, one a batch."""
    rows = random.Random(seed).sample(rows, len(rows)) if seed is not None else rows
    folder = str(tmp_path / f"in{seed}{end}")
    schema = spark.createDataFrame([], kind).schema
    for n in range(files):
        spark.createDataFrame(rows[n::files] if seed is not None else rows[len(rows) * n // files : len(rows) * (n + 1) // files], schema).coalesce(1).write.mode("append").parquet(folder)
    if end:
        end_stream(spark, schema, folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per).parquet(folder)


def run(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query, sorted(map(tuple, stream.sparkSession.table(name).collect()), key=repr)


KIND = "doc_id string, kind string, ts timestamp, event_id int, value double"


def moments(seed, n=160):
    rng, t0 = random.Random(seed), datetime(2024, 1, 1)
    return [(rng.choice(["a", "b", None]), rng.choice(["apply", "page", "page", "scroll", None]), t0 + timedelta(milliseconds=rng.randrange(0, 6000, 5)), i, rng.random()) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_echoes_of_a_shuffled_stream_are_those_of_the_batch(spark, tmp_path, seed):
    rows = moments(seed)
    _, found = run(without_echoes(replay(spark, tmp_path, rows, KIND, seed, 4), "1 minute"), f"echoes{seed}")
    batch = suppress_echoes(spark.createDataFrame(rows, KIND), ["doc_id"], ["ts", "event_id"], F.coalesce(F.col("kind") == "apply", F.lit(False)))
    assert found == sorted(map(tuple, batch.select("doc_id", "kind", "ts", "event_id", "value").collect()), key=repr)
    assert 10 < len(found) < sum(r[1] != "apply" for r in rows)


def test_frames_of_a_shuffled_stream_and_late_rows(spark, tmp_path):
    rows = moments(3)
    query, found = run(coalesced_frames(replay(spark, tmp_path, rows, KIND, 3, 5), "1 minute", "100 milliseconds", "value"), "frames")
    batch = coalesce_scrolls(spark.createDataFrame(rows, KIND), ["doc_id"], "100 milliseconds", "value", ["ts", "event_id"])
    ended = [r for r in found if r[1].year < 9000]
    assert ended == sorted(map(tuple, batch.collect()), key=repr) and late_rows(query) == 0
    # In order of time but for one row, which comes when its frame is long closed.
    ordered = sorted((r for r in rows if r[2].second >= 1), key=lambda r: r[2])
    stray = ("a", "scroll", datetime(2024, 1, 1), 999, 0.5)
    query, late = run(coalesced_frames(replay(spark, tmp_path, [*ordered, stray], KIND, None, 4), "1 second", "100 milliseconds", "value"), "late")
    batch = coalesce_scrolls(spark.createDataFrame(ordered, KIND), ["doc_id"], "100 milliseconds", "value", ["ts", "event_id"])
    assert [r for r in late if r[1].year < 9000] == sorted(map(tuple, batch.collect()), key=repr) and late_rows(query) == 1


@pytest.mark.parametrize("end", [True, False])
def test_debounced_saves_on_a_stream(spark, tmp_path, end):
    at = [0, 100, 1000, 1100, 60_000]
    rows = [("d", "page", datetime(2024, 1, 1) + timedelta(milliseconds=ms), i, 0.0) for i, ms in enumerate(at)]
    _, found = run(debounced_saves(replay(spark, tmp_path, rows, KIND, None, 1, end), "1 second").where(F.col("kind") != END), f"saves{end}")
    assert sorted(r[3] for r in found) == ([1, 3, 4] if end else [1, 3])  # without an end a teardown cancels the last


def test_pdf_files(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"%PDF" + name.encode())
    found = {r["path"].rsplit("/", 1)[-1]: bytes(r["content"]) for r in pdf_files(spark, str(tmp_path)).select("path", "content").collect()}
    assert found == {"a.pdf": b"%PDFa.pdf", "b.PDF": b"%PDFb.PDF"}


def test_browser_store(spark):
    df = spark.createDataFrame([('[{"id":"a","view_state":{"page_number":3}},{"id":"b"}]',), ("oops",), (None,), ("null",)], "text string")
    assert [r[0] for r in df.select(F.size(parse_store(F.col("text")))).collect()] == [2, 0, 0, 0]
    documents = read_store(df, "text")
    assert json.loads(write_store(documents).first()["store"])[0]["view_state"] == {"page_number": 3}
    assert write_store(documents, 1).select(F.size(parse_store(F.col("store")))).first()[0] == 1


def test_sqlite_library(spark, tmp_path):
    path = str(tmp_path / "library.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE documents (id TEXT PRIMARY KEY, page_count INTEGER, scale REAL, sync_enabled INTEGER)")
        db.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [(f"d{i}", i, i / 4, i % 2) for i in range(10)])
    register_sqlite(spark)
    df = spark.read.format("sqlite").schema("id string, page_count bigint, scale double, sync_enabled boolean").option("path", path).option("dbtable", "documents").load()
    assert df.count() == 10 and df.rdd.getNumPartitions() == 4
    assert [tuple(r) for r in df.where("id = 'd3'").collect()] == [("d3", 3, 0.75, True)] and df.count() == 10
    one = spark.read.format("sqlite").schema(df.schema).options(path=path, dbtable="documents", key="id", value="d3").load()
    assert [tuple(r) for r in one.collect()] == [("d3", 3, 0.75, True)]


def test_sqlite_library_with_times(spark, tmp_path):
    """The library's own table, whose times are text."""
    path = str(tmp_path / "whole.db")
    kinds = {"string": "TEXT", "int": "INTEGER", "double": "REAL", "boolean": "INTEGER", "timestamp": "TEXT"}
    columns = ", ".join(f"{f.name} {kinds[f.dataType.simpleString()]} NOT NULL" for f in LIBRARY)
    rows = [("a", "/a.pdf", "A", 3, "2024-01-01T10:20:30.456Z", 2, 0.5, "page-width", 1, 90, "single", 1, "2024-02-01T00:00:00.000Z"), ("b", "/b.pdf", "B", 0, "2023-01-01", 1, 0, "x", 1.5, 0, "stacked", 0, "2024-02-01T01:00:00+01:00")]
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE documents ({columns})")
        db.executemany(f"INSERT INTO documents VALUES ({', '.join('?' * len(rows[0]))})", rows)
    register_sqlite(spark)
    df = spark.read.format("sqlite").schema(LIBRARY).option("path", path).option("dbtable", "documents").load()
    found = {r["id"]: r for r in df.collect()}
    assert (found["a"]["last_opened_at"], found["a"]["updated_at"]) == (datetime(2024, 1, 1, 10, 20, 30, 456_000), datetime(2024, 2, 1))
    assert found["b"]["updated_at"] == datetime(2024, 2, 1) and found["b"]["sync_enabled"] is False and found["a"]["scale"] == 1.0
    assert [r["id"] for r in df.where(F.col("updated_at") == F.lit("2024-02-01").cast("timestamp")).orderBy("id").collect()] == ["a", "b"]
    assert [r["id"] for r in df.where("id = 'b' and page_count = 0").collect()] == ["b"]
    assert [r["id"] for r in recent(df, "last_opened_at", "id").collect()] == ["a", "b"]


def test_browser_files_get_a_path(spark):
    df = spark.createDataFrame([("x.pdf",)], "name string")
    assert browser_files(df, "name").first()["file_path"] == "browser://x.pdf"
