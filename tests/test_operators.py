"""Library and event operators on small tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quire.operators import events as E
from quire.operators import library as B
from quire.schemas import PANE_EVENT

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_recent_is_newest_first_with_ties_by_key(spark):
    df = spark.createDataFrame([(i, T0 + timedelta(minutes=i // 2)) for i in range(45)], "id long, ts timestamp")
    found = [r["id"] for r in B.recent(df, "ts", "id").collect()]
    assert found == sorted(range(45), key=lambda i: (-(i // 2), i))[:20]


def test_search_is_literal_and_blank_keeps_all(spark):
    df = spark.createDataFrame([("50% off", "a"), ("Title", "path.pdf"), ("x_y", "b")], "title string, file_path string")
    assert B.search(df, " \t").count() == 3
    assert [r[0] for r in B.search(df, "%").collect()] == ["50% off"]
    assert [r[0] for r in B.search(df, "TITLE path").collect()] == ["Title"]
    assert B.recent_summary(df, " nothing ").first() == (3, 0, "일치하는 논문이 없습니다.")


def test_upsert_and_partial_update(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "id long, x string, y int")
    new = spark.createDataFrame([(2, None, 7), (3, "c", None)], "id long, x string, y int")
    assert rows(B.upsert(old, new)) == [(1, "a", None), (2, None, 7), (3, "c", None)]
    assert rows(B.partial_update(old, new, ["y"])) == [(1, "a", None), (2, "b", 7)]
    assert rows(B.upsert(old.where("false"), new)) == rows(new)


def test_browser_list(spark):
    store = spark.createDataFrame([(i, i) for i in range(25)], "id long, position long")
    moved = B.renumber(B.move_to_front(store, store.where("id = 24").drop("position")))
    assert [tuple(r) for r in moved.orderBy("position").collect()] == [(24, 0), *((i, i + 1) for i in range(19))]


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 0, 3), (None, 5, 4)], "k string, ts int, event_id int")
    assert rows(B.latest_per_key(df, "k", ["ts", "event_id"])) == [("a", 1, 2), ("b", 0, 3), (None, 5, 4)]


def test_restore_normalizes_but_carries_over_raw(spark):
    library = spark.createDataFrame([(1, 99, 0.5, "page-fit", 9.0, 100, "single", False)], "id long, page_number int, relative_offset_y double, scale_value string, scale double, rotation int, split_mode string, sync_enabled boolean")
    opened = B.with_previous(spark.createDataFrame([(1, 10), (2, 10)], "id long, page_count int"), library)
    assert rows(opened.select("id", "page_number", "scale", "split_mode")) == [(1, 99, 9.0, "single"), (2, 1, 1.0, "side-by-side")]
    assert rows(B.restore(opened).select("id", "original.page_number", "original.scale", "companion.rotation")) == [(1, 10, 4.0, 90), (2, 1, 1.0, 0)]


def test_nest_and_flatten(spark):
    flat = spark.createDataFrame([("i", "p", "t", 3, T0, 2, 0.5, "page-fit", 1.5, 90, "single", 1)], "id string, file_path string, title string, page_count int, last_opened_at timestamp, page_number int, relative_offset_y double, scale_value string, scale double, rotation int, split_mode string, sync_enabled int")
    assert rows(B.flatten(B.nest(flat))) == rows(flat)


@pytest.mark.parametrize(("gap_ms", "saved"), [(449, 1), (450, 2), (451, 2)])
def test_debounce(spark, gap_ms, saved):
    df = spark.createDataFrame([("d", T0, 1), ("d", T0 + timedelta(milliseconds=gap_ms), 2)], "doc_id string, ts timestamp, event_id int")
    assert E.debounce(df, ["doc_id"], ["ts", "event_id"]).count() == saved
    assert E.debounce(df, ["doc_id"], ["ts", "event_id"], flush_at_end=False).count() == saved - 1


def test_echoes_are_dropped_until_eighty_ms(spark):
    at = [("apply", 0), ("page", 79), ("page", 80), ("page", 81), ("apply", 100), ("page", 150), ("page", 200)]
    df = spark.createDataFrame([("d", k, T0 + timedelta(milliseconds=ms), i) for i, (k, ms) in enumerate(at)], "doc_id string, kind string, ts timestamp, event_id int")
    left = E.suppress_echoes(df, ["doc_id"], ["ts", "event_id"], F.col("kind") == "apply")
    assert sorted(r["event_id"] for r in left.collect()) == [3, 6]


DEFAULT = {"page_number": 1, "relative_offset_y": 0.0, "scale_value": "page-width", "scale": 1.0, "rotation": 0}


def plain_fold(events, pages):
    """The fold, one event after the other."""
    half_up = lambda x: int((x + 0.5) // 1)
    clamp = lambda v, a, b: min(max(v, a), b)
    text = lambda v: str(int(v)) if v == int(v) else str(v)
    panes, sync, active, split, applied = {"original": dict(DEFAULT), "companion": dict(DEFAULT)}, True, "original", "side-by-side", None
    for e in sorted(events, key=lambda e: (e["ts"], e["event_id"])):
        kind, update = e["kind"], {}
        if kind == "toggle_sync":
            if not sync:
                panes = {p: dict(panes[active]) for p in panes}
            sync = not sync
            continue
        if kind == "activate":
            active = e["pane_id"]
            continue
        if kind == "split":
            split = e["scale_value"]
            active = "original" if split == "single" else active
            continue
        if kind == "apply":
            applied = e["ts"]
            continue
        tool = kind in ("goto", "zoom_in", "zoom_out", "fit", "rotate")
        pane = active if tool else e["pane_id"]
        if not tool and applied is not None and e["ts"] - applied <= timedelta(milliseconds=80):
            continue
        now = panes[pane]
        if kind in ("page", "scroll", "goto"):
            update["page_number"] = e["page_number"]
        if kind == "goto":
            update["relative_offset_y"] = 0.0
        if kind == "scroll":
            update["relative_offset_y"] = e["relative_offset_y"]
        if kind in ("zoom_in", "zoom_out"):
            update["scale"] = clamp(now["scale"] * (1.1 if kind == "zoom_in" else 1 / 1.1), 0.25, 4.0)
            update["scale_value"] = text(update["scale"])
        if kind == "scale":
            update["scale"], update["scale_value"] = e["scale"], e["scale_value"] or text(e["scale"])
        if kind == "fit":
            update["scale_value"] = e["scale_value"]
        if kind == "rotate":
            update["rotation"] = now["rotation"] + 90
        if kind == "rotation":
            update["rotation"] = e["rotation"]
        new = now | {k: v for k, v in update.items() if v is not None}
        new["page_number"] = half_up(clamp(new["page_number"], 1, max(pages, 1)))
        new["relative_offset_y"] = clamp(new["relative_offset_y"], 0, 1)
        new["scale"] = clamp(new["scale"], 0.25, 4.0)
        new["rotation"] = half_up(new["rotation"] / 90) * 90 % 360
        for p in panes if sync else [pane]:
            panes[p] = dict(new)
    return panes, sync, active, split


def made_events(seed, n=60, docs=4):
    rng, out = random.Random(seed), []
    kinds = ["page", "scale", "rotation", "scroll", "goto", "zoom_in", "zoom_out", "fit", "rotate", "toggle_sync", "activate", "split", "apply"]
    for i in range(n):
        kind = rng.choice(kinds)
        e = dict.fromkeys(PANE_EVENT.fieldNames())
        e |= {"event_id": i, "ts": T0 + timedelta(milliseconds=30 * i), "doc_id": f"d{rng.randrange(docs)}", "pane_id": rng.choice(["original", "companion"]), "kind": kind}
        if kind in ("page", "scroll", "goto"):
            e["page_number"] = rng.choice([-3.0, 2.5, 7.0, 99.0])
        if kind == "scroll":
            e["relative_offset_y"] = rng.choice([-1.0, 0.25, 2.0, None])
        if kind == "scale":
            e["scale"], e["scale_value"] = rng.choice([0.1, 1.5, 9.0]), rng.choice(["page-fit", "", None])
        if kind == "rotation":
            e["rotation"] = rng.choice([-45.0, 44.0, 450.0])
        if kind in ("fit", "split"):
            e["scale_value"] = rng.choice(["page-fit", "page-width"]) if kind == "fit" else rng.choice(["single", "stacked"])
        out.append(e)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_is_the_sequential_one(spark, seed):
    events = made_events(seed)
    df = spark.createDataFrame([tuple(e.values()) for e in events], PANE_EVENT)
    for row in E.fold_panes(df, F.lit(12)).collect():
        panes, sync, active, split = plain_fold([e for e in events if e["doc_id"] == row["doc_id"]], 12)
        s = row["state"].asDict(True)
        assert (s["original"], s["companion"], s["sync"], s["active"], s["split"]) == (panes["original"], panes["companion"], sync, active, split)


@pytest.mark.parametrize("most", [1, 7, 16])
def test_fold_of_long_keys_goes_by_ranges(spark, most):
    events = made_events(5, 48, 1) + [{**e, "doc_id": None, "event_id": 100 + n} for n, e in enumerate(made_events(6, 20, 1))] + [{**e, "doc_id": "few"} for e in made_events(7, 1, 1)]
    df = spark.createDataFrame([tuple(e.values()) for e in events], PANE_EVENT).repartition(3)
    folded = E.fold_panes(df, F.when(F.col("event_id") == 47, 12).otherwise(3), most=most).collect()
    assert rows(E.fold_panes(df, F.when(F.col("event_id") == 47, 12).otherwise(3))) == sorted(map(tuple, folded), key=repr)
    assert sorted(r["doc_id"] or "" for r in folded) == ["", "d0", "few"]
    for row in folded:
        panes, sync, active, split = plain_fold([e for e in events if e["doc_id"] == row["doc_id"]], 12 if row["doc_id"] == "d0" else 3)
        s = row["state"].asDict(True)
        assert (s["original"], s["companion"], s["sync"], s["active"], s["split"]) == (panes["original"], panes["companion"], sync, active, split)


def test_fold_goes_on_from_states_and_takes_as_many_jobs_for_any_ranges(spark):
    events = made_events(11, 120, 3)
    frame = lambda some: spark.createDataFrame([tuple(e.values()) for e in some], PANE_EVENT)
    whole = {r["doc_id"]: r["state"] for r in E.fold_panes(frame(events), F.lit(12)).collect()}
    half = spark.createDataFrame(E.fold_panes(frame(events[:50]), F.lit(12)).collect(), f"doc_id string, state {E.STATE}")
    jobs = []
    for most in (1, 5):
        spark.sparkContext.setJobGroup(f"fold{most}", "")
        found = {r["doc_id"]: r["state"] for r in E.fold_panes(frame(events[50:]), F.lit(12), before=half, most=most).collect()}
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fold{most}")))
        assert found == whole
    spark.sparkContext.setJobGroup("tests", "")
    assert abs(jobs[0] - jobs[1]) <= 2, jobs  # 70 ranges and 14


def test_fold_from_panes_that_differ_in_sync(spark):
    """A start that no fold leaves: in sync, but with different views. The first event's pane becomes both."""
    view = lambda page: (page, 0.5, "page-fit", 2.0, 90)
    start = spark.createDataFrame([("a", (view(3), view(7), True, "companion", "stacked", None)), ("b", (view(3), view(7), True, "companion", "stacked", None))], f"doc_id string, state {E.STATE}")
    event = dict.fromkeys(PANE_EVENT.fieldNames()) | {"event_id": 1, "ts": T0, "pane_id": "original"}
    made = [event | {"doc_id": "a", "kind": "rotate"}, event | {"doc_id": "b", "kind": "scroll", "relative_offset_y": 0.25}]
    df = spark.createDataFrame([tuple(e.values()) for e in made], PANE_EVENT)
    found = {r["doc_id"]: r["state"] for r in E.fold_panes(df, F.lit(12), before=start).collect()}
    assert (found["a"]["original"]["page_number"], found["a"]["companion"]["page_number"], found["a"]["original"]["rotation"]) == (7, 7, 180)
    assert (found["b"]["original"]["page_number"], found["b"]["companion"]["relative_offset_y"]) == (3, 0.25)


def test_zooms_of_long_keys_go_by_ranges(spark):
    rng, made = random.Random(9), []
    for key, n, up in (("up", 300, 0.6), ("even", 500, 0.5), (None, 90, 0.4), ("swing", 40, None), ("one", 1, 1)):
        made += [(key, T0 + timedelta(seconds=i // 3), i, (i % 2 == 0) if up is None else rng.random() < up) for i in range(n)]
    expected = {}
    for key, _, _, zoom_in in made:
        expected[key] = min(max(expected.get(key, 1.0) * (1.1 if zoom_in else 1 / 1.1), 0.25), 4.0)
    df = spark.createDataFrame(random.Random(1).sample(made, len(made)), "k string, ts timestamp, event_id int, up boolean").repartition(3)
    for most in (1, 7, 64, 10_000):
        found = {r["k"]: r["scale"] for r in E.zooms(df, "k", ["ts", "event_id"], F.col("up"), most).collect()}
        assert found == (expected if most == 10_000 else pytest.approx(expected, rel=1e-12))


def test_ranges_are_full_and_in_order(spark):
    made = [("hot" if i % 3 else None, T0 + timedelta(seconds=i // 4), i) for i in range(400)]
    cut = E.in_ranges(spark.createDataFrame(made, "k string, ts timestamp, event_id int").repartition(5), "k", ["ts", "event_id"], 30).collect()
    for key in ("hot", None):
        places = [r["_range"] for r in sorted((r for r in cut if r["k"] == key), key=lambda r: (r["ts"], r["event_id"]))]
        assert places == [n // 30 for n in range(len(places))]


def test_fold_without_pages_changes_nothing(spark):
    df = spark.createDataFrame([tuple(e.values()) for e in made_events(4) if e["kind"] in ("page", "goto", "rotate")], PANE_EVENT)
    assert {r["state"]["original"]["page_number"] for r in E.fold_panes(df, F.lit(0)).collect()} == {1}


def test_fan_out(spark):
    df = spark.createDataFrame([(1, "original", True), (2, "companion", False)], "event_id int, pane_id string, sync boolean")
    assert rows(E.fan_out(df, F.col("sync")).select("event_id", "target")) == [(1, "companion"), (1, "original"), (2, "companion")]


def test_windows_over_ranges_of_a_hot_key(spark):
    """Ranges of a few events give what whole windows give; nulls in the key, in fields and ties included."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", None]), T0 + timedelta(seconds=rng.randrange(300)), rng.choice([None, 1.0, 2.0]), rng.choice(["x", "y", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id int, doc_id string, ts timestamp, scale double, kind string").repartition(5)
    order = ["ts", "event_id"]
    calls = [
        lambda most: E.fold_absolute(df, ["doc_id"], ["scale", "kind"], order, most=most),
        lambda most: E.suppress_echoes(df, ["doc_id"], order, F.coalesce(F.col("kind") == "x", F.lit(False)), 3_000_000, most=most),
        lambda most: E.debounce(df, ["doc_id"], order, 4_000_000, most=most),
        lambda most: E.on_change(df, ["doc_id"], order, ["scale", "kind"], most=most),
    ]
    for call in calls:
        whole = call(None)
        assert rows_of(call(7), whole.columns) == rows_of(whole, whole.columns) and call(7).columns == whole.columns
    before = {}
    for i, d, t, _, k in sorted(rows, key=lambda r: (r[2], r[0])):
        before.setdefault(d, []).append((i, t, k))
    changed = {e[n][0] for e in before.values() for n in range(len(e)) if n == 0 or e[n][2] != e[n - 1][2]}
    assert {r["event_id"] for r in E.on_change(df, ["doc_id"], order, ["kind"], most=7).collect()} == changed


def rows_of(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
