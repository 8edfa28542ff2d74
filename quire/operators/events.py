"""View events as batches: folds, fan-out, suppression of echoes, debounce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.labels import number_text, preset_or_number
from quire.functions.normalize import normalize_offset, normalize_page, normalize_rotation, normalize_scale, scale_by
from quire.scratch import forget, keep
from quire.schemas import DEBOUNCE_MS, DEFAULT_SPLIT, DEFAULT_SYNC, DEFAULT_VIEW, ECHO_MS, LEAST_SCALE, MOST_SCALE

PANE_KINDS = ("page", "scale", "rotation", "scroll")
TOOLBAR_KINDS = ("goto", "zoom_in", "zoom_out", "fit", "rotate")
_EVENT = ("ts", "event_id", "pane_id", "kind", "page_number", "relative_offset_y", "scale_value", "scale", "rotation")
_ORDER = ["ts", "event_id"]
VIEWS = ("original", "companion")
#: Events of a key that one window sorts, and zoom steps that meet in one array, at most.
RANGE = 100_000
STATE = "struct<original:{v},companion:{v},sync:boolean,active:string,split:string,applied:timestamp>".format(v="struct<page_number:int,relative_offset_y:double,scale_value:string,scale:double,rotation:int>")


def initial_state() -> Column:
    view = F.struct(*(F.lit(v).alias(k) for k, v in DEFAULT_VIEW.items()))
    return F.struct(
        view.alias("original"), view.alias("companion"), F.lit(DEFAULT_SYNC).alias("sync"), F.lit("original").alias("active"),
        F.lit(DEFAULT_SPLIT).alias("split"), F.lit(None).cast("timestamp").alias("applied"),
    ).cast(STATE)


def in_ranges(events: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """Add _range, from 0, which cuts each key's events in order into ranges of most events each, the last one may have fewer.

    A key's events need not meet in a task: all are sorted by range partitioning, numbered within their partition, and the partitions' counts,
    summed up in order, are added. Where no key has more than most, all events are in range 0 as they are.
    """
    if not events.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).take(1):
        return events.withColumn("_range", F.lit(0).cast("long"))
    cut = keep(events.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "cut")
    counts = cut.groupBy(F.col(key).alias("_cut_key"), F.col("_part").alias("_at")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_cut_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_cut_key", "_at", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1
    placed = cut.join(offsets, F.col(key).eqNullSafe(F.col("_cut_key")) & (F.col("_part") == F.col("_at"))).withColumn("_range", F.floor(place / most))
    ranged = keep(placed.drop("_cut_key", "_at", "_part", "_before").repartitionByRange("_range", key), "ranges")  # so that a reader of one range skips the others
    forget(cut)
    return ranged


def zoomed(scale: Column, steps: Column) -> Column:
    """scale after zoom steps in order, true for in."""
    return F.aggregate(steps, scale, lambda x, zoom_in: scale_by(x, zoom_in))


def zoom_steps(rows: DataFrame, keys: list[str], order: list[str], zoom_in: Column, **sums: Column) -> DataFrame:
    """keys, _scale, _steps, and sums: zoom steps of rows (zoom_in is null where a row is none) by _range, reduced to what still counts.

    A step keeps the order of two scales. So where the least and the greatest scale end alike after a range, all do: _scale is where they end in the
    last such range, else null, and _steps are the steps behind it, so the result is exact to the last digit wherever ranges are cut. Steps at
    random reach a bound after some hundred; a key that never does keeps a byte for each.
    """
    steps = F.transform(F.array_sort(F.collect_list(F.when(zoom_in.isNotNull(), F.struct(*order, zoom_in.alias("_in"))))), lambda x: x["_in"])
    ranges = rows.groupBy(*keys, "_range").agg(steps.alias("_steps"), *(F.sum(c).alias(n) for n, c in sums.items()))
    ends = ranges.withColumns({"_low": zoomed(F.lit(LEAST_SCALE), F.col("_steps")), "_high": zoomed(F.lit(MOST_SCALE), F.col("_steps"))})
    last = F.max(F.when(F.col("_low") == F.col("_high"), F.col("_range"))).over(Window.partitionBy(*keys))
    marked = ends.withColumn("_last", F.coalesce(last, F.lit(-1)))
    behind = F.collect_list(F.when((F.col("_range") > F.col("_last")) & (F.size("_steps") > 0), F.struct("_range", "_steps")))
    return marked.groupBy(*keys).agg(
        F.max(F.when(F.col("_range") == F.col("_last"), F.col("_low"))).alias("_scale"),
        F.flatten(F.transform(F.array_sort(behind), lambda x: x["_steps"])).alias("_steps"),
        *(F.sum(n).alias(n) for n in sums),
    )


def _carried(ranged: DataFrame, values: dict[str, Column], count: Column) -> DataFrame:
    """ranged with the last value of each name before each row of its _key, and _count, how many rows before it meet count."""
    here = Window.partitionBy("_key", "_range").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, -1)
    number = count.cast("long")
    found = ranged.withColumns({n: F.last(v, ignorenulls=True).over(here) for n, v in values.items()} | {"_count": F.coalesce(F.sum(number).over(here), F.lit(0))})
    if not hasattr(ranged, "_scratch"):
        return found
    last = [F.max_by(v, F.when(v.isNotNull(), F.struct(*_ORDER))).alias(n) for n, v in values.items()]
    ends = ranged.groupBy("_key", "_range").agg(F.sum(number).alias("_number"), *last)
    across = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    far = ends.select(
        F.col("_key").alias("_far_key"), F.col("_range").alias("_far_range"), F.coalesce(F.sum("_number").over(across), F.lit(0)).alias("_far_count"),
        *(F.last(n, ignorenulls=True).over(across).alias(f"_far{n}") for n in values),
    )
    joined = found.join(far, F.col("_key").eqNullSafe(F.col("_far_key")) & (F.col("_range") == F.col("_far_range")), "left")
    joined = joined.withColumns({n: F.coalesce(n, f"_far{n}") for n in values} | {"_count": F.col("_count") + F.col("_far_count")})
    return joined.drop("_far_key", "_far_range", "_far_count", *(f"_far{n}" for n in values))


def _lines(ranged: DataFrame, start: DataFrame | None, echo_ms: int) -> DataFrame:
    """Events that count, each with its _line, and what it sets.

    Sync, the active pane and applies depend on no view, so windows give them at every event. While sync is on there is one view; when it is turned
    on, the active pane's view becomes that of both. So the views at the end come from one line of events that both share ("both"), and, while sync is
    off at the end, from those of each pane since. Events of a pane that was given up, and echoes, are in no line. "control" are the others.
    """
    kind, pane = F.col("kind"), F.col("pane_id")
    is_kind = lambda *names: F.coalesce(kind.isin(*names), F.lit(False))
    toggle = is_kind("toggle_sync")
    turns = F.when(is_kind("activate") & pane.isin(*VIEWS), pane).when(is_kind("split") & (F.col("scale_value") == "single"), "original")
    known = _carried(ranged, {"_active": turns, "_applied": F.when(is_kind("apply"), F.col("ts"))}, toggle)
    if start is None:
        known = known.withColumns({"_sync0": F.lit(DEFAULT_SYNC), "_active0": F.lit("original"), "_applied0": F.lit(None).cast("timestamp")})
    else:
        known = known.join(start, F.col("_key").eqNullSafe(F.col("_start_key")), "left").drop("_start_key")
        known = known.withColumns({"_sync0": F.coalesce("_sync0", F.lit(DEFAULT_SYNC)), "_active0": F.coalesce("_active0", F.lit("original"))})
    active, applied = F.coalesce("_active", "_active0"), F.coalesce("_applied", "_applied0")
    sync = F.col("_sync0") != (F.col("_count") % 2 == 1)
    echo = is_kind(*PANE_KINDS) & applied.isNotNull() & (F.unix_micros("ts") - F.unix_micros(applied) <= echo_ms * 1000)
    target = F.when(is_kind(*TOOLBAR_KINDS), active).when(is_kind(*PANE_KINDS) & pane.isin(*VIEWS) & ~F.coalesce(echo, F.lit(False)), pane)
    control = toggle | turns.isNotNull() | is_kind("split", "apply")
    some = known.select(
        "_key", "_range", *_ORDER, "kind", target.alias("_target"), sync.alias("_sync"), F.col("_count").alias("_phase"), active.alias("_now"), control.alias("_control"),
        turns.alias("_turns"), "page_number", "relative_offset_y", "scale_value", "scale", "rotation",
    )
    some = some.where(F.col("_target").isNotNull() | F.col("_control"))
    chosen = some.where((F.col("kind") == "toggle_sync") & ~F.col("_sync")).select(F.col("_key").alias("_of"), F.col("_phase").alias("_until"), F.col("_now").alias("_chosen"))
    joined = some.join(chosen, F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_phase") == F.col("_until")), "left")
    line = F.when(F.col("_control"), "control").when(F.col("_sync") | (F.col("_target") == F.col("_chosen")), "both").when(F.col("_chosen").isNull(), F.col("_target"))
    return keep(joined.withColumn("_line", line).where("_line is not null").drop("_of", "_until", "_chosen"), "lines")


def _set_by(lines: DataFrame) -> DataFrame:
    """What each line of each key sets: its last page, place, text of the scale, scale and rotation, quarter turns and zoom steps since, and control."""
    kind, at = F.col("kind"), F.struct(*_ORDER)
    last = lambda value, here: F.max_by(value, F.when(here, at))
    zooms = kind.isin("zoom_in", "zoom_out")
    text = F.when(kind == "scale", preset_or_number(F.col("scale_value"), F.col("scale"))).when(kind == "fit", F.col("scale_value"))
    pages, scales, rotates = kind.isin("page", "scroll", "goto") & F.col("page_number").isNotNull(), (kind == "scale") & F.col("scale").isNotNull(), (kind == "rotation") & F.col("rotation").isNotNull()
    place = F.when(kind == "goto", F.lit(0.0)).when(kind == "scroll", F.col("relative_offset_y"))
    found = lines.groupBy("_key", "_line").agg(
        last(F.col("page_number"), pages).alias("page"), last(place, place.isNotNull()).alias("place"), last(F.struct(text.alias("text"), zooms.alias("zoomed")), zooms | text.isNotNull()).alias("text"),
        last(F.col("scale"), scales).alias("scale"), F.max(F.when(scales, at)).alias("scale_at"), last(F.col("rotation"), rotates).alias("rotation"), F.max(F.when(rotates, at)).alias("rotation_at"),
        F.count_if(kind == "toggle_sync").alias("toggles"), last(F.col("_turns"), F.col("_turns").isNotNull()).alias("active"),
        last(F.struct("scale_value"), kind == "split").alias("split"), last(F.col("ts"), kind == "apply").alias("applied"),
    )
    steps = lines.where(kind.isin("zoom_in", "zoom_out", "rotate")).withColumnsRenamed({"_key": "_of", "_line": "_in"})
    positions = found.select("_key", "_line", "scale_at", "rotation_at")
    counted = steps.join(positions, F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_line") == F.col("_in")))
    behind = lambda c: F.col(c).isNull() | (at > F.col(c))
    zoom_in = F.when(kind.isin("zoom_in", "zoom_out") & behind("scale_at"), kind == "zoom_in")
    turns = F.when((kind == "rotate") & behind("rotation_at"), 1).otherwise(0)
    reduced = zoom_steps(counted.drop("_of", "_in"), ["_key", "_line"], _ORDER, zoom_in, turns=turns).withColumnsRenamed({"_key": "_of", "_line": "_in"})
    both = found.join(reduced, F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_line") == F.col("_in")), "left")
    return both.drop("_of", "_in", "scale_at", "rotation_at")


def _after(view: Column, line: Column, pages: Column) -> Column:
    """A view after a line's events; no line, or a document without pages, leaves it as it is."""
    start = normalize_scale(F.coalesce(line["scale"], view["scale"]))
    scale = zoomed(F.coalesce(line["_scale"], start), F.coalesce(line["_steps"], F.array().cast("array<boolean>")))
    text = F.when(line["text"]["zoomed"], number_text(scale)).otherwise(F.coalesce(line["text"]["text"], view["scale_value"]))
    turned = normalize_rotation(F.coalesce(line["rotation"], view["rotation"].cast("double")) + 90.0 * F.coalesce(line["turns"], F.lit(0)))
    new = F.struct(
        normalize_page(F.coalesce(line["page"], view["page_number"].cast("double")), pages).alias("page_number"), normalize_offset(F.coalesce(line["place"], view["relative_offset_y"])).alias("relative_offset_y"),
        text.alias("scale_value"), scale.alias("scale"), turned.alias("rotation"),
    )
    return F.when(line.isNull() | ~F.coalesce(pages > 0, F.lit(False)), view).otherwise(new)


def fold_panes(events: DataFrame, page_count: Column, key: str = "doc_id", before: DataFrame | None = None, most: int | None = None, echo_ms: int = ECHO_MS) -> DataFrame:
    """key and state after all events of each key, in order of ts and event_id.

    Events of a pane change it, toolbar events the active one; in sync both panes get the result. Right after an apply, events of panes are its echo
    and are dropped. Turning sync on copies the active pane; a single pane makes the original one active. A document without pages keeps its views.

    before: key and state to start from, else the default. The fold depends on order, but no event waits for the one before: control state comes from
    windows, events are sorted into lines (_lines), and a line is reduced by partial aggregates to what it sets last (_set_by). The number of jobs
    does not depend on the number of events; a key with more than most (RANGE) is cut into ranges (in_ranges) for windows and zoom steps.
    """
    columns = [F.col(c) for c in _EVENT]
    ranged = in_ranges(events.select(F.col(key).alias("_key"), *columns, page_count.alias("_pages")), "_key", _ORDER, most or RANGE)
    start = None
    if before is not None:
        start = before.select(F.col(key).alias("_start_key"), F.col("state.sync").alias("_sync0"), F.col("state.active").alias("_active0"), F.col("state.applied").alias("_applied0"))
    lines = _lines(ranged, start, echo_ms)
    # The pane whose first view "both" goes on from: the one that the first event in sync changes, or the active one when sync is first turned on.
    first = F.when(F.col("_sync") & (F.col("_phase") == 0) & F.col("_target").isNotNull(), F.col("_target")).when((F.col("kind") == "toggle_sync") & ~F.col("_sync"), F.col("_now"))
    origin = lines.groupBy(F.col("_key").alias("_of")).agg(F.min_by(first, F.when(first.isNotNull(), F.struct(*_ORDER))).alias("_origin"))
    whole = _set_by(lines)
    one = lambda name: F.first(F.when(F.col("_line") == name, F.struct(*(c for c in whole.columns if c not in ("_key", "_line")))), ignorenulls=True).alias(f"_{name}")
    found = whole.groupBy(F.col("_key").alias("_set_key")).agg(*map(one, ("control", "both", *VIEWS)))
    keys = ranged.groupBy("_key").agg(F.max("_pages").alias("_pages"))
    same = lambda other: F.col("_key").eqNullSafe(F.col(other))
    rows = keys.join(found, same("_set_key"), "left").join(origin, same("_of"), "left")
    state = initial_state()
    if before is not None:
        rows = rows.join(before.select(F.col(key).alias("_start_key"), F.col("state").alias("_before")), same("_start_key"), "left")
        state = F.coalesce("_before", state)
    rows = rows.withColumn("_state", state)
    pages, old, control = F.col("_pages"), F.col("_state"), F.col("_control")
    shared = rows.withColumn("_shared", F.when(F.col("_origin").isNotNull(), _after(F.when(F.col("_origin") == "original", old["original"]).otherwise(old["companion"]), F.col("_both"), pages)))
    views = [_after(F.coalesce("_shared", old[v]), F.col(f"_{v}"), pages).alias(v) for v in VIEWS]
    folded = F.struct(
        *views, F.when(control["toggles"] % 2 == 1, ~old["sync"]).otherwise(old["sync"]).alias("sync"), F.coalesce(control["active"], old["active"]).alias("active"),
        F.when(control["split"].isNotNull(), control["split"]["scale_value"]).otherwise(old["split"]).alias("split"), F.coalesce(control["applied"], old["applied"]).alias("applied"),
    ).cast(STATE)
    done = shared.select(F.col("_key").alias(key), folded.alias("state"))
    done._reads = [t for t in (lines, ranged) if hasattr(t, "_scratch")]
    return done


def release(folded: DataFrame) -> None:
    """Delete the scratch tables that a fold reads, once it has been written."""
    for table in folded._reads:
        forget(table)


def last_known(events: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], inclusive: bool = True, forward: bool = True, most: int | None = None) -> DataFrame:
    """events with, for each name, the last value that is not null among the rows of the same keys up to each row, or before it.

    forward: in order, else from the end. A key with more than most (RANGE) events is cut into ranges (in_ranges): values are looked for within
    a range, and what is not found there is the last one of the ranges before, of which only a row each meet.
    """
    ranged = in_ranges(events.withColumn("_keys", F.struct(*keys)), "_keys", order, most or RANGE)
    turned = lambda c: F.col(c).asc() if forward else F.col(c).desc()
    here = Window.partitionBy("_keys", "_range").orderBy(*map(turned, order)).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    found = ranged.withColumns({name: F.last(value, ignorenulls=True).over(here) for name, value in values.items()})
    if not hasattr(ranged, "_scratch"):
        return found.drop("_keys", "_range")
    pick = F.max_by if forward else F.min_by
    ends = ranged.groupBy("_keys", "_range").agg(*(pick(value, F.when(value.isNotNull(), F.struct(*order))).alias(name) for name, value in values.items()))
    across = Window.partitionBy("_keys").orderBy(turned("_range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_keys", "_range", *(F.last(name, ignorenulls=True).over(across).alias(f"_far_{name}") for name in values))
    joined = found.join(carried, ["_keys", "_range"]).withColumns({name: F.coalesce(name, f"_far_{name}") for name in values})
    return joined.drop("_keys", "_range", *(f"_far_{name}" for name in values))


def fold_absolute(events: DataFrame, keys: list[str], fields: list[str], order: list[str], most: int | None = None) -> DataFrame:
    """Views after each event while sync is constant and updates absolute: each field's last value that is not null."""
    known = last_known(events, keys, order, {f"_last_{c}": F.col(c) for c in fields}, most=most)
    return known.select(*(F.col(f"_last_{c}").alias(c) if c in fields else F.col(c) for c in events.columns))


def rotations(events: DataFrame, key: str, turns: Column) -> DataFrame:
    """Rotation of each key after all its quarter turns."""
    return events.groupBy(key).agg(F.pmod(90 * F.count_if(turns), F.lit(360)).alias("rotation"))


def zooms(events: DataFrame, key: str, order: list[str], zoom_in: Column, most: int | None = None) -> DataFrame:
    """Scale of each key after its zoom steps in order, from 1; each is clamped, so order counts. Ranges of most (RANGE) steps are reduced alone (zoom_steps)."""
    ranged = in_ranges(events.select(key, *(c for c in order if c != key), zoom_in.alias("_zoom")), key, order, most or RANGE)
    reduced = zoom_steps(ranged, [key], order, F.col("_zoom"))
    return reduced.select(key, zoomed(F.coalesce("_scale", F.lit(1.0)), F.col("_steps")).alias("scale"))


def fan_out(events: DataFrame, sync: Column, pane: str = "pane_id") -> DataFrame:
    """A row for each pane that an event reaches."""
    panes = F.when(sync, F.array(F.lit("original"), F.lit("companion"))).otherwise(F.array(F.col(pane)))
    return events.withColumn("target", F.explode(panes))


def suppress_echoes(events: DataFrame, keys: list[str], order: list[str], applies: Column, within_us: int = ECHO_MS * 1000, ts: str = "ts", most: int | None = None) -> DataFrame:
    """Events that do not follow an apply of their key within a time; applies themselves are left out."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    marked = last_known(events, keys, order, {"_applied": F.when(applies, at)}, inclusive=False, most=most)
    return marked.where(~applies & (F.col("_applied").isNull() | (at - F.col("_applied") > within_us))).drop("_applied")


def debounce(events: DataFrame, keys: list[str], order: list[str], gap_us: int = DEBOUNCE_MS * 1000, ts: str = "ts", flush_at_end: bool = True, most: int | None = None) -> DataFrame:
    """Events after which a key is quiet for the gap: those that are saved. flush_at_end keeps the last one of each key too."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    known = last_known(events, keys, order, {"_next": at}, inclusive=False, forward=False, most=most)
    return known.where((F.col("_next") - at >= gap_us) | (F.col("_next").isNull() & F.lit(flush_at_end))).drop("_next")


def on_change(events: DataFrame, keys: list[str], order: list[str], fields: list[str], most: int | None = None) -> DataFrame:
    """Events that change a field against the one before; the first of a key does."""
    known = last_known(events, keys, order, {"_before": F.struct(*fields)}, inclusive=False, most=most)
    return known.where(F.col("_before").isNull() | (F.col("_before") != F.struct(*fields))).drop("_before")


def coalesce_scrolls(events: DataFrame, keys: list[str], frame: str, value: str, order: list[str], ts: str = "ts") -> DataFrame:
    """The last value of each frame of time."""
    return events.groupBy(*keys, F.window(ts, frame).alias("_frame")).agg(F.max_by(value, F.struct(*order)).alias(value)).select(*keys, F.col("_frame.start").alias("frame_start"), value)
