"""The operators applied to whole tables, by name, and DuckDB SQL for the same rows.

Stand-ins: users of events are documents opened by time, event types are kinds of updates; sources of documents are titles and texts
paths; urls of pages are paths and their html titles metadata.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import guards as G
from quire.functions import labels as L
from quire.functions import normalize as N
from quire.functions import paths as P
from quire.operators import events as E
from quire.operators import library as B
from quire.operators.index import TextIndex, lay_out_by_time, recent_from_layout
from quire.schemas import DEFAULT_VIEW, LIBRARY, PANE_EVENT
from quire.scratch import scratch_dir
from quire.session import table
from quire.sources.buckets import BucketedTable
from quire.sources.files import parse_store, read_store, write_store
from quire.streaming import states as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The stand-in events are minutes apart, so the gap of saves and the guard against echoes are hours here.
HOURS_US = 6 * 3600 * 1_000_000
ORDER = ["ts", "event_id"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _props(name: str = "k"):
    return F.get_json_object("props", f"$.{name}").cast("double")


#: Kinds of view events by event type and event_id % 3.
KINDS = {
    "view": ("goto", "page", "scroll"), "click": ("rotate", "rotation", "rotate"), "signup": ("toggle_sync", "split", "fit"),
    "error": ("activate", "zoom_in", "zoom_out"), "purchase": ("scroll", "scale", "apply"),
}


def view_events(events: DataFrame) -> DataFrame:
    """Stand-in pane events of all kinds: user as document, kind by event type and number, value and props as fields."""
    k, value, event_type = _props(), F.col("value"), F.col("event_type")
    even = F.col("event_id") % 2 == 0
    names = F.get(F.create_map(*(x for t, kinds in KINDS.items() for x in (F.lit(t), F.array(*map(F.lit, kinds)))))[event_type], (F.col("event_id") % 3).cast("int"))
    text = F.when(names == "split", F.when(even, "single").otherwise("stacked")).when(names == "fit", "page-fit")
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("doc_id"), F.when(even, "original").otherwise("companion").alias("pane_id"),
        names.alias("kind"), k.alias("page_number"), F.pmod(value, F.lit(1.0)).alias("relative_offset_y"), text.alias("scale_value"),
        F.when(names == "scale", value / 50).alias("scale"), F.when(names == "rotation", value * 3).alias("rotation"),
    ).to(PANE_EVENT)


_LATEST = "SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"


@query(f"SELECT * FROM ({_LATEST}) ORDER BY ts DESC, user_id LIMIT 20")
def recent_topk(spark, d):
    return B.recent(B.latest_per_key(table(spark, d, "events"), "user_id", ORDER), "ts", "user_id")


@query(_LATEST)
def latest_per_key(spark, d):
    return B.latest_per_key(table(spark, d, "events"), "user_id", ORDER)


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE event_id = 7")
def point_lookup(spark, d):
    return B.lookup(table(spark, d, "events"), "event_id", 7)


@query("SELECT doc_id, source, lang FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20) WHERE contains(lower(source || ' ' || text), 'the')")
def search_recent(spark, d):
    return B.search(B.recent(table(spark, d, "documents"), "n_chars", "doc_id"), " The ", "source", "text").select("doc_id", "source", "lang")


@query("SELECT doc_id, source, lang FROM documents WHERE contains(lower(source || ' ' || text), 'src1 the')")
def search_all(spark, d):
    return B.search(table(spark, d, "documents"), "SRC1 the", "source", "text").select("doc_id", "source", "lang")


@query("SELECT page_id, url FROM pages WHERE contains(lower(url || ' ' || regexp_extract(html, '<title>([^<]*)</title>', 1)), 'net/')")
def search_indexed(spark, d):
    """A search by an index of runs of characters, over addresses and titles of pages."""
    rows = table(spark, d, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    index = TextIndex(spark, f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}", "page_id", "url", "title")
    index.build(rows)
    return index.search(rows, " NET/ ").select("page_id", "url")


@query("SELECT event_id, ts, user_id FROM events ORDER BY ts DESC, event_id LIMIT 20")
def recent_laid_out(spark, d):
    """The recent list from files laid out by time."""
    folder = f"{scratch_dir(spark)}/layout-{uuid.uuid4().hex}"
    lay_out_by_time(table(spark, d, "events"), folder, "ts", "event_id")
    return recent_from_layout(spark, folder, "ts", "event_id").select("event_id", "ts", "user_id")


@query("""
WITH r AS (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20)
SELECT (SELECT count(*) FROM r) AS n_recent, (SELECT count(*) FROM r WHERE contains(lower(source || ' ' || text), '%')) AS n_found,
  CASE WHEN (SELECT count(*) FROM r WHERE contains(lower(source || ' ' || text), '%')) = 0 THEN '일치하는 논문이 없습니다.' END AS message""")
def recent_summary(spark, d):
    return B.recent_summary(B.recent(table(spark, d, "documents"), "n_chars", "doc_id"), "%", "source", "text")


@query("""
SELECT page_id, 'doc_' || lpad(lower(to_hex(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(url, ''), lambda c: unicode(c)::BIGINT)),
  lambda a, b: ((xor(a, b) * 16777619) & 4294967295)))), 8, '0') AS id FROM pages""")
def document_id(spark, d):
    return table(spark, d, "pages").select("page_id", P.document_id(F.col("url")).alias("id"))


@query(r"SELECT page_id, coalesce(nullif(regexp_extract(url, '([^/\\]*)$', 1), ''), 'Untitled.pdf') AS name FROM pages")
def file_name(spark, d):
    return table(spark, d, "pages").select("page_id", P.file_name(F.col("url")).alias("name"))


@query(r"""
SELECT page_id, coalesce(nullif(trim(CASE WHEN page_id % 3 = 0 THEN '' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END, E' \t\n\r'), ''),
  regexp_replace(coalesce(nullif(regexp_extract(url, '([^/\\]*)$', 1), ''), 'Untitled.pdf'), '\.html$', '', 'i')) AS title FROM pages""")
def title_fallback(spark, d):
    title = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return table(spark, d, "pages").select("page_id", P.title_or(title, P.file_name(F.col("url")), "html").alias("title"))


@query(r"""
SELECT page_id, regexp_matches(url, '[^/\\]\.html$', 'i') AS has_ending, starts_with(url, 'browser://') AS in_browser,
  CASE WHEN NOT regexp_matches(path, '[^/\\]\.pdf$', 'i') THEN 'not a pdf' WHEN length(html) < 1000 THEN 'not found' WHEN page_id % 2 = 1 THEN 'not a file' END AS error,
  starts_with(html, '<!') OR ends_with(lower(path), '.pdf') AS accepted
FROM (SELECT *, url || CASE WHEN contains(url, '?') THEN '' ELSE '.PDF' END AS path FROM pages)""")
def path_checks(spark, d):
    url, path = F.col("url"), F.concat("url", F.when(F.contains("url", F.lit("?")), "").otherwise(".PDF"))
    exists, is_file = F.length("html") >= 1000, F.col("page_id") % 2 == 0
    mime = F.when(F.startswith("html", F.lit("<!")), "application/pdf").otherwise("text/html")  # a stand-in
    return table(spark, d, "pages").select(
        "page_id", url.rlike(r"(?i)[^/\\]\.html\z").alias("has_ending"), P.is_browser_path(url).alias("in_browser"),
        P.path_error(path, exists, is_file).alias("error"), P.browser_accepts(mime, path).alias("accepted"),
    )


_OPENED = """SELECT d.doc_id AS id, 10 AS page_count, coalesce(l.quality + 2, 1) AS page_number, coalesce(l.toxic / 2.0, 0.0) AS relative_offset_y,
  CASE WHEN l.doc_id IS NULL THEN 'page-width' ELSE 'page-fit' END AS scale_value, CASE WHEN l.doc_id IS NULL THEN 1.0 ELSE 8.0 END::DOUBLE AS scale,
  CASE WHEN l.doc_id IS NULL THEN 0 ELSE 100 END AS rotation, CASE WHEN l.doc_id IS NULL THEN 'side-by-side' ELSE 'single' END AS split_mode,
  l.doc_id IS NULL AS sync_enabled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def _opened_and_saved(spark, d) -> tuple[DataFrame, DataFrame]:
    saved = table(spark, d, "labels").select(
        F.col("doc_id").alias("id"), (F.col("quality") + 2).alias("page_number"), (F.col("toxic") / 2).alias("relative_offset_y"), F.lit("page-fit").alias("scale_value"),
        F.lit(8.0).alias("scale"), F.lit(100).alias("rotation"), F.lit("single").alias("split_mode"), F.lit(False).alias("sync_enabled"),
    )
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(10).alias("page_count")), saved


def _opened(spark, d) -> DataFrame:
    return B.with_previous(*_opened_and_saved(spark, d))


@query(_OPENED)
def restore_defaults(spark, d):
    return _opened(spark, d)


@query(_OPENED)
def restore_from_table(spark, d):
    """The same from a stored library, of which only buckets of opened documents are read."""
    opened, saved = _opened_and_saved(spark, d)
    return B.with_previous(opened, _stored(spark, saved).having(opened))


@query(f"SELECT id, page_number, relative_offset_y, scale_value, least(scale, 4.0) AS scale, CASE WHEN rotation = 100 THEN 90 ELSE 0 END AS rotation, 'original' AS active FROM ({_OPENED})")
def restore_views(spark, d):
    return B.restore(_opened(spark, d)).select("id", "original.*", "active")


#: The library is of what was not bought, the batch of updates of purchases; ids are of a user and a number of theirs, so some are on one side only.
_SIDE = "SELECT user_id * 100 + json_extract_string(props, '$.k')::BIGINT AS id, count(*) AS n, max(value) AS top, max(ts) AS opened FROM events WHERE event_type {} 'purchase' GROUP BY 1"
_OLD, _NEW = _SIDE.format("<>"), _SIDE.format("=")


def _slices(spark, d) -> tuple[DataFrame, DataFrame]:
    """A library and a batch of updates; together they read all events."""
    rows = table(spark, d, "events").withColumn("id", F.col("user_id") * 100 + _props().cast("bigint"))
    made = lambda part: part.groupBy("id").agg(F.count("*").alias("n"), F.max("value").alias("top"), F.max("ts").alias("opened"))
    return made(rows.where(F.col("event_type") != "purchase")), made(rows.where(F.col("event_type") == "purchase"))


_UPSERTED = f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)"
_UPDATED = f"WITH o AS ({_OLD}), n AS ({_NEW}) SELECT o.id, o.n, coalesce(n.top, o.top) AS top, coalesce(n.opened, o.opened) AS opened FROM o LEFT JOIN n ON o.id = n.id"


@query(_UPSERTED)
def upsert(spark, d):
    return B.upsert(*_slices(spark, d))


@query(_UPDATED)
def partial_update(spark, d):
    return B.partial_update(*_slices(spark, d), ["top", "opened"])


def _stored(spark, rows: DataFrame, key: str = "id") -> BucketedTable:
    """rows as a bucketed table in the scratch folder."""
    stored = BucketedTable(spark, f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}", key, rows.schema)
    stored.upsert(rows)
    return stored


@query(_UPSERTED)
def upsert_table(spark, d):
    """The same by a commit to a stored library."""
    library, incoming = _slices(spark, d)
    stored = _stored(spark, library)
    stored.upsert(incoming)
    return stored.rows()


@query(_UPDATED)
def update_table(spark, d):
    library, updates = _slices(spark, d)
    stored = _stored(spark, library)
    stored.update(updates, ["top", "opened"])
    return stored.rows()


_TYPED = """SELECT DISTINCT ON (id) * FROM (SELECT user_id * 100 + json_extract_string(props, '$.k')::BIGINT AS id, event_id, ts, value FROM events WHERE event_type {} 'purchase') ORDER BY id, ts DESC, event_id DESC"""


@query(f"""
WITH o AS ({_TYPED.format("<>")}), n AS ({_TYPED.format("=")})
SELECT o.id::VARCHAR AS id, CASE WHEN n.id IS NULL THEN 1 ELSE floor(n.value)::INT END AS page_number, CASE WHEN n.id IS NULL THEN o.ts ELSE TIMESTAMP '2024-01-29 12:00:00' END AS last_opened_at
FROM o LEFT JOIN n USING (id) ORDER BY last_opened_at DESC, id LIMIT 20""")
def recent_after_save(spark, d):
    """The recent list after views were saved: those of purchases into a library of all else."""
    rows = table(spark, d, "events").withColumn("id", (F.col("user_id") * 100 + _props().cast("bigint")).cast("string")).withColumn("ts", F.col("ts").cast("timestamp"))
    newest = lambda part: B.latest_per_key(part, "id", ORDER)
    default = {f"_{c}": F.lit(v) for c, v in DEFAULT_VIEW.items()}
    library = newest(rows.where(F.col("event_type") != "purchase")).select(
        "id", F.col("id").alias("file_path"), F.col("event_type").alias("title"), F.lit(9).alias("page_count"), F.col("ts").alias("last_opened_at"),
        *(v.alias(c[1:]) for c, v in default.items()), F.lit("single").alias("split_mode"), F.lit(True).alias("sync_enabled"), F.col("ts").alias("updated_at"),
    ).to(LIBRARY)
    view = F.struct(F.floor("value").cast("int").alias("page_number"), F.lit(0.5).alias("relative_offset_y"), F.lit("page-fit").alias("scale_value"), F.lit(1.5).alias("scale"), F.lit(90).alias("rotation"))
    saved = newest(rows.where(F.col("event_type") == "purchase")).select(F.col("id").alias("doc_id"), F.struct(view.alias("original"), F.lit("stacked").alias("split"), F.lit(False).alias("sync")).alias("state"))
    found = S.recent_after(library, saved, F.lit("2024-01-29 12:00:00").cast("timestamp"))
    return found.select("id", "page_number", F.col("last_opened_at").cast("timestamp_ntz").alias("last_opened_at"))


_STORE = "SELECT user_id AS id, max(ts) AS opened, user_id AS position FROM events GROUP BY user_id"


def _store(spark, d) -> DataFrame:
    """A browser's list: users in order of their numbers."""
    return table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("opened")).withColumn("position", F.col("id"))


@query(f"WITH s AS ({_STORE}) SELECT id, opened, 0 AS position FROM s WHERE id = 5 UNION ALL SELECT id, opened, position + 1 FROM s WHERE id <> 5")
def move_to_front(spark, d):
    store = _store(spark, d)
    return B.move_to_front(store, store.where("id = 5").drop("position"))


@query(f"""
SELECT row_number() OVER (ORDER BY position) - 1 AS position, id::VARCHAR AS id, date_trunc('milliseconds', opened) AS last_opened_at, (position % 7)::INT AS page_number FROM ({_STORE}) ORDER BY position LIMIT 20""")
def store_written(spark, d):
    """The browser's list as JSON, read again; times are kept to the millisecond."""
    view = F.struct((F.col("position") % 7).cast("int").alias("page_number"), F.lit(0.0).alias("relative_offset_y"), F.lit("x").alias("scale_value"), F.lit(1.0).alias("scale"), F.lit(0).alias("rotation"))
    rows = _store(spark, d).select(
        F.col("id").cast("string").alias("id"), F.lit("/p").alias("file_path"), F.lit("t").alias("title"), F.lit(9).alias("page_count"), F.col("opened").cast("timestamp").alias("last_opened_at"),
        view.alias("view_state"), F.lit("single").alias("split_mode"), F.lit(True).alias("sync_enabled"), "position",
    )
    found = read_store(write_store(rows), "store")
    return found.select(F.col("position").cast("bigint").alias("position"), "id", F.col("last_opened_at").cast("timestamp_ntz").alias("last_opened_at"), "view_state.page_number")


@query(f"WITH s AS ({_STORE}) SELECT id, opened, row_number() OVER (ORDER BY position) - 1 AS position FROM s ORDER BY position LIMIT 20")
def truncating_write(spark, d):
    return B.renumber(_store(spark, d))


@query(f"SELECT s.id, CASE WHEN s.id % 2 = 0 THEN TIMESTAMP '2025-01-01' ELSE opened END AS opened, position FROM ({_STORE}) s")
def update_in_place(spark, d):
    store = _store(spark, d)
    return B.partial_update(store, store.where("id % 2 = 0").select("id", F.lit("2025-01-01").cast("timestamp_ntz").alias("opened")), ["opened"])


@query(f"SELECT id, 'path-' || id AS file_path, page_number, relative_offset_y, scale, rotation, sync_enabled::INT AS sync_enabled, split_mode FROM ({_OPENED})")
def nest_flatten(spark, d):
    rows = _opened(spark, d).withColumns({"file_path": F.concat(F.lit("path-"), "id"), "title": F.lit("t"), "last_opened_at": F.lit(None).cast("timestamp")})
    return B.flatten(B.nest(rows)).select("id", "file_path", "page_number", "relative_offset_y", "scale", "rotation", "sync_enabled", "split_mode")


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN least(greatest(value, 0), 1) END IGNORE NULLS) OVER w AS relative_offset_y,
  last_value(CASE WHEN event_type = 'click' THEN least(greatest(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 20, 0.25), 4) END IGNORE NULLS) OVER w AS scale
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def merge_fold(spark, d):
    rows = table(spark, d, "events").select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") == "view", N.normalize_offset(F.col("value"))).alias("relative_offset_y"),
        F.when(F.col("event_type") == "click", N.normalize_scale(_props() / 20)).alias("scale"),
    )
    return E.fold_absolute(rows, ["user_id"], ["relative_offset_y", "scale"], ORDER).drop("ts")


@query("SELECT user_id, (90 * count(*) FILTER (event_type = 'click')) % 360 AS rotation FROM events GROUP BY user_id")
def rotate_fold(spark, d):
    return E.rotations(table(spark, d, "events"), "user_id", F.col("event_type") == "click")


@query("""
SELECT user_id, list_reduce(list_prepend(1::DOUBLE, list(CASE WHEN event_type = 'view' THEN 1.1::DOUBLE ELSE 1::DOUBLE / 1.1::DOUBLE END ORDER BY ts, event_id)),
  lambda a, f: least(greatest(a * f, 0.25::DOUBLE), 4::DOUBLE)) AS scale FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id""")
def zoom_fold(spark, d):
    rows = table(spark, d, "events").where(F.col("event_type").isin("view", "click"))
    return E.zooms(rows, "user_id", ORDER, F.col("event_type") == "view")


@query("""
SELECT event_id, t.target FROM events, (VALUES ('original'), ('companion')) t(target)
WHERE user_id % 2 = 0 OR t.target = CASE WHEN event_type = 'view' THEN 'original' ELSE 'companion' END""")
def sync_fanout(spark, d):
    pane = F.when(F.col("event_type") == "view", "original").otherwise("companion")
    return E.fan_out(table(spark, d, "events").withColumn("pane_id", pane), F.col("user_id") % 2 == 0).select("event_id", "target")


@query("""
SELECT event_id, user_id, ts FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events)
WHERE following IS NULL OR following >= ts + INTERVAL 6 HOUR""")
def debounce_persist(spark, d):
    return E.debounce(table(spark, d, "events"), ["user_id"], ORDER, HOURS_US).select("event_id", "user_id", "ts")


@query("""
SELECT event_id, user_id FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS applied FROM events)
WHERE event_type <> 'purchase' AND (applied IS NULL OR ts > applied + INTERVAL 6 HOUR)""")
def echo_suppress(spark, d):
    applies = F.col("event_type") == "purchase"
    return E.suppress_echoes(table(spark, d, "events"), ["user_id"], ORDER, applies, HOURS_US).select("event_id", "user_id")


@query("""
SELECT event_id, coalesce(event_type = lag(event_type) OVER w AND abs(value - lag(value) OVER w) < 0.002, false) AS close
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def state_close(spark, d):
    view = F.struct(F.lit(1).alias("page_number"), F.lit(0.0).alias("relative_offset_y"), F.col("event_type").alias("scale_value"), F.col("value").alias("scale"), F.lit(0).alias("rotation"))
    rows = E.last_known(table(spark, d, "events").withColumn("view", view), ["user_id"], ORDER, {"before": F.col("view")}, inclusive=False)
    return rows.select("event_id", F.coalesce(N.view_is_close(F.col("view"), F.col("before")), F.lit(False)).alias("close"))


@query("""
SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR event_type <> before""")
def apply_on_change(spark, d):
    return E.on_change(table(spark, d, "events"), ["user_id"], ORDER, ["event_type"]).select("event_id", "user_id", "event_type")


@query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS frame_start, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def scroll_coalesce(spark, d):
    rows = table(spark, d, "events")
    return E.coalesce_scrolls(rows, ["user_id"], "1 hour", "value", ORDER).select("user_id", F.col("frame_start").cast("timestamp_ntz").alias("frame_start"), "value")


@query("SELECT event_id, floor(value * 100 + 0.5)::BIGINT AS percent FROM events")
def percent(spark, d):
    return table(spark, d, "events").select("event_id", N.percent(F.col("value")).alias("percent"))


@query("SELECT event_id, (((floor((value - 50) * 7 / 90 + 0.5) * 90)::BIGINT % 360) + 360) % 360 AS rotation FROM events")
def normalize_rotation(spark, d):
    return table(spark, d, "events").select("event_id", N.normalize_rotation((F.col("value") - 50) * 7).cast("bigint").alias("rotation"))


@query("""
SELECT event_id, floor(least(greatest(value, 1), greatest(user_id % 40, 1)) + 0.5)::INT AS page_number, least(greatest(value - 1, 0), 1) AS relative_offset_y FROM events""")
def normalize_anchor(spark, d):
    page = N.normalize_page(F.col("value"), (F.col("user_id") % 40).cast("int"))
    return table(spark, d, "events").select("event_id", page.alias("page_number"), N.normalize_offset(F.col("value") - 1).alias("relative_offset_y"))


@query("""
SELECT event_id, least(greatest((value / 20) * CASE WHEN event_type = 'view' THEN 1.1::DOUBLE ELSE 1::DOUBLE / 1.1::DOUBLE END, 0.25::DOUBLE), 4::DOUBLE) AS scale FROM events""")
def scale_step(spark, d):
    return table(spark, d, "events").select("event_id", N.scale_by(F.col("value") / 20, F.col("event_type") == "view").alias("scale"))


@query("""
SELECT *, CASE WHEN abs(value * 30 - scroll_top) > 3 THEN scroll_top ELSE value * 30 END AS scrolled FROM (
  SELECT event_id, value, 100 + anchor * greatest(value, 1) AS scroll_top, anchor FROM (SELECT *, least(greatest((value * 30 - 100) / greatest(value, 1), 0), 1) AS anchor FROM events))""")
def scroll_anchor(spark, d):
    value = F.col("value")
    anchor = N.scroll_to_anchor(value * 30, F.lit(100.0), value)
    target = N.anchor_to_scroll(anchor, F.lit(100.0), value)
    return table(spark, d, "events").select("event_id", "value", anchor.alias("anchor"), target.alias("scroll_top"), N.applied_scroll(value * 30, target).alias("scrolled"))


@query("SELECT event_id, k AS page FROM events, unnest(from_json('[' || props || ']', '[{\"k\":\"DOUBLE\"}]')) u(p), LATERAL (SELECT p.k AS k)")
def page_input(spark, d):
    return table(spark, d, "events").select("event_id", L.page_input(F.concat(F.lit(" \t"), F.get_json_object("props", "$.k"), F.lit(" "))).alias("page"))


@query("""
SELECT event_id, CASE WHEN user_id % 7 = 0 THEN '준비됨' ELSE CASE event_type WHEN 'view' THEN '원문' WHEN 'click' THEN '좌우 분할' ELSE '상하 분할' END
  || ' · ' || CASE WHEN user_id % 2 = 0 THEN '동기화됨' ELSE '독립 보기' END END AS status,
  'p. ' || user_id || ' · ' || floor(value * 100 + 0.5)::BIGINT || '% · ' || 90 || '°' AS footer FROM events""")
def status_labels(spark, d):
    mode = F.when(F.col("event_type") == "view", "single").when(F.col("event_type") == "click", "side-by-side").otherwise("stacked")
    status = L.status_label(F.col("user_id") % 7 != 0, mode, F.col("user_id") % 2 == 0)
    return table(spark, d, "events").select("event_id", status.alias("status"), L.position_label(F.col("user_id"), F.col("value"), F.lit(90)).alias("footer"))


@query("""
SELECT doc_id, NOT has OR doc_id <= 1 AS previous_off, NOT has OR doc_id >= 50 AS next_off, NOT has OR source = 'src1' AS sync_off, doc_id = 7 AS active, has AND n_chars > 100 AS ready
FROM (SELECT *, lang <> 'de' AS has FROM documents)""")
def navigation_guards(spark, d):
    page, has, mode = F.col("doc_id"), F.col("lang") != "de", F.when(F.col("source") == "src1", "single").otherwise("stacked")
    height = F.when(F.col("n_chars") > 100, F.col("n_chars"))
    return table(spark, d, "documents").select(
        "doc_id", G.previous_off(has, page).alias("previous_off"), G.next_off(has, page, F.lit(50)).alias("next_off"), G.sync_off(has, mode).alias("sync_off"),
        G.is_active(page, F.lit(7)).alias("active"), G.is_ready(has, height).alias("ready"),
    )


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS n_documents, CASE WHEN event_id % 2 = 0 THEN user_id END AS page_count FROM events")
def browser_store_scan(spark, d):
    good = F.concat(F.lit('[{"id":"a","page_count":'), F.col("user_id"), F.lit("}]"))
    text = F.when(F.col("event_id") % 2 == 0, good).otherwise(F.when(F.col("event_id") % 3 == 0, "not json"))
    rows = table(spark, d, "events").select("event_id", parse_store(text).alias("list"))
    return rows.select("event_id", F.size("list").alias("n_documents"), F.get("list", F.lit(0))["page_count"].cast("bigint").alias("page_count"))


@query("""
SELECT event_id, CASE WHEN ts::DATE = DATE '2024-01-30' THEN CASE WHEN hour(ts) < 12 THEN '오전' ELSE '오후' END || strftime(ts, ' %I:%M')
  ELSE month(ts) || '월 ' || day(ts) || '일' END AS label FROM events""")
def label_recent(spark, d):
    return table(spark, d, "events").select("event_id", L.recent_label(F.col("ts"), F.lit("2024-01-30 12:00:00").cast("timestamp")).alias("label"))


def _fold_sql() -> str:
    """The fold as a recursive query: one row per user and step, with page, offset, scale and rotation of both panes."""
    kinds = " ".join(f"WHEN '{t}' THEN {list(names)}" for t, names in KINDS.items())
    fields = {
        "page": "floor(least(greatest(coalesce(CASE WHEN kind IN ('page', 'scroll', 'goto') THEN k END, c_page), 1), 80) + 0.5)",
        "place": "least(greatest(coalesce(CASE kind WHEN 'goto' THEN 0 WHEN 'scroll' THEN value % 1 END, c_place), 0), 1)",
        "scale": "least(greatest(CASE kind WHEN 'zoom_in' THEN c_scale * 1.1::DOUBLE WHEN 'zoom_out' THEN c_scale * (1::DOUBLE / 1.1::DOUBLE) WHEN 'scale' THEN value / 50 ELSE c_scale END, 0.25), 4)",
        "text": "CASE WHEN kind IN ('zoom_in', 'zoom_out') THEN {zoomed} WHEN kind = 'scale' THEN {given} WHEN kind = 'fit' THEN 'page-fit' ELSE c_text END",
        "turn": "(floor(CASE kind WHEN 'rotate' THEN c_turn + 90 WHEN 'rotation' THEN value * 3 ELSE c_turn END / 90 + 0.5) * 90) % 360",
    }
    number = lambda x: f"CASE WHEN {x} = floor({x}) THEN ({x})::BIGINT::VARCHAR ELSE ({x})::VARCHAR END"
    fields["text"] = fields["text"].format(zoomed=number(fields["scale"]), given=number("value / 50"))
    kind_of = {f: "VARCHAR" if f == "text" else "DOUBLE" for f in fields}
    of = lambda pane: [f"{pane}_{f}" for f in fields]
    current = ", ".join(f"CASE WHEN pane = 'original' THEN o_{f} ELSE s_{f} END AS c_{f}" for f in fields)
    active = ", ".join(f"CASE WHEN active = 'original' THEN o_{f} ELSE s_{f} END AS a_{f}" for f in fields)
    put = ", ".join(
        f"(CASE WHEN kind = 'toggle_sync' AND NOT sync THEN a_{f} WHEN moves AND (sync OR pane = '{name}') THEN {new} ELSE {p}_{f} END)::{kind_of[f]}"
        for p, name in (("o", "original"), ("s", "companion")) for f, new in fields.items()
    )
    return f"""
WITH RECURSIVE e AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, epoch_us(ts) AS us, event_id % 2 = 0 AS even, value, user_id % 10 > 1 AS has_pages,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, (CASE event_type {kinds} END)[event_id % 3 + 1] AS kind FROM events),
f(user_id, n, {", ".join(of("o") + of("s"))}, sync, active, split, applied) AS (
  SELECT DISTINCT user_id, 0::BIGINT, 1::DOUBLE, 0::DOUBLE, 1::DOUBLE, 'page-width', 0::DOUBLE, 1::DOUBLE, 0::DOUBLE, 1::DOUBLE, 'page-width', 0::DOUBLE, true, 'original', 'side-by-side', NULL::BIGINT FROM events
  UNION ALL
  SELECT user_id, n, {put}, CASE WHEN kind = 'toggle_sync' THEN NOT sync ELSE sync END,
    CASE WHEN kind = 'activate' THEN own WHEN kind = 'split' AND even THEN 'original' ELSE active END,
    CASE WHEN kind = 'split' THEN CASE WHEN even THEN 'single' ELSE 'stacked' END ELSE split END, CASE WHEN kind = 'apply' THEN us ELSE applied END
  FROM (SELECT *, {current}, {active}, has_pages AND (toolbar OR (kind IN ('page', 'scale', 'rotation', 'scroll') AND coalesce(us - applied > 80000, true))) AS moves
    FROM (SELECT *, CASE WHEN toolbar THEN active ELSE own END AS pane
      FROM (SELECT f.* EXCLUDE n, e.* EXCLUDE user_id, CASE WHEN even THEN 'original' ELSE 'companion' END AS own, kind IN ('goto', 'zoom_in', 'zoom_out', 'fit', 'rotate') AS toolbar
        FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1))))
SELECT user_id::VARCHAR AS doc_id, sync, active, split, {", ".join(f"{p}_{f}{kind} AS {name}_{column}" for p, name in (("o", "original"), ("s", "companion"))
    for f, column, kind in (("page", "page_number", "::INT"), ("place", "relative_offset_y", ""), ("scale", "scale", ""), ("text", "scale_value", ""), ("turn", "rotation", "::INT")))}
FROM f WHERE n = (SELECT count(*) FROM events x WHERE x.user_id = f.user_id)"""


_FOLD = _fold_sql()
_FOLDED = ("page_number", "relative_offset_y", "scale", "scale_value", "rotation")


def _pages():
    """Documents have 80 pages, but for some whose number is not known yet or 0."""
    last = F.col("doc_id").cast("bigint") % 10
    return F.when(last == 0, F.lit(0)).when(last > 1, F.lit(80))


def _flat_states(folded: DataFrame) -> DataFrame:
    rows = folded.select("doc_id", "state.*")
    return rows.select("doc_id", "sync", "active", "split", *(F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("original", "companion") for c in _FOLDED))


@query(_FOLD)
def pane_fold(spark, d):
    return _flat_states(E.fold_panes(view_events(table(spark, d, "events")), _pages()))


def _replayed(spark, rows: DataFrame, files: int, shuffled: bool, end: bool, kind: str) -> tuple[DataFrame, str]:
    """rows as a stream of some files, in order of time or in any; end: with an end. Also a folder for what it gives and its checkpoint."""
    folder = f"{scratch_dir(spark)}/replay-{uuid.uuid4().hex}"
    dealt = rows.repartition(files, F.xxhash64("event_id")) if shuffled else rows.repartitionByRange(files, *ORDER).sortWithinPartitions(*ORDER)
    dealt.write.parquet(f"{folder}/in")
    if end:
        S.end_stream(spark, rows.schema, f"{folder}/in", kind)
    return spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder


def _streamed(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream in append mode gives once all its files are read."""
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").outputMode("append")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def _timed(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(_FOLD)
def pane_fold_stream(spark, d):
    """The fold as a stream into a table of states. Documents come in any order, each document's events together."""
    events, folder = view_events(table(spark, d, "events")), f"{scratch_dir(spark)}/replay-{uuid.uuid4().hex}"
    events.repartition(4, "doc_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    S.fold_stream(stream, f"{folder}/out", f"{folder}/check", _pages()).awaitTermination()
    return _flat_states(S.states(spark, f"{folder}/out"))


@query("""
SELECT event_id, user_id FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS applied FROM events)
WHERE event_type <> 'purchase' AND (applied IS NULL OR ts > applied + INTERVAL 6 HOUR)""")
def echo_stream(spark, d):
    """Echoes suppressed as events arrive, in any order."""
    rows = _timed(spark, d).withColumnRenamed("event_type", "kind").select("event_id", "user_id", "ts", "kind")
    stream, folder = _replayed(spark, rows, 4, True, True, "kind")
    return _streamed(S.without_echoes(stream, "60 days", F.col("kind") == "purchase", HOURS_US // 1000, ("user_id",)), folder).select("event_id", "user_id")


@query("SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS frame_start, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def scroll_stream(spark, d):
    """Frames closed by event time."""
    stream, folder = _replayed(spark, _timed(spark, d).select("event_id", "user_id", "ts", "value", "event_type"), 4, True, True, "event_type")
    found = _streamed(S.coalesced_frames(stream, "60 days", "1 hour", "value", ("user_id",)).where(S.before_end("frame_start")), folder)
    return found.select("user_id", F.col("frame_start").cast("timestamp_ntz").alias("frame_start"), "value")


_SESSIONS = """SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events)
WHERE (following IS NULL OR following > ts + INTERVAL 6 HOUR)"""


def _saves(spark, d, end: bool) -> DataFrame:
    stream, folder = _replayed(spark, _timed(spark, d), 4, False, end, "event_type")
    saves = S.debounced_saves(stream, "0 seconds" if not end else "60 days", "6 hours", ("user_id",))
    return _streamed(saves.where(S.before_end()), folder).select("event_id", "user_id")


@query(_SESSIONS)
def debounce_sessions(spark, d):
    """The same saves by sessions of a stream with an end instead of a look at the next event; a gap equal to the threshold merges here."""
    return _saves(spark, d, True)


@query(f"{_SESSIONS} AND epoch_us(ts) + {HOURS_US} <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events)")
def debounce_cancelled(spark, d):
    """A stream that is torn down: saves that are still waiting then are lost."""
    return _saves(spark, d, False)


@query("""
SELECT event_id, user_id, ts FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events)
WHERE following >= ts + INTERVAL 6 HOUR""")
def debounce_teardown(spark, d):
    """The batch form of it: the last change of each key is never saved."""
    return E.debounce(table(spark, d, "events"), ["user_id"], ORDER, HOURS_US, flush_at_end=False).select("event_id", "user_id", "ts")
