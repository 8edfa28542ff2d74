"""The library of documents: lookups, the recent list, upserts and updates, as joins over whole tables.

Update batches may be as large as the table, so no side is broadcast by hand; the optimizer does so when it knows that one is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.labels import empty_label
from quire.functions.normalize import merge_view
from quire.functions.paths import trim_space
from quire.schemas import DEFAULT_SPLIT, DEFAULT_SYNC, DEFAULT_VIEW, RECENT, VIEW_STATE

VIEW = VIEW_STATE.fieldNames()


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key. Rows are thinned out before they are shuffled, so a hot key costs a row per task."""
    newest = F.max_by(F.struct("*"), F.struct(*order)).alias("_last")
    return rows.groupBy(F.col(key).alias("_key")).agg(newest).select("_last.*")


def recent(rows: DataFrame, opened: str, key: str, n: int = RECENT) -> DataFrame:
    """The n rows opened last, newest first; ties by key."""
    return rows.orderBy(F.desc(opened), key).limit(n)


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none."""
    return rows.where(F.col(key) == value).limit(1)


def search(rows: DataFrame, query: str, title: str = "title", path: str = "file_path") -> DataFrame:
    """Rows whose title and path, joined by a space, contain the query whatever its case; a blank query keeps all. A null counts as empty."""
    needle = F.lower(trim_space(F.lit(query)))
    both = F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(path), F.lit("")))
    return rows.where(F.contains(F.lower(both), needle))


def recent_summary(rows: DataFrame, query: str, title: str = "title", path: str = "file_path") -> DataFrame:
    """n_recent, n_found and message: the badge counts the whole list, the message is about what the search left."""
    total = rows.agg(F.count("*").alias("n_recent"))
    found = search(rows, query, title, path).agg(F.count("*").alias("n_found"))
    return total.join(found).withColumn("message", empty_label(F.col("n_found"), F.lit(query)))


def nest(rows: DataFrame) -> DataFrame:
    """Flat library rows as records with a view_state."""
    view = F.struct(*(F.col(c) for c in VIEW)).alias("view_state")
    return rows.select("id", "file_path", "title", "page_count", "last_opened_at", view, "split_mode", (F.col("sync_enabled").cast("int") != 0).alias("sync_enabled"))


def flatten(records: DataFrame) -> DataFrame:
    """Records as flat rows; sync_enabled as 0 or 1."""
    return records.select("id", "file_path", "title", "page_count", "last_opened_at", "view_state.*", "split_mode", F.col("sync_enabled").cast("int").alias("sync_enabled"))


def _default(name: str) -> Column:
    return F.lit(DEFAULT_VIEW[name])


def with_previous(opened: DataFrame, library: DataFrame, key: str = "id") -> DataFrame:
    """Opened documents with the view they were left in, or the default one. The view is taken as it was saved."""
    before = library.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in (*VIEW, "split_mode", "sync_enabled")))
    joined = opened.join(before, opened[key] == before._key, "left")
    view = [F.coalesce(f"_{c}", _default(c)).alias(c) for c in VIEW]
    return joined.select(*opened.columns, *view, F.coalesce("_split_mode", F.lit(DEFAULT_SPLIT)).alias("split_mode"), F.coalesce("_sync_enabled", F.lit(DEFAULT_SYNC)).alias("sync_enabled"))


def restore(opened: DataFrame) -> DataFrame:
    """Both panes' views after a document is opened: the saved one normalized to its pages."""
    current = F.struct(*(_default(c).alias(c) for c in VIEW))
    merged = merge_view(current, {c: F.col(c) for c in VIEW}, F.col("page_count"))
    return opened.withColumn("original", merged).withColumn("companion", F.col("original")).withColumn("active", F.lit("original"))


def upsert(library: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """library with incoming rows in place of those of equal key, or added. incoming has one row per key."""
    columns = [c for c in library.columns if c != key]
    new = incoming.select(F.col(key).alias("_key"), F.struct(*columns).alias("_new"))
    joined = library.join(new, library[key] == new._key, "full")
    pick = [F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(library[c]).alias(c) for c in columns]
    return joined.select(F.coalesce("_key", library[key]).alias(key), *pick).select(library.columns)


def partial_update(library: DataFrame, updates: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """library with the given columns of rows that updates names; keys it does not have are ignored."""
    new = updates.select(F.col(key).alias("_key"), F.struct(*columns).alias("_new"))
    joined = library.join(new, library[key] == new._key, "left")
    return joined.select(*(F.when(F.col("_key").isNotNull(), F.col("_new")[c]).otherwise(library[c]).alias(c) if c in columns else library[c] for c in library.columns))


def move_to_front(store: DataFrame, opened: DataFrame, key: str = "id") -> DataFrame:
    """A list by position with one opened row put first, in place of an older one of its key."""
    kept = store.join(opened.select(key), key, "left_anti").withColumn("position", F.col("position") + 1)
    return opened.withColumn("position", F.lit(0).cast("bigint")).unionByName(kept.select(*opened.columns, "position"))


def renumber(store: DataFrame, n: int = RECENT) -> DataFrame:
    """The first n rows of a list by position, numbered from 0; the rest is gone. Only n rows are numbered."""
    first = store.orderBy("position").limit(n)
    return first.withColumn("position", (F.row_number().over(Window.orderBy("position")) - 1).cast("bigint"))
