"""View events as streams: states folded batch by batch into a bucketed table, and echoes, frames and saves by event time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quire.operators.events import STATE, fold_panes, release
from quire.operators.library import partial_update, recent
from quire.schemas import DEBOUNCE_MS, ECHO_MS, RECENT
from quire.sources.buckets import BUCKETS, COMMITS, BucketedTable


def state_table(spark: SparkSession, folder: str, kind: str = "string", buckets: int = BUCKETS, commits: int = COMMITS) -> BucketedTable:
    """States by document."""
    return BucketedTable(spark, folder, "doc_id", T.StructType.fromDDL(f"doc_id {kind}, state {STATE}"), buckets, commits)


def states(spark: SparkSession, folder: str, kind: str = "string") -> DataFrame:
    """doc_id and state after all batches."""
    return state_table(spark, folder, kind).rows()


def fold_stream(events: DataFrame, folder: str, checkpoint: str, page_count: int | Column, available_now: bool = True, buckets: int = BUCKETS, commits: int = COMMITS, after=None) -> StreamingQuery:
    """Fold a stream of events into states: each batch opens the buckets that hold its documents, folds its events from there and commits these states alone.

    The fold is the batch one. The number of a batch is noted with its commit, so one that is repeated after a failure is not folded twice. Events are
    folded in order within a batch; batches are folded as they arrive. after: called with (states, batch number) once a batch is committed.
    """
    kind = events.schema["doc_id"].dataType.simpleString()

    def step(batch: DataFrame, number: int) -> None:
        table = state_table(batch.sparkSession, folder, kind, buckets, commits)
        if table.notes().get("batch", -1) < number:
            base = table.version()
            folded = fold_panes(batch, page_count if isinstance(page_count, Column) else F.lit(page_count), "doc_id", table.having(batch, version=base))
            table.commit(folded, {"batch": number}, base)
            release(folded)
        if after is not None:
            after(table.rows(), number)

    writer = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


#: An event that says that no more follow; its time lets every watermark pass.
END, END_TIME = "end of stream", datetime(9000, 1, 1)


def end_stream(spark: SparkSession, schema: T.StructType, folder: str, kind: str = "kind", ts: str = "ts") -> None:
    """Append an end to a folder of event files that streams read. Windows and sessions that are still open close then; without it they stay open."""
    row = {f.name: END if f.name == kind else END_TIME if f.name == ts else None for f in schema}
    spark.createDataFrame([tuple(row.values())], schema).coalesce(1).write.mode("append").parquet(folder)


def before_end(ts: str = "ts") -> Column:
    """Whether a row is no end. It asks for the time and not for the kind, since the optimizer would take an end out before its time reached the watermark."""
    return F.col(ts) < F.lit(END_TIME).cast("timestamp")


def without_echoes(events: DataFrame, late: str, applies: Column | None = None, within_ms: int = ECHO_MS, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Events that do not follow an apply of their key within a time, whatever order they arrive in; applies are left out.

    An event waits until the watermark is past it, since its apply may come later; applies are kept as long as an event could follow them. Both are
    dropped then, so state is as long as late and the guard. The end of the stream is no event.
    """
    applies = F.coalesce(F.col("kind") == "apply" if applies is None else applies, F.lit(False))
    ends = F.coalesce(F.col("kind") == END, F.lit(False))  # on both sides, so that both watermarks pass
    mine = events.where(~applies | ends).withWatermark("ts", late)
    guards = events.where(applies | ends).select(*(F.col(k).alias(f"_g_{k}") for k in keys), F.col("ts").alias("_g_ts"), F.col("event_id").alias("_g_id")).withWatermark("_g_ts", late)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    earlier = (F.col("_g_ts") < F.col("ts")) | ((F.col("_g_ts") == F.col("ts")) & (F.col("_g_id") < F.col("event_id")))
    near = (F.col("_g_ts") <= F.col("ts")) & (F.col("_g_ts") >= F.col("ts") - F.expr(f"INTERVAL {within_ms} MILLISECONDS"))
    joined = mine.join(guards, same & near & earlier, "left_outer")
    return joined.where(F.col("_g_ts").isNull() & before_end()).select(*events.columns)


def coalesced_frames(events: DataFrame, late: str, frame: str, value: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The last value of each frame of time, once the watermark is past it. Rows that come later are not looked at; late_rows counts them."""
    last = F.max_by(F.col(value), F.struct("ts", "event_id")).alias(value)
    frames = events.withWatermark("ts", late).groupBy(*keys, F.window("ts", frame).alias("_frame")).agg(last)
    return frames.select(*keys, F.col("_frame.start").alias("frame_start"), value)


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's batches so far dropped because the watermark was past them."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def debounced_saves(events: DataFrame, late: str, gap: str = f"{DEBOUNCE_MS} milliseconds", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The last event of each session of a key, once the watermark is past the gap. Sessions that are open when the stream ends are saved if it has an end
    (end_stream), else they are lost, as changes are that a teardown cancels."""
    last = F.max_by(F.struct("*"), F.struct("ts", "event_id")).alias("_last")
    sessions = events.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap).alias("_session"))
    return sessions.agg(last).select("_last.*")


def save_views(library: DataFrame, states_: DataFrame, now) -> DataFrame:
    """library with the original pane's view, split mode and sync of states; both times become now."""
    view = states_.select(F.col("doc_id").alias("id"), "state.original.*", F.col("state.split").alias("split_mode"), F.col("state.sync").alias("sync_enabled"))
    stamped = view.withColumn("last_opened_at", now).withColumn("updated_at", now)
    return partial_update(library, stamped, [c for c in stamped.columns if c != "id"])


def recent_after(library: DataFrame, states_: DataFrame, now, n: int = RECENT) -> DataFrame:
    """The recent list as it is after the views have been saved."""
    return recent(save_views(library, states_, now), "last_opened_at", "id", n)
