"""What the corpus operators share: reads, and ranks that spread hot keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.scratch import drop_scratch, forget, keep, scratch_dir

__all__ = ["WORD", "bits_for", "drop_scratch", "forget", "keep", "numbered", "one_of_alike", "read", "scratch_dir", "spread_rank"]

#: A word: anything between the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bits_for(rows: int, target: int = 20_000) -> int:
    """Bits of a uniform hash that cut rows into pieces of about target rows each, 3 at least and 24 at most."""
    return min(24, max(3, math.ceil(math.log2(max(rows, 1) / target)) if rows > target else 3))


def spread_rank(df: DataFrame, keys: list[str], by: str, to: str, bits: int, ties: list[Column] | None = None, extra: DataFrame | None = None) -> DataFrame:
    """Add to, the rank from 0 of each row among the rows of its keys, ordered by the uniform long column by.

    A key's rows need not meet in a task: by is cut into 2**bits ranges, rows are ranked within (keys, range) and the
    ranges' counts, summed up in order, are added. keys must not be null. extra: a table with one row for each keys
    whose other columns are added too.
    """
    cut = df.withColumn("_range", F.shiftright(by, 64 - bits))
    counts = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if extra is not None:
        offsets = offsets.join(extra, keys)
    within = Window.partitionBy(*keys, "_range").orderBy(by, *(ties or []))
    return cut.join(offsets, [*keys, "_range"]).withColumn(to, F.col("_before") + F.row_number().over(within) - 1).drop("_range", "_before")


#: Rows alike that are written out one after the other.
LOT = 10_000


def numbered(df: DataFrame, to: str = "_nth") -> DataFrame:
    """df with to, which numbers rows alike in all columns from 0. They are counted before they are written out again, so they never meet in a sort."""
    counted = df.groupBy(*(F.col(f"`{c}`") for c in df.columns)).agg(F.count("*").alias("_rows"))
    lots = counted.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_rows") - 1) / LOT))))
    last = F.least(F.col("_rows"), (F.col("_lot") + 1) * LOT) - 1
    return lots.withColumn(to, F.explode(F.sequence(F.col("_lot") * LOT, last))).drop("_rows", "_lot")


def one_of_alike(rows: DataFrame, keys: list[str], row: str) -> DataFrame:
    """For each keys one of the structs row: the least by its hash, so that a rerun takes the same."""
    return rows.groupBy(*keys).agg(F.min_by(row, F.struct(F.xxhash64(row), F.xxhash64(F.lit(1), row))).alias(row))
