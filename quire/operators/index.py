"""Layouts that let a read skip most files: posting lists of runs of characters for searches, and files in order of time for the recent list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.paths import trim_space
from quire.operators.library import recent, search
from quire.schemas import RECENT

#: Length of the runs of characters that are indexed; shorter needles have their own.
GRAM = 3
#: Folders that postings are dealt to by hash of the run.
SHELVES = 256


def searched_text(title: str, path: str) -> Column:
    """What a search looks at: title and path, joined by a space, in lower case."""
    return F.lower(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" "), F.coalesce(F.col(path), F.lit(""))))


def grams(text: Column, size: int) -> Column:
    """All runs of size characters of a text, each once."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    starts = F.sequence(F.lit(0), F.size(chars) - size)
    runs = F.transform(starts, lambda i: F.concat(*(F.get(chars, i + k) for k in range(size))))
    return F.when(F.size(chars) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def shelf(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(SHELVES)).cast("int")


@dataclass
class TextIndex:
    """Postings of a table with a key for each row, in a folder."""

    spark: SparkSession
    folder: str
    key: str
    title: str
    path: str

    def build(self, rows: DataFrame) -> None:
        """Write (run, key) for all runs of one to three characters. A run that a third of all rows have is spread over files by key, since rows are
        dealt out by both; within a file runs are sorted, so that footers tell which files and pages can hold one."""
        text = searched_text(self.title, self.path)
        every = F.concat(*(grams(text, n) for n in range(1, GRAM + 1)))
        postings = rows.select(F.explode(every).alias("gram"), F.col(f"`{self.key}`").alias("key"))
        placed = postings.withColumn("shelf", shelf(F.col("gram"))).withColumn("_lot", F.pmod(F.xxhash64("key"), F.lit(4)))
        placed.repartition("shelf", "_lot").drop("_lot").sortWithinPartitions("shelf", "gram", "key").write.partitionBy("shelf").parquet(self.folder)

    def wanted(self, query: str) -> list[str]:
        """The runs that a row has to have to hold the query, which is trimmed and in lower case."""
        needle = self.spark.range(1).select(F.lower(trim_space(F.lit(query)))).first()[0]
        size = min(GRAM, len(needle))
        return sorted({needle[i : i + size] for i in range(len(needle) - size + 1)}) if needle else []

    def postings(self, runs: list[str]) -> DataFrame:
        """The index's rows of some runs: shelves are pruned, then files by footers."""
        shelves = [r[0] for r in self.spark.createDataFrame([(r,) for r in runs], "gram string").select(shelf(F.col("gram"))).distinct().collect()]
        return self.spark.read.parquet(self.folder).where(F.col("shelf").isin(shelves) & F.col("gram").isin(runs))

    def search(self, rows: DataFrame, query: str) -> DataFrame:
        """rows as search() finds them: those with all runs of the query, looked at literally. A blank query keeps all."""
        runs = self.wanted(query)
        if not runs:
            return rows
        found = self.postings(runs).groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") == len(runs)).select(F.col("key").alias("_hit"))
        return search(rows.join(found, F.col(f"`{self.key}`").eqNullSafe(F.col("_hit")), "left_semi"), query, self.title, self.path)


def lay_out_by_time(rows: DataFrame, folder: str, opened: str, key: str, files: int = 32) -> None:
    """Write rows in files that each hold a range of times, newest first within a file; beside them, from when to when each file is and how many rows it has."""
    ordered = rows.repartitionByRange(files, F.desc(opened), key).sortWithinPartitions(F.desc(opened), key)
    ordered.write.parquet(f"{folder}/rows")
    spark = rows.sparkSession
    written = spark.read.parquet(f"{folder}/rows").select(F.col("_metadata.file_path").alias("file"), F.col(opened).alias("opened"))
    written.groupBy("file").agg(F.min("opened").alias("least"), F.max("opened").alias("most"), F.count("*").alias("n")).coalesce(1).write.parquet(f"{folder}/files")


def recent_from_layout(spark: SparkSession, folder: str, opened: str, key: str, n: int = RECENT) -> DataFrame:
    """The recent list from a table laid out by time: only files that can hold one of the n newest rows are opened.

    Files from the newest on are taken until they hold n rows; the least time among these bounds the list, and every file that reaches up to it is
    read. Only names of such files reach the driver. Rows without a time are last and are only read where there are fewer than n others.
    """
    files = spark.read.parquet(f"{folder}/files")
    left, least = n, []
    for file in files.orderBy(F.desc_nulls_last("least"), "file").limit(n).collect():  # each has a row at least
        if left > 0:
            left -= file["n"]
            least.append(file["least"])
    chosen = files if left > 0 or None in least else files.where(F.col("most") >= F.lit(min(least)))
    names = [r["file"] for r in chosen.select("file").collect()]
    whole = spark.read.parquet(f"{folder}/rows")
    return recent(spark.read.schema(whole.schema).parquet(*names) if names else whole, opened, key, n)
