"""A keyed table on a shared file system in buckets by hash of the key, with versions: a commit writes the rows that change, a read opens the buckets it needs.

    folder/
      data/<name>/bucket=<b>/*.parquet   rows of a commit, in the buckets that it touches
      versions/<n>.json                  for each bucket the folders under data that make it up, and notes

A version is there once its file is: it is written aside and renamed, which fails where another commit was first. A commit that fails before leaves
files that no version names, and readers keep the version that they began with until expire() deletes what is out of use.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new table. Their numbers, and nothing that grows with rows, reach the driver.
BUCKETS = 64
#: Commits that a bucket is read from at most before it is written whole.
COMMITS = 8
_AT = "_commit"


class CommitConflict(RuntimeError):
    """Another commit made the same version first."""


class BucketedTable:
    """Rows of one key each, by the commit that wrote them last."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: T.StructType, buckets: int = BUCKETS, commits: int = COMMITS) -> None:
        self.spark, self.folder, self.key, self.schema, self.commits = spark, folder.rstrip("/"), key, schema, commits
        self._jvm = spark.sparkContext._jvm
        self.buckets = self._manifest().get("buckets", buckets)

    # Files. ------------------------------------------------------------------------------------------------------------------

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        fs, path = self._fs(), self._path(name)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json") and n[0].isdigit())

    def version(self) -> int:
        """Number of the last commit, 0 for a new table."""
        return max(self.versions(), default=0)

    def _manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"parts": {}, "notes": {}}
        stream = self._fs().open(self._path(f"versions/{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        fs, aside, final = self._fs(), self._path(f"versions/_{uuid.uuid4().hex}"), self._path(f"versions/{version}.json")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(manifest), "utf-8"))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(aside, final, options)  # fails where the version is there
        except Exception as error:
            fs.delete(aside, False)
            if fs.exists(final):
                raise CommitConflict(f"version {version} of {self.folder} is there already") from error
            raise

    # Reads. ------------------------------------------------------------------------------------------------------------------

    def bucket(self, key: Column | None = None) -> Column:
        """The bucket of a key; a null key has one too."""
        key = F.col(f"`{self.key}`") if key is None else key
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, key: str | None = None) -> list[int]:
        """The buckets that rows' keys are in; at most all of them reach the driver."""
        return sorted(r[0] for r in rows.select(self.bucket(F.col(f"`{key or self.key}`"))).distinct().collect())

    def rows(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """All rows, or those of some buckets; only their files are opened. Where no bucket has several commits, rows come as they are, unshuffled."""
        parts = self._manifest(version)["parts"]
        chosen = {b: names for b, names in parts.items() if buckets is None or int(b) in set(buckets)}
        paths = [f"{self.folder}/data/{name}/bucket={b}" for b, names in chosen.items() for name in names]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(T.StructType([*self.schema, T.StructField(_AT, T.LongType())])).parquet(*paths)
        if all(len(names) == 1 for names in chosen.values()):
            return found.drop(_AT)
        last = F.max_by(F.struct(*(f"`{c}`" for c in self.schema.fieldNames())), _AT).alias("_last")
        return found.groupBy(F.col(f"`{self.key}`").alias("_of")).agg(last).select("_last.*")

    def having(self, rows: DataFrame, key: str | None = None, version: int | None = None) -> DataFrame:
        """The table's rows of the keys that rows have; only the buckets of these are opened."""
        asked = rows.select(F.col(f"`{key or self.key}`").alias("_asked")).distinct()
        found = self.rows(self.touched(rows, key), version)
        return found.join(asked, F.col(f"`{self.key}`").eqNullSafe(F.col("_asked")), "left_semi")

    def notes(self) -> dict:
        """What the last commit noted."""
        return self._manifest()["notes"]

    # Writes. -----------------------------------------------------------------------------------------------------------------

    def commit(self, rows: DataFrame, notes: dict | None = None, base: int | None = None) -> int:
        """Write rows, one for each of their keys, in place of those of equal keys or beside them; the new version's number.

        What is written is rows, and whole buckets that were in as many commits as they may be. notes replace those of the last commit where given.
        base: the version that rows were made from, the last one by default; if there is a later one, the commit fails and has to be made anew.
        """
        base = self.version() if base is None else base
        old, version = self._manifest(base), base + 1
        full = [int(b) for b, names in old["parts"].items() if len(names) >= self.commits]
        new = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema)).withColumn("bucket", self.bucket())
        name = f"{version}-{uuid.uuid4().hex[:8]}"
        path = f"{self.folder}/data/{name}"
        new.withColumn(_AT, F.lit(version).cast("long")).repartition("bucket").write.partitionBy("bucket").parquet(path)
        written = {int(n.removeprefix("bucket=")) for n in self._names(f"data/{name}") if n.startswith("bucket=")}
        parts = {int(b): names for b, names in old["parts"].items()}
        whole = sorted(written & set(full))
        for b in written:
            parts[b] = [*parts.get(b, []), name]
        if whole:
            self._whole(parts, whole, version)
        kept = {"buckets": self.buckets, "parts": {str(b): parts[b] for b in sorted(parts)}, "notes": old["notes"] | (notes or {})}
        self._publish(version, kept)
        return version

    def _whole(self, parts: dict[int, list[str]], buckets: list[int], version: int) -> None:
        """Write some buckets whole; parts then names only that."""
        name = f"{version}-{uuid.uuid4().hex[:8]}"
        paths = [f"{self.folder}/data/{n}/bucket={b}" for b in buckets for n in parts[b]]
        found = self.spark.read.schema(T.StructType([*self.schema, T.StructField(_AT, T.LongType())])).parquet(*paths)
        last = F.max_by(F.struct("*"), _AT).alias("_last")
        rows = found.groupBy(F.col(f"`{self.key}`").alias("_of")).agg(last).select("_last.*")
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/data/{name}")
        for b in buckets:
            parts[b] = [name]

    def upsert(self, incoming: DataFrame, notes: dict | None = None) -> int:
        """Incoming rows, with all columns and one for each key, replace those of equal key or are added."""
        return self.commit(incoming, notes)

    def update(self, updates: DataFrame, columns: list[str], notes: dict | None = None) -> int:
        """The given columns of rows that updates names; keys that the table does not have are ignored."""
        base = self.version()
        new = updates.select(F.col(f"`{self.key}`").alias("_of"), *(F.col(f"`{c}`").alias(f"_new_{c}") for c in columns))
        joined = self.rows(self.touched(updates), base).join(new, F.col(f"`{self.key}`").eqNullSafe(F.col("_of")))
        return self.commit(joined.select(*(F.col(f"_new_{c}" if c in columns else f"`{c}`").alias(c) for c in self.schema.fieldNames())), notes, base)

    def expire(self, keep: int = 2) -> None:
        """Delete all but the last versions, and data that these do not name. No commit may run beside it."""
        versions = self.versions()
        named = {n for v in versions[-keep:] for names in self._manifest(v)["parts"].values() for n in names}
        fs = self._fs()
        for v in versions[:-keep]:
            fs.delete(self._path(f"versions/{v}.json"), False)
        for name in self._names("data"):
            if name not in named:
                fs.delete(self._path(f"data/{name}"), True)
