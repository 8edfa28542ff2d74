"""Approximate nearest neighbours by an inverted multi-index: halves quantised apart, cells taken by summed distance, entries reranked exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quire.llm.common import forget, keep

#: Vectors the codebooks are fitted to, about: a sample by hash above that. Every vector is indexed.
SAMPLE = 20_000
#: Vectors of the sample that are searched in it, exactly and by cells, to find the share of vectors a query has to take,
#: and the part of their neighbours that must be among these.
TRIED, RECALL = 400, 0.94
#: A bucket is a run of first centroids, or a part of one that many vectors have. About so many buckets, of LEAST distinct vectors at least and
#: of MOST numbers at most, which is what a task holds while queries pass by.
BUCKETS, LEAST, MOST = 64, 1_024, 1 << 23
#: Queries looked up together. Queries, or vectors to place, and vectors of a bucket compared at a time, which stays in a core's cache.
TOGETHER, BLOCK, PIECE = 64, 128, 1_024
#: Vectors of a bucket, about, that are measured exactly at a time.
MANY = 4_096
#: Vectors of the sample for each centroid of a half, and centroids of a half at most. Fine halves make summed distances tell cells apart.
PER_CENTROID, MOST_CENTROIDS = 4, 2_048
ITERATIONS, SEED = 6, 3
#: Rows of a matrix of distances at a time.
CHUNK = 2_000
#: Relative error of distances by expanded squares, generously.
ERROR = 1e-11
#: Likewise in single precision, for each component: these distances only tell which vectors to measure.
SINGLE = 2.0**-22


def usable(vector: Column, size: int) -> Column:
    """Not null, of the table's dimension, finite in all components and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return F.coalesce((F.size(vector) == size) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(vectors: DataFrame, ids: int) -> DataFrame:
    """vector and ids, as a scratch table: the smallest ids, so many at most, of the rows that have it; more can't be among a query's nearest.

    Vectors of one id are told by their least and largest id. One that very many rows share is thinned out in salted parts first.
    """
    ends = keep(vectors.groupBy("vector").agg(F.min("vec_id").alias("low"), F.max("vec_id").alias("high")), "ends")
    alone = ends.where("low = high").select("vector", F.array("low").alias("ids"))
    shared = ends.where("low < high").select("vector")
    if shared.isEmpty():
        return alone
    salted = vectors.join(shared, "vector", "left_semi").withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    order = Window.partitionBy("vector", "_salt").orderBy("vec_id")
    least = salted.distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= ids)
    distinct = keep(alone.union(least.groupBy("vector").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, ids).alias("ids"))), "vectors")
    forget(ends)
    return distinct


def centroids(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means by Lloyd's steps from distinct rows of x."""
    x = np.unique(x, axis=0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ITERATIONS):
        at = nearest(x, c)
        order = np.argsort(at, kind="stable")
        some, first = np.unique(at[order], return_index=True)
        c[some] = np.add.reduceat(x[order], first) / np.diff(np.append(first, len(x)))[:, None]
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest row of c to each row of x. What rounding leaves in doubt is measured directly, so a vector has the same cell wherever it is looked at."""
    norms = (c * c).sum(1)
    at = np.zeros(len(x), np.int64)
    for low in range(0, len(x), BLOCK):
        some = x[low : low + BLOCK]
        far = norms / 2 - some @ c.T
        at[low : low + BLOCK] = far.argmin(1)
        close = far <= (far.min(1) + ERROR * ((some * some).sum(1) + norms.max()))[:, None]
        for row in np.flatnonzero(np.count_nonzero(close, axis=1) > 1):
            which = np.flatnonzero(close[row])
            at[low + row] = which[((c[which] - some[row]) ** 2).sum(1).argmin()]
    return at


class Cells:
    """The cells (a pair of centroids, one of each half) that hold vectors, in order of the first centroid, and how many each holds."""

    def __init__(self, cell: np.ndarray, counts: np.ndarray, width: int) -> None:
        order = np.argsort(cell)
        self.cell, self.counts = cell[order], counts[order]
        self.first, self.second = self.cell // width, self.cell % width

    def in_order(self, first: np.ndarray, second: np.ndarray, enough: int) -> np.ndarray:
        """Places of cells by summed distance of their halves, until they hold enough vectors."""
        order = np.argsort(first[self.first] + second[self.second], kind="stable")
        return order[: np.searchsorted(np.cumsum(self.counts[order]), enough) + 1]

    def reach(self, first: np.ndarray, second: np.ndarray, enough: int) -> float:
        """Summed distance of the last cell that is taken; infinite if all are."""
        taken = self.in_order(first, second, enough)
        return math.inf if len(taken) == len(self.cell) else first[self.first[taken[-1]]] + second[self.second[taken[-1]]]


def share_for(sample: np.ndarray, books: list[np.ndarray], half: int, k: int, recall: float) -> float:
    """Share of vectors, taken cell by cell, that holds a part recall of the k nearest neighbours of vectors of the sample within it."""
    if len(sample) <= k + 1:
        return 1.0
    at = [nearest(part, book) for part, book in zip((sample[:, :half], sample[:, half:]), books, strict=True)]
    queries = sample[:: max(1, len(sample) // TRIED)]
    places = []
    for low in range(0, len(queries), 50):
        q = queries[low : low + 50]
        far = squared(q, sample)
        true = np.argpartition(far, k, axis=1)[:, : k + 1]
        summed = squared(q[:, :half], books[0])[:, at[0]] + squared(q[:, half:], books[1])[:, at[1]]
        mine = np.take_along_axis(summed, true, 1)
        places.append(np.stack([np.searchsorted(np.sort(row), m, side="right") for row, m in zip(summed, mine, strict=True)]))
    own = np.sort(np.concatenate(places), axis=1)[:, 1:]  # but for the query itself, mostly the first
    return min(1.0, float(np.quantile(own, recall)) / len(sample))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, size)


def _vectors(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()).cast(kind))


def least(row: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest ids of each row, nearest first, ties to the smaller id; an id counts once, where it is nearest."""
    order = np.lexsort((far, ids, row))
    row, ids, far = row[order], ids[order], far[order]
    once = np.ones(len(row), bool)
    once[1:] = (np.diff(row) != 0) | (np.diff(ids) != 0)
    row, ids, far = row[once], ids[once], far[once]
    order = np.lexsort((ids, far, row))
    row, ids, far = row[order], ids[order], far[order]
    good = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[good], ids[good], far[good]


class Bucket:
    """The vectors of a bucket, with their cells and ids."""

    def __init__(self, batches: list[pa.RecordBatch], size: int) -> None:
        column = lambda name: [b.column(name) for b in batches]
        self.size = size
        self.first, self.second = (np.concatenate([c.to_numpy() for c in column(name)]) for name in ("first", "second"))
        self.wide = np.empty((len(self.first), size + 1))
        for low, c in zip(np.cumsum([0, *map(len, batches)]), column("vector"), strict=False):
            self.wide[low : low + len(c), :size] = _matrix(c, size)
        norms = np.square(self.wide[:, :size]).sum(1)
        self.wide[:, size], self.largest = -norms / 2, norms.max()
        with np.errstate(over="ignore"):
            self.narrow = self.wide.astype(np.float32)  # for numbers of usual size
        self.ids = np.concatenate([c.flatten().to_numpy() for c in column("ids")])
        self.times = np.concatenate([pc.list_value_length(c).to_numpy() for c in column("ids")])
        self.starts = np.cumsum(self.times) - self.times

    def nearest(self, ids: np.ndarray, q: np.ndarray, reach: np.ndarray, bound: np.ndarray, books: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of q, vec_ids and distances of each row's k nearest other ids, of the vectors whose cell's summed distance is within reach.

        bound: squared distance within which k others are known to be, or infinite.
        """
        half, low = self.size // 2, self.first.min()
        first, second = squared(q[:, :half], books[0][low : self.first.max() + 1]), squared(q[:, half:], books[1])
        norms, bound = (q * q).sum(1), bound.copy()
        error, wide, mine = ERROR * (norms + self.largest), np.hstack([q, np.ones((len(q), 1))]), self.wide
        rough = (self.size + 8) * SINGLE * (norms + self.largest)
        if 1e-20 < self.largest < 1e30 and norms.max() < 1e30 and (rough < bound / 1_000).all():
            error, wide, mine = rough, wide.astype(np.float32), self.narrow
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        limit, rows, places = None, [], []
        for at in range(0, len(mine), PIECE):
            if limit is None:
                limit = np.nextafter(((norms - bound) / 2 - error).astype(mine.dtype), mine.dtype.type(-math.inf))[:, None]
            close = wide @ mine[at : at + PIECE].T  # half of: q's square less the squared distance
            row, e = np.divmod(np.flatnonzero(close >= limit), close.shape[1])
            e += at
            taken = first[row, self.first[e] - low] + second[row, self.second[e]] <= reach[row]
            rows.append(row[taken])
            places.append(e[taken])
            if at + PIECE < len(mine) and sum(map(len, rows)) < MANY:
                continue
            row, e = np.concatenate(rows), np.concatenate(places)
            limit, rows, places = None, [], []
            far = np.zeros(len(row))
            for c in range(0, len(row), CHUNK):
                far[c : c + CHUNK] = np.sqrt(((self.wide[e[c : c + CHUNK], : self.size] - q[row[c : c + CHUNK]]) ** 2).sum(1))
            times = self.times[e]
            own = self.ids[np.repeat(self.starts[e] - np.cumsum(times) + times, times) + np.arange(times.sum())]
            row, far = np.repeat(row, times), np.repeat(far, times)
            others = own != ids[row]
            found = least(*(np.concatenate([old, new[others]]) for old, new in zip(found, (row, own, far), strict=True)), k)
            full = np.flatnonzero(found[0][k - 1 :] == found[0][: len(found[0]) - k + 1]) + k - 1 if len(found[0]) >= k else np.zeros(0, np.int64)
            bound[found[0][full]] = np.minimum(bound[found[0][full]], found[2][full] ** 2)
        return found


def nearest_neighbours(embeddings: DataFrame, every: int = 100, k: int = 10, share: float | None = None, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest found to each row whose vec_id is divisible by every.

    A query takes cells, nearest first, until they hold a share of the sample's distinct vectors, and every vector in a cell as near as the last: the
    share given, or else what a part recall of neighbours needs within the sample. Up to SAMPLE distinct vectors, the sample has them all. The driver
    holds the sample and its codebooks, and nothing that grows with the table.
    Candidates are all rows of another vec_id. Rows with a null vec_id, a vector that is null, zero, of another length than most or has null or
    non-finite components take no part; rows alike in vec_id and vector count once, and a vec_id with several vectors is as near as its nearest
    is to any of the query's. Fewer candidates than k are all returned, nearest first, ties to the smaller vec_id. Other columns are not
    read; without usable rows the result is empty.
    """
    spark = embeddings.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = embeddings.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).where("size > 0").orderBy(F.desc("n"), "size").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    size = sizes["size"]
    half = size // 2
    number, kind = ("float", pa.float32()) if isinstance(embeddings.schema["embedding"].dataType.elementType, FloatType) else ("double", pa.float64())
    rows = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), size)).select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{number}>").alias("vector"))
    distinct = distinct_vectors(rows, k + 1)
    total = distinct.count()
    if not total:
        return spark.createDataFrame([], schema)
    picked = distinct if total <= SAMPLE else distinct.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / total))
    drawn = picked.select("vector", F.col("ids")[0].alias("id")).toArrow().combine_chunks()  # bounded by SAMPLE
    sample, owner = _matrix(drawn.column(0).combine_chunks(), size), drawn.column(1).to_numpy()
    order = np.lexsort(sample.T)
    sample, owner = sample[order], owner[order]
    rng, k_cells = np.random.default_rng(SEED), min(MOST_CENTROIDS, max(8, len(sample) // PER_CENTROID))
    books = [centroids(part, k_cells, rng) for part in (sample[:, :half], sample[:, half:])]
    enough = math.ceil(len(sample) * (share_for(sample, books, half, k, recall) if share is None else share))
    first_of, second_of = nearest(sample[:, :half], books[0]), nearest(sample[:, half:], books[1])
    cells = Cells(*np.unique(first_of * len(books[1]) + second_of, return_counts=True), len(books[1]))

    # buckets as the sample fills them
    most = min(max(LEAST, total // BUCKETS), max(1, MOST // size))
    counts = np.bincount(first_of, minlength=len(books[0])) * (total / len(sample))
    parts = np.maximum(1, np.ceil(counts / most)).astype(np.int64)
    large = parts > 1
    bucket = np.unique(np.cumsum(np.where(large, 0, counts)) // most, return_inverse=True)[1]
    bucket[large] = bucket.max() + 1 + np.cumsum(parts[large]) - parts[large]
    held = np.repeat(np.arange(len(parts)), parts)  # first centroids of each bucket, by bucket
    holder = np.repeat(bucket, parts) + np.arange(len(held)) - np.repeat(np.cumsum(parts) - parts, parts)
    by_bucket = np.argsort(holder, kind="stable")
    held, (holder, begins) = held[by_bucket], np.unique(holder[by_bucket], return_index=True)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's bucket and cell."""
        for batch in batches:
            x = _matrix(batch.column(0), size)
            first, second = nearest(x[:, :half], books[0]), nearest(x[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first] + batch.column(2).to_numpy() % parts[first]), pa.array(first), pa.array(second), *batch.columns[:2]], ["bucket", "first", "second", "vector", "ids"])

    hashed = distinct.select("vector", "ids", F.xxhash64("vector").bitwiseAND(F.lit((1 << 62) - 1)).alias("_hash"))
    entries = hashed.mapInArrow(placed, f"bucket long, first long, second long, vector array<{number}>, ids array<long>").withColumn("asks", F.lit(False))
    slack = ERROR * max((b * b).sum(1).max() for b in (*books, sample))
    one = np.unique(owner, return_index=True)[1]  # vector for each id
    sample, owner, first_of, second_of = sample[one], owner[one], first_of[one], second_of[one]

    def lookups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for each bucket it touches, with its reach and, from the sample, a squared distance within which it has k neighbours."""
        for batch in batches:
            for start in range(0, len(batch), TOGETHER):
                part = batch.slice(start, TOGETHER)
                ids, x = part.column(0).to_numpy(), _matrix(part.column(1), size)
                error = 2 * (slack + ERROR * (x * x).sum(1))
                first, second = squared(x[:, :half], books[0]), squared(x[:, half:], books[1])
                reach = np.array([cells.reach(*pair, enough) for pair in zip(first, second, strict=True)])
                far = squared(x, sample)
                far[(first[:, first_of] + second[:, second_of] > reach[:, None]) | (owner == ids[:, None])] = math.inf
                bound = np.partition(far, k - 1, axis=1)[:, k - 1] + error if far.shape[1] >= k else np.full(len(x), math.inf)
                reach += error
                touched = np.logical_or.reduceat((first + second.min(1)[:, None] <= reach[:, None])[:, held], begins, axis=1)
                query, to = np.nonzero(touched)
                lot = max(1, (MOST >> 1) // size)
                for low in range(0, len(query), lot):
                    q, b = query[low : low + lot], holder[to[low : low + lot]]
                    yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(ids[q]), pa.array(reach[q]), pa.array(bound[q]), _vectors(x[q], kind)], ["bucket", "query_id", "reach", "bound", "vector"])

    queries = keep(rows.where(F.col("vec_id") % every == 0).distinct(), "queries")
    blocks = min(10_000, queries.count() // TOGETHER + 1)
    asked = queries.repartition(blocks, "vec_id").mapInArrow(lookups, f"bucket long, query_id long, reach double, bound double, vector array<{number}>").withColumn("asks", F.lit(True))

    def reranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's vectors come first and are held; queries pass by."""
        at, parts, vectors = None, [], None
        for batch in batches:
            bucket, asks = batch.column("bucket").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((np.diff(bucket) != 0) | (asks[1:] != asks[:-1])) + 1
            for low, high in zip([0, *cut], [*cut, len(batch)], strict=True):
                part = batch.slice(low, high - low)
                if not len(part):
                    continue
                if not asks[low]:
                    if bucket[low] != at:
                        at, parts, vectors = bucket[low], [], None
                    parts.append(part)
                elif bucket[low] == at:
                    if vectors is None:
                        vectors, parts = Bucket(parts, size), []
                    for start in range(0, len(part), BLOCK):
                        some = part.slice(start, BLOCK)
                        ids, reach, bound = (some.column(c).to_numpy() for c in ("query_id", "reach", "bound"))
                        row, near, far = vectors.nearest(ids, _matrix(some.column("vector"), size), reach, bound, books, k)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(near), pa.array(far)], ["query_id", "vec_id", "score"])

    met = entries.unionByName(asked, allowMissingColumns=True).repartition(len(holder), "bucket").sortWithinPartitions("bucket", "asks")
    near = met.mapInArrow(reranked, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
