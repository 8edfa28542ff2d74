"""Compressed vectors: each part of a vector becomes the number of the nearest entry of that part's codebook.

The nearest entry is found by annular pruning. Entries are sorted by norm. With a distance d to some entry, nearer ones have a norm within d of the
vector's, so two binary searches give the interval that may hold them; it is taken with both ends, and only its entries are evaluated, exactly, in
whole numbers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import keep

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Scaled components are exact below this and held at it beyond; errors that no long holds are given as the largest one.
MOST, LARGEST = 1 << 62, (1 << 63) - 1
#: Largest scaled component for which a part's squared distances fit 64 bits, for parts of up to 1,024 components; others use Python's integers.
PLAIN = 1 << 25
#: Entries next to a vector by norm that give the first distance.
PROBES = 4
#: Vectors that are looked at together.
BLOCK = 4096


def finite_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there and has neither null nor NaN nor infinite components."""
    good = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return rows.where(F.col(f"`{vector}`").isNotNull() & F.forall(f"`{vector}`", good))


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each: 64-bit integers, or Python's where these are too small for squared distances."""
    values = values.astype(np.float64)
    if not values.size or np.abs(values).max() * scale < PLAIN:
        return np.floor(values * scale).astype(np.int64)
    whole = lambda x: math.floor(x) * scale if abs(x) >= 1 << 52 else math.floor(x * scale)
    return np.array([max(-MOST, min(MOST, whole(x))) for x in values.ravel().tolist()], object).reshape(values.shape)


def squared(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=-1)


class Annuli:
    """One part's entries sorted by norm."""

    def __init__(self, entries: np.ndarray) -> None:
        norms = np.sqrt(squared(entries).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], entries[self.order]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest entry of each vector (of equally near ones the first), its squared distance, and how many distances were taken."""
        n, k = len(vectors), len(self.order)
        norms = np.sqrt(squared(vectors).astype(np.float64))
        first = np.clip(np.searchsorted(self.norms, norms) - PROBES // 2, 0, max(k - PROBES, 0))
        best = np.stack([squared(vectors - self.entries[first + i]) for i in range(min(PROBES, k))]).min(axis=0)
        radius = np.sqrt(best.astype(np.float64))
        slack = 1e-9 * (radius + norms) + 1e-9  # over the rounding of both norms and of the radius, so that no end is lost
        low = np.searchsorted(self.norms, norms - radius - slack, side="left")
        high = np.searchsorted(self.norms, norms + radius + slack, side="right")
        wide = high - low
        ends = np.cumsum(wide)
        row = np.repeat(np.arange(n), wide)
        at = np.arange(ends[-1] if n else 0) - np.repeat(ends - wide - low, wide)
        distance = squared(vectors[row] - self.entries[at])
        least = np.minimum.reduceat(distance, ends - wide) if n else distance
        number = np.where(distance == least[row], self.order[at], k)
        return (np.minimum.reduceat(number, ends - wide) if n else number.astype(np.int64)), least, len(at)


@dataclass
class Codebooks:
    """entries[p]: integers of part p's codebook, a row for each entry."""

    entries: list[np.ndarray]
    scale: int = SCALE

    @property
    def width(self) -> int:
        return sum(e.shape[1] for e in self.entries)

    def numbers(self) -> str:
        """All components by part, entry and position, with commas."""
        return ",".join(str(int(x)) for e in self.entries for x in e.ravel())

    def digest(self) -> str:
        return hashlib.sha256(self.numbers().encode()).hexdigest()

    def parts(self, vectors: np.ndarray) -> list[np.ndarray]:
        return np.split(vectors, len(self.entries), axis=1)


def vectors_of(column: pa.Array, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of lists with width components (None: all must be alike), and these as a table of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes[0]) if width is None and len(sizes) else width
    fits = np.flatnonzero(sizes == width)
    flat = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
    return fits, flat.astype(np.float64).reshape(len(fits), width or 0)


def first_vectors(rows: DataFrame, n: int, parts: int, key: str = "vec_id", vector: str = "embedding") -> list[list[float]]:
    """Vectors of the n smallest keys, ascending; of repeated keys the least vector. Each partition looks for its own n, and no vector is shuffled but these."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, list[float]] = {}
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            bound = np.partition(np.unique(keys), n - 1)[n - 1] if len(np.unique(keys)) > n else None
            chosen = np.arange(len(keys)) if bound is None else np.flatnonzero(keys <= bound)
            for at in chosen.tolist():
                value = batch.column(1)[at].as_py()
                if len(value) % parts:
                    continue
                have[keys[at]] = min(have.get(keys[at], value), value)
            have = {k: have[k] for k in sorted(have)[:n]}
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int64()), pa.array(list(have.values()), pa.list_(pa.float64()))], ["key", "vector"])

    some = rows.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector")).where("key is not null")
    found = some.mapInArrow(smallest, "key long, vector array<double>").groupBy("key").agg(F.min("vector").alias("vector"))
    return [r["vector"] for r in found.orderBy("key").limit(n).collect()]


def train_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding") -> Codebooks | None:
    """Codebooks from the parts of the vectors of the smallest keys, after some rounds of assigning all vectors and moving entries to floored means.

    Entries that no part is assigned to stay. Sums are taken in the tasks, and only a row for each part and entry reaches the driver. The vector of
    the smallest key gives the length, a multiple of parts; vectors of another length take no part. None where no vector is left.
    """
    seeds = first_vectors(rows, entries, parts, key, vector)
    if not seeds:
        return None
    width = len(seeds[0])
    books = Codebooks(np.split(scaled(np.array([s for s in seeds if len(s) == width])), parts, axis=1))
    for _ in range(rounds):
        sums = rows.select(F.col(f"`{vector}`").alias("vector")).mapInArrow(_sums(books), "part int, entry int, place int, total decimal(38,0), n long")
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # parts * entries * positions at most
            moved = int(r["total"]) // r["n"]
            book = books.entries[r["part"]]
            if abs(moved) >= PLAIN and book.dtype != object:
                books.entries[r["part"]] = book = book.astype(object)
            book[r["entry"], r["place"]] = moved
    return books


def _sums(books: Codebooks):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(e.shape, object) for e in books.entries]
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        annuli = [Annuli(e) for e in books.entries]
        for batch in batches:
            for vectors in _blocks(batch.column(0), books.width):
                for p, part in enumerate(books.parts(scaled(vectors, books.scale))):
                    number, _, _ = annuli[p].nearest(part)
                    counts[p] += np.bincount(number, minlength=len(counts[p]))
                    order = np.argsort(number, kind="stable")
                    at = np.flatnonzero(np.diff(number[order], prepend=-1))
                    totals[p][number[order][at]] += np.add.reduceat(part[order], at, axis=0).astype(object)  # a block's sums fit 64 bits
        rows = [(p, e, i, t, int(counts[p][e])) for p in range(len(totals)) for e in np.flatnonzero(counts[p]).tolist() for i, t in enumerate(totals[p][e])]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array([int(x) for x in c], k) for c, k in zip(columns, kinds, strict=True)], ["part", "entry", "place", "total", "n"])

    return add


def _blocks(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for start in range(0, len(column), BLOCK):
        _, vectors = vectors_of(column.slice(start, BLOCK), width)
        if len(vectors):
            yield vectors


def encode(rows: DataFrame, books: Codebooks, key: str = "vec_id", vector: str = "embedding", carry: dict[str, Column] | None = None) -> DataFrame:
    """key, the carried columns, code (two hexadecimal digits a part) and error, the squared distances of all parts to their entries."""
    carry = carry or {}
    some = rows.select(F.col(f"`{vector}`").alias("vector"), F.col(f"`{key}`").cast("long").alias("vec_id"), *(c.alias(n) for n, c in carry.items()))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema[1:])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(e) for e in books.entries]
        digits = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                at, vectors = vectors_of(part.column(0), books.width)
                codes, error = np.full(len(at), "", f"<U{2 * len(annuli)}"), np.zeros(len(at), object)
                for annulus, values in zip(annuli, books.parts(scaled(vectors, books.scale)), strict=True):
                    number, distance, _ = annulus.nearest(values)
                    codes, error = np.char.add(codes, digits[number]), error + distance.astype(object)
                others = part.take(pa.array(at)).columns[1:]
                held = pa.array([min(int(e), LARGEST) for e in error], pa.int64())
                yield pa.RecordBatch.from_arrays([*others, pa.array(codes.tolist(), pa.string()), held], [*part.schema.names[1:], "code", "error"])

    return some.mapInArrow(code, f"{kinds}, code string, error long")


def decode(codes: DataFrame, books: Codebooks, code: str = "code", to: str = "vector") -> DataFrame:
    """codes with, for each, the vector of its entries, unscaled to the middle of their steps."""
    tables = [F.array(*(F.array(*(F.lit((float(x) + 0.5) / books.scale) for x in e)) for e in part)) for part in books.entries]
    numbers = [F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int") for p in range(len(tables))]
    return codes.withColumn(to, F.flatten(F.array(*(F.get(t, n) for t, n in zip(tables, numbers, strict=True)))))


def compress_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each row with a finite vector.

    label_error sums errors over equal labels, nulls together. Repeated rows are coded each; a null vec_id is coded and counted, but seeds no codebook.
    With fewer than 64 keys codebooks have fewer entries. Vectors of another length than that of the smallest vec_id are left out, as are those whose
    length is no multiple of 16; without vectors there are no rows. Other columns are not read.
    """
    good = finite_vectors(rows.select("vec_id", "embedding", F.col("label")))
    books = train_codebooks(good)
    if books is None:
        return good.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = keep(encode(good, books, carry={"label": F.col("label")}), "codes")
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
