"""Audit of filters that interact: what each removes in every order, and what it would have removed had others not come first.

Documents are routed by a fingerprint of their text. A task keeps, for a fingerprint, a chain of the different texts that have it, each in full
with its least id, and emits every row as the first of its text or as a copy. Rows then are a mask of five filters each, and counts of masks
by part of the corpus, merged as vectors, say all about all orders.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: Bit of a document that is a copy of one of smaller id.
COPY = 1 << FILTERS.index("E")
#: Texts, in bytes as they are kept, that a task remembers before it passes them on.
REMEMBERED = 48 << 20
#: Bytes of texts for each partition that they are routed to; nothing adapts these at runtime.
PARTITION = 128 << 20
#: Groups of input partitions whose copies of a text that is frequent in each meet first.
LANES = 32
_UPPER, _SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: str) -> int:
    """Bits of the filters A to D that a text fails: few words, repeated words, capitals, signs."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at the six ASCII white space characters
    capitals = len(data) - len(data.translate(None, _UPPER))
    fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * len(text), len(data.translate(None, _SIGNS)) < len(data))
    return sum(1 << k for k, failed in enumerate(fails) if failed)


class Chains:
    """For each fingerprint the different texts that have it, in full, each with its least id and the rows of that id.

    A row is (id, part, mask); rows alike are counted. add() and emit() return rows known to be copies, since a smaller id has their text.
    """

    def __init__(self) -> None:
        self.of: dict[int, list[list]] = {}
        self.size = 0

    def add(self, fingerprint: int, text: bytes, least: int, rows: dict, seen: int = 1) -> list:
        chain = self.of.setdefault(fingerprint, [])
        for entry in chain:
            if entry[0] == text:
                break
        else:
            chain.append([text, least, rows, seen])
            self.size += len(text) + 200
            return []
        entry[3] += seen
        if least > entry[1]:
            return list(rows.items())
        if least < entry[1]:
            entry[1], entry[2], rows = least, rows, entry[2]
            return list(rows.items())
        for row, n in rows.items():
            entry[2][row] = entry[2].get(row, 0) + n
        return []

    def drain(self) -> Iterator[tuple[int, list]]:
        for fingerprint, chain in self.of.items():
            for entry in chain:
                yield fingerprint, entry
        self.of, self.size = {}, 0


def _known(rows, copy: int = COPY) -> Iterator[tuple]:
    """Rows of which all is known: they go on without a text, under a key that spreads them."""
    for (doc_id, part, mask), n in rows:
        yield xxhash.xxh64_intdigest(f"{doc_id}"), (None, doc_id, part, mask | copy, n)


def _read(index: int, rows: Iterator) -> Iterator[tuple]:
    """Of a partition's documents ((fingerprint, lane), chain entry), one for each text, and rows known to be copies."""
    chains, lane = Chains(), index % LANES

    def passed_on(pairs) -> Iterator[tuple]:
        for fingerprint, value in pairs:
            yield (fingerprint, lane), value

    for doc_id, text, part in rows:
        text = text or ""
        row = (doc_id, part or "", text_mask(text))
        if doc_id is None:
            yield from passed_on(_known([(row, 1)], 0))
            continue
        data = text.encode("utf-8", "surrogatepass")
        yield from passed_on(_known(chains.add(xxhash.xxh64_intdigest(data), zlib.compress(data, 1), doc_id, {row: 1})))
        if chains.size > REMEMBERED:
            yield from passed_on(chains.drain())
    yield from passed_on(chains.drain())


def _meet(pairs: Iterator, last: bool) -> Iterator[tuple]:
    """Chains of one key after the other, as the pairs are sorted. last: all copies of a text are here, so what is left is the first of its text."""
    chains, now = Chains(), None

    def done() -> Iterator[tuple]:
        for fingerprint, entry in chains.drain():
            yield from _known(entry[2].items(), 0) if last else [(fingerprint, entry)]

    for key, value in pairs:
        fingerprint = key if last else key[0]
        if value[0] is None:
            yield fingerprint, value
            continue
        if key != now:
            yield from done()
            now = key
        yield from _known(chains.add(fingerprint, *value))
    yield from done()


def _place(key) -> int:
    """A partition for a fingerprint, or for one and its lane."""
    return key if isinstance(key, int) else key[0] + 0x9E3779B97F4A7C15 * (key[1] + 1)


def marked_copies(documents: DataFrame) -> DataFrame:
    """doc_id, part, mask and n of all documents: n rows alike, mask with the bits of all filters that they fail, copies included.

    A document is a copy if a smaller doc_id has its text (null: empty), removed or not. Rows of one doc_id are no copies of each other, and a null
    doc_id is neither smaller than any nor greater. Texts travel compressed (equal bytes for equal texts). A partition passes a text on once, and
    copies meet in lanes before they meet in one task, so a text that a third of all rows hold never does so row by row.
    """
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), size // PARTITION)
    pairs = documents.select(F.col("doc_id").cast("long"), "text", F.col("source").alias("part")).rdd.mapPartitionsWithIndex(_read)
    for last in (False, True):
        pairs = pairs.repartitionAndSortWithinPartitions(parts, _place).mapPartitions(lambda found, last=last: _meet(found, last))
    return spark.createDataFrame(pairs.map(lambda pair: pair[1][1:]), "doc_id long, part string, mask int, n long", verifySchema=False)


def copies(documents: DataFrame) -> DataFrame:
    """doc_id of each document whose text a smaller doc_id has, once."""
    return marked_copies(documents).where(F.col("mask").bitwiseAND(F.lit(COPY)) > 0).select("doc_id").distinct()


def _cell(row) -> tuple[str, tuple[int, int, int, int]]:
    return row["part"], (row["mask"], row["n"], row["good"], row["toxic"])


def _counted(vector: np.ndarray, cell: tuple) -> np.ndarray:
    mask, n, good, toxic = cell
    vector[:, mask] += (n, n * good, n * toxic)
    return vector


def mask_counts(documents: DataFrame, labels: DataFrame) -> RDD:
    """For each part a table of counts by mask: documents, those labelled good, those labelled toxic. Vectors are merged before they are shuffled."""
    rows = marked_copies(documents).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    joined = rows.join(known, F.col("doc_id") == F.col("_id"), "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    empty = lambda cell: _counted(np.zeros((3, 1 << len(FILTERS)), np.int64), cell)
    return joined.rdd.map(_cell).combineByKey(empty, _counted, np.add)


def reports(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """The rows of one part: each order of the filters, each step of it."""
    masks = np.arange(1 << len(FILTERS))
    bits = {name: 1 << k for k, name in enumerate(FILTERS)}
    documents, good, toxic = counts
    fails = np.array([bin(m).count("1") for m in masks])
    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    # in as many orders as there are, a document goes to each filter that it fails equally often
    shares = {f: int((documents * (masks & b > 0) * (len(orders) // np.maximum(fails, 1))).sum()) for f, b in bits.items()}
    for order in orders:
        earlier = 0
        for step, name in enumerate(order, 1):
            bit = bits[name]
            fails_it, left = (masks & bit) > 0, (masks & earlier) == 0
            here = fails_it & left
            kept = documents[(masks & (earlier | bit)) == 0].sum()
            redundant, unique = documents[fails_it & ~left].sum(), documents[bit]
            yield part, order, step, int(kept), int(documents[here].sum()), int(redundant), int(unique), int(good[here].sum()), int(toxic[here].sum()), shares[name]
            earlier |= bit


def audit_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (source; null: empty), order of the five filters and step, with counts of documents within the part.

    A: under 200 words. B: fewer distinct words than half. C: over 2 % capitals A-Z. D: holds one of #$%&*|. E: a smaller doc_id has the same text.
    A null text is empty and so fails A alone, and E as copy of other empty ones. Repeated rows count each; a document is good or toxic if any row of
    labels says so. Without documents there are no parts and no rows. Other columns are not read.
    """
    rows = mask_counts(documents, labels).flatMap(lambda x: reports(*x))
    return documents.sparkSession.createDataFrame(rows, AUDIT, verifySchema=False)
