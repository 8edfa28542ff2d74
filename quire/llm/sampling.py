"""Texts cut into stretches that only depend on content: the windows in a row that have the same run of least hash.

A window of size units holds size - k + 1 runs of k units; the one of least hash, the leftmost of equals, is its anchor. Windows in a row with the
same anchor are a stretch. Equal windows have equal anchors at equal places, wherever they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.textarrays import U64, Block, Prefix, mix

#: Stands for a null doc_id, which so comes last.
NO_ID = (1 << 63) - 1
#: Units looked at together, and bits of a place among them, which replace the lowest of a hash to find its leftmost place.
CHUNK, PLACE_BITS = 1 << 23, 24
#: Polynomials of runs and of whole stretches; so anchor and content are two hashes with nothing in common but the units' own.
RUNS, CONTENT = 2, 3


@dataclass
class Units:
    """Words or bytes of a block: a value for each, and the first and the one behind the last of each text."""

    values: np.ndarray
    first: np.ndarray
    end: np.ndarray


def word_units(block: Block) -> Units:
    return Units(block.word_hash, *block.word_range)


def byte_units(block: Block) -> Units:
    return Units(block.bytes_prefix.values, block.start, block.end)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


@dataclass
class Stretches:
    """Stretches of a block's texts: text, first window, windows, place of the anchor from there, and hashes of the anchor, of the content with the
    anchor's place, and of the size - 1 units at its start and at its end."""

    text: np.ndarray
    start: np.ndarray
    n: np.ndarray
    shift: np.ndarray
    anchor: np.ndarray
    content: np.ndarray
    tail: np.ndarray
    head: np.ndarray


def stretches(units: Units, size: int, k: int, ends: bool) -> Stretches:
    """All stretches, in order; ends: with tail and head."""
    found: list[list[np.ndarray]] = []
    total, length = len(units.values), units.end - units.first
    for low in range(0, max(total - size + 1, 0), CHUNK):
        high = min(total, low + CHUNK + size - 1)
        at = np.arange(high - low - k + 1)
        runs = Prefix(units.values[low:high], RUNS).hash(at, at + k)
        least = sliding_least((runs & ~U64((1 << PLACE_BITS) - 1)) | at.astype(U64), size - k + 1)
        text = np.repeat(np.arange(len(length)), length)[low:high]
        start = np.flatnonzero(text[: len(least)] == text[size - 1 : size - 1 + len(least)])
        if not len(start):
            continue
        owner = (least[start] & U64((1 << PLACE_BITS) - 1)).astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1) | (text[start[1:]] != text[start[:-1]])
        place = np.flatnonzero(new)
        n = np.diff(np.append(place, len(start)))
        begin, owner = start[place], owner[place]
        whole = Prefix(units.values[low:high], CONTENT)
        content = mix(whole.hash(begin, begin + n - 1 + size) ^ mix((owner - begin).astype(U64)))
        edges = [whole.hash(begin, begin + size - 1), whole.hash(begin + n, begin + n + size - 1)] if ends else [content[:0], content[:0]]
        found.append([text[begin], begin + low - units.first[text[begin]], n, owner - begin, runs[owner], content, *edges])
    if not found:
        return Stretches(*[np.zeros(0, np.int64)] * 4, *[np.zeros(0, U64)] * 4)
    return Stretches(*map(np.concatenate, zip(*found, strict=True)))


def told_apart(documents: DataFrame) -> DataFrame:
    """doc (doc_id, null as the largest), key and tag (79 bits of the text's hash, to tell rows apart that share a doc_id), doc_id and text."""
    tag = F.xxhash64(F.lit(1), "text").bitwiseAND(F.lit(0x7FFF))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("key"), tag.alias("tag"), "doc_id", "text")


def packed(tag: np.ndarray, start: np.ndarray, n: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Tag, place in the text, number of windows and place of the anchor from there in one long, which sorts by these."""
    return (tag << 48) | (start << 16) | (n << 8) | shift


def unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, number of windows, and place of the anchor from there."""
    return (at >> 16) & 0xFFFFFFFF, (at >> 8) & 0xFF, at & 0xFF


def tag_of(at: str) -> Column:
    return F.shiftright(at, 48)


def start_of(at: str) -> Column:
    return F.shiftright(at, 16).bitwiseAND(F.lit(0xFFFFFFFF))


def windows_of(at: str) -> Column:
    return F.shiftright(at, 8).bitwiseAND(F.lit(0xFF))


def with_lists(documents: DataFrame, wanted: DataFrame, entry: Column, how: str = "inner") -> DataFrame:
    """doc, key, tag, doc_id, text and wanted: the distinct entries of rows (doc, key, tag) for each text, no more than a text's length."""
    lists = wanted.groupBy(F.col("doc").alias("_doc"), F.col("key").alias("_key"), F.col("tag").alias("_tag")).agg(F.collect_set(entry).alias("wanted"))
    texts = told_apart(documents)
    return texts.join(lists, (texts.doc == lists._doc) & (texts.key == lists._key) & (texts.tag == lists._tag), how).select("doc", "key", "tag", "doc_id", "text", "wanted")


def covered(units: Units, size: int, text: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each unit of a block, whether one of n windows in a row from start, in a text, covers it."""
    at = start + units.first[text]
    change = np.zeros(len(units.values) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + n - 1 + size, -1)
    return np.cumsum(change[:-1]) > 0


def without_spans(documents: DataFrame, spans: DataFrame, size: int, units: Callable[[Block], Units], rows: Callable, schema: dict[str, str]) -> DataFrame:
    """rows(block, units, covered) of every text, for rows spans (doc, key, tag, start, n) of windows to be removed, with doc_id."""
    from quire.llm.textarrays import blocks

    joined = with_lists(documents, spans, F.struct(F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n")), "left").select("doc_id", "text", "wanted")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).fill_null([]) if batch.column(2).null_count else batch.column(2)
            offsets = lists.offsets.to_numpy()
            start, n = (x.to_numpy() for x in lists.values.flatten())
            for block in blocks(batch.column(1)):
                here = slice(int(offsets[block.first]), int(offsets[block.first + len(block)]))
                text = np.repeat(np.arange(len(block)), np.diff(offsets[block.first : block.first + len(block) + 1]))
                u = units(block)
                found = rows(block, u, covered(u, size, text, start[here], n[here]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), *map(pa.array, found.values())], ["doc_id", *found])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(judged, ", ".join([f"doc_id {kind}", *(f"{name} {t}" for name, t in schema.items())]))
