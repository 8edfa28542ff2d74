"""Dedup of repeated byte strings by prefix-free parsing.

A rolling hash triggers at the least run of 32 bytes of every window of 100, so triggers cut all texts into phrases that only depend on content
(quire.llm.sampling). Phrases overlap by 99 bytes; so no window spans two, and each is in the phrase of its own trigger.

* The parse is the table of phrases in their places. The dictionary has each distinct phrase once, with its first place; phrases whose trigger is
  found once in all texts repeat nothing and go.
* In corpus order the first place of a phrase comes before all others of the parse, and settles these whole.
* Windows repeated within the dictionary can only be in phrases that share a trigger. Those are cut into parts of a few windows at multiples of a step
  from the trigger, and a part stays if what its windows have in common is in several distinct ones. The parts' suffixes are sorted; neighbours with
  a common prefix of a whole window, in the order of the first places of their parts, are the same string, and all but the first repeat it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import forget, keep
from quire.llm.sampling import CONTENT, Units, byte_units, packed, start_of, stretches, tag_of, told_apart, unpacked, windows_of, with_lists, without_spans
from quire.llm.textarrays import U64, Block, Prefix, blocks, count_in, mix

WINDOW, K = 100, 32
#: Windows of a part of a phrase.
PART = 8
#: Suffixes sorted together, but for a bucket that has more.
SORTED = 100_000


def _kept_bytes(block: Block, units: Units, gone: np.ndarray) -> dict:
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    starts = block.start[block.end > block.start]
    begins[starts] = gone[starts]
    text = block.data[~gone].tobytes()
    cut = np.concatenate([[0], np.cumsum(count_in(~gone, block.start, block.end))])
    hashes = [hashlib.sha256(text[cut[i] : cut[i + 1]]).hexdigest() for i in range(len(block))]
    return {"n_bytes": block.end - block.start, "n_removed": count_in(gone, block.start, block.end), "n_spans": count_in(begins, block.start, block.end), "kept_sha256": hashes}


def parse(documents: DataFrame, window: int, k: int) -> DataFrame:
    """All texts as phrases: trigger, phrase (content), doc, key and at (packed)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key, tag = (batch.column(i).to_numpy() for i in range(3))
            for block in blocks(batch.column(3)):
                s = stretches(byte_units(block), window, k, ends=False)
                row = s.text + block.first
                arrays = [s.anchor.view(np.int64), s.content.view(np.int64), doc[row], key[row], packed(tag[row], s.start, s.n, s.shift)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays)], ["trigger", "phrase", "doc", "key", "at"])

    return told_apart(documents).select("doc", "key", "tag", "text").mapInArrow(rows, "trigger long, phrase long, doc long, key long, at long")


def settled(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of phrases or parts (keys, phrase, doc, key, at): the places that come after the phrase's first, and the first ones of keys with several phrases."""
    place = F.struct("doc", "key", "at")
    first = keep(rows.groupBy(*keys, "phrase").agg(F.min(place).alias("first"), F.max(place).alias("_last")), "dictionary")
    parted = first.groupBy(*keys).agg(F.min("phrase").alias("_low"), F.max("phrase").alias("_high")).where("_low < _high").select(*keys)
    known = first.where("first < _last").select(*keys, "phrase", "first")
    later = keep(rows.join(known, [*keys, "phrase"]).where(place > F.col("first")).select("doc", "key", "at"), "later")
    return later, keep(first.join(parted, keys).select(*keys, "first.*"), "open")


def parts_of(phrases: DataFrame, documents: DataFrame, window: int, step: int = PART) -> DataFrame:
    """Phrases (trigger, doc, key, at) in parts that start a multiple of step windows before the trigger: trigger, core, phrase (the part's content), doc, key, at.

    core: hash of what all windows of a full part have in common, and of the part's place. Equal windows are in parts of equal trigger and core,
    so a part whose core is in no other repeats none of them.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key, tag = (batch.column(i).to_numpy() for i in range(3))
            offsets = batch.column(4).offsets.to_numpy()
            places, triggers = (x.to_numpy() for x in batch.column(4).values.flatten())
            for block in blocks(batch.column(3)):
                prefix = Prefix(byte_units(block).values, CONTENT)
                here = slice(int(offsets[block.first]), int(offsets[block.first + len(block)]))
                text = np.repeat(np.arange(len(block)), np.diff(offsets[block.first : block.first + len(block) + 1]))
                start, n, shift = unpacked(places[here])
                head = shift % step  # windows before the first multiple of step
                parts = (head > 0) + np.maximum(n - head + step - 1, 0) // step
                owner = np.repeat(np.arange(len(start)), parts)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
                nth -= head[owner] > 0
                begin = np.maximum(head[owner] + nth * step, 0)
                stop = np.minimum(head[owner] + (nth + 1) * step, n[owner])
                low = start[owner] + block.start[text[owner]] + begin
                left = shift[owner] - begin
                content = mix(prefix.hash(low, low + (stop - begin) - 1 + window) ^ mix(left.astype(U64)))
                number = (left + step - 1) // step  # of the part, counted from the trigger
                last = low + left - number * step + step - 1  # where a full part's last window starts
                core = mix(prefix.hash(last, last - step + 1 + window) ^ mix(number.astype(U64)))
                row = text[owner] + block.first
                arrays = [triggers[here][owner], core.view(np.int64), content.view(np.int64), doc[row], key[row], packed(tag[row], start[owner] + begin, stop - begin, left)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, arrays)], ["trigger", "core", "phrase", "doc", "key", "at"])

    entry = F.struct("at", "trigger")
    texts = with_lists(documents, phrases.withColumn("tag", tag_of("at")), entry).select("doc", "key", "tag", "text", "wanted")
    return texts.mapInArrow(rows, "trigger long, core long, phrase long, doc long, key long, at long")


def dictionary_bytes(parts: DataFrame, documents: DataFrame, window: int) -> DataFrame:
    """Parts (trigger, core, doc, key, at) with their bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key = (batch.column(i).to_numpy() for i in range(2))
            offsets = batch.column(3).offsets.to_numpy()
            at, trigger, core = (x.to_numpy() for x in batch.column(3).values.flatten())
            for block in blocks(batch.column(2)):
                here = slice(int(offsets[block.first]), int(offsets[block.first + len(block)]))
                text = np.repeat(np.arange(len(block)), np.diff(offsets[block.first : block.first + len(block) + 1]))
                start, n, _ = unpacked(at[here])
                size = n - 1 + window
                ends = np.concatenate([[0], np.cumsum(size)])
                source = np.repeat(start + block.start[text] - ends[:-1], size) + np.arange(ends[-1])
                data = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(block.data[source].tobytes())])
                row = text + block.first
                yield pa.RecordBatch.from_arrays([*map(pa.array, (trigger[here], core[here], doc[row], key[row], at[here])), data.cast(pa.binary())], ["trigger", "core", "doc", "key", "at", "bytes"])

    entry = F.struct("at", "trigger", "core")
    texts = with_lists(documents, parts.withColumn("tag", tag_of("at")), entry).select("doc", "key", "text", "wanted")
    return texts.mapInArrow(rows, "trigger long, core long, doc long, key long, at long, bytes binary")


def repeats_in_order(data: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """Which of the suffixes at start, in corpus order, share a prefix of window bytes with an earlier one.

    The suffixes are sorted by that prefix, equal ones stay in order, and neighbours are compared.
    """
    if not len(start):
        return np.zeros(0, np.int64)
    prefixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, window)[start]).view(f"V{window}").ravel()
    words = np.ascontiguousarray(np.pad(prefixes.view(np.uint8).reshape(-1, window), ((0, 0), (0, -window % 8)))).view(">u8")
    order = np.lexsort(words.T[::-1])
    ordered = words[order]
    same = (ordered[1:] == ordered[:-1]).all(axis=1)
    return order[1:][same]


def repeated_in_dictionary(dictionary: DataFrame, window: int) -> DataFrame:
    """Windows (doc, key, tag, start, n) of the dictionary's parts that an earlier part with the same trigger and core has too."""

    def found(table: pa.Table) -> pa.RecordBatch:
        at = table.column("at").to_numpy()
        texts = table.column("bytes").combine_chunks().cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        start, n, _ = unpacked(at)
        owner = np.repeat(np.arange(len(at)), n)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        again = repeats_in_order(data, offsets[owner] + nth, window)
        owner, nth = owner[again], nth[again]
        columns = [table.column("doc").to_numpy()[owner], table.column("key").to_numpy()[owner], at[owner] >> 48, start[owner] + nth, np.ones(len(owner), np.int64)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["doc", "key", "tag", "start", "n"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of whole buckets: rows come in order of trigger and core, then of the corpus."""
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not len(batch):
                continue
            if held and count > SORTED // PART:
                keys = [np.stack([b.column(i).to_numpy() for i in (0, 1)]) for b in (held[-1], batch)]
                new = (keys[1] != keys[0][:, -1:]).any(axis=0)
                cut = int(np.argmax(new)) if new.any() else len(batch)
                held.append(batch.slice(0, cut))
                if cut < len(batch):
                    yield from in_order(held)
                    held, count = [], 0
                batch = batch.slice(cut)
            if len(batch):
                held.append(batch)
                count += len(batch)
        if held:
            yield from in_order(held)

    def in_order(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield found(pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("doc", "key", "at")]))

    dealt = dictionary.repartition("trigger", "core").sortWithinPartitions("trigger", "core")
    return dealt.mapInArrow(rows, "doc long, key long, tag long, start long, n long")


def repeated_spans(documents: DataFrame, window: int, k: int) -> DataFrame:
    """Spans (doc, key, tag, start, n) of windows that also start earlier."""
    every = keep(parse(documents, window, k), "parse")
    triggers = keep(every.groupBy("trigger").agg(F.count("*").alias("_n")).where("_n > 1").select("trigger"), "triggers")
    rows = keep(every.join(triggers, "trigger"), "repeated")
    forget(every)
    copies, open_ = settled(rows, ["trigger"])
    forget(rows)
    parts = keep(parts_of(open_, documents, window), "parts")
    again, several = settled(parts, ["trigger", "core"])
    forget(parts)
    dictionary = keep(dictionary_bytes(several, documents, window), "bytes")
    single = repeated_in_dictionary(dictionary, window)
    spans = copies.union(again).select("doc", "key", tag_of("at").alias("tag"), start_of("at").alias("start"), windows_of("at").alias("n"))
    found = keep(spans.union(single), "removed")
    for table in (triggers, copies, open_, again, several, dictionary):
        forget(table)
    return found


def dedup_bytes(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document.

    Bytes covered by a string of window bytes that also starts earlier, in a document of smaller doc_id or before in the same, are removed. Null
    texts are empty; a null doc_id counts as the largest. Rows that share a doc_id, or have none, follow each other in the order of their texts' hashes
    (xxhash64); equal rows are one, each with the same result. Other columns are not read; an empty table gives an empty result.
    """
    spans = repeated_spans(documents, window, min(K, window))
    return without_spans(documents, spans, window, byte_units, _kept_bytes, {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"})
