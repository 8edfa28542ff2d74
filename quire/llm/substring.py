"""Substring dedup on a de Bruijn graph of words.

Windows of 50 words are the graph's k-mers: edges from their first 49 words to their last. Rows hold stretches of edges (quire.llm.sampling), which
are cut where the content says so, and only stretches around runs of 12 words that several documents have stay.

* Repeated stretches are joined at nodes with one edge in and one out, as far as one document has them in a row: those are the compacted paths.
* A document's stretches along a path are one span. What it and the path's source hold at their coordinates is read again and must be equal.
* Where different stretches share an anchor, the graph branches: there k-mers are spelled out one by one, and counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import forget, keep
from quire.llm.sampling import CONTENT, RUNS, Units, packed, start_of, stretches, tag_of, told_apart, windows_of, with_lists, without_spans, word_units
from quire.llm.textarrays import Block, Prefix, blocks, count_in

WINDOW, K = 50, 12
#: Words are compared as bytes with one of these behind each.
BETWEEN = 0x20


def joined_words(block: Block) -> tuple[bytes, np.ndarray]:
    """All words with a space behind each, and where each word starts."""
    begin, end = block.words
    size = end - begin + 1
    at = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(begin - at[:-1], size) + np.arange(at[-1])
    data = np.append(block.data, np.uint8(BETWEEN))[source]
    data[at[1:] - 1] = BETWEEN
    return data.tobytes(), at


def _kept_words(block: Block, units: Units, gone: np.ndarray) -> dict:
    text, at = joined_words(block)
    kept = np.repeat(~gone, np.diff(at))
    data = np.frombuffer(text, np.uint8)[kept].tobytes()
    size = np.concatenate([[0], np.cumsum(kept)])
    low, high = size[at[units.first]], size[at[units.end]]
    hashes = [hashlib.sha256(data[a : b - 1 if b > a else b]).hexdigest() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
    return {"n_words": units.end - units.first, "n_removed": count_in(gone, units.first, units.end), "kept_sha256": hashes}


def edge_rows(documents: DataFrame, window: int, k: int) -> DataFrame:
    """All stretches of edges: anchor, edge (content), tail and head node, doc, key and at (packed)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key, tag = (batch.column(i).to_numpy() for i in range(3))
            for block in blocks(batch.column(3)):
                s = stretches(word_units(block), window, k, ends=True)
                row = s.text + block.first
                hashes = [x.view(np.int64) for x in (s.anchor, s.content, s.tail, s.head)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, hashes), *map(pa.array, (doc[row], key[row], packed(tag[row], s.start, s.n, s.shift)))], ["anchor", "edge", "tail", "head", "doc", "key", "at"])

    return told_apart(documents).select("doc", "key", "tag", "text").mapInArrow(rows, "anchor long, edge long, tail long, head long, doc long, key long, at long")


def compacted(graph: DataFrame) -> DataFrame:
    """anchor, edge, first (its source) and path of the repeated stretches of graph; path: place in the source where its path starts.

    Two stretches go on in one path over a node that no other repeated one enters or leaves, if the first document has them in a row.
    """
    edges = graph.where("several")
    one_out = edges.groupBy(F.col("tail").alias("node")).agg(F.count("*").alias("_n")).where("_n = 1").select("node")
    one_in = edges.groupBy(F.col("head").alias("node")).agg(F.count("*").alias("_n")).where("_n = 1").select("node")
    through = one_out.join(one_in, "node").withColumn("goes_on", F.lit(True))
    linked = edges.join(through, F.col("tail") == F.col("node"), "left")
    source = Window.partitionBy("first.doc", "first.key", tag_of("first.at")).orderBy("first.at")
    start, n = start_of("first.at"), windows_of("first.at")
    after = F.lag(start + n).over(source)
    begins = ~(F.coalesce("goes_on", F.lit(False)) & F.coalesce(after == start, F.lit(False)))
    cut = linked.select("anchor", "edge", "first", F.when(begins, start).alias("_begin"), F.col("first.doc").alias("_doc"), F.col("first.key").alias("_key"), tag_of("first.at").alias("_tag"))
    along = Window.partitionBy("_doc", "_key", "_tag").orderBy("first.at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut.select("anchor", "edge", "first", F.max("_begin").over(along).alias("path"))


def copied_spans(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Spans (doc, key, tag, start, n) of documents along a path that a smaller doc_id has, and their source (s_doc, s_key, s_tag, s_start)."""
    met = rows.join(paths, ["anchor", "edge"]).where(F.col("doc") > F.col("first.doc"))
    met = met.select(
        "doc", "key", tag_of("at").alias("tag"), start_of("at").alias("start"), windows_of("at").alias("n"),
        F.col("first.doc").alias("s_doc"), F.col("first.key").alias("s_key"), tag_of("first.at").alias("s_tag"), "path", (start_of("first.at") - start_of("at")).alias("ahead"),
    ).distinct()
    line = ["doc", "key", "tag", "s_doc", "s_key", "s_tag", "path", "ahead"]
    order = Window.partitionBy(*line).orderBy("start")
    begin = F.when(F.coalesce(F.lag(F.col("start") + F.col("n")).over(order) != F.col("start"), F.lit(True)), F.col("start"))
    runs = met.withColumn("_begin", begin).withColumn("_run", F.max("_begin").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = runs.groupBy(*line, "_run").agg(F.sum("n").alias("n"))
    return spans.select("doc", "key", "tag", F.col("_run").alias("start"), "n", "s_doc", "s_key", "s_tag", (F.col("_run") + F.col("ahead")).alias("s_start"))


def spelled(documents: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Of wanted stretches (doc, key, tag, start, n, branch): a digest of their words, or for a branch two hashes of each of its windows.

    doc, key, tag, start, n, branch, and a and b: the digest's 128 bits or the hashes.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "key", "tag", "start", "n", "branch", "a", "b"]
        for batch in batches:
            doc, key, tag = (batch.column(i).to_numpy() for i in range(3))
            offsets = batch.column(4).offsets.to_numpy()
            starts, ns, branches = (x.to_numpy(zero_copy_only=False) for x in batch.column(4).values.flatten())
            for block in blocks(batch.column(3)):
                units = word_units(block)
                here = slice(int(offsets[block.first]), int(offsets[block.first + len(block)]))
                text = np.repeat(np.arange(len(block)), np.diff(offsets[block.first : block.first + len(block) + 1]))
                start, n, branch = starts[here], ns[here], branches[here]
                low = units.first[text] + start
                data, at = joined_words(block)
                whole = np.flatnonzero(~branch)
                cut = zip(at[low[whole]].tolist(), at[low[whole] + n[whole] - 1 + window].tolist(), strict=True)
                digests = b"".join(hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in cut)
                digest = np.frombuffer(digests, np.int64).reshape(-1, 2)
                some = np.flatnonzero(branch)
                owner = np.repeat(some, n[some])
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
                one = low[owner] + nth
                hashes = [Prefix(units.values, kind).hash(one, one + window).view(np.int64) for kind in (RUNS, CONTENT)]
                row = np.concatenate([text[whole], text[owner]]) + block.first
                columns = [doc[row], key[row], tag[row], np.concatenate([start[whole], start[owner] + nth]), np.concatenate([n[whole], np.ones(len(owner), np.int64)])]
                ends = [np.arange(len(row)) >= len(whole), *(np.concatenate([digest[:, i], hashes[i]]) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *map(pa.array, ends)], names)

    entry = F.struct(*(F.col(c).cast("long").alias(c) for c in ("start", "n")), "branch")
    texts = with_lists(documents, wanted, entry).select("doc", "key", "tag", "text", "wanted")
    return texts.mapInArrow(rows, "doc long, key long, tag long, start long, n long, branch boolean, a long, b long")


def repeated_spans(documents: DataFrame, window: int, k: int) -> DataFrame:
    """Spans (doc, key, tag, start, n) of windows that also start in a document of smaller doc_id."""
    place = ["doc", "key", "tag", "start", "n"]
    every = keep(edge_rows(documents, window, k), "edges")
    anchors = keep(every.groupBy("anchor").agg(F.min("doc").alias("_low"), F.max("doc").alias("_high")).where("_low < _high").select("anchor"), "anchors")
    rows = keep(every.join(anchors, "anchor"), "shared")
    forget(every)
    ends = [F.min(c).alias(c) for c in ("tail", "head")]
    graph = rows.groupBy("anchor", "edge").agg(F.min(F.struct("doc", "key", "at")).alias("first"), *ends, (F.min("doc") < F.max("doc")).alias("several"))
    graph = keep(graph, "graph")
    spans = keep(copied_spans(rows, compacted(graph)), "spans")
    forget(rows)
    parted = graph.groupBy("anchor").agg(F.min("edge").alias("_low"), F.max("edge").alias("_high")).where("_low < _high").select("anchor")
    branches = graph.join(parted, "anchor").select("first.doc", "first.key", tag_of("first.at").alias("tag"), start_of("first.at").alias("start"), windows_of("first.at").alias("n"), F.lit(True).alias("branch"))
    sources = spans.select(*(F.col(f"s_{c}").alias(c) for c in ("doc", "key", "tag", "start")), "n", F.lit(False).alias("branch"))
    wanted = branches.union(spans.select(*place, F.lit(False).alias("branch"))).union(sources)
    read = keep(spelled(documents, wanted, window), "spelled")
    forget(anchors)
    digests = read.where("not branch").select(*place, "a", "b").distinct()
    theirs = digests.select(*(F.col(c).alias(f"s_{c}") for c in ("doc", "key", "tag", "start")), "n", F.col("a").alias("_a"), F.col("b").alias("_b"))
    verified = spans.join(digests, place).join(theirs, ["s_doc", "s_key", "s_tag", "s_start", "n"]).where("a = _a and b = _b").select(*place)
    kmers = read.where("branch")
    first = kmers.groupBy("a", "b").agg(F.min("doc").alias("_first"), F.max("doc").alias("_last")).where("_first < _last").select("a", "b", "_first")
    again = kmers.join(first, ["a", "b"]).where("doc > _first").select(*place)
    found = keep(verified.union(again), "removed")
    for table in (graph, spans, read):
        forget(table)
    return found


def dedup_substrings(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document.

    Words covered by a window that also starts in a document of smaller doc_id are removed; repeats within a document alone stay. Null
    and empty texts have no words; a null doc_id counts as the largest; rows that share a doc_id, or have none, are one document of several texts,
    which takes nothing from itself. Other columns are not read; an empty table gives an empty result.
    """
    spans = repeated_spans(documents, window, min(K, window))
    return without_spans(documents, spans, window, word_units, _kept_words, {"n_words": "long", "n_removed": "long", "kept_sha256": "string"})
