"""Uniform shuffle into shards of exact size: draw a hypergeometric communication matrix, permute, exchange, permute."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bits_for, keep, numbered, spread_rank

#: Blocks stand for the partitions of the shuffle. Their number is fixed, so the matrix does not grow with the rows.
BLOCKS = 1024
#: Above this, numpy does not draw.
LARGE = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of draws without replacement are good; for large populations by inverting the distribution around its mode."""
    if not good or not draws:
        return 0
    if good + bad < LARGE:
        return int(rng.hypergeometric(good, bad, draws))
    total, least, most = good + bad, max(0, draws - bad), min(draws, good)
    mode = min(most, max(least, (draws + 1) * (good + 1) // (total + 2)))
    spread = int(12 * (draws * (good / total) * (bad / total) * ((total - draws) / max(total - 1, 1))) ** 0.5) + 12
    k = np.arange(max(least, mode - spread), min(most, mode + spread), dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return int(k[0] if len(k) else mode) + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows of block i that go to shard j, drawn so that every assignment of rows to places is equally likely."""
    rng, left, matrix = np.random.default_rng(seed), list(sizes), []
    for count in counts:
        row, rest = [], sum(left)
        for j, size in enumerate(left):
            drawn = hypergeometric(rng, size, rest - size, count)
            row.append(drawn)
            left[j] -= drawn
            rest -= size
            count -= drawn
        matrix.append(row)
    return matrix


def shuffle_into_shards(rows: DataFrame, shards: int, identity: list[str], seed: int = 7) -> DataFrame:
    """Add shard (int, from 0) and slot (long, gapless from 0 in its shard); shards' counts differ by one at most.

    identity: columns whose hash stands for a random number. Rows alike in all of them are interchangeable, so the
    result doesn't depend on how the rows are partitioned and a lost task repeats its share exactly; where very many may be alike, number them
    first (numbered). Nulls hash like any value;
    repeated rows get places of their own; an empty table gives an empty result. Shards are balanced by rows, so equal texts may part.
    """
    spark = rows.sparkSession
    clash = {c: f"_in_{i}" for i, c in enumerate(rows.columns)}
    named = rows.select(*(F.col(f"`{c}`").alias(n) for c, n in clash.items()))
    draw = lambda salt: F.xxhash64(F.lit(seed * 31 + salt), *(clash[c] for c in identity))
    dealt = keep(named.withColumn("_block", F.shiftright(draw(1), 54).cast("int")).withColumn("_first", draw(2)).withColumn("_second", draw(3)), "shards")
    counts = {r["_block"]: r["n"] for r in dealt.groupBy("_block").agg(F.count("*").alias("n")).collect()}  # BLOCKS rows at most
    blocks, total = sorted(counts), sum(counts.values())
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix([counts[b] for b in blocks], sizes, seed)
    ends = spark.createDataFrame([(b, np.cumsum(row).tolist()) for b, row in zip(blocks, matrix, strict=True)], "_block int, _ends array<long>")
    local = spread_rank(dealt, ["_block"], "_first", "_local", bits_for(total // BLOCKS + 1))
    sent = local.join(F.broadcast(ends), "_block").withColumn("shard", F.expr("size(filter(_ends, e -> e <= _local))"))
    placed = spread_rank(sent.drop("_ends", "_local", "_first", "_block"), ["shard"], "_second", "slot", bits_for(total // shards + 1))
    return placed.select(*(F.col(n).alias(c) for c, n in clash.items()), "shard", F.col("slot").cast("long").alias("slot"))


def shard_documents(documents: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, null: none, plus 16), text_crc32, law, shard, slot and grown_shard (null) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = documents.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    placed = shuffle_into_shards(numbered(sized), shards, ["doc_id", "size", "text_crc32", "_nth"], seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
