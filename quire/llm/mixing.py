"""Mix sources to target weights: entropy balancing by distributed Newton steps, then rounding into copies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, bits_for, keep, numbered, one_of_alike, spread_rank

#: Weights of sources in code point order, repeated; null comes last.
WEIGHTS = (5.0, 2.0, 1.0)
#: Share of all words that the mix takes.
SHARE = 1.5
#: Copies of a document at most, and so the times a source is taken at most.
MOST = 2.0
STEPS = 60
#: Newton stops for a source when its words are within this share of its target.
CLOSE = 1e-6
#: Passes that make up for rounding.
SETTLE = 5
#: Up to so many sources, their state is broadcast.
FEW = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(seed: int) -> Column:
    """128 bits by which documents are told apart; the first half puts them in order."""
    return F.struct(*(F.xxhash64(F.lit(seed + i), "doc_id", "source", "text").alias(c) for i, c in enumerate("ab")))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source_key, source, source_size and target: share of all words by weight, none above most times its source's size.

    What a full source can't take is shared by weight among the others until none is above. A target follows
    from one scalar per round, so sources are never collected; they are numbered in order by ranges, whose counts are summed up.
    """
    order = [F.col("source").isNull(), F.col("source")]
    cut = keep(sizes.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "cut")
    counts = cut.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    weight = F.array(*map(F.lit, weights))
    ranked = cut.join(F.broadcast(offsets), "_part").withColumn("_weight", F.get(weight, (place % len(weights)).cast("int"))).drop("_part", "_before")
    ranked = keep(ranked, "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * most
    level = 0.0
    while True:
        full = F.col("_weight") * level >= cap
        taken, open_weight = ranked.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("_weight")))).first()
        rest = share * total - (taken or 0.0)
        new = rest / open_weight if open_weight else level
        if not open_weight or new <= level:
            break
        level = new
    return ranked.withColumn("target", F.least(F.col("_weight") * level, cap).cast("double")).drop("_weight")


def entropy_rates(groups: DataFrame, targets: DataFrame, most: float = MOST) -> DataFrame:
    """For each source_key the tilt and scale with which documents of size s have rate min(most, exp(tilt * s / scale)).

    The rates are those nearest to one copy of each document, in relative entropy over documents, for which the words of each
    source, sum of rate * size, meet its target and no rate exceeds most. The dual has one variable per source, its tilt, and
    is convex; Newton steps on it, kept inside a bracket, need a sum per source of the size histogram each. groups: source_key, size, n.
    """
    n_sources = targets.count()
    spread = groups.groupBy("source_key").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("scale"))
    state = targets.join(spread, "source_key", "left").select(
        "source_key", "target", "scale", "source_size",
        F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        ((F.col("source_size") == 0) | (F.col("target") >= most * F.col("source_size"))).alias("done"),
    )
    state = keep(state, "tilts")
    limit = math.log(most)
    for _ in range(STEPS):
        side = F.broadcast(state) if n_sources <= FEW else state
        x = F.col("size") / F.col("scale")
        words = F.col("n") * F.col("size") * F.exp(F.least(F.col("tilt") * x, F.lit(limit)))
        bends = F.when(F.col("tilt") * x < limit, words * x).otherwise(0.0)
        sums = groups.join(side.where(~F.col("done")), "source_key").groupBy("source_key").agg(F.sum(words).alias("words"), F.sum(bends).alias("slope"))
        over = F.col("words") > F.col("target")
        low = F.when(over, F.col("low")).otherwise(F.col("tilt"))
        high = F.when(over, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - (F.col("words") - F.col("target")) / F.col("slope")
        wide = F.greatest(F.abs(F.col("tilt")), F.lit(1.0))
        middle = F.when(F.col("low").isNull(), F.col("high") - 2 * wide).when(F.col("high").isNull(), F.col("low") + 2 * wide).otherwise((F.col("low") + F.col("high")) / 2)
        fits = (F.col("slope") > 0) & (F.col("low").isNull() | (newton > F.col("low"))) & (F.col("high").isNull() | (newton < F.col("high"))) & (F.abs(newton - F.col("tilt")) <= 8 * wide)
        close = F.abs(F.col("words") - F.col("target")) <= F.greatest(F.col("target") * CLOSE, F.lit(0.5))
        moved = state.join(F.broadcast(sums) if n_sources <= FEW else sums, "source_key", "left").withColumns({"low": low, "high": high}).withColumn("_next", F.when(fits, newton).otherwise(middle))
        open_ = F.col("words").isNotNull() & ~F.col("done")
        still = Observation()
        moved = moved.select("source_key", "target", "scale", "source_size", F.when(open_ & ~close, F.col("_next")).otherwise(F.col("tilt")).alias("tilt"), "low", "high", (F.col("done") | close | F.col("words").isNull()).alias("done"))
        state = keep(moved.observe(still, F.count_if(~F.col("done")).alias("open")), "tilts")
        if not still.get.get("open"):
            break
    full = (F.col("source_size") > 0) & (F.col("target") >= most * F.col("source_size"))
    return state.select("source_key", "tilt", "scale", full.alias("full"))


def settle(rated: DataFrame, most: float) -> DataFrame:
    """Change _copies (of all documents of a source_key and size) so that the words a source misses are halved at least, if its sizes allow."""
    by_source = Window.partitionBy("source_key")
    missed = rated.withColumn("_miss", F.col("target") - F.sum(F.col("_copies") * F.col("size")).over(by_source))
    room = F.when(F.col("_miss") > 0, F.floor(F.lit(most) * F.col("n")) - F.col("_copies")).otherwise(F.col("_copies"))
    fits = (F.col("size") > 0) & (F.col("size") <= F.abs("_miss"))
    larger = by_source.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    missed = missed.withColumn("_room", F.when(fits, room).otherwise(0))
    left = F.abs("_miss") - F.coalesce(F.sum(F.col("_room") * F.col("size")).over(larger), F.lit(0))
    change = F.when(fits, F.least(F.greatest(F.floor(left / F.col("size")), F.lit(0)), "_room")).otherwise(0)
    return missed.withColumn("_copies", (F.col("_copies") + F.signum("_miss").cast("long") * change).cast("long")).drop("_miss", "_room")


def mix_to_targets(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate and row_key of each document, for the mix of sources described at source_targets.

    Rates (entropy_rates) become whole copies: each takes the whole part, and along the sizes of a source running sums of the
    fractions say how many documents of a size take one more, those of the smallest hashes. What a source's words then miss of its
    target, at most its largest document, is made up with copies of shorter ones (settle). Null texts and texts without words have size 0 and are not taken; null sources are one source, the
    last; repeated rows count each; the result depends on neither order nor partitions. An empty table gives an empty result.
    """
    source_key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    base = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_key(seed).alias("row_key")).withColumn("source_key", source_key)
    base = keep(numbered(base).withColumn("_h", F.xxhash64("row_key.a", "_nth")).drop("_nth"), "sized")
    groups = keep(base.groupBy("source_key", "source", "size").agg(F.count("*").alias("n")), "sizes")
    targets = keep(source_targets(groups.groupBy("source_key", "source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, most), "targets")
    tilts = entropy_rates(groups.select("source_key", "size", "n").where("size > 0"), targets, most)
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("full"), F.lit(most)).otherwise(F.least(F.lit(most), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(math.log(most))))))
    rated = groups.drop("source").join(tilts, "source_key").join(targets.drop("source"), "source_key").withColumn("rate", rate)
    along = Window.partitionBy("source_key").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = F.col("n") * (F.col("rate") - F.floor("rate"))
    rated = rated.withColumn("_run", F.sum(part).over(along))
    rated = rated.withColumn("_copies", F.floor("rate") * F.col("n") + F.least(F.greatest(F.floor(F.col("_run") + 0.5) - F.floor(F.col("_run") - part + 0.5), F.lit(0)), "n"))
    for _ in range(SETTLE):
        rated = settle(rated, most)
    rated = keep(rated.select("source_key", "size", "source_size", "target", "rate", F.expr("_copies div n").cast("int").alias("_whole"), (F.col("_copies") % F.col("n")).alias("_more")), "rates")
    n = groups.agg(F.sum("n")).first()[0] or 0
    ranked = spread_rank(base.select("doc_id", "source_key", "size", "row_key", "_h"), ["source_key", "size"], "_h", "_rank", bits_for(n, 1_000_000), extra=rated)
    copies = F.least(F.col("_whole") + (F.col("_rank") < F.col("_more")).cast("int"), F.lit(int(most)))
    return ranked.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate", "row_key")


def take_mix(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11) -> DataFrame:
    """documents, each repeated as often as mix_to_targets takes it, with all their columns.

    Rows alike in doc_id, source and text are one row, the least by the hash of all its columns, taken as often as all of them together.
    """
    mixed = mix_to_targets(documents, weights, share, most, seed)
    copies = keep(mixed.groupBy("row_key").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")), "copies")
    rows = documents.select(row_key(seed).alias("_key"), F.struct("*").alias("_row"))
    if not copies.where("_rows > 1").isEmpty():
        rows = one_of_alike(rows, ["_key"], "_row")
    taken = rows.join(copies.where("_copies > 0").hint("shuffle_merge"), F.col("_key") == F.col("row_key"))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")
