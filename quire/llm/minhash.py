"""Near-duplicate documents by b-bit MinHash: bands give candidates, packed low bits of minima thin them out, full sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import forget, keep, one_of_alike
from quire.llm.components import components
from quire.llm.textarrays import U64, Block, Prefix, blocks, distinct_within, mix, sorted_within

SHINGLE = 5
#: A link: 100 * intersection >= 75 * union.
LINK = 75
BANDS, ROWS = 32, 4
#: Minima of a document, the first of which make the bands, and low bits kept of each; 16 minima fill a long.
MINIMA, BITS = 256, 4
#: Pairs whose estimate is below are not confirmed; over four standard deviations (0.028 each) below LINK.
LEAST_ESTIMATE = 0.63
#: Turns that link members of a bucket to one of its documents before pairs across what is left apart are taken.
STARS = 2
#: Pairs whose sets are compared together.
TOGETHER = 1_000
#: Documents with so many differences from their centre are compared where they meet; longer ones by their texts.
INLINE = 512

_DRAWN = np.random.default_rng(77).integers(0, 2**63, (2, MINIMA), dtype=np.int64).astype(U64)
_SALTS, _FACTORS = _DRAWN[0], _DRAWN[1] | U64(1)
_LONGS = MINIMA * BITS // 64
_DIFFERENCES = {"centre": "long", "doc_id": "long", "text": "long", "base": "long", "size": "long", "extra": "long", "weight": "long", "differing": "array<long>"}
_SHINGLES = {"doc_id": "long", "n_shingles": "long", "set_a": "long", "set_b": "long", "packed": "array<long>", "bands": "array<long>"}


def shingles(block: Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each text's distinct shingles; a text of fewer words has one, all its words."""
    first, value = block.windows(size)
    text = block.word_text[first]
    low, high = block.word_range
    short = np.flatnonzero((high > low) & (high - low < size))
    if len(short):
        whole = mix(Prefix(block.word_hash, 1).hash(low[short], high[short]) ^ U64(0x9E3779B97F4A7C15))
        text, value = np.concatenate([text, short]), np.concatenate([value, whole])
    return distinct_within(text, value)


def signatures(block: Block) -> dict[str, np.ndarray]:
    """For each text: size of its set, two sums that stand for the set, packed low bits of the minima, and a hash of each band."""
    text, value = shingles(block)
    n = np.bincount(text, minlength=len(block))
    some = np.flatnonzero(n)
    first = (np.cumsum(n) - n)[some]
    out = {"n": n, "set_a": np.zeros(len(block), U64), "set_b": np.zeros(len(block), U64), "packed": np.zeros((len(block), _LONGS), U64), "bands": np.zeros((len(block), BANDS), U64)}
    if not len(some):
        return out
    out["set_a"][some] = np.add.reduceat(mix(value), first)
    out["set_b"][some] = np.add.reduceat(mix(value ^ U64(0xD6E8FEB86659FD93)), first)
    buffer = np.empty_like(value)
    for k in range(MINIMA):
        np.bitwise_xor(value, _SALTS[k], out=buffer)
        np.multiply(buffer, _FACTORS[k], out=buffer)
        least = mix(np.minimum.reduceat(buffer, first))
        if k < BANDS * ROWS:
            band = out["bands"][:, k // ROWS]
            band[some] = mix(band[some] * U64(0x9DDFEA08EB382D69) + least + U64(k // ROWS))
        per_long = 64 // BITS
        out["packed"][some, k // per_long] |= (least & U64(2**BITS - 1)) << U64(BITS * (k % per_long))
    return out


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(1), lower=True):
            found = signatures(block)
            some = found["n"] > 0
            lists = []
            for name in ("packed", "bands"):
                width = found[name].shape[1]
                sizes = np.where(some, width, 0)
                lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(found[name][some].reshape(-1).view(np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), pa.array(found["n"].astype(np.int64)), pa.array(found["set_a"].view(np.int64)), pa.array(found["set_b"].view(np.int64)), *lists], list(_SHINGLES))


def document_signatures(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_signature_rows, ", ".join(f"{k} {v}" for k, v in _SHINGLES.items()))


def estimate(left: str, right: str) -> Column:
    """Similarity from packed low bits of minima, corrected for those that agree by chance."""
    differing = None
    for k in range(_LONGS):
        x = F.get(F.col(left), F.lit(k)).bitwiseXOR(F.get(F.col(right), F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        count = F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
        differing = count if differing is None else differing + count
    chance = 2.0**-BITS
    return (1 - differing / float(MINIMA) - chance) / (1 - chance)


def _set_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Place of each text and hash of each of its shingles."""
    places, values = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for block in blocks(texts, lower=True):
        text, value = shingles(block)
        places.append(text + block.first)
        values.append(value)
    return np.concatenate(places), np.concatenate(values)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), TOGETHER):
            part = batch.slice(at, TOGETHER)
            left, right = _set_rows(part.column(2)), _set_rows(part.column(3))
            pair, value = (np.concatenate([x, y]) for x, y in zip(left, right, strict=True))
            order = sorted_within(pair, value)
            pair, value = pair[order], value[order]
            shared = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (value[1:] == value[:-1])], minlength=len(part))
            union = np.bincount(pair, minlength=len(part)) - shared
            linked = pa.array((100 * shared >= LINK * union) & (union > 0))
            yield pa.RecordBatch.from_arrays([part.column(0).filter(linked), part.column(1).filter(linked)], ["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of documents linked by their full shingle sets."""
    left, right = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirmed, "a long, b long")


def _difference_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), TOGETHER):
            part = batch.slice(at, TOGETHER)
            n = len(part)
            (pair, value), (other, theirs) = _set_rows(part.column(2)), _set_rows(part.column(3))
            base, size = np.bincount(pair, minlength=n), np.bincount(other, minlength=n)
            text = np.zeros(n, U64)
            np.add.at(text, other, mix(theirs))
            side = np.concatenate([np.zeros(len(value), bool), np.ones(len(theirs), bool)])
            pair, value = np.concatenate([pair, other]), np.concatenate([value, theirs])
            order = sorted_within(pair, value)
            pair, value, side = pair[order], value[order], side[order]
            same = (pair[1:] == pair[:-1]) & (value[1:] == value[:-1])
            single = np.append(True, ~same) & np.append(~same, True) if n else np.zeros(0, bool)
            pair, value, side = pair[single], value[single], side[single]
            extra = np.bincount(pair[side], minlength=n)
            held = np.bincount(pair, minlength=n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(held)]), pa.int32()), pa.array(((value << U64(1)) | side.astype(U64)).view(np.int64)))
            weight = 4 * (held - extra) + 3 * extra
            numbers = [pa.array(x) for x in (text.view(np.int64), base, size, extra, weight)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *numbers, lists], list(_DIFFERENCES))


def differences(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """For each (centre, doc_id): the shingles that a document's set lacks of the centre's (missing) and has beyond it (extra; these are odd).

    With base the centre's size and weight = 4 * missing + 3 * extra, two documents that share s of their differences from one centre have
    7 * intersection - 3 * sum of sizes = base - weight - weight + 7 * s, and are linked when that is not negative. So the full sets decide,
    but only what differs has to be compared. Of a centre with several texts any one serves; a document's are rows of their own (text).
    """
    centres = pairs.select("centre").distinct().join(texts, F.col("centre") == F.col("doc_id")).groupBy("centre").agg(F.min("text").alias("text_a"))
    both = pairs.join(centres, "centre").join(texts.withColumnRenamed("text", "text_b"), "doc_id")
    return both.select("centre", "doc_id", "text_a", "text_b").mapInArrow(_difference_rows, ", ".join(f"{k} {v}" for k, v in _DIFFERENCES.items()))


def lightest_other(rows: DataFrame) -> DataFrame:
    """rows (centre, doc_id, component, weight) with other_weight and other, the least weight around the centre in another component and who has it.

    The two lightest components of each centre are written first, so that the join with rows can split a centre that very many share.
    """
    per = keep(rows.groupBy("centre", "component").agg(F.min(F.struct("weight", "doc_id")).alias("_least")), "components")
    light = F.min(F.struct("_least.weight", "component", "_least.doc_id"))
    first = per.groupBy("centre").agg(light.alias("_first"))
    second = per.join(first, "centre").where("component <> _first.component").groupBy("centre").agg(light.alias("_second"))
    both = keep(first.join(second, "centre"), "lightest")
    other = F.when(F.col("component") == F.col("_first.component"), F.col("_second")).otherwise(F.col("_first"))
    return rows.join(both, "centre").withColumn("_other", other).withColumns({"other_weight": F.col("_other.weight"), "other": F.col("_other.doc_id")}).drop("_first", "_second", "_other")


def light_links(different: DataFrame) -> DataFrame:
    """Links (a, b) of documents to the lightest of another component, where weights alone decide.

    Where two documents' weights add up to base at most, each one's also does with the lightest, so no other such link is needed.
    """
    return lightest_other(different).where("weight + other_weight <= base").select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()


def heavy_links(different: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between components of documents around a centre whose weights do not decide: they share some of their differences.

    A document needs at least (weight + other_weight - base) / 7 shared differences with any, so of its differences that others have
    too, rarest first, all but that many and one more must have one in common with the other document's. Those with more differences of their own
    than a link allows are left out; documents of a component with equal differences are one, the lightest. Documents that meet are compared at
    once, by their differences; those with over INLINE are paired first and confirmed by their texts.
    """
    size = F.col("size")
    rows = lightest_other(different)
    least = different.groupBy("centre").agg(F.min("size").alias("_least"))
    rows = keep(rows.join(least, "centre"), "around")
    spelled = rows.select("centre", "doc_id", "text", "component", F.explode("differing").alias("element"))
    shared = keep(
        spelled.groupBy("centre", "element").agg(F.count("*").alias("_df"), F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high").select("centre", "element", "_df"), "shared"
    )
    met = spelled.join(shared, ["centre", "element"]).groupBy("centre", "doc_id", "text").agg(F.transform(F.sort_array(F.collect_list(F.struct("_df", "element"))), lambda x: x["element"]).alias("common"))
    need = F.greatest(F.ceil((F.col("weight") + F.col("other_weight") - F.col("base")) / 7), F.lit(1))
    n_common = F.size("common")
    held = rows.drop("differing").join(met, ["centre", "doc_id", "text"]).withColumn("_need", need)
    # what a document has beyond the centre and shares with nobody is in no intersection
    alone = F.col("extra") - F.size(F.filter("common", lambda x: x.bitwiseAND(F.lit(1)) == 1))
    held = held.where((n_common >= F.col("_need")) & (7 * (size - alone) >= 3 * (size + F.col("_least"))))
    classes = keep(held.groupBy("centre", "component", "base", "common").agg(F.min(F.struct("weight", "doc_id", "_need")).alias("_one")).select("centre", "component", "base", "common", "_one.*"), "classes")
    sizes = classes.groupBy("centre", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("centre").agg(F.max_by("component", F.struct("n", "component")).alias("_most"), F.count("*").alias("_groups")).where("_groups > 1").select("centre", "_most")
    n_common = F.size("common")
    tokens = classes.join(largest, "centre").select(
        "centre", "base", "_most", "component", "doc_id", "weight", n_common.alias("n"), F.when(n_common <= INLINE, F.col("common")).alias("common"),
        F.explode(F.slice("common", F.lit(1), (n_common - F.col("_need") + 1).cast("int"))).alias("token"),
    )
    tokens = keep(tokens, "tokens")
    side = lambda c: tokens.select("centre", "token", *(F.col(x).alias(f"{x}_{c}") for x in ("base", "_most", "component", "doc_id", "weight", "n", "common")))
    once = (F.col("component_b") == F.col("_most_b")) | (F.col("doc_id_a") < F.col("doc_id_b"))
    lacking = F.col("weight_a") + F.col("weight_b") - F.col("base_a")
    fits = lacking <= 7 * F.least("n_a", "n_b")
    linked = F.coalesce(lacking <= 7 * F.size(F.array_intersect("common_a", "common_b")), F.lit(True))
    found = side("a").where("component_a <> _most_a").join(side("b"), ["centre", "token"]).where((F.col("component_a") != F.col("component_b")) & once & fits & linked)
    decided = F.col("common_a").isNotNull() & F.col("common_b").isNotNull()
    found = keep(found.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b"), decided.alias("decided")).distinct(), "met")
    links = keep(found.where("decided").select("a", "b").union(confirm(found.where("not decided").select("a", "b"), texts)), "links")
    for table in (rows, shared, classes, tokens, found):
        forget(table)
    return links


def around_centres(rows: DataFrame, links: DataFrame) -> DataFrame:
    """centre, doc_id and component of rows (bucket, doc_id, component): a bucket's centre is the most linked document of its largest component."""
    ends = links.select(F.col("a").alias("_end")).union(links.select("b")).groupBy("_end").agg(F.count("*").alias("_n"))
    members = rows.select("component", "doc_id").distinct()
    rank = F.struct(F.coalesce("_n", F.lit(0)), -F.col("doc_id"))
    middle = members.join(ends, F.col("doc_id") == F.col("_end"), "left").groupBy("component").agg(F.max_by("doc_id", rank).alias("centre"))
    sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("component"))
    return rows.join(largest.join(middle, "component").select("bucket", "centre"), "bucket").select("centre", "doc_id", "component").distinct()


def near_duplicate_links(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All documents with doc_id, n_shingles and alike (the smallest doc_id of those with the same set), and the components of these.

    Documents with equal sets are one from here on. Documents that share a band are candidates. A bucket's are first linked to one of them, drawn
    anew each turn while groups are apart; in the end those still apart are compared by their differences from a common centre (differences), so a
    link is missed only if no band is shared.
    """
    signed = keep(document_signatures(documents), "signatures")
    alike = signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("alike"))
    alike = keep(alike, "alike")
    own = ["set_a", "set_b", "n_shingles"]
    first = keep(signed.join(alike.withColumn("doc_id", F.col("alike")), [*own, "doc_id"]).select("doc_id", "n_shingles", "packed", "bands").dropDuplicates(["doc_id", "n_shingles", "packed"]), "first")
    band = first.select("doc_id", F.explode("bands").alias("bucket"))
    shared = band.groupBy("bucket").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high")).where("_low < _high").select("bucket")
    band = keep(band.join(shared, "bucket").select("bucket", "doc_id"), "buckets")
    used = band.select("doc_id").distinct()
    texts = keep(documents.select(F.col("doc_id").cast("long"), "text").join(used, "doc_id").dropDuplicates(["doc_id", "text"]), "texts")
    bits = keep(first.join(used, "doc_id").select("doc_id", "n_shingles", "packed"), "bits")
    forget(first)

    def candidates(pairs: DataFrame) -> DataFrame:
        a = bits.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("packed").alias("packed_a"))
        b = bits.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("packed").alias("packed_b"))
        size = (100 * F.least("n_a", "n_b")) >= LINK * F.greatest("n_a", "n_b")
        return pairs.join(a, "a").join(b, "b").where(size & (estimate("packed_a", "packed_b") >= LEAST_ESTIMATE)).select("a", "b").distinct()

    def labelled(rows: DataFrame, group: DataFrame | None) -> DataFrame:
        """rows with component, so far."""
        if group is None:
            return rows.withColumn("component", F.col("doc_id"))
        return rows.join(group, F.col("doc_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "doc_id")).drop("node")

    def apart(group: DataFrame | None) -> DataFrame:
        """bucket, doc_id and component of buckets whose documents are not all in one."""
        rows = labelled(band, group)
        several = rows.groupBy("bucket").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high").select("bucket")
        return keep(rows.join(several, "bucket"), "apart")

    links = group = None
    for turn in range(STARS):
        rows = apart(group)
        centre = rows.groupBy("bucket").agg(F.min_by(F.struct("doc_id", "component"), F.struct(F.xxhash64(F.lit(turn), "doc_id"), "doc_id")).alias("_c")).select("bucket", F.col("_c.doc_id").alias("a"), F.col("_c.component").alias("_own"))
        pairs = rows.join(centre, "bucket").where("component <> _own").groupBy(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).agg(F.count("*").alias("n"))
        if group is None:  # most need no more than the centre they share most bands with
            pairs = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
        pairs = keep(candidates(pairs.select("a", "b")), "stars")
        found = keep(confirm(pairs, texts), "links")
        links = found if links is None else links.union(found)
        group = components(links)
        forget(rows)
        forget(pairs)
    rows = apart(group)
    different = keep(differences(around_centres(rows, links).select("centre", "doc_id"), texts), "differences")
    links = links.union(keep(light_links(labelled(different, group)), "links"))
    group = components(links)
    last = heavy_links(labelled(different, group), texts)
    documents_of = signed.select("doc_id", *own).join(alike, own, "left").select("doc_id", "n_shingles", F.coalesce("alike", "doc_id").alias("alike"))
    sets = documents_of.where("doc_id is not null").groupBy("doc_id").agg(F.min("alike").alias("_low"), F.max("alike").alias("_high")).where("_low < _high").select("doc_id")
    same = keep(documents_of.join(sets, "doc_id").where("doc_id <> alike").select(F.col("doc_id").alias("a"), F.col("alike").alias("b")).distinct(), "same")  # an id of several sets links them
    if not (last.isEmpty() and same.isEmpty()):
        links = links.union(last).union(same)
        group = components(links)
    for table in (band, texts, bits, rows, different):
        forget(table)
    return documents_of, group


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document.

    Texts with A-Z lowered are sets of five-word shingles. Null texts and texts without words have empty sets and are linked with nothing;
    rows with a null doc_id too: their component_id is null and they are kept. Rows that repeat a doc_id are one document with several
    texts: a link of any is a link of it. Other columns are not read; an empty table gives an empty result.
    """
    labelled, group = near_duplicate_links(documents)
    found = labelled.join(group, labelled.alike == group.node, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "alike")).alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """The documents that near_duplicates keeps, with all their columns; of rows alike in doc_id and text one stays, the least by its other columns' hash."""
    ids = near_duplicates(documents)
    kept = keep(ids.select("doc_id", "kept"), "kept")
    repeated = not kept.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    good = kept.where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept")).distinct().hint("shuffle_merge")
    rows = documents.select(F.col("doc_id").alias("_id"), F.struct("*").alias("_row"))
    out = rows.join(good, F.col("_id") == F.col("_kept"), "left_semi").union(rows.where("_id is null"))
    if not repeated:
        return out.select("_row.*")
    texts = out.select("_id", F.xxhash64("_row.text").alias("_a"), F.xxhash64(F.lit(1), "_row.text").alias("_b"), "_row")
    return one_of_alike(texts, ["_id", "_a", "_b"], "_row").select("_row.*")
