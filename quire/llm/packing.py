"""Best-fit packing: a configuration linear program over the length histogram, solved by multiplicative weights and rounded."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bits_for, keep, spread_rank

CAPACITY = 2048
#: Token ids cached per task: words up to so many bytes, and so many of them in each Python worker before it drops the later half.
CACHED_BYTES, CACHED_WORDS = 48, 300_000
#: Texts whose new words are tokenized together, and their bytes; a longer text is alone.
TOGETHER, TOGETHER_BYTES = 256, 1 << 20


MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def marks_apart(word: bytes) -> tuple[bytes, bytes] | None:
    """The word and the ASCII marks at its end, if it ends in an ASCII letter or digit, or a Latin letter of two bytes, before them."""
    stem = word.rstrip(MARKS)
    if b"<|" in word or not (stem[-1:].isalnum() or (len(stem) > 1 and stem[-2] == 0xC3 and stem[-1] not in (0x97, 0xB7))):
        return None
    return stem, word[len(stem) :]


def lowered_words(text: bytes) -> list[bytes]:
    """The words of a text, with A-Z lowered unless the tokenizer, which composes letters with marks first, would see another word.

    Letters of ASCII are composed only with U+0300 to U+036F, whose UTF-8 begins with CC or CD, as that of no other character does but a few. In texts with
    these, words with other than ASCII stay as they are, and so do texts that may hold special tokens.
    """
    if b"<|" in text:
        return text.split()
    if b"\xcc" not in text and b"\xcd" not in text:
        return text.lower().split()
    return [w.lower() if w.isascii() else w for w in text.split()]


class Tokens:
    """Ids of texts by a tokenizer file. Its words never span ASCII white space, so each word between is tokenized once and remembered."""

    _open: dict[str, Tokens] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.known: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Tokens:
        """The one of this Python worker, which later tasks use again."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids as unsigned 32-bit numbers, little-endian as all machines that Spark runs on are.

        The tokenizer lowers case, so A-Z are lowered before where that changes nothing (lowered_words). ASCII marks right behind a
        letter or digit are a word of their own to it, so they are looked up apart.
        """
        if len(self.known) > CACHED_WORDS:
            self.known = dict(islice(self.known.items(), CACHED_WORDS // 2))  # the first ones, as frequent words come early
        words = list(map(lowered_words, texts))
        known, new = self.known, set()
        for text in words:
            new.update(text)
        new = new.difference(known)  # looks only at the new ones
        parts = {w: cut for w in new if w[-1] in MARKS and (cut := marks_apart(w))}
        whole = list({x for w in new for x in parts.get(w, (w,))}.difference(known))
        other = []
        for word in whole:
            if word.isalpha() and word.islower():  # to the tokenizer one word, as it is: only the merges are left to do
                known[word] = array("I", [t.id for t in self.merges(word.decode())]).tobytes()
            else:
                other.append(word)
        found = self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False) if other else []
        for word, one in zip(other, found, strict=True):
            known[word] = array("I", one.ids).tobytes()
        for word, (stem, mark) in parts.items():
            known[word] = known[stem] + known[mark]
        out = [b"".join(map(known.__getitem__, text)) for text in words]
        for word in {w for w in (*whole, *parts) if len(w) > CACHED_BYTES}:
            del known[word]
        return out


def together(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """First text and number of texts that are tokenized together: TOGETHER of them, and TOGETHER_BYTES, at most."""
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes):
        fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER_BYTES, side="right")) - at
        n = max(1, min(TOGETHER, fit, len(sizes) - at))
        yield at, n
        at += n


def token_pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece: ids of the text and a final 0, cut at capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.of(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for at, n in together(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)):
                part = [t or b"" for t in texts.slice(at, n).to_pylist()]
                owner, piece, length, crc = [], [], [], []
                for row, data in enumerate(tokens.encode(part)):
                    data += b"\0\0\0\0"
                    for k in range(0, len(data), 4 * capacity):
                        chunk = data[k : k + 4 * capacity]
                        owner.append(at + row)
                        piece.append(k // (4 * capacity))
                        length.append(len(chunk) // 4)
                        crc.append(zlib.crc32(chunk))
                number = np.array(piece, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner, pa.int64())), pa.array(number.astype(np.int32)), pa.array(number * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    doc_id = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(cut, f"doc_id {doc_id}, piece int, start long, length long, ids_crc32 long")


def price_best(prices: np.ndarray, capacity: int) -> list[int]:
    """Unbounded knapsack: lengths, longest first, whose prices sum up highest within capacity. prices[l] is length l's."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    usable = np.flatnonzero(prices > 0)
    for room in range(1, capacity + 1):
        fits = usable[: np.searchsorted(usable, room, side="right")]
        if len(fits):
            worth = prices[fits] + best[room - fits]
            k = int(worth.argmax())
            best[room], choice[room] = worth[k], fits[k]
    found, room = [], capacity
    while room > 0 and choice[room]:
        found.append(int(choice[room]))
        room -= choice[room]
    return sorted(found, reverse=True)


def fractional_configurations(counts: np.ndarray, capacity: int, rounds: int, step: float = 0.15) -> dict[tuple[int, ...], float]:
    """Configurations and how often each is used, covering counts, by multiplicative weights on the covering program.

    Each length's weight falls by exp(-step * its coverage) as configurations cover it; a round adds the configuration of most
    weight per covered piece, found by the knapsack, in the amount that covers some length once over.
    """
    used: dict[tuple[int, ...], float] = {}
    lengths = np.flatnonzero(counts)
    cover = np.zeros(len(counts))
    log = np.zeros(len(counts))
    for _ in range(rounds):
        prices = np.zeros(len(counts))
        weight = np.exp(log[lengths] - log[lengths].max())
        prices[lengths] = weight / counts[lengths]
        config = price_best(prices, capacity)
        have = np.bincount(config, minlength=len(counts))
        inside = np.flatnonzero(have)
        amount = float((counts[inside] / have[inside]).min())
        used[tuple(config)] = used.get(tuple(config), 0.0) + amount
        gained = amount * have[inside] / counts[inside]
        cover[inside] += gained
        log[inside] -= step * gained
    scale = cover[lengths].mean() if len(lengths) else 1.0
    return {config: amount / scale for config, amount in used.items()}


def plan_sequences(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = 150) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and whole numbers of sequences for them that hold exactly counts[l] pieces of each length l.

    Fractional uses are rounded down, as far as pieces are left; what remains goes by the program solved again on the rest, and in the
    end by best fit decreasing. The work depends on capacity and rounds, not on the number of pieces.
    """
    left, plan = counts.astype(np.int64).copy(), []
    full = int(left[capacity])
    left[capacity] = 0
    if full:
        plan.append(((capacity,), full))

    def use(config: tuple[int, ...], times: int) -> None:
        have = np.bincount(config, minlength=len(left))
        inside = np.flatnonzero(have)
        times = int(min(times, (left[inside] // have[inside]).min()))
        if times > 0:
            left[inside] -= times * have[inside]
            plan.append((config, times))

    for part in (rounds, rounds // 3, rounds // 3):
        if left.sum() < 50:
            break
        for config, amount in sorted(fractional_configurations(left, capacity, part).items(), key=lambda x: (-sum(x[0]), -x[1], x[0])):
            use(config, int(amount))
    # Best fit decreasing on counts: alike bins are kept as one entry with a number, so work follows lengths, not pieces.
    while left.any():
        config, room = [], capacity
        while room > 0:
            fits = np.flatnonzero(left[: room + 1] - np.bincount(config, minlength=len(left))[: room + 1] > 0)
            if not len(fits):
                break
            config.append(int(fits[-1]))
            room -= config[-1]
        use(tuple(config), int(left.sum()))
    return plan


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length the runs of places in order: rank of the first, sequence of the first, offset; all of a run are in sequences one after another."""
    rows, base = [], 0
    for config, times in plan:
        offset = 0
        for length in config:
            rows.append((length, times, base, offset))
            offset += length
        base += times
    table = np.array(rows, np.int64).reshape(-1, 4)
    table = table[np.argsort(table[:, 0], kind="stable")]
    before = np.cumsum(table[:, 1]) - table[:, 1]
    _, first, inverse = np.unique(table[:, 0], return_index=True, return_inverse=True)
    return {"length": table[:, 0], "rank": before - before[first][inverse] if len(table) else before, "sequence": table[:, 2], "offset": table[:, 3]}


def pack(pieces: DataFrame, capacity: int = CAPACITY, identity: list[Column] | None = None, rounds: int = 150) -> DataFrame:
    """Add sequence_id and offset (from 0, gapless) to pieces of a length from 1 to capacity, in about as few sequences as possible.

    Only the length histogram reaches the driver: capacity numbers. The plan that returns to the tasks has a row for each place in
    each configuration, a number bounded by capacity and rounds. Which piece of a length gets which of its places goes by hash.
    """
    columns = pieces.columns
    ranked_by = F.xxhash64(*(identity or [F.col(c) for c in pieces.columns]))
    hashed = keep(pieces.withColumn("_h", ranked_by), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in hashed.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[row["length"]] = row["n"]
    places = slots(plan_sequences(counts, capacity, rounds))
    key = places["length"] * (1 << 40) + places["rank"]
    ranked = spread_rank(hashed, ["length"], "_h", "_rank", bits_for(int(counts.max()), 200_000), ties=[F.col(c) for c in columns])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(key, length * (1 << 40) + rank, side="right") - 1
            added = [pa.array(places["sequence"][at] + rank - places["rank"][at]), pa.array(places["offset"][at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *added], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.select(*columns, "_rank").mapInArrow(place, schema)


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    A null or empty text has the one id 0. Only documents longer than capacity are cut. Repeated rows are packed each, null ids stay null,
    other columns are not read, an empty table gives an empty result.
    """
    return pack(token_pieces(documents, tokenizer, capacity), capacity)
