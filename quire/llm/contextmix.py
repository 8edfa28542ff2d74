"""Scores of texts by a language model: bits of words predicted from hashed contexts, mixed by gated weights that are learned online.

A text is a row of words, lower-cased, and an end. Each word is spelled: its bytes and a stop are coded as bits of a fixed prefix code, the end is a
word without bytes. For every bit several predictors look up how often it was 0 and 1 behind their context: the last bytes of the word, all of them,
or all of them and the word before. Their log odds are added up with weights that a gate chooses, and the sum is refined by what was seen where sums
were alike. The product over all bits is a probability of the text.

Counts, weights and the refinement are of all training texts. Counts are added up in the tasks, merged in blocks of slots by Spark, and what reaches the driver and every task is
the table of slots: MOST_BITS bounds it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import forget, keep
from quire.llm.textarrays import LOWER, U64, Block, Prefix, mix

FOLDS, HELD_OUT = 5, 1
#: Each predictor has 2 to the power of at most so many slots; fewer where there are fewer than a quarter as many training tokens.
MOST_BITS = (16, 20, 22, 24, 24)
#: Bytes of texts that share a table of their words, and of those that a task looks at together.
BUFFER, SLICE = 16 << 20, 1 << 20
#: Rows that Spark hands to a task's Python at once: a batch of texts is held on both sides.
ROWS = 2000
#: Bytes of a word that the word before speaks for.
SPOKEN = 3
STOP = 0x20
ORDERS = (1, 2, 4)
PREDICTORS = len(ORDERS) + 2  # and all bytes of the word, and these with the word before
INPUTS = 1 + PREDICTORS
PLACES, SURE, SPOKEN_SURE = 6, 5, 3
#: A gate for each place in a word and how sure the predictors are that know all of the word, without and with the word before.
GATES = PLACES * SURE * SPOKEN_SURE
BUCKETS, REACH = 64, 8.0
#: Slots that are merged as one row.
SLOTS = 4096
#: Bits, and words, that are looked at together.
CHUNK, WORDS = 1 << 16, 1 << 13
#: Bits after which the weights that are being learned change.
STEP = 1 << 14
RATE, PRIOR = 0.05, 30.0
_NODES = mix(np.arange(1, 513, dtype=U64) * U64(0x9E3779B97F4A7C15))
_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))
_ODD = U64(0xA24BAED4963EE407)


def _prefix_code() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each byte where its path starts and how many bits it has; and of all paths the nodes and bits. Frequent letters have few."""
    weight = {b: 1e-3 if b >= 128 else 1e-5 if b < 32 else 2e-3 for b in range(256) if chr(b) not in "\t\n\v\f\r" and not 65 <= b <= 90}
    weight |= {ord(c): 1 / (k + 8) for k, c in enumerate("etaoinshrdlcumwfgypbvkjxqz")} | {STOP: 0.25}
    heap = [(w, b, b) for b, w in weight.items()]
    heapq.heapify(heap)
    count = 256
    while len(heap) > 1:
        (w, _, a), (v, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (w + v, count, (count - 256, a, b)))
        count += 1
    paths: dict[int, list[tuple[int, int]]] = {}
    stack = [(heap[0][2], [])]
    while stack:
        tree, path = stack.pop()
        if isinstance(tree, int):
            paths[tree] = path
        else:
            stack += [(tree[1 + bit], [*path, (tree[0], bit)]) for bit in (0, 1)]
    sizes = np.array([len(paths.get(b, ())) for b in range(256)])
    flat = [step for b in range(256) for step in paths.get(b, ())]
    return np.cumsum(sizes) - sizes, sizes, np.array([n for n, _ in flat]), np.array([b for _, b in flat], np.uint8)


PATH_START, PATH_SIZE, PATH_NODE, PATH_BIT = _prefix_code()
#: What an 8-bit count stands for: exact up to 63, then in steps of a tenth.
COUNTS = np.concatenate([np.arange(64), np.round(63 * 1.1 ** np.arange(1, 193))])


def _log_odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.clip(np.log((np.maximum(ones, 0) + 0.4) / (np.maximum(zeros, 0) + 0.4)), -REACH, REACH).astype(np.float32)


_ZEROS, _ONES = np.repeat(COUNTS, 256), np.tile(COUNTS, 256)
#: By a slot's 16 bits: the log odds; the same without one 0 or one 1; and how sure it is.
STRETCH = _log_odds(_ZEROS, _ONES)
WITHOUT = np.concatenate([_log_odds(_ZEROS - 1, _ONES), _log_odds(_ZEROS, _ONES - 1)])
SURENESS = np.searchsorted([1, 2, 4, 16], _ZEROS + _ONES, side="right").astype(np.int32)
_SPOKEN = np.array([0, 1, 1, 2, 2], np.int32)
SURENESS_WITHOUT = np.searchsorted([1, 2, 4, 16], _ZEROS + _ONES - 1, side="right").astype(np.int32)


@dataclass
class Texts:
    """Tokens of some texts: words, the distinct ones (the empty one is the end), number of each token's word, its text, and the word before or -1."""

    words: pa.Array
    token: np.ndarray
    text: np.ndarray
    before: np.ndarray


def lexed(texts: pa.Array) -> Texts:
    """Null texts are empty; each text has at least its end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    block = Block(0, LOWER[data], offsets[:-1] - offsets[0], offsets[1:] - offsets[0])
    starts, ends = block.words
    of = block.word_text
    sizes = np.zeros(len(starts) + n, np.int64)
    text = np.zeros(len(sizes), np.int64)
    at = np.arange(len(starts)) + of
    sizes[at], text[at] = ends - starts, of
    text[block.word_range[1] + np.arange(n)] = np.arange(n)
    places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    tokens = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(block.data[~block.space]))]).dictionary_encode()
    token = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.full(len(token), -1, np.int64)
    before[1:] = np.where(text[1:] == text[:-1], token[:-1], -1)
    return Texts(tokens.dictionary, token, text, before)


@dataclass
class Bits:
    """Bits of some words: number of the word, place of the byte in it, node and bit, the byte before, and a hash for each predictor."""

    word: np.ndarray
    place: np.ndarray
    bit: np.ndarray
    last: np.ndarray
    hashes: list[np.ndarray]

    def __len__(self) -> int:
        return len(self.word)


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words, each with its stop; word and place of each; and a hash of each word up to each byte."""
    n = len(words)
    data, offsets = flat(words)
    sizes = np.diff(offsets)
    word = np.repeat(np.arange(n, dtype=np.int32), sizes + 1)
    start = offsets[:-1] + np.arange(n)
    symbols = np.full(len(word), STOP, np.uint8)
    place = (np.arange(len(word)) - start[word]).astype(np.int32)
    symbols[place < sizes[word]] = data
    return symbols, word, place, Prefix(_CODES[symbols], 3).hash(start[word], np.arange(len(word)))


def bits_of(words: pa.Array, late: bool | None = None, orders: tuple[int, ...] = ORDERS) -> Iterator[Bits]:
    """All bits of all words, in pieces; late: of the bytes behind the first ones alone, or of the first ones alone. Hashes of some orders and of all bytes."""
    for low in range(0, len(words), WORDS):
        for piece in _bits_of(words.slice(low, WORDS), late, orders):
            piece.word += np.int32(low)
            yield piece


def _bits_of(words: pa.Array, late: bool | None, orders: tuple[int, ...]) -> Iterator[Bits]:
    symbols, word, place, whole = spelled(words)
    before = [np.where(place >= k, np.concatenate([np.zeros(k, np.uint8), symbols[: len(symbols) - k]])[: len(symbols)], 0).astype(U64) for k in range(1, max((1, *orders)) + 1)]
    if late is not None:
        some = np.flatnonzero((place >= SPOKEN) == late)
        symbols, word, place, whole, before = symbols[some], word[some], place[some], whole[some], [b[some] for b in before]
    width = PATH_SIZE[symbols]
    cut = np.concatenate([np.searchsorted(np.cumsum(width), np.arange(0, width.sum(), CHUNK)), [len(symbols)]])
    for low, high in zip(cut[:-1], cut[1:], strict=True):
        if low == high:
            continue
        here = slice(low, high)
        size = width[here]
        at = np.repeat(np.arange(high - low, dtype=np.int32), size)
        step = np.repeat(PATH_START[symbols[here]] - (np.cumsum(size) - size), size) + np.arange(len(at))
        node = _NODES[PATH_NODE[step]]
        hashes = []
        for k in orders:
            context = np.zeros(high - low, U64)
            for j in range(k):
                context = (context << U64(8)) | before[j][here]
            hashes.append(mix(context + U64(k << 56))[at] ^ node)
        hashes.append(whole[here][at] ^ node)
        yield Bits(word[here][at], place[here][at], PATH_BIT[step], before[0][here][at].astype(np.int32), hashes)


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes * _ODD) >> U64(64 - bits)).astype(np.int64)


def flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words in a row, and where each begins and ends."""
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word; at the end of the array, for no word before, another."""
    data, offsets = flat(words)
    return np.append(mix(Prefix(_CODES[data], 3).hash(offsets[:-1], offsets[1:]) + U64(1)), U64(77))


@dataclass
class Pairs:
    """Heads, the distinct first bytes of words, and distinct (word before, head): number of the word, number of the head, and number of each token's pair.

    Bits of first bytes depend on no more of a word than its head, of which there are few.
    """

    heads: pa.Array
    first: np.ndarray
    second: np.ndarray
    token: np.ndarray


def pairs_of(texts: Texts) -> Pairs:
    heads = pc.binary_slice(texts.words, 0, SPOKEN).dictionary_encode()
    n, head = max(len(heads.dictionary), 1), heads.indices.to_numpy().astype(np.int64)
    key, number = np.unique((texts.before + 1) * n + head[texts.token], return_inverse=True)
    return Pairs(heads.dictionary, key // n - 1, key % n, number)


@dataclass
class Opening:
    """Bits of heads, where each head's begin and how many there are."""

    bits: Bits
    start: np.ndarray
    size: np.ndarray

    def of_pairs(self, pairs: Pairs, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """In pieces: number of the pair, place of the bit, and its hash with the word before."""
        size = self.size[pairs.second]
        ends = np.cumsum(size)
        cut = np.concatenate([np.searchsorted(ends, np.arange(0, size.sum(), CHUNK)), [len(size)]])
        for low, high in zip(cut[:-1], cut[1:], strict=True):
            if low == high:
                continue
            some = size[low:high]
            pair = np.repeat(np.arange(low, high), some)
            at = np.repeat((self.start[pairs.second[low:high]] - (np.cumsum(some) - some)).astype(np.int32), some) + np.arange(len(pair), dtype=np.int32)
            yield pair, at, before[pairs.first[pair]] + self.bits.hashes[-1][at]


def opening(pieces: list[Bits], n: int) -> Opening:
    """The bits of n heads, from their pieces."""
    if not pieces:
        none = np.zeros(0, np.int32)
        return Opening(Bits(none, none, none.astype(np.uint8), none, [none.astype(U64)]), np.zeros(n, np.int64), np.zeros(n, np.int64))
    join = lambda get: np.concatenate([get(b) for b in pieces])
    word = join(lambda b: b.word)
    size = np.bincount(word, minlength=n)
    return Opening(Bits(word, join(lambda b: b.place), join(lambda b: b.bit), join(lambda b: b.last), [join(lambda b: b.hashes[-1])]), np.cumsum(size) - size, size)


@dataclass
class Model:
    """Tables of slots (16 bits each: two counts), weights by gate, and the refinement by last byte and bucket."""

    bits: list[int]
    tables: list[np.ndarray]
    weights: np.ndarray
    refined: np.ndarray

    def inputs(self, piece: Bits, taken_out: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of the predictors that look at the word alone, a row for each, and gates; taken_out: as if this very bit had not been counted."""
        rows, code = np.empty((len(piece.hashes), len(piece)), np.float32), None
        for k, (table, bits, hashes) in enumerate(zip(self.tables, self.bits, piece.hashes, strict=False)):
            code = table[slots(hashes, bits)]
            rows[k] = self.odds(code, piece.bit if taken_out else None)
        return rows, gate(piece.place, sureness(code, taken_out))

    def weighted(self, rows: np.ndarray, gates: np.ndarray) -> np.ndarray:
        """Sums of a bias and rows with the gates' weights."""
        weights = self.weights.T.astype(np.float32)
        sums = weights[0][gates]
        for row, weight in zip(rows, weights[1:], strict=False):
            sums += row * weight[gates]
        return sums

    def with_before(self, hashes: np.ndarray, bit: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of the predictor that knows the word before, and how sure it is; bit: to be taken out."""
        code = self.tables[-1][slots(hashes, self.bits[-1])]
        return self.odds(code, bit), _SPOKEN[sureness(code, bit is not None)]

    @staticmethod
    def odds(code: np.ndarray, bit: np.ndarray | None) -> np.ndarray:
        return STRETCH[code] if bit is None else WITHOUT[code | (bit.astype(np.int64) << 16)]

    def chance(self, sums: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of a 1: by the sums alone, and refined."""
        plain = squash(sums)
        return plain, np.float32(0.5) * (plain + self.refined.astype(np.float32)[cells(sums, last)])

    def logarithms(self, sums: np.ndarray, last: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """log10 of the probability of each bit."""
        _, p = self.chance(sums, last)
        return np.log(np.abs(p - (1 - bit).astype(np.float32))) * np.float32(1 / math.log(10))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -11, 11)))


def cells(sums: np.ndarray, last: np.ndarray) -> np.ndarray:
    bucket = np.clip((sums + np.float32(REACH)) * np.float32(BUCKETS / (2 * REACH)), 0, BUCKETS - 1).astype(np.int32)
    return last * np.int32(BUCKETS) + bucket


def plain_refinement() -> np.ndarray:
    middles = (np.arange(BUCKETS) + 0.5) * (2 * REACH / BUCKETS) - REACH
    return np.tile(squash(middles), 256)


def plain_weights() -> np.ndarray:
    weights = np.full((GATES, INPUTS), 0.3)
    weights[:, 0] = 0
    return weights


def sureness(code: np.ndarray, taken_out: bool) -> np.ndarray:
    return (SURENESS_WITHOUT if taken_out else SURENESS)[code]


def gate(place: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Gate without a word before; how sure that one is is added."""
    return (np.minimum(place, PLACES - 1) * SURE + sure) * SPOKEN_SURE


def opened(model: Model, heads: pa.Array, taken_out: bool) -> tuple[Opening, np.ndarray, np.ndarray]:
    """The bits of heads, with their rows of log odds and gates."""
    pieces, rows, gates = [], [np.zeros((PREDICTORS - 1, 0), np.float32)], [np.zeros(0, np.int32)]
    for piece in bits_of(heads, late=False):
        x, g = model.inputs(piece, taken_out)
        rows.append(x)
        gates.append(g)
        piece.hashes = piece.hashes[-1:]
        pieces.append(piece)
    return opening(pieces, len(heads)), np.concatenate(rows, axis=1), np.concatenate(gates)


def late_scores(model: Model, words: pa.Array) -> np.ndarray:
    """log10 of the probability of each word's bytes behind the first ones, which are the same in all texts."""
    alone = np.zeros(len(words))
    for piece in bits_of(words, late=True):
        x, gates = model.inputs(piece, False)
        alone += np.bincount(piece.word, model.logarithms(model.weighted(x, gates), piece.last, piece.bit), len(alone))
    return alone


def scores(model: Model, texts: Texts, n: int, alone: np.ndarray | None = None) -> np.ndarray:
    """log10 of the probability of each of n texts. alone: late_scores of the words, where they are known."""
    alone = late_scores(model, texts.words) if alone is None else alone
    pairs = pairs_of(texts)
    first, x, gates = opened(model, pairs.heads, False)
    of_pair = np.zeros(len(pairs.first))
    by_sureness = np.stack([model.weighted(x, gates + s) for s in range(SPOKEN_SURE)], axis=1).ravel()
    spoken = model.weights[:, -1].astype(np.float32)[gates[:, None] + np.arange(SPOKEN_SURE)].ravel()
    for pair, at, hashes in first.of_pairs(pairs, word_hashes(texts.words)):
        odds, sure = model.with_before(hashes, None)
        both = at * SPOKEN_SURE + sure
        sums = by_sureness[both] + spoken[both] * odds
        of_pair += np.bincount(pair, model.logarithms(sums, first.bits.last[at], first.bits.bit[at]), len(of_pair))
    return np.bincount(texts.text, alone[texts.token] + of_pair[pairs.token], n)


@dataclass
class Lesson:
    """For learning: gates, log odds of the first predictors, bit, byte before, and how often; each bit's own count is taken out."""

    gates: np.ndarray
    rows: list[np.ndarray]
    bit: np.ndarray
    last: np.ndarray
    times: np.ndarray


def late_lessons(model: Model, words: pa.Array, times: np.ndarray) -> Iterator[Lesson]:
    """Of words' bytes behind the first ones, for which the word before counts nothing."""
    for piece in bits_of(words, late=True):
        x, gates = model.inputs(piece, True)
        yield Lesson(gates, list(x), piece.bit, piece.last, times[piece.word])


def early_lessons(model: Model, texts: Texts) -> Iterator[Lesson]:
    """Of the first bytes of all words."""
    pairs = pairs_of(texts)
    first, x, gates = opened(model, pairs.heads, True)
    times = np.bincount(pairs.token, minlength=len(pairs.first))
    for pair, at, hashes in first.of_pairs(pairs, word_hashes(texts.words)):
        bit = first.bits.bit[at]
        odds, sure = model.with_before(hashes, bit)
        yield Lesson(gates[at] + sure, [*(row[at] for row in x), odds], bit, first.bits.last[at], times[pair])


class Learner:
    """Weights that follow lessons online, in steps of STEP bits, and what was seen by last byte and bucket of the weighted sum."""

    def __init__(self) -> None:
        self.weights, self.squares, self.seen = plain_weights(), np.full((GATES, INPUTS), 1e-4), np.zeros(GATES)
        self.ones, self.all = np.zeros(256 * BUCKETS), np.zeros(256 * BUCKETS)

    def learn(self, lesson: Lesson) -> None:
        sums = np.empty(len(lesson.gates), np.float32)
        for low in range(0, len(sums), STEP):
            few = slice(low, low + STEP)
            g, here, rows = lesson.gates[few].astype(np.intp), lesson.times[few].astype(np.float64), [row[few] for row in lesson.rows]
            weights = self.weights.T.astype(np.float32)
            x = weights[0][g]
            for row, weight in zip(rows, weights[1:], strict=False):
                x += row * weight[g]
            sums[few] = x
            miss = (lesson.bit[few] - squash(x)) * here
            total = np.bincount(g, here, GATES)
            slope = np.zeros((GATES, INPUTS))
            slope[:, 0] = np.bincount(g, miss, GATES)
            for k, row in enumerate(rows, 1):
                slope[:, k] = np.bincount(g, miss * row, GATES)
            slope /= np.maximum(total, 1)[:, None]
            self.squares += slope**2
            self.weights += RATE * slope / np.sqrt(self.squares)
            self.seen += total
        cell = cells(sums, lesson.last)
        self.all += np.bincount(cell, lesson.times, len(self.all))
        self.ones += np.bincount(cell, lesson.times * lesson.bit, len(self.ones))

    def learned(self) -> pa.RecordBatch:
        """gate, at, total and seen: of each gate that was seen the weights times how many bits that were, and with gate -1 cells."""
        made = [(g, i, self.weights[g, i] * self.seen[g], self.seen[g]) for g in np.flatnonzero(self.seen).tolist() for i in range(INPUTS)]
        made += [(-1, c, self.ones[c], self.all[c]) for c in np.flatnonzero(self.all).tolist()]
        columns = list(zip(*made, strict=True)) or [[]] * 4
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["gate", "at", "total", "seen"])


# Jobs. ----------------------------------------------------------------------------------------------------------------------------


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run meanwhile hand ROWS rows at most to Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), ROWS) if int(before) > 0 else ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def buffered(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, text and buffer: rows that a task reads in a row share a buffer of about BUFFER bytes; a longer text has its own.

    A null doc_id counts as empty text, which is not held out.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16
            buffer = (done + np.cumsum(size)) // BUFFER
            done += int(size.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(buffer + (task << 32), pa.int64())], [*batch.schema.names, "buffer"])

    sum_ = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    held = sum_ % FOLDS == HELD_OUT
    some = documents.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text")
    return some.mapInArrow(number, "doc_id long, held_out boolean, text string, buffer long")


def slices(rows: pa.Table | pa.RecordBatch) -> Iterator[pa.Table | pa.RecordBatch]:
    """Rows of a buffer in pieces of about SLICE bytes; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(rows.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(ends // SLICE)) + 1, [len(ends)]]).tolist()
    for low, high in zip(cut[:-1], cut[1:], strict=True):
        yield rows.slice(low, high - low)
        pa.default_memory_pool().release_unused()


def by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Each row's buffer with rows in a row that share it, about SLICE bytes of them at most; no more than one batch is in memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buffer = batch.column("buffer").to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(np.diff(buffer)) + 1, [len(buffer)]]).tolist()
        for low, high in zip(cut[:-1], cut[1:], strict=True):
            for part in slices(batch.slice(low, high - low)):
                yield int(buffer[low]), part


def word_counts(rows: DataFrame) -> DataFrame:
    """buffer, word and n, how often it is in training texts of the buffer; words of held-out texts alone have 0."""

    def total(buffer: int, words: list[pa.Array], n: list[np.ndarray]) -> pa.RecordBatch:
        found = pa.concat_arrays(words).dictionary_encode()
        times = np.bincount(found.indices.to_numpy(), np.concatenate(n), len(found.dictionary)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(times), buffer), pa.int64()), found.dictionary.cast(pa.binary()), pa.array(times)], ["buffer", "word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, n = None, [], []
        for buffer, part in by_slice(batches):
            if words and buffer != held:
                yield total(held, words, n)
                words, n = [], []
            held = buffer
            texts = lexed(part.column("text"))
            train = ~part.column("held_out").to_numpy(zero_copy_only=False)
            words.append(texts.words)
            n.append(np.bincount(texts.token, train[texts.text], len(texts.words)))
        if words:
            yield total(held, words, n)

    return rows.select("held_out", "text", "buffer").mapInArrow(count, "buffer long, word binary, n long")


def packed_counts(counts: np.ndarray) -> bytes:
    """A block's counts, those that are not 0: their places, as numbers where they are few or else a bit for each place, and the counts less one in four bits.

    Those of 16 and more follow, in one byte each or in four; before all stand this width and how many places there are.
    """
    at = np.flatnonzero(counts)
    less = counts[at].astype(np.int64) - 1
    few = np.minimum(less, 15).astype(np.uint8)
    if len(few) % 2:
        few = np.append(few, np.uint8(0))
    many = less[less >= 15] - 15
    kind = np.uint8 if not len(many) or many.max() < 256 else np.uint32
    places = at.astype(np.uint16) if 16 * len(at) < len(counts) else np.packbits(counts > 0)
    return bytes([np.dtype(kind).itemsize]) + len(at).to_bytes(2, "little") + places.tobytes() + (few[::2] | (few[1::2] << 4)).tobytes() + many.astype(kind).tobytes()


def add_packed(sums: np.ndarray, packed: bytes) -> None:
    width, n, begin = packed[0], int.from_bytes(packed[1:3], "little"), 3
    if 16 * n < len(sums):
        at, begin = np.frombuffer(packed, np.uint16, n, begin), begin + 2 * n
    else:
        at, begin = np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, len(sums) // 8, begin))), begin + len(sums) // 8
    halves = np.frombuffer(packed, np.uint8, (n + 1) // 2, begin)
    less = np.stack([halves & 15, halves >> 4], axis=1).ravel()[:n].astype(np.int64)
    many = np.flatnonzero(less == 15)
    less[many] += np.frombuffer(packed, f"u{width}", len(many), begin + len(halves))
    sums[at] += less + 1


class SlotCounts:
    """Counts of zeros and ones by slot, for predictors from first on. What is not 0 is handed on by blocks, before any count could overflow."""

    def __init__(self, bits: list[int], first: int, behind: int) -> None:
        self.bits, self.first, self.added = bits, first, 0
        self.counts = {k: np.zeros(2 << bits[k], np.uint32) for k in range(first, behind)}
        self.block = (np.cumsum([0] + [1 << b for b in bits]) // SLOTS).tolist()

    def add(self, predictor: int, hashes: np.ndarray, bit: np.ndarray, times: np.ndarray) -> None:
        np.add.at(self.counts[predictor], slots(hashes, self.bits[predictor]) * 2 + bit, times.astype(np.uint32))

    def handed_on(self) -> Iterator[pa.RecordBatch]:
        for predictor, counts in self.counts.items():
            blocks = counts.reshape(-1, 2 * SLOTS)
            chosen = np.flatnonzero(blocks.any(axis=1)).tolist()
            for low in range(0, len(chosen), 256):
                some = chosen[low : low + 256]
                packed = pa.array([packed_counts(blocks[b]) for b in some], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([self.block[predictor] + b for b in some], pa.int32()), packed], ["block", "counts"])
            counts[:] = 0
        self.added = 0

    def handed_on_if_full(self, times: int) -> Iterator[pa.RecordBatch]:
        if self.added + times >= 1 << 31:
            yield from self.handed_on()
        self.added += times


def count_words(words: DataFrame, bits: list[int]) -> DataFrame:
    """Blocks of counts for the predictors that look at a word alone, from all distinct words with how often each is in training texts.

    The largest one, of all bytes of the word, is counted apart, so that no task holds its slots beside the others'.
    """
    whole = PREDICTORS - 2
    return _count_words(words, bits, ORDERS, 0, whole).unionByName(_count_words(words, bits, (), whole, whole + 1))


def _count_words(words: DataFrame, bits: list[int], orders: tuple[int, ...], first: int, behind: int) -> DataFrame:
    """Those of the predictors from first on; orders: what bits_of needs to have their hashes first."""
    most = 1 << 20  # more than a slot can take at once is added in several goes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = SlotCounts(bits, first, behind)
        for batch in batches:
            n, column, go = batch.column("n").to_numpy(), batch.column("word").cast(pa.large_binary()), 0
            while len(some := np.flatnonzero(n > go * most)):
                times = np.minimum(n[some] - go * most, most)
                for piece in bits_of(column.take(pa.array(some)), orders=orders):
                    t = times[piece.word]
                    yield from counts.handed_on_if_full(int(t.sum()))
                    for k, h in zip(range(first, behind), piece.hashes, strict=False):
                        counts.add(k, h, piece.bit, t)
                go += 1
        yield from counts.handed_on()

    return words.where("n > 0").select("word", "n").mapInArrow(count, "block int, counts binary")


def count_pairs(rows: DataFrame, bits: list[int]) -> DataFrame:
    """Blocks of counts for the predictor that knows the word before, from all training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = SlotCounts(bits, PREDICTORS - 1, PREDICTORS)
        for _, part in by_slice(batches):
            texts = lexed(part.column("text"))
            pairs, before = pairs_of(texts), word_hashes(texts.words)
            first = opening(list(bits_of(pairs.heads, False, ())), len(pairs.heads))
            times = np.bincount(pairs.token, minlength=len(pairs.first))
            for pair, at, hashes in first.of_pairs(pairs, before):
                yield from counts.handed_on_if_full(int(times[pair].sum()))
                counts.add(PREDICTORS - 1, hashes, first.bits.bit[at], times[pair])
        yield from counts.handed_on()

    return rows.where("not held_out").select("text", "buffer").mapInArrow(count, "block int, counts binary")


def merged(blocks: DataFrame, partitions: int = 64) -> DataFrame:
    """block and slots: the sums of all counts of a block, two bytes a slot. A task holds its blocks, whatever the number of rows that it adds."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                add_packed(sums.setdefault(block, np.zeros(2 * SLOTS, np.int64)), counts)
        code = lambda x: np.searchsorted(COUNTS, x.reshape(-1, 2), side="right") - 1
        packed = [(code(s) @ np.array([256, 1])).astype(np.uint16).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["block", "slots"])

    return blocks.repartition(partitions, "block").mapInArrow(add, "block int, slots binary")


def slot_tables(words: DataFrame, rows: DataFrame, bits: list[int]) -> list[np.ndarray]:
    """All predictors' slots, two bytes each: their number is bounded by MOST_BITS, whatever the size of the corpus."""
    whole = np.zeros(sum(1 << b for b in bits), np.uint16)
    found = keep(merged(count_words(words, bits).unionByName(count_pairs(rows, bits))), "slots")  # written, so that its shuffle files go
    for r in found.toLocalIterator():
        whole[r["block"] * SLOTS : (r["block"] + 1) * SLOTS] = np.frombuffer(r["slots"], np.uint16)
    forget(found)
    return np.split(whole, np.cumsum([1 << b for b in bits])[:-1])


def taught(rows: DataFrame, words: DataFrame, bits: list[int], tables) -> DataFrame:
    """What each task has learned from all of its training texts. tables: broadcast.

    It learns online in small blocks of bits, from the weights that it has so far. First bytes are learned from texts, the others, which the word before does not change, from all
    distinct words with how often they are in training texts.
    """

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, learner = Model(bits, tables.value, plain_weights(), plain_refinement()), Learner()
        for _, part in by_slice(batches):
            for lesson in early_lessons(model, lexed(part.column("text"))):
                learner.learn(lesson)
        yield learner.learned()

    def late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, learner = Model(bits, tables.value, plain_weights(), plain_refinement()), Learner()
        for batch in batches:
            for lesson in late_lessons(model, batch.column("word").cast(pa.large_binary()), batch.column("n").to_numpy()):
                learner.learn(lesson)
        yield learner.learned()

    schema = "gate int, at int, total double, seen double"
    return rows.where("not held_out").select("text", "buffer").mapInArrow(early, schema).unionByName(words.where("n > 0").select("word", "n").mapInArrow(late, schema))


def tuned(taught: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weights by gate, the tasks' ones averaged by how many bits each saw, and the share of ones by last byte and bucket of the weighted sum."""
    weights, refined = plain_weights(), plain_refinement()
    for r in taught.groupBy("gate", "at").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen")).collect():  # GATES * INPUTS + 256 * BUCKETS rows at most
        if r["gate"] < 0:
            refined[r["at"]] = (r["total"] + PRIOR * refined[r["at"]]) / (r["seen"] + PRIOR)
        else:
            weights[r["gate"], r["at"]] = r["total"] / r["seen"]
    return weights, np.clip(refined, 1e-5, 1 - 1e-5)


@dataclass
class Trained:
    """A model whose tables are broadcast, and what base scores need: all words with how often each is in training texts, how many that are, and how many distinct."""

    bits: list[int]
    tables: object
    weights: np.ndarray
    refined: np.ndarray
    words: DataFrame
    tokens: int
    distinct: int


def train(rows: DataFrame, counts: DataFrame, most_bits: tuple[int, ...] = MOST_BITS) -> Trained:
    """rows: buffered documents, counts: word_counts of them, both written tables."""
    words = keep(counts.groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    tokens, distinct = total["n"] or 0, total["v"] or 0
    bits = [min(most, max(12, math.ceil(math.log2(max(tokens, 1))) + 2)) for most in most_bits]
    tables = rows.sparkSession.sparkContext.broadcast(slot_tables(words, rows, bits))
    return Trained(bits, tables, *tuned(taught(rows, words, bits, tables)), words, tokens, distinct)


def with_late_scores(trained: Trained) -> DataFrame:
    """All words with n and late, their late_scores: once for each distinct word, not once a text."""
    model, words = (trained.bits, trained.tables, trained.weights, trained.refined), trained.words

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Model(model[0], model[1].value, *model[2:])
        for batch in batches:
            late = late_scores(made, batch.column("word").cast(pa.large_binary())).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(late)], ["word", "n", "late"])

    return words.select("word", "n").mapInArrow(score, "word binary, n long, late float")


def score_documents(documents: DataFrame, most_bits: tuple[int, ...] = MOST_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of each document.

    Both scores are of the words, lower-cased, and the end; bits_per_byte is the second one's bits over the bytes of the text, null without any. A null
    text is empty and has its end alone. Repeated rows count and are scored each. A null doc_id is not held out. Without training documents no token is
    known, and predictors know nothing. Other columns are not read. The result is written, so all jobs run here.
    """
    with small_batches(documents.sparkSession):
        return _score_documents(documents, most_bits)


def _score_documents(documents: DataFrame, most_bits: tuple[int, ...]) -> DataFrame:
    rows = keep(buffered(documents), "texts")
    counts = keep(word_counts(rows), "counts")
    trained = train(rows, counts, most_bits)
    known = keep(counts.select("buffer", "word").join(with_late_scores(trained), "word").select("buffer", "word", "n", "late"), "known")
    forget(counts)
    forget(trained.words)
    model, tokens, distinct = (trained.bits, trained.tables, trained.weights, trained.refined), trained.tokens, trained.distinct

    def scored(part: pa.Table, texts: Texts, c: np.ndarray, late: np.ndarray) -> pa.Table:
        n = part.num_rows
        base = np.log10((c + 0.5) / (tokens + 0.5 * (distinct + 1)))
        found = scores(Model(model[0], model[1].value, *model[2:]), texts, n, late)
        size = pc.fill_null(pc.binary_length(part.column("text")), 0).to_numpy().astype(np.float64)
        columns = {
            "n_tokens": np.bincount(texts.text, minlength=n),
            "n_known": np.bincount(texts.text, c[texts.token] > 0, n).astype(np.int64),
            "train_tokens": np.full(n, tokens, np.int64),
            "base_score": np.bincount(texts.text, base[texts.token], n),
            "score": found,
        }
        with np.errstate(divide="ignore"):
            per_byte = pa.array(-found * math.log2(10) / size, mask=size == 0)
        return pa.Table.from_arrays([part.column("doc_id"), part.column("held_out"), *(pa.array(v) for v in columns.values()), per_byte], ["doc_id", "held_out", *columns, "bits_per_byte"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        words = right.column("word").combine_chunks().cast(pa.large_binary())
        n_of, late_of = right.column("n").to_numpy(), right.column("late").to_numpy().astype(np.float64)
        found = []
        for part in slices(left):  # one at a time in memory
            texts = lexed(part.column("text"))
            at = pc.index_in(texts.words, value_set=words).to_numpy()  # all words are there
            found.append(scored(part, texts, n_of[at], late_of[at]))
        return pa.concat_tables(found)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    done = keep(rows.select("doc_id", "held_out", "text", "buffer").groupBy("buffer").cogroup(known.groupBy("buffer")).applyInArrow(score, schema), "scores")
    forget(rows)
    forget(known)
    return done
