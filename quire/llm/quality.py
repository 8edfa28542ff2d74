"""Quality rules: gradient-boosted trees over statistics of documents, with monotonic constraints, scored as numpy node arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import keep
from quire.llm.textarrays import Block, blocks, count_in, sorted_within

#: Labelled documents the trees are fitted to, about; above that a sample by hash.
TRAIN_ROWS = 20_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bytes", "n_digits", "n_upper", "n_marks", "n_bars", "n_distinct"]
#: Feature and the direction in which it may move the score: -1 never raises it, 0 is free.
FEATURES = {"words": 0, "word_length": 0, "symbols": -1, "dup_lines": -1, "repeats": -1, "digits": -1, "upper": -1, "marks": 0, "bars": -1, "distinct": 0, "line_words": 0}


def _mask(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


SYMBOLS, DIGITS, UPPER, MARKS, BARS = map(_mask, (b"#*$%&|<>", b"0123456789", bytes(range(65, 91)), b".,!?;:", b"|"))
REPEAT = 5


def repeated_words(block: Block, size: int = REPEAT) -> np.ndarray:
    """Words in windows of size words that a text has twice or more, first ones included, for each text."""
    first, value = block.windows(size)
    text = block.word_text
    change = np.zeros(len(text) + 1, np.int64)
    if len(first):
        order = sorted_within(text[first], value)
        same = np.zeros(len(order) + 1, bool)
        owner, value = text[first][order], value[order]
        same[1:-1] = (owner[1:] == owner[:-1]) & (value[1:] == value[:-1])
        again = first[order[same[1:] | same[:-1]]]
        np.add.at(change, again, 1)
        np.add.at(change, again + size, -1)
    return count_in(np.cumsum(change[:-1]) > 0, *block.word_range)


def duplicate_lines(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier line, for each text."""
    breaks = np.flatnonzero(block.data == 10)
    per_text = np.searchsorted(breaks, block.end) - np.searchsorted(breaks, block.start) + 1
    text = np.repeat(np.arange(len(block)), per_text)
    start = np.sort(np.concatenate([block.start, breaks + 1]))
    end = np.sort(np.concatenate([block.end, breaks]))
    worded = count_in(~block.space, start, end) > 0
    start, end, text = start[worded], end[worded], text[worded]
    value = block.bytes_prefix.hash(start, end)
    order = sorted_within(text, value)
    owner, value = text[order], value[order]
    again = (owner[1:] == owner[:-1]) & (value[1:] == value[:-1])
    return np.bincount(text, minlength=len(block)), np.bincount(owner[1:][again], minlength=len(block))


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text; null counts as empty."""
    parts: dict[str, list[np.ndarray]] = {c: [np.zeros(0, np.int64)] for c in COUNTS}
    for block in blocks(texts):
        data, span = block.data, (block.start, block.end)
        low, high = block.word_range
        lines, again = duplicate_lines(block)
        order = sorted_within(block.word_text, block.word_hash)
        owner, value = block.word_text[order], block.word_hash[order]
        new = np.ones(len(order), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        found = {
            "n_words": high - low,
            "word_chars": count_in(~block.space & ((data & 0xC0) != 0x80), *span),
            "n_symbols": count_in(SYMBOLS[data], *span),
            "n_dup_lines": again,
            "n_repeat_words": repeated_words(block),
            "n_lines": lines,
            "n_bytes": block.end - block.start,
            "n_digits": count_in(DIGITS[data], *span),
            "n_upper": count_in(UPPER[data], *span),
            "n_marks": count_in(MARKS[data], *span),
            "n_bars": count_in(BARS[data], *span),
            "n_distinct": np.bincount(owner[new], minlength=len(block)),
        }
        for name, values in found.items():
            parts[name].append(values)
    return {name: np.concatenate(values).astype(np.int64) for name, values in parts.items()}


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    words, lines, size = (np.maximum(counts[c], 1).astype(float) for c in ("n_words", "n_lines", "n_bytes"))
    return np.column_stack([
        np.log1p(counts["n_words"]), counts["word_chars"] / words, counts["n_symbols"] / words, counts["n_dup_lines"] / lines,
        counts["n_repeat_words"] / words, counts["n_digits"] / size, counts["n_upper"] / size, counts["n_marks"] / words,
        counts["n_bars"] / words, counts["n_distinct"] / words, np.log1p(words / lines),
    ])


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])


def leaf_values(tree: tuple[np.ndarray, ...], x: np.ndarray, depth: int) -> np.ndarray:
    """Each row's leaf value; all rows go down a level at a time."""
    feature, cut, left, right, value = tree
    at, row = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        at = np.where(x[row, feature[at]] <= cut[at], left[at], right[at])
    return value[at]


@dataclass
class Trees:
    """All trees' nodes in arrays, one row per tree: go left where the feature is at most cut; a leaf is its own child."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability that a document is good."""
        total = np.full(len(x), self.start)
        for tree in zip(self.feature, self.cut, self.left, self.right, self.value, strict=True):
            total += leaf_values(tree, x, self.depth)
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 40, depth: int = 4, rate: float = 0.2, least: int = 20, ridge: float = 1.0, bins: int = 64) -> Trees:
    """Boosted trees for 0/1 labels by Newton gains on binned features.

    A feature of sign s: of two children split on it the upper never has the lower value times s, and what lies below the
    children stays on its side of their middle, so scores are monotonic in it.
    """
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    total, size, made = np.full(len(y), start), 2 ** (depth + 1) - 1, []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, bend = y - p, p * (1 - p)
        feature, cut, value = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
        left, right = np.arange(size), np.arange(size)
        todo = [(0, np.arange(len(y)), -np.inf, np.inf, 0)]
        while todo:
            node, rows, low, high, level = todo.pop()
            g, h = slope[rows].sum(), bend[rows].sum()
            value[node] = rate * np.clip(g / (h + ridge), low, high)
            best = (1e-6, None)
            for j, c in enumerate(cuts if level < depth and len(rows) >= 2 * least else []):
                at = binned[rows, j]
                n = np.cumsum(np.bincount(at, minlength=len(c) + 1))[:-1]
                gl, hl = (np.cumsum(np.bincount(at, weights=w[rows], minlength=len(c) + 1))[:-1] for w in (slope, bend))
                vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip((g - gl) / (h - hl + ridge), low, high)
                gain = gl * vl - (hl + ridge) * vl * vl / 2 + (g - gl) * vr - (h - hl + ridge) * vr * vr / 2 - (g * g / (h + ridge) / 2)
                gain[(n < least) | (len(rows) - n < least) | (signs[j] * (vr - vl) < 0)] = 0
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], (j, k, vl[k], vr[k]))
            if best[1]:
                j, k, vl, vr = best[1]
                feature[node], cut[node], left[node], right[node] = j, cuts[j][k], 2 * node + 1, 2 * node + 2
                middle = (vl + vr) / 2
                bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[j]]
                goes = binned[rows, j] <= k
                todo += [(2 * node + 1, rows[goes], *bounds[0], level + 1), (2 * node + 2, rows[~goes], *bounds[1], level + 1)]
        made.append((feature, cut, left, right, value))
        total += leaf_values(made[-1], x, depth)
    return Trees(*map(np.stack, zip(*made, strict=True)), start, depth)


def _statistics_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = statistics(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[c]) for c in COUNTS)], ["doc_id", *COUNTS])


def document_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and COUNTS (long) of each document."""
    doc_id = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(_statistics_rows, f"doc_id {doc_id}, " + ", ".join(f"{c} long" for c in COUNTS))


def _as_counts(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS}


def fit_quality(counts: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees | None:
    """Trees fitted to labelled documents that pass the base rules: all of them, or about rows by hash of doc_id.

    A document with several labels takes the lowest; null labels don't count. None if a class has no document.
    """
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    passed = counts.where((F.col("n_words") >= 10) & (100 * F.col("n_repeat_words") <= 20 * F.col("n_words")))
    known = keep(passed.join(marks, "doc_id"), "labelled")
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * rows / n))
    sample = known.sort("doc_id", *COUNTS).toArrow()
    y = sample.column("quality").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None
    return fit_trees(features({c: sample.column(c).to_numpy() for c in COUNTS}), y, list(FEATURES.values()))


def judge(counts: dict[str, np.ndarray], trees: Trees | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether the base rules fail, the score, and whether the document stays."""
    failed = base_failed(counts)
    score = trees.score(features(counts)) if trees is not None else np.ones(len(failed))
    return failed, score, ~failed & (score >= threshold)


def quality_verdicts(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, COUNTS, base_failed, score and kept of each document.

    Without labels of both classes the base rules decide alone. Null texts and empty ones have no words and fail;
    repeated rows are judged each; null ids are kept as they are; other columns are not read.
    """
    doc_id = documents.schema["doc_id"].dataType.simpleString()
    counts = keep(document_statistics(documents), "statistics")
    trees = fit_quality(counts, labels)

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = judge(_as_counts(batch), trees, threshold)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], [*batch.schema.names, "base_failed", "score", "kept"])

    return counts.mapInArrow(verdicts, f"doc_id {doc_id}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, kept boolean")


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that quality_verdicts would keep, with all their columns. Texts are read twice rather than moved."""
    trees = fit_quality(document_statistics(documents), labels)
    place = documents.columns.index("text")

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(statistics(batch.column(place)), trees, threshold)[2]))

    return documents.mapInArrow(good, documents.schema)
