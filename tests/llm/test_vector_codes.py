"""Vector codes against plain Python, and annular pruning against all distances."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.vectorcodes import LARGEST, Annuli, compress_vectors, decode, encode, finite_vectors, first_vectors, scaled, train_codebooks

SCHEMA = "vec_id long, embedding array<double>, label int, code string, n int"


def plain(rows, parts=16, entries=64, rounds=2):
    """vec_id, code, error, label_error and digest, in whole numbers of any size."""
    good = [(i, v, label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    by_id = {}
    for i, v, _ in good:
        if i is not None:
            by_id[i] = min(by_id.get(i, v), v)
    cut = lambda v: [[math.floor(256 * x) for x in v[p * len(v) // parts : (p + 1) * len(v) // parts]] for p in range(parts)]
    books = [list(b) for b in zip(*(cut(by_id[i]) for i in sorted(by_id)[:entries]), strict=True)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min(range(len(books[p])), key=lambda e: (away(v, books[p][e]), e))
    vectors = [cut(v) for _, v, _ in good]
    for _ in range(rounds):
        taken = [[nearest(v[p], p) for v in vectors] for p in range(parts)]
        for p in range(parts):
            for e in set(taken[p]):
                mine = [v[p] for v, t in zip(vectors, taken[p], strict=True) if t == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for (i, _, label), v in zip(good, vectors, strict=True):
        codes = [nearest(v[p], p) for p in range(parts)]
        out.append((i, label, "".join(f"{c:02x}" for c in codes), min(LARGEST, sum(away(v[p], books[p][c]) for p, c in enumerate(codes)))))
    total = {}
    for _, label, _, error in out:
        total[label] = total.get(label, 0) + error
    return sorted(((i, c, e, min(LARGEST, total[label]), digest) for i, label, c, e in out), key=repr)


def found(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r[:3], "x", 1) for r in rows], SCHEMA).repartition(partitions)
    return sorted((tuple(r) for r in compress_vectors(df).collect()), key=repr)


def made(seed, n, width=32, values=None):
    rng = random.Random(seed)
    value = (lambda: rng.choice(values)) if values else (lambda: rng.gauss(0, 1))
    return [(i, [value() for _ in range(width)], rng.choice([1, 2, None])) for i in range(n)]


def test_codes_are_the_plain_ones(spark):
    rows = made(1, 150) + made(2, 20) + [(500, None, 1), (501, [1.0, None] * 16, 1), (502, [float("nan")] * 32, 2), (503, [float("inf")] * 32, 2), (None, [0.5] * 32, 7), (504, [0.0] * 32, None)]
    rows += [rows[3]] * 4
    assert found(spark, rows) == plain(rows)


def test_ties_and_few_rows(spark):
    rows = made(3, 120, 16, [-0.01, 0.0, 0.003, 1.0])
    assert found(spark, rows) == plain(rows)
    assert found(spark, made(4, 5)) == plain(made(4, 5))
    assert found(spark, [(7, [0.1] * 16, 1)] * 50) == plain([(7, [0.1] * 16, 1)] * 50)


def test_very_large_components(spark):
    rows = made(5, 30, 16) + [(100, [1e5] * 16, 1), (101, [-3e9] * 16, 1), (102, [7e12] * 16, 2)]
    assert found(spark, rows) == plain(rows)
    beyond = made(5, 30, 16) + [(-1, [3e38] * 16, 1)]
    assert {r[2] for r in found(spark, beyond) if r[0] == -1} == {0}  # its own entry


def test_nothing_and_other_lengths(spark):
    assert found(spark, []) == found(spark, [(1, None, 1), (2, [], 1)][:1]) == []
    rows = made(6, 80) + [(200, [1.0] * 16, 1), (201, [], 1), (202, [1.0] * 33, 1)]
    assert found(spark, rows) == plain(rows[:80])


@pytest.mark.parametrize("seed", range(6))
def test_annuli_miss_no_entry(seed):
    rng = np.random.default_rng(seed)
    width, k = (1, 2, 4, 8, 4, 3)[seed], (1, 64, 64, 200, 3, 64)[seed]
    entries = scaled(rng.normal(size=(k, width)) * (0.01 if seed == 2 else 1))
    entries[k // 2] = entries[0]
    vectors = scaled(rng.normal(size=(3000, width)) * rng.choice([0.01, 1, 30], (3000, 1)))
    number, distance, taken = Annuli(entries).nearest(vectors)
    all_ = ((vectors[:, None] - entries[None]) ** 2).sum(-1)
    assert (number == all_.argmin(1)).all() and (distance == all_.min(1)).all()
    assert k < 64 or taken < 0.9 * len(vectors) * k


def test_seeds_are_the_smallest_keys(spark):
    rows = [(i % 90 - 10, [float(i)] * 16, 1) for i in range(400)] + [(None, [0.0] * 16, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(7)
    assert first_vectors(df, 64, 16) == [[float(i)] * 16 for i in range(64)]


def test_decoded_vectors_are_near(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in made(8, 300)], SCHEMA).select("vec_id", "embedding")
    books = train_codebooks(finite_vectors(df))
    both = decode(encode(df, books), books).join(df, "vec_id")
    gap = F.aggregate(F.zip_with("vector", "embedding", lambda a, b: (a - b) ** 2), F.lit(0.0), lambda s, x: s + x)
    for r in both.select(gap.alias("gap"), "error").collect():
        assert math.sqrt(r["gap"]) == pytest.approx(math.sqrt(r["error"]) / 256, abs=math.sqrt(32) / 256)
