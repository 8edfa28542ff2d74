"""Mixing sources (1) and shards (10)."""

import collections
import zlib

import cases
import numpy as np
import pytest

from quire.llm.common import numbered
from quire.llm.mixing import mix_to_targets, source_targets, take_mix
from quire.llm.sharding import communication_matrix, hypergeometric, shard_documents


def water_level(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by giving out the rest by weight again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full, rest = dict.fromkeys(order, 0.0), set(), share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        total = sum(weight[s] for s in free)
        got = {s: (rest - sum(most * sizes[x] for x in full)) * weight[s] / total for s in free} if total else {}
        over = [s for s in free if got[s] > most * sizes[s]]
        if not over:
            return target | got | {s: most * sizes[s] for s in full}
        full |= set(over)


def test_targets_and_taken(spark, docs):
    sizes, source = collections.Counter(), {}
    for i, t, s in cases.prose():
        sizes[s] += len(cases.words(t))
        source[i] = s
    wanted = water_level(sizes)
    found = cases.by_id(mix_to_targets(docs), "size", "source_size", "target", "taken", "copies")
    assert len(found) == len(source)
    taken = collections.Counter()
    for i, (size, source_size, target, words, copies) in found.items():
        assert source_size == sizes[source[i]] and target == pytest.approx(wanted[source[i]])
        assert words == size * copies <= 2 * size
        taken[source[i]] += words
    for s, target in wanted.items():
        assert abs(taken[s] - target) <= max(60, 0.02 * target)


def test_mix_is_the_same_whatever_the_partitions(docs):
    assert cases.by_id(mix_to_targets(docs), "taken") == cases.by_id(mix_to_targets(docs.repartition(7, "lang")), "taken")


def test_take_mix_repeats_rows(docs, clashing):
    copies = {i: c for i, c in cases.by_id(mix_to_targets(docs), "copies").items() if c}
    assert collections.Counter(r["doc_id"] for r in take_mix(docs).collect()) == copies
    out = take_mix(clashing)
    assert out.columns == clashing.columns and collections.Counter(r["doc_id"] for r in out.collect()) == copies


def test_repeated_rows_and_empty_tables(spark, empty):
    twice = cases.documents(spark, [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", None), (None, None, None)])
    found = mix_to_targets(twice).collect()
    assert len(found) == 4 and sum(r["taken"] for r in found) == pytest.approx(12, abs=3)
    assert mix_to_targets(empty).count() == 0 and take_mix(empty).count() == 0
    assert source_targets(spark.createDataFrame([], "source_key string, source string, source_size long")).count() == 0


def test_hypergeometric_matches_its_mean_and_spread():
    rng = np.random.default_rng(1)
    for good, bad, draws in ((300, 700, 100), (10**10, 3 * 10**10, 10**6)):
        x = np.array([hypergeometric(rng, good, bad, draws) for _ in range(300)])
        p = good / (good + bad)
        sd = (draws * p * (1 - p) * (1 - draws / (good + bad))) ** 0.5
        assert abs(x.mean() - draws * p) < 5 * sd / 300**0.5 and 0.8 < x.std() / sd < 1.2


def test_matrix_keeps_both_margins():
    m = np.array(communication_matrix([5, 0, 17, 8], [10, 10, 10], 3))
    assert m.sum(0).tolist() == [10, 10, 10] and m.sum(1).tolist() == [5, 0, 17, 8] and (m >= 0).all()


def test_shards_are_exact_and_gapless(docs):
    found = shard_documents(docs).collect()
    texts = {i: t or "" for i, t, _ in cases.prose()}
    slots = collections.defaultdict(list)
    for r in found:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        slots[r["shard"]].append(r["slot"])
    assert len(found) == len(texts) and max(map(len, slots.values())) - min(len(slots.get(s, [])) for s in range(40)) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in shard_documents(docs.repartition(5)).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in found}


def test_shards_of_repeated_rows_and_none(spark, empty, clashing):
    same = cases.documents(spark, [(1, "x", "s")] * 100 + [(None, None, None)] * 3)
    counts = collections.Counter(r["shard"] for r in shard_documents(same).collect())
    assert sum(counts.values()) == 103 and set(counts.values()) <= {2, 3}
    assert shard_documents(empty).count() == 0 and shard_documents(clashing).count() == len(cases.prose())


def test_shuffle_is_uniform(spark):
    """Documents of eight ranges of ids are spread over eight shards, and over places in them, as chance would."""
    df = cases.documents(spark, [(i, f"t{i}", "s") for i in range(8000)])
    found = shard_documents(df, shards=8).collect()
    counts, halves = np.zeros((8, 8)), np.zeros((8, 2))
    for r in found:
        counts[r["doc_id"] // 1000, r["shard"]] += 1
        halves[r["doc_id"] // 1000, r["slot"] // 500] += 1
    assert counts.sum(0).tolist() == [1000] * 8
    assert 15 < ((counts - 125) ** 2 / 125).sum() < 100  # 49 degrees of freedom
    assert ((halves - 500) ** 2 / 500).sum() < 35  # 8 degrees of freedom
    other = {r["doc_id"]: r["shard"] for r in shard_documents(df, shards=8, seed=8).collect()}
    assert 700 < sum(other[r["doc_id"]] == r["shard"] for r in found) < 1300


def test_many_sources_are_numbered_in_order(spark):
    names = [f"s{k:03d}" for k in range(300)] + ["", "é", "\U0001f600", None]
    sizes = {s: 10 + (7 * k) % 90 for k, s in enumerate(names)}
    df = spark.createDataFrame([(f"={s}" if s is not None else "-", s, n) for s, n in sizes.items()], "source_key string, source string, source_size long").repartition(6)
    found = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert found == {s: pytest.approx(t) for s, t in water_level(sizes).items()}


def test_rows_alike_are_numbered(spark):
    df = spark.createDataFrame([("a", None)] * 25_000 + [("a", 1.0)] * 3 + [(None, None)], "x string, y double")
    found = collections.defaultdict(list)
    for r in numbered(df).collect():
        found[r["x"], r["y"]].append(r["_nth"])
    assert {k: sorted(v) for k, v in found.items()} == {("a", None): list(range(25_000)), ("a", 1.0): [0, 1, 2], (None, None): [0]}
