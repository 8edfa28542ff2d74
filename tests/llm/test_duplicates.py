"""Near duplicates (8), repeated word windows (7) and repeated bytes (9) against brute force."""

import collections
import hashlib
import random

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.components import components
from quire.llm.minhash import BITS, MINIMA, differences, drop_near_duplicates, estimate, heavy_links, lightest_other, light_links, near_duplicates
from quire.llm.substring import dedup_substrings
from quire.llm.suffix import dedup_bytes, repeats_in_order


def sets_of(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, t, _ in rows:
        w = cases.words((t or "").translate(lower))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    return out


def plain_components(rows):
    sets, parent = sets_of(rows), {i: i for i, *_ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def edited(rng, words, share):
    return [f"w{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def near_copies(seed, group=40):
    """Groups of copies of one text with more and more words changed, so that links, chains and near misses occur."""
    rng, rows = random.Random(seed), []
    for _ in range(3):
        base = [f"w{rng.randrange(500)}" for _ in range(150)]
        rows += [(len(rows) + k, " ".join(edited(rng, base, k / group * 0.08)), "s") for k in range(group)]
    rng.shuffle(rows)
    return [(n, t.upper() if n % 5 == 0 else t, s) for n, (_, t, s) in enumerate(rows)]


@pytest.mark.parametrize("rows", [cases.prose(), near_copies(1), near_copies(2)], ids=["prose", "copies", "more"])
def test_near_duplicates(spark, rows):
    found = cases.by_id(near_duplicates(cases.documents(spark, rows).repartition(3)), "n_shingles", "component_id", "kept")
    assert found == plain_components(rows)


def test_estimate_is_near_the_similarity(spark):
    rng = random.Random(4)
    longs = lambda: [rng.getrandbits(63) for _ in range(MINIMA * BITS // 64)]
    a = longs()
    half = a[: len(a) // 2] + longs()[len(a) // 2 :]
    df = spark.createDataFrame([(a, a), (a, half), (a, longs())], "a array<long>, b array<long>")
    same, mid, none = (r[0] for r in df.select(estimate("a", "b")).collect())
    assert same == pytest.approx(1) and abs(mid - 0.5) < 0.12 and abs(none) < 0.12


def test_near_duplicates_of_nulls_repeats_and_none(spark, empty, docs, clashing):
    rows = [(None, "a b c d e f", "s"), (3, "a b c d e f", "s"), (3, "a b c d e f", "s"), (2, "A b c d e f", "s"), (5, None, None), (6, "", None), (7, "a b", "s"), (8, "a b", "s")]
    found = sorted(((r["doc_id"] or 0), r["component_id"], r["kept"]) for r in near_duplicates(cases.documents(spark, rows)).collect())
    assert found == [(0, None, True), (2, 2, True), (3, 2, False), (3, 2, False), (5, 5, True), (6, 6, True), (7, 7, True), (8, 7, False)]
    assert near_duplicates(empty).count() == 0 and drop_near_duplicates(empty).count() == 0
    kept = {i for i, (_, _, k) in plain_components(cases.prose()).items() if k}
    out = drop_near_duplicates(clashing)
    assert out.columns == clashing.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(kept)
    twice = cases.documents(spark, [(1, "x y", "s")] * 2 + [(None, "z", "s")])
    assert sorted(r["doc_id"] or 0 for r in drop_near_duplicates(twice).collect()) == [0, 1]


def test_an_id_with_several_texts_is_one_document(spark):
    text = lambda c: " ".join(f"{c}{k}" for k in range(60))
    a, b, c = map(text, "abc")
    rows = [(5, a, "s"), (5, b, "s"), (3, b, "s"), (8, a + " more", "s"), (9, None, "s"), (9, c, "s"), (4, c, "s"), (6, text("d"), "s")]
    df = cases.documents(spark, rows)
    found = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect())
    assert found == [(3, 3, True), (4, 4, True), (5, 3, False), (5, 3, False), (6, 6, True), (8, 3, False), (9, 4, False), (9, 4, False)]
    assert sorted(r["doc_id"] for r in drop_near_duplicates(df).collect()) == [3, 4, 6]


def group_of_near_copies(seed, copies, misses):
    """Copies of one text with up to six words changed, and near misses with seven to twelve."""
    rng, base = random.Random(seed), [f"w{k}" for k in range(150)]
    rows = []
    for i in range(copies + misses):
        changed = rng.sample(range(150), rng.randint(0, 6) if i < copies else rng.randint(7, 12))
        words = [f"x{rng.randrange(40)}" if k in changed else w for k, w in enumerate(base)]
        rows.append(" ".join(words))
    rng.shuffle(rows)
    return [(i, t, "s") for i, t in enumerate(rows)]


def test_a_group_with_many_near_misses(spark):
    rows = group_of_near_copies(3, 600, 150)
    found = cases.by_id(near_duplicates(cases.documents(spark, rows).repartition(4)), "n_shingles", "component_id", "kept")
    assert found == plain_components(rows)


@pytest.mark.parametrize("inline", [512, 3], ids=["met", "texts"])
def test_differences_from_a_centre_decide_all_links(spark, monkeypatch, inline):
    """Every document a component of its own: light links join what weights decide, heavy ones hold all other links to what is in another component."""
    monkeypatch.setattr("quire.llm.minhash.INLINE", inline)
    rows = group_of_near_copies(5, 60, 60)
    sets = sets_of(rows)
    df = cases.documents(spark, rows).select("doc_id", "text")
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    apart = differences(df.selectExpr("7L as centre", "doc_id"), df).cache()
    weight = {r["doc_id"]: r["weight"] for r in apart.collect()}
    base = len(sets[7])
    light = {(r["a"], r["b"]) for r in light_links(apart.withColumn("component", F.col("doc_id"))).collect()}
    assert light <= links and all(a in {x for p in light for x in p} for a, b in links if weight[a] + weight[b] <= base)
    group = {i: min((a for a, b in light if i in (a, b)), default=i) for i in sets}
    while any(group[group[i]] != group[i] for i in group):
        group = {i: group[group[i]] for i in group}
    label = spark.createDataFrame(list(group.items()), "node long, component long")
    rows_in = apart.join(label, apart.doc_id == label.node).drop("node")
    assert {r["other"] == r["doc_id"] for r in lightest_other(rows_in).collect()} == {False}
    heavy = {(r["a"], r["b"]) for r in heavy_links(rows_in, df).collect()}
    assert heavy <= links
    top = plain_components(rows)
    parent = {i: group[i] for i in group}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in light | heavy:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert {i: root(i) for i in parent} == {i: c for i, (_, c, _) in top.items()}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_windows(rows, size=50):
    first, texts = {}, {i: cases.words(t) for i, t, _ in rows}
    for i in sorted(texts):
        for k in range(len(texts[i]) - size + 1):
            first.setdefault(tuple(texts[i][k : k + size]), i)
    out = {}
    for i, w in texts.items():
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def plain_bytes(rows, size=100):
    seen, out = set(), {}
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - size + 1):
            part = data[k : k + size]
            if part in seen:
                gone[k : k + size] = b"\1" * size
            seen.add(part)
        runs = sum(1 for k in range(len(data)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(data), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out


def spliced(seed, n=50):
    """Texts made of shared passages cut at all places, of one repeated word, and of copies that differ in a letter."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "ré", "x", "long-er", "zz9"]) + rng.choice(["", "q", "é", "7"])
    pool = [[word() for _ in range(rng.randint(40, 160))] for _ in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            a = rng.randrange(0, len(p) - 20)
            w += p[a : a + rng.randint(20, 140)] + [word() for _ in range(rng.randint(0, 30))]
        if i % 8 == 0:
            w = ["na"] * rng.randint(30, 400)
        if i % 8 == 1:
            w = rows[-1][1].split()
            w[rng.randrange(len(w))] += "!"
        rows.append((i, (" " if i % 3 else "\n").join(w), "s"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [cases.prose(), spliced(1), spliced(2)], ids=["prose", "spliced", "more"])
def test_windows_of_words(spark, rows):
    found = cases.by_id(dedup_substrings(cases.documents(spark, rows).repartition(3)), "n_words", "n_removed", "kept_sha256")
    assert found == plain_windows(rows)


@pytest.mark.parametrize("rows", [cases.prose(), spliced(3), spliced(4)], ids=["prose", "spliced", "more"])
def test_bytes(spark, rows):
    found = cases.by_id(dedup_bytes(cases.documents(spark, rows).repartition(3)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found == plain_bytes(rows)


def test_small_windows(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 60))), "s") for i in range(30)]
    assert cases.by_id(dedup_substrings(cases.documents(spark, rows), 3), "n_words", "n_removed", "kept_sha256") == plain_windows(rows, 3)
    assert cases.by_id(dedup_bytes(cases.documents(spark, rows), 9), "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_bytes(rows, 9)


def test_sorted_suffixes_find_repeats_in_order():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[100:110] = 0
    start = np.sort(rng.choice(3990, 900, replace=False))
    seen, wanted = set(), []
    for k in start:
        part = data[k : k + 9].tobytes()
        if part in seen:
            wanted.append(k)
        seen.add(part)
    assert sorted(start[repeats_in_order(data, start, 9)]) == wanted


def one_id(df, i):
    return df.withColumn("doc_id", F.lit(i).cast("long"))


@pytest.mark.parametrize("same", [None, 2**63 - 1])
def test_many_rows_of_one_id(spark, same):
    """3,000 rows without an id, or of one: word windows take nothing from each other, bytes are taken in the order of texts' hashes."""
    rng = random.Random(6)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(60)) for _ in range(40)]
    texts = [f"{rng.choice(pool)} {k} {rng.choice(pool)[: rng.randrange(300)]}" for k in range(3000)]
    df = one_id(cases.documents(spark, [(k, t, "s") for k, t in enumerate(texts)]), same).repartition(5)
    found = dedup_substrings(df).collect()
    assert {r["n_removed"] for r in found} == {0} and {r["doc_id"] for r in found} == {same} and len(found) == 3000
    key = {r["text"]: r["k"] for r in df.select("text", F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text").bitwiseAND(F.lit(0x7FFF))).alias("k")).collect()}
    ordered = [(k, t, "s") for k, t in enumerate(sorted(texts, key=lambda t: tuple(key[t])))]
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in dedup_bytes(df).collect()) == sorted(plain_bytes(ordered).values())


def test_repeats_in_very_long_texts(spark):
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(10**5)}" for _ in range(150_000))
    rows = [(0, long, "s"), (1, "start " + long[5_000:400_000] + " end", "s"), (2, "x" * 300_000, "s"), (3, "x y " * 60_000, "s")]
    df = cases.documents(spark, rows)
    assert cases.by_id(dedup_substrings(df), "n_words", "n_removed", "kept_sha256") == plain_windows(rows)
    assert cases.by_id(dedup_bytes(df), "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_bytes(rows)
    assert cases.by_id(near_duplicates(df), "component_id") == {i: i for i in range(4)}


def test_repeats_of_nulls_repeated_rows_and_none(spark, empty, clashing):
    t = " ".join(f"w{i}" for i in range(60))
    df = cases.documents(spark, [(None, t, "s"), (2, t, "s"), (2, t, "s"), (1, None, "s"), (2, "other", "s")])
    removed = collections.Counter((r["doc_id"], r["n_removed"]) for r in dedup_substrings(df).collect())
    assert removed == {(None, 60): 1, (2, 0): 3, (1, 0): 1}
    size = len(t.encode())
    removed = collections.Counter((r["doc_id"], r["n_removed"]) for r in dedup_bytes(df).collect())
    assert removed == {(None, size): 1, (2, 0): 3, (1, 0): 1}
    assert dedup_substrings(empty).count() == 0 and dedup_bytes(empty).count() == 0
    assert dedup_substrings(clashing).count() == dedup_bytes(clashing).count() == len(cases.prose())
