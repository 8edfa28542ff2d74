"""Language-model scores: base scores and counts against plain Python, the code against its definition, and what the model makes of unseen texts."""

import collections
import math
import random
import zlib

import cases
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import contextmix as cm
from quire.llm.contextmix import Model, lexed, plain_refinement, plain_weights, score_documents, scores


def tokens(text):
    return [w.encode("utf-8", "surrogatepass").translate(bytes(cm.LOWER)) for w in cases.words(text)] + [b""]


def plain(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    count = collections.Counter(t for i, text, _ in rows if not held(i) for t in tokens(text))
    n, v = sum(count.values()), len(count)
    return [(i, held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for i, t, _ in rows]


def rounded(rows):
    return sorted(((*r[:5], f"{r[5]:.9g}") for r in rows), key=repr)


COLUMNS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")


def test_base_scores_are_the_plain_ones(spark, docs, clashing):
    rows = cases.prose()
    found = score_documents(clashing, (12,) * cm.PREDICTORS).collect()
    assert rounded(tuple(r[c] for c in COLUMNS) for r in found) == rounded(plain(rows))
    assert all(r["score"] < 0 and (r["bits_per_byte"] is None) == (r["doc_id"] in (60, 61)) for r in found)
    again = {(r["doc_id"]): r["score"] for r in score_documents(docs, (12,) * cm.PREDICTORS).collect()}
    assert again == pytest.approx({r["doc_id"]: r["score"] for r in found})


def test_odd_rows(spark):
    rows = [(None, "Null id", "s"), (1, None, "s"), (1, "", "s"), (7, "ÄÖ ÄÖ  x", "s"), (7, "x" * 300_000, "s"), (8, "a b " * 100_000, None)] + [(3, "same text here", "s")] * 9
    found = score_documents(cases.documents(spark, rows).repartition(4), (12,) * cm.PREDICTORS).collect()
    assert rounded(tuple(r[c] for c in COLUMNS) for r in found) == rounded(plain(rows))
    assert len({r["score"] for r in found if r["doc_id"] == 3}) == 1 and all(math.isfinite(r["score"]) for r in found)
    assert score_documents(cases.documents(spark, [])).count() == 0


def test_nothing_to_learn_from(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1]
    found = score_documents(cases.documents(spark, [(i, "some words", "s") for i in held]), (12,) * cm.PREDICTORS).collect()
    assert {(r["n_known"], r["train_tokens"], r["held_out"], r["base_score"]) for r in found} == {(0, 0, True, 0.0)} and {r["score"] < 0 for r in found} == {True}


def test_unseen_texts_score_better_than_base_and_noise_worse(spark):
    """Words made of known parts; each is followed by one of two."""
    rng = random.Random(3)
    parts = ["ka", "lo", "mi", "tu", "en", "st", "ra", "vo"]
    vocabulary = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    follows = {w: rng.sample(vocabulary, 2) for w in vocabulary}

    def walk(n):
        w, out = rng.choice(vocabulary), []
        for _ in range(n):
            out.append(w)
            w = rng.choice(follows[w])
        return out

    rows = [(i, " ".join(walk(150)), "s") for i in range(400)]
    held = [i for i in range(400, 480) if zlib.crc32(str(i).encode()) % 5 == 1]
    shuffled = set(held[::2])
    for i in held:
        text = walk(150)
        if i in shuffled:
            rng.shuffle(text)
        rows.append((i, " ".join(text), "s"))
    found = {r["doc_id"]: r for r in score_documents(cases.documents(spark, rows).repartition(6)).collect()}
    own = [i for i in held if i not in shuffled]
    assert all(found[i]["score"] > found[i]["base_score"] for i in own)
    assert min(found[i]["score"] for i in own) > max(found[i]["score"] for i in shuffled)  # order counts
    assert np.mean([found[i]["bits_per_byte"] for i in own]) < 0.8


def model(seed=0, bits=12):
    rng = np.random.default_rng(seed)
    weights = plain_weights() + rng.normal(0, 0.2, (cm.GATES, cm.INPUTS))
    refined = np.clip(plain_refinement() + rng.normal(0, 0.05, 256 * cm.BUCKETS), 0.01, 0.99)
    return Model([bits] * cm.PREDICTORS, [rng.integers(0, 65536, 1 << bits).astype(np.uint16) for _ in range(cm.PREDICTORS)], weights, refined)


def test_probabilities_of_all_next_words_add_up():
    """All words of up to two letters of a few, each followed by its stop: with what is longer they share a probability of 1."""
    m = model()
    letters = [chr(b) for b in range(256) if cm.PATH_SIZE[b] and b != cm.STOP and b < 128]
    whole = scores(m, lexed(pa.array([""])), 1)[0]
    one = scores(m, lexed(pa.array(letters)), len(letters))
    assert 0 < 10**whole < 1 and 0 < sum(10 ** (x - 0) for x in one) < 1
    paths = {b: "".join(str(x) for x in cm.PATH_BIT[cm.PATH_START[b] : cm.PATH_START[b] + cm.PATH_SIZE[b]]) for b in range(256) if cm.PATH_SIZE[b]}
    assert sum(2.0 ** -len(p) for p in paths.values()) == 1  # a whole prefix code
    assert len(paths) == 256 - 5 - 26


def test_scores_are_sums_over_texts_whatever_stands_beside():
    m, rng = model(1), random.Random(1)
    texts = [" ".join(rng.choice(["the", "of", "x", "Longer-word", "é"]) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    together = scores(m, lexed(pa.array(texts)), len(texts))
    alone = [scores(m, lexed(pa.array([t])), 1)[0] for t in texts]
    assert together == pytest.approx(alone, rel=1e-5) and scores(m, lexed(pa.array(texts[::-1])), len(texts))[::-1] == pytest.approx(together, rel=1e-5)


def test_small_pieces_change_nothing(monkeypatch):
    texts = lexed(pa.array(["some words " * 20, "other words and a_very_long_word_" + "x" * 500]))
    whole = scores(model(2), texts, 2)
    monkeypatch.setattr(cm, "CHUNK", 64)
    assert scores(model(2), texts, 2) == pytest.approx(whole, rel=1e-6)


def test_first_bytes_are_looked_at_once_for_each_head():
    """Words that begin alike share their first bits, and pairs with the word before; each token has its own word's."""
    texts = lexed(pa.array([" ".join(f"{head}{i}" for i in range(2000) for head in ("abc", "abd")) + " ab a é", "", None]))
    pairs = cm.pairs_of(texts)
    assert sorted(pairs.heads.to_pylist()) == [b"", b"a", b"ab", b"abc", b"abd", "é".encode()]
    assert sum(len(b) for b in cm.opened(model(), pairs.heads, False)[1][:1]) < 100
    words, heads = texts.words.to_pylist(), pairs.heads.to_pylist()
    assert [heads[h] for h in pairs.second[pairs.token]] == [words[w][: cm.SPOKEN] for w in texts.token]
    assert pairs.first[pairs.token].tolist() == texts.before.tolist()


def test_counts_are_those_of_single_words(spark, docs):
    """Merged blocks of slots against one count of every bit of every training token."""
    bits = [12] * cm.PREDICTORS
    rows = cm.buffered(docs)
    counts = cm.word_counts(rows).groupBy("word").agg(F.sum("n").alias("n"))
    tables = cm.slot_tables(counts, rows, bits)
    expected = [np.zeros((4096, 2), np.int64) for _ in bits]
    for i, text, _ in cases.prose():
        if zlib.crc32(str(i).encode()) % 5 == 1:
            continue
        before = None
        for token in tokens(text):
            words = pa.array([token], pa.large_binary())
            hashes = cm.word_hashes(pa.array([before or b""], pa.large_binary()))
            for piece in cm.bits_of(words):
                for k, h in enumerate(piece.hashes):
                    np.add.at(expected[k], (cm.slots(h, 12), piece.bit), 1)
                early = piece.place < cm.SPOKEN
                np.add.at(expected[-1], (cm.slots(hashes[-1 if before is None else 0] + piece.hashes[-1][early], 12), piece.bit[early]), 1)
            before = token
    code = lambda x: np.searchsorted(cm.COUNTS, x, side="right") - 1
    for found, wanted in zip(tables, expected, strict=True):
        assert (found == code(wanted[:, 0]) * 256 + code(wanted[:, 1])).all()


def test_a_task_holds_one_batch_of_texts():
    """Texts of a buffer are looked at as they come; they were held until the buffer was whole."""

    class Rows:
        def __getattr__(self, name):
            return lambda *_: self

        def mapInArrow(self, f, schema):
            return f

    held = []

    def batches():
        for k in range(30):
            held.append(pa.total_allocated_bytes())
            yield pa.RecordBatch.from_pydict({"held_out": [False] * 500, "text": ["some words again " * 50] * 500, "buffer": pa.array([k // 20] * 500, pa.int64())})

    for f in (cm.word_counts(Rows()), cm.count_pairs(Rows(), [12] * cm.PREDICTORS)):
        held.clear()
        out = pa.Table.from_batches(list(f(batches())))
        assert len(held) == 30 and max(held) - held[0] < 3_000_000  # of 425,000 bytes each
        if "n" in out.column_names:
            assert sorted((r["buffer"], r["word"], r["n"]) for r in out.to_pylist()) == [(b, w, n * (20, 10)[b]) for b in (0, 1) for w, n in ((b"", 500), (b"again", 25_000), (b"some", 25_000), (b"words", 25_000))]


def test_few_rows_are_handed_to_python_at_once(spark, docs, monkeypatch):
    name, seen, keep = "spark.sql.execution.arrow.maxRecordsPerBatch", [], cm.keep
    before = spark.conf.get(name)
    monkeypatch.setattr(cm, "ROWS", 7)
    monkeypatch.setattr(cm, "keep", lambda df, to: (seen.append((to, spark.conf.get(name))), keep(df, to))[1])
    found = score_documents(docs, (12,) * cm.PREDICTORS).select("doc_id", "n_tokens").collect()
    assert seen == [(to, "7") for to in ("texts", "counts", "words", "slots", "known", "scores")] and spark.conf.get(name) == before
    assert sorted((r[0], r[1]) for r in found) == sorted((i, len(tokens(t))) for i, t, _ in cases.prose())


@pytest.mark.parametrize("share", [0.001, 0.05, 0.07, 0.4, 1.0])
def test_packed_counts_are_the_counts(share):
    rng = np.random.default_rng(5)
    counts = np.where(rng.random(2 * cm.SLOTS) < share, rng.choice([1, 2, 14, 15, 16, 17, 270, 271, 272], 2 * cm.SLOTS), 0).astype(np.uint32)
    counts[77] = 1
    for most in (3, 1 << 31):
        counts[4000] = most
        sums = np.ones(2 * cm.SLOTS, np.int64)
        cm.add_packed(sums, cm.packed_counts(counts))
        assert (sums == counts.astype(np.int64) + 1).all()


def test_dense_counts_take_little_room():
    """Four in ten places hold a count, most of them 1, as in the table of pairs after 50 MB of text."""
    rng = np.random.default_rng(6)
    counts = np.where(rng.random(2 * cm.SLOTS) < 0.4, rng.geometric(0.6, 2 * cm.SLOTS), 0).astype(np.uint32)
    assert len(cm.packed_counts(counts)) < 0.4 * 3 * np.count_nonzero(counts)


def test_weights_are_learned_from_every_training_text(spark, docs):
    """Every bit of every training token is in the refinement's counts, and the gates have seen as many."""
    bits = [12] * cm.PREDICTORS
    rows = cm.keep(cm.buffered(docs), "texts")
    counts = cm.keep(cm.word_counts(rows), "counts")
    tables = cm.slot_tables(counts.groupBy("word").agg(F.sum("n").alias("n")), rows, bits)
    found = cm.taught(rows, counts, bits, spark.sparkContext.broadcast(tables)).groupBy((F.col("gate") < 0).alias("cells")).agg(F.sum(F.when((F.col("gate") < 0) | (F.col("at") == 0), F.col("seen"))).alias("n")).collect()
    seen = {r["cells"]: r["n"] for r in found}
    width = lambda token: int(cm.PATH_SIZE[np.frombuffer(token + b" ", np.uint8)].sum())
    wanted = sum(width(t) for i, text, _ in cases.prose() if zlib.crc32(str(i).encode()) % 5 != 1 for t in tokens(text))
    assert seen == {True: wanted, False: wanted}
