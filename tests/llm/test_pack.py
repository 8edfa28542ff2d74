"""Packing (2)."""

import collections
import random
import zlib

import cases
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import packing
from quire.llm.packing import Tokens, pack_documents, plan_sequences, price_best, slots, together

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_tokens_are_the_tokenizers(plain):
    odd = ["It's DON'T a### é!! x<|endoftext|> <|ENDOFTEXT|> 's\". ×. 9%% à-la-.. --x-- İ. K. d1,", "日本語　テスト\u00a0x\x1cy\x85z", "é" * 500 + "," + " x" * 50, "", "e\u0301, A\u0301.", "\x00 \ufeff a\u200bb,"]
    texts = [t or "" for _, t, _ in cases.prose()] + odd
    assert [np.frombuffer(x, "<u4").tolist() for x in Tokens(PATH).encode([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_letters_are_composed_before_they_are_lowered(plain):
    texts = ["H\u0331", "T\u0308", "W\u030a", "J\u030c", "aH\u0331B, Plain WORDS, \u00c9T\u00c9!", "J\u030c <|endoftext|> ABC"]
    assert [np.frombuffer(x, "<u4").tolist() for x in Tokens(PATH).encode([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_and_places(docs, plain):
    expected = {}
    for i, t, _ in cases.prose():
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            expected[i, k // 2048] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    found = pack_documents(docs, PATH).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in found} == expected
    placed = collections.defaultdict(list)
    for r in found:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in placed.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(placed) <= -(-sum(r["length"] for r in found) // 2048) + 1


def test_repeated_rows_nulls_and_none(spark, empty, clashing):
    found = pack_documents(cases.documents(spark, [(1, "a b", "x")] * 3 + [(None, None, None)]), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in found) == [(0, 1), (1, 3), (1, 3), (1, 3)]
    assert len({r["offset"] for r in found}) == 4 and len({r["sequence_id"] for r in found}) == 1
    assert pack_documents(empty, PATH).count() == 0 and pack_documents(clashing, PATH).count() >= len(cases.prose())


def test_knapsack_is_the_best_of_all():
    rng = random.Random(2)
    for _ in range(20):
        prices = np.zeros(13)
        for length in rng.sample(range(2, 13), 4):
            prices[length] = rng.random()
        best = lambda room: max([0.0, *(prices[x] + best(room - x) for x in range(2, min(room, 12) + 1) if prices[x])])
        config = price_best(prices, 12)
        assert sum(config) <= 12 and sum(prices[c] for c in config) == pytest.approx(best(12))


@pytest.mark.parametrize("shape", ["flat", "halves", "large"])
def test_plan_uses_every_piece_once_and_few_sequences(shape):
    rng, counts = np.random.default_rng(4), np.zeros(2049, np.int64)
    draws = {"flat": rng.integers(1, 2049, 3000), "halves": rng.integers(900, 1100, 3000), "large": rng.integers(1025, 2049, 500)}[shape]
    np.add.at(counts, draws, 1)
    plan = plan_sequences(counts)
    held = sum((np.bincount(config, minlength=2049) * times for config, times in plan), np.zeros(2049, np.int64))
    assert (held == counts).all() and all(sum(config) <= 2048 for config, _ in plan)
    n = sum(times for _, times in plan)
    decreasing = []  # best fit decreasing
    for x in sorted(draws.tolist(), reverse=True):
        fits = [b for b in range(len(decreasing)) if decreasing[b] + x <= 2048]
        if fits:
            decreasing[max(fits, key=lambda b: decreasing[b])] += x
        else:
            decreasing.append(x)
    assert n <= len(decreasing) + 2
    places = slots(plan)
    assert sum(times * len(config) for config, times in plan) == counts.sum() and (np.diff(places["length"]) >= 0).all()


def test_few_words_are_remembered_the_first_ones(plain, monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 20)
    tokens = Tokens(PATH)
    for k in range(0, 100, 10):
        text = "the of and " + " ".join(f"w{j}x" for j in range(k, k + 10))
        assert np.frombuffer(tokens.encode([text.encode()])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert {b"the", b"of", b"and"} <= set(tokens.known) and len(tokens.known) <= 20 + 13
    assert b"w0x" in tokens.known  # not forgotten with the later ones


def test_large_texts_are_not_tokenized_together():
    sizes = np.array([10, 600_000, 600_000, 3_000_000, 0, 5, *[1] * 600])
    parts = list(together(sizes))
    assert [at for at, _ in parts[1:]] == [at + n for at, n in parts[:-1]] and sum(n for _, n in parts) == len(sizes)
    assert parts[:4] == [(0, 2), (2, 1), (3, 1), (4, 256)] and max(n for _, n in parts) == 256
    assert list(together(np.zeros(0, np.int64))) == []
