"""The audit of filters against each order worked through one document at a time, and its chains under collisions."""

import itertools
import re

import cases
import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import filteraudit
from quire.llm.filteraudit import Chains, audit_filters, copies
from quire.llm.oracles import FILTER_AUDIT

LABELS = "doc_id long, quality int, toxic int"


def plain(rows, labels):
    """(part, order, step) to the counts, each order applied in turn."""
    docs = []
    for doc_id, text, source in rows:
        text = text or ""
        words = cases.words(text)
        smaller = any(doc_id is not None and i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": smaller,
        }
        docs.append((source or "", {f for f, x in fails.items() if x}, any(i == doc_id and q == 1 for i, q, _ in labels if i is not None), any(i == doc_id and t == 1 for i, _, t in labels if i is not None)))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                mine = [d for d in docs if d[0] == part]
                gone = [d for d in left if f in d[1]]
                failing = sum(f in d[1] for d in mine)
                left = [d for d in left if f not in d[1]]
                out[part, order, step] = (len(left), len(gone), failing - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone))
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def odd_rows():
    long = " ".join(f"w{k}" for k in range(260))
    rows = cases.prose()[:25] + [(100 + i, long, "src0") for i in range(9)] + [(100, long, "src0"), (90, long, "src7"), (None, long, None), (None, None, None), (3, None, "")]
    return rows + [(200, "A" * 50 + long, "src0"), (201, long + " |", ""), (202, "na " * 300, "src1"), (203, "é" * 3 + long, "src1"), (201, "other", "src2"), (204, "", "src2")]


def test_every_order_is_the_plain_one(spark):
    rows = odd_rows()
    labels = [(i, i % 3 == 0, i % 4 == 0) for i in range(0, 110)] + [(100, 1, None), (100, 0, 1), (None, 1, 1)]
    labels = [(i, None if q is None else int(q), None if t is None else int(t)) for i, q, t in labels]
    docs = cases.documents(spark, rows).withColumn("mask", F.lit(1)).withColumn("part", F.lit("x")).repartition(5)
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in audit_filters(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert found == plain(rows, labels)


def test_sql_says_the_same_on_odd_rows(spark):
    rows = odd_rows()
    documents = cases.documents(spark, rows).toArrow()  # noqa: F841  duckdb finds both by name
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(100, 1, 1), (100, 0, 0)], LABELS)
    expected = plain(rows, [tuple(r) for r in labels.collect()])
    labels = labels.toArrow()
    result = duckdb.sql(FILTER_AUDIT).fetchall()
    assert {r[:3]: r[3:] for r in result} == expected


def test_chains_hold_texts_with_one_fingerprint(monkeypatch, spark):
    """With one fingerprint for all texts, full texts still tell copies."""
    chains = Chains()
    assert chains.add(1, b"x", 5, {(5, "", 0): 1}) == [] and chains.add(1, b"y", 6, {(6, "", 0): 1}) == []
    assert chains.add(1, b"x", 5, {(5, "", 0): 2}) == [] and chains.add(1, b"x", 9, {(9, "", 0): 1}) == [((9, "", 0), 1)]
    assert chains.add(1, b"x", 2, {(2, "", 0): 1}) == [((5, "", 0), 3)] and chains.add(1, b"y", 7, {(7, "", 0): 1}) == [((7, "", 0), 1)]
    assert sorted(e[1] for _, e in chains.drain()) == [2, 6] and chains.size == 0 and not chains.of


def test_texts_are_passed_on_early_when_many(monkeypatch):
    monkeypatch.setattr(filteraudit, "REMEMBERED", 1000)
    rows = [(i, f"text {i % 50}", "s") for i in range(200)]
    found = list(filteraudit._read(3, iter(rows)))
    assert sum(v[0] is not None for _, v in found) > 50 and {k[1] for k, _ in found} == {3}
    pairs = sorted(found, key=lambda x: x[0])
    last = list(filteraudit._meet(iter(sorted(filteraudit._meet(iter(pairs), False), key=lambda x: x[0])), True))
    assert len(last) == 200 and sorted(v[1] for _, v in last if not v[3] & filteraudit.COPY) == list(range(50))


def test_hot_texts_and_copies(spark):
    rows = [(i, "the hot text" if i % 3 else f"text {i}", "s") for i in range(600)]
    found = sorted(r["doc_id"] for r in copies(cases.documents(spark, rows).repartition(37)).collect())
    assert found == [i for i in range(2, 600) if i % 3]


def test_no_documents_no_rows(spark):
    assert audit_filters(cases.documents(spark, []), spark.createDataFrame([], LABELS)).collect() == []


@pytest.mark.parametrize("text", ["\ud800 x", "a\x00b", "   ", "x" * 3_000_000])
def test_odd_texts(text):
    assert filteraudit.text_mask(text) & 1 == 1
