"""Quality rules (3) and URL filters (5)."""

import collections
import math
import random
import re

import cases
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import urlfilter
from quire.llm.quality import FEATURES, fit_trees, keep_good, quality_verdicts, statistics
from quire.llm.urlfilter import entropy, featured, filter_urls, host_of, judged, lexical_features, path_of


def plain_statistics(text):
    text, w = text or "", cases.words(text)
    windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    again = [False] * len(w)
    for k in range(len(w) - 4):
        if windows[tuple(w[k : k + 5])] > 1:
            again[k : k + 5] = [True] * 5
    lines = [x for x in text.split("\n") if cases.words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(again)


TEXTS = [t for _, t, _ in cases.prose()] + ["x\nx\n\n x\nx\n", "a b c d e a b c d e f", "é # é\n#|\x0bq\x1fr", "\n", "a\n" * 50, "w " * 4000]


def test_statistics_are_the_plain_ones():
    found = statistics(pa.array(TEXTS, pa.string()))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert list(zip(*(found[c].tolist() for c in names), strict=True)) == [plain_statistics(t) for t in TEXTS]


def test_trees_are_accurate_on_held_out_rows_and_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(FEATURES)))
    y = (x[:, 1] - x[:, 2] + 0.1 * rng.standard_normal(4000) > 0).astype(float)
    signs = list(FEATURES.values())
    trees = fit_trees(x[:3000], y[:3000], signs)
    assert ((trees.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    for j, sign in enumerate(signs):
        if sign:
            base = np.repeat(x[3000:3050], 20, axis=0)
            base[:, j] = np.tile(np.linspace(0, 1, 20), 50)
            assert (sign * np.diff(trees.score(base).reshape(50, 20), axis=1) >= -1e-12).all()


def labelled(spark, n=400):
    rng = random.Random(3)
    good = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho"]) + str(rng.randint(0, 99)) for _ in range(80)), "s") for i in range(n)]
    bad = [(n + i, " ".join(rng.choice(["zip", "zap", "zop"]) + f"{rng.randint(0, 999)}$$$" for _ in range(80)), "s") for i in range(n)]
    return good + bad, spark.createDataFrame([(i, int(i < n), 0) for i, _, _ in good + bad if i % 2 == 0], "doc_id long, quality int, toxic int")


def test_verdicts_hold_out(spark):
    rows, labels = labelled(spark)
    found = quality_verdicts(cases.documents(spark, rows), labels)
    for r in found.collect():
        n, chars, symbols, dup, repeat = plain_statistics(rows[r["doc_id"]][1])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
        assert r["kept"] == (r["doc_id"] < 400)


def test_quality_without_labels_and_with_clashing_columns(spark, docs, empty, clashing):
    none = spark.createDataFrame([(None, 1, None), (1, None, None)], "doc_id long, quality int, toxic int")
    kept = cases.by_id(quality_verdicts(docs, none), "base_failed", "kept")
    assert all(k == (not b) for b, k in kept.values()) and len(kept) == len(cases.prose())
    out = keep_good(clashing, none)
    assert out.columns == clashing.columns and {r["doc_id"] for r in out.collect()} == {i for i, (_, k) in kept.items() if k}
    assert quality_verdicts(empty, none).count() == 0 and keep_good(empty, none).count() == 0


URLS = [
    ("https://A.Example.NET/en/1?x=/de/", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://net/", "net", "/", "net/", "block"),
    ("http://x.net", "x.net", "", None, None),
    ("https://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
    ("https://www.example.com/de/a#b", "www.example.com", "/de/a", "example.com/de/", "block"),
    ("ftp://q.org/fr/://z", "q.org", "/fr/://z", "org/fr/", "allow"),
    ("https://q.org?fr/", "q.org", "", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("", "", "", None, None),
    ("://\nh/p\nq?r", "\nh", "/p\nq", None, None),
]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, length int")


def test_rules_fit_hosts_and_paths(spark):
    found = {r["page_id"]: r for r in filter_urls(pages(spark, [u for u, *_ in URLS])).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, rule)
        assert found[i]["verdict"] == (verdict or found[i]["verdict"]) and found[i]["verdict"] in ("allow", "block")
    assert pages(spark, ["a://B/c"]).select(host_of(F.col("url")), path_of(F.col("url"))).first() == ("b", "/c")


def test_urls_without_rules_or_rows(spark):
    assert {r["verdict"] for r in filter_urls(pages(spark, ["http://a.com/x", None])).collect()} == {"allow"}
    assert filter_urls(pages(spark, [])).count() == 0


def test_trees_agree_with_rules_on_urls_they_were_not_fitted_to(spark):
    rng = random.Random(6)
    name = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    urls = [f"http://{name(30)}-{rng.randint(10**8, 10**9)}.net/{name(40)}" for _ in range(400)] + [f"http://{name(5)}.org/fr/{name(4)}" for _ in range(400)]
    urls += [f"http://{name(5)}.biz/{name(4)}" for _ in range(200)]
    found = filter_urls(pages(spark, urls), rows=200).orderBy("page_id").collect()
    assert np.mean([(r["score"] > 0.5) == (r["verdict"] == "block") for r in found[:800]]) > 0.95
    assert [r["verdict"] for r in found[800:]].count("block") <= 10


def tree_of(lines, depth):
    """(feature, at most, left, right) or a number, from a tree's lines."""
    line = lines.pop(0).strip()
    if line.startswith("Predict"):
        return float(line.split(":")[1])
    feature, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    left = tree_of(lines, depth + 1)
    assert lines.pop(0).strip().startswith("Else")
    return int(feature), float(bound), left, tree_of(lines, depth + 1)


def plain_score(model, features):
    margin = 0.0
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        node = tree_of(tree.toDebugString.strip().split("\n")[1:], 0)
        while isinstance(node, tuple):
            node = node[2] if features[node[0]] <= node[1] else node[3]
        margin += weight * node
    return 1 / (1 + math.exp(-2 * margin))


def made_urls(seed, n=500):
    rng = random.Random(seed)
    name = lambda k: "".join(rng.choice("abcdefghij") for _ in range(k))
    hosts = [f"{rng.choice(['www.', '', 'm.'])}{name(rng.randint(3, 12))}.example.{rng.choice(['com', 'net', 'org'])}" for _ in range(40)]
    return [f"https://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr'])}/{rng.randint(1, 10**rng.randint(1, 9))}{rng.choice(['', '.html', '?a=1&b=2', '#x'])}" for _ in range(n)]


def test_suffix_statistics_and_verdicts_are_the_plain_ones(spark):
    """Shares from other folds of hosts, and the trees walked node by node."""
    urls = made_urls(4)
    full = featured(pages(spark, urls))
    model = urlfilter.fit_trees(full)
    rows, found = {r["page_id"]: r for r in full.collect()}, {r["page_id"]: r for r in judged(full, model).collect()}
    fold = {r["host"]: (xxhash.xxh64_intdigest(r["host"], 42) + (1 << 63)) % (1 << 64) - (1 << 63) for r in rows.values()}
    fold = {h: x % urlfilter.FOLDS for h, x in fold.items()}
    for i, r in rows.items():
        mine = [o for o in rows.values() if o["suffix"] == r["suffix"]]
        others = [o for o in mine if fold[o["host"]] != fold[r["host"]]]
        assert r["suffix_share"] == pytest.approx(len(mine) / len(urls))
        assert r["suffix_blocked"] == pytest.approx((sum(o["verdict"] == "block" for o in others) + 1) / (len(others) + 10))
        score = plain_score(model, [r[c] for c in urlfilter.FEATURES])
        assert found[i]["score"] == pytest.approx(score, abs=1e-9)
        assert found[i]["verdict"] == (r["verdict"] or ("block" if found[i]["score"] > 0.5 else "allow"))
    assert len({round(r["score"], 6) for i, r in found.items() if rows[i]["verdict"] is None}) > 20


def test_features_do_not_tell_labels_within_a_host(spark):
    """All pages of a host, blocked, allowed or undecided, have the same statistics of its suffix."""
    of = collections.defaultdict(set)
    for r in featured(pages(spark, made_urls(5))).collect():
        of[r["host"]].add((r["suffix_share"], r["suffix_blocked"]))
    assert all(len(x) == 1 for x in of.values())


def test_hosts_that_trees_have_not_seen(spark):
    """Trees fitted without some hosts agree with rules on these hosts' pages, where features tell them: long addresses are blocked ones here."""
    rng = random.Random(8)
    name = lambda k: "".join(rng.choice("abcdefghij") for _ in range(k))
    blocked = [f"http://h{h}x{name(25)}.net/{name(30)}/{rng.randint(0, 10**6)}" for h in range(40) for _ in range(8)]
    allowed = [f"http://h{h}y.example.net/en/{rng.randint(0, 99)}" for h in range(40) for _ in range(8)]
    full = featured(pages(spark, blocked + allowed))
    seen = F.regexp_extract("host", "^h([0-9]+)", 1).cast("int") % 4 != 0
    model = urlfilter.fit_trees(full.where(seen))
    unseen = judged(full.where(~seen), model).collect()
    assert len(unseen) == 160 and np.mean([(r["score"] > 0.5) == (r["verdict"] == "block") for r in unseen]) > 0.95


def test_clashing_columns_and_a_score_at_the_threshold(spark):
    urls = made_urls(6, 120)
    df = pages(spark, urls)
    clash = df.withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "score", "suffix", "fold", "label", "weight", "_features", "_h", "n")})
    plain = {r["page_id"]: tuple(r) for r in filter_urls(df).collect()}
    assert {r["page_id"]: tuple(r) for r in filter_urls(clash).collect()} == plain
    full = featured(df)
    model = urlfilter.fit_trees(full)
    score = max(r["score"] for r in judged(full.where("verdict is null"), model).collect())
    assert {r["verdict"] for r in judged(full.where("verdict is null"), model, score).collect()} == {"allow"}


@pytest.mark.parametrize("text", ["", "aaaa", "abab", "hello.world", "a.b*c"])
def test_entropy(spark, text):
    counts = collections.Counter(text)
    expected = -sum(n / len(text) * math.log2(n / len(text)) for n in counts.values())
    assert spark.range(1).select(entropy(F.lit(text))).first()[0] == pytest.approx(expected)


def test_features_are_the_plain_ones(spark):
    rng = random.Random(2)
    part = lambda n: "".join(rng.choice("abcXYZ0123-._~%") for _ in range(rng.randrange(n)))
    urls = [u for u, *_ in URLS] + [f"http{rng.choice(['', 's'])}://{part(20)}.{part(5)}/{part(9)}/{part(9)}{rng.choice(['', '?a=' + part(5), '?a=1&b=' + part(4), '#x'])}" for _ in range(150)]
    for r in lexical_features(pages(spark, urls)).collect():
        url = urls[r["page_id"]] or ""
        rest = re.split(r"[/?#]", url.split("://", 1)[1], maxsplit=1)[0] if "://" in url else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), rest)
        path = re.match(r"[^?#]*", url.split("://", 1)[1][len(rest) :])[0] if "://" in url else ""
        query = url.split("?", 1)[1].split("#")[0] if "?" in url else ""
        chars = collections.Counter(url)
        bits = -sum(n / len(url) * math.log2(n / len(url)) for n in chars.values())
        wanted = (host, path, len(url), len(host), len(path), host.count("."), len(re.findall("/[^/]", path)), sum(c in "0123456789" for c in url) / max(len(url), 1), host.count("-"), query.count("&") + 1 if query else 0, float("#" in url))
        assert (r["host"], r["path"], r["length"], r["host_length"], r["path_length"], r["labels"], r["depth"], pytest.approx(r["digits"]), r["hyphens"], r["parameters"], r["fragment"]) == wanted, url
        assert r["entropy"] == pytest.approx(bits) and r["suffix"] == host.rsplit(".", 1)[-1]


def test_repeated_and_very_long_urls(spark):
    long = "http://a.example.net/en/" + "x/" * 500_000 + "?" + "&" * 100_000
    rows = [("http://b.biz/1",)] * 3 + [(long,), ("http://" + "a." * 200_000 + "net/",), ("http://q.org/fr/1",)]
    df = spark.createDataFrame([(i % 4, *r) for i, r in enumerate(rows)], "page_id long, url string")
    found = filter_urls(df).collect()
    assert len(found) == 6 and len({(r["verdict"], r["score"]) for r in found if r["host"] == "b.biz"}) == 1
    assert sorted((r["rule"], r["verdict"]) for r in found if r["rule"]) == [("example.net/en/", "allow"), ("net/", "block"), ("org/fr/", "allow")]


def test_quality_of_repeated_rows_and_long_texts(spark):
    long = " ".join(f"w{k % 70_000}" for k in range(200_000))
    df = cases.documents(spark, [(1, "one two three " * 9, "s")] * 3 + [(2, long, "s"), (None, long, "s")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = quality_verdicts(df, none).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_repeat_words"], r["kept"]) for r in found) == [(0, 200_000, 200_000, False), *[(1, 27, 27, False)] * 3, (2, 200_000, 200_000, False)]
