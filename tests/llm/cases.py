"""Small tables for the corpus operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=None):
    """(doc_id, text, source) as the documents table; by default made-up prose with copies, near copies, nulls and extremes."""
    rows = prose() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


def prose(seed=5, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ré", "tu", "en", "st"]) for _ in range(rng.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k))
    passage = text(70)
    rows = []
    for i in range(n):
        t = text(rng.choice([3, 12, 60, 140]))
        if i % 7 == 3:
            t = f"{t}\n{passage} {text(9)}"
        if i % 6 == 5:
            t = rows[-1][1]
        if i % 9 == 8:
            words = (rows[0][1] or "").split(" ")
            words[i % len(words)] = word()
            t = " ".join(words)
        rows.append((i, t, f"src{rng.randint(0, 3)}"))
    rows += [(n, None, None), (n + 1, "", "src0"), (n + 2, " \n\t ", None), (n + 3, text(4000), "src1"), (n + 4, "one", "src9"), (n + 5, "na " * 300, "src2")]
    return rows


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}
