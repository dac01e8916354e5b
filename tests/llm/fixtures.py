"""Small tables with everything that may go wrong in them."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use themselves.
CLASHING = ("k1", "k2", "row", "n", "h", "c", "size", "score", "sid", "node", "vector", "spans", "packed", "mark", "text_sha256", "keep_id", "kept", "label", "host")


def table(spark, rows, clashing=False):
    """documents from (doc_id, text, source) rows."""
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHING}) if clashing else df


def corpus(seed=3, n=60):
    """Random texts over a small vocabulary, with shared passages, near and exact copies, and odd texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéüxyz") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = words(60)
    rows = []
    for i in range(n):
        text = words(rng.randint(1, 160))
        kind = i % 6
        if kind == 1 and rows:
            text = (rows[rng.randrange(len(rows))][1] or "").split(" ")
        elif kind == 2 and rows:
            text = (rows[rng.randrange(len(rows))][1] or "").split(" ")
            text[rng.randrange(len(text))] = "changed"
        elif kind == 3:
            at = rng.randrange(len(text))
            text = text[:at] + passage[rng.randrange(20):] + text[at:]
        rows.append((i, rng.choice([" ", " ", "\n", "\t "]).join(text) if kind == 5 else " ".join(text), f"s{i % 4}"))
    again = " ".join(words(12))
    rows += [
        (n, None, None), (n + 1, "", "s0"), (n + 2, "  \n\t", "s1"), (n + 3, "a " * 300, "s2"), (n + 4, "a " * 300, None),
        (n + 5, f"{again} {again} {again} {again} {again}", "s3"), (n + 6, "one", "s0"), (n + 7, "ONE", "s0"),
        (n + 8, "x" * 3000, "s1"), (n + 9, " ".join(words(6000)), "s2"), (n + 10, None, "s3"), (n + 11, "日本語 テキスト 🤗 \x00 end", "s1"),
    ]
    return rows


def least_of(nodes, links):
    """Least node reachable of every node."""
    at = {x: x for x in nodes}

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}
