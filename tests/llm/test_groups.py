"""Centroid clustering, spelling variants and weak-supervision rules against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens.llm import centroids, spelling, weak_rules

from .fixtures import CLASHING, LOWER, WORD, corpus, table


# ---- centroid clustering

def plain_clusters(rows, dim, scale, k, rounds, seed):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(float(np.float32(x)) * scale) for x in v]))
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes())
    centers = [x for _, x in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((far(x, c), j) for j, c in enumerate(centers)) for _, x in kept]
    for _ in range(rounds):
        groups = {}
        for (_, x), (_, j) in zip(kept, assign(), strict=True):
            groups.setdefault(j, []).append(x)
        centers = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centers)]
    last = assign()
    inertia = Counter()
    for d, j in last:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted((str(i), j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(kept, last, strict=True))


def vector_rows(n=150, dim=6, seed=2):
    rng = random.Random(seed)
    middles = [[rng.uniform(-3, 3) for _ in range(dim)] for _ in range(4)]
    rows = [(i, [m + rng.gauss(0, 0.4) for m in rng.choice(middles)]) for i in range(n)]
    rows += [(n + j, rows[j][1]) for j in range(20)]  # repeated vectors
    rows += [(5, [9.0] * dim), (5, [9.0] * dim), (5, [-9.0] * dim), (None, [0.25] * dim), (None, [0.25] * dim)]
    rows += [(900, None), (901, []), (902, [1.0] * (dim - 1)), (903, [1.0] * (dim + 1)), (904, [None] + [1.0] * (dim - 1)), (905, [math.nan] + [1.0] * (dim - 1)),
             (906, [math.inf] * dim), (907, [1e30] * dim), (908, [0.0] * dim), (909, [-0.0] * dim)]
    return rows


def vector_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in (*CLASHING, "x", "v", "cluster", "head", "rest", "i")})


@pytest.mark.parametrize(("k", "rounds", "lead"), [(5, 6, 2), (3, 0, 6), (400, 2, 1)])
def test_clusters_equal_plain_loops(spark, k, rounds, lead):
    rows = vector_rows()
    got = centroids.cluster_vectors(vector_table(spark, rows).repartition(5), dim=6, scale=100, k=k, rounds=rounds, lead=lead)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = plain_clusters([r for r in rows if r[0] != 907], 6, 100, k, rounds, centroids.SEED)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want


def test_empty_tables_of_vectors(spark):
    empty = vector_table(spark, [])
    assert centroids.cluster_vectors(empty, dim=6).count() == 0
    assert centroids.cluster_vectors(vector_table(spark, [(1, None)]), dim=6).count() == 0


def test_bounds_leave_out_centroids_and_change_nothing():
    rng = np.random.default_rng(4)
    middles = rng.integers(-20000, 20000, (40, 32))
    x = middles[rng.integers(0, 40, 3000)] + rng.integers(-900, 900, (3000, 32))
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1]
    best, least, measured = centroids.nearest(x, *centroids.rotated(x, axes, 6), middles, *centroids.rotated(middles, axes, 6))
    exact = np.square(x[:, None, :] - middles[None]).sum(axis=2)
    assert (best == exact.argmin(axis=1)).all() and (least == exact.min(axis=1)).all()
    assert measured < 2 * len(x)
    twice = np.concatenate([middles[:3], middles[:3]])  # ties go to the smaller number
    best, _, _ = centroids.nearest(x, *centroids.rotated(x, axes, 6), twice, *centroids.rotated(twice, axes, 6))
    assert best.max() == 2
    big = np.full((2, 64), centroids.largest_component(64)) * np.array([[1], [-1]])
    best, least, _ = centroids.nearest(big, *centroids.rotated(big, np.eye(64), 8), big[:1], *centroids.rotated(big[:1], np.eye(64), 8))
    assert least.tolist() == [0, 64 * 4 * centroids.largest_component(64) ** 2]


# ---- spelling variants

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(count, ratio=2):
    near = {w: [v for v in count if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= ratio * count[w] else None
    out = []
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), count.get(form[w])))
    return sorted(out)


def random_words(seed=1, n=500):
    rng = random.Random(seed)
    words = {"".join(rng.choice("aabbcéßÿ") for _ in range(rng.randint(5, 8))) for _ in range(n)}
    words |= {"listen", "silent", "enlist", "a" * 6, "a" * 7, "a" * 8, "a" * 300, "a" * 301, "b" + "a" * 299, "a" * 299 + "b", "abcdef", "abcdfe"}
    return {w: rng.choice([3, 4, 6, 9, 20, 50]) for w in sorted(words)}


@pytest.mark.parametrize(("per_cell", "chunk"), [(1 << 15, 1 << 15), (25, 1 << 15), (25, 7), (1 << 15, 40)])
def test_near_words_equal_brute_force(spark, per_cell, chunk):
    count = random_words()
    words = spark.createDataFrame(list(count.items()), "word string, n long").withColumns({"h": F.lit(1), "length": F.lit("x"), "cell": F.lit(0)}).repartition(5)
    got = spelling.group_words(words, per_cell=per_cell, chunk=chunk)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in got.collect()) == plain_groups(count)


def test_chains_of_forms_are_followed_to_their_end(spark):
    word, chain = "aaaaaaaaaaaa", []
    for i in range(12):
        chain.append((word[:i] + "b" * (12 - i), 3 * 2**i))
    got = spelling.group_words(spark.createDataFrame(chain, "word string, n long")).collect()
    assert {r["root"] for r in got} == {chain[-1][0]}
    assert sum(r["form"] is None for r in got) == 1


def test_words_of_documents_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcéÀ") for _ in range(rng.randint(3, 8))) for _ in range(60)]
    rows = [(i, rng.choice([" ", "-", "×2 "]).join(rng.choice([w, w.upper(), w.title()]) for w in rng.choices(vocabulary, k=rng.randint(0, 60))), "s") for i in range(120)]
    rows += [(None, "wordlike wordlike wordlike", "s"), (7, None, "s"), (8, "", "s"), (rows[3][0], rows[3][1], "s"), (9, "longlong " * 20000, None), (10, "x" * 70000 + " é" * 50, "s")]
    count = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    count = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    got = spelling.spelling_groups(table(spark, rows, clashing=True).repartition(4))
    assert sorted(tuple(r) for r in got.collect()) == plain_groups(count)
    assert spelling.spelling_groups(table(spark, [])).count() == 0
    assert spelling.spelling_groups(table(spark, [(1, "one two", "s")])).count() == 0


def test_tree_searches_find_every_reachable_box():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 4, (400, spelling.LETTERS)).astype(np.uint8) * (rng.random((400, spelling.LETTERS)) < 0.08)
    points = points.astype(np.uint8)
    points[300:340] = points[0]  # equal vectors stay in one leaf
    tree = spelling.KdTree(points, 10)
    leaf_of = np.empty(len(points), np.int64)
    for number, (a, size) in enumerate(zip(tree.start, tree.size, strict=True)):
        leaf_of[tree.order[a : a + size]] = number
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for up, down in ((1, 1), (0, 1), (0, 0)):
        found = set(zip(*(x.tolist() for x in tree.search(points, up, down)), strict=True))
        gap = points[None, :, :].astype(int) - points[:, None, :]
        close = (np.maximum(gap, 0).sum(axis=2) <= up) & (np.maximum(-gap, 0).sum(axis=2) <= down)
        assert {(p, leaf_of[t]) for p, t in np.argwhere(close)} <= found
        assert len(found) < len(points) * len(tree.size)
    assert len(tree.search(points, 0, 0)[0]) == len(points)


# ---- rules

def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    letter = re.compile("[A-Za-z\u0080-\U0010ffff]")
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": dup, "n_repeat_words": len(repeated),
        "n_lines": sum(bool(WORD.search(x)) for x in text.split("\n")), "n_capitals": len(re.findall("[A-Z]", text)), "n_letters": len(letter.findall(text)),
        "n_ends": sum(w[-1] in ".!?" for w in words), "n_distinct": len(set(words)), "n_letter_words": sum(bool(letter.search(w)) for w in words),
    }


def plain_estimate(votes, count, rounds=weak_rules.ROUNDS):
    n, m = len(votes), len(votes[0])
    share = [weak_rules.START_GOOD, *[(1 - weak_rules.START_GOOD) / m] * m]
    start = [[weak_rules.START_FALSE] * m] + [[weak_rules.START_OWN if i == j else weak_rules.START_OTHER for j in range(m)] for i in range(m)]
    rate, start_share, weight = start, share, weak_rules.PRIOR_WEIGHT
    for _ in range(rounds):
        post = []
        for v in votes:
            p = [s * math.prod(r[j] if v[j] < 0 else 1 - r[j] if v[j] > 0 else 1.0 for j in range(m)) for s, r in zip(share, rate, strict=True)]
            post.append([x / sum(p) for x in p])
        held = [sum(post[i][c] * count[i] for i in range(n)) for c in range(m + 1)]
        share = [(h + weight * s) / (sum(count) + weight) for h, s in zip(held, start_share, strict=True)]
        new = []
        for c in range(m + 1):
            row = []
            for j in range(m):
                bad = sum(post[i][c] * count[i] for i in range(n) if votes[i][j] < 0)
                cast = sum(post[i][c] * count[i] for i in range(n) if votes[i][j])
                least = weak_rules.LEAST_FALSE if c == 0 else weak_rules.LEAST_OWN if c == j + 1 else 1e-6
                row.append(min(max((bad + weight * start[c][j]) / (cast + weight), least), 1 - 1e-6))
            new.append(row)
        rate = new
    return [p[0] for p in post]


def test_estimation_equals_plain_loops():
    rng = random.Random(2)
    votes = [[rng.choice([-1, 0, 1, 1]) for _ in range(4)] for _ in range(25)]
    count = [rng.randint(1, 60) for _ in votes]
    posterior, share, rate = weak_rules.estimate(np.array(votes), np.array(count, float), 40)
    assert np.allclose(posterior, plain_estimate(votes, count, 40), atol=1e-9)
    assert math.isclose(share.sum(), 1) and ((rate > 0) & (rate < 1)).all()
    assert weak_rules.estimate(np.zeros((0, 4)), np.zeros(0))[0].shape == (0,)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 8))) + ("." if rng.random() < 0.08 else "") for _ in range(n))


def test_measures_verdicts_and_odd_rows(spark):
    rng = random.Random(8)
    clean = [(i, prose(rng, rng.randint(60, 300)), "s") for i in range(120)]
    menus = [(200 + i, prose(rng, 150).replace(" ", " | "), "s") for i in range(8)]
    symbols = [(220 + i, prose(rng, 150).replace(" ", "### "), "s") for i in range(8)]
    shouts = [(240 + i, prose(rng, 150).upper().replace(" ", "!! "), "s") for i in range(8)]
    repeats = [(260 + i, (prose(rng, 9) + "\n") * 30, "s") for i in range(8)]
    odd = [(1000 + i if i is not None else None, t, s) for i, t, s in corpus()]
    odd += [(clean[0][0], clean[0][1], "s"), (2000, "a b c\na b c\n\n \n a b c\n" * 15, None), (2001, prose(rng, 90000), "s"), (None, clean[1][1], "s"), (-7, "Ünïcode ÉÉÉ 日本。 a b " * 60, "s")]
    rows = clean + menus + symbols + shouts + repeats + odd
    got = weak_rules.judged(table(spark, rows, clashing=True).repartition(7)).collect()
    key = lambda m: tuple(m[c] for c in weak_rules.MEASURES)
    measures = [(i, plain_measures(t)) for i, t, _ in rows]
    assert sorted((str(r["doc_id"]), *key(r)) for r in got) == sorted((str(i), *key(m)) for i, m in measures)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert all(i in kept for i, _, _ in clean) and 2001 in kept
    assert not kept & {i for i, _, _ in menus + symbols + shouts + repeats}
    again = weak_rules.judged(table(spark, rows).repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_a_corpus_without_faults_is_kept(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 200), "s") for i in range(60)]
    assert weak_rules.judged(table(spark, rows)).where("kept").count() == 60
    assert weak_rules.judged(table(spark, [])).count() == 0
