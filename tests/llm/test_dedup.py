"""Substring, suffix, exact and Jaccard dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plantlens.llm import exact_dedup, jaccard, substring, suffix_index
from plantlens.llm.common import Words, anchors, byte_hash, covered
from plantlens.llm.components import Forest, components

from .fixtures import LOWER, WORD, corpus, least_of, table


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words_of(text):
    return WORD.findall(text or "")


def expected_substring(rows, window):
    texts = [words_of(t) for _, t, _ in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _, _), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((doc_id, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "gram"), [(35, 8), (5, 2)])
def test_substring_matches_brute_force(spark, window, gram):
    rows = corpus() + [(None, "p q r s t u v", "s0"), (None, "zz p q r s t", "s0"), (7, corpus()[7][1], "s3")]
    got = substring.remove_repeats(table(spark, rows, clashing=True).repartition(5), window=window, gram=gram)
    have = sorted([tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], key=str)
    assert have == expected_substring(rows, window)
    for r in got.collect():
        assert sha(r["kept"]) == r["kept_sha256"]
        assert sum(s["last"] - s["first"] for s in r["spans"]) == r["n_removed"]


def expected_suffix(rows, window):
    """Rows that agree in id and text are one document; ids in order, null first, then by fingerprint (not tested)."""
    seen, out = set(), {}
    for doc_id, text, _ in sorted(set(rows), key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            if raw[i : i + window] in seen:
                gone[i : i + window] = b"\1" * window
            seen.add(raw[i : i + window])
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id, text] = (doc_id, len(raw), sum(gone), spans, sha(kept))
    return sorted((out[i, t] for i, t, _ in rows), key=str)


@pytest.mark.parametrize(("window", "gram", "branches", "block"), [(100, 24, 256, 1 << 20), (30, 8, 1, 1 << 20), (30, 8, 3, 2000), (12, 5, 1000, 300)])
def test_suffix_matches_brute_force(spark, window, gram, branches, block):
    rows = corpus() + [(7, corpus()[7][1], "s3"), (None, corpus()[9][1], "s0")]
    got = suffix_index.remove_earlier(table(spark, rows, clashing=True).repartition(5), window=window, gram=gram, most_branches=branches, block_bytes=block)
    have = sorted([tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()], key=str)
    assert have == expected_suffix(rows, window)


def test_run_length_index_finds_every_longest_match():
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 100, rng.integers(1, 60)).astype(np.uint8) for _ in range(25)]
    index = suffix_index.RunLengthIndex(texts)
    patterns = [rng.integers(97, 101, 40).astype(np.uint8) for _ in range(20)]
    whole = [t.tobytes() for t in texts]
    row, place, length = np.zeros(20, np.int64), np.full(20, index.order[0]), np.zeros(20, np.int64)
    for back in range(1, 41):
        row, place, length = index.step(row, place, length, np.array([p[40 - back] for p in patterns], np.int64) + 1)
        for k, p in enumerate(patterns):
            rest = p[40 - back :].tobytes()
            best = max(n for n in range(len(rest) + 1) if n == 0 or any(rest[:n] in w for w in whole))
            assert length[k] == best
            if best:
                assert (index.symbols[place[k] : place[k] + best] - 1).astype(np.uint8).tobytes() == rest[:best]
                assert index.order[row[k]] == place[k]


def test_exact_groups(spark):
    rows = corpus() + [(None, "one", "s0"), (7, corpus()[7][1], "s3")]
    docs = table(spark, rows, clashing=True).repartition(4)
    texts = Counter(t or "" for _, t, _ in rows)
    keep = {}
    for i, t, _ in rows:
        keep[t or ""] = max(keep.get(t or "", -1), -1 if i is None else i)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t, _ in rows:
        best = keep[t or ""] if texts[t or ""] > 1 else i
        want[i, best, texts[t or ""], i == best, sha(t or "")] += 1
    assert Counter(map(tuple, got)) == want
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == sorted(
        ((keep[t] if n > 1 else next(i for i, x, _ in rows if (x or "") == t)) is None, (keep[t] if n > 1 else next(i for i, x, _ in rows if (x or "") == t)) or 0, t)
        for t, n in texts.items())


def shingles(text, k):
    w = words_of((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


@pytest.mark.parametrize(("k", "hundredths"), [(4, 85), (1, 60), (2, 50)])
def test_jaccard_matches_brute_force(spark, k, hundredths):
    rows = corpus(n=90) + [(None, "never seen before in here", "s0"), (7, corpus(n=90)[7][1], "s3"), (500, "One", "s0")]
    sets = [shingles(t, k) for _, t, _ in rows]
    ids = range(len(rows))
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= hundredths * len(sets[a] | sets[b])]
    assert links
    least = least_of(ids, links)
    members = {}
    for a in ids:
        members.setdefault(least[a], []).append(rows[a][0])
    want = Counter((rows[a][0], len(sets[a]), min((x for x in members[least[a]] if x is not None), default=None) if sets[a] else rows[a][0]) for a in ids)
    docs = table(spark, rows, clashing=True).repartition(4)
    got = jaccard.near_duplicate_classes(docs, ngram=k, hundredths=hundredths)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, got.collect())) == want
    kept = jaccard.keep_one(docs, ngram=k, hundredths=hundredths)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not s for s in sets) + len({least[a] for a in ids if sets[a]})


def test_clusters_in_small_chunks_and_slices(spark, monkeypatch):
    """Chunks of a cluster, their copies and the batches of a key change nothing."""
    for name, value in (("CHUNK", 3), ("SLICE", 4), ("PROBE_TOKENS", 20), ("SEEN", 2), ("SALTS", 3)):
        monkeypatch.setattr(jaccard, name, value)
    test_jaccard_matches_brute_force(spark, 2, 50)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_shared_keys_whatever_the_batches(size):
    """Keys of two sets or more pass, however the rows are cut; rows of one set alone do not, unless tagged."""
    rng = np.random.default_rng(size)
    keys, sids = rng.integers(-40, 40, 300), rng.integers(-4, 4, 300)
    keys, sids = np.concatenate([keys, np.full(30, 99), np.full(30, 100)]), np.concatenate([sids, np.full(30, 7), np.repeat([5, 6], 15)])
    sets = {}
    for k, s in zip(keys.tolist(), sids.tolist(), strict=True):
        sets.setdefault(k, set()).add(s)
    want = {(k, s) for k, of in sets.items() if len(of) > 1 for s in of}
    order = np.lexsort((sids, keys))
    rows = pa.RecordBatch.from_arrays([pa.array(keys[order]), pa.array(sids[order]), pa.array(np.zeros(len(keys), np.int32))], names=["key", "sid", "tag"])

    def passed(rows):
        batches = [rows.slice(at, size) for at in range(0, rows.num_rows, size)]
        return {(r["key"], r["sid"]) for b in jaccard._shared_task([rows.slice(0, 0), *batches]) for r in b.to_pylist()}

    assert passed(rows) == want

    # two batches, each combined before: tagged rows lie elsewhere, their stand-ins among the others
    halves = [jaccard._tagged(x.astype(np.int64).view(np.uint64), y.astype(np.int64).view(np.uint64)) for x, y in
              ((keys[::2], sids[::2]), (keys[1::2], sids[1::2]))]
    both = pa.Table.from_batches(halves).to_pandas()
    got = set()
    for _, part in both.groupby(both["tag"].clip(lower=0)):
        got |= passed(pa.RecordBatch.from_pandas(part.sort_values(["key", "sid"]), preserve_index=False))
    assert got == want


@pytest.mark.parametrize("chunk", [3, 1 << 14])
def test_common_words_chain_no_unlike_sets_into_clusters(spark, monkeypatch, chunk):
    """Sets that share a segment by chance leave the groups by their sketches; before, they were clusters whose tokens met in full."""
    rng, stored, clusters = random.Random(7), jaccard.stored, []

    def seen(df, name):
        out = stored(df, name)
        clusters.extend([out.count()] if name == "jaccard-clusters" else [])
        return out

    monkeypatch.setattr(jaccard, "stored", seen)
    monkeypatch.setattr(jaccard, "GROUP_CHUNK", chunk)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.sample(words, 24)) for _ in range(150)]
    texts += [t + " " + u for t, u in zip(texts[:40:2], words, strict=False)]
    sets = [set(t.split()) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    least = least_of(range(len(sets)), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicate_classes(docs, ngram=1).collect()}
    assert got == {i: least[i] for i in range(len(sets))} and len(links) >= 20
    assert clusters and max(clusters) < 10


def test_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(3)
    for size in (1, 5, 63, 64, 200, 1000, 5000):
        pool = np.unique(rng.integers(0, 1 << 54, 3 * size, dtype=np.uint64))
        for _ in range(20):
            x = rng.choice(pool, size, replace=False)
            y = np.concatenate([rng.choice(x, rng.integers(0, size + 1), replace=False), rng.choice(pool, rng.integers(1, size + 1), replace=False)])
            x, y = np.unique(x), np.unique(y)
            a, b = jaccard._words([jaccard.sketch(x), jaccard.sketch(y)])
            assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))
    assert len(jaccard.sketch(np.zeros(0, np.uint64))) == 8


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_touching_sets_of_a_group_whatever_the_batches(size):
    """What touches is connected by the pairs that come out, within chunks and between them, and nothing else is."""
    rng = np.random.default_rng(size)
    base = [np.unique(rng.integers(0, 1 << 54, 90, dtype=np.uint64)) for _ in range(4)]
    sets = [np.concatenate([base[i % 4], rng.integers(0, 1 << 54, rng.integers(0, 4), dtype=np.uint64)]) for i in range(40)]
    own = [int(x) for x in rng.integers(0, 3, 40)]
    rows = [(5, chunk, int(chunk < own[i]), i, len(s), i, jaccard.sketch(s)) for i, s in enumerate(sets) for chunk in range(own[i] + 1)]
    rows += [(9, 0, 0, i, len(sets[i]), 77, jaccard.sketch(sets[i])) for i in (0, 4)]  # one component: nothing to find
    names = ["key", "chunk", "role", "sid", "n", "component", "sketch"]
    table = pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in sorted(rows)])
    found = [(r["a"], r["b"]) for b in jaccard._touching_task(85)(table.to_batches(max_chunksize=size)) for r in b.to_pylist()]
    assert found and all(a % 4 == b % 4 for a, b in found)
    least = least_of(range(40), found)
    assert all(least[i] == i % 4 for i in range(40))


def test_signatures_meet_for_all_linked_sizes():
    """Any two sets that reach the bound share a key, whatever their sizes, also with too few spare segments."""
    rng = np.random.default_rng(5)
    for hundredths in (50, 85, 95):
        for size in [*range(1, 40), 75, 150, 400]:
            a = np.unique(rng.integers(0, 1 << 54, size, dtype=np.uint64))
            for other in range(size * hundredths // 100, size + 1):
                if not other or 100 * other < hundredths * size:
                    continue
                b = rng.permutation(a)[:other]  # a subset
                common = other
                fresh = 0
                while 100 * common >= hundredths * (len(a) + fresh + 1) and fresh < 3:
                    fresh += 1
                b = np.sort(np.concatenate([b, rng.integers(0, 1 << 54, fresh, dtype=np.uint64)]))
                keys, owner = jaccard.signatures(np.concatenate([np.sort(a), b]), np.array([0, len(a), len(a) + len(b)]), hundredths)
                assert set(keys[owner == 0]) & set(keys[owner == 1])


def test_signatures_of_crowded_sets(monkeypatch):
    """With no spare segments, neighbourhoods and single tokens take over."""
    monkeypatch.setattr(jaccard, "_spare", lambda differences, size: 0)
    jaccard.schemes.cache_clear()
    try:
        test_signatures_meet_for_all_linked_sizes()
    finally:
        jaccard.schemes.cache_clear()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(3, 3), (5, 4)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = least_of({x for e in links for x in e}, links)
    assert got == {x: c for x, c in want.items() if x != c}


def test_forest_keeps_links_over_many_calls():
    forest = Forest(8)
    for targets in ([5, 7], [3, 5], [2, 7]):
        forest.join(np.zeros(2, np.int64), np.array(targets))
    assert forest.label.tolist() == [0, 1, 2, 2, 4, 2, 6, 2]
    rng = np.random.default_rng(2)
    n = 600
    place = rng.permutation(n)  # chains of 30 targets under shuffled names, met in small batches
    pairs = rng.permutation([(place[i], place[i + 1]) for i in range(n - 1) if (i + 1) % 30])
    forest = Forest(n)
    for at in range(0, len(pairs), 7):
        some = np.sort(pairs[at : at + 7], axis=1)
        first = forest.join(np.repeat(np.arange(len(some)), 2), some.ravel())
        assert first.tolist() == list(range(0, 2 * len(some), 2))
    want = least_of(set(range(n)), [tuple(map(int, p)) for p in pairs])
    node, root = forest.edges()
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {x: c for x, c in want.items() if x != c}


def test_sampled_grams_agree_on_equal_windows():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    place, first, last = anchors(byte_hash(data).windows(3), np.ones(400 - 9, bool), 8)
    assert (np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)]) == np.arange(391)).all()
    chosen = {}
    for p, a, b in zip(place, first, last, strict=True):
        for i in range(a, b + 1):
            assert chosen.setdefault(data[i : i + 10].tobytes(), p - i) == p - i
    assert covered(5, np.array([0, 3]), np.array([2, 9][:1] + [5])).tolist() == [True, True, False, True, True]


def test_words_split_on_ascii_space_only():
    texts = ["a b", "", " \t", "é\u00a0x\vy", "z"]
    raw = [t.encode() for t in texts]
    words = Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert words.count.tolist() == [len(words_of(t)) for t in texts]


@pytest.mark.parametrize("operator", [substring.remove_repeats, suffix_index.remove_earlier, exact_dedup.exact_duplicates, exact_dedup.drop_duplicates,
                                      jaccard.near_duplicate_classes, jaccard.keep_one])
def test_empty_tables(spark, operator):
    assert operator(table(spark, [])).count() == 0
    assert operator(table(spark, [(None, None, None)])).count() == 1
