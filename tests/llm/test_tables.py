"""Mixing, URL verdicts, embeddings, the pipeline and the registered queries."""

import math
import os
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plantlens.llm import embeddings, mixing, queries, url_filter

from .fixtures import CLASHING, WORD, corpus, least_of, table

SF = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def expected_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("per_block", [512, 3])
def test_mix_comes_near_its_targets(spark, per_block):
    rows = corpus(n=200) + [(7, corpus(n=200)[7][1], corpus(n=200)[7][2]), (None, "a b c", "é"), (900, "q " * 50, None)]
    docs = table(spark, rows, clashing=True).repartition(5)
    mix = mixing.mixed(docs, docs_per_block=per_block)
    got = mix.collect()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    target = expected_targets(sizes)
    taken, smallest = Counter(), {}
    assert sum(r["copies"] for r in got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["times"] <= 2
        taken[r["source"]] += r["size"] * r["times"] * r["copies"]
        if r["size"] and r["times"] < 2:
            smallest[r["source"]] = min(smallest.get(r["source"], 1 << 30), r["size"] * r["copies"])
    for s in sizes:
        assert taken[s] <= target[s] + 1e-6
        if per_block == 512:  # one block: what fits has been taken
            whole = int(target[s] // sizes[s]) if sizes[s] else 0
            left_out = [r["size"] * r["copies"] for r in got if r["source"] == s and r["times"] == whole and r["size"]]
            assert not left_out or target[s] - taken[s] < min(left_out) + 1e-6
    again = mixing.mixed(docs.repartition(2), docs_per_block=per_block).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    drawn = mixing.mix_documents(docs, docs_per_block=per_block)
    assert drawn.columns == docs.columns
    assert drawn.count() == sum(r["times"] * r["copies"] for r in got)


def test_splitting_tree_is_exact_and_even(spark):
    counts = np.array([5, 0, 70, 25, 1])
    quotas = mixing.split_quotas(counts, 7, seed=3)
    assert (quotas.sum(axis=0) == counts).all() and quotas.sum(axis=1).max() - quotas.sum(axis=1).min() <= 1
    means = np.mean([mixing.split_quotas(counts, 2, seed=s)[0] for s in range(300)], axis=0)
    assert np.allclose(means, counts / 2, atol=1.2)
    docs = table(spark, corpus(n=200)).repartition(4)
    mix = mixing.mixed(docs, docs_per_block=4)
    rows = mixing.with_shards(mix, words_per_shard=3000).collect()
    assert len(rows) == sum(r["times"] for r in mix.collect())
    assert len({r["shard"] for r in rows}) > 3
    blocks = {}
    for r in rows:  # blocks are disjoint: one shard per draw
        assert blocks.setdefault((r["source"], r["turn"], r["block"]), r["shard"]) == r["shard"]


def test_mix_written_by_shard(spark, tmp_path):
    docs = table(spark, corpus(n=60)).repartition(3)
    mixing.write_mix(docs, str(tmp_path / "mix"), words_per_shard=2000)
    assert spark.read.parquet(str(tmp_path / "mix")).count() == mixing.mix_documents(docs).count()
    assert mixing.mixed(table(spark, [])).count() == 0
    assert [r["times"] for r in mixing.mixed(table(spark, [(None, None, None)])).collect()] is not None


def test_mix_is_dealt_by_the_tree(spark, tmp_path, monkeypatch):
    rows = [r for r in corpus(n=200) if r[0] is not None]
    docs = table(spark, rows).repartition(4)
    draws = mixing.with_shards(mixing.mixed(docs, docs_per_block=4), words_per_shard=3000).collect()
    assert len({r["shard"] for r in draws}) > 3
    want = [r["doc_id"] for r in sorted(draws, key=lambda r: (r["shard"], r["place"])) for _ in range(r["copies"])]
    got = [r["doc_id"] for r in mixing.mix_documents(docs, docs_per_block=4, words_per_shard=3000).collect()]
    assert got == want
    # rows that differ in their source alone are drawn each for itself
    twins = table(spark, [*rows, (*rows[9][:2], "other")])
    mixing.write_mix(twins, str(tmp_path / "mix"), words_per_shard=3000)
    assert spark.read.parquet(str(tmp_path / "mix")).count() == sum(r["times"] * r["copies"] for r in mixing.mixed(twins).collect())
    # what op7 calls taken are the draws of the shards
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    taken = lambda: {(r["doc_id"], r["taken"]) for r in queries.op7_mixing(spark, str(tmp_path)).collect()}
    assert taken() == {(r["doc_id"], r["size"] * r["times"]) for r in mixing.mixed(docs).collect()}
    deal = mixing.with_shards
    monkeypatch.setattr(mixing, "with_shards", lambda *a, **b: deal(*a, **b).where("turn = 1"))
    assert taken() == {(r["doc_id"], r["size"] * min(r["times"], 1)) for r in mixing.mixed(docs).collect()}


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.com/en/x?q#f", "https://www.example.com/en/", "ftp://x.net/es/a", "x.net/es/a", None, "", "a://b://c/d", "http://evilexample.com/en/",
            "http://net/fr/?/es/", "http://h?x/y", "http://h#/en/", "://h/p\nq?z", "HTTP://WWW.ÄÖ.ORG/É"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in CLASHING})
    outcomes = spark.createDataFrame([("http://x.net/", 1), (None, None)], "url string, good int")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, outcomes, queries.URL_RULES).collect()}

    def part(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        path = rest[cut:]
        stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:stop]

    for i, u in enumerate(urls):
        host, path = part(u)
        fits = [(len(h) + len(p), h + p, kind) for kind, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert got[i]["rule"] == (max(fits)[1] if fits else None)
        if fits:
            assert got[i]["verdict"] == max(fits)[2]
        assert got[i]["verdict"] in ("allow", "block")


def test_reputation_shrinks_to_the_level_above(spark):
    rows = [("good.a.com", 1)] * 40 + [("bad.a.com", 0)] * 40 + [("bad.a.com", 1)] * 2 + [("new.a.com", 0)] + [("x.b.org", 1)] * 30 + [("y.b.org", 1)] * 5 + [("y.b.org", None)]
    level = url_filter.host_reputation(spark.createDataFrame(rows, "host string, good int"))
    host = {r["host"]: r for r in level["host"].collect()}
    assert host["bad.a.com"]["mean"] < 0.2 < host["new.a.com"]["mean"] < host["good.a.com"]["mean"]
    assert all(r["bound"] < r["mean"] for r in host.values())
    assert host["y.b.org"]["bound"] < host["x.b.org"]["bound"]
    empty = url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "url string, good int"), queries.URL_RULES)
    assert empty.count() == 0


def vectors(spark, rows, clashing=True):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.withColumns({c: F.lit(1) for c in (*CLASHING, "label")}) if clashing else df


@pytest.mark.parametrize(("per_cell", "chunk"), [(4096, 4096), (20, 7), (60, 1000)])
def test_range_join_matches_brute_force(spark, monkeypatch, per_cell, chunk):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    data = [(i, (centres[i % 12] + rng.normal(scale=[0.02, 0.2, 0.5][i % 3], size=6)).tolist()) for i in range(240)]
    data += [(300 + i, [2.0 * x for x in data[5][1]]) for i in range(30)]
    odd = [(400, None), (401, [0.0] * 6), (402, [float("nan")] * 6), (403, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (404, []), (405, [float("inf")] + [0.0] * 5), (406, [1.0, 2.0]), (407, [1.0, 2.1]),
           (408, [1e300] * 6), (409, [1e-300] * 6)]
    x = np.array([v for _, v in data] + [[1.0] * 6] * 2)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [i for i, _ in data] + [408, 409]
    near = x @ x.T >= 0.9
    assert not (np.abs(x @ x.T - 0.9) < 1e-9).any()
    np.fill_diagonal(near, False)
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)] + [(406, 407)]
    count = Counter(a for a, _ in links if a != 406) | Counter({406: 1, 407: 1})
    least = least_of([*ids, 406, 407], links)
    got = embeddings.near_duplicate_vectors(vectors(spark, data + odd).repartition(5), per_cell=per_cell).collect()
    assert len(got) == len(data) + len(odd)
    for r in got:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == (count[i], least.get(i, i), least.get(i, i) == i)


def test_range_join_odd_tables(spark):
    assert embeddings.near_duplicate_vectors(vectors(spark, [])).count() == 0
    got = embeddings.near_duplicate_vectors(vectors(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (5, None)])).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (5, 0, 5, True)], key=str)


def test_queries_equal_their_sql(spark):
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.ORACLE.items():
        cursor = connection.execute(sql)
        columns = [c[0] for c in cursor.description]
        got = queries.QUERIES[name](spark, SF)
        assert sorted(got.columns) == sorted(columns), name
        assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, cursor.fetchall())), name


def test_every_query_covers_its_table(spark):
    for name in ("op2_lm_scoring", "op4_quality", "op5_sentencepiece", "op7_mixing"):
        got = queries.QUERIES[name](spark, SF)
        assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count(), name


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(spark.createDataFrame(stage(spark, kept[-1], SF).collect(), docs.schema))
        assert kept[-1].columns == columns
    rows = [[r.asDict() for r in d.collect()] for d in kept]
    assert len(rows[1]) >= 0.8 * len(rows[0])
    texts = [r["text"] for r in rows[2]]
    assert len(set(texts)) == len(texts) and set(texts) == {r["text"] for r in rows[1]}
    for t in set(texts):
        assert max(r["doc_id"] for r in rows[1] if r["text"] == t) in {r["doc_id"] for r in rows[2]}
    assert {r["doc_id"] for r in rows[3]} <= {r["doc_id"] for r in rows[2]}
    assert max(Counter(r["doc_id"] for r in rows[4]).values()) <= 2
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == len(rows[4])
    assert out.where("not round_trip").count() == 0
