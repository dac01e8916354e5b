"""Language model, classifier, SentencePiece and pipeline."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from plantlens.llm import maxent, quality, sentencepiece_fst
from plantlens.llm.queries import SENTENCEPIECE_MODEL, held_out

from .fixtures import LOWER, WORD, corpus, table

SF = "/root/testdata/sf0.001"


def test_held_out_rows(spark):
    got = spark.createDataFrame([(i,) for i in (*range(50), None)], "doc_id long").select("doc_id", held_out(7, 2).alias("x")).collect()
    assert all(r["x"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in got)


def tokens_of(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


@pytest.mark.parametrize("frequent", [1 << 18, 20])
def test_language_model_counts_and_gain(spark, monkeypatch, frequent):
    monkeypatch.setattr(maxent, "FREQUENT", frequent)
    rows = corpus(n=120) + [(7, corpus(n=120)[7][1], "s3"), (None, "one more", "s1")]
    learn = F.coalesce(F.col("doc_id") % 5 != 0, F.lit(True))
    got = maxent.score_texts(table(spark, rows, clashing=True).repartition(3), learn).collect()
    assert len(got) == len(rows)
    count = Counter(w for i, t, _ in rows if i is None or i % 5 for w in tokens_of(t))
    total, distinct = sum(count.values()), len(count)
    want = Counter()
    for i, t, _ in rows:
        w = tokens_of(t)
        want[i, len(w), sum(count[x] > 0 for x in w), total, round(sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in w), 6)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_language_model_is_a_distribution_and_beats_the_base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = maxent.score_texts(docs, ~held_out(7, 2)).withColumn("held", held_out(7, 2)).where("held").agg(F.sum("score"), F.sum("base_score")).head()
    assert got[0] > got[1]
    texts = maxent.keyed(docs)
    model = maxent.fit(texts, maxent.token_counts(texts), steps=1)
    v = model.vocabulary
    features = [np.array([1, 5, 9], np.uint16)] * maxent.KINDS
    classes = np.exp(maxent._log_softmax(model.weights, model.bias, features).astype(np.float64))
    assert np.allclose(classes.sum(axis=1), 1, atol=1e-5)
    inside = np.bincount(v.classes, weights=10 ** v.log_within(), minlength=maxent.CLASSES)
    assert (inside <= 1 + 1e-9).all()


def test_language_model_has_all_its_classes(spark):
    texts = maxent.keyed(spark.read.parquet(f"{SF}/documents.parquet"))
    vocabulary = maxent.vocabulary_of(maxent.token_counts(texts), texts)
    learned = np.setdiff1d(vocabulary.classes, [maxent.REST, maxent.END_CLASS, maxent.TAIL])
    assert (maxent.CLASSES, maxent.CLUSTERS) == (32, 29)
    assert 24 < len(learned) <= 29


def test_sums_of_many_tasks(spark):
    arrays = [np.arange(100, dtype=np.float32) * k for k in range(9)]
    parts = spark.createDataFrame([(bytearray(a.tobytes()),) for a in arrays], "sums binary").repartition(9)
    assert (maxent._summed(parts) == np.arange(100) * 36).all()
    assert maxent._summed(parts.where("false")) is None


def test_language_model_without_training_text(spark):
    got = maxent.score_texts(table(spark, [(1, "a b", "s"), (2, None, "s")]), F.lit(False)).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert maxent.score_texts(table(spark, []), F.lit(True)).count() == 0


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels.where(~held_out(5, 0)).select("doc_id", F.col("quality").alias("label")))
    held = quality.score(docs, model).join(labels.where(held_out(5, 0)), "doc_id").select("score", "quality").collect()
    good = [r["score"] for r in held if r["quality"] == 1]
    bad = [r["score"] for r in held if r["quality"] == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95
    assert np.mean([g >= 0.3 for g in good]) > 0.97
    again = quality.fit(docs.repartition(7), labels.where(~held_out(5, 0)).select("doc_id", F.col("quality").alias("label")))
    assert np.array_equal(again[0], model[0]) and again[1] == model[1]


def test_classifier_odd_inputs(spark):
    rows = corpus() + [(None, "one", "s0")]
    docs = table(spark, rows, clashing=True)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (999, 0), (4, 0)], "doc_id long, label int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[60] == by[61] == 1 / (1 + math.exp(-model[1]))
    kept = quality.keep_good(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    empty = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, empty).collect()} == {0.5}
    assert quality.score(table(spark, []), model).count() == 0


def test_pieces_equal_the_library(spark):
    rows = corpus() + [(200 + i, "a" + " " * i + "b\n" + "  x" * i, "s") for i in range(20)] + [(300, "▁ meta ▁▁ symbol", "s")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("en").alias("lang"), "source", "n_chars")
    docs = docs.withColumn("doc_id", F.col("doc_id") + 1000).unionByName(table(spark, rows)).repartition(4)
    model = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = sentencepiece_fst.encode_documents(docs, sentencepiece_fst.read_model(SENTENCEPIECE_MODEL)).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == model.encode(text)
        assert r["n_tokens"] == len(r["ids"]) and r["round_trip"]
        assert r["decoded_sha256"] == hashlib.sha256(text.replace("▁", " ").encode()).hexdigest()


def test_unigram_weights_take_the_shortest_path():
    """A unigram model made by hand: the best sum of scores, checked against all segmentations."""

    def field(number, kind, payload):
        return bytes([number << 3 | kind]) + payload

    def piece(text, score, type_=1):
        body = field(1, 2, bytes([len(text.encode())]) + text.encode()) + field(2, 5, np.float32(score).tobytes()) + field(3, 0, bytes([type_]))
        return field(1, 2, bytes([len(body)]) + body)

    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.5, "▁a": -4.2, "ba": -2.2, "aba": -6.0}
    normaliser = field(3, 0, b"\1") + field(4, 0, b"\0") + field(5, 0, b"\1")
    raw = piece("<unk>", 0, 2) + b"".join(piece(t, s) for t, s in scores.items()) + field(2, 2, bytes([2]) + field(3, 0, b"\1")) + field(3, 2, bytes([len(normaliser)]) + normaliser)
    transducer = sentencepiece_fst.Transducer(raw)
    names = ["<unk>", *scores]

    def best(text):
        table_ = [(0.0, [])] + [(-1e9, [])] * len(text)
        for j in range(1, len(text) + 1):
            table_[j] = max((table_[i][0] + scores[text[i:j]], [*table_[i][1], text[i:j]]) for i in range(j) if text[i:j] in scores)
        return table_[-1][0]

    for text in ("abab", "baab ab", "a", "b a b a", "aaaabbbbabab"):
        data = np.frombuffer(text.encode(), np.uint8)
        ids, _ = transducer.encode(data, np.array([0, len(data)]))
        assert math.isclose(sum(scores[names[i]] for i in ids), best("▁" + text.replace(" ", "▁")), abs_tol=1e-4)


def test_encoding_odd_tables(spark):
    model = sentencepiece_fst.read_model(SENTENCEPIECE_MODEL)
    assert sentencepiece_fst.encode_documents(table(spark, []), model).count() == 0
    got = sentencepiece_fst.encode_documents(table(spark, [(None, None, None), (1, "", "s"), (1, "", "s")], clashing=True), model).collect()
    assert [(r["n_tokens"], r["ids"], r["round_trip"]) for r in got] == [(0, [], True)] * 3


def test_model_sums_come_from_no_more_tasks_than_cores(spark):
    from plantlens.llm import maxent

    texts = spark.createDataFrame([("un mot",)] * 300, "text string").repartition(100)
    gathered = maxent._gathered(texts)
    assert gathered.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and gathered.count() == 300
