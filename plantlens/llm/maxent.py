"""Hashed maximum-entropy language model with a class-factored softmax.

A token's probability is P(class | context) * P(token | class).  The classes of the ``CLUSTERED`` most frequent words
come from k-means over the counts of their frequent neighbours; other frequent words, all rarer words, and the end of a
text are classes of their own.  Within a class, tokens have add-one probabilities.  P(class | context) is a
softmax over hashed features: the word before, the pair of words before, and the word two back (a skip).

Counts cover all training texts.  Weights are trained by gradient updates: the training texts are cut into ``STEPS`` parts
by hash; in each step every task adds up observed and expected feature counts of its texts of that part, the
sums are combined slice by slice, and the weights move along the difference, scaled by the counts.  Model
and sums have a fixed size.

Scoring is sparse numpy in batches.  Counts of the ``FREQUENT`` most frequent words travel with the model; other words
are joined with the table of all counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import Words, keyed, lower_ascii, mix, mix_int, signed, stored, text_groups

CLASSES = 32
REST, END_CLASS, TAIL = 29, 30, 31
CLUSTERS = 29
FREQUENT = 1 << 18
CLUSTERED = 1 << 16
NEIGHBOURS = 15
BUCKET_BITS = 14
KINDS = 3
STEPS = 4
RATE = 0.6
PRIOR = 8.0
SLICES = 32
END = np.uint64(mix_int(77))
BEGIN = np.uint64(mix_int(78))
_SALTS = [np.uint64(mix_int(90 + i)) for i in range(KINDS)]
# Tokens whose class scores are held at a time.
ROWS = 1 << 14


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a group of texts, an end after each text, and the bounds of the texts."""
    words = Words(lower_ascii(data), offsets)
    docs = len(offsets) - 1
    tokens = np.full(len(words.start) + docs, END, np.uint64)
    tokens[np.arange(len(words.start)) + words.doc] = words.hashes()
    return tokens, words.bounds + np.arange(docs + 1)


def contexts(tokens: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Hashed features of each token's context."""
    one = np.concatenate([[BEGIN], tokens[:-1]]) if len(tokens) else tokens
    one[bounds[:-1][bounds[:-1] < len(tokens)]] = BEGIN
    two = np.concatenate([[BEGIN], one[:-1]]) if len(tokens) else tokens
    two[bounds[:-1][bounds[:-1] < len(tokens)]] = BEGIN
    shift = np.uint64(64 - BUCKET_BITS)
    kinds = (one, mix(one) + two, two)
    return [(mix(k ^ salt) >> shift).astype(np.uint16) for k, salt in zip(kinds, _SALTS, strict=True)]


@dataclass
class Vocabulary:
    """The most frequent training tokens by hash, with counts and classes; totals of all training tokens."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    total: int
    distinct: int
    starts: np.ndarray | None = None
    shift: np.uint64 = np.uint64(0)

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """Place of each token, or -1; the upper bits of a hash tell where to look first."""
        out = np.full(len(tokens), -1)
        if not len(self.hashes):
            return out
        if self.starts is None:
            self.shift = np.uint64(max(1, 64 - len(self.hashes).bit_length()))
            self.starts = np.searchsorted(self.hashes >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64))
        cell = (tokens >> self.shift).astype(np.int64)
        at, stop = self.starts[cell], self.starts[cell + 1]
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            here = at[open_]
            found = self.hashes[here] == tokens[open_]
            out[open_[found]] = here[found]
            at[open_] += 1
            open_ = open_[~found & (at[open_] < stop[open_])]
        return out

    def class_of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.find(tokens)
        if not len(self.hashes):
            return at, np.where(tokens == END, END_CLASS, REST)
        return at, np.where(at >= 0, self.classes[np.maximum(at, 0)], np.where(tokens == END, END_CLASS, REST))

    def class_totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and distinct tokens of each class; what is not frequent is the rest."""
        tokens = np.bincount(self.classes, weights=self.counts, minlength=CLASSES).astype(np.int64)
        distinct = np.bincount(self.classes, minlength=CLASSES)
        tokens[REST] += self.total - int(self.counts.sum())
        distinct[REST] += self.distinct - len(self.hashes)
        return tokens, distinct

    def log_within(self) -> np.ndarray:
        """log10 P(token | class) of the frequent tokens."""
        tokens, distinct = self.class_totals()
        return np.log10((self.counts + 1.0) / (tokens + distinct)[self.classes]) if len(self.counts) else np.zeros(0)


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def packed() -> pa.RecordBatch:
        hashes = np.concatenate([h for h, _ in held])
        values, inverse = np.unique(hashes, return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([c for _, c in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(counts)], names=["h", "c"])

    for batch in batches:
        for _, data, offsets in text_groups(batch):
            held.append(np.unique(token_stream(data, offsets)[0], return_counts=True))
            size += len(held[-1][0])
            if size > 1 << 20:
                yield packed()
                held, size = [], 0
    if held:
        yield packed()


def token_counts(texts: DataFrame) -> DataFrame:
    """``h, c``: every distinct token of the texts by hash, with its count (combined in tasks, then by hash)."""
    parts = texts.select("text").mapInArrow(_count_task, "h long, c long")
    return stored(parts.groupBy("h").agg(F.sum("c").alias("c")), "lm-counts")


def _profile_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, rank = shared.value
        out = np.zeros((CLUSTERED, 2 * (NEIGHBOURS + 1)), np.float32)
        for batch in batches:
            for _, data, offsets in text_groups(batch):
                tokens, _ = token_stream(data, offsets)
                if len(tokens) < 2 or not len(rank):
                    continue
                at = vocabulary.find(tokens)
                place = np.where(at >= 0, rank[np.maximum(at, 0)], CLUSTERED)
                near = np.minimum(place, NEIGHBOURS)
                for own, other, base in ((place[1:], near[:-1], 0), (place[:-1], near[1:], NEIGHBOURS + 1)):
                    known = own < CLUSTERED
                    cell = own[known] * out.shape[1] + base + other[known]
                    values, counts = np.unique(cell, return_counts=True)
                    out.reshape(-1)[values] += counts
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    return run


def _summed(parts: DataFrame) -> np.ndarray | None:
    """Sum of fixed-size float arrays, one per task, added up in slices by tasks; the driver gets one array."""
    cut = parts.rdd.flatMap(lambda r: enumerate(np.array_split(np.frombuffer(bytes(r["sums"]), np.float32), SLICES)))
    sums = sorted(cut.reduceByKey(lambda a, b: a + b, SLICES).collect(), key=lambda x: x[0])
    return np.concatenate([x for _, x in sums]) if sums else None


def _gathered(texts: DataFrame) -> DataFrame:
    """Texts in no more partitions than there are cores, without a shuffle: every task sends sums of a fixed size, however few its texts are."""
    return texts.coalesce(texts.sparkSession.sparkContext.defaultParallelism)


def _clusters(profile: np.ndarray, seed: int = 13) -> np.ndarray:
    """k-means classes of words by direction of their (square-rooted) neighbour counts."""
    points = np.sqrt(profile)
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    weight = profile.sum(axis=1) + 1e-3
    rng = np.random.default_rng(seed)
    centres = points[np.sort(rng.choice(len(points), min(CLUSTERS, len(points)), replace=False, p=weight / weight.sum()))]
    label = np.zeros(len(points), np.int64)
    for _ in range(10):
        label = (points @ centres.T).argmax(axis=1)
        for k in range(len(centres)):
            mine = label == k
            if mine.any():
                centre = (points[mine] * weight[mine, None]).sum(axis=0)
                centres[k] = centre / max(np.linalg.norm(centre), 1e-9)
    return label


def vocabulary_of(counts: DataFrame, texts: DataFrame) -> Vocabulary:
    """The most frequent tokens, at most ``FREQUENT``, with classes; this bounded list is all that reaches the driver.

    They are those above a threshold, taken from a histogram of counts on a log scale (a thousand cells at most).
    """
    spark = counts.sparkSession
    cell = F.floor(F.log2("c") * 16).cast("int")
    cells = counts.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).orderBy(F.desc("cell")).collect()
    total, distinct = sum(r["c"] for r in cells), sum(r["n"] for r in cells)
    least, held = 1 << 20, 0
    for r in cells:
        held += r["n"]
        if held >= FREQUENT:
            break
        least = r["cell"]
    top = counts.where((cell >= least) | (F.col("h") == signed(np.array([END]))[0].item())).toPandas()
    hashes, count = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    rank = np.empty(len(hashes), np.int64)
    rank[np.lexsort((hashes, -count))] = np.arange(len(hashes))
    order = np.argsort(hashes)
    vocabulary = Vocabulary(hashes[order], count[order], np.full(len(order), TAIL), int(total), int(distinct))
    rank = np.minimum(rank[order], CLUSTERED)
    if len(order):
        shared = spark.sparkContext.broadcast((vocabulary, rank))
        profile = _summed(_gathered(texts.select("text")).mapInArrow(_profile_task(shared), "sums binary"))
        clustered = np.flatnonzero(rank < CLUSTERED)
        if profile is not None and len(clustered):
            label = _clusters(profile.reshape(CLUSTERED, -1)[: len(clustered)])
            vocabulary.classes[clustered] = label[rank[clustered]]
        vocabulary.classes[vocabulary.hashes == END] = END_CLASS
    return vocabulary


def _log_softmax(weights: np.ndarray, bias: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    scores = weights[0][features[0]]
    for kind in range(1, KINDS):
        scores += weights[kind][features[kind]]
    scores += bias
    scores -= scores.max(axis=1, keepdims=True)
    scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
    return scores


def _gradient_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights, bias = shared.value
        buckets = 1 << BUCKET_BITS
        seen = np.zeros((KINDS, buckets * CLASSES), np.float32)
        expected = np.zeros((KINDS, buckets, CLASSES), np.float32)
        for batch in batches:
            for _, data, offsets in text_groups(batch):
                tokens, bounds = token_stream(data, offsets)
                features = contexts(tokens, bounds)
                label = vocabulary.class_of(tokens)[1]
                for at in range(0, len(tokens), ROWS):
                    some = [f[at : at + ROWS] for f in features]
                    chance = np.exp(_log_softmax(weights, bias, some))
                    for kind, f in enumerate(some):
                        order = np.argsort(f, kind="stable")
                        cut = np.flatnonzero(np.diff(f[order].astype(np.int32), prepend=-1))
                        expected[kind][f[order][cut]] += np.add.reduceat(chance[order], cut, axis=0)
                for kind, f in enumerate(features):
                    cells, counts = np.unique(f.astype(np.int64) * CLASSES + label, return_counts=True)
                    seen[kind][cells] += counts
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([seen.ravel(), expected.ravel()]).tobytes()], pa.binary())], names=["sums"])

    return run


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray
    bias: np.ndarray


def fit(texts: DataFrame, counts: DataFrame, steps: int = STEPS) -> Model:
    """Train on ``texts`` (``k1, k2, text``); ``counts`` are those of the same texts."""
    spark = texts.sparkSession
    vocabulary = vocabulary_of(counts, texts)
    prior = vocabulary.class_totals()[0] + 1.0
    bias = np.log(prior / prior.sum()).astype(np.float32)
    weights = np.zeros((KINDS, 1 << BUCKET_BITS, CLASSES), np.float32)
    for step in range(steps):
        part = texts.where(F.pmod(F.xxhash64(F.lit(17), "k1", "k2"), F.lit(steps)) == step).select("text")
        shared = spark.sparkContext.broadcast((vocabulary, weights, bias))
        sums = _summed(_gathered(part).mapInArrow(_gradient_task(shared), "sums binary"))
        if sums is None:
            continue
        seen, expected = sums.reshape(2, *weights.shape)
        weights = weights + np.clip(RATE * (seen - expected) / (np.maximum(seen, expected) * 0.5 + PRIOR), -2, 2).astype(np.float32)
    return Model(vocabulary, weights, bias)


def _score_task(shared):
    names = ["k1", "k2", "doc_id", "h", "times", "n_tokens", "n_known", "base", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        vocabulary = model.vocabulary
        log_within = vocabulary.log_within()
        log_base = np.log10((vocabulary.counts + 1.0) / (vocabulary.total + vocabulary.distinct + 1.0))
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            for part, data, offsets in text_groups(batch):
                tokens, bounds = token_stream(data, offsets)
                features = contexts(tokens, bounds)
                at, label = vocabulary.class_of(tokens)
                score = np.empty(len(tokens))
                for i in range(0, len(tokens), ROWS):
                    logs = _log_softmax(model.weights, model.bias, [f[i : i + ROWS] for f in features])
                    score[i : i + ROWS] = logs[np.arange(len(logs)), label[i : i + ROWS]] / np.log(10)
                known = at >= 0
                base = np.zeros(len(tokens))
                if len(log_within):
                    base[known] = log_base[at[known]]
                    score[known] += log_within[at[known]]
                n, docs = np.diff(bounds), len(bounds) - 1
                sums = [np.add.reduceat(x, bounds[:-1]) for x in (known.astype(np.int64), base, score)]
                none = pa.nulls(docs, pa.int64())
                doc_id = batch.column("doc_id")[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[part]), pa.array(k2[part]), doc_id, none, none, pa.array(n), *map(pa.array, sums)], names=names)
                # distinct other words of each text, to be joined with their counts
                other = np.flatnonzero(~known)
                doc = np.searchsorted(bounds, other, "right") - 1
                order = np.lexsort((tokens[other], doc))
                doc, value = doc[order], tokens[other][order]
                cut = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | np.concatenate([[True], value[1:] != value[:-1]])[: len(value)])
                times = np.diff(np.append(cut, len(doc)))
                gap, zero = pa.nulls(len(cut), pa.int64()), pa.nulls(len(cut), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[part][doc[cut]]), pa.array(k2[part][doc[cut]]), gap, pa.array(signed(value[cut])), pa.array(times), gap, gap, zero, zero],
                    names=names)

    return run


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, k1, k2, n_tokens, n_known, train_tokens, base_score, score``.

    ``learn`` is a condition over ``doc_id`` of the rows to learn from.  Null texts count as empty and have one token,
    the end.  Without any training text all tokens are unknown and the base is uniform over one token.
    Repeated rows get a row each.  Empty tables give an empty result; other columns are never read.
    """
    rows = keyed(docs, id_col, text_col)
    training = rows.where(learn)
    counts = token_counts(training)
    model = fit(training, counts)
    vocabulary = model.vocabulary
    tokens, distinct = vocabulary.class_totals()
    base_of = float(vocabulary.total + vocabulary.distinct + 1)
    rest_of = float(tokens[REST] + distinct[REST] + 1)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "k1 long, k2 long, doc_id long, h long, times long, n_tokens long, n_known long, base double, score double"
    parts = stored(rows.mapInArrow(_score_task(shared), schema), "lm-parts")
    words = parts.where("h is not null").select("k1", "k2", "h", "times")
    c = F.coalesce(F.col("c"), F.lit(0))
    found = words.join(counts, "h", "left").groupBy("k1", "k2").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10((c + 1) / base_of)).alias("more_base"),
        F.sum(F.col("times") * F.log10((c + 1) / rest_of)).alias("more_score"), F.sum("times").alias("more_tokens"),
    )
    # repeated rows have sent their other words once each
    copies = parts.where("h is null").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.first("doc_id").alias("doc_id"), *[
        F.first(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")])
    share = lambda x: F.coalesce(F.col(x) / F.col("copies"), F.lit(0.0))
    each = copies.join(found, ["k1", "k2"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select(
        "doc_id", "k1", "k2", "n_tokens", (F.col("n_known") + share("more_known").cast("long")).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("base") + share("more_base")).alias("base_score"),
        (F.col("score") + share("more_score")).alias("score"),
    )
