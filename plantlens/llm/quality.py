"""Quality classifier: supervised subword embeddings.

Words, word pairs (a repeated word also as one such), and character n-grams (bytes within a word) are hashed into one table of learned vectors; a
document is their average; a softmax over the two classes is trained with it by stochastic gradient descent
in numpy.  Training uses a bounded sample of labelled rows (``SAMPLE`` documents, whole texts) inside one
task.  Scoring is linear in the average, so each vector is reduced once to its contribution and every text
is one gather and one sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import RollingHash, Words, byte_hash, keyed, mix_int, small_batches, text_groups

BUCKETS = 1 << 18
DIM = 12
NGRAMS = (3, 4)
SAMPLE = 6000
EPOCHS = 4
RATE = 0.5
BATCH = 32
ECHO = np.uint64(mix_int(35))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a group of texts in document order, and the number of each text's features."""
    words = Words(data, offsets)
    whole = words.hashes()
    kinds, docs = [whole], [words.doc]
    if len(whole) > 1:
        same = words.doc[1:] == words.doc[:-1]
        kinds.append(RollingHash(whole).windows(2)[same])
        docs.append(words.doc[1:][same])
        # a word that follows itself is one feature whatever the word, as rare words have no vector of their own
        echo = same & (whole[1:] == whole[:-1])
        kinds.append(np.full(int(echo.sum()), ECHO, np.uint64))
        docs.append(words.doc[1:][echo])
    inside = np.zeros(len(data), np.int32)
    lengths = words.end - words.start
    # bytes left in the word at each place, 0 on white space
    if len(lengths):
        ends = np.repeat(words.end, lengths)
        places = np.arange(len(ends)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(words.start, lengths)
        inside[places] = ends - places
    rolling = byte_hash(data)
    doc_of_byte = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for n in NGRAMS:
        grams = rolling.windows(n)
        fits = inside[: len(grams)] >= n
        kinds.append(grams[fits] + np.uint64(n))
        docs.append(doc_of_byte[: len(grams)][fits])
    buckets = (np.concatenate(kinds) >> np.uint64(46)).astype(np.int64) % BUCKETS
    of = np.concatenate(docs)
    order = np.argsort(of, kind="stable")
    return buckets[order], np.bincount(of, minlength=len(offsets) - 1)


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 11) -> tuple[np.ndarray, float]:
    """Contribution of each bucket to the log-odds of label 1, and the bias.

    ``texts`` has the distinct buckets and their counts for each document.
    """
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros(DIM, np.float32)  # softmax over two classes: only the difference of the class vectors matters
    bias, steps, total = 0.0, 0, max(1, EPOCHS * ((len(texts) + BATCH - 1) // BATCH))
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            pick = [i for i in order[at : at + BATCH] if len(texts[i][0])]
            if not pick:
                continue
            rate = RATE * (1 - steps / total)
            steps += 1
            ids = np.concatenate([texts[i][0] for i in pick])
            share = np.concatenate([texts[i][1] / texts[i][1].sum() for i in pick]).astype(np.float32)
            sizes = np.array([len(texts[i][0]) for i in pick])
            starts = np.cumsum(sizes) - sizes
            mean = np.add.reduceat(table[ids] * share[:, None], starts, axis=0)
            gap = labels[pick] - 1 / (1 + np.exp(-np.clip(mean @ out + bias, -30, 30)))
            gap = gap.astype(np.float32)
            step = np.repeat(gap, sizes) * share * rate
            moved = out.copy()
            out += rate * (gap @ mean)
            bias += 0.1 * rate * float(gap.mean())
            np.add.at(table, ids, step[:, None] * moved[None, :] * np.float32(DIM))
            if steps == 1:
                out += rng.normal(0, 0.1, DIM).astype(np.float32)
    return (table @ out).astype(np.float32), float(bias)


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels, keys = [], [], []
    for batch in batches:
        for part, data, offsets in text_groups(batch):
            buckets, sizes = features(data, offsets)
            at = np.cumsum(sizes) - sizes
            texts += [np.unique(buckets[a : a + n], return_counts=True) for a, n in zip(at, sizes, strict=True)]
            k1, k2, label = (batch.column(c).to_pylist()[part] for c in ("k1", "k2", "label"))
            keys += zip(k1, k2, strict=True)
            labels += label
    order = sorted(range(len(keys)), key=keys.__getitem__)
    weights, bias = train([texts[i] for i in order], np.array([labels[i] for i in order], np.float64)) if order else (np.zeros(BUCKETS, np.float32), 0.0)
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["weights", "bias"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Train on at most ``sample`` labelled documents, chosen by hash of the id.

    ``labels`` has ``<id>`` and ``label`` (0 or 1; null rows are ignored; of several labels the larger counts).
    Only the chosen ids are broadcast; the model (a table of fixed size) is all that reaches the driver.
    """
    chosen = (
        labels.where(F.col("label").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("k1")).agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64(F.lit(3), "k1"), "k1").limit(sample)
    )
    rows = keyed(docs, id_col, text_col).where("doc_id is not null").join(F.broadcast(chosen), "k1").select("k1", "k2", "text", F.col("label").cast("int"))
    row = rows.repartition(1).mapInArrow(_train_task, "weights binary, bias double").head()
    if row is None:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(bytes(row["weights"]), np.float32), float(row["bias"])


def _score_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            scores = []
            for _, data, offsets in text_groups(batch):
                buckets, sizes = features(data, offsets)
                sums = np.concatenate([[0.0], np.cumsum(weights[buckets], dtype=np.float64)])
                ends = np.cumsum(sizes)
                logit = bias + (sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1)
                scores.append(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
            score = np.concatenate(scores) if scores else np.zeros(0)
            columns = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(score, pa.float64())], names=[*columns, "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``k1, k2, doc_id, score`` for every row; score is the probability of label 1.

    A null or empty text, having no features, gets the bias alone.  Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keyed(docs, id_col, text_col).mapInArrow(_score_task(shared), "k1 long, k2 long, doc_id long, score double")


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with a score of ``least`` or more, with all their columns, in one pass without a shuffle."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    schema = wide.select("row", F.lit(0.0).alias("score")).schema
    return wide.mapInArrow(_score_task(shared), schema).where(F.col("score") >= least).select("row.*")
