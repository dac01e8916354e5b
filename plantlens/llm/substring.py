"""Substring dedup over words by de Bruijn compaction.

Nodes are sampled k-mers of words and edges the word stretches around them (see ``sampling``).  An edge with
several copies is a repeated path whatever follows; consecutive ones of a document compact into one span of
source coordinates.  Where a node branches, that is at the ends of a repeat or around an edit, the windows of its
edges are verified one by one: each distinct edge sends its windows once, and those that meet their like in
another place are removed from every edge that holds them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import RollingHash, Words, anchors, covered, keyed, signed, stored, text_groups
from plantlens.llm.sampling import EDGE_SCHEMA, repeated_occurrences

WINDOW = 35
GRAM = 8


def _edges_task(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            for part, data, offsets in text_groups(batch):
                words = Words(data, offsets)
                if not len(words.start):
                    continue
                doc, rolling = words.doc, RollingHash(words.hashes())
                n = len(doc)
                ok = np.zeros(n, bool)
                if n >= window:
                    ok[: n - window + 1] = doc[: n - window + 1] == doc[window - 1 :]
                place, first, last = anchors(rolling.windows(gram), ok, window - gram + 1)
                edge = rolling.slices(first, last + window) ^ (place - first).astype(np.uint64)
                node = rolling.slices(place, place + gram)
                of = doc[first]
                base = words.bounds[of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(node)), pa.array(signed(edge)), pa.array(k1[part][of]), pa.array(k2[part][of]),
                     pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32)), pa.array((place - base).astype(np.int32))],
                    names=["node", "edge", "k1", "k2", "first", "last", "place"],
                )

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they travel between tasks twice."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [pack.compress(t.as_buffer()) for t in batch.column("text")]
        columns = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(packed, pa.binary())], names=[*columns, "packed"])


def packed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``k1, k2, doc_id, packed``: every row, with its text as zstd."""
    rows = keyed(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    return rows.mapInArrow(_packed, "k1 long, k2 long, doc_id long, packed binary")


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    unpack = zstandard.ZstdDecompressor()
    for i, value in enumerate(batch.column("packed")):
        yield i, np.frombuffer(unpack.decompress(value.as_buffer()), np.uint8)


def text_runs(batch: pa.RecordBatch, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``most`` bytes of unpacked text: first row, row after, bytes, offsets."""
    held, size, first = [], 0, 0
    for i, data in unpacked(batch):
        held.append(data)
        size += len(data)
        if size >= most:
            yield first, i + 1, np.concatenate(held), np.concatenate([[0], np.cumsum([len(x) for x in held])])
            held, size, first = [], 0, i + 1
    if held:
        yield first, first + len(held), np.concatenate(held), np.concatenate([[0], np.cumsum([len(x) for x in held])])


def _list_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.Array]:
    """Row offsets and the flat values of a list column (null lists are empty)."""
    column = batch.column(name)
    lengths = np.nan_to_num(pyarrow.compute.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.concatenate([[0], np.cumsum(lengths)]), column.flatten()


def _windows_task(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, spans = _list_column(batch, "spans")
            first, last, seen = (spans.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last", "sure"))
            k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            for a, b, data, offsets in text_runs(batch):
                words = Words(data, offsets)
                grams = RollingHash(words.hashes()).windows(window)
                own = slice(at[a], at[b])
                of = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
                f, n = first[own].astype(np.int64), (last[own] - first[own] + 1).astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + f[row]
                hashes = grams[words.bounds[of[row]] + place] if len(row) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(hashes)), pa.array(k1[a:b][of[row]]), pa.array(k2[a:b][of[row]]), pa.array(place.astype(np.int32)),
                     pa.array(seen[own][row].astype(bool))],
                    names=["gram", "k1", "k2", "place", "sure"],
                )

    return run


def _cut_task(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, spans = _list_column(batch, "spans")
            first, last = (spans.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last"))
            out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": [], "spans": []}
            for a, b, data, offsets in text_runs(batch):
                words = Words(data, offsets)
                own = slice(at[a], at[b])
                base = words.bounds[np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))]
                gone = covered(len(words.start), base + first[own], base + last[own] + window)
                raw = data.tobytes()
                for i in range(b - a):
                    lo, hi = int(words.bounds[i]), int(words.bounds[i + 1])
                    mask = gone[lo:hi]
                    stay = np.flatnonzero(~mask) + lo
                    kept = b" ".join([raw[s:e] for s, e in zip(words.start[stay].tolist(), words.end[stay].tolist(), strict=True)])
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                    out["n_words"].append(hi - lo)
                    out["n_removed"].append(int(mask.sum()))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    out["kept"].append(kept.decode("utf-8", "replace"))
                    out["spans"].append([{"first": int(x), "last": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string()),
                 pa.array(out["kept"], pa.string()), pa.array(out["spans"], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"],
            )

    return run


def repeated_spans(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``k1, k2, first, last``: ranges of starts of windows that occur elsewhere too (in word positions)."""
    edges = keyed(docs, id_col, text_col).select("k1", "k2", "text").mapInArrow(_edges_task(window, gram), EDGE_SCHEMA)
    known = repeated_occurrences(edges, "substring")
    known = stored(known, "substring-edges")
    sure = known.where("copies > 1").select("k1", "k2", "first", "last")
    # each distinct edge of a branching node sends its windows once; of an edge with copies the first one does
    here = (F.col("least")["k1"] == F.col("k1")) & (F.col("least")["k2"] == F.col("k2")) & (F.col("least")["first"] == F.col("first"))
    asked = known.where((F.col("branches") > 1) & ((F.col("copies") == 1) | here)).select(
        "k1", "k2", F.struct("first", "last", (F.col("copies") > 1).alias("sure")).alias("span"))
    asked = asked.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))
    sent = packed.join(asked, ["k1", "k2"]).mapInArrow(_windows_task(window), "gram long, k1 long, k2 long, place int, sure boolean")
    sent = stored(sent, "substring-windows")
    grams = sent.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    verified = sent.where(~F.col("sure")).join(grams, "gram", "left_semi").select("k1", "k2", F.col("place").alias("first"), F.col("place").alias("last"))
    return sure.unionByName(verified)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256, kept, spans``.

    A word goes if a window of ``window`` words that covers it also starts anywhere else, in another document
    or further on in the same one; windows are judged on the input.  ``kept`` has the other words joined by one
    space, ``spans`` the removed word ranges [first, last).  Null texts count as empty.  Texts shorter than
    a window stay whole.  A row that repeats another's id and text is a copy like any other: both lose what
    they share.  Empty tables give an empty result; other columns are never read.
    """
    packed = packed_texts(docs, id_col, text_col)
    spans = repeated_spans(docs, packed, id_col, text_col, window, gram)
    spans = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    joined = packed.join(spans, ["k1", "k2"], "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<first: long, last: long>>"
    return joined.mapInArrow(_cut_task(window), schema)
