"""Byte-level dedup with a run-length suffix index.

Only stretches of bytes around repeated sampled k-mers (``sampling``) can hold a repeated window, and of equal
stretches one stands for all.  Stretches that differ somewhere are indexed in blocks of bounded size: a
run-length Burrows-Wheeler transform with the text position sampled at both ends of every run.  All
stretches of a block stream over it right to left, all at once; each step follows the LF mapping, or jumps to the
nearer run end of the wanted byte and shortens its match by the common prefix of the two sampled places.
Rows whose suffixes share ``window`` bytes form a class; in each class the earliest window stays.

A node with more than ``MOST_BRANCHES`` different stretches (a line that a large share of all documents holds) does
not go to one block: its windows are compared by hash, combined map-side, first in pieces of ``SLOT`` windows and
then, where pieces differ, one by one.  In both cases only windows are compared whose common core occurs twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import anchors, byte_hash, covered, keyed, mix, signed, stored, text_groups
from plantlens.llm.sampling import EDGE_SCHEMA, repeated_occurrences
from plantlens.llm.substring import _list_column, packed_texts, text_runs

WINDOW = 100
GRAM = 24
MOST_BRANCHES = 256
# Bytes of stretches that one index holds; whole nodes only, so a block has at most this and one node more.
BLOCK_BYTES = 1 << 20


class RunLengthIndex:
    """Run-length BWT of several texts, each ended by a separator of its own, with positions at run ends."""

    def __init__(self, texts: list[np.ndarray]) -> None:
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(sizes + 1) - (sizes + 1)
        n, count = int((sizes + 1).sum()), len(texts)
        symbols = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.starts + sizes] = False
        if inside.any():
            symbols[inside] = np.concatenate(texts).astype(np.int64) + 1
        owner = np.repeat(np.arange(count), sizes + 1)
        left = np.repeat(self.starts + sizes, sizes + 1) - np.arange(n)  # bytes up to the separator
        order, rank = self._sorted(symbols, owner, left, count)
        before = np.where(order > 0, symbols[order - 1], 0)
        head = np.flatnonzero(np.diff(before, prepend=-1))
        self.run_start, self.run_symbol = head, before[head]
        run_size = np.diff(np.append(head, n))
        self.run_first, self.run_last = order[head], order[head + run_size - 1]  # sampled positions
        by_symbol = np.argsort(self.run_symbol, kind="stable")
        sorted_size = run_size[by_symbol]
        seen = np.cumsum(sorted_size) - sorted_size
        first_of = np.searchsorted(self.run_symbol[by_symbol], self.run_symbol[by_symbol])
        self.run_before = np.empty(len(head), np.int64)
        self.run_before[by_symbol] = seen - seen[first_of]
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=257))])
        self.by_symbol, self.keys = by_symbol, self.run_symbol[by_symbol] * len(head) + by_symbol
        self.symbols, self.left, self.order, self.n = symbols, left, order, n
        self.hash = byte_hash((symbols & 255).astype(np.uint8))

    @staticmethod
    def _sorted(symbols: np.ndarray, owner: np.ndarray, left: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order by doubling; a suffix ends at its separator, and separators are ordered by text."""
        n, width = len(symbols), 7
        padded = np.append(symbols, np.zeros(width, np.int64))
        key = np.zeros(n, np.int64)
        for j in range(width):
            key = key * 257 + np.where(left > j, padded[j : j + n], 0)
        while True:
            order = np.argsort(key, kind="stable")
            step = np.diff(key[order], prepend=-1) != 0
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(step) - 1
            if rank[order[-1]] == n - 1:
                return order, rank
            reach = np.minimum(np.arange(n) + width, n - 1)
            second = np.where(left >= width, rank[reach] + count, owner)
            key = rank * (n + count + 1) + second
            width *= 2

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes at text positions a and b, at most ``most``, by bisection over hashes."""
        high = np.minimum(most, np.minimum(self.left[a], self.left[b]))
        low = np.zeros_like(high)
        for _ in range(int(high.max(initial=0)).bit_length()):
            middle = (low + high + 1) // 2
            same = self.hash.slices(a, a + middle) == self.hash.slices(b, b + middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def _to(self, run: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.less[self.run_symbol[run]] + self.run_before[run] + row - self.run_start[run]

    def step(self, row: np.ndarray, place: np.ndarray, length: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of one more symbol to the left, for many patterns at once."""
        run = np.searchsorted(self.run_start, row, "right") - 1
        follows = self.run_symbol[run] == symbol
        new_row, new_place, new_length = self._to(run, row), place - 1, length + 1
        jump = np.flatnonzero(~follows)
        if len(jump):
            c, at, have = symbol[jump], place[jump], length[jump]
            up = np.searchsorted(self.keys, c * len(self.run_start) + run[jump]) - 1
            down = up + 1
            runs = len(self.keys)
            has_up = (up >= 0) & (self.run_symbol[self.by_symbol[np.maximum(up, 0)]] == c)
            has_down = (down < runs) & (self.run_symbol[self.by_symbol[np.minimum(down, runs - 1)]] == c)
            r_up, r_down = self.by_symbol[np.maximum(up, 0)], self.by_symbol[np.minimum(down, runs - 1)]
            q_up, q_down = self.run_last[r_up], self.run_first[r_down]
            n_up = np.where(has_up, self.common(at, q_up, have), -1)
            n_down = np.where(has_down, self.common(at, q_down, have), -1)
            take_up = n_up >= n_down
            r = np.where(take_up, r_up, r_down)
            last_row = np.append(self.run_start[1:], self.n)[r] - 1
            found = has_up | has_down
            landed = self._to(r, np.where(take_up, last_row, self.run_start[r]))
            new_row[jump] = np.where(found, landed, 0)
            new_place[jump] = np.where(found, np.where(take_up, q_up, q_down) - 1, self.order[0])
            new_length[jump] = np.where(found, np.maximum(n_up, n_down) + 1, 0)
        return new_row, new_place, new_length

    def classes(self, window: int) -> np.ndarray:
        """First rows of the classes of rows whose suffixes share ``window`` bytes."""
        whole = self.left[self.order] >= window
        at = np.where(whole, self.order, 0)
        hashes = self.hash.slices(at, np.minimum(at + window, self.n))
        same = whole[1:] & whole[:-1] & (hashes[1:] == hashes[:-1])
        return np.flatnonzero(np.concatenate([[True], ~same]))


def earlier_windows(texts: list[np.ndarray], document: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of texts whose bytes occur in an earlier place among them: (text, offset) and match length there.

    ``document`` orders the texts, ``start`` is the place of a text in its document.
    """
    index = RunLengthIndex(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = index.starts + sizes
    row, place, length = np.zeros(len(texts), np.int64), np.full(len(texts), index.order[0]), np.zeros(len(texts), np.int64)
    class_rows = index.classes(window)
    of_text, of_offset, of_class, of_length = [], [], [], []
    for back in range(1, int(sizes.max(initial=0)) + 1):
        live = np.flatnonzero(sizes >= back)
        row[live], place[live], length[live] = index.step(row[live], place[live], length[live], index.symbols[ends[live] - back])
        long = live[length[live] >= window]
        of_text.append(long)
        of_offset.append(sizes[long] - back)
        of_class.append(np.searchsorted(class_rows, row[long], "right") - 1)
        of_length.append(length[long])
    if not of_text:
        none = np.zeros(0, np.int64)
        return none, none, none
    text, offset, group, lengths = (np.concatenate(x) for x in (of_text, of_offset, of_class, of_length))
    place_in_order = (document[text] << 32) + start[text] + offset
    earliest = np.full(len(class_rows), np.iinfo(np.int64).max)
    np.minimum.at(earliest, group, place_in_order)
    later = place_in_order != earliest[group]
    return text[later], offset[later], lengths[later]


def _edges_task(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            for part, data, offsets in text_groups(batch):
                n = len(data)
                if n < window:
                    continue
                rolling = byte_hash(data)
                ok = np.zeros(n, bool)
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    ok[a : max(a, b - window + 1)] = True
                place, first, last = anchors(rolling.windows(gram), ok, window - gram + 1)
                edge = rolling.slices(first, last + window) ^ (place - first).astype(np.uint64)
                node = rolling.slices(place, place + gram)
                of = np.searchsorted(offsets, first, "right") - 1
                base = offsets[of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(node)), pa.array(signed(edge)), pa.array(k1[part][of]), pa.array(k2[part][of]),
                     pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32)), pa.array((place - base).astype(np.int32))],
                    names=["node", "edge", "k1", "k2", "first", "last", "place"],
                )

    return run


_STRETCHES = "node long, k1 long, k2 long, first int, place int, bytes binary, core long, piece long, grams array<long>"
# Window starts are dealt into slots of so many, counted from the place of the node.  All windows of a slot hold its core,
# so a slot whose core is unlike that of every other stretch of the node holds no repeated window.
SLOT = 8


def _slots(first: np.ndarray, last: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of stretches of windows first..last: the stretch of each, and the first window of the whole slot, and of the next."""
    low, high = (first - place) // SLOT, (last - place) // SLOT
    count = high - low + 1
    row = np.repeat(np.arange(len(first)), count)
    slot = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, place[row] + SLOT * slot, place[row] + SLOT * slot + SLOT


def _stretches_task(window: int):
    """Stretches asked for: their bytes, or for hot nodes their slots, with hashes of core, piece and each window."""
    names = ["node", "k1", "k2", "first", "place", "bytes", "core", "piece", "grams"]
    hashes = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, spans = _list_column(batch, "spans")
            node, first, last, place, hot = (spans.field(c).to_numpy(zero_copy_only=False) for c in ("node", "first", "last", "place", "hot"))
            first, last, place, hot = first.astype(np.int64), last.astype(np.int64), place.astype(np.int64), hot.astype(bool)
            k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2"))
            for a, b, data, offsets in text_runs(batch):
                own = np.arange(at[a], at[b])
                of = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
                raw = data.tobytes()
                calm = ~hot[own]
                begin, end = offsets[of] + first[own], offsets[of] + last[own] + window
                some = own[calm]
                values = [raw[x:y] for x, y in zip(begin[calm].tolist(), end[calm].tolist(), strict=True)]
                gap = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[some]), pa.array(k1[a:b][of[calm]]), pa.array(k2[a:b][of[calm]]), pa.array(first[some].astype(np.int32)),
                     pa.array(place[some].astype(np.int32)), pa.array(values, pa.binary()), gap, gap, pa.nulls(len(some), hashes)], names=names)
                if calm.all():
                    continue
                rolling = byte_hash(data)
                grams = signed(rolling.windows(window))
                wide = own[~calm]
                row, start, stop = _slots(first[wide], last[wide], place[wide])
                doc = of[~calm][row]
                low, high = np.maximum(start, first[wide][row]), np.minimum(stop - 1, last[wide][row])
                core = rolling.slices(offsets[doc] + stop - 1, offsets[doc] + start + window) ^ (start - place[wide][row]).astype(np.uint64)
                piece = rolling.slices(offsets[doc] + low, offsets[doc] + high + window)
                size = high - low + 1
                cut = np.concatenate([[0], np.cumsum(size)])
                flat = np.repeat(offsets[doc] + low, size) + np.arange(cut[-1]) - np.repeat(cut[:-1], size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[wide][row]), pa.array(k1[a:b][doc]), pa.array(k2[a:b][doc]), pa.array(low.astype(np.int32)),
                     pa.array(place[wide][row].astype(np.int32)), pa.nulls(len(row), pa.binary()), pa.array(signed(core)), pa.array(signed(piece)),
                     pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(grams[flat]))], names=names)

    return run


def _shared_parts(node: np.ndarray, first: np.ndarray, place: np.ndarray, texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of stretches that may hold repeated windows: the stretch, and first and last window of each part.

    Slots whose core is unique to a stretch are left out, neighbouring ones that stay are put together.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(sizes) - sizes
    rolling = byte_hash(np.frombuffer(b"".join(texts), np.uint8))
    last = first + sizes - window
    row, start, stop = _slots(first, last, place)
    shift = base[row] - first[row]
    core = rolling.slices(shift + stop - 1, shift + start + window) ^ mix(node[row].view(np.uint64) + (start - place[row]).astype(np.uint64))
    _, which, times = np.unique(core, return_inverse=True, return_counts=True)
    kept = np.flatnonzero(times[which] > 1)
    row, low, high = row[kept], np.maximum(start[kept], first[row[kept]]), np.minimum(stop[kept] - 1, last[row[kept]])
    if not len(row):
        return row, low, high
    cut = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (low != np.concatenate([[-1], high[:-1] + 1])))
    return row[cut], low[cut], high[np.append(cut[1:], len(row)) - 1]


def _index_task(window: int, block_bytes: int):
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        node, k1, k2, first, place, texts = zip(*rows, strict=True)
        node, k1, k2, first, place = (np.array(x, np.int64) for x in (node, k1, k2, first, place))
        row, low, high = _shared_parts(node, first, place, texts, window)
        parts = [np.frombuffer(texts[r][x : y + window], np.uint8) for r, x, y in zip(row.tolist(), (low - first[row]).tolist(), (high - first[row]).tolist(), strict=True)]
        order = np.lexsort((k2, k1))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)
        document = np.empty(len(order), np.int64)
        document[order] = np.cumsum(new) - 1
        text, offset, _ = earlier_windows(parts, document[row], low, window) if parts else (row, row, row)
        by = np.lexsort((offset, text))
        text, offset = text[by], offset[by]
        cut = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(offset, prepend=-2) != 1))
        end = np.append(cut[1:], len(text)) - 1 if len(cut) else cut
        of = row[text[cut]]
        return pa.RecordBatch.from_arrays(
            [pa.array(k1[of]), pa.array(k2[of]), pa.array((low[text[cut]] + offset[cut]).astype(np.int32)),
             pa.array((low[text[cut]] + offset[end]).astype(np.int32))], names=["k1", "k2", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:  # sorted by node: a node's stretches follow each other
            for row in zip(*(batch.column(c).to_pylist() for c in ("node", "k1", "k2", "first", "place", "bytes")), strict=True):
                if size >= block_bytes and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield solve(rows)

    return run


def earlier_spans(docs: DataFrame, packed: DataFrame, id_col: str, text_col: str, window: int, gram: int, most_branches: int, block_bytes: int) -> DataFrame:
    """``k1, k2, first, last``: ranges of starts of windows that also start earlier (in byte positions)."""
    edges = keyed(docs, id_col, text_col).select("k1", "k2", F.col("text").cast("binary").alias("text")).mapInArrow(_edges_task(window, gram), EDGE_SCHEMA)
    known = stored(repeated_occurrences(edges, "suffix"), "suffix-edges")
    here = (F.col("least")["k1"] == F.col("k1")) & (F.col("least")["k2"] == F.col("k2")) & (F.col("least")["first"] == F.col("first"))
    copies = known.where(~here).select("k1", "k2", "first", "last")
    asked = known.where(here & (F.col("branches") > 1)).select(
        "k1", "k2", F.struct("node", "first", "last", "place", (F.col("branches") > most_branches).alias("hot")).alias("span"))
    asked = asked.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))
    once = packed.join(asked, ["k1", "k2"])
    sent = stored(once.mapInArrow(_stretches_task(window), _STRETCHES), "suffix-stretches")
    at = ["node", "k1", "k2", "first"]
    calm = sent.where("bytes is not null").select(*at, "place", "bytes").dropDuplicates(at)
    calm = calm.repartition("node").sortWithinPartitions(*at)
    indexed = calm.mapInArrow(_index_task(window, block_bytes), "k1 long, k2 long, first int, last int")
    # hot nodes: slots with a shared core, of them one of each equal piece, of those the single windows
    where = F.struct("k1", "k2", "first")
    slots = sent.where("bytes is null").select(*at, "core", "piece", "grams").dropDuplicates(at)
    cores = slots.groupBy("node", "core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node", "core")
    slots = stored(slots.join(cores, ["node", "core"], "left_semi"), "suffix-slots")
    kinds = slots.groupBy("node", "piece").agg(F.min(where).alias("earliest"))
    slots = stored(slots.join(kinds, ["node", "piece"]).withColumn("again", where != F.col("earliest")), "suffix-pieces")
    again = slots.where("again").select("k1", "k2", "first", (F.col("first") + F.size("grams") - 1).alias("last"))
    # dealt out by place before the fan-out, as the pieces of a hot node lie together
    each = slots.where("not again").repartition("k1", "k2", "first").select("node", "k1", "k2", F.col("first").alias("low"), F.posexplode("grams").alias("step", "gram"))
    each = each.select("node", "gram", "k1", "k2", (F.col("low") + F.col("step")).alias("first"))
    earliest = each.groupBy("node", "gram").agg(F.min(where).alias("earliest"), F.max(where).alias("latest")).where("earliest != latest")
    later = each.join(earliest.select("node", "gram", "earliest"), ["node", "gram"]).where(where != F.col("earliest"))
    later = later.select("k1", "k2", "first", F.col("first").alias("last"))
    return copies.unionByName(indexed).unionByName(again).unionByName(later)


def _cut_task(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, spans = _list_column(batch, "spans")
            first, last = (spans.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "last"))
            out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for a, b, data, offsets in text_runs(batch):
                own = slice(at[a], at[b])
                base = offsets[np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))]
                gone = covered(len(data), base + first[own], base + last[own] + window)
                for i in range(b - a):
                    lo, hi = int(offsets[i]), int(offsets[i + 1])
                    mask = gone[lo:hi]
                    kept = data[lo:hi][~mask].tobytes()
                    out["n_bytes"].append(hi - lo)
                    out["n_removed"].append(int(mask.sum()))
                    out["n_spans"].append(int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum()))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    out["kept"].append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")],
                 pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def remove_earlier(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
    most_branches: int = MOST_BRANCHES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (``kept`` as bytes).

    A byte goes if a string of ``window`` bytes that covers it also starts earlier: in a document with a
    smaller id, or further left in the same one.  Null texts count as empty; null ids come before all others;
    different texts with one id are ordered by their fingerprint, and rows that agree in id and text are one
    document.  Empty tables give an empty result; other columns are never read.
    """
    packed = packed_texts(docs, id_col, text_col)
    spans = earlier_spans(docs, packed, id_col, text_col, window, gram, most_branches, block_bytes)
    spans = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return packed.join(spans, ["k1", "k2"], "left").mapInArrow(_cut_task(window), schema)
