"""Helpers of the training-data operators: document keys, stored steps, and byte, word and window hashes.

Rows of a table are named by ``(doc_id, fingerprint of the text)``, so that a missing or repeated
``doc_id`` never mixes two texts.  Rows that agree in both are copies of one row: they get one result each,
and the result is the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.session import ensure_checkpoint_dir

# A word is a run of bytes other than space and \t \n \v \f \r (the pattern [^\x20\x09-\x0D]+).
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
# Texts are handled in groups of about so many bytes, a longer text alone.
CHUNK_BYTES = 1 << 19
# Rows of an Arrow batch: whole texts are long, and two batches are held at a time on both sides.
BATCH_ROWS = 1000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fingerprint(column: Column) -> Column:
    return F.xxhash64(column)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size for tables of texts (only speed and memory depend on it)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``k1`` (the id), ``k2`` (fingerprint of id being missing, and text) and ``text`` (null: empty)."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    id_ = F.col(id_col).cast("long")
    return docs.select(
        F.coalesce(id_, F.lit(-1)).alias("k1"), F.xxhash64(id_.isNull(), text).alias("k2"), id_.alias("doc_id"), text.alias("text")
    )


@contextmanager
def _files_cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a stored step go when it has been written: nothing reads them again."""
    before = spark.conf.get(_FILE_CLEANUP, None)
    spark.conf.set(_FILE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FILE_CLEANUP)
        else:
            spark.conf.set(_FILE_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step as Parquet beside the checkpoints, which all executors share, and read it back."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with _files_cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove a table that ``stored`` wrote, once what was made of it is written too (nothing may read it again)."""
    context = table.sparkSession.sparkContext
    for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


# Keys (two longs each) that may be broadcast; more are joined by shuffle.
MAX_BROADCAST_KEYS = 500_000


def few(df: DataFrame, name: str) -> DataFrame:
    """A stored table of keys, marked for broadcast if it has at most ``MAX_BROADCAST_KEYS`` rows."""
    df = stored(df, name)
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_KEYS else df


def text_keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """``k1`` and ``k2`` of the rows of a table, as in ``keyed``."""
    id_, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return [F.coalesce(id_, F.lit(-1)).alias("k1"), F.xxhash64(id_.isNull(), text).alias("k2")]


def without(docs: DataFrame, gone: DataFrame, repeated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with all columns, less the rows whose ``k1, k2`` are in ``gone``, and one row for each in ``repeated``.

    The keys are broadcast up to a checked number, so that texts are shuffled only beyond it.
    """
    marks = few(gone.distinct().withColumn("mark", F.lit(1)).unionByName(repeated.distinct().withColumn("mark", F.lit(2))), "marks")
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *text_keys(docs, id_col, text_col))
    marked = wide.join(marks, ["k1", "k2"], "left")
    once = marked.where("mark is null").select("row.*")
    if marks.where("mark = 2").isEmpty():
        return once
    return once.unionByName(marked.where("mark = 2").dropDuplicates(["k1", "k2"]).select("row.*"))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit (in place on its copy)."""
    x = x + _GOLD
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x], np.uint64))[0])


_BYTE_VALUES = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 20))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n + n // 4, 1 << 16)
            grown = []
            for b in (self.base, self.inverse):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                grown.append(np.multiply.accumulate(steps))
            self.up, self.down = grown
        return self.up[:n], self.down[:n]


_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(0xA0761D6478BD642F)


def _prefix(values: np.ndarray, powers: _Powers) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers.get(len(values))[0], out=out[1:])
    return out


class RollingHash:
    """64-bit polynomial hashes of any slices of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, powers: _Powers = _WORD_POWERS) -> None:
        self.prefix = _prefix(values, powers)
        self.down = powers.get(len(values) + 1)[1]

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.down[start])

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all slices of length k."""
        n = len(self.prefix) - k
        return mix((self.prefix[k:] - self.prefix[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def byte_hash(data: np.ndarray) -> RollingHash:
    return RollingHash(_BYTE_VALUES[data], _POWERS)


class Words:
    """Words of a group of texts: byte bounds, text number, and (lazily) 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        solid = ~_IS_SPACE[data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        first[cuts] = solid[cuts]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        ends = offsets[1:][offsets[1:] > 0] - 1
        last[ends] = solid[ends]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)  # words before each text
        self.count = np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        return byte_hash(self.data).slices(self.start, self.end)


def text_groups(
    batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES, most_rows: int = 1 << 30
) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most ``most`` bytes of text (or one text), as bytes and offsets.  No nulls allowed."""
    array = batch.column(column)
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(array):
        to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1), at + most_rows)
        yield slice(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


_PLACE_BITS = np.uint64(26)


def anchors(grams: np.ndarray, windows_ok: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled grams: the (leftmost) least of every ``width`` consecutive grams of an allowed window.

    Returns gram positions and, for each, the first and last window that chose it.  Equal windows choose at
    the same place, so two equal windows always share a sampled gram.  The upper 38 bits of a hash decide,
    then the place, in stretches of 2^26 grams.
    """
    stretch = (1 << 26) - width
    parts = []
    for at in range(0, max(len(grams) - width + 1, 0), stretch):
        some = grams[at : at + stretch + width - 1]
        order = (some >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(some), dtype=np.uint64)
        chosen = (sliding_least(order, width) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        windows = np.flatnonzero(windows_ok[at : at + len(chosen)])
        chosen = chosen[windows]
        cut = np.flatnonzero((np.diff(chosen, prepend=-1) != 0) | (np.diff(windows, prepend=-2) != 1))
        last = windows[np.append(cut[1:], len(windows)) - 1] if len(cut) else windows[:0]
        parts.append((chosen[cut] + at, windows[cut] + at, last + at))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def covered(length: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Mask of positions in any of the ranges [first, last)."""
    steps = np.zeros(length + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, last, -1)
    return np.cumsum(steps[:-1]) > 0


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
