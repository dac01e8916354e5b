"""Groups of spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

One inserted or deleted letter changes one count of a word's letter-count vector by one; a replaced letter takes one
from one count and adds one to another.  So a word's near words of its own length lie within one unit up and one
unit down of its vector (L1 distance two), those one letter shorter within one unit down (L1 distance one).  For each
length, words are dealt to the cells of a k-d tree; a word is sent to the cells whose box it can reach under these
limits, and there a second tree prunes boxes in the same way.  What is left is compared letter by letter.

Each pair of near words meets once: words of equal length in the lower of their two cells (and the lower chunk of a
large cell), words of unequal length in the tree of the shorter.  Cells return counts and the best near word of each word,
never pairs.  A sample of words only shapes the cells; every word is dealt, and cells beyond ``CHUNK``
words are cut into chunks that join independently.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import stored

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, RATIO, THINNED = 5, 3, 2, 97
CHUNK = 1 << 15
CHUNK_BYTES = 1 << 22
SAMPLE = 200_000
SAMPLE_LENGTH = 64  # longer words have one cell a length
LEAF = 24
PAIRS = 1 << 18
# letters: a-z, then U+00C0 to U+00FF
LETTERS = 26 + 64
_LETTER = np.zeros(256, np.int64)
_LETTER[97:123] = np.arange(26)
_LETTER[0xC0:] = 26 + np.arange(64)
TARGET, SAME, LONGER = 0, 1, 2


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thinned: int | None = THINNED) -> DataFrame:
    """``word, n``: words of at least ``LEAST_LENGTH`` letters that occur ``LEAST_COUNT`` times or more.

    Runs of letters are lower-cased (A-Z only).  If ``thinned`` divides the crc32 ``h`` of ``<id>:<run>``, the letter ``h % length``
    (from 0) is left out; None leaves all runs as they are.  A null id counts as empty text, a null text has no runs.
    Counts are combined map-side.
    """
    text = F.translate(F.col(f"`{text_col}`").cast("string"), UPPER, LOWER)
    runs = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"({RUN})"), F.lit(0))).alias("run"))
    word: Column = F.col("run")
    if thinned:
        h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
        runs = runs.select("run", h.alias("h"))
        at = (F.col("h") % F.char_length("run")).cast("int")
        word = F.when(F.col("h") % thinned == 0, F.overlay("run", F.lit(""), at + 1, F.lit(1))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """Counts (up to 255, which keeps every bound valid) of the rows of a matrix of Latin-1 letters."""
    n, length = letters.shape
    out = np.zeros((n, LETTERS), np.uint8)
    step = max(1, (1 << 22) // max(length, 1))
    for at in range(0, n, step):
        part = _LETTER[letters[at : at + step]]
        flat = np.bincount((part + np.arange(len(part))[:, None] * LETTERS).ravel(), minlength=len(part) * LETTERS)
        out[at : at + step] = np.minimum(flat.reshape(len(part), LETTERS), 255)
    return out


class KdTree:
    """A k-d tree over letter counts; a leaf holds at most ``leaf`` points unless their vectors are equal."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        letter, level, left, right, low, high, number = [], [], [], [], [], [], []
        parts: list[np.ndarray] = []

        def node(lo: int, hi: int) -> int:
            for column, value in ((letter, 0), (level, 0), (left, -1), (right, -1), (low, lo), (high, hi), (number, -1)):
                column.append(value)
            return len(letter) - 1

        box = np.array([[0] * LETTERS, [255] * LETTERS], np.int16)
        todo = [(node(0, 255), np.arange(len(points)), box)]
        while todo:
            at, rows, box = todo.pop()
            cut = self._cut(points[rows]) if len(rows) > leaf else None
            if cut is None:
                number[at] = len(parts)
                parts.append(rows)
                continue
            d, t = cut
            letter[at], level[at], low[at], high[at] = d, t, int(box[0, d]), int(box[1, d])
            above = points[rows, d] > t
            under, over = box.copy(), box.copy()
            under[1, d], over[0, d] = t, t + 1
            left[at], right[at] = node(0, 255), node(0, 255)
            todo += [(right[at], rows[above], over), (left[at], rows[~above], under)]
        self.letter, self.left, self.right, self.number = (np.array(x, np.int64) for x in (letter, left, right, number))
        self.level, self.low, self.high = (np.array(x, np.int16) for x in (level, low, high))
        self.order = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.size = np.array([len(x) for x in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size

    @staticmethod
    def _cut(points: np.ndarray) -> tuple[int, int] | None:
        """Letter and level that halve the points best."""
        shares = np.stack([(points > t).mean(axis=0) for t in (0, 1)])
        level, letter = np.unravel_index(np.abs(shares - 0.5).argmin(), shares.shape)
        if 0 < shares[level, letter] < 1:
            return int(letter), int(level)
        spread = points.max(axis=0).astype(int) - points.min(axis=0)
        letter = int(spread.argmax())
        return (letter, int(points[:, letter].min()) + (int(spread[letter]) - 1) // 2) if spread[letter] else None

    def search(self, probes: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (probe, leaf) for every leaf whose box is at most ``up`` units above and ``down`` below the probe in all."""
        probe = np.arange(len(probes))
        node = np.zeros(len(probes), np.int64)
        rise = np.zeros(len(probes), np.int16)
        fall = rise.copy()
        found = []
        while len(probe):
            leaf = self.number[node] >= 0
            if leaf.any():
                found.append((probe[leaf], self.number[node[leaf]]))
                inner = ~leaf
                probe, node, rise, fall = probe[inner], node[inner], rise[inner], fall[inner]
                if not len(probe):
                    break
            x = probes[probe, self.letter[node]].astype(np.int16)
            t = self.level[node]
            to_left = fall - np.maximum(x - self.high[node], 0) + np.maximum(x - t, 0)
            to_right = rise - np.maximum(self.low[node] - x, 0) + np.maximum(t + 1 - x, 0)
            goes_left, goes_right = to_left <= down, to_right <= up
            probe, node, rise, fall = (
                np.concatenate([probe[goes_left], probe[goes_right]]), np.concatenate([self.left[node[goes_left]], self.right[node[goes_right]]]),
                np.concatenate([rise[goes_left], to_right[goes_right]]), np.concatenate([to_left[goes_left], fall[goes_right]]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _letters(words: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def _masks(letters: np.ndarray) -> np.ndarray:
    """Which letters a word holds, as two 64-bit masks."""
    held = np.zeros((len(letters), 128), np.uint8)
    held[np.arange(len(letters))[:, None], _LETTER[letters]] = 1
    return np.packbits(held, axis=1).view(np.uint64)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_deleted(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Whether the shorter row is the longer one less a letter: equal starts and equal ends together cover it."""
    n, length = shorter.shape
    ends = np.ones((n, 1), bool)
    starts = np.concatenate([longer[:, :-1] != shorter, ends], axis=1).argmax(axis=1)
    tails = np.concatenate([(longer[:, 1:] != shorter)[:, ::-1], ends], axis=1).argmax(axis=1)
    return starts + tails >= length


class _Cell:
    """Words of one chunk of a cell, with the tree that searches them."""

    def __init__(self, length: int) -> None:
        self.length, self.words, self.n = length, [], []
        self.tree = None

    def add(self, words: list[bytes], n: np.ndarray) -> None:
        self.words += words
        self.n.append(n)

    def prepare(self) -> Iterator[tuple]:
        """Build the tree and join the chunk with itself."""
        if self.tree is not None or not self.words:
            return
        self.letters = _letters(self.words, self.length)
        self.n = np.concatenate(self.n)
        self.names = np.array(self.words, f"S{self.length + 1}")
        counts = letter_counts(self.letters)
        self.tree = KdTree(counts, LEAF)
        self.masks = _masks(self.letters)
        self.near = np.zeros(len(self.words), np.int64)
        self.best = np.zeros(len(self.words), np.int64)
        self.form = np.zeros(len(self.words), f"S{self.length + 1}")
        yield from self._meet(self.names, self.letters, counts, self.masks, self.n, SAME, True)

    def meet(self, words: list[bytes], n: np.ndarray, role: int) -> Iterator[tuple]:
        """Rows (word, near, best, form) of probes that have near words here."""
        if self.tree is None or not words:
            return
        length = self.length + (role == LONGER)
        letters = _letters(words, length)
        yield from self._meet(np.array(words, f"S{length}"), letters, letter_counts(letters), _masks(letters), n, role, False)

    def _meet(self, names, letters, counts, masks, n, role: int, within: bool) -> Iterator[tuple]:
        up = 1 if role == SAME else 0
        for at in range(0, len(names), 2048):
            probe, leaf = self.tree.search(counts[at : at + 2048], up, 1)
            probe = probe + at
            sizes = self.tree.size[leaf]
            ends = np.cumsum(sizes)
            links = []
            first = 0
            while first < len(leaf):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
                some = sizes[first:last]
                p = np.repeat(probe[first:last], some)
                place = np.arange(len(p)) - np.repeat(np.cumsum(some) - some, some)
                t = self.tree.order[np.repeat(self.tree.start[leaf[first:last]], some) + place]
                if within:
                    lower = t < p
                    p, t = p[lower], t[lower]
                above = np.bitwise_count(self.masks[t] & ~masks[p]).sum(axis=1)
                below = np.bitwise_count(masks[p] & ~self.masks[t]).sum(axis=1)
                close = (above <= up) & (below <= 1)
                p, t = p[close], t[close]
                step = max(1, (1 << 24) // (self.length + 1))
                for i in range(0, len(p), step):
                    q, s = p[i : i + step], t[i : i + step]
                    near = one_replaced(letters[q], self.letters[s]) if role == SAME else one_deleted(letters[q], self.letters[s])
                    links.append((q[near], s[near]))
                first = last
            if not links:
                continue
            p, t = np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links])
            if len(p):
                self._take(t, names[p], n[p])
                who, near, best, form = _best(p, self.names[t], self.n[t])
                yield names[who], near, best, form

    def _take(self, target: np.ndarray, word: np.ndarray, n: np.ndarray) -> None:
        who, near, best, form = _best(target, word, n)
        self.near[who] += near
        better = (best > self.best[who]) | ((best == self.best[who]) & (form < self.form[who]))
        self.best[who[better]], self.form[who[better]] = best[better], form[better]

    def close(self) -> Iterator[tuple]:
        yield from self.prepare()
        if self.tree is not None:
            some = np.flatnonzero(self.near)
            yield self.names[some], self.near[some], self.best[some], self.form[some]


def _best(who: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each one in ``who``: number of words, and the one of largest n (ties: the smallest)."""
    order = np.lexsort((word, -n, who))
    who, word, n = who[order], word[order], n[order]
    first = np.flatnonzero(np.diff(who, prepend=-1))
    return who[first], np.diff(np.append(first, len(who))), n[first], word[first]


_NEAR = "word string, near long, best long, form string"


def _packed(rows: tuple) -> pa.RecordBatch:
    text = lambda a: pa.array([w.decode("latin-1") for w in a.tolist()], pa.string())
    return pa.RecordBatch.from_arrays([text(rows[0]), pa.array(rows[1]), pa.array(rows[2]), text(rows[3])], names=["word", "near", "best", "form"])


def _match_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of a partition sorted by length, cell, chunk and role: targets first, then probes as a stream."""
    key, cell = None, None
    for batch in batches:
        ids = np.stack([batch.column(c).to_numpy() for c in ("length", "cell", "chunk", "role")], axis=1)
        cuts = np.flatnonzero(np.concatenate([[True], (np.diff(ids, axis=0) != 0).any(axis=1)])) if len(ids) else np.zeros(0, np.int64)
        for a, b in zip(cuts, np.append(cuts[1:], len(ids)), strict=True):
            here = tuple(ids[a][:3])
            if here != key:
                if cell is not None:
                    yield from map(_packed, cell.close())
                key, cell = here, _Cell(int(ids[a][0]))
            words = [w.encode("latin-1") for w in batch.column("word")[a:b].to_pylist()]
            n, role = batch.column("n")[a:b].to_numpy(), int(ids[a][3])
            if role == TARGET:
                cell.add(words, n)
            else:
                yield from map(_packed, cell.prepare())
                yield from map(_packed, cell.meet(words, n, role))
    if cell is not None:
        yield from map(_packed, cell.close())


class Cells:
    """The trees that deal words: one for each length that is sampled, a single cell for any other."""

    def __init__(self, sample: list[bytes], totals: dict[int, int], per_cell: int) -> None:
        self.trees, self.chunks = {}, {}
        by_length: dict[int, list[bytes]] = {}
        for word in sample:
            by_length.setdefault(len(word), []).append(word)
        for length, words in by_length.items():
            wanted = -(-totals.get(length, 0) // per_cell)
            if wanted > 1:
                self.trees[length] = KdTree(letter_counts(_letters(words, length)), max(8, len(words) // wanted))

    def visits(self, length: int, probes: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        tree = self.trees.get(length)
        return (np.arange(len(probes)), np.zeros(len(probes), np.int64)) if tree is None else tree.search(probes, up, down)

    def home(self, length: int, probes: np.ndarray) -> np.ndarray:
        probe, cell = self.visits(length, probes, 0, 0)
        return cell[np.argsort(probe)]


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and letter counts."""
    words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield int(length), rows, letter_counts(_letters([words[i] for i in rows], int(length)))


def _home_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, rows, counts in _by_length(batch):
                cells, sizes = np.unique(shared.value.home(length, counts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), length, np.int32)), pa.array(cells.astype(np.int32)), pa.array(sizes)], names=["length", "cell", "n"])

    return run


def _deal_task(shared, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value

        def parts(length: int, cell: np.ndarray) -> np.ndarray:
            return np.array([cells.chunks.get((length, int(c)), 0) for c in cell], np.int64)

        def spread(length: int, rows: np.ndarray, cell: np.ndarray, times: np.ndarray, role: int):
            """A row for each of the first ``times`` chunks."""
            at = np.repeat(np.arange(len(rows)), times)
            return length, rows[at], cell[at], np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times), role

        for batch in batches:
            key = batch.column("h").to_numpy().view(np.uint64)
            for length, rows, counts in _by_length(batch):
                home = cells.home(length, counts)
                part = (key[rows] % parts(length, home).astype(np.uint64)).astype(np.int64)
                probe, cell = cells.visits(length, counts, 1, 1)
                # equal lengths: only towards lower cells, and in the own cell towards lower chunks
                times = np.where(cell == home[probe], part[probe], np.where(cell < home[probe], parts(length, cell), 0))
                out = [(length, rows, home, part, TARGET), spread(length, rows[probe], cell, times, SAME)]
                probe, cell = cells.visits(length - 1, counts, 0, 1)
                out.append(spread(length - 1, rows[probe], cell, parts(length - 1, cell), LONGER))
                for to, who, where, chunks, role in out:
                    for at in range(0, len(who), 8192):
                        some = slice(at, at + 8192)
                        take, size = pa.array(who[some]), len(who[some])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(size, to, np.int32)), pa.array(where[some].astype(np.int32)), pa.array(chunks[some].astype(np.int32)), pa.array(np.full(size, role, np.int32)),
                             batch.column("word").take(take), batch.column("n").take(take)],
                            names=["length", "cell", "chunk", "role", "word", "n"])

    return run


def near_words(words: DataFrame, per_cell: int = CHUNK, chunk: int = CHUNK, sample: int = SAMPLE) -> DataFrame:
    """``word, n_near, best, near_word`` of the words (``word, n``, each word once) that have near words.

    ``near_word`` is the near word of largest n (``best``), the smallest in code-point order of several.  About ``sample`` words,
    chosen by hash, shape the cells on the driver; all words are dealt to them.
    """
    spark = words.sparkSession
    words = words.withColumn("h", F.xxhash64("word"))
    totals = {r["length"]: r["count"] for r in words.groupBy(F.char_length("word").alias("length")).count().where(F.col("length") <= SAMPLE_LENGTH).collect()}
    shape = []
    if any(n > per_cell for n in totals.values()):
        # a share of all hashes, so that tasks pick their own rows and the driver gets about ``sample`` of them
        share = min(1.0, sample / sum(totals.values()))
        rows = words.where((F.char_length("word") <= SAMPLE_LENGTH) & (F.col("h").cast("double") <= (2 * share - 1) * 2.0**63)).select("word").collect()
        shape = [r["word"].encode("latin-1") for r in rows]
    cells = Cells(shape, totals, per_cell)
    shared = spark.sparkContext.broadcast(cells)
    # one row for each cell that holds words
    for r in words.select("word").mapInArrow(_home_task(shared), "length int, cell int, n long").groupBy("length", "cell").agg(F.sum("n").alias("n")).collect():
        cells.chunks[r["length"], r["cell"]] = -(-r["n"] // max(1, min(chunk, CHUNK_BYTES // r["length"])))
    dealt = words.mapInArrow(
        _deal_task(spark.sparkContext.broadcast(cells), chunk), "length int, cell int, chunk int, role int, word string, n long")
    joined = dealt.repartition("length", "cell", "chunk").sortWithinPartitions("length", "cell", "chunk", "role")
    found = joined.mapInArrow(_match_task, _NEAR)
    best = F.min(F.struct((-F.col("best")).alias("less"), F.col("form").alias("near_word")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best"), "b.near_word")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: forms followed to their end by doubling the way each round.

    A form occurs at least twice as often as its word, so ways are short and hold no cycle.
    """
    state = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        state = stored(state.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "spelling-roots")
        if state.where("moved").isEmpty():
            return state.select("word", "root")
        state = state.drop("moved")


def group_words(words: DataFrame, ratio: int = RATIO, **how) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every row of ``word, n``.

    ``form`` is the near word of largest n, if that is at least ``ratio`` times the word's own; ``root`` is the last word on the
    way from form to form.  A word without near words has ``n_near`` 0; without a form it is its own root.
    """
    words = stored(words.select("word", "n"), "spelling-words")
    near = near_words(words, **how)
    enough = F.col("best") >= ratio * F.col("n")
    forms = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("near_word")).alias("form"), F.when(enough, F.col("best")).alias("form_n")), "spelling-forms")
    ends = roots(forms.where("form is not null").select("word", "form"))
    return forms.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Words of the documents (see ``counted_words``) with their forms and roots (see ``group_words``).

    Rows that repeat an id or a text count as often as they occur; an empty table, or one without words that occur often
    enough, gives an empty result.  Other columns are never read.
    """
    return group_words(counted_words(docs, id_col, text_col), **how)
