"""Exact Jaccard self-join of word n-gram sets by a partition of the token universe.

Sets of similar size (a band) cut the universe of token hashes into more segments than two linked sets can differ
in tokens, so by the pigeonhole principle linked sets agree on a whole segment.  Every set is indexed under the
content of each non-empty segment.  Sets that straddle two bands also use a scheme of their own for the border.

Allocation by cost: a segment left empty by a set is no evidence (every other set that leaves it empty
would be a candidate), so a scheme has some spare segments, as many as make indexing cheapest.  A set
with more empty segments than spare ones also indexes the one-deletion neighbourhoods of its segments, which
count for two differences each; if even that does not reach the bound, it indexes its single tokens.

Candidates are compared exactly.  In the group of a key, every set is first compared with the one that shares keys
with most others, which then leaves the group, and so on for a few rounds; a group of two or three sets is decided by that.
Sets whose groups are still apart after that are held against each other by sketches, group by group: the parities of a
set's tokens in a few cells bound from below in how many tokens two sets differ, so no linked pair is ruled out, and
common phrases chain no unlike sets together.  What the sketches leave forms clusters, whose tokens are compared in chunks.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import RollingHash, Words, discard, few, keyed, lower_ascii, mix, mix_int, signed, stored, text_groups, without
from plantlens.llm.components import Forest, components
from plantlens.llm.substring import packed_texts, unpacked

NGRAM = 4
# Linked: HUNDREDTHS / 100 of the union or more are common.
HUNDREDTHS = 85
BAND_RATIO = 1.5
# Rounds in which the sets of a group meet its first one.
FIRST_ROUNDS = 3
# Sets of a chunk of targets, and tokens of the probes that meet it at a time.
CHUNK = 256
PROBE_TOKENS = 1 << 13
# Probes that meet one copy of a chunk: a large cluster's chunks are copied, so that no task takes all its sets.
SLICE = 2048
# Sets of a group that meet each other's sketches in one task, and pairs of sketches compared at a time.
GROUP_CHUNK = 1 << 14
SKETCH_PAIRS = 1 << 20
# Sets that a task remembers as sent, and parts of the rows of a key that a batch knows to be shared.
SEEN = 1 << 17
SALTS = 64
_DOC_BITS = np.uint64(10)


def token_sets(data: np.ndarray, offsets: np.ndarray, ngram: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each of at most 1024 texts, sorted within the text, and the bounds of the texts.

    Fewer words than ``ngram`` make one token of all of them; no word, an empty set.
    """
    words = Words(lower_ascii(data), offsets)
    rolling, count = RollingHash(words.hashes()), words.count
    n = len(words.start)
    start = np.arange(n)
    end = np.minimum(start + ngram, np.repeat(words.bounds[1:], count))
    whole = (end - start == ngram) | ((start == np.repeat(words.bounds[:-1], count)))
    start, end = start[whole], end[whole]
    doc = np.repeat(np.arange(len(count)), count)[whole].astype(np.uint64)
    tokens = np.sort((doc << np.uint64(54)) | (rolling.slices(start, end) >> _DOC_BITS))
    tokens = tokens[np.concatenate([[True], tokens[1:] != tokens[:-1]])] if len(tokens) else tokens
    bounds = np.searchsorted(tokens, np.arange(len(count) + 1, dtype=np.uint64) << np.uint64(54))
    return tokens & np.uint64((1 << 54) - 1), bounds


def _segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def set_ids(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids of the sets' contents, and their sizes."""
    size = np.diff(bounds)
    return mix(_segment_sums(mix(tokens), bounds) + size.astype(np.uint64)), size


@functools.lru_cache(maxsize=64)
def schemes(most: int, hundredths: int) -> tuple[np.ndarray, ...]:
    """Bands up to size ``most``: least and largest size of sets in a scheme, the bound on differences, and segments.

    Scheme 2b is band b itself, 2b + 1 the border to the next band.
    """
    low, ratio = [1], max(BAND_RATIO, 100 / hundredths)  # so that linked sets lie in neighbouring bands at most
    while low[-1] <= most:
        low.append(math.floor(low[-1] * ratio) + 1)
    rows = []
    for b in range(len(low) - 1):
        a, z = low[b], low[b + 1] - 1
        rows.append((a, z, 2 * z))
        over = 100 * z // hundredths  # the largest set that can be linked with one of this band
        under = -(-hundredths * low[b + 1] // 100)  # the least one that can be linked with one of the next
        rows.append((under, over, z + over) if over > z and under <= z else (1, 0, 0))
    least, largest, total = np.array(rows).T
    differences = (100 - hundredths) * total // (100 + hundredths)
    segments = np.array([d + 1 + _spare(int(d), int(s)) for d, s in zip(differences, least, strict=True)])
    return least, largest, differences, segments


def _spare(differences: int, size: int) -> int:
    """Spare segments that make the keys of a set of this size fewest: each is a key, too few cost neighbourhoods."""
    best, at = math.inf, 0
    for spare in range(0, 4 * differences + 8):
        m = differences + 1 + spare
        empty = m * (1 - 1 / m) ** size
        deviation = math.sqrt(max(empty * (1 - empty / m), 1e-9))
        short = 0.5 * math.erfc((spare + 0.5 - empty) / deviation / math.sqrt(2))
        cost = m - empty + short * size
        if cost < best - 1e-9:
            best, at = cost, spare
    return at


def signatures(tokens: np.ndarray, bounds: np.ndarray, hundredths: int = HUNDREDTHS) -> tuple[np.ndarray, np.ndarray]:
    """Keys of sets and the set each is of: two linked sets share a key at least."""
    size = np.diff(bounds)
    if not len(tokens):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    least, largest, differences, segments = schemes(1 << int(size.max()).bit_length(), hundredths)
    band = np.searchsorted(least[::2], size, "right") - 1
    keys, owners = [], []
    for shift in (0, 1, -1):
        scheme = 2 * band + shift
        usable = (size > 0) & (scheme >= 0)
        scheme = np.where(usable, scheme, 0)
        usable &= (size >= least[scheme]) & (size <= largest[scheme])
        sets = np.flatnonzero(usable)
        if not len(sets):
            continue
        own = np.repeat(np.arange(len(sets)), size[sets])
        values = tokens[np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in sets])]
        kind = scheme[sets].astype(np.uint64)
        seed = mix(kind + np.uint64(1 << 32))
        mixed = mix(values ^ seed[own])
        m = segments[scheme[sets]]
        first = np.concatenate([[0], np.cumsum(m)])
        cell = first[own] + (mixed >> np.uint64(33)).astype(np.int64) % m[own]
        order = np.argsort(cell, kind="stable")
        cell, mixed = cell[order], mixed[order]
        cut = np.flatnonzero(np.diff(cell, prepend=-1))
        sums, filled = np.add.reduceat(mixed, cut), cell[cut]
        held = np.diff(np.append(cut, len(cell)))
        owner = np.searchsorted(first, filled, "right") - 1
        place = mix((kind[owner] << np.uint64(32)) + (filled - first[owner]).astype(np.uint64))
        keys.append(mix(sums ^ place))
        owners.append(sets[owner])
        # sets with more empty segments than spare ones: one-deletion neighbourhoods, then single tokens
        needed = differences[scheme[sets]] + 1
        short = np.bincount(owner, minlength=len(sets)) < needed
        if short.any():
            of_token = np.repeat(np.arange(len(cut)), held)
            near = short[owner[of_token]] & (held[of_token] > 1)
            keys.append(mix((sums[of_token] - mixed)[near] ^ place[of_token][near]))
            owners.append(sets[owner[of_token][near]])
            reach = np.bincount(owner, weights=np.where(held > 1, 2, 1), minlength=len(sets))
            alone = (reach < needed)[owner[of_token]]
            keys.append(mix(mixed[alone] ^ seed[owner[of_token][alone]]))
            owners.append(sets[owner[of_token][alone]])
    return np.concatenate(keys), np.concatenate(owners)


def _sets_task(ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = [], []
            for _, data, offsets in text_groups(batch, most_rows=1024):
                a, b = set_ids(*token_sets(data, offsets, ngram))
                ids.append(a)
                sizes.append(b)
            size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            sid = signed(np.concatenate(ids)) if ids else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), batch.column("doc_id"), pa.array(sid, mask=size == 0), pa.array(size.astype(np.int64))],
                names=["k1", "k2", "doc_id", "sid", "n"],
            )

    return run


def _keys_task(ngram: int, hundredths: int):
    """Keys of the sets, each set once for ``SEEN`` sets of a task, with a ``tag``.

    A key that several sets of a batch share is known to be shared: its rows pass on with a tag above 0 that spreads them,
    and two of them stand in for it (tag -1) among the keys met once (tag 0).  So a hot key is combined before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, owners = [], []
            for _, data, offsets in text_groups(batch, most_rows=1024):
                tokens, bounds = token_sets(data, offsets, ngram)
                ids, size = set_ids(tokens, bounds)
                new = []
                for i, sid in enumerate(ids.tolist()):
                    if size[i] and sid not in seen:
                        seen.add(sid)
                        new.append(i)
                if not new:
                    continue
                if len(new) < len(ids):
                    tokens = np.concatenate([tokens[bounds[i] : bounds[i + 1]] for i in new])
                    ids, bounds = ids[new], np.concatenate([[0], np.cumsum(size[new])])
                found, owner = signatures(tokens, bounds, hundredths)
                keys.append(found)
                owners.append(ids[owner])
                if len(seen) > SEEN:
                    seen.clear()
            if keys:
                yield _tagged(np.concatenate(keys), np.concatenate(owners))

    return run


def _tagged(key: np.ndarray, sid: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((sid, key))
    key, sid = key[order], sid[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
    key, sid = key[new], sid[new]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    held = np.diff(np.append(cut, len(key)))
    several = cut[held > 1]
    tag = np.where(np.repeat(held > 1, held), 1 + (mix(sid) % np.uint64(SALTS)).astype(np.int32), 0)
    stand_in = np.concatenate([several, several + 1])
    key, sid = np.append(key, key[stand_in]), np.append(sid, sid[stand_in])
    tag = np.append(tag, np.full(len(stand_in), -1)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(sid)), pa.array(tag)], names=["key", "sid", "tag"])


def _shared_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys that two sets share or that are tagged so, from rows sorted by key and set; one row is held in between.

    Of a key's first set a row may come out once more with every batch.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, sid, tag = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "sid", "tag"))
        if held is not None:
            key, sid, tag = np.append(held[0], key), np.append(held[1], sid), np.append(0, tag)
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        end = np.append(start[1:], len(key))
        passes = np.repeat(sid[start] != sid[end - 1], end - start) | (tag > 0)
        yield pa.RecordBatch.from_arrays([pa.array(key[passes]), pa.array(sid[passes])], names=["key", "sid"])
        held = key[start[-1]], sid[start[-1]]


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the number of tokens in each of 64 cells or more, about as many as a set has tokens.

    Two sets differ in at least as many tokens as their sketches differ in cells.
    """
    cells = max(64, 1 << (len(tokens).bit_length() - 1)) if len(tokens) else 64
    odd = np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """Sketches (a row of words each) as they would be with fewer cells."""
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def _words(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, all folded to the shortest."""
    lengths = np.array([len(x) for x in sketches])
    out = np.zeros((len(sketches), lengths.min() // 8), np.uint64)
    for length in np.unique(lengths):
        some = np.flatnonzero(lengths == length)
        out[some] = _folded(np.frombuffer(b"".join(sketches[i] for i in some), np.uint64).reshape(len(some), -1), out.shape[1])
    return out


def _contents_task(ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sketches = [], []
            for _, data in unpacked(batch):
                tokens = token_sets(data, np.array([0, len(data)]), ngram)[0]
                values.append(tokens.tobytes())
                sketches.append(sketch(tokens))
            yield pa.RecordBatch.from_arrays(
                [batch.column("sid"), pa.array(values, pa.binary()), pa.array(sketches, pa.binary())], names=["sid", "tokens", "sketch"]
            )

    return run


def _near_task(hundredths: int):
    """Pairs that their sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            total = batch.column("na").to_numpy(zero_copy_only=False) + batch.column("nb").to_numpy(zero_copy_only=False)
            for i, pair in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)):
                x, y = _words(list(pair))
                near[i] = (100 + hundredths) * int(np.bitwise_count(x ^ y).sum()) <= (100 - hundredths) * total[i]
            keep = pa.array(near)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _near_pairs(pairs: DataFrame, contents: DataFrame, hundredths: int) -> DataFrame:
    """``a, b`` of the pairs ``a, b, na, nb`` that may be linked by their sketches, which are moved in place of tokens."""
    one = pairs.join(contents.select(F.col("sid").alias("a"), F.col("sketch").alias("sa")), "a")
    two = one.join(contents.select(F.col("sid").alias("b"), F.col("sketch").alias("sb")), "b")
    return two.mapInArrow(_near_task(hundredths), "a long, b long")


def _verify_task(hundredths: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("ta"), batch.column("tb"), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([p, q]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                linked[i] = 100 * common >= hundredths * (len(p) + len(q) - common)
            keep = pa.array(linked)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def _contents_of(sids: DataFrame, contents: DataFrame) -> DataFrame:
    """The contents of some sets: by chance most sets share a key, but the tokens of few are compared, and only those are moved."""
    return contents.select("sid", "tokens").join(few(sids.select("sid").distinct(), "jaccard-asked"), "sid", "left_semi")


def _verified(pairs: DataFrame, contents: DataFrame, hundredths: int) -> DataFrame:
    contents = _contents_of(pairs.select(F.explode(F.array("a", "b")).alias("sid")), contents)
    one = pairs.join(contents.select(F.col("sid").alias("a"), F.col("tokens").alias("ta")), "a")
    two = one.join(contents.select(F.col("sid").alias("b"), F.col("tokens").alias("tb")), "b").select("a", "b", "ta", "tb")
    return stored(two.mapInArrow(_verify_task(hundredths), "a long, b long"), "jaccard-links")


def _alike(hundredths: int, na: str, nb: str) -> Column:
    return 100 * F.least(na, nb) >= hundredths * F.greatest(na, nb)


def linked_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, hundredths: int = HUNDREDTHS) -> tuple[DataFrame, DataFrame]:
    """``(rows, roots)``: ``k1, k2, doc_id, sid, n`` of every row, and ``sid, root`` of sets linked with another set.

    ``sid`` names the set (rows with equal sets share it; null for the empty set), so copies cost nothing more.
    """
    texts = keyed(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    rows = stored(texts.mapInArrow(_sets_task(ngram), "k1 long, k2 long, doc_id long, sid long, n long"), "jaccard-rows")
    sent = texts.select("text").mapInArrow(_keys_task(ngram, hundredths), "key long, sid long, tag int")
    met_once = sent.repartition("key", F.greatest("tag", F.lit(0))).sortWithinPartitions("key", "sid")
    groups = stored(met_once.mapInArrow(_shared_task, "key long, sid long").distinct(), "jaccard-groups")
    # a set that shares keys with many others is likely the text the others were copied from: it is compared first
    met = groups.groupBy("key").agg((F.count(F.lit(1)) - 1).alias("met"))
    met = groups.join(met, "key").groupBy("sid").agg(F.sum("met").alias("met"))
    of_rows = rows.where("sid is not null").groupBy("sid").agg(F.min(F.struct("k1", "k2")).alias("at"), F.first("n").alias("n"))
    members = stored(met.join(of_rows, "sid").select("sid", "met", "n", "at.k1", "at.k2"), "jaccard-members")
    named = stored(groups.join(members.select("sid", "met", "n"), "sid"), "jaccard-groups")
    discard(groups)
    groups = named

    contents = packed_texts(docs, id_col, text_col).join(members.select("sid", "k1", "k2"), ["k1", "k2"]).dropDuplicates(["k1", "k2", "sid"])
    contents = stored(contents.select("sid", "packed").mapInArrow(_contents_task(ngram), "sid long, tokens binary, sketch binary"), "jaccard-contents")

    # every set of a group meets the group's first one, which then leaves: it has been compared with all of them
    links, rest = None, groups
    for _ in range(FIRST_ROUNDS):
        first = rest.groupBy("key").agg(F.max(F.struct("met", "sid", "n")).alias("r"), F.count(F.lit(1)).alias("held"))
        first = first.select("key", F.col("r.sid").alias("b"), F.col("r.n").alias("nb"), "held")
        others = rest.join(first, "key").where(F.col("sid") != F.col("b"))
        pairs = others.where(_alike(hundredths, "n", "nb")).select(F.col("sid").alias("a"), "b", F.col("n").alias("na"), "nb").distinct()
        found = _verified(stored(_near_pairs(pairs, contents, hundredths), "jaccard-pairs"), contents, hundredths)
        links = found if links is None else links.unionByName(found)
        roots = components(links).select(F.col("node").alias("sid"), "component")
        of = others.where("held > 2").select("key", "sid", "met", "n").join(roots, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        apart = of.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
        left = stored(of.join(apart, "key", "left_semi"), "jaccard-groups")
        discard(rest)
        rest = left.drop("component")
    links = links.unionByName(_linked_in_clusters(left, contents, hundredths))
    discard(left)
    return rows, components(links).select(F.col("node").alias("sid"), F.col("component").alias("root"))


def _touching(groups: DataFrame, contents: DataFrame, hundredths: int) -> DataFrame:
    """Pairs ``a, b`` of a key's sets from two components that sketches do not rule out: a spanning forest of them for each chunk.

    Groups of the very same sets count once.  Large groups are cut into chunks of ``GROUP_CHUNK`` sets; a set meets its own chunk
    and those before it.
    """
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "sid")).alias(f"x{i}") for i in (0, 1)]
    same = groups.groupBy("key").agg(F.count(F.lit(1)).alias("held"), *marks)
    once = same.groupBy("held", "x0", "x1").agg(F.min("key").alias("key")).select("key", "held")
    rows = groups.select("key", "sid", "n", "component").join(once, "key").join(contents.select("sid", "sketch"), "sid")
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.lit(3), "sid"), F.ceil(F.col("held") / GROUP_CHUNK)))
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.col("own")))
    dealt = rows.select("key", met.alias("chunk"), "own", "sid", "n", "component", "sketch").withColumn("role", (F.col("chunk") < F.col("own")).cast("int")).drop("own")
    dealt = dealt.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "role", "sid")
    return stored(dealt.mapInArrow(_touching_task(hundredths), "a long, b long"), "jaccard-touching")


def _linked_in_clusters(groups: DataFrame, contents: DataFrame, hundredths: int) -> DataFrame:
    """Links ``a, b`` that connect what is linked in the groups ``key, sid, n, component``, chunk by chunk, without listing pairs.

    Sets that touch by their sketches, directly or through others, are a cluster.  The sets of its largest component are connected already
    and meet only the others.  Sets are cut into chunks of ``CHUNK`` targets, that component's first; every other set meets its
    own chunk and those before it, in one of the chunk's copies.  A chunk counts common tokens by an index of its tokens
    and returns a spanning forest of the links it finds.
    """
    touch = components(_touching(groups, contents, hundredths)).select(F.col("node").alias("sid"), F.col("component").alias("cluster"))
    touch = touch.unionByName(touch.select(F.col("cluster").alias("sid"), "cluster").distinct())
    members = stored(groups.groupBy("sid").agg(F.first("component").alias("component")).join(touch, "sid"), "jaccard-clusters")
    held = members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("held"))
    sizes = held.groupBy("cluster").agg(F.max(F.struct("held", "component")).alias("lead"), F.sum("held").alias("total"))
    others = F.col("total") - F.col("lead.held")
    sizes = sizes.select("cluster", F.col("lead.component").alias("lead"), *[F.ceil(x).cast("long").alias(c) for c, x in (
        ("led", F.col("lead.held") / CHUNK), ("chunks", others / CHUNK), ("slices", others / SLICE))])
    spread = F.xxhash64(F.lit(1), "sid")
    placed = members.join(sizes, "cluster").withColumn("leads", F.col("component") == F.col("lead"))
    placed = placed.withColumn("own", F.when(F.col("leads"), F.pmod(spread, F.col("led"))).otherwise(F.col("led") + F.pmod(spread, F.col("chunks"))))
    placed = placed.join(_contents_of(members, contents), "sid").withColumn("part", F.pmod(F.xxhash64(F.lit(2), "sid"), F.col("slices")))
    zero = F.lit(0).cast("long")
    copies, met = F.explode(F.sequence(zero, F.col("slices") - 1)), F.explode(F.sequence(zero, F.col("own")))
    target = placed.select("cluster", F.col("own").alias("chunk"), copies.alias("slice"), F.lit(0).alias("role"), "sid", "tokens")
    probe = placed.where("not leads").select("cluster", met.alias("chunk"), F.col("part").alias("slice"), F.lit(1).alias("role"), "sid", "tokens")
    dealt = target.unionByName(probe).repartition("cluster", "chunk", "slice").sortWithinPartitions("cluster", "chunk", "slice", "role", "sid")
    return stored(dealt.mapInArrow(_clusters_task(hundredths), "a long, b long"), "jaccard-links")


class _Sketches:
    """Sets of one chunk of a group by their sketches; probes come in batches."""

    def __init__(self, hundredths: int) -> None:
        self.hundredths, self.held, self.forest = hundredths, [], None

    def add(self, *columns) -> None:
        """``sid, n, component`` as arrays and a list of sketches."""
        self.held.append(columns)

    def _close_targets(self) -> None:
        self.sid, self.n, self.component = (np.concatenate([x[i] for x in self.held]) for i in range(3))
        self.words = _words([y for x in self.held for y in x[3]])
        self.forest = Forest(len(self.sid))

    def meet(self, sid: np.ndarray, n: np.ndarray, component: np.ndarray, words: np.ndarray, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Probes that touch a target (``own``: one before them), and one such target each."""
        if self.forest is None:
            self._close_targets()
        width = min(words.shape[1], self.words.shape[1])
        probes, targets = _folded(words, width), _folded(self.words, width)
        step, a, b = max(1, SKETCH_PAIRS // len(targets)), [], []
        for at in range(0, len(probes), step):
            some = slice(at, at + step)
            near = component[some, None] != self.component[None, :]
            if own:
                near &= np.arange(len(probes))[some, None] > np.arange(len(targets))[None, :]
            differ = np.zeros(near.shape, np.int64)
            for w in range(width):
                differ += np.bitwise_count(probes[some, w, None] ^ targets[None, :, w])
            near &= (100 + self.hundredths) * differ <= (100 - self.hundredths) * (n[some, None] + self.n[None, :])
            probe, target = np.nonzero(near)
            first = self.forest.join(probe, target)
            a.append(sid[at + probe[first]])
            b.append(self.sid[target[first]])
        return np.concatenate(a), np.concatenate(b)

    def close(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.held:
            if self.forest is None:
                self._close_targets()
            yield self.meet(self.sid, self.n, self.component, self.words, own=True)
            node, root = self.forest.edges()
            yield self.sid[node], self.sid[root]


def _touching_task(hundredths: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, targets = None, _Sketches(hundredths)
        none = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

        def packed(found: list) -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*(none + found), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:  # sorted by key, chunk and role
            if not batch.num_rows:
                continue
            place = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "chunk", "role")]
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("sid", "n", "component")]
            sketches, found = batch.column("sketch").to_pylist(), []
            new = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in place], axis=0)])
            for at, to in zip(np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], batch.num_rows), strict=True):
                here = place[0][at], place[1][at]
                if here != key:
                    found += targets.close()
                    key, targets = here, _Sketches(hundredths)
                rows = [x[at:to].copy() for x in columns]
                if place[2][at] == 0:
                    targets.add(*rows, sketches[at:to])
                elif targets.held:  # else no set was dealt to this chunk
                    found.append(targets.meet(*rows, _words(sketches[at:to])))
            yield packed(found)
        yield packed(list(targets.close()))

    return run


class _Targets:
    """Sets of one chunk, indexed by token; probes come in batches."""

    def __init__(self, hundredths: int) -> None:
        self.hundredths, self.sid, self.sets, self.forest = hundredths, [], [], None

    def add(self, sid: int, tokens: np.ndarray) -> None:
        self.sid.append(sid)
        self.sets.append(tokens)

    def _index(self) -> None:
        self.sid, self.size = np.array(self.sid, np.int64), np.array([len(s) for s in self.sets])
        tokens, owner = np.concatenate(self.sets), np.repeat(np.arange(len(self.sets)), self.size)
        order = np.argsort(tokens, kind="stable")
        self.owner, tokens = owner[order], tokens[order]
        self.first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        self.token, self.times = tokens[self.first], np.diff(np.append(self.first, len(tokens)))
        self.forest = Forest(len(self.sid))

    def meet(self, sid: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Probes with a linked target, and one such target each."""
        if not len(self.sid):  # no set was dealt to this chunk
            return sid[:0], sid[:0]
        if self.forest is None:
            self._index()
        size = np.array([len(s) for s in sets])
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        at = np.minimum(np.searchsorted(self.token, tokens), len(self.token) - 1)
        here = np.flatnonzero(self.token[at] == tokens)
        at, owner = at[here], owner[here]
        times = self.times[at]
        ends = np.cumsum(times)
        flat = np.repeat(self.first[at] - ends + times, times) + np.arange(ends[-1] if len(ends) else 0)
        width = len(self.sid)
        common = np.bincount(np.repeat(owner, times) * width + self.owner[flat], minlength=len(sets) * width).reshape(len(sets), width)
        near = 100 * common >= self.hundredths * (size[:, None] + self.size[None, :] - common)
        probe, target = np.nonzero(near & (sid[:, None] != self.sid[None, :]))
        first = self.forest.join(probe, target)
        return sid[probe[first]], self.sid[target[first]]

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        if self.forest is None:
            return none, none
        node, root = self.forest.edges()
        return self.sid[node], self.sid[root]


def _clusters_task(hundredths: int):
    def packed(rows: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, targets = None, _Targets(hundredths)
        for batch in batches:  # sorted by cluster, chunk, slice and role
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("cluster", "chunk", "slice", "role", "sid")), strict=True))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("tokens")]
            at = 0
            while at < len(rows):
                if rows[at][:3] != key:
                    yield packed(targets.close())
                    key, targets = rows[at][:3], _Targets(hundredths)
                to, held = at, 0
                while to < len(rows) and rows[to][:4] == rows[at][:4] and (to == at or held < PROBE_TOKENS):
                    held += len(sets[to])
                    to += 1
                if rows[at][3] == 0:
                    for i in range(at, to):
                        targets.add(rows[i][4], sets[i].copy())
                else:
                    yield packed(targets.meet(np.array([r[4] for r in rows[at:to]], np.int64), sets[at:to]))
                at = to
        yield packed(targets.close())

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, hundredths: int = HUNDREDTHS) -> DataFrame:
    """``k1, k2, doc_id, n, root`` of every row; rows with equal ``root`` are connected by links (null: empty set)."""
    rows, roots = linked_sets(docs, id_col, text_col, ngram, hundredths)
    return stored(rows.join(roots, "sid", "left").select("k1", "k2", "doc_id", "n", F.coalesce("root", "sid").alias("root")), "jaccard-classes")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, hundredths: int = HUNDREDTHS) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (the least id reachable by links, itself included).

    Null and empty texts, and texts without words, have an empty set and are linked with nothing.  Rows with a
    null id take part; they never give a component its id unless all its ids are null.  Repeated rows are linked
    with each other.  Empty tables give an empty result; other columns are never read.
    """
    rows = classes(docs, id_col, text_col, ngram, hundredths)
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, hundredths: int = HUNDREDTHS) -> DataFrame:
    """Documents without near duplicates and the least of each group, with all their columns.

    Rows without words are linked with nothing and stay.
    """
    rows = classes(docs, id_col, text_col, ngram, hundredths)
    kept = rows.where("root is not null").groupBy("root").agg(F.min(F.struct("k1", "k2")).alias("at"), F.count(F.lit(1)).alias("rows"))
    gone = rows.join(kept, "root").where((F.col("k1") != F.col("at")["k1"]) | (F.col("k2") != F.col("at")["k2"])).select("k1", "k2")
    repeated = rows.where("root is not null").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("k1", "k2")
    return without(docs, gone, repeated.join(gone, ["k1", "k2"], "left_anti"), id_col, text_col)
