"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets: sources share ``share`` times all words by weight; none gets more than ``most`` times its own
   size, and what is cut off is shared again by weight.  This is one pass over sources ordered by
   cap / weight, because the capped sources come first in that order.
2. Blocks: documents of a source fall into blocks by hash; a target is so many whole passes over the
   source plus a part of one, and the part takes whole blocks in permuted order.  Of the block that the
   target cuts, documents are taken in permuted order as long as they fit.
3. Splitting tree: the blocks to draw of all sources are split between the two halves of the output shards by
   a multivariate hypergeometric draw, and so on down to single shards; each shard then draws the next
   blocks of the permutation, so draws are disjoint.
4. Each shard shuffles its documents locally.

All sums by source or block are combined map-side; no window ever holds more rows of a source than its blocks
times its passes (``MAX_BLOCKS`` and two).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plantlens.llm.common import Words, small_batches, stored, text_groups

WEIGHTS = (5, 2, 1)
DOCS_PER_BLOCK = 512
MAX_BLOCKS = 4096
WORDS_PER_SHARD = 1 << 28


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [Words(data, offsets).count for _, data, offsets in text_groups(batch)]
        size = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("k1"), batch.column("k2"), batch.column("doc_id"), batch.column("source"), pa.array(size, pa.int64())],
            names=["k1", "k2", "doc_id", "source", "size"],
        )


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``k1, k2, doc_id, source, size`` of every row; size is the number of words (null text: 0)."""
    small_batches(docs.sparkSession)
    source = F.col(source_col).cast("string").alias("source")
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), source)
    id_, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = plain.select(
        F.coalesce(id_, F.lit(-1)).alias("k1"), F.xxhash64(id_.isNull(), text).alias("k2"), id_.alias("doc_id"), "source", text.alias("text")
    )
    return rows.mapInArrow(_count_words, "k1 long, k2 long, doc_id long, source string, size long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, docs, target`` from ``source, source_size, docs`` (one row per source).

    Sources are ordered by code point, null last, and take the weights in turn.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    ranked = sizes.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    scanned = ranked.withColumn("level", level)
    ratio = F.col("cap") / F.col("weight")
    first_open = F.min(F.when(F.col("level") <= ratio, F.struct(ratio.alias("ratio"), F.col("source").isNull().alias("last"), "source", "level"))).over(everything)
    open_level = first_open["level"]
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("lambda"), F.col("cap")))
    return scanned.withColumn("lambda", open_level).select("source", "source_size", "docs", target.alias("target"))


def split_quotas(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Split block counts of sources among shards: an array (shards, sources) whose columns sum to ``counts``.

    Every node of the tree hands its left half a multivariate hypergeometric draw of its blocks, so
    shards differ in size by one block at most and each holds a fair random share of every source.
    """
    out = np.zeros((shards, len(counts)), np.int64)
    todo = [(0, shards, np.asarray(counts, np.int64))]
    while todo:
        first, n, have = todo.pop()
        if n == 1:
            out[first] = have
            continue
        half, total = n // 2, int(have.sum())
        take = total * half // n
        rng = np.random.default_rng([seed, first, n])
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if total else have
        todo += [(first, half, left), (first + half, n - half, have - left)]
    return out


def _greedy(columns: list[str]):
    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["turn", "k1", "k2"])
        left, taken = float(rows["gap"].iloc[0]), []
        for weight in rows["weight"]:
            fits = weight <= left
            left -= weight if fits else 0
            taken.append(int(fits))
        return rows.assign(part=taken)[columns]

    return pick


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5, most: float = 2.0, seed: int = 7, docs_per_block: int = DOCS_PER_BLOCK,
) -> DataFrame:
    """One row per distinct document row: ``k1, k2, doc_id, source, copies, size, source_size, target, times, block``.

    ``times`` is how often the mix draws the row (every one of its ``copies``).  A null text has size 0; a null
    source is a source of its own.  Rows that agree in id, text and source are drawn together.  Empty tables
    give an empty result.  The same seed gives the same mix.
    """
    rows = sized(docs, id_col, text_col, source_col)
    items = stored(
        rows.groupBy("k1", "k2", "source").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.count(F.lit(1)).alias("copies"))
        .withColumn("s", _key(F.col("source"))).withColumn("weight", F.col("size") * F.col("copies")), "mix-items",
    )
    sizes = items.groupBy("source").agg(F.sum("weight").alias("source_size"), F.sum("copies").alias("docs"))
    plan = targets(sizes, weights, share, most)
    blocks = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("docs") / docs_per_block)))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.select(
        _key(F.col("source")).alias("s"), "source_size", "target", blocks.cast("long").alias("blocks"), whole.cast("long").alias("whole"),
        (F.col("target") - whole * F.col("source_size")).alias("quota"),
    )
    plan = stored(plan, "mix-plan")
    placed = items.join(plan.select("s", "blocks"), "s").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "k1", "k2"), F.col("blocks")))
    table = placed.groupBy("s", "block").agg(F.sum("weight").alias("words")).join(plan.select("s", "quota"), "s")
    turn = Window.partitionBy("s").orderBy(F.xxhash64(F.lit(seed + 1), "s", "block"), "block")
    table = table.withColumn("upto", F.sum("words").over(turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    some = F.col("quota") > 0
    first_cut = F.min(F.when(some & (F.col("upto") > F.col("quota")), F.struct("upto", "block"))).over(Window.partitionBy("s"))
    table = table.withColumn("cut", first_cut["block"])
    table = stored(table.select(
        "s", "block", (some & (F.col("upto") <= F.col("quota"))).cast("int").alias("drawn"), F.col("block").eqNullSafe(F.col("cut")).alias("at_cut"),
        (F.col("quota") - F.col("upto") + F.col("words")).alias("gap"),
    ), "mix-blocks")
    joined = placed.join(table, ["s", "block"])
    kept = ["k1", "k2", "s", "doc_id", "source", "size", "copies", "block"]
    simple = joined.where(~F.col("at_cut")).select(*kept, F.col("drawn").alias("part"))
    cut = joined.where("at_cut").withColumn("turn", F.xxhash64(F.lit(seed + 2), "k1", "k2"))
    types = {f.name: f.dataType.simpleString() for f in joined.schema}
    picked = cut.groupBy("s").applyInPandas(_greedy([*kept, "part"]), ", ".join(f"{c} {types[c]}" for c in kept) + ", part int")
    return simple.unionByName(picked).join(plan.select("s", "source_size", "target", "whole"), "s").select(
        "k1", "k2", "doc_id", "source", "copies", "size", "source_size", "target", (F.col("whole") + F.col("part")).alias("times"), "block"
    )


def _shards_of_quotas(words_per_shard: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"s": pd.Series(dtype=str), "draws": [], "words": []}), *batches]).sort_values("s")
        if not len(rows):
            return
        shards = max(1, int(rows["words"].sum() // words_per_shard))
        quotas = split_quotas(rows["draws"].to_numpy(np.int64), shards, seed)
        first = np.cumsum(quotas, axis=0) - quotas
        for shard in range(shards):
            yield pd.DataFrame({"s": rows["s"].to_numpy(), "shard": shard, "first": first[shard], "n": quotas[shard]})

    return run


def with_shards(mix: DataFrame, words_per_shard: int = WORDS_PER_SHARD, seed: int = 7) -> DataFrame:
    """Rows of ``mixed`` that are drawn, once per draw, with ``turn`` (1 or 2), ``shard`` and ``place`` in the shard.

    A block drawn in a pass is one draw.  The summary that the tree splits has one row per source.
    """
    drawn = mix.where("times > 0").withColumn("s", _key(F.col("source"))).withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    blocks = drawn.groupBy("s", "turn", "block").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    order = Window.partitionBy("s").orderBy(F.xxhash64(F.lit(seed + 3), "s", "turn", "block"), "turn", "block")
    blocks = stored(blocks.withColumn("draw", F.row_number().over(order) - 1), "mix-draws")
    quotas = blocks.groupBy("s").agg(F.count(F.lit(1)).alias("draws"), F.sum("words").alias("words"))
    ranges = quotas.repartition(1).mapInPandas(_shards_of_quotas(words_per_shard, seed), "s string, shard int, first long, n long")
    each = ranges.where("n > 0").select("s", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("draw"))
    of_block = blocks.join(each, ["s", "draw"]).select("s", "turn", "block", "shard")
    return drawn.join(of_block, ["s", "turn", "block"]).withColumn("place", F.xxhash64(F.lit(seed + 4), "k1", "k2", "turn")).drop("s")


def drawn_words(docs: DataFrame, words_per_shard: int = WORDS_PER_SHARD, seed: int = 7, **options) -> DataFrame:
    """Rows of ``mixed`` with ``taken``: the words of the row times its draws in the shards (0: in no shard)."""
    mix = stored(mixed(docs, seed=seed, **options), "mix").withColumn("s", _key(F.col("source")))
    draws = with_shards(mix, words_per_shard, seed).groupBy("k1", "k2", _key(F.col("source")).alias("s")).agg(F.count(F.lit(1)).alias("draws"))
    return mix.join(draws, ["k1", "k2", "s"], "left").withColumn("taken", F.col("size") * F.coalesce("draws", F.lit(0).cast("long"))).drop("s", "draws")


def _in_shards(docs: DataFrame, id_col: str, text_col: str, source_col: str, words_per_shard: int, seed: int, options: dict) -> DataFrame:
    """``row, shard, place``: every drawn row once per draw, shard after shard and shuffled by place in each.

    The order runs over the partitions of the result, so a shard may be many tasks.
    """
    mix = stored(mixed(docs, id_col, text_col, source_col, seed=seed, **options), "mix")
    drawn = stored(with_shards(mix, words_per_shard, seed).select("k1", "k2", _key(F.col("source")).alias("s"), "shard", "place"), "mix-places")
    names = docs.columns
    id_, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(id_, F.lit(-1)).alias("k1"), F.xxhash64(id_.isNull(), text).alias("k2"),
        _key(F.col(f"`{source_col}`").cast("string")).alias("s"),
    )
    placed = rows.join(drawn, ["k1", "k2", "s"]).select("row", "shard", "place")
    return placed.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")


def write_mix(
    docs: DataFrame, path: str, words_per_shard: int = WORDS_PER_SHARD, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", **options,
) -> None:
    """Write the mixed documents as Parquet, one folder per shard, locally shuffled."""
    _in_shards(docs, id_col, text_col, source_col, words_per_shard, seed, options).select("row.*", "shard").write.partitionBy("shard").parquet(path)


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", words_per_shard: int = WORDS_PER_SHARD,
    seed: int = 7, **options,
) -> DataFrame:
    """The mixed table itself, shard after shard and shuffled in each: the columns of ``docs``, each drawn row as often as it is drawn."""
    return _in_shards(docs, id_col, text_col, source_col, words_per_shard, seed, options).select("row.*")
