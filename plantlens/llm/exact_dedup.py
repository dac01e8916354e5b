"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Each step keeps only groups of two or more, so that full texts are hashed only where length and prefix
agree already.  Only lengths, hashes and ids are shuffled, never texts.  Counts are combined map-side and
joined back, so one group may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.llm.common import MAX_BROADCAST_KEYS, stored, text_keys, without

PREFIX_BYTES = 64


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_bytes: int = PREFIX_BYTES) -> DataFrame:
    """Groups of two or more equal texts: ``text_sha256, keep_id, group_size``.

    A null text counts as empty.  The row with the largest id stays; null ids count as smaller than any.
    Empty tables give an empty result; other columns are never read.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(id_col).alias("_id"), text.alias("_text"), F.octet_length(text).alias("_len"),
        F.xxhash64(F.substring(text, 1, prefix_bytes)).alias("_prefix"),
    )
    narrow = rows.select("_len", "_prefix")
    lengths = narrow.groupBy("_len").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_len")
    alike = narrow.join(lengths, "_len", "left_semi")
    keys = stored(alike.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_len", "_prefix"), "exact-keys")
    if keys.count() <= MAX_BROADCAST_KEYS:
        keys = F.broadcast(keys)
    survivors = rows.join(keys, ["_len", "_prefix"], "left_semi")
    full = survivors.select("_id", F.sha2(F.col("_text"), 256).alias("text_sha256"))
    return (
        full.groupBy("text_sha256").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_bytes: int = PREFIX_BYTES) -> DataFrame:
    """One row per document: ``<id>, keep_id, group_size, kept, text_sha256``.

    A text without a copy keeps itself.  Rows that repeat both id and text share one ``kept`` value: a
    caller that needs one physical row drops duplicates of the id afterwards (see ``drop_duplicates``).
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("_id"), F.sha2(text, 256).alias("text_sha256"))
    groups = stored(exact_groups(docs, id_col, text_col, prefix_bytes), "exact-groups")
    keep = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return rows.join(groups, "text_sha256", "left").select(
        F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose text has no copy, and of each group the row with the largest id; all columns stay.

    Ids and hashes are joined with the groups; only the keys of dropped rows meet the texts.  Rows that repeat the
    kept id and its text are reduced to one.
    """
    groups = stored(exact_groups(docs, id_col, text_col), "exact-groups")
    digest = F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")), 256)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), digest.alias("text_sha256"), *text_keys(docs, id_col, text_col))
    of_groups = stored(rows.join(groups, "text_sha256").select("k1", "k2", F.col("id").eqNullSafe(F.col("keep_id")).alias("stays")), "exact-members")
    gone = of_groups.where("not stays").select("k1", "k2")
    repeated = of_groups.where("stays").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2")
    return without(docs, gone, repeated, id_col, text_col)
