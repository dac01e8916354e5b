"""Pre-filling of cause branches and defect contexts from measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantlens.functions.vocab import FORM_BRANCHES
from plantlens.operators.clean import column_stats, numeric_columns, to_number
from plantlens.session import join_small


def out_of_target(parameters: DataFrame, targets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Parameters outside their target range, worded; parameters without a target are ignored.

    ``parameters``: keys, parameter, value; ``targets``: parameter, lo, hi.
    """
    joined = join_small(parameters, targets.select("parameter", "lo", "hi"), ["parameter"])
    shown = F.format_string("%.2f", F.col("value"))

    def worded(side: str, sign: str, bound: str) -> Column:
        return F.concat(
            F.col("parameter"), F.lit(f" {side} ("), shown, F.lit(f" {sign} "), F.col(bound).cast("string"), F.lit(")")
        )

    text = F.when(F.col("value") < F.col("lo"), worded("bas", "<", "lo")).when(
        F.col("value") > F.col("hi"), worded("haut", ">", "hi")
    )
    return joined.withColumn("suspect", text).where(F.col("suspect").isNotNull()).select(*keys, "parameter", "value", "suspect")


def atypical_lots(current: DataFrame, history: DataFrame, columns: Sequence[str], z_threshold: float = 2.0, keys: Sequence[str] = ()) -> DataFrame:
    """Parameters of current lots more than ``z_threshold`` sigmas off their history.

    ``current``: keys, parameter, value; ``history``: wide table of past lots (five values or
    more, not constant).
    """
    stats = column_stats(history, columns).where((F.col("n") >= 5) & (F.col("std") != 0))
    joined = join_small(current, stats.select("parameter", "mean", "std"), ["parameter"])
    z = F.abs((F.col("value") - F.col("mean")) / F.col("std"))
    hits = joined.withColumn("z", z).where(F.col("z") > z_threshold)
    text = F.format_string("Lot atypique sur %s (z=%.1f)", F.col("parameter"), F.col("z"))
    return hits.select(*keys, "parameter", "value", "z", text.alias("suspect"))


def last_values(df: DataFrame, order: Sequence[str], series: Sequence[str] = ()) -> DataFrame:
    """Numeric values of the last sample of every series, as ``series, parameter, value``."""
    columns = [c for c in numeric_columns(df) if c not in series]
    row = F.struct(*[to_number(df, c).alias(c) for c in columns])
    at = F.struct(*[F.col(o) for o in order], *[to_number(df, c) for c in columns])
    last = df.groupBy(*series).agg(F.max_by(row, at).alias("_l"))
    cells = F.array(*[F.struct(F.lit(c).alias("parameter"), F.col(f"_l.`{c}`").alias("value")) for c in columns])
    return (
        last.select(*series, F.explode(cells).alias("_c")).select(*series, "_c.*").where(F.col("value").isNotNull())
    )


def merge_contexts(contexts: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Contexts of several files merged: for the same parameter the later file wins."""
    merged = None
    for i, c in enumerate(contexts):
        part = c.select(*keys, "parameter", "value", F.lit(i).alias("_file"))
        merged = part if merged is None else merged.unionByName(part)
    return merged.groupBy(*keys, "parameter").agg(F.max_by("value", "_file").alias("value"))


def deviation_from_median(value: str, median: str) -> list[Column]:
    """Difference to the median, absolute and in percent (0 % for a zero median)."""
    delta = F.col(value) - F.col(median)
    return [
        delta.alias("delta"),
        F.when(F.col(median) != 0, delta / F.col(median) * 100).otherwise(F.lit(0.0)).alias("delta_pct"),
    ]


def branch_mode(column: str) -> Column:
    """How a branch of the cause form is filled; unknown branches are manual."""
    pairs = [F.lit(x) for kv in FORM_BRANCHES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.lit("manuel"))


def empty_form(spark) -> DataFrame:
    """The five branches of the cause form with no cause yet."""
    rows = [(b, m, []) for b, m in FORM_BRANCHES.items()]
    return spark.createDataFrame(rows, "branch string, mode string, causes array<string>")
