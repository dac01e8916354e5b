"""Shift (crew) comparison: stability scores and the Kruskal-Wallis test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.stats import chi2_p, nan_to_null
from plantlens.operators.clean import distinct_up_to, is_numeric_type, to_number
from plantlens.operators.ranks import average_ranks
from plantlens.session import join_small, materialize, named, null_safe_join

# Words that mark a shift column by name.
SHIFT_NAME_WORDS = ("shift", "shifts", "equipe", "team", "poste", "quart", "rotation")
MIN_SHIFTS, MAX_SHIFTS = 2, 8
MAX_LABEL_LENGTH = 15
MIN_VALUES_PER_SHIFT = 3
MEAN_FLOOR = 1e-12


def detect_shift_column(df: DataFrame) -> str | None:
    """A column named like a shift, or else the first text column with few short values."""
    fields = df.schema.fields
    distinct = distinct_up_to(df, df.columns, MAX_SHIFTS)
    profile = df.agg(
        *[F.max(F.length(named(f.name).cast("string"))).alias(f"_l{i}") for i, f in enumerate(fields)],
    ).first()

    def few(i):
        return MIN_SHIFTS <= distinct[fields[i].name] <= MAX_SHIFTS

    for i, f in enumerate(fields):
        if any(word in f.name.lower().strip() for word in SHIFT_NAME_WORDS) and few(i):
            return f.name
    for i, f in enumerate(fields):
        if not is_numeric_type(f.dataType) and few(i) and profile[f"_l{i}"] <= MAX_LABEL_LENGTH:
            return f.name
    return None


def _cells(df: DataFrame, shift: str, params: Sequence[str], series: Sequence[str]) -> DataFrame:
    wide = df.where(named(shift).isNotNull()).select(
        *series, named(shift).cast("string").alias("shift"),
        F.array(
            *[
                F.struct(F.lit(p).alias("parameter"), to_number(df, p).alias("value"))
                for p in params if p in df.columns
            ]
        ).alias("_c"),
    )
    return (
        wide.select(*series, "shift", F.explode("_c").alias("_p"))
        .select(*series, "shift", "_p.*")
        .where(F.col("value").isNotNull())
    )


def shift_stability(df: DataFrame, shift: str, params: Sequence[str], series: Sequence[str] = ()) -> DataFrame:
    """n, mean, std and coefficient of variation per shift and parameter."""
    stats = _cells(df, shift, params, series).groupBy(*series, "shift", "parameter").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
    )
    std = F.when(F.col("n") > 1, F.col("std")).otherwise(F.lit(0.0))
    cv = F.when(F.abs("mean") > MEAN_FLOOR, F.try_divide(std, F.abs("mean")))
    return stats.select(*series, "shift", "parameter", "n", "mean", std.alias("std"), cv.alias("cv"))


def compare_shifts(df: DataFrame, shift: str, params: Sequence[str], series: Sequence[str] = ()) -> DataFrame:
    """Kruskal-Wallis H per parameter over shifts with at least three values, tie-corrected.

    Works on the (value, shift) contingency counts, so ties and hot values collapse before the
    ranks are built; the ranks themselves come from a distributed running total.
    """
    keys = [*series, "parameter"]
    counted = materialize(
        _cells(df, shift, params, series).groupBy(*keys, "shift", "value").agg(F.count(F.lit(1)).alias("c"))
    )
    sizes = counted.groupBy(*keys, "shift").agg(F.sum("c").alias("_n")).where(F.col("_n") >= MIN_VALUES_PER_SHIFT)
    kept = join_small(counted, sizes, [*keys, "shift"])
    values = kept.groupBy(*keys, "value").agg(F.sum("c").alias("cnt"))
    ranks = materialize(average_ranks(values, keys, "value"))
    ranked = null_safe_join(kept, ranks.select(*keys, "value", "rank"), [*keys, "value"])
    sums = ranked.groupBy(*keys, "shift").agg(F.sum(F.col("c") * F.col("rank")).alias("_r"), F.sum("c").alias("_n"))
    groups = sums.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_shifts"), F.sum("_n").alias("_total"),
        F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_s"),
    )
    cnt = F.col("cnt").cast("double")
    ties = ranks.groupBy(*keys).agg(F.sum(cnt * cnt * cnt - cnt).alias("_t"))
    joined = null_safe_join(groups, ties, keys)
    total = F.col("_total").cast("double")
    h = F.lit(12.0) / (total * (total + 1)) * F.col("_s") - 3 * (total + 1)
    correction = 1 - F.col("_t") / (total * total * total - total)
    h = F.when((F.col("n_shifts") >= 2) & (correction > 0), h / F.nullif(correction, F.lit(0.0)))
    every = counted.groupBy(*keys).agg(F.count_distinct("shift").alias("_shifts"))
    table = null_safe_join(every, joined.withColumn("h_statistic", h), keys, "left").select(
        *keys, F.coalesce("n_shifts", F.lit(0)).alias("n_shifts"), "h_statistic",
    )
    p = nan_to_null(chi2_p(F.col("h_statistic"), (F.col("n_shifts") - 1).cast("double")))
    return table.withColumn("p_value", p).withColumn(
        "significatif_5pct", F.coalesce(F.col("p_value") < 0.05, F.lit(False))
    )
