"""Slow-drift detection: EWMA and CUSUM charts as block-wise scans."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantlens.functions.spc_values import (
    CUSUM_DECISION,
    CUSUM_SLACK,
    EWMA_LAMBDA,
    EWMA_WIDTH,
    MIN_POINTS_DRIFT,
    SIGMA_FLOOR,
)
from plantlens.operators.clean import numeric_columns
from plantlens.operators.ordered import MIN_BLOCK_ROWS, to_points
from plantlens.session import materialize, null_safe_join

# In-block weights reach decay ** -block; this keeps them far inside the double range.
_MAX_LOG_WEIGHT = 230.0
# decay ** block below this is nothing next to double precision: only the previous block counts.
_NEGLIGIBLE_LOG = 80.0
_SMOOTHING_BLOCK = 65_536


def exponential_scan(rows: DataFrame, keys: Sequence[str], decay: float, out: str) -> DataFrame:
    """Add ``out`` with out[0] = input[0], out[i] = decay * out[i-1] + input[i].

    Needs ``pos`` (0-based, dense per key) and ``input``.  Each block of fixed length is summed
    with weights decay^-offset; what enters a block is the value at the end of the one before.
    When decay^block vanishes that is the previous block's own sum, otherwise the block ends
    form a shorter series of the same kind and are scanned the same way.
    """
    keys = list(keys)
    if decay <= 0.0:
        return rows.withColumn(out, F.col("input"))
    rate = -math.log(decay)
    block = _SMOOTHING_BLOCK if rate == 0 else max(2, min(_SMOOTHING_BLOCK, int(_MAX_LOG_WEIGHT / rate)))
    cut = rows.withColumn("_m", F.floor(F.col("pos") / F.lit(block))).withColumn(
        "_off", F.col("pos") - F.col("_m") * block
    )
    weighted = F.col("input") * F.pow(F.lit(decay), -F.col("_off"))
    last = F.pow(F.lit(decay), F.lit(float(block - 1)))
    ends = cut.groupBy(*keys, "_m").agg((F.sum(weighted) * last).alias("input"))
    if rate * block >= _NEGLIGIBLE_LOG:
        ends = ends.withColumnRenamed("input", "_carry")
    else:
        ends = exponential_scan(
            ends.withColumnRenamed("_m", "pos"), keys, decay**block, "_end"
        ).select(*keys, F.col("pos").alias("_m"), F.col("_end").alias("_carry"))
    entering = ends.withColumn("_m", F.col("_m") + 1)
    w = Window.partitionBy(*keys, "_m").orderBy("_off").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.sum(weighted).over(w)
    summed = cut.withColumn("_inside", inside)
    joined = null_safe_join(summed, entering, [*keys, "_m"], "left")
    value = F.pow(F.lit(decay), F.col("_off")) * (
        F.col("_inside") + F.lit(decay) * F.coalesce(F.col("_carry"), F.lit(0.0))
    )
    return joined.withColumn(out, value).drop("_m", "_off", "_inside", "_carry")


def _usable():
    return (F.col("n") >= MIN_POINTS_DRIFT) & (F.col("std") >= SIGMA_FLOOR)


def _reason():
    return (
        F.when(F.col("n") < MIN_POINTS_DRIFT, F.concat(F.lit("n="), F.col("n").cast("string"), F.lit(" < 10")))
        .when(F.col("std") < SIGMA_FLOOR, F.lit("ecart-type nul (serie constante)"))
        .otherwise(F.lit(""))
    )


def ewma_points(points: DataFrame, keys: Sequence[str], lam: float = EWMA_LAMBDA, width: float = EWMA_WIDTH) -> DataFrame:
    """EWMA chart per sample: starts at the mean, ignores the first value, asymptotic limits."""
    fed = points.where(_usable()).withColumn(
        "input", F.when(F.col("pos") == 0, F.col("mean")).otherwise(F.lit(lam) * F.col("value"))
    )
    half = F.lit(width * math.sqrt(lam / (2 - lam))) * F.col("std")
    charted = exponential_scan(fed, keys, 1.0 - lam, "ewma").drop("input")
    return charted.select(
        "*", (F.col("mean") - half).alias("lcl"), (F.col("mean") + half).alias("ucl")
    ).withColumn("signal", (F.col("ewma") > F.col("ucl")) | (F.col("ewma") < F.col("lcl")))


def ewma(points: DataFrame, keys: Sequence[str], lam: float = EWMA_LAMBDA, width: float = EWMA_WIDTH) -> DataFrame:
    """One row per series: violations, first violating index, validity and reason."""
    keys = list(keys)
    charted = ewma_points(points, keys, lam, width)
    hits = charted.groupBy(*keys).agg(
        F.count_if("signal").alias("_hits"),
        F.min(F.when(F.col("signal"), F.col("pos"))).alias("_first"),
    )
    return _with_validity(points, keys, hits, {"ewma_violations": "_hits"}, "ewma_first_idx", "ewma")


def cusum_points(points: DataFrame, keys: Sequence[str], slack: float = CUSUM_SLACK, decision: float = CUSUM_DECISION) -> DataFrame:
    """Two-sided CUSUM per sample, reset at zero, first sample zero.

    Inside a block, with s the running sum of increments, C = max(entering + s, s - min(0, s..)).
    A block therefore acts on what enters it as x -> max(x + a, b); the value entering block m
    follows from the (a, b) of the earlier blocks by a running sum and a running maximum.
    """
    keys = list(keys)
    k = F.lit(slack) * F.col("std")
    fed = points.where(_usable()).withColumns(
        {
            "_up": F.when(F.col("pos") == 0, 0.0).otherwise(F.col("value") - F.col("mean") - k),
            "_down": F.when(F.col("pos") == 0, 0.0).otherwise(F.col("mean") - k - F.col("value")),
        }
    )
    w = Window.partitionBy(*keys, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    fed = fed.withColumns({"_su": F.sum("_up").over(w), "_sd": F.sum("_down").over(w)})
    fed = fed.withColumns(
        {
            "_bu": F.col("_su") - F.least(F.lit(0.0), F.min("_su").over(w)),
            "_bd": F.col("_sd") - F.least(F.lit(0.0), F.min("_sd").over(w)),
        }
    )
    fed = materialize(fed)  # read twice: block summary, then the samples themselves
    blocks = fed.groupBy(*keys, "block").agg(
        *[F.max_by(c, "pos").alias(c) for c in ("_su", "_sd", "_bu", "_bd")]
    )
    upto = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumns({"_au": F.sum("_su").over(upto), "_ad": F.sum("_sd").over(upto)})
    leaving = {
        f"_c{s}": F.col(f"_a{s}") + F.greatest(F.lit(0.0), F.max(F.col(f"_b{s}") - F.col(f"_a{s}")).over(upto))
        for s in ("u", "d")
    }
    entering = blocks.withColumns(leaving).select(*keys, (F.col("block") + 1).alias("block"), "_cu", "_cd")
    joined = null_safe_join(fed, entering, [*keys, "block"], "left")
    none = F.lit(0.0)
    out = joined.withColumns(
        {
            "c_plus": F.greatest(F.coalesce("_cu", none) + F.col("_su"), F.col("_bu")),
            "c_minus": F.greatest(F.coalesce("_cd", none) + F.col("_sd"), F.col("_bd")),
        }
    )
    h = F.lit(decision) * F.col("std")
    return out.withColumns({"up": F.col("c_plus") > h, "down": F.col("c_minus") > h}).drop(
        "_up", "_down", "_su", "_sd", "_bu", "_bd", "_cu", "_cd"
    )


def cusum(points: DataFrame, keys: Sequence[str], slack: float = CUSUM_SLACK, decision: float = CUSUM_DECISION) -> DataFrame:
    """One row per series: signals up and down, first signalling index, validity and reason."""
    keys = list(keys)
    charted = cusum_points(points, keys, slack, decision)
    hits = charted.groupBy(*keys).agg(
        F.count_if("up").alias("_up"),
        F.count_if("down").alias("_down"),
        F.min(F.when(F.col("up") | F.col("down"), F.col("pos"))).alias("_first"),
    )
    names = {"cusum_signal_up": "_up", "cusum_signal_down": "_down"}
    return _with_validity(points, keys, hits, names, "cusum_first_idx", "cusum")


def _with_validity(points, keys, hits, counts, first_name, prefix):
    """Left-join the counts to all series, so that unusable ones are reported with a reason."""
    every = points.groupBy(*keys).agg(F.max("n").alias("n"), F.max("std").alias("std"))
    joined = null_safe_join(every, hits, list(keys), "left")
    return joined.select(
        *keys,
        *[F.coalesce(F.col(src), F.lit(0)).alias(dst) for dst, src in counts.items()],
        F.col("_first").alias(first_name),
        _usable().alias(f"{prefix}_valid"),
        _reason().alias(f"{prefix}_reason"),
    )


def detect_drift(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    series: Sequence[str] = (),
    order: Sequence[str] = (),
    min_block_rows: int = MIN_BLOCK_ROWS,
) -> DataFrame:
    """EWMA and CUSUM for every numeric column of every series; gaps are dropped per column."""
    columns = list(columns or [c for c in numeric_columns(df) if c not in (*series, *order)])
    points = to_points(df, columns, series, order, "each", min_block_rows)
    keys = [*series, "parameter"]
    both = null_safe_join(ewma(points, keys), cusum(points, keys), keys)
    return _drift_rows(both, keys, df, columns, series)


def _drift_rows(both, keys, df, columns, series):
    if not series:
        # a column with no value at all still gets its row
        names = df.sparkSession.createDataFrame([(c,) for c in columns], "parameter string")
        both = names.join(both, "parameter", "left").na.fill(0).na.fill(
            "n=0 < 10", ["ewma_reason", "cusum_reason"]
        ).na.fill(False)
        # an index that does not exist stays missing
        none = F.lit(None).cast("long")
        both = both.withColumns(
            {
                "ewma_first_idx": F.when(F.col("ewma_violations") > 0, F.col("ewma_first_idx")).otherwise(none),
                "cusum_first_idx": F.when(
                    (F.col("cusum_signal_up") > 0) | (F.col("cusum_signal_down") > 0), F.col("cusum_first_idx")
                ).otherwise(none),
            }
        )
    return both.select(
        *keys, "ewma_violations", "cusum_signal_up", "cusum_signal_down", "ewma_first_idx", "cusum_first_idx",
        (
            (F.col("ewma_violations") > 0) | (F.col("cusum_signal_up") > 0) | (F.col("cusum_signal_down") > 0)
        ).alias("drift_detected"),
        F.concat_ws(
            " | ",
            F.when(~F.col("ewma_valid"), F.concat(F.lit("EWMA: "), F.col("ewma_reason"))),
            F.when(~F.col("cusum_valid"), F.concat(F.lit("CUSUM: "), F.col("cusum_reason"))),
        ).alias("reason"),
    )
