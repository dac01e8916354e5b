"""Ordered series without an unbounded window.

A control chart needs every sample's place in its series, and a single series may hold a
large part of all rows.  ``Window.partitionBy(series)`` would put that series into one task,
so the order is built differently:

1. range-partition and sort the rows by (series, order key) and materialise them, which
   fixes each row's partition;
2. count rows per (series, partition) -- a tiny table -- and turn the counts into offsets;
3. position = offset + place inside the partition.

Positions then cut every series into blocks of equal size, and later windows run per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plantlens.session import join_small, materialize, named

# Smallest block: with its halo it stays under the 4096 rows a window keeps in its plain row
# buffer.  Longer series use longer blocks, so that one series has at most MAX_BLOCKS of them and
# its block table (one small row each) stays a light task.
MIN_BLOCK_ROWS = 4_000
MAX_BLOCKS = 1_000_000

_UNBOUNDED = Window.unboundedPreceding


def _sorted_and_frozen(df: DataFrame, series: list[str], order: list[str]) -> DataFrame:
    """Globally sort by (series, order, rest of the row); add ``_uid`` growing in that order.

    Range bounds are sampled on series, order and the rest up to its first text, of which 32 characters count: whole
    texts never reach the driver, and rows that agree in that much are sorted inside one partition.
    """
    sortable = {
        f.name
        for f in df.schema.fields
        if f.dataType.typeName() not in ("map", "variant")
    }
    rest = sorted(c for c in df.columns if c in sortable and c not in (*series, *order))
    bounds = [named(c) for c in (*series, *order)]
    for c in rest:
        kind = df.schema[c].dataType
        if not isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            bounds += [F.substring(named(c), 1, 32)] if isinstance(kind, T.StringType) else []
            break
        bounds.append(named(c))
    ranged = df.repartitionByRange(*bounds).sortWithinPartitions(*[named(c) for c in (*series, *order, *rest)])
    return materialize(ranged.withColumn("_uid", F.monotonically_increasing_id()))


def _partition_of(uid: str) -> Column:
    return F.shiftright(F.col(uid), 33)


def with_positions(
    df: DataFrame,
    series: Sequence[str],
    order: Sequence[str],
    stats_of: Sequence[str] = (),
    min_block_rows: int = MIN_BLOCK_ROWS,
) -> DataFrame:
    """Add ``pos`` (0-based place in the series), ``n``, ``block_rows`` and ``block``.

    ``stats_of`` names value columns whose series mean and sample standard deviation are
    added as ``mean_<c>`` and ``std_<c>``; they are merged from per-partition moments in the
    same pass that counts the rows.  Ties in ``order`` are broken by the rest of the row.
    """
    series, order = list(series), list(order)
    marker = not series
    if marker:
        df, series = df.withColumn("_all", F.lit(0)), ["_all"]
    frozen = _sorted_and_frozen(df, series, order).withColumn("_pid", _partition_of("_uid"))

    aggs = [F.min("_uid").alias("_first"), F.count(F.lit(1)).alias("_rows")]
    for c in stats_of:
        aggs += [
            F.count(c).alias(f"_n_{c}"),
            F.avg(c).alias(f"_avg_{c}"),
            F.var_pop(c).alias(f"_var_{c}"),
        ]
    runs = frozen.groupBy(*series, "_pid").agg(*aggs)

    whole = Window.partitionBy(*series)
    before = whole.orderBy("_pid").rowsBetween(_UNBOUNDED, -1)
    runs = runs.select(
        "*",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"),
        F.sum("_rows").over(whole).alias("n"),
    )
    for c in stats_of:
        runs = runs.withColumn(
            f"mean_{c}",
            F.sum(F.col(f"_avg_{c}") * F.col(f"_n_{c}")).over(whole)
            / F.nullif(F.sum(f"_n_{c}").over(whole), F.lit(0)),
        )
    for c in stats_of:
        spread = F.col(f"_n_{c}") * (
            F.col(f"_var_{c}") + F.pow(F.col(f"_avg_{c}") - F.col(f"mean_{c}"), 2)
        )
        count = F.sum(f"_n_{c}").over(whole)
        runs = runs.withColumn(
            f"std_{c}",
            F.when(count > 1, F.sqrt(F.sum(spread).over(whole) / (count - 1))).otherwise(
                F.when(count == 1, F.lit(0.0))
            ),
        )
    keep = [*series, "_pid", "_first", "_base", "n"]
    keep += [f"{p}_{c}" for c in stats_of for p in ("mean", "std")]
    block_rows = F.greatest(
        F.lit(min_block_rows).cast("long"),
        F.ceil(F.col("n") / F.lit(float(MAX_BLOCKS))).cast("long"),
    )
    placed = join_small(frozen, runs.select(*keep), [*series, "_pid"])
    placed = placed.withColumn("pos", F.col("_base") + F.col("_uid") - F.col("_first"))
    placed = placed.withColumn("block_rows", block_rows)
    placed = placed.withColumn("block", F.floor(F.col("pos") / F.col("block_rows")))
    drop = ["_uid", "_pid", "_first", "_base"] + (["_all"] if marker else [])
    return placed.drop(*drop)


def to_points(
    df: DataFrame,
    parameters: Sequence[str],
    series: Sequence[str] = (),
    order: Sequence[str] = (),
    missing: str = "any",
    min_block_rows: int = MIN_BLOCK_ROWS,
) -> DataFrame:
    """Unpivot a wide measurement table into ordered points, one row per sample and parameter.

    Returns ``series..., parameter, pos, n, block_rows, block, value, mean, std``.
    ``missing="any"`` drops samples with a gap in any parameter (the order is built once on
    the wide rows, before the fan-out); ``"each"`` drops gaps per parameter.
    """
    series, order, parameters = list(series), list(order), list(parameters)
    base = df.select(
        *series,
        *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
        *[named(p).cast("double").alias(f"_v{i}") for i, p in enumerate(parameters)],
    )
    values = [f"_v{i}" for i in range(len(parameters))]
    orders = [f"_o{i}" for i in range(len(order))]
    for v in values:
        base = base.withColumn(v, F.when(~F.isnan(v), F.col(v)))
    out = [*series, "parameter", "pos", "n", "block_rows", "block", "value", "mean", "std"]
    if missing == "any":
        wide = with_positions(base.dropna("any", subset=values), series, orders, values, min_block_rows)
        points = wide.select(
            *series, "pos", "n", "block_rows", "block",
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(p).alias("parameter"),
                            F.col(v).alias("value"),
                            F.col(f"mean_{v}").alias("mean"),
                            F.col(f"std_{v}").alias("std"),
                        )
                        for p, v in zip(parameters, values)
                    ]
                )
            ).alias("_p"),
        ).select(*series, "pos", "n", "block_rows", "block", "_p.*")
        return points.select(*out)
    points = base.select(
        *series, *orders,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(p).alias("parameter"), F.col(v).alias("value"))
                    for p, v in zip(parameters, values)
                ]
            )
        ).alias("_p"),
    ).select(*series, *orders, "_p.*").where(F.col("value").isNotNull())
    placed = with_positions(points, [*series, "parameter"], orders, ["value"], min_block_rows)
    return placed.withColumnsRenamed({"mean_value": "mean", "std_value": "std"}).select(*out)


def with_halo(points: DataFrame, rows: int) -> DataFrame:
    """Copy the last ``rows`` samples of every block in front of the next one.

    Adds ``own``: false for the copies.  A rule that looks back at most ``rows`` samples can
    then be evaluated block by block, and counted over ``own`` rows only.
    """
    tail = (F.col("pos") % F.col("block_rows")) >= F.col("block_rows") - rows
    follows = (F.col("block") + 1) * F.col("block_rows") < F.col("n")
    home = F.col("block")
    copies = points.withColumn(
        "_b", F.explode(F.when(tail & follows, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    return copies.select(
        *[c for c in points.columns if c != "block"],
        F.col("_b").alias("block"),
        (F.col("_b") == home).alias("own"),
    )


def previous_in_series(df: DataFrame, series: Sequence[str], order: Sequence[str], column: str, out: str) -> DataFrame:
    """Add ``out`` = ``column`` of the sample before, along the series; blocks carry one row over."""
    keys = list(series)
    copies = with_halo(with_positions(df, series, order, (), 1024), 1)
    before = F.lag(column).over(Window.partitionBy(*keys, "block").orderBy("pos"))
    filled = copies.withColumn(out, before).where("own")
    return filled.drop("own", "pos", "n", "block", "block_rows")


def running_total(
    df: DataFrame, series: Sequence[str], order: Sequence[str], amount: str, out: str
) -> DataFrame:
    """Add ``out`` = sum of ``amount`` over strictly earlier rows of the series.

    ``(series, order)`` should be unique (pre-aggregate first).  Same scheme as positions:
    in-partition running sum plus the totals of the earlier partitions.
    """
    series, order = list(series), list(order)
    frozen = _sorted_and_frozen(df, series, order).withColumn("_pid", _partition_of("_uid"))
    runs = frozen.groupBy(*series, "_pid").agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*series).orderBy("_pid").rowsBetween(_UNBOUNDED, -1)
    runs = runs.select(
        *series, "_pid", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")
    )
    inside = Window.partitionBy(*series, "_pid").orderBy("_uid").rowsBetween(_UNBOUNDED, -1)
    return (
        join_small(frozen, runs, [*series, "_pid"])
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .drop("_uid", "_pid", "_base")
    )
