"""Column selection, numeric coercion and per-column statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantlens.session import named

# A plain decimal number; Spark's own cast would also take '12d' or 'NaN'.
NUMBER_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def is_numeric_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_datetime_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def to_number(df: DataFrame, column: str) -> Column:
    """Coerce a column to double; text that is no number, and NaN, become NULL."""
    dtype = df.schema[column].dataType
    c = named(column)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if is_numeric_type(dtype) or isinstance(dtype, T.BooleanType):
        return c.cast("double")
    if isinstance(dtype, T.StringType):
        return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))
    return F.lit(None).cast("double")


@dataclass
class Cleaned:
    """Cleaned rows and the columns left out because they hold too few numbers."""

    rows: DataFrame
    kept: list[str]
    dropped: list[str]


def clean_data(
    df: DataFrame,
    columns: Sequence[str],
    min_valid_ratio: float = 0.05,
    carry: Sequence[str] = (),
) -> Cleaned:
    """Keep numeric columns, drop sparse ones first, then rows with any gap.

    Dropping sparse columns before the rows keeps one dead sensor from erasing the table.
    ``carry`` columns (series and order keys) pass through untouched.
    """
    if not columns:
        raise ValueError("Aucune colonne selectionnee.")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"Colonnes absentes : {missing}")
    numeric = df.select(*carry, *[to_number(df, c).alias(c) for c in columns])
    valid = numeric.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(named(c)).alias(f"_valid{i}") for i, c in enumerate(columns)],
    ).first()
    total = max(valid["_rows"], 1)
    kept = [c for i, c in enumerate(columns) if valid[f"_valid{i}"] / total >= min_valid_ratio]
    dropped = [c for c in columns if c not in kept]
    if not kept:
        return Cleaned(numeric.where(F.lit(False)), [], dropped)
    return Cleaned(numeric.select(*carry, *kept).dropna("any", subset=kept), kept, dropped)


def valid_ratios(df: DataFrame, columns: Sequence[str], min_valid_ratio: float = 0.05) -> DataFrame:
    """One row per column: numeric cells, share of all rows, and whether it would be kept."""
    numeric = df.select(*[to_number(df, c).alias(c) for c in columns])
    row = numeric.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.count(named(c)).alias("n_valid"))
                for c in columns
            ]
        ).alias("_cols"),
    )
    return row.select("n_total", F.explode("_cols").alias("_c")).select(
        "_c.column",
        "n_total",
        "_c.n_valid",
        (F.col("_c.n_valid") / F.greatest("n_total", F.lit(1))).alias("valid_ratio"),
        (F.col("_c.n_valid") / F.greatest("n_total", F.lit(1)) >= min_valid_ratio).alias("kept"),
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def candidate_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Non-date columns with at least one numeric value, in table order (one aggregate)."""
    names = [
        f.name
        for f in df.schema.fields
        if not is_datetime_type(f.dataType) and f.name not in exclude
    ]
    if not names:
        return []
    found = df.agg(
        *[F.max(to_number(df, c).isNotNull()).alias(f"_c{i}") for i, c in enumerate(names)]
    ).first()
    return [c for i, c in enumerate(names) if found[f"_c{i}"]]


def _first_distinct(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[set] = []
        for batch in batches:
            seen = seen or [set() for _ in batch.schema.names]
            for i, found in enumerate(seen):
                if len(found) <= limit:
                    found.update(islice((v for v in batch.column(i).unique().to_pylist() if v is not None and v not in found), limit + 1 - len(found)))
        rows = [(i, v) for i, found in enumerate(seen) for v in found]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.string())], names=["i", "v"])

    return run


def distinct_up_to(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, int]:
    """Number of distinct values of each column, exact up to ``limit`` and larger than it beyond.

    Every task passes on at most ``limit + 1`` values of a column, which is enough to tell.
    """
    texts = df.select(*[named(c).cast("string").alias(f"_c{i}") for i, c in enumerate(columns)])
    found = texts.mapInArrow(_first_distinct(limit), "i int, v string").groupBy("i").agg(F.count_distinct("v").alias("n"))
    counts = {r["i"]: r["n"] for r in found.collect()}  # one row per column
    return {c: counts.get(i, 0) for i, c in enumerate(columns)}


def categorical_columns(df: DataFrame, max_distinct: int = 10) -> list[str]:
    """Text columns, or columns with few distinct values."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    others = [c for c in df.columns if c not in text]
    few: set[str] = set()
    if others:
        counts = distinct_up_to(df, others, max_distinct)
        few = {c for c in others if counts[c] <= max_distinct}
    return [c for c in df.columns if c in text or c in few]


def default_selection(candidates: Sequence[str], first: int = 5) -> list[str]:
    return list(candidates[:first])


def column_stats(df: DataFrame, columns: Sequence[str], series: Sequence[str] = ()) -> DataFrame:
    """n, mean and sample standard deviation per (series, column): one hash aggregate."""
    cells = [to_number(df, c) for c in columns]
    aggs = [
        F.struct(
            F.lit(c).alias("parameter"),
            F.count(cell).alias("n"),
            F.avg(cell).alias("mean"),
            F.stddev_samp(cell).alias("std"),
        )
        for c, cell in zip(columns, cells)
    ]
    table = df.groupBy(*series).agg(F.array(*aggs).alias("_s"))
    return table.select(*series, F.explode("_s").alias("_p")).select(*series, "_p.*")
