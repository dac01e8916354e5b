"""Rows of the printed report: fixed decimals, '-' for missing values, shortened names."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decimals(c, digits: int) -> Column:
    """Number with fixed decimals; '-' when missing, 'inf' when unbounded."""
    c = F.col(c) if isinstance(c, str) else c
    return (
        F.when(c.isNull() | F.isnan(c), "-")
        .when(c == math.inf, "inf")
        .otherwise(F.format_string(f"%.{digits}f", c))
    )


def spc_rows(results: DataFrame) -> DataFrame:
    return results.select(
        F.substring("parameter", 1, 22).alias("parametre"), F.col("n").cast("string").alias("n"),
        decimals("mean", 3).alias("moyenne"), decimals("std", 3).alias("ecart_type"), decimals("lcl", 3).alias("lcl"),
        decimals("ucl", 3).alias("ucl"), F.col("violations").cast("string").alias("viol"),
        decimals("criticality", 2).alias("criticite_pct"),
    )


def correlation_rows(table: DataFrame) -> DataFrame:
    return table.select(
        F.substring("parameter", 1, 28).alias("parametre"), F.col("n").cast("string").alias("n"),
        F.col("test_retenu").alias("test"), decimals("r", 3).alias("r"), decimals("p_value", 4).alias("p_value"),
    )


def cpk_rows(table: DataFrame) -> DataFrame:
    return table.select(
        F.substring("parameter", 1, 25).alias("parametre"), decimals("lsl", 2).alias("lsl"),
        decimals("usl", 2).alias("usl"), decimals("cpk", 3).alias("cpk"), F.substring("verdict", 1, 30).alias("verdict"),
    )


def shift_rows(table: DataFrame) -> DataFrame:
    return table.select(
        F.substring("parameter", 1, 25).alias("parametre"), F.lit("Kruskal-Wallis").alias("test"),
        decimals("h_statistic", 2).alias("statistique"), decimals("p_value", 4).alias("p_value"),
        F.when(F.col("significatif_5pct"), "OUI").otherwise("non").alias("significatif"),
    )
