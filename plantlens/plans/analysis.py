"""Whole analyses: from a measurement table to the tables a user reads."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.operators import clean, drift, losses, quality, shifts, spc
from plantlens.session import named


@dataclass
class LossAnalysis:
    correlations: DataFrame
    cpk: DataFrame | None
    ppm: DataFrame | None


def analyze_losses(
    df: DataFrame,
    params: Sequence[str],
    defect: str,
    volume_total: float | None = None,
    specs: DataFrame | None = None,
    series: Sequence[str] = (),
) -> LossAnalysis:
    """Correlations against the defects, capability where limits exist, overall ppm."""
    return LossAnalysis(
        losses.correlations(df, params, defect, series),
        losses.cpk(df, specs, series) if specs is not None else None,
        losses.ppm(df, defect, volume_total, series) if volume_total is not None else None,
    )


@dataclass
class ShiftAnalysis:
    detected: bool
    shift_column: str | None
    n_shifts: int
    reason: str
    stability: DataFrame | None = None
    comparison: DataFrame | None = None


def analyze_shifts(df: DataFrame, params: Sequence[str], shift: str | None = None) -> ShiftAnalysis:
    """Find the shift column if not given, then stability and comparison between shifts."""
    shift = shift or shifts.detect_shift_column(df)
    if shift is None:
        return ShiftAnalysis(False, None, 0, "Aucune colonne shift detectee.")
    n = df.agg(F.count_distinct(named(shift))).first()[0]
    if n < shifts.MIN_SHIFTS:
        reason = f"Colonne '{shift}' detectee mais {n} modalite(s) uniquement — comparaison impossible."
        return ShiftAnalysis(False, None, 0, reason)
    return ShiftAnalysis(
        True, shift, n, "", shifts.shift_stability(df, shift, params), shifts.compare_shifts(df, shift, params)
    )


@dataclass
class ProcessReport:
    audit: DataFrame
    kept: list[str]
    dropped: list[str]
    control: DataFrame
    alerts: DataFrame
    drift: DataFrame


def process_report(
    df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None, series: Sequence[str] = ()
) -> ProcessReport:
    """Audit, cleaning, control charts, alerts and drift of one measurement table."""
    chosen = list(columns or clean.candidate_columns(df, [*order, *series]))
    cleaned = clean.clean_data(df, chosen, carry=[*series, *order])
    control = spc.analyze_all(cleaned.rows, cleaned.kept, series, order)
    return ProcessReport(
        quality.audit(df, order), cleaned.kept, cleaned.dropped, control, spc.alerts(control, series),
        drift.detect_drift(cleaned.rows, cleaned.kept, series, order),
    )


def dashboard_kpis(
    df: DataFrame, control: DataFrame, cpk_table: DataFrame | None = None, ppm_table: DataFrame | None = None
) -> DataFrame:
    """Samples, parameters, violations, ppm and mean capability in one row."""
    n_params = len(clean.numeric_columns(df))
    points = df.agg(F.count(F.lit(1)).alias("n_points")).withColumn("n_params", F.lit(n_params).cast("long"))
    row = points.join(control.agg(F.coalesce(F.sum("violations"), F.lit(0)).alias("n_alerts")))
    if ppm_table is not None:
        row = row.join(ppm_table.agg(F.max("ppm").alias("ppm")))
    if cpk_table is not None:
        finite = F.when(F.abs("cpk") < float("inf"), F.col("cpk"))
        row = row.join(cpk_table.agg(F.avg("cpk").alias("cpk_mean"), F.avg(finite).alias("cpk_mean_finite")))
    return row
