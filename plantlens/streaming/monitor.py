"""Control charts on arriving samples, against limits frozen from a baseline."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.functions.spc_values import CUSUM_DECISION, CUSUM_SLACK, EWMA_LAMBDA, EWMA_WIDTH

ALERT_SCHEMA = "series string, parameter string, ts timestamp, value double, rule string, statistic double"
# rule of samples that cannot be judged, as their series and parameter have no baseline
NO_BASELINE = "sans_reference"
STATE_SCHEMA = "ewma double, c_plus double, c_minus double, last timestamp"


def with_limits(samples: DataFrame, baseline: DataFrame) -> DataFrame:
    """Join each sample to its frozen mean and sigma (static side: series, parameter, mean, std); null where there are none."""
    return samples.join(baseline, ["series", "parameter"], "left")


def _upward(start: float, steps: np.ndarray) -> np.ndarray:
    """Sums that never fall below zero: c = max(0, c + step), for a whole batch."""
    total = start + np.cumsum(steps)
    return total - np.minimum(np.minimum.accumulate(total), 0.0)


def _advance(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Move the EWMA and CUSUM of one (series, parameter) over the samples of a micro-batch."""
    rows = pd.concat(list(batches)).sort_values("ts", kind="stable").reset_index(drop=True)
    unknown = (rows["mean"].isna() | rows["std"].isna()).to_numpy()
    stray, rows = rows[unknown], rows[~unknown].reset_index(drop=True)
    ewma, c_plus, c_minus, last = state.get if state.exists else (None, 0.0, 0.0, None)
    # a sample older than what the state has seen is checked against its limits only
    late = rows["ts"] < last if last is not None else pd.Series(False, index=rows.index)
    tests = [(stray, NO_BASELINE, np.ones(len(stray), bool), stray["value"]), (rows, "limites", (rows["value"] - rows["mean"]).abs() > 3 * rows["std"], rows["value"])]
    timely = rows[~late].reset_index(drop=True)
    if len(timely):
        value, mean, std = (timely[c].to_numpy(float) for c in ("value", "mean", "std"))
        start = mean[0] if ewma is None else ewma
        level = pd.Series(np.concatenate([[start], value])).ewm(alpha=EWMA_LAMBDA, adjust=False).mean().to_numpy()[1:]
        up, down = _upward(c_plus, value - mean - CUSUM_SLACK * std), _upward(c_minus, mean - CUSUM_SLACK * std - value)
        width = EWMA_WIDTH * math.sqrt(EWMA_LAMBDA / (2 - EWMA_LAMBDA))
        tests += [
            (timely, "ewma", np.abs(level - mean) > width * std, level),
            (timely, "cusum_haut", up > CUSUM_DECISION * std, up),
            (timely, "cusum_bas", down > CUSUM_DECISION * std, down),
        ]
        state.update((float(level[-1]), float(up[-1]), float(down[-1]), timely["ts"].iloc[-1].to_pydatetime()))
    found = []
    for table, rule, hit, statistic in tests:
        hit = np.asarray(hit, bool)
        found.append(pd.DataFrame({
            "series": key[0], "parameter": key[1], "ts": table["ts"][hit], "value": table["value"][hit], "rule": rule, "statistic": np.asarray(statistic, float)[hit],
        }))
    yield pd.concat(found).sort_values("ts", kind="stable")


def monitor(samples: DataFrame, baseline: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Alerts of a stream of samples ``series, parameter, ts, value``.

    The state per (series, parameter) is three numbers and the last time, however long the stream runs.  Samples that
    arrive after a later one of their series are checked against the limits and move no running statistic.  The samples
    of one micro-batch are brought into time order per series, so the source's rate options
    (``maxFilesPerTrigger`` and the like) bound what a task holds.  A sample without a baseline is reported as such, with its value.
    """
    timed = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    live = with_limits(timed, baseline)
    return live.groupBy("series", "parameter").applyInPandasWithState(
        _advance, ALERT_SCHEMA, STATE_SCHEMA, "append", "NoTimeout"
    )


def status_counts(rows: DataFrame, ts: str, status: str, width: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Incidents or votes per time window and status."""
    return (
        rows.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, watermark)
        .groupBy(F.window(ts, width).alias("_w"), F.col(status).alias("statut"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("_w.start").alias("window_start"), "statut", "n")
    )


def open_windows(spark: SparkSession, checkpoint: str, status: str = "statut") -> DataFrame:
    """Counts of the windows that a stopped ``status_counts`` stream has not closed yet, from its state.

    Together with what the stream has written they are the counts of all rows that arrived.
    """
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(
        F.col("key")["window"]["start"].alias("window_start"), F.col("key")[status].alias("statut"), F.col("value")["count"].cast("long").alias("n")
    )
