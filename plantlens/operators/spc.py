"""Control charts: three-sigma limits, the eight run rules, alerts, chart points, Pareto."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plantlens.functions.spc_values import (
    MIN_POINTS_RULES,
    PATTERN_LABELS,
    RULE_CATEGORY,
    SIGMA_FLOOR,
)
from plantlens.operators.clean import column_stats, numeric_columns, to_number
from plantlens.operators.ordered import MIN_BLOCK_ROWS, to_points, with_halo

# The longest look-back: 15 samples in a row plus the one before them.
LOOK_BACK = 15
# Cells that a correlation task holds at a time, and the share of a sum of squares below which a variance is rounding.
CELLS = 1 << 20
NO_SPREAD = 1e-12

RULES = [f"nelson_{i}" for i in range(1, 9)]


def _limits() -> list[Column]:
    return [
        (F.col("mean") - 3 * F.col("std")).alias("lcl"),
        (F.col("mean") + 3 * F.col("std")).alias("ucl"),
    ]


def shewhart(df: DataFrame, parameters: Sequence[str], series: Sequence[str] = ()) -> DataFrame:
    """Mean, sigma, limits, violations and criticality per (series, parameter); no order needed.

    Two scans of the wide rows: moments first, then violations against the joined limits.
    """
    from plantlens.session import join_small

    series = list(series)
    stats = column_stats(df, parameters, series).where(F.col("n") > 0)
    stats = stats.withColumn("std", F.when(F.col("n") > 1, F.col("std")).otherwise(F.lit(0.0)))
    stats = stats.select("*", *_limits())
    limits = stats.groupBy(*series).pivot("parameter", list(parameters)).agg(
        F.first("lcl").alias("lcl"), F.first("ucl").alias("ucl")
    )
    if series:
        joined = join_small(df, limits, series)
    else:
        row = limits.first()
        joined = df
        for p in parameters:
            joined = joined.withColumn(f"{p}_lcl", F.lit(row[f"{p}_lcl"] if row else None).cast("double"))
            joined = joined.withColumn(f"{p}_ucl", F.lit(row[f"{p}_ucl"] if row else None).cast("double"))
    outside = [
        F.struct(
            F.lit(p).alias("parameter"),
            F.count_if(
                (to_number(df, p) > F.col(f"`{p}_ucl`")) | (to_number(df, p) < F.col(f"`{p}_lcl`"))
            ).alias("violations"),
        )
        for p in parameters
    ]
    counts = joined.groupBy(*series).agg(F.array(*outside).alias("_o"))
    counts = counts.select(*series, F.explode("_o").alias("_p")).select(*series, "_p.*")
    result = join_small(stats, counts, [*series, "parameter"])
    return result.select(
        *series, "parameter", "n", "mean", "std", "lcl", "ucl", "violations",
        (F.col("violations") / F.col("n") * 100.0).alias("criticality"),
    )


def rule_signals(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per sample: does run rule 1..8 fire here?  Adds boolean ``nelson_1`` .. ``nelson_8``.

    A run of length k is reported once, at its k-th sample; the run length is the distance to
    the last sample whose flag was false.  Rules 5 and 6 report every window.  All rules look
    back at most ``LOOK_BACK`` samples, hence the halo; the only shuffle is by
    (series, parameter, block), and two growing frames plus two short ones serve all rules.
    """
    w = Window.partitionBy(*keys, "block").orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)

    def run_length(flag: str) -> Column:
        before_block = F.min("pos").over(so_far) - 1
        return F.col("pos") - F.coalesce(F.max(F.when(~F.col(flag), F.col("pos"))).over(so_far), before_block)

    def crowded(threshold: float, k: int, size: int) -> Column:
        frame = w.rowsBetween(-(size - 1), 0)
        high = F.sum((F.col("z") > threshold).cast("int")).over(frame)
        low = F.sum((F.col("z") < -threshold).cast("int")).over(frame)
        return F.coalesce((F.col("pos") >= size - 1) & ((high >= k) | (low >= k)), F.lit(False))

    usable = (F.col("n") >= MIN_POINTS_RULES) & (F.col("std") >= SIGMA_FLOOR)
    z = F.when(usable, F.try_divide(F.col("value") - F.col("mean"), F.col("std")))
    d = with_halo(points.withColumn("z", z), LOOK_BACK)
    false = F.lit(False)
    step = F.signum(F.col("value") - F.lag("value").over(w))
    d = d.withColumns(
        {
            "_step": F.when(F.col("z").isNotNull(), step),
            "_same": F.coalesce((F.col("z") > 0) == (F.lag("z").over(w) > 0), false),
            "_in": F.coalesce(F.abs("z") < 1.0, false),
            "_out": F.coalesce(F.abs("z") > 1.0, false),
        }
    )
    d = d.withColumns(
        {
            "_up": F.coalesce(F.col("_step") > 0, false),
            "_down": F.coalesce(F.col("_step") < 0, false),
            "_alt": F.coalesce((F.col("_step") != 0) & (F.col("_step") == -F.lag("_step").over(w)), false),
        }
    )
    d = d.withColumns(
        {
            "nelson_1": F.coalesce(F.abs("z") > 3, false),
            "nelson_2": run_length("_same") == 8,
            "nelson_3": (run_length("_up") == 5) | (run_length("_down") == 5),
            "nelson_4": run_length("_alt") == 13,
            "nelson_5": crowded(2.0, 2, 3),
            "nelson_6": crowded(1.0, 4, 5),
            "nelson_7": run_length("_in") == 15,
            "nelson_8": run_length("_out") == 8,
        }
    )
    return d.where("own").drop("own", "_step", "_in", "_out", "_same", "_up", "_down", "_alt")


def analyze_points(points: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Limits, violations, criticality and run-rule counts per (series, parameter)."""
    keys = [*series, "parameter"]
    signals = rule_signals(points, keys)
    outside = (F.col("value") > F.col("mean") + 3 * F.col("std")) | (
        F.col("value") < F.col("mean") - 3 * F.col("std")
    )
    table = signals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("mean").alias("mean"),
        F.max("std").alias("std"),
        F.count_if(outside).alias("violations"),
        *[F.count_if(F.col(r)).alias(r) for r in RULES],
    )
    counts = F.array(*RULES)
    best = F.array_position(counts, F.array_max(counts)).cast("int")
    kinds = F.array(*[F.lit(RULE_CATEGORY[i]) for i in range(1, 9)])
    table = table.select(
        *keys, "n", "mean", "std", *_limits(), "violations",
        (F.col("violations") / F.col("n") * 100.0).alias("criticality"),
        *RULES,
        sum((F.col(r) for r in RULES[1:]), F.col(RULES[0])).alias("nelson_total"),
        F.when(F.array_max(counts) > 0, F.element_at(kinds, best)).otherwise(F.lit("none")).alias(
            "dominant_pattern"
        ),
    )
    return table


def analyze_all(
    df: DataFrame,
    parameters: Sequence[str],
    series: Sequence[str] = (),
    order: Sequence[str] = (),
    min_block_rows: int = MIN_BLOCK_ROWS,
) -> DataFrame:
    """Every parameter of every series in one job, most critical first.

    A parameter without a single sample is reported with zeros when there is one series.
    """
    points = to_points(df, parameters, series, order, "any", min_block_rows)
    result = analyze_points(points, series)
    if not series:
        names = df.sparkSession.createDataFrame([(p,) for p in parameters], "parameter string")
        result = names.join(result, "parameter", "left").na.fill(0).na.fill("none", ["dominant_pattern"])
    return result.orderBy(F.desc("criticality"), *series, "parameter")


def alerts(results: DataFrame, series: Sequence[str] = (), shown: int | None = None) -> DataFrame:
    """Rows with a violation, graded ``danger``/``warn``; ``shown`` keeps the top of the list."""
    hit = results.where((F.col("violations") > 0) | (F.col("criticality") > 0))
    severity = F.when((F.col("criticality") >= 1.0) | (F.col("violations") >= 3), "danger").otherwise("warn")
    rows = hit.select(
        *series, "parameter",
        F.format_string(
            "%d violation(s) hors limite &middot; criticite %.2f%%",
            F.col("violations").cast("long"), F.col("criticality"),
        ).alias("message"),
        severity.alias("severity"),
        "violations", "criticality",
    ).orderBy(F.desc("criticality"), *series, "parameter")
    return rows.limit(shown) if shown is not None else rows


def control_points(points: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Points of the chart: x = 1..n, value, limits and whether the point is in control."""
    return points.select(
        *series, "parameter", (F.col("pos") + 1).alias("x"), "value", "mean", *_limits(),
    ).withColumn("in_control", F.col("value").between(F.col("lcl"), F.col("ucl")))


def alert_timeline(alert_rows: DataFrame, ts: str, width: str = "1 day") -> DataFrame:
    """Alerts per time window and severity."""
    return (
        alert_rows.groupBy(F.window(ts, width).alias("_w"), "severity")
        .agg(F.count(F.lit(1)).alias("alerts"), F.count_distinct("parameter").alias("parameters"))
        .select(F.col("_w.start").alias("window_start"), "severity", "alerts", "parameters")
    )


def alert_badge(column: str = "violations") -> Column:
    """Badge of a violation count."""
    return F.when(F.col(column) >= 3, "danger").when(F.col(column) > 0, "warn").otherwise("ok")


def alert_trend(column: str = "n_alerts") -> list[Column]:
    """Trend and wording of the dashboard's alert count."""
    n = F.col(column)
    return [
        F.when(n > 0, "down").otherwise("up").alias("trend"),
        F.when(n > 0, F.concat(n.cast("string"), F.lit(" a traiter"))).otherwise("Processus stable").alias("libelle"),
    ]


def pattern_label(column: str = "dominant_pattern") -> Column:
    """Display label of a pattern; unknown patterns keep their own name."""
    pairs = [F.lit(x) for kv in PATTERN_LABELS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.col(column))


def variation_ranking(df: DataFrame, columns: Sequence[str] | None = None, top: int | None = None) -> DataFrame:
    """Coefficient of variation |std / mean| of each column, most variable first."""
    columns = list(columns or numeric_columns(df))
    stats = column_stats(df, columns).where((F.col("n") >= 2) & (F.col("mean") != 0))
    ranked = stats.select(
        "parameter", "n", F.abs(F.col("std") / F.col("mean")).alias("cv")
    ).orderBy(F.desc("cv"), "parameter")
    return ranked.limit(top) if top is not None else ranked


def pareto(scores: DataFrame, name: str = "parameter", score: str = "score", top_n: int = 10) -> DataFrame:
    """Top scores with cumulative share of the shown rows, share of all, and a tier by rank."""
    total = scores.agg(F.sum(score).alias("_all"))
    shown = scores.select(name, score).orderBy(F.desc(score), name).limit(top_n)
    by_rank = Window.orderBy(F.desc(score), F.col(name))  # at most top_n rows
    cumulative = F.sum(score).over(by_rank.rowsBetween(Window.unboundedPreceding, 0))
    shown_sum = F.sum(score).over(Window.partitionBy())
    ranked = shown.select(
        F.row_number().over(by_rank).cast("long").alias("rank"), name, score,
        F.try_divide(cumulative, shown_sum).alias("_c"), cumulative.alias("_cum"),
    )
    whole = total.first()["_all"]
    tier = F.when(F.col("rank") <= 3, "danger").when(F.col("rank") <= 6, "warn").otherwise("primary")
    return ranked.select(
        "rank", name, score,
        (F.col("_c") * 100.0).alias("cumulative_pct"),
        (F.try_divide(F.col("_cum"), F.lit(whole)) * 100.0).alias("cumulative_pct_of_all"),
        tier.alias("tier"),
    )


def _moments(shift: np.ndarray):
    """Sums of every column pair over the rows in which both have a value, as masked matrix products of a task's batches."""
    p = len(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sx, sxx, sxy, odd = np.zeros((5, p, p))
        for batch in batches:
            step = max(1, CELLS // max(p, 1))
            for at in range(0, batch.num_rows, step):
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.slice(at, step).columns]).astype(float)
                there, endless = (~np.isnan(x)).astype(float), np.isinf(x).astype(float)
                d = np.where(np.isfinite(x), x, shift) - shift
                n += there.T @ there
                sx += d.T @ there
                sxx += (d * d).T @ there
                sxy += d.T @ d
                odd += endless.T @ there
        i, j = np.triu_indices(p)
        columns = [i, j, n[i, j], sx[i, j], sx[j, i], sxx[i, j], sxx[j, i], sxy[i, j], odd[i, j] + odd[j, i]]
        names = ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy", "odd"]
        for at in range(0, len(i), CELLS >> 4):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (CELLS >> 4)]) for c in columns], names=names)

    return run


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """Pairwise-complete Pearson correlations of all column pairs.

    Tasks return one row of sums (around the column means) per pair, which are added up by pair; only the means reach the driver.
    A column whose spread vanishes against its distance from the mean gives NULL, an infinite value NaN.
    """
    columns = list(columns or numeric_columns(df))
    numbers = df.select(*[to_number(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    finite = [F.avg(F.when(F.abs(f"c{i}") < float("inf"), F.col(f"c{i}"))) for i in range(len(columns))]
    shift = np.array([m or 0.0 for m in numbers.agg(*finite).first()])
    # a row without values changes no sum, and gives an empty table its pairs
    blank = df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(c) for c in numbers.columns])
    kinds = "i long, j long, n double, sx double, sy double, sxx double, syy double, sxy double, odd double"
    sums = numbers.unionByName(blank).mapInArrow(_moments(shift), kinds).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy", "odd")]
    )
    n = F.nullif(F.col("n"), F.lit(0.0))
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    spread = (vx > NO_SPREAD * F.col("sxx")) & (vy > NO_SPREAD * F.col("syy"))
    r = F.when(spread, (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx) / F.sqrt(vy))
    r = F.round(F.when(F.col("odd") > 0, float("nan")).otherwise(r), digits)
    names = F.array(*[F.lit(c) for c in columns])
    half = sums.select(names[F.col("i").cast("int")].alias("x"), names[F.col("j").cast("int")].alias("y"), r.alias("r"), (F.col("i") < F.col("j")).alias("_off"))
    turned = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    sides = F.explode(F.when(F.col("_off"), turned).otherwise(F.array(F.struct("x", "y"))))
    return half.select(sides.alias("_p"), "r").select("_p.x", "_p.y", "r")
