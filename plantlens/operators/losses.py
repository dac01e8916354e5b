"""Loss analysis: defect correlations, process capability, parts per million."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantlens.functions.stats import SCORES_PER_ROW, correlation_p, nan_to_null, normal_score_sums, shapiro_p
from plantlens.operators.clean import to_number
from plantlens.operators.ranks import average_ranks, skew_safe_join
from plantlens.session import join_small, materialize, named, null_safe_join

CONSTANT_STD = 1e-9
NORMALITY_P = 0.05
CPK_CAPABLE = 1.33
CPK_MARGINAL = 1.0
NOT_COMPUTABLE = "NON_CALCULABLE"


def ppm(df: DataFrame, defects: str, volume: str | float, by: Sequence = ()) -> DataFrame:
    """Defects per million; invalid volumes or defect counts give a status instead of a value."""
    v = F.sum(to_number(df, volume)) if isinstance(volume, str) else F.lit(float(volume))
    table = df.groupBy(*by).agg(
        F.sum(to_number(df, defects)).alias("defects"), v.alias("volume"),
        F.count(named(defects)).alias("_given"), F.count(to_number(df, defects)).alias("_numeric"),
    )
    status = (
        F.when(~(F.col("volume") > 0) | F.col("volume").isNull(), "VOLUME_INVALIDE")
        .when((F.col("_given") > 0) & (F.col("_numeric") == 0), "NON_NUMERIQUE")
        .when(F.col("defects") < 0, "DEFAUTS_INVALIDES")
        .otherwise("OK")
    )
    table = table.withColumn("status", status).withColumn("defects", F.coalesce("defects", F.lit(0.0)))
    value = F.when(F.col("status") == "OK", F.try_divide("defects", "volume") * 1_000_000.0)
    return table.withColumn("ppm", value).drop("_given", "_numeric")


def ppm_by_period(df: DataFrame, ts: str, defects: str, volume: str, first_days: int = 10, last_days: int = 7) -> DataFrame:
    """Defect rate in the first days, the last days and between them."""
    kind = df.schema[ts].dataType
    bounds = df.agg(F.min(ts).cast("string").alias("lo"), F.max(ts).cast("string").alias("hi")).first()
    start = F.lit(bounds["lo"]).cast(kind) + F.expr(f"INTERVAL {first_days} DAY")
    end = F.lit(bounds["hi"]).cast(kind) - F.expr(f"INTERVAL {last_days} DAY")
    period = F.when(F.col(ts) < start, "debut").when(F.col(ts) >= end, "fin").otherwise("milieu")
    return ppm(df.withColumn("period", period), defects, volume, ["period"])


def specs_frame(spark, specs: dict[str, tuple[float, float]]) -> DataFrame:
    rows = [(p, float(lo), float(hi)) for p, (lo, hi) in specs.items()]
    return spark.createDataFrame(rows, "parameter string, lsl double, usl double")


def cpk(df: DataFrame, specs: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Capability index per (series, parameter with limits), with an explicit verdict.

    ``specs`` has ``parameter, lsl, usl``.  Parameters that are no column stay in the result.
    """
    series = list(series)
    wanted = specs.where(F.col("parameter").isin(df.columns)).select("parameter").distinct()
    present = sorted(r["parameter"] for r in wanted.collect())  # no more than the columns of df
    cells = []
    for c in present:
        x = to_number(df, c)
        cells.append(
            F.struct(
                F.lit(c).alias("parameter"), F.count(named(c)).alias("_given"), F.count(x).alias("n"),
                F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                F.first(named(c).cast("string"), ignorenulls=True).alias("_example"),
            )
        )
    if not present:
        empty = "parameter string, _given long, n long, mean double, std double, _example string"
        stats = df.sparkSession.createDataFrame([], empty)
        for c in series:
            stats = stats.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
    else:
        stats = df.groupBy(*series).agg(F.array(*cells).alias("_s"))
        stats = stats.select(*series, F.explode("_s").alias("_p")).select(*series, "_p.*")
    joined = specs.join(stats, "parameter", "left")
    low, high, mean, std, n = (F.col(c) for c in ("lsl", "usl", "mean", "std", "n"))
    inside = (mean >= low) & (mean <= high)
    index = F.least(F.try_divide(high - mean, 3 * std), F.try_divide(mean - low, 3 * std))
    absent = ~F.col("parameter").isin(present) if present else F.lit(True)
    bad_limits = low >= high
    bad_text = (F.col("_given") > 0) & (n == 0)
    out = joined.withColumn(
        "cpk",
        F.when(absent | bad_limits | bad_text | (n < 2), F.lit(None).cast("double"))
        .when(std < CONSTANT_STD, F.when(inside, math.inf).otherwise(0.0))
        .otherwise(index),
    )
    verdict = (
        F.when(absent, "COLONNE_ABSENTE")
        .when(
            bad_limits,
            F.concat(
                F.lit("ERREUR: lsl ("), low.cast("string"), F.lit(") doit etre strictement inferieur a usl ("),
                high.cast("string"), F.lit(")."),
            ),
        )
        .when(
            bad_text,
            F.concat(
                F.lit("ERREUR: Colonne '"), F.col("parameter"),
                F.lit("' non convertible en numerique (exemple de valeur : '"), F.col("_example"), F.lit("')."),
            ),
        )
        .when(n < 2, "DONNEES_INSUFFISANTES")
        .when(std < CONSTANT_STD, F.when(inside, "CONSTANTE_DANS_SPECS").otherwise("CONSTANTE_HORS_SPECS"))
        .when(F.col("cpk") >= CPK_CAPABLE, "CAPABLE")
        .when(F.col("cpk") >= CPK_MARGINAL, "MARGINAL")
        .otherwise("NON_CAPABLE")
    )
    skipped = absent | bad_limits | bad_text
    unknown = F.lit(None).cast("double")
    return out.withColumn("verdict", verdict).select(
        *series, "parameter", "lsl", "usl",
        F.when(skipped, F.lit(0)).otherwise(n).cast("long").alias("n"),
        F.when(skipped | (n < 2), unknown).otherwise(mean).alias("mean"),
        F.when(skipped | (n < 2), unknown).otherwise(std).alias("std"),
        "cpk", "verdict",
    )


def cpk_label(value):
    """Dashboard wording of a capability index."""
    return F.when(value >= CPK_CAPABLE, "Capable (≥1.33)").when(value < CPK_MARGINAL, "Insuffisant (<1)").otherwise(
        "Acceptable"
    )


def _pairs(df: DataFrame, params: list[str], defect: str, series: list[str]) -> DataFrame:
    wide = df.select(
        *series, to_number(df, defect).alias("d"), *[to_number(df, p).alias(f"_p{i}") for i, p in enumerate(params)]
    ).where(F.col("d").isNotNull())
    cells = F.array(
        *[F.struct(F.lit(p).alias("parameter"), F.col(f"_p{i}").alias("p")) for i, p in enumerate(params)]
    )
    return (
        wide.select(*series, "d", F.explode(cells).alias("_c"))
        .select(*series, "_c.parameter", "_c.p", "d")
        .where(F.col("p").isNotNull())
    )


def _value_ranks(counted: DataFrame, keys: list[str], v: str) -> DataFrame:
    values = counted.groupBy(*keys, v).agg(F.sum("c").alias("cnt"))
    return materialize(average_ranks(values, keys, v))


def _spearman(counted: DataFrame, keys: list[str], ranks: dict[str, DataFrame], sizes: DataFrame, total: int) -> DataFrame:
    """Rank correlation from distinct (p, d) pairs: ranks of values, not of rows."""
    ranked = counted
    for v in ("p", "d"):
        side = ranks[v].select(*keys, v, F.col("cnt").alias(f"_w{v}"), F.col("rank").alias(f"r{v}"))
        ranked = skew_safe_join(ranked, side, [*keys, v], f"_w{v}", total)
    centred = join_small(ranked, sizes.select(*keys, "n"), keys).withColumn("_m", (F.col("n") + 1) / 2.0)
    x, y, c = F.col("rp") - F.col("_m"), F.col("rd") - F.col("_m"), F.col("c")
    return centred.groupBy(*keys).agg(
        F.try_divide(F.sum(c * x * y), F.sqrt(F.sum(c * x * x) * F.sum(c * y * y))).alias("spearman_r")
    )


def _shapiro(ranks: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """Normality p-value of every group, whatever its size, from distinct values and their places.

    A value that many samples share is cut into stretches of places, so no row stands for more than
    ``SCORES_PER_ROW`` of them.
    """
    placed = join_small(ranks.select(*keys, "p", "cnt", "rank"), sizes.select(*keys, "n", "mean_p", "std_p"), keys)
    x, before = F.col("p") - F.col("mean_p"), F.col("rank") - (F.col("cnt") + 1) / 2.0
    placed = placed.select(*keys, "n", "std_p", x.alias("x"), before.cast("long").alias("before"), "cnt")
    steps = F.sequence(F.lit(0).cast("long"), F.col("cnt") - 1, F.lit(SCORES_PER_ROW).cast("long"))
    parts = placed.withColumn("_step", F.explode(steps))
    length = F.least(F.col("cnt") - F.col("_step"), F.lit(SCORES_PER_ROW).cast("long"))
    scores = normal_score_sums(F.col("before") + F.col("_step") + 1, length, F.col("n"))
    parts = parts.withColumn("_s", scores)
    upto = F.col("before") + F.col("cnt")
    sums = parts.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("std_p").alias("std_p"), F.sum(F.col("x") * F.col("_s.total")).alias("cross"), F.sum("_s.square").alias("square"),
        F.min("x").alias("x1"), F.min(F.when(upto >= 2, F.col("x"))).alias("x2"),
        F.max(F.when(F.col("before") <= F.col("n") - 2, F.col("x"))).alias("y2"), F.max("x").alias("y1"),
    )
    spread = F.col("std_p") * F.col("std_p") * (F.col("n") - 1)
    return sums.select(*keys, shapiro_p("n", "cross", "square", spread, "x1", "x2", "y2", "y1").alias("shapiro_p"))


def correlations(
    df: DataFrame, params: Sequence[str], defect: str, series: Sequence[str] = (), normality_up_to: int | None = None
) -> DataFrame:
    """Pearson, Spearman and the retained test per (series, parameter) against the defects.

    Pearson is retained when Shapiro-Wilk does not reject normality, Spearman otherwise.  The test of
    normality is made at every size; ``normality_up_to`` makes it up to so many pairs only (5000 is the
    customary limit, beyond which the test rejects almost everything), and Spearman is retained beyond.
    What cannot be computed is reported as ``NON_CALCULABLE`` with a reason, never raised.
    """
    params, series = list(params), list(series)
    missing = [c for c in [*params, defect] if c not in df.columns]
    if missing:
        raise ValueError(f"Colonnes parametres absentes : {missing}")
    keys = [*series, "parameter"]
    pairs = _pairs(df, params, defect, series)
    spread = F.stddev_samp("p") * F.stddev_samp("d")
    stats = materialize(
        pairs.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("p").alias("mean_p"),
            F.stddev_samp("p").alias("std_p"),
            F.stddev_samp("d").alias("std_d"),
            F.try_divide(F.covar_samp("p", "d"), spread).alias("pearson_r"),
        )
    )
    total = stats.agg(F.sum("n")).first()[0] or 0
    ok = (F.col("n") >= 3) & (F.col("std_p") >= CONSTANT_STD) & (F.col("std_d") >= CONSTANT_STD)
    # every (series, parameter) gets a row, also without a single usable pair
    cells = []
    for p in params:
        raw, x = named(p), to_number(df, p)
        cells.append(
            F.struct(
                F.lit(p).alias("parameter"), ((F.count(raw) > 0) & (F.count(x) == 0)).alias("_text_p"),
                F.first(raw.cast("string"), ignorenulls=True).alias("_example_p"),
            )
        )
    raw, x = named(defect), to_number(df, defect)
    every = df.groupBy(*series).agg(
        F.array(*cells).alias("_c"), ((F.count(raw) > 0) & (F.count(x) == 0)).alias("_text_d"),
        F.first(raw.cast("string"), ignorenulls=True).alias("_example_d"),
    )
    every = every.select(*series, "_text_d", "_example_d", F.explode("_c").alias("_p")).select(
        *series, "_text_d", "_example_d", "_p.*"
    )
    usable = join_small(pairs, stats.where(ok).select(*keys), keys, "left_semi")
    table = null_safe_join(every, stats, keys, "left")
    counted = materialize(usable.groupBy(*keys, "p", "d").agg(F.count(F.lit(1)).alias("c")))
    ranks = {v: _value_ranks(counted, keys, v) for v in ("p", "d")}
    tested = ok if normality_up_to is None else ok & (F.col("n") <= normality_up_to)
    table = null_safe_join(table, _spearman(counted, keys, ranks, stats, total), keys, "left")
    table = null_safe_join(table, _shapiro(ranks["p"], keys, stats.where(tested)), keys, "left")

    def not_numeric(name, example):
        return F.concat(
            F.lit("Colonne '"), name, F.lit("' non convertible en numerique (exemple de valeur : '"),
            example, F.lit("')."),
        )

    quoted = F.concat(F.lit("'"), F.col("parameter"), F.lit("' : "))
    motif = (
        F.when(F.col("_text_p"), not_numeric(F.col("parameter"), F.col("_example_p")))
        .when(F.col("_text_d"), not_numeric(F.lit("defaut"), F.col("_example_d")))
        .when(
            F.coalesce(F.col("n"), F.lit(0)) < 3,
            F.concat(quoted, F.lit("moins de 3 observations communes exploitables.")),
        )
        .when(F.col("std_p") < CONSTANT_STD, F.concat(quoted, F.lit("parametre constant, correlation non definie.")))
        .when(F.col("std_d") < CONSTANT_STD, F.concat(quoted, F.lit("defauts constants, correlation non definie.")))
    )
    table = table.withColumn("motif", motif)
    good = F.col("motif").isNull()
    # rounding noise must not push a correlation past 1
    for c in ("pearson_r", "spearman_r"):
        clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(c)))  # both ignore null
        table = table.withColumn(c, F.when(good & F.col(c).isNotNull(), clamped))
    table = table.withColumns(
        {
            "n": F.when(good, F.col("n")).otherwise(0).cast("long"),
            "pearson_p": nan_to_null(correlation_p(F.col("pearson_r"), F.col("n").cast("double"))),
            "spearman_p": nan_to_null(correlation_p(F.col("spearman_r"), F.col("n").cast("double"))),
            "shapiro_p": nan_to_null(F.col("shapiro_p")),
        }
    )
    normal = F.coalesce(F.col("shapiro_p") > NORMALITY_P, F.lit(False))
    return table.select(
        *keys, "n", "pearson_r", "pearson_p", "spearman_r", "spearman_p", "shapiro_p",
        F.when(~good, NOT_COMPUTABLE).when(normal, "pearson").otherwise("spearman").alias("test_retenu"),
        F.when(good, F.when(normal, F.col("pearson_r")).otherwise(F.col("spearman_r"))).alias("r"),
        F.when(good, F.when(normal, F.col("pearson_p")).otherwise(F.col("spearman_p"))).alias("p_value"),
        "motif",
    ).orderBy(*series, F.desc_nulls_last(F.abs("r")), "parameter")
