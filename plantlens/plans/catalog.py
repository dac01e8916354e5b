"""Registered queries: every operator on the test tables, with the SQL that checks it.

Each entry is a Spark callable ``(spark, sf_dir) -> DataFrame`` and, where plain SQL can say
the same, an independent statement over the same tables.  Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.functions import report, text
from plantlens.functions.spc_values import RULE_CATEGORY
from plantlens.functions.vocab import (
    BLAME_MARKERS,
    CATEGORY_WEIGHTS,
    CONDITION_MARKERS,
    FAMILIES,
    FAMILY_WORDS,
    FOLD_CLASSIFIER,
    FOLD_SIMILARITY,
    FOLLOW_UP_QUESTION,
    NO_CAUSE,
    ROOT_MARKERS,
    SEVERITY,
    STATUS_LABELS,
    STOP_REASONS,
    STOPWORDS,
    SYMPTOM_MARKERS,
    TEMPLATES,
    TRANSITIONS,
    TREE_BRANCHES,
)
from plantlens.operators import autofill, cases, clean, drift, losses, nodes, ordered, quality, retrieval, shifts, similarity, spc, supervised
from plantlens.plans import analysis, standins
from plantlens.plans.standins import frame, quoted
from plantlens.session import join_small, read_table, work_folder
from plantlens.sources import files, store
from plantlens.streaming import monitor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its own name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (and -0.0 made 0.0), integers as bigint, for an exact comparison."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        if kind in ("double", "float"):
            c = F.round(c, digits) + F.lit(0.0)
        elif kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


# --- measurement tables ------------------------------------------------------

PARAMETERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

LINE_POINTS = (
    "base AS (SELECT *, row_number() OVER (ORDER BY " + ", ".join(LINE_ORDER + PARAMETERS) + ") - 1 AS pos FROM lineitem), "
    "pts AS (" + " UNION ALL ".join(f"SELECT 'all' AS s, '{p}' AS parameter, pos, {p} AS value FROM base" for p in PARAMETERS) + ")"
)


def event_points(columns, by="event_type", not_null=True):
    """Ordered points of the sensor stream: gaps dropped per column before numbering."""
    parts = [
        f"SELECT {by} AS s, '{c}' AS parameter, row_number() OVER (PARTITION BY {by} ORDER BY event_id) - 1 AS pos, "
        f"{c} AS value FROM sensors WHERE {c} IS NOT NULL"
        for c in columns
    ]
    return f"sensors AS ({standins.SENSORS}), pts AS (" + " UNION ALL ".join(parts) + ")"


STATS = (
    "st AS (SELECT s, parameter, count(*) AS n, avg(value) AS mean, "
    "CASE WHEN count(*) > 1 THEN stddev_samp(value) ELSE 0 END AS sd FROM pts GROUP BY s, parameter)"
)

# Run rules by counting flags in fixed frames; W is the series in order.
RULE_STEPS = f"""
{STATS},
z AS (SELECT p.s, p.parameter, p.pos, p.value, st.n, st.mean, st.sd,
        CASE WHEN st.n >= 9 AND st.sd >= 1e-12 THEN (p.value - st.mean) / st.sd END AS z
      FROM pts p JOIN st ON p.s = st.s AND p.parameter = st.parameter),
f AS (SELECT *, CASE WHEN z IS NOT NULL THEN sign(value - lag(value) OVER w) END AS d,
        CASE WHEN (z > 0) = (lag(z) OVER w > 0) THEN 1 ELSE 0 END AS same,
        CASE WHEN abs(z) < 1 THEN 1 ELSE 0 END AS near, CASE WHEN abs(z) > 1 THEN 1 ELSE 0 END AS far
      FROM z WINDOW w AS (PARTITION BY s, parameter ORDER BY pos)),
g AS (SELECT *, CASE WHEN d > 0 THEN 1 ELSE 0 END AS up, CASE WHEN d < 0 THEN 1 ELSE 0 END AS down,
        CASE WHEN d <> 0 AND d = -(lag(d) OVER w) THEN 1 ELSE 0 END AS alt
      FROM f WINDOW w AS (PARTITION BY s, parameter ORDER BY pos)),
r AS (SELECT s, parameter, n, mean, sd, value,
        CASE WHEN abs(z) > 3 THEN 1 ELSE 0 END AS r1,
        CASE WHEN sum(same) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) = 8 AND coalesce(lag(same, 8) OVER w, 0) = 0 THEN 1 ELSE 0 END AS r2,
        CASE WHEN (sum(up) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 AND coalesce(lag(up, 5) OVER w, 0) = 0)
               OR (sum(down) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 AND coalesce(lag(down, 5) OVER w, 0) = 0) THEN 1 ELSE 0 END AS r3,
        CASE WHEN sum(alt) OVER (w ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 13 AND coalesce(lag(alt, 13) OVER w, 0) = 0 THEN 1 ELSE 0 END AS r4,
        CASE WHEN pos >= 2 AND (sum(CASE WHEN z > 2 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2
               OR sum(CASE WHEN z < -2 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2) THEN 1 ELSE 0 END AS r5,
        CASE WHEN pos >= 4 AND (sum(CASE WHEN z > 1 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 4
               OR sum(CASE WHEN z < -1 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 4) THEN 1 ELSE 0 END AS r6,
        CASE WHEN sum(near) OVER (w ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) = 15 AND coalesce(lag(near, 15) OVER w, 0) = 0 THEN 1 ELSE 0 END AS r7,
        CASE WHEN sum(far) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) = 8 AND coalesce(lag(far, 8) OVER w, 0) = 0 THEN 1 ELSE 0 END AS r8
      FROM g WINDOW w AS (PARTITION BY s, parameter ORDER BY pos)),
c AS (SELECT s, parameter, count(*) AS n, max(mean) AS mean, max(sd) AS sd,
        sum(CASE WHEN value > mean + 3 * sd OR value < mean - 3 * sd THEN 1 ELSE 0 END) AS violations,
        {", ".join(f"sum(r{i}) AS r{i}" for i in range(1, 9))}
      FROM r GROUP BY s, parameter)
"""
_BEST = f"greatest({', '.join(f'r{i}' for i in range(1, 9))})"
_DOMINANT = "CASE WHEN " + _BEST + " = 0 THEN 'none' " + " ".join(
    f"WHEN r{i} = {_BEST} THEN '{RULE_CATEGORY[i]}'" for i in range(1, 9)
) + " END"
RULE_OUTPUT = (
    "parameter, n, round(mean, 6) AS mean, round(sd, 6) AS std, round(mean - 3 * sd, 6) AS lcl, "
    "round(mean + 3 * sd, 6) AS ucl, CAST(violations AS BIGINT) AS violations, "
    "round(violations / n * 100.0, 6) AS criticality, "
    + ", ".join(f"CAST(r{i} AS BIGINT) AS nelson_{i}" for i in range(1, 9))
    + ", CAST(" + " + ".join(f"r{i}" for i in range(1, 9)) + " AS BIGINT) AS nelson_total, "
    + _DOMINANT + " AS dominant_pattern"
)


def lineitem(spark, d):
    return read_table(spark, f"{d}/lineitem.parquet")


def sensors(spark, d):
    return frame(spark, d, standins.SENSORS)


@query(f"WITH {LINE_POINTS}, {RULE_STEPS} SELECT {RULE_OUTPUT} FROM c")
def spc_nelson(spark, d):
    """Limits and all run rules of every line parameter."""
    return rounded(spc.analyze_all(lineitem(spark, d), PARAMETERS, (), LINE_ORDER))


@query(f"WITH {event_points(['value', 'k'])}, {RULE_STEPS} SELECT s AS event_type, {RULE_OUTPUT} FROM c")
def spc_nelson_by_series(spark, d):
    """The same per sensor series."""
    return rounded(spc.analyze_all(sensors(spark, d), ["value", "k"], ["event_type"], ["event_id"]))


SHEWHART_SQL = (
    "lim AS (SELECT s, parameter, n, mean, sd, mean - 3 * sd AS lcl, mean + 3 * sd AS ucl FROM st), "
    "v AS (SELECT p.s, p.parameter, count(*) FILTER (WHERE value > ucl OR value < lcl) AS violations "
    "FROM pts p JOIN lim ON p.s = lim.s AND p.parameter = lim.parameter GROUP BY p.s, p.parameter)"
)


@query(
    f"WITH {event_points(['value', 'k'])}, {STATS}, {SHEWHART_SQL} SELECT lim.s AS event_type, lim.parameter, n, "
    "round(mean, 6) AS mean, round(sd, 6) AS std, round(lcl, 6) AS lcl, round(ucl, 6) AS ucl, violations, "
    "round(violations / n * 100.0, 6) AS criticality FROM lim JOIN v ON lim.s = v.s AND lim.parameter = v.parameter"
)
def spc_shewhart(spark, d):
    return rounded(spc.shewhart(sensors(spark, d), ["value", "k"], ["event_type"]))


ALERT_SQL = (
    f"WITH {event_points(['value', 'k', 'patchy'])}, {STATS}, {SHEWHART_SQL}, "
    "j AS (SELECT lim.s, lim.parameter, violations, violations / n * 100.0 AS crit FROM lim JOIN v ON lim.s = v.s "
    "AND lim.parameter = v.parameter WHERE violations > 0) "
)


@query(
    ALERT_SQL + "SELECT s AS event_type, parameter, format('{} violation(s) hors limite &middot; criticite {:.2f}%', violations, crit) "
    "AS message, CASE WHEN crit >= 1 OR violations >= 3 THEN 'danger' ELSE 'warn' END AS severity, violations, "
    "round(crit, 6) AS criticality FROM j"
)
def spc_alerts(spark, d):
    control = spc.shewhart(sensors(spark, d), ["value", "k", "patchy"], ["event_type"])
    return rounded(spc.alerts(control, ["event_type"]))


@query(
    ALERT_SQL + "SELECT s AS event_type, parameter, CASE WHEN crit >= 1 OR violations >= 3 THEN 'danger' ELSE 'warn' END AS severity, "
    "violations, round(crit, 6) AS criticality FROM j ORDER BY crit DESC, s, parameter LIMIT 12"
)
def spc_alerts_top(spark, d):
    control = spc.shewhart(sensors(spark, d), ["value", "k", "patchy"], ["event_type"])
    return rounded(spc.alerts(control, ["event_type"], 12).drop("message"))


@query(
    f"WITH {event_points(['value'])}, {STATS} SELECT p.s AS event_type, p.parameter, pos + 1 AS x, round(value, 6) AS value, "
    "round(mean, 6) AS mean, round(mean - 3 * sd, 6) AS lcl, round(mean + 3 * sd, 6) AS ucl, "
    "value BETWEEN mean - 3 * sd AND mean + 3 * sd AS in_control FROM pts p JOIN st ON p.s = st.s AND p.parameter = st.parameter"
)
def control_points(spark, d):
    points = ordered.to_points(sensors(spark, d), ["value"], ["event_type"], ["event_id"])
    return rounded(spc.control_points(points, ["event_type"]))


@query(
    f"WITH {event_points(['value'])}, {STATS}, a AS (SELECT e.ts, e.event_type, st.mean, st.sd, e.value FROM events e JOIN st ON st.s = e.event_type) "
    "SELECT date_trunc('day', ts) AS window_start, CASE WHEN value > mean + 4 * sd THEN 'danger' ELSE 'warn' END AS severity, "
    "count(*) AS alerts, count(DISTINCT event_type) AS parameters FROM a WHERE value > mean + 3 * sd GROUP BY 1, 2"
)
def alert_timeline(spark, d):
    stats = clean.column_stats(sensors(spark, d), ["value"], ["event_type"]).drop("parameter")
    hits = join_small(sensors(spark, d), stats, ["event_type"]).where(F.col("value") > F.col("mean") + 3 * F.col("std"))
    severity = F.when(F.col("value") > F.col("mean") + 4 * F.col("std"), "danger").otherwise("warn")
    rows = hits.select("ts", F.col("event_type").alias("parameter"), severity.alias("severity"))
    return spc.alert_timeline(rows, "ts")


# --- drift -------------------------------------------------------------------

CUSUM_STEPS = (
    "u AS (SELECT p.s, p.parameter, pos, st.sd, CASE WHEN pos = 0 THEN 0 ELSE value - mean - 0.5 * sd END AS up, "
    "CASE WHEN pos = 0 THEN 0 ELSE mean - 0.5 * sd - value END AS down FROM pts p JOIN st ON p.s = st.s AND p.parameter = st.parameter "
    "WHERE n >= 10 AND sd >= 1e-12), "
    "t AS (SELECT *, sum(up) OVER w AS su, sum(down) OVER w AS sd2 FROM u WINDOW w AS (PARTITION BY s, parameter ORDER BY pos)), "
    "cc AS (SELECT *, su - min(su) OVER w AS cp, sd2 - min(sd2) OVER w AS cm FROM t WINDOW w AS (PARTITION BY s, parameter ORDER BY pos)), "
    "cu AS (SELECT s, parameter, count(*) FILTER (WHERE cp > 4 * sd) AS up, count(*) FILTER (WHERE cm > 4 * sd) AS down, "
    "min(pos) FILTER (WHERE cp > 4 * sd OR cm > 4 * sd) AS idx FROM cc GROUP BY s, parameter)"
)
REASON = "CASE WHEN n < 10 THEN 'n=' || n || ' < 10' WHEN sd < 1e-12 THEN 'ecart-type nul (serie constante)' ELSE '' END"


@query(
    f"WITH {LINE_POINTS}, {STATS}, {CUSUM_STEPS} SELECT parameter, up AS cusum_signal_up, down AS cusum_signal_down, "
    "idx AS cusum_first_idx, true AS cusum_valid, '' AS cusum_reason FROM cu"
)
def drift_cusum(spark, d):
    """CUSUM of the line parameters (one long series each)."""
    points = ordered.to_points(lineitem(spark, d), PARAMETERS, (), LINE_ORDER)
    return drift.cusum(points, ["parameter"])


# EWMA step by step, one level of recursion per sample
EWMA_STEPS = (
    "ew AS (SELECT p.s, p.parameter, pos, mean AS e FROM pts p JOIN st ON p.s = st.s AND p.parameter = st.parameter "
    "WHERE pos = 0 AND n >= 10 AND sd >= 1e-12 UNION ALL "
    "SELECT p.s, p.parameter, p.pos, 0.2 * p.value + 0.8 * ew.e FROM ew JOIN pts p ON p.s = ew.s AND p.parameter = ew.parameter AND p.pos = ew.pos + 1)"
)
EWMA_COUNT = (
    "eo AS (SELECT ew.s, ew.parameter, pos, abs(e - mean) > 3 * sd * sqrt(0.2 / 1.8) AS hit FROM ew JOIN st ON st.s = ew.s AND st.parameter = ew.parameter), "
    "ec AS (SELECT s, parameter, count(*) FILTER (WHERE hit) AS hits, min(pos) FILTER (WHERE hit) AS idx FROM eo GROUP BY s, parameter)"
)


@query(
    f"WITH RECURSIVE {event_points(['value'])}, {STATS}, {EWMA_STEPS} SELECT s AS event_type, ew.parameter, pos, round(e, 6) AS ewma FROM ew"
)
def drift_ewma_points(spark, d):
    points = ordered.to_points(sensors(spark, d), ["value"], ["event_type"], ["event_id"])
    keys = ["event_type", "parameter"]
    return rounded(drift.ewma_points(points, keys).select(*keys, "pos", "ewma"))


_DRIFT_COLUMNS = ["value", "patchy", "nearly_dead", "frozen"]


@query(
    f"WITH RECURSIVE {event_points(_DRIFT_COLUMNS)}, {STATS}, {CUSUM_STEPS}, {EWMA_STEPS}, {EWMA_COUNT} "
    "SELECT st.s AS event_type, st.parameter, coalesce(hits, 0) AS ewma_violations, coalesce(up, 0) AS cusum_signal_up, "
    "coalesce(down, 0) AS cusum_signal_down, ec.idx AS ewma_first_idx, cu.idx AS cusum_first_idx, "
    "coalesce(hits, 0) + coalesce(up, 0) + coalesce(down, 0) > 0 AS drift_detected, "
    f"CASE WHEN {REASON} = '' THEN '' ELSE 'EWMA: ' || {REASON} || ' | CUSUM: ' || {REASON} END AS reason "
    "FROM st LEFT JOIN cu ON st.s = cu.s AND st.parameter = cu.parameter LEFT JOIN ec ON st.s = ec.s AND st.parameter = ec.parameter"
)
def drift_summary(spark, d):
    """EWMA and CUSUM of every sensor column, gaps dropped per column."""
    return drift.detect_drift(sensors(spark, d), _DRIFT_COLUMNS, ["event_type"], ["event_id"])


# --- losses ------------------------------------------------------------------

_SPECS = {
    "l_quantity": (-30.0, 90.0), "l_extendedprice": (0.0, 60000.0), "l_discount": (-0.1, 0.2), "l_tax": (0.08, 0.0),
    "absent": (0.0, 1.0), "l_returnflag": (0.0, 1.0),
}


@query(
    "WITH sp(parameter, lsl, usl) AS (VALUES " + ", ".join(f"('{p}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for p, (a, b) in _SPECS.items() if p[:2] == "l_" and a < b and p != "l_returnflag")
    + "), long AS (" + " UNION ALL ".join(f"SELECT l_linestatus, '{p}' AS parameter, {p} AS v FROM lineitem" for p in PARAMETERS)
    + "), st AS (SELECT l_linestatus, parameter, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM long GROUP BY 1, 2), "
    "j AS (SELECT st.*, lsl, usl, least((usl - mean) / (3 * sd), (mean - lsl) / (3 * sd)) AS cpk FROM sp JOIN st ON sp.parameter = st.parameter) "
    "SELECT l_linestatus, parameter, lsl, usl, n, round(mean, 6) AS mean, round(sd, 6) AS std, round(cpk, 6) AS cpk, "
    "CASE WHEN cpk >= 1.33 THEN 'CAPABLE' WHEN cpk >= 1 THEN 'MARGINAL' ELSE 'NON_CAPABLE' END AS verdict FROM j"
)
def capability_cpk(spark, d):
    """Capability per line status where limits are usable."""
    specs = losses.specs_frame(spark, {p: v for p, v in _SPECS.items() if p in PARAMETERS and v[0] < v[1]})
    return rounded(losses.cpk(lineitem(spark, d), specs, ["l_linestatus"]))


@query(
    "WITH st AS (SELECT count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd FROM lineitem) "
    "SELECT 'l_quantity' AS parameter, n, round(least((90 - mean) / (3 * sd), (mean + 30) / (3 * sd)), 6) AS cpk, "
    "CASE WHEN least(90 - mean, mean + 30) / (3 * sd) >= 1.33 THEN 'CAPABLE' WHEN least(90 - mean, mean + 30) / (3 * sd) >= 1 THEN 'MARGINAL' ELSE 'NON_CAPABLE' END AS verdict FROM st "
    "UNION ALL SELECT 'l_tax', 0, NULL, 'ERREUR: lsl (0.08) doit etre strictement inferieur a usl (0.0).' "
    "UNION ALL SELECT 'absent', 0, NULL, 'COLONNE_ABSENTE' "
    "UNION ALL SELECT 'fixe', n, CAST('inf' AS DOUBLE), 'CONSTANTE_DANS_SPECS' FROM (SELECT count(*) AS n FROM lineitem) "
    "UNION ALL SELECT 'hors', n, 0.0, 'CONSTANTE_HORS_SPECS' FROM (SELECT count(*) AS n FROM lineitem)"
)
def capability_verdicts(spark, d):
    """Every special verdict: bad limits, absent column, constants inside and outside."""
    rows = lineitem(spark, d).select("*", F.lit(5.0).alias("fixe"), F.lit(50.0).alias("hors"))
    specs = losses.specs_frame(
        spark, {"l_quantity": (-30, 90), "l_tax": (0.08, 0.0), "absent": (0, 1), "fixe": (0, 10), "hors": (0, 10)}
    )
    return rounded(losses.cpk(rows, specs).select("parameter", "n", "cpk", "verdict"))


@query(
    "SELECT l_returnflag, round(sum(l_tax), 4) AS defects, sum(l_quantity) AS volume, 'OK' AS status, "
    "round(sum(l_tax) / sum(l_quantity) * 1000000, 4) AS ppm FROM lineitem GROUP BY l_returnflag"
)
def ppm_by_shift(spark, d):
    return rounded(losses.ppm(lineitem(spark, d), "l_tax", "l_quantity", ["l_returnflag"]), 4)


_PERIOD = "CASE WHEN l_shipdate < lo + INTERVAL 10 DAY THEN 'debut' WHEN l_shipdate >= hi - INTERVAL 7 DAY THEN 'fin' ELSE 'milieu' END"


@query(
    "WITH b AS (SELECT min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem), "
    f"p AS (SELECT {_PERIOD} AS period, l_tax, l_quantity FROM lineitem, b) "
    "SELECT period, round(sum(l_tax), 4) AS defects, sum(l_quantity) AS volume, 'OK' AS status, "
    "round(sum(l_tax) / sum(l_quantity) * 1000000, 4) AS ppm FROM p GROUP BY period"
)
def ppm_by_period(spark, d):
    """Defect rate in the first ten and last seven days."""
    return rounded(losses.ppm_by_period(lineitem(spark, d), "l_shipdate", "l_tax", "l_quantity"), 4)


def _rank_sql(table: str, params, defect: str, by: str) -> str:
    long = " UNION ALL ".join(
        f"SELECT {by} AS s, '{p}' AS parameter, {p} AS p, {defect} AS d FROM {table} WHERE {p} IS NOT NULL AND {defect} IS NOT NULL"
        for p in params
    )
    return (
        f"long AS ({long}), rk AS (SELECT *, rank() OVER (PARTITION BY s, parameter ORDER BY p) + "
        "(count(*) OVER (PARTITION BY s, parameter, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY s, parameter ORDER BY d) + "
        "(count(*) OVER (PARTITION BY s, parameter, d) - 1) / 2.0 AS rd FROM long), "
        "co AS (SELECT s, parameter, count(*) AS n, corr(p, d) AS pr, corr(rp, rd) AS sr FROM rk GROUP BY s, parameter)"
    )


@query(
    f"WITH {_rank_sql('lineitem', PARAMETERS[:3], 'l_tax', repr('all'))} SELECT parameter, n, round(pr, 6) AS pearson_r, "
    "round(sr, 6) AS spearman_r FROM co"
)
def loss_correlation(spark, d):
    """Pearson and Spearman of the line parameters against the defects."""
    table = losses.correlations(lineitem(spark, d), PARAMETERS[:3], "l_tax")
    return rounded(table.select("parameter", "n", "pearson_r", "spearman_r"))


@query(
    f"WITH sensors AS ({standins.SENSORS}), {_rank_sql('sensors', ['k', 'patchy', 'user_id'], 'value', 'event_type')} "
    "SELECT s AS event_type, parameter, n, round(pr, 6) AS pearson_r, round(sr, 6) AS spearman_r, '' AS motif FROM co "
    "UNION ALL SELECT event_type, 'frozen', 0, NULL, NULL, '''frozen'' : parametre constant, correlation non definie.' FROM events GROUP BY event_type"
)
def loss_correlation_by_series(spark, d):
    table = losses.correlations(sensors(spark, d), ["k", "patchy", "user_id", "frozen"], "value", ["event_type"])
    return rounded(
        table.select("event_type", "parameter", "n", "pearson_r", "spearman_r", F.coalesce("motif", F.lit("")).alias("motif"))
    )


# two-sided tail of a correlation by Simpson's rule: the t variable is sqrt(n - 2) * tan(angle), the angle's density cos^(n - 3)
def _tail_sql(r: str) -> str:
    low, high, steps = f"asin(least(1, abs({r})))", "least(pi() / 2, 60 / sqrt(n))", 4000
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"

    def area(start: str) -> str:
        return f"(({high}) - {start}) * (SELECT sum({weight} * pow(cos({start} + (({high}) - {start}) * i / {steps}), n - 3)) FROM range({steps + 1}) g(i))"

    return f"CASE WHEN {r} IS NULL THEN NULL WHEN {low} >= {high} THEN 0.0 ELSE {area(low)} / ({area('0')}) END"


_GAPPY = (
    f"(SELECT *, NULLIF(event_type, 'click') AS kind, CASE WHEN user_id < 0 THEN CAST(1 AS DOUBLE) END AS absent FROM ({standins.SENSORS}) x)"
)


@query(
    f"WITH sensors AS {_GAPPY}, {_rank_sql('sensors', ['k', 'patchy', 'user_id'], 'value', 'kind')}, "
    f"pv AS (SELECT s, parameter, n, pr, sr, {_tail_sql('pr')} AS pp, {_tail_sql('sr')} AS sp FROM co) "
    "SELECT s AS kind, parameter, n, round(pr, 6) AS pearson_r, round(pp, 6) AS pearson_p, round(sr, 6) AS spearman_r, round(sp, 6) AS spearman_p, "
    "'spearman' AS test_retenu, '' AS motif FROM pv UNION ALL "
    "SELECT DISTINCT kind, 'frozen', 0, NULL, NULL, NULL, NULL, 'NON_CALCULABLE', '''frozen'' : parametre constant, correlation non definie.' "
    "FROM sensors UNION ALL "
    "SELECT DISTINCT kind, 'absent', 0, NULL, NULL, NULL, NULL, 'NON_CALCULABLE', '''absent'' : moins de 3 observations communes exploitables.' "
    "FROM sensors"
)
def loss_analysis(spark, d):
    """The whole loss analysis, with a series without a name and a column without values."""
    result = analysis.analyze_losses(
        frame(spark, d, f"SELECT * FROM {_GAPPY}"), ["k", "patchy", "user_id", "frozen", "absent"], "value", series=["kind"]
    )
    kept = ("kind", "parameter", "n", "pearson_r", "pearson_p", "spearman_r", "spearman_p", "test_retenu")
    return rounded(result.correlations.select(*kept, F.coalesce("motif", F.lit("")).alias("motif")))


# --- shifts ------------------------------------------------------------------


@query(
    "WITH long AS (" + " UNION ALL ".join(f"SELECT l_returnflag AS shift, '{p}' AS parameter, {p} AS v FROM lineitem" for p in PARAMETERS)
    + ") SELECT shift, parameter, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, "
    "round(stddev_samp(v) / abs(avg(v)), 6) AS cv FROM long GROUP BY shift, parameter"
)
def shift_stability(spark, d):
    return rounded(shifts.shift_stability(lineitem(spark, d), "l_returnflag", PARAMETERS))


_KRUSKAL = (
    "WITH long AS (" + " UNION ALL ".join(f"SELECT l_returnflag AS shift, '{p}' AS parameter, {p} AS v FROM lineitem" for p in PARAMETERS)
    + "), ok AS (SELECT shift, parameter FROM long GROUP BY 1, 2 HAVING count(*) >= 3), "
    "rk AS (SELECT long.*, rank() OVER (PARTITION BY long.parameter ORDER BY v) + (count(*) OVER (PARTITION BY long.parameter, v) - 1) / 2.0 AS r "
    "FROM long JOIN ok ON long.shift = ok.shift AND long.parameter = ok.parameter), "
    "gr AS (SELECT parameter, shift, count(*) AS n, sum(r) AS sr FROM rk GROUP BY 1, 2), "
    "h AS (SELECT parameter, count(*) AS k, CAST(sum(n) AS DOUBLE) AS nn, sum(sr * sr / n) AS q FROM gr GROUP BY parameter), "
    "ti AS (SELECT parameter, sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM (SELECT parameter, v, count(*) AS t FROM rk GROUP BY 1, 2) GROUP BY 1), "
    "kw AS (SELECT h.parameter, k AS n_shifts, (12 / (nn * (nn + 1)) * q - 3 * (nn + 1)) / (1 - ties / (nn * nn * nn - nn)) AS h FROM h JOIN ti ON h.parameter = ti.parameter)"
)


@query(f"{_KRUSKAL} SELECT parameter, n_shifts, round(h, 4) AS h_statistic FROM kw")
def shift_kruskal(spark, d):
    """Kruskal-Wallis statistic between shifts."""
    table = shifts.compare_shifts(lineitem(spark, d), "l_returnflag", PARAMETERS)
    return rounded(table.select("parameter", "n_shifts", "h_statistic"), 4)


# three shifts: the tail of the chi-squared distribution with two degrees of freedom is exp(-h / 2)
@query(
    f"{_KRUSKAL} SELECT 'l_returnflag' AS shift_column, parameter, n_shifts, round(h, 4) AS h_statistic, round(exp(-h / 2), 6) AS p_value, "
    "exp(-h / 2) < 0.05 AS significatif_5pct FROM kw"
)
def shift_comparison(spark, d):
    """Detected shift column, test, p-value and verdict."""
    found = analysis.analyze_shifts(lineitem(spark, d), PARAMETERS)
    table = found.comparison.withColumn("shift_column", F.lit(found.shift_column))
    return table.withColumns({"h_statistic": F.round("h_statistic", 4) + 0.0, "p_value": F.round("p_value", 6) + 0.0})


# --- quality -----------------------------------------------------------------

_AUDITED = ["ts", "event_type", "value", "k", "spiky", "patchy", "outage", "nearly_dead", "frozen"]
_TYPES = {"ts": "datetime", "event_type": "categorical"}


def _gap_sql(column: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, " if by else ""
    return (
        f"SELECT {keys}max(run) AS gap FROM (SELECT {keys}grp, count(*) AS run FROM (SELECT {keys}event_id, {column} IS NULL AS miss, "
        f"row_number() OVER ({part}ORDER BY event_id) - row_number() OVER ({('PARTITION BY ' + by + ', ') if by else 'PARTITION BY '}{column} IS NULL ORDER BY event_id) AS grp "
        f"FROM sensors) WHERE miss GROUP BY {keys}grp)" + (f" GROUP BY {by}" if by else "")
    )


_AUDIT_SQL = f"WITH sensors AS ({standins.SENSORS}), a AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, '{_TYPES.get(c, 'numeric')}' AS type, count(*) AS n_total, count({c}) AS n_valid, "
    f"count(DISTINCT {c}) AS n_unique, coalesce(({_gap_sql(c)}), 0) AS max_gap_nan FROM sensors"
    for c in _AUDITED
) + "), p AS (SELECT *, 100.0 * (n_total - n_valid) / n_total AS miss FROM a)"


@query(
    _AUDIT_SQL + " SELECT col AS column, type, n_total, n_valid, round(CAST(miss AS DOUBLE), 2) AS pct_missing, max_gap_nan, n_unique, "
    "CASE WHEN miss >= 50 THEN 'danger' WHEN miss >= 20 OR max_gap_nan >= 20 OR (n_unique <= 1 AND type = 'numeric') THEN 'warn' ELSE 'ok' END AS verdict, "
    "CASE WHEN miss >= 50 THEN CAST(round_even(CAST(miss AS DOUBLE), 0) AS BIGINT) || '% manquantes - colonne non exploitable' "
    "WHEN miss >= 20 THEN CAST(round_even(CAST(miss AS DOUBLE), 0) AS BIGINT) || '% manquantes - investigation recommandee' "
    "WHEN max_gap_nan >= 20 THEN 'Trou capteur detecte (' || max_gap_nan || ' NaN consecutifs)' "
    "WHEN n_unique <= 1 AND type = 'numeric' THEN 'Valeur constante - aucune information' ELSE 'Conforme' END AS commentaire FROM p"
)
def quality_audit(spark, d):
    return quality.audit(sensors(spark, d), ["event_id"], _AUDITED)


@query(
    _AUDIT_SQL + ", v AS (SELECT n_total, CASE WHEN miss >= 50 THEN 'danger' WHEN miss >= 20 OR max_gap_nan >= 20 OR "
    "(n_unique <= 1 AND type = 'numeric') THEN 'warn' ELSE 'ok' END AS verdict FROM p) SELECT count(*) AS n_columns, max(n_total) AS n_rows, "
    "count(*) FILTER (WHERE verdict = 'ok') AS n_ok, count(*) FILTER (WHERE verdict = 'warn') AS n_warn, "
    "count(*) FILTER (WHERE verdict = 'danger') AS n_danger FROM v"
)
def quality_summary(spark, d):
    return quality.audit_summary(quality.audit(sensors(spark, d), ["event_id"], _AUDITED))


@query(
    f"WITH sensors AS ({standins.SENSORS}) "
    + " UNION ALL ".join(
        f"SELECT e.event_type, '{c}' AS column, coalesce(gap, 0) AS max_gap FROM (SELECT DISTINCT event_type FROM sensors) e "
        f"LEFT JOIN ({_gap_sql(c, 'event_type')}) g ON g.event_type = e.event_type"
        for c in ("value", "patchy", "outage", "nearly_dead")
    )
)
def longest_gaps(spark, d):
    """Longest run of missing samples per sensor series and column."""
    return quality.longest_gaps(sensors(spark, d), ["value", "patchy", "outage", "nearly_dead"], ["event_id"], ["event_type"])


@query(
    "SELECT l_returnflag, CAST(sum(c - 1) AS BIGINT) AS duplicates FROM (SELECT l_returnflag, l_shipdate, count(*) AS c FROM lineitem "
    "GROUP BY 1, 2) GROUP BY l_returnflag"
)
def duplicate_timestamps(spark, d):
    return quality.duplicate_timestamps(lineitem(spark, d), "l_shipdate", ["l_returnflag"])


_SPARSE = ["value", "patchy", "nearly_dead", "event_type"]


@query(
    f"WITH sensors AS ({standins.SENSORS}) SELECT event_id, value, patchy FROM sensors WHERE value IS NOT NULL AND patchy IS NOT NULL"
)
def clean_sparse_columns(spark, d):
    """Sparse and text columns are dropped before rows with gaps."""
    return clean.clean_data(sensors(spark, d), _SPARSE, 0.05, ["event_id"]).rows


@query(
    f"WITH sensors AS ({standins.SENSORS}), r AS (SELECT count(*) AS n, count(value) AS a, count(patchy) AS b, count(nearly_dead) AS c FROM sensors) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column, n AS n_total, {e} AS n_valid, round({e} / n, 6) AS valid_ratio, {e} / n >= 0.05 AS kept FROM r"
        for c, e in zip(_SPARSE, ("a", "b", "c", "CAST(0 AS BIGINT)"))
    )
)
def valid_ratios(spark, d):
    return rounded(clean.valid_ratios(sensors(spark, d), _SPARSE))


_LINE_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *PARAMETERS, "l_returnflag", "l_linestatus", "l_shipdate")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column, {str(c not in _LINE_COLUMNS[-3:]).lower()} AS candidate, "
        + ("true" if c in _LINE_COLUMNS[-3:-1] else f"count(DISTINCT {c}) <= 10") + " AS categorical FROM lineitem HAVING count(*) > 0"
        for c in _LINE_COLUMNS
    )
)
def column_roles(spark, d):
    """Which columns may be analysed, which may group."""
    rows = lineitem(spark, d)
    usable, groups = set(clean.candidate_columns(rows)), set(clean.categorical_columns(rows))
    return spark.createDataFrame(
        [(c, c in usable, c in groups) for c in rows.columns], "column string, candidate boolean, categorical boolean"
    )


# --- ingest ------------------------------------------------------------------

# Lines as a factory export would hold them: units, French decimals, sentinels, dates as text.
EXPORT = """
SELECT event_id, CASE WHEN k < 5 THEN 'N/A' WHEN k < 10 THEN '-9999' WHEN k < 13 THEN ' sensor_fail '
            ELSE concat(replace(CAST(CAST(value AS DECIMAL(10, 2)) AS STRING), '.', ','), CASE WHEN k < 40 THEN ' degC' ELSE '' END) END AS temperature,
       CASE WHEN k < 30 THEN '' ELSE CAST(k AS STRING) END AS poste,
       CAST(CAST(ts AS DATE) AS STRING) AS jour, event_type AS libelle
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e
"""


@query(
    f"WITH x AS ({EXPORT}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column, count(*) FILTER (WHERE lower(trim({c})) IN ({', '.join(quoted(t.lower()) for t in files.SENTINEL_TEXTS)}, "
        f"'-9999', '-9999.0', '-999', '-999.0', '-273.15', '9999', '9999.0', '65535', '65535.0')) AS sentinels FROM x"
        for c in ("temperature", "poste", "jour", "libelle")
    )
)
def sentinel_counts(spark, d):
    rows = frame(spark, d, EXPORT)
    counted = rows.agg(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.count_if(files.sentinel_condition(F.col(c))).alias("sentinels"))
                for c in ("temperature", "poste", "jour", "libelle")
            ]
        ).alias("_a")
    )
    return counted.select(F.explode("_a").alias("_c")).select("_c.*")


@query(
    f"WITH x AS ({EXPORT}) SELECT event_id, CASE WHEN regexp_matches(replace(regexp_replace(replace(trim(temperature), ' ', ''), '[a-zA-Z°%]+$', ''), ',', '.'), "
    "'^[+-]?[0-9.]+$') THEN CAST(replace(regexp_replace(replace(trim(temperature), ' ', ''), '[a-zA-Z°%]+$', ''), ',', '.') AS DOUBLE) END AS temperature FROM x"
)
def french_numbers(spark, d):
    return frame(spark, d, EXPORT).select("event_id", files.french_number(F.col("temperature")).alias("temperature"))


@query(
    f"WITH x AS ({EXPORT}), y AS (SELECT event_id, CASE WHEN lower(trim(temperature)) NOT IN ('n/a', '-9999', 'sensor_fail') THEN temperature END AS t, "
    "CASE WHEN poste <> '' THEN poste END AS poste, jour, nullif(libelle, 'error') AS libelle FROM x) SELECT event_id, "
    "CAST(replace(regexp_replace(replace(trim(t), ' ', ''), '[a-zA-Z°%]+$', ''), ',', '.') AS DOUBLE) AS temperature, "
    "CAST(poste AS DOUBLE) AS poste, strftime(CAST(jour AS DATE), '%Y-%m-%d') AS jour, libelle FROM y"
)
def promote_types(spark, d):
    """Sentinels, dates and French numbers decided per column from its values."""
    typed, _ = files.promote_types(frame(spark, d, EXPORT), ["event_id"])
    return typed.withColumn("jour", F.date_format("jour", "yyyy-MM-dd"))


@query(
    f"WITH x AS ({EXPORT}), s AS (SELECT count(*) AS n, count(*) FILTER (WHERE lower(trim(temperature)) IN ('n/a', '-9999', 'sensor_fail')) AS a, "
    "count(*) FILTER (WHERE poste = '') AS b, count(*) FILTER (WHERE libelle = 'error') AS c FROM x) SELECT 'Sentinelles remplacees : ' || (a + b + c) || ' valeurs | Decimales FR converties : 2 colonne(s) | "
    "Dates parsees : 1 colonne(s) | Resultat : ' || n || ' lignes x 4 colonnes' AS summary FROM s"
)
def load_report(spark, d):
    _, done = files.promote_types(frame(spark, d, EXPORT), ["event_id"])
    return done.frame(spark).select("summary")


# --- dashboard ---------------------------------------------------------------

_CV = "cv AS (" + " UNION ALL ".join(
    f"SELECT '{p}' AS parameter, count({p}) AS n, abs(stddev_samp({p}) / avg({p})) AS cv FROM lineitem" for p in PARAMETERS
) + ")"


@query(f"WITH {_CV} SELECT parameter, n, round(cv, 6) AS cv FROM cv ORDER BY cv DESC LIMIT 3")
def variation_top3(spark, d):
    return rounded(spc.variation_ranking(lineitem(spark, d), PARAMETERS, 3))


_SCORES = "sc AS (SELECT p_type || ' ' || p_brand AS parameter, sum(p_retailprice) AS score FROM part GROUP BY 1)"


@query(
    f"WITH {_SCORES}, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, parameter) AS rank FROM sc ORDER BY rank LIMIT 10) "
    "SELECT rank, parameter, round(score, 4) AS score, round(sum(score) OVER (ORDER BY rank) / sum(score) OVER () * 100, 4) AS cumulative_pct, "
    "round(sum(score) OVER (ORDER BY rank) / (SELECT sum(score) FROM sc) * 100, 4) AS cumulative_pct_of_all, "
    "CASE WHEN rank <= 3 THEN 'danger' WHEN rank <= 6 THEN 'warn' ELSE 'primary' END AS tier FROM top"
)
def pareto(spark, d):
    part = read_table(spark, f"{d}/part.parquet")
    scores = part.groupBy(F.concat_ws(" ", "p_type", "p_brand").alias("parameter")).agg(F.sum("p_retailprice").alias("score"))
    return rounded(spc.pareto(scores), 4)


@query(
    f"WITH sensors AS ({standins.SENSORS}) "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, " + ("CAST(1 AS DOUBLE)" if a == b else f"round(corr({a}, {b}), 4) + 0.0") + " AS r FROM sensors"
        + (" HAVING count(*) > 0" if a == b else "")
        for a in ("value", "k", "patchy", "user_id") for b in ("value", "k", "patchy", "user_id")
    )
)
def correlation_matrix(spark, d):
    return spc.correlation_matrix(sensors(spark, d), ["value", "k", "patchy", "user_id"], 4).withColumn("r", F.col("r") + 0.0)


@query(
    f"WITH {event_points(['value', 'k'])}, {STATS}, {SHEWHART_SQL} SELECT (SELECT count(*) FROM events) AS n_points, CAST(9 AS BIGINT) AS n_params, "
    "CAST(sum(violations) AS BIGINT) AS n_alerts FROM v"
)
def dashboard_kpis(spark, d):
    rows = sensors(spark, d)
    return analysis.dashboard_kpis(rows, spc.shewhart(rows, ["value", "k"], ["event_type"]))


@query(
    f"WITH {LINE_POINTS}, {STATS}, {SHEWHART_SQL} SELECT lim.parameter AS parametre, CAST(n AS VARCHAR) AS n, format('{{:.3f}}', mean) AS moyenne, "
    "format('{:.3f}', sd) AS ecart_type, format('{:.3f}', lcl) AS lcl, format('{:.3f}', ucl) AS ucl, CAST(violations AS VARCHAR) AS viol, "
    "format('{:.2f}', violations / n * 100.0) AS criticite_pct FROM lim JOIN v ON lim.parameter = v.parameter"
)
def report_rows(spark, d):
    return report.spc_rows(spc.shewhart(lineitem(spark, d), PARAMETERS))


# --- pre-filling -------------------------------------------------------------


@query(
    "WITH t(parameter, lo, hi) AS (VALUES ('l_quantity', CAST(10 AS DOUBLE), CAST(45 AS DOUBLE)), ('l_discount', CAST(0.02 AS DOUBLE), CAST(0.09 AS DOUBLE))), "
    "p AS (SELECT l_orderkey, l_linenumber, l_partkey, 'l_quantity' AS parameter, l_quantity AS value FROM lineitem UNION ALL "
    "SELECT l_orderkey, l_linenumber, l_partkey, 'l_discount', l_discount FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, l_partkey, p.parameter, value, CASE WHEN value < lo THEN p.parameter || ' bas (' || format('{:.2f}', value) || ' < ' || lo || ')' "
    "ELSE p.parameter || ' haut (' || format('{:.2f}', value) || ' > ' || hi || ')' END AS suspect FROM p JOIN t ON t.parameter = p.parameter WHERE value < lo OR value > hi"
)
def out_of_target(spark, d):
    targets = spark.createDataFrame([("l_quantity", 10.0, 45.0), ("l_discount", 0.02, 0.09)], "parameter string, lo double, hi double")
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    cells = F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).alias("value")) for p in ("l_quantity", "l_discount", "l_tax")])
    rows = lineitem(spark, d).select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")
    return autofill.out_of_target(rows, targets, keys)


@query(
    "WITH st AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events) SELECT event_id, 'value' AS parameter, value, "
    "round(abs((value - m) / sd), 6) AS z, 'Lot atypique sur value (z=' || format('{:.1f}', abs((value - m) / sd)) || ')' AS suspect FROM events, st "
    "WHERE abs((value - m) / sd) > 2"
)
def atypical_lots(spark, d):
    rows = sensors(spark, d)
    current = rows.select("event_id", F.lit("value").alias("parameter"), "value")
    return rounded(autofill.atypical_lots(current, rows, ["value", "frozen"], keys=["event_id"]))


@query(
    f"WITH sensors AS ({standins.SENSORS}), l AS (SELECT * FROM sensors QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) = 1) "
    + " UNION ALL ".join(f"SELECT event_type, '{c}' AS parameter, CAST({c} AS DOUBLE) AS value FROM l WHERE {c} IS NOT NULL" for c in ("value", "k", "patchy", "nearly_dead"))
)
def last_values(spark, d):
    """Context of a defect: numeric values of the last sample of every series."""
    rows = sensors(spark, d).select("event_type", "event_id", "value", "k", "patchy", "nearly_dead")
    return autofill.last_values(rows, ["event_id"], ["event_type"]).where("parameter <> 'event_id'")


# --- text and similarity -----------------------------------------------------

_STOP = ", ".join(quoted(w) for w in dict.fromkeys(STOPWORDS))


def _tf_sql(name: str, source: str) -> str:
    folded = f"translate(lower(coalesce(description, '') || ' ' || coalesce(type_incident, '')), {quoted(FOLD_SIMILARITY[0])}, {quoted(FOLD_SIMILARITY[1])})"
    return (
        f"{name} AS ({source}), {name}_t AS (SELECT id, t, count(*) AS c FROM (SELECT id, unnest(regexp_extract_all({folded}, '[a-z0-9]{{2,}}')) AS t FROM {name}) "
        f"WHERE t NOT IN ({_STOP}) GROUP BY id, t), {name}_n AS (SELECT id, sqrt(sum(c * c)) AS norm FROM {name}_t GROUP BY id)"
    )


def _fold_sql(c: str) -> str:
    return f"nullif(translate(lower({c}), {quoted(FOLD_SIMILARITY[0])}, {quoted(FOLD_SIMILARITY[1])}), '')"


def _severity_sql(c: str) -> str:
    return "(CASE lower(" + c + ") " + " ".join(f"WHEN '{k}' THEN {int(v)}" for k, v in SEVERITY.items()) + " END)"


def _similar_sql(new: str, past: str, k: int) -> str:
    category = " + ".join(
        f"CASE WHEN {_fold_sql('q.' + f)} = {_fold_sql('h.' + f)} THEN CAST({w} AS DOUBLE) ELSE 0 END" for f, w in CATEGORY_WEIGHTS.items()
    )
    return (
        f"{_tf_sql('q', new)}, {_tf_sql('h', past)}, "
        "dots AS (SELECT q_t.id AS qid, h_t.id AS hid, sum(q_t.c * h_t.c) AS dot FROM q_t JOIN h_t ON q_t.t = h_t.t GROUP BY 1, 2), "
        f"sc AS (SELECT q.id AS case_id, h.id AS id, round(0.5 * coalesce(dot / (qn.norm * hn.norm), 0) + 0.3 * (({category}) / CAST(2.4 AS DOUBLE)) + "
        f"0.2 * coalesce(1 - abs({_severity_sql('q.severite')} - {_severity_sql('h.severite')}) / CAST(3 AS DOUBLE), 0.5), 9) AS similarity "
        "FROM q CROSS JOIN h LEFT JOIN dots ON dots.qid = q.id AND dots.hid = h.id LEFT JOIN q_n qn ON qn.id = q.id LEFT JOIN h_n hn ON hn.id = h.id), "
        f"sim AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY similarity DESC, id) AS rank FROM sc QUALIFY rank <= {k})"
    )


@query(
    f"WITH {_similar_sql(standins.NEW_CASES, standins.PAST_INCIDENTS, 5)} SELECT case_id, rank, id, round(similarity, 6) AS similarity FROM sim"
)
def case_similarity_top(spark, d):
    """Five most similar past incidents of every new case, over all documents."""
    found = similarity.find_similar(frame(spark, d, standins.NEW_CASES), frame(spark, d, standins.PAST_INCIDENTS), 5)
    return rounded(found)


_GRAMS = (
    "w AS (SELECT id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM docs), "
    "g AS (SELECT id, unnest(w) AS t FROM w UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w), "
    "tf AS (SELECT id, t, count(*) AS c FROM g GROUP BY id, t), "
    "voc AS (SELECT t AS term, CAST(sum(c) AS BIGINT) AS tf, count(*) AS df FROM tf GROUP BY t ORDER BY 2 DESC, t LIMIT 5000), "
    "idf AS (SELECT *, ln((1.0 + (SELECT count(*) FROM docs)) / (1 + df)) + 1 AS idf FROM voc)"
)


@query(f"WITH docs AS (SELECT doc_id AS id, text FROM documents), {_GRAMS} SELECT term, tf, df, round(idf, 6) AS idf FROM idf")
def tfidf_vocabulary(spark, d):
    """5000 most frequent words and word pairs with their idf."""
    documents = read_table(spark, f"{d}/documents.parquet")
    return rounded(retrieval.vocabulary(documents, "text"))


@query(
    f"WITH docs AS ({standins.RCA_CASES}), {_GRAMS}, "
    "hw AS (SELECT tf.id, tf.t, (1 + ln(tf.c)) * idf AS w FROM tf JOIN idf ON idf.term = tf.t), hn AS (SELECT id, sqrt(sum(w * w)) AS n FROM hw GROUP BY id), "
    "qd AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM benchmark), "
    "qg AS (SELECT id, unnest(w) AS t FROM qd UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM qd), "
    "qw AS (SELECT id, t, (1 + ln(count(*))) * any_value(idf) AS w FROM qg JOIN idf ON idf.term = qg.t GROUP BY id, t), qn AS (SELECT id, sqrt(sum(w * w)) AS n FROM qw GROUP BY id), "
    "sc AS (SELECT qw.id AS query_id, hw.id AS source_case_id, round(sum(qw.w * hw.w) / (any_value(qn.n) * any_value(hn.n)), 9) AS s "
    "FROM qw JOIN hw ON qw.t = hw.t JOIN qn ON qn.id = qw.id JOIN hn ON hn.id = hw.id GROUP BY 1, 2), "
    "lb AS (SELECT sc.*, validated_branch AS branch, validated_root_cause AS cause, defect_type, created_at FROM sc JOIN docs ON docs.id = source_case_id "
    "WHERE s > 0 AND validated_root_cause <> '' QUALIFY row_number() OVER (PARTITION BY query_id, branch, cause ORDER BY s DESC, source_case_id) = 1), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, source_case_id) AS rank FROM lb QUALIFY rank <= 5) "
    "SELECT query_id, rank, branch, cause, round(s, 6) AS confidence, source_case_id, "
    "'Cas similaire (defect: ' || defect_type || ') resolu le ' || substring(created_at, 1, 10) AS explanation FROM rk"
)
def tfidf_suggest(spark, d):
    """Best five distinct causes per new case by TF-IDF similarity."""
    engine = retrieval.TextEngine.fit(frame(spark, d, standins.RCA_CASES))
    queries = read_table(spark, f"{d}/benchmark.parquet").select(F.col("item_id").alias("id"), "text")
    return rounded(engine.suggest(queries))


def _markers_sql(markers) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN contains(t, {quoted(m)}) THEN {quoted(m)} END" for m in markers) + "], lambda x: x IS NOT NULL)"


_NODE_SQL = (
    f"WITH n AS ({standins.WORDED_NODES}), f AS (SELECT doc_id, niveau, translate(lower(reponse), {quoted(FOLD_CLASSIFIER[0])}, {quoted(FOLD_CLASSIFIER[1])}) AS t FROM n), "
    f"m AS (SELECT doc_id, niveau, {_markers_sql(ROOT_MARKERS)} AS r, {_markers_sql(CONDITION_MARKERS)} AS c, {_markers_sql(SYMPTOM_MARKERS)} AS y, "
    f"{_markers_sql(BLAME_MARKERS)} AS b FROM f), "
    "k AS (SELECT *, CASE WHEN len(r) > 0 THEN 'cause_racine' WHEN len(c) > 0 THEN 'condition' WHEN len(y) > 0 AND niveau <= 2 THEN 'symptome' ELSE 'cause_directe' END AS kind FROM m) "
)


@query(
    _NODE_SQL + "SELECT doc_id, CAST(niveau AS BIGINT) AS niveau, CASE WHEN len(b) > 0 THEN 'cause_directe' ELSE kind END AS type, "
    "CASE CASE WHEN len(b) > 0 THEN 'cause_directe' ELSE kind END WHEN 'cause_racine' THEN 'Cause racine' WHEN 'condition' THEN 'Condition' WHEN 'symptome' THEN 'Symptome' ELSE 'Cause directe' END AS type_label, "
    "round(CAST(CASE kind WHEN 'cause_racine' THEN least(1.0, 0.7 + 0.1 * len(r)) WHEN 'cause_directe' THEN 0.55 ELSE 0.6 END AS DOUBLE), 6) AS confidence, "
    "len(b) = 0 AND kind = 'cause_racine' AS is_root, len(b) > 0 AS is_blame, len(b) = 0 AND (kind = 'cause_racine' OR (niveau >= 5 AND kind = 'cause_directe')) AS should_stop, "
    f"CASE WHEN len(b) > 0 THEN '{STOP_REASONS['blame']}' WHEN kind = 'cause_racine' THEN '{STOP_REASONS['root']}' "
    f"WHEN niveau >= 5 AND kind = 'cause_directe' THEN '{STOP_REASONS['deep']}' ELSE '{STOP_REASONS['go_on']}' END AS raison_arret, "
    f"CASE WHEN len(b) > 0 THEN {quoted(FOLLOW_UP_QUESTION)} END AS relance_question, "
    "array_to_string(list_concat(CASE kind WHEN 'cause_racine' THEN r WHEN 'condition' THEN c WHEN 'symptome' THEN y ELSE [] END, b), ', ') AS markers FROM k"
)
def node_classify(spark, d):
    """Kind, blame, stop decision and markers of every why-answer."""
    graded = nodes.analyze_nodes(frame(spark, d, standins.WORDED_NODES))
    return rounded(graded.drop("reponse").withColumn("markers", F.array_join("markers", ", ")))


_FAMILY_ARMS = ", ".join(
    f"CASE WHEN regexp_matches(lower(cause), {quoted('(^|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])(' + '|'.join(FAMILY_WORDS[f]) + ')([^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]|$)')}) THEN '{f}' END"
    for f in FAMILIES
)


@query(f"WITH x AS ({standins.WORDED_CAUSES}) SELECT doc_id, array_to_string(list_filter([{_FAMILY_ARMS}], lambda x: x IS NOT NULL), ', ') AS families FROM x")
def cause_families(spark, d):
    """Cause texts assigned to machine, material and method."""
    return frame(spark, d, standins.WORDED_CAUSES).select("doc_id", F.array_join(text.families_of("cause"), ", ").alias("families"))


@query(
    f"WITH n AS ({standins.CHAINS}) SELECT id, repeat('★', CAST(round_even(confidence * 5, 0) AS INT)) || repeat('☆', 5 - CAST(round_even(confidence * 5, 0) AS INT)) AS stars, "
    "CASE WHEN length(reponse) <= 140 THEN reponse ELSE substring(reponse, 1, 137) || '...' END AS short FROM n"
)
def stars_and_short_text(spark, d):
    return frame(spark, d, standins.CHAINS).select("id", text.stars("confidence").alias("stars"), text.shorten("reponse").alias("short"))


# --- case base ---------------------------------------------------------------

_TALLY = (
    f"fb AS ({standins.FEEDBACK}), tally AS (SELECT chemin_id, count(*) FILTER (WHERE decision = 1) AS valid, count(*) FILTER (WHERE decision = -1) AS refus, "
    "count(*) FILTER (WHERE decision = 0) AS ajuste, CAST(sum(decision) AS BIGINT) AS net FROM fb GROUP BY chemin_id)"
)
_WEIGHT = "greatest(0.1, 1 + 0.3 * ln(1 + coalesce(valid, 0)) - 0.5 * coalesce(refus, 0))"


@query(f"WITH {_TALLY} SELECT * FROM tally")
def vote_tally(spark, d):
    return cases.vote_tally(frame(spark, d, standins.FEEDBACK))


@query(
    f"WITH {_TALLY}, n AS ({standins.CHAINS}) SELECT id, coalesce(valid, 0) AS valid, coalesce(refus, 0) AS refus, coalesce(net, 0) AS net, "
    f"round({_WEIGHT}, 6) AS weight FROM n LEFT JOIN tally ON chemin_id = id"
)
def path_weights(spark, d):
    weighted = cases.node_weights(frame(spark, d, standins.CHAINS), frame(spark, d, standins.FEEDBACK))
    return rounded(weighted.select("id", "valid", "refus", "net", "weight"))


_ROOTS = f"n AS ({standins.CHAINS}), roots AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY projet_id, branche_m ORDER BY est_cause_racine DESC, niveau DESC, id DESC) = 1)"


_FIRST_ROOTS = _ROOTS.replace(
    "est_cause_racine DESC, niveau DESC, id DESC",
    "est_cause_racine DESC, CASE WHEN est_cause_racine THEN niveau ELSE -niveau END, CASE WHEN est_cause_racine THEN id ELSE -id END",
)


@query(
    f"WITH {_TALLY}, {_ROOTS}, ch AS (SELECT projet_id, branche_m, string_agg(reponse, ' → ' ORDER BY niveau, id) AS chaine FROM n GROUP BY 1, 2) "
    "SELECT roots.projet_id, row_number() OVER (PARTITION BY roots.projet_id ORDER BY confidence DESC, roots.branche_m) AS rank, roots.branche_m, id AS root_id, reponse, "
    "round(confidence, 6) AS confidence, CASE WHEN coalesce(net, 0) > 0 THEN 'valide' ELSE 'propose' END AS etat, chaine FROM roots LEFT JOIN tally ON chemin_id = id "
    "JOIN ch ON ch.projet_id = roots.projet_id AND ch.branche_m = roots.branche_m"
)
def branches_ranked(spark, d):
    """Branches of a project by confidence of their root, with state and chain."""
    return rounded(cases.ranked_branches(frame(spark, d, standins.CHAINS), frame(spark, d, standins.FEEDBACK)))


@query(
    f"WITH n AS ({standins.CHAINS}), hr AS (SELECT DISTINCT projet_id FROM n WHERE est_cause_racine) SELECT projet_id, id, round(confidence, 6) AS confidence FROM n WHERE est_cause_racine "
    "UNION ALL (SELECT projet_id, id, round(confidence, 6) FROM n WHERE projet_id NOT IN (SELECT projet_id FROM hr) "
    "QUALIFY row_number() OVER (PARTITION BY projet_id ORDER BY confidence DESC, id) <= 5)"
)
def proposed_causes(spark, d):
    return rounded(cases.proposed_causes(frame(spark, d, standins.CHAINS)).select("projet_id", "id", "confidence"))


@query(
    f"WITH v AS ({standins.VALIDATIONS}), n AS ({standins.CHAINS}) SELECT n.id AS chemin_id, CASE decision WHEN 'valide' THEN 1 ELSE -1 END AS decision, "
    "'Vote ' || decision || ' de ' || role_valideur AS commentaire, nom_valideur AS valide_par, role_valideur FROM v JOIN n ON n.projet_id = v.projet_id WHERE est_cause_racine"
)
def record_outcomes(spark, d):
    """Votes written as feedback on the root nodes."""
    return cases.record_outcomes(frame(spark, d, standins.VALIDATIONS), frame(spark, d, standins.CHAINS))


_STATE = (
    f"v AS ({standins.VALIDATIONS}), gv AS (SELECT *, CASE role_valideur WHEN 'technician' THEN 'tech' WHEN 'maintenance' THEN 'tech' WHEN 'production' THEN 'prod' END AS g FROM v), "
    "lv AS (SELECT * FROM gv WHERE g IS NOT NULL QUALIFY row_number() OVER (PARTITION BY projet_id, g ORDER BY cree_le DESC, id DESC) = 1), "
    f"p AS ({standins.PROJECTS}), stt AS (SELECT p.id AS projet_id, statut, t.decision AS tech_decision, r.decision AS prod_decision, t.g IS NOT NULL AS tech_done, r.g IS NOT NULL AS prod_done, "
    "coalesce(t.decision = 'valide' AND r.decision = 'valide', false) AS all_valid, coalesce(t.decision = 'refuse', false) OR coalesce(r.decision = 'refuse', false) AS any_refused "
    "FROM p LEFT JOIN lv t ON t.projet_id = p.id AND t.g = 'tech' LEFT JOIN lv r ON r.projet_id = p.id AND r.g = 'prod')"
)


@query(f"WITH {_STATE} SELECT * FROM stt")
def validation_state(spark, d):
    state = cases.validation_state(frame(spark, d, standins.PROJECTS), frame(spark, d, standins.VALIDATIONS))
    return state.select("projet_id", "statut", "tech_decision", "prod_decision", "tech_done", "prod_done", "all_valid", "any_refused")


@query(
    f"WITH {_STATE}, o AS (SELECT *, CASE WHEN statut <> 'validation_en_cours' THEN NULL WHEN any_refused THEN 'refuse_back_to_cadrage' WHEN all_valid THEN 'valide' END AS resultat FROM stt) "
    "SELECT projet_id, statut, CASE resultat WHEN 'refuse_back_to_cadrage' THEN 'cadre' WHEN 'valide' THEN 'valide' ELSE statut END AS nouveau_statut, resultat FROM o"
)
def apply_votes(spark, d):
    return cases.apply_votes(cases.validation_state(frame(spark, d, standins.PROJECTS), frame(spark, d, standins.VALIDATIONS)))


@query(
    f"WITH {_STATE} SELECT projet_id, 'tech' AS vote_group FROM stt WHERE NOT tech_done UNION ALL SELECT projet_id, 'prod' FROM stt WHERE NOT prod_done"
)
def pending_votes(spark, d):
    return cases.pending_votes(frame(spark, d, standins.PROJECTS), frame(spark, d, standins.VALIDATIONS))


_EDGES = ", ".join(f"('{a}', '{b}')" for a, b in TRANSITIONS)
_KNOWN = ", ".join(f"'{s}'" for s in STATUS_LABELS)


@query(
    f"WITH e(a, b) AS (VALUES {_EDGES}), nx AS (SELECT a, '[''' || string_agg(b, ''', ''' ORDER BY b) || ''']' AS l FROM e GROUP BY a), r AS ({standins.TRANSITION_REQUESTS}), p AS ({standins.PROJECTS}), "
    "j AS (SELECT r.projet_id, p.statut, r.demande, e.b IS NOT NULL AS ok FROM r LEFT JOIN p ON p.id = r.projet_id LEFT JOIN e ON e.a = p.statut AND e.b = r.demande) "
    "SELECT projet_id, statut, demande, ok, CASE WHEN statut IS NULL THEN 'Projet ' || projet_id || ' introuvable' WHEN ok THEN '' "
    "ELSE 'Transition interdite : ' || statut || ' → ' || demande || '. Suivants possibles : ' || coalesce(l, 'aucun') END AS raison FROM j LEFT JOIN nx ON nx.a = j.statut"
)
def workflow_check(spark, d):
    """Requested status changes judged against the state graph."""
    return cases.check_transitions(frame(spark, d, standins.TRANSITION_REQUESTS), frame(spark, d, standins.PROJECTS))


_TEMPLATE_ROWS = ", ".join(
    f"({quoted(b)}, {i}, {quoted(q)}, {quoted(a)}, CAST({c} AS DOUBLE))" for b, chain in TEMPLATES.items() for i, (q, a, c) in enumerate(chain, 1)
)
_TREE = (
    f"{_similar_sql(standins.NEW_CASES, standins.CHAIN_INCIDENTS, 3)}, {_TALLY}, {_FIRST_ROOTS}, pr AS ({standins.CHAIN_PROJECTS}), "
    f"cand AS (SELECT sim.case_id, roots.branche_m, roots.projet_id, sim.id AS source_id, similarity, rank, similarity * {_WEIGHT} AS score FROM sim JOIN pr ON pr.incident_id = sim.id "
    "JOIN roots ON roots.projet_id = pr.id LEFT JOIN tally ON chemin_id = roots.id), "
    "best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY case_id, branche_m ORDER BY score DESC, rank, projet_id) = 1), "
    f"tp(branche_m, niveau, question, reponse, confidence) AS (VALUES {_TEMPLATE_ROWS}), "
    "tree AS (SELECT case_id, best.branche_m, CAST(n.niveau AS BIGINT) AS niveau, question, reponse, confidence * similarity AS confidence, type_noeud, est_cause_racine, source_id AS source_cas_id, "
    "similarity AS similarite_cas, 'cas_historique' AS origine FROM best JOIN n ON n.projet_id = best.projet_id AND n.branche_m = best.branche_m UNION ALL "
    "SELECT q.id, tp.branche_m, tp.niveau, question, reponse, confidence, CASE WHEN tp.niveau = 5 THEN 'cause_racine' ELSE 'cause_directe' END, tp.niveau = 5, NULL, NULL, 'template_synthetique' "
    "FROM q CROSS JOIN tp WHERE NOT EXISTS (SELECT 1 FROM best WHERE best.case_id = q.id AND best.branche_m = tp.branche_m))"
)


def _trees(spark, d):
    return cases.generate_trees(
        frame(spark, d, standins.NEW_CASES), frame(spark, d, standins.CHAIN_INCIDENTS), frame(spark, d, standins.CHAIN_PROJECTS),
        frame(spark, d, standins.CHAINS), frame(spark, d, standins.FEEDBACK), exclude_self=False,
    )


@query(
    f"WITH {_TREE} SELECT case_id, branche_m, niveau, question, reponse, round(confidence, 6) AS confidence, type_noeud, est_cause_racine, source_cas_id, "
    "round(similarite_cas, 6) AS similarite_cas, origine FROM tree"
)
def tree_generate(spark, d):
    """Why-trees of all new cases: best past chain per branch, template otherwise."""
    return rounded(_trees(spark, d))


@query(
    f"WITH {_TREE}, bc AS (SELECT case_id, branche_m, avg(confidence) AS c FROM tree GROUP BY 1, 2) SELECT case_id, branche_m, round(c, 6) AS branch_confidence, "
    "round(avg(c) OVER (PARTITION BY case_id), 6) AS global_confidence FROM bc"
)
def tree_confidence(spark, d):
    return rounded(cases.tree_confidence(_trees(spark, d)))


@query(
    f"WITH {_TREE}, t AS (SELECT case_id + 50 AS projet_id, tree.* FROM tree), mx AS (SELECT max(id) AS m FROM n), "
    "nw AS (SELECT m + row_number() OVER (ORDER BY projet_id, branche_m, niveau) AS id, projet_id, branche_m, niveau FROM t, mx), "
    "u AS (SELECT id, projet_id, branche_m, CAST(niveau AS BIGINT) AS niveau, lag(id) OVER (PARTITION BY projet_id, branche_m ORDER BY niveau, id) AS parent_id FROM nw) "
    "SELECT * FROM u UNION ALL SELECT id, projet_id, branche_m, CAST(niveau AS BIGINT), NULL FROM n WHERE projet_id NOT IN (SELECT projet_id FROM t)"
)
def trees_saved(spark, d):
    """Stored node table after writing the trees into it, read back: replaced projects, dense ids, parent links."""
    past = store.conform(frame(spark, d, standins.CHAINS), "chemins_pourquoi", F.lit("2026-01-01").cast("timestamp"))
    trees = _trees(spark, d).withColumn("projet_id", F.col("case_id") + 50)
    folder = work_folder(spark, "nodes")
    store.write_grouped(past, folder, "projet_id")
    cases.store_trees(spark, folder, trees)
    return rounded(store.read_grouped(spark, folder).select("id", "projet_id", "branche_m", "niveau", "parent_id"))


@query(
    f"WITH {_TALLY}, n AS ({standins.CHAINS}), pr AS ({standins.CHAIN_PROJECTS}) SELECT n.id, round(least(0.95, confidence * {_WEIGHT}), 6) AS confidence FROM n JOIN pr ON pr.id = n.projet_id "
    "LEFT JOIN tally ON chemin_id = n.id WHERE statut = 'valide'"
)
def enrich_validated(spark, d):
    """New confidence of the nodes of validated projects."""
    done = frame(spark, d, standins.CHAIN_PROJECTS).where("statut = 'valide'")
    patches, _, _ = cases.enrich_validated(done, frame(spark, d, standins.CHAINS), frame(spark, d, standins.FEEDBACK))
    return rounded(patches)


@query(
    f"WITH n AS ({standins.CHAINS}), pr AS ({standins.CHAIN_PROJECTS}) SELECT pr.id AS projet_id, count(n.id) AS noeuds_enrichis, CAST(1 AS BIGINT) AS incidents_marques "
    "FROM pr LEFT JOIN n ON n.projet_id = pr.id WHERE statut = 'valide' GROUP BY pr.id"
)
def enrich_report(spark, d):
    done = frame(spark, d, standins.CHAIN_PROJECTS).where("statut = 'valide'")
    _, _, summary = cases.enrich_validated(done, frame(spark, d, standins.CHAINS), frame(spark, d, standins.FEEDBACK))
    return rounded(summary)


# --- store -------------------------------------------------------------------


@query(
    f"WITH fb AS ({standins.FEEDBACK}), n AS ({standins.CHAINS}), pr AS ({standins.CHAIN_PROJECTS}), v AS ({standins.VALIDATIONS}) "
    "SELECT 'feedback_chemins' AS table_name, 'reference' AS rule, 'chemin_id' AS column, id FROM fb WHERE chemin_id NOT IN (SELECT id FROM n) UNION ALL "
    "SELECT 'validations', 'reference', 'projet_id', id FROM v WHERE projet_id NOT IN (SELECT id FROM pr) UNION ALL "
    "SELECT 'projets_ac', 'not_null', 'titre', id FROM pr"
)
def constraint_violations(spark, d):
    """Missing titles, orphan votes and orphan feedback of the derived tables."""
    tables = {
        "chemins_pourquoi": frame(spark, d, standins.CHAINS).withColumn("parent_id", F.lit(None).cast("bigint")),
        "feedback_chemins": frame(spark, d, standins.FEEDBACK),
        "projets_ac": frame(spark, d, standins.CHAIN_PROJECTS).withColumns({"titre": F.lit(None).cast("string"), "incident_id": F.lit(None).cast("bigint")}),
        "validations": frame(spark, d, standins.VALIDATIONS),
    }
    return store.constraint_violations(tables)


@query(
    f"WITH i AS ({standins.ORDER_INCIDENTS}), v AS ({standins.VALIDATIONS}), lp AS (SELECT projet_id AS id, max_by(decision, id) AS s, count(*) AS k FROM v GROUP BY projet_id) "
    "SELECT i.id, machine, coalesce(s, statut) AS statut, s IS NOT NULL AS changed FROM i LEFT JOIN lp ON lp.id = i.id"
)
def patched_incidents(spark, d):
    """A batch of status updates; the last patch per id wins, other columns are refused."""
    patches = frame(spark, d, standins.VALIDATIONS).select(
        F.col("projet_id").alias("id"), F.col("decision").alias("statut"), F.lit("x").alias("machine"), F.col("id").alias("patch_no")
    )
    return store.apply_patches(frame(spark, d, standins.ORDER_INCIDENTS), patches, "incidents").select("id", "machine", "statut", "changed")


@query(
    f"WITH a AS ({standins.ACTIONS}), mx AS (SELECT max(id) AS m FROM a), nw AS (SELECT event_id, user_id AS projet_id, '  ' || event_type || ' ' AS titre, "
    "CASE WHEN value > 50 THEN 1 END AS priorite FROM events) SELECT m + row_number() OVER (ORDER BY nw.event_id) AS id, projet_id, trim(titre) AS titre, '' AS description, '' AS assignee, "
    "CAST(coalesce(priorite, 2) AS BIGINT) AS priorite, 'a_faire' AS statut FROM nw, mx"
)
def appended_actions(spark, d):
    """New actions with defaults, trimmed titles and dense ids after the existing ones."""
    existing = frame(spark, d, standins.ACTIONS)
    fresh = read_table(spark, f"{d}/events.parquet").select(
        F.col("event_id").alias("_e"), F.col("user_id").alias("projet_id"), F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("titre"),
        F.when(F.col("value") > 50, 1).alias("priorite"), F.col("ts").alias("cree_le"),
    )
    # events carry distinct, growing timestamps: creation order is event order
    rows = store.append(existing, fresh, "actions", ["cree_le"])
    return rounded(rows.select("id", "projet_id", "titre", "description", "assignee", "priorite", "statut"))


@query(
    f"WITH a AS ({standins.ACTIONS}) SELECT id, projet_id, CAST(priorite AS BIGINT) AS priorite, statut FROM a WHERE statut = 'bloque'"
)
def list_actions(spark, d):
    rows = store.list_rows(frame(spark, d, standins.ACTIONS), "actions", statut="bloque")
    return rounded(rows.select("id", "projet_id", "priorite", "statut"))


@query(
    f"WITH n AS ({standins.CHAINS}) SELECT id, projet_id, round(confidence, 6) AS confidence FROM n WHERE est_cause_racine AND branche_m = 'Matiere'"
)
def root_cause_history(spark, d):
    rows = frame(spark, d, standins.CHAINS).withColumn("cree_le", F.lit("2026-01-01").cast("timestamp"))
    return rounded(store.root_cause_history(rows, "Matiere").select("id", "projet_id", "confidence"))


@query(
    f"WITH n AS ({standins.CHAINS}), pr AS ({standins.CHAIN_PROJECTS}) SELECT n.id, n.projet_id, branche_m FROM n WHERE projet_id NOT IN (SELECT id FROM pr WHERE statut = 'cadrage')"
)
def deleted_nodes(spark, d):
    gone = frame(spark, d, standins.CHAIN_PROJECTS).where("statut = 'cadrage'").select(F.col("id").alias("projet_id"))
    return store.delete_nodes(frame(spark, d, standins.CHAINS), gone).select("id", "projet_id", "branche_m")


@query(
    f"WITH p AS ({standins.PROJECTS}) SELECT id, statut, CASE statut " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in STATUS_LABELS.items())
    + " ELSE statut END AS label FROM p WHERE statut IN ('valide', 'solution_propose')"
)
def solvable_projects(spark, d):
    rows = store.solvable_projects(store.open_projects(frame(spark, d, standins.PROJECTS)))
    return rows.select("id", "statut", store.status_label().alias("label"))


@query(
    f"WITH i AS ({standins.ORDER_INCIDENTS}) SELECT count(*) FILTER (WHERE statut = 'brut') AS n_brut, count(*) FILTER (WHERE statut = 'fiabilise') AS n_fiabilise, count(*) AS n_total FROM i"
)
def incident_kpis(spark, d):
    return cases.incident_kpis(frame(spark, d, standins.ORDER_INCIDENTS))


@query(
    f"WITH a AS ({standins.ACTIONS}) SELECT count(*) AS n_total, count(*) FILTER (WHERE statut = 'fait') AS n_fait, count(*) FILTER (WHERE statut = 'bloque') AS n_bloque, "
    "round(count(*) FILTER (WHERE statut = 'fait') / count(*) * 100.0, 6) AS pct_fait FROM a"
)
def action_kpis(spark, d):
    return rounded(cases.action_kpis(frame(spark, d, standins.ACTIONS)))


def _choices(incidents: DataFrame) -> DataFrame:
    labels = [f"{c} — {label}" for c, label, *_ in cases.DEFECT_CATALOGUE] + ["inconnu"]
    return incidents.select("id", F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col("id") % len(labels) + 1).cast("int")).alias("libelle_choisi"))


@query(
    f"WITH i AS ({standins.ORDER_INCIDENTS}), ct(k, code, libelle, quoi) AS (VALUES "
    + ", ".join(f"({i}, {quoted(c)}, {quoted(lb)}, {quoted(q)})" for i, (c, lb, _, q) in enumerate((*cases.DEFECT_CATALOGUE, cases.DEFECT_CATALOGUE[-1])))
    + ") SELECT id AS incident_id, code, CASE WHEN code <> 'AUT-00' THEN 'Reduire ' || lower(libelle) || ' — ' || machine ELSE '' END AS titre, "
    "CASE WHEN quoi <> '' THEN quoi ELSE substring(description, 1, 120) END AS qqoqcp_quoi, machine AS qqoqcp_ou, "
    "CASE WHEN operateur_nom <> '' THEN 'Signale par ' || operateur_nom ELSE '' END AS qqoqcp_qui FROM i JOIN ct ON ct.k = id % 9"
)
def framed_projects(spark, d):
    """Projects prefilled from incident and defect catalogue."""
    incidents = frame(spark, d, standins.ORDER_INCIDENTS)
    return cases.frame_projects(incidents, _choices(incidents))


@query(
    f"WITH p AS ({standins.PROJECTS}), x AS (SELECT *, trim(solution_proposee) AS sol FROM p), y AS (SELECT *, CASE WHEN length(sol) <= 140 THEN sol ELSE substring(sol, 1, 137) || '...' END AS short FROM x), "
    "l AS (SELECT id, 'production' AS role, 0 AS o, CASE WHEN coalesce(gain_estime_eur, 0) <> 0 THEN 'Gain estime : ' || replace(format('{:,.0f}', gain_estime_eur), ',', ' ') || ' €/an' ELSE 'Gain : non-conformites evitees' END AS text FROM y "
    "UNION ALL SELECT id, 'production', 1, format('Productivite : +{:.1f} %', gain_productivite) FROM y WHERE coalesce(gain_productivite, 0) <> 0 "
    "UNION ALL SELECT id, 'production', 2, 'Mise en place : ' || format('{:.0f}', temps_estime_jours) || ' jour(s), sans arret ligne planifie' FROM y WHERE coalesce(temps_estime_jours, 0) <> 0 "
    "UNION ALL SELECT id, 'production', 3, CASE WHEN coalesce(cout_estime, 0) <> 0 THEN 'Cout : ' || replace(format('{:,.0f}', cout_estime), ',', ' ') || ' €' ELSE 'Cout : negligeable' END FROM y "
    "UNION ALL SELECT id, 'technician', 0, CASE WHEN sol <> '' THEN 'Mode operatoire : ' || short ELSE 'Mode operatoire a definir' END FROM y "
    "UNION ALL SELECT id, 'technician', 1, 'Moins de retouches a gerer pour son equipe' FROM y UNION ALL SELECT id, 'technician', 2, 'Il adapte la consigne au terrain — c''est lui le relais' FROM y "
    "UNION ALL SELECT id, 'operator', 0, CASE WHEN sol <> '' THEN '« ' || short || ' »' ELSE 'Consigne a definir' END FROM y "
    "UNION ALL SELECT id, 'operator', 1, 'Ce qui change a ton poste, rien de plus' FROM y UNION ALL SELECT id, 'operator', 2, 'Bouton « je bloque » si ca ne marche pas : c''est traite' FROM y) "
    "SELECT id AS projet_id, role, row_number() OVER (PARTITION BY id, role ORDER BY o) - 1 AS line, text FROM l"
)
def solution_sheets(spark, d):
    return rounded(cases.solution_sheets(frame(spark, d, standins.PROJECTS)))


def _stored_cases(spark, d):
    """Cases with maps, encoded to JSON text and read back."""
    rows = read_table(spark, f"{d}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("defect_type"), F.col("o_orderstatus").alias("context"),
        F.create_map(F.lit("prix"), F.round("o_totalprice", 2), F.lit("total"), F.round(F.col("o_totalprice") * 128, 0)).alias("parameters"),
        F.create_map(F.lit("Machine"), F.array(F.lit("usure"), F.col("o_orderstatus"))).alias("causes_5m"),
        F.when(F.col("o_orderstatus") != "P", F.lit("usure")).alias("validated_root_cause"), F.lit("Machine").alias("validated_branch"),
        F.lit(None).cast("string").alias("operator"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )
    return store.decode_rca(store.encode_rca(rows))


@query(
    "SELECT o_orderkey AS id, o_orderpriority || ' | ' || o_orderstatus || ' | prix=' || round(o_totalprice, 2) || ' | total=' || round(o_totalprice * 128, 0) || "
    "' | Machine: usure, ' || o_orderstatus AS text, "
    "CASE WHEN o_orderstatus <> 'P' THEN 'usure' ELSE '' END AS validated_root_cause, '' AS operator FROM orders"
)
def stored_cases(spark, d):
    """Round trip of stored root-cause cases and their text form, with values beyond 1e7."""
    return retrieval.rca_text(_stored_cases(spark, d)).select("id", "text", "validated_root_cause", "operator")


@query("SELECT count(*) AS n_cases, count(*) FILTER (WHERE o_orderstatus <> 'P') AS n_validated FROM orders")
def case_kpis(spark, d):
    return cases.case_kpis(_stored_cases(spark, d))


@query(
    "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS defect_type, 'Machine' AS validated_branch, "
    "CASE WHEN o_orderstatus <> 'P' THEN 'usure' ELSE '' END AS validated_root_cause, '' AS operator FROM orders"
)
def latest_cases(spark, d):
    return store.latest_cases(_stored_cases(spark, d))


_PREDICTIONS = """
SELECT event_id AS id, event_id AS defaut_id, user_id % 10 AS model_version_id, CAST(event_id % 3 + 1 AS INT) AS rank FROM events
"""


@query(
    f"WITH p AS ({_PREDICTIONS}) SELECT model_version_id, CAST(rank AS BIGINT) AS rank, count(*) AS n_feedback, count(*) FILTER (WHERE value > 30) AS n_correct, "
    "round(avg(CASE WHEN value > 30 THEN 1 ELSE 0 END), 6) AS hit_rate FROM p JOIN events ON event_id = id GROUP BY 1, 2"
)
def feedback_stats(spark, d):
    """Hit rate of predictions per model version and rank."""
    feedback = read_table(spark, f"{d}/events.parquet").select(F.col("event_id").alias("prediction_id"), (F.col("value") > 30).alias("was_correct"))
    return rounded(store.feedback_stats(frame(spark, d, _PREDICTIONS), feedback))


_VERSIONS = """
SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'Machine' WHEN 1 THEN 'Matiere' ELSE 'Methode' END AS m_axis, p_name AS version, p_size < 5 AS active FROM part
"""


@query(
    f"WITH v AS ({_VERSIONS}), ch AS (SELECT max(id) AS id FROM v WHERE m_axis <> 'Methode' GROUP BY m_axis) SELECT id, m_axis, CASE WHEN m_axis = 'Methode' THEN active ELSE id IN (SELECT id FROM ch) END AS active FROM v"
)
def activated_models(spark, d):
    """One chosen version per axis becomes the active one."""
    versions = frame(spark, d, _VERSIONS)
    chosen = versions.where("m_axis <> 'Methode'").groupBy("m_axis").agg(F.max("id").alias("id"))
    return store.activate_models(versions, chosen).select("id", "m_axis", "active")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2000-01-01' - INTERVAL 365 DAY")
def pruned_rows(spark, d):
    rows = read_table(spark, f"{d}/orders.parquet")
    return store.prune(rows, "o_orderdate", 365, F.lit("2000-01-01").cast("date")).select("o_orderkey", "o_orderstatus")


@query()
def training_data_hash(spark, d):
    """Order-free fingerprint of the training history."""
    return store.data_hash(frame(spark, d, standins.HISTORY))


# --- supervised --------------------------------------------------------------


def _labels_sql(family: str) -> str:
    pattern = quoted("(^|[^" + chr(92) + "p{L}" + chr(92) + "p{N}_])(" + "|".join(FAMILY_WORDS[family]) + ")([^" + chr(92) + "p{L}" + chr(92) + "p{N}_]|$)")
    return f"SELECT '{family}' AS m, CASE WHEN regexp_matches(lower(cause_racine), {pattern}) THEN cause_racine ELSE '{NO_CAUSE}' END AS label FROM h"


@query(
    f"WITH h AS ({standins.HISTORY}), l AS (" + " UNION ALL ".join(_labels_sql(f) for f in FAMILIES) + "), c AS (SELECT m, label, count(*) AS n FROM l GROUP BY 1, 2) "
    f"SELECT m, CASE WHEN n < 5 THEN '{NO_CAUSE}' ELSE label END AS label, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1, 2"
)
def label_distribution(spark, d):
    """Classes per family after merging the rare ones."""
    history = frame(spark, d, standins.HISTORY)
    parts = [supervised.label_counts(supervised.family_dataset(history, m)[0], m) for m in FAMILIES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_FEATURES = ("M_machine_temperature", "M_machine_pression", "M_matiere_humidite", "M_matiere_grammage", "M_methode_vitesse")


@query(
    f"WITH h AS ({standins.HISTORY}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n, round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS std FROM h" for c in _FEATURES
    )
)
def feature_statistics(spark, d):
    """Exact median and deviation of every feature."""
    history = frame(spark, d, standins.HISTORY)
    return rounded(supervised.feature_statistics(history, list(_FEATURES)))


def _train(spark, d):
    return supervised.train_all(frame(spark, d, standins.HISTORY))


def _engine(spark, d):
    """Models trained, saved and loaded again."""
    folder = work_folder(spark, "models")
    supervised.save_models(_train(spark, d), folder, spark)
    return supervised.SupervisedEngine.load(spark, folder)


def _contexts(spark, d):
    return frame(spark, d, standins.HISTORY).withColumn("case_id", F.concat_ws("-", *standins.HISTORY_KEY))


@query()
def supervised_training(spark, d):
    """Trained and skipped families with their metrics."""
    return _train(spark, d).frame(spark)


@query()
def supervised_suggest(spark, d):
    """Most likely causes over all families for every sample."""
    return _engine(spark, d).suggest(_contexts(spark, d), 3)


@query()
def supervised_explain(spark, d):
    """Largest feature contributions for every sample and family."""
    return _engine(spark, d).explain(_contexts(spark, d), 2)


_CASE_ID = " || '-' || ".join(standins.HISTORY_KEY)


@query(
    f"WITH h AS ({standins.HISTORY}), x AS (SELECT {_CASE_ID} AS case_id FROM h), f(m) AS (VALUES " + ", ".join(f"('{m}')" for m in FAMILIES)
    + ") SELECT case_id, m, true AS ranks_follow, true AS confidence_falls, true AS only_causes, true AS bounded FROM x CROSS JOIN f"
)
def supervised_contract(spark, d):
    """Every family and case: ranks from 1, falling confidences in 0..1, never the no-cause class, at most three causes or a reason."""
    rows = _engine(spark, d).predict(_contexts(spark, d), 3)
    by_rank = F.array_sort(F.collect_list(F.struct("rank", "confidence", "cause")))
    lists = rows.groupBy("case_id", "m", "available", "reason").agg(by_rank.alias("c"), F.count("rank").alias("n"))
    places, values = F.transform("c", lambda s: s["rank"]), F.transform("c", lambda s: -s["confidence"])
    known = F.col("n") > 0
    return lists.select(
        "case_id", "m", F.when(known, places == F.sequence(F.lit(1).cast("long"), F.col("n"))).otherwise(True).alias("ranks_follow"),
        F.when(known, F.array_sort(values) == values).otherwise(True).alias("confidence_falls"),
        F.when(known, F.forall("c", lambda s: (s["cause"] != NO_CAUSE) & s["confidence"].between(0, 1))).otherwise(True).alias("only_causes"),
        ((F.col("n") <= 3) & (F.col("available") | (F.col("reason") != ""))).alias("bounded"),
    )


@query(
    f"WITH h AS ({standins.HISTORY}) SELECT {_CASE_ID} AS case_id, true AS ranks_follow, true AS confidence_falls, true AS few FROM h"
)
def supervised_suggest_contract(spark, d):
    """Every sample's list: ranks from 1 and falling confidences, at most three causes."""
    contexts = _contexts(spark, d)
    by_rank = F.array_sort(F.collect_list(F.struct("rank", "confidence")))
    lists = _engine(spark, d).suggest(contexts, 3).groupBy("case_id").agg(by_rank.alias("c"))
    every = contexts.select("case_id").join(lists, "case_id", "left").withColumn("n", F.coalesce(F.size("c"), F.lit(0)))
    places, values = F.transform("c", lambda s: s["rank"]), F.transform("c", lambda s: -s["confidence"])
    known = F.col("n") > 0
    return every.select(
        "case_id", F.when(known, places == F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).otherwise(True).alias("ranks_follow"),
        F.when(known, F.array_sort(values) == values).otherwise(True).alias("confidence_falls"), (F.col("n") <= 3).alias("few"),
    )


# --- files and streams -------------------------------------------------------


@query(
    f"WITH x AS ({EXPORT}), y AS (SELECT event_id, CASE WHEN lower(trim(temperature)) NOT IN ('n/a', '-9999', 'sensor_fail') THEN temperature END AS t, "
    "CASE WHEN poste <> '' THEN poste END AS poste, jour, libelle FROM x) SELECT CAST(event_id + 100000 AS DOUBLE) AS numero, "
    "CAST(replace(regexp_replace(replace(trim(t), ' ', ''), '[a-zA-Z°%]+$', ''), ',', '.') AS DOUBLE) AS temperature, "
    "CAST(poste AS DOUBLE) AS poste, strftime(CAST(jour AS DATE), '%Y-%m-%d') AS jour, 'événement ' || libelle AS libelle FROM y"
)
def file_round_trip(spark, d):
    """Sensor table written as a Latin-1 export, then sniffed, read and typed again."""
    folder = work_folder(spark, "export")
    rows = frame(spark, d, EXPORT).select(
        (F.col("event_id") + 100000).cast("string").alias("numero"), "temperature", "poste", "jour",
        F.concat(F.lit("événement "), "libelle").alias("libelle"),
    )
    rows.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(folder)
    paths = spark.read.text(folder).inputFiles()
    loaded = files.load_files(spark, paths)
    typed = loaded[0].rows
    for part in loaded[1:]:
        typed = typed.unionByName(part.rows)
    return typed.select("numero", "temperature", "poste", F.date_format("jour", "yyyy-MM-dd").alias("jour"), "libelle")


# records with line breaks, doubled and stray quotes, under a two-row header whose first cell holds a line break
_QUOTED_HEADER = '"Lot\nprincipal";Texte;Mesure;\nnumero;libelle;taille;note'


@query(
    "SELECT CAST(doc_id AS DOUBLE) AS numero, 't ' || translate(coalesce(text, ''), chr(13) || chr(9) || ',|', '    ') || '.' AS libelle, CAST(coalesce(n_chars, 0) AS DOUBLE) AS taille, "
    "CASE doc_id % 3 WHEN 0 THEN '5\" x' WHEN 1 THEN '7\" y' ELSE 'z\"z\"' END AS note FROM documents"
)
def file_quoted_records(spark, d):
    """Whole texts as quoted cells beside stray quotes, written as files with a two-row header and read again.

    Other candidate separators are blanked, as the separator is sniffed from physical lines.
    """
    folder = work_folder(spark, "records")
    text = F.replace(F.concat(F.lit("t "), F.translate(F.coalesce("text", F.lit("")), "\r\t,|", "    "), F.lit(".")), F.lit('"'), F.lit('""'))
    note = F.when(F.col("doc_id") % 3 == 0, '5" x').when(F.col("doc_id") % 3 == 1, '7" y').otherwise('z"z"')
    record = F.concat(F.col("doc_id").cast("string"), F.lit(';"'), text, F.lit('";'), F.coalesce("n_chars", F.lit(0)).cast("string"), F.lit(";"), note)
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of each file
    read_table(spark, f"{d}/documents.parquet").select(F.concat(F.when(first, _QUOTED_HEADER + "\n").otherwise(""), record).alias("value")).write.text(folder)
    (loaded,) = files.load_files(spark, spark.read.text(folder).inputFiles())
    names = ("Lot\nprincipal_numero", "Texte_libelle", "Mesure_taille", "Mesure_note")
    return loaded.rows.select(*[F.col(f"`{n}`").alias(n.split("_")[1]) for n in names])


def _run_stream(spark, stream: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """Drain a stream into a table; that table and the stream's checkpoint."""
    folder = work_folder(spark, purpose)
    running = (
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out"), f"{folder}/state"


def _event_stream(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query(
    f"WITH RECURSIVE {event_points(['value'])}, {STATS}, "
    "p AS (SELECT pts.s, pts.pos, pts.value, st.mean, st.sd FROM pts JOIN st ON st.s = pts.s), "
    "m AS (SELECT s, pos, value, mean, sd, 0.2 * value + 0.8 * mean AS e, greatest(0, value - mean - 0.5 * sd) AS cp, greatest(0, mean - 0.5 * sd - value) AS cm FROM p WHERE pos = 0 "
    "UNION ALL SELECT p.s, p.pos, p.value, p.mean, p.sd, 0.2 * p.value + 0.8 * m.e, greatest(0, m.cp + p.value - p.mean - 0.5 * p.sd), greatest(0, m.cm + p.mean - 0.5 * p.sd - p.value) "
    "FROM m JOIN p ON p.s = m.s AND p.pos = m.pos + 1), "
    "a AS (SELECT s, 'limites' AS rule, value AS statistic FROM m WHERE abs(value - mean) > 3 * sd UNION ALL SELECT s, 'ewma', e FROM m WHERE abs(e - mean) > 3 * sd * sqrt(0.2 / 1.8) "
    "UNION ALL SELECT s, 'cusum_haut', cp FROM m WHERE cp > 4 * sd UNION ALL SELECT s, 'cusum_bas', cm FROM m WHERE cm > 4 * sd) "
    "SELECT s AS series, rule, round(statistic, 6) AS statistic FROM a"
)
def stream_monitor(spark, d):
    """Alerts of the sensor stream against limits frozen from a baseline."""
    baseline = clean.column_stats(sensors(spark, d), ["value"], ["event_type"]).select(
        F.col("event_type").alias("series"), "parameter", "mean", "std"
    )
    samples = _event_stream(spark, d).select(F.col("event_type").alias("series"), F.lit("value").alias("parameter"), "ts", "value")
    alerts, _ = _run_stream(spark, monitor.monitor(samples, baseline), "monitor")
    return rounded(alerts.select("series", "rule", "statistic"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS heure, event_type AS statut, count(*) AS n FROM events GROUP BY 1, 2")
def stream_status_counts(spark, d):
    """Events per hour and type: the windows that the watermark has closed, and those still open at the end."""
    counts = monitor.status_counts(_event_stream(spark, d), "ts", "event_type")
    closed, checkpoint = _run_stream(spark, counts, "counts")
    both = closed.unionByName(monitor.open_windows(spark, checkpoint, "event_type"))
    return both.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("heure"), "statut", "n")


# --- further lists and labels ------------------------------------------------


@query(
    f"WITH i AS ({standins.ORDER_INCIDENTS}), p AS ({standins.PROJECTS}) SELECT id, machine, severite FROM i WHERE id IN (SELECT id FROM p WHERE statut = 'valide')"
)
def incident_lookup(spark, d):
    """Batch of point lookups."""
    wanted = frame(spark, d, standins.PROJECTS).where("statut = 'valide'")
    return store.lookup(frame(spark, d, standins.ORDER_INCIDENTS), wanted).select("id", "machine", "severite")


@query(
    f"WITH i AS ({standins.ORDER_INCIDENTS}) SELECT id, strftime(cree_le, '%Y-%m-%d') AS jour, machine FROM i WHERE statut = 'brut'"
)
def newest_incidents(spark, d):
    rows = store.list_rows(store.open_incidents(frame(spark, d, standins.ORDER_INCIDENTS)), "incidents", statut="brut")
    return rows.select("id", F.date_format("cree_le", "yyyy-MM-dd").alias("jour"), "machine")


@query(
    "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS timestamp, o_orderstatus AS ligne FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50"
)
def newest_defects(spark, d):
    defects = read_table(spark, f"{d}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"), F.col("o_orderstatus").alias("ligne")
    )
    return store.list_defects(defects, 50, "F")


@query(
    "WITH md AS (SELECT event_type, median(value) AS md FROM events GROUP BY event_type) SELECT event_id, round(value - md, 6) AS delta, "
    "round(CASE WHEN md <> 0 THEN (value - md) / md * 100 ELSE 0 END, 6) AS delta_pct FROM events e JOIN md ON md.event_type = e.event_type"
)
def median_deviation(spark, d):
    """Every sample against the exact median of its series."""
    from plantlens.operators.ranks import exact_medians
    from plantlens.session import join_small

    rows = read_table(spark, f"{d}/events.parquet").select("event_id", "event_type", "value")
    joined = join_small(rows, exact_medians(rows, ["event_type"], "value"), ["event_type"])
    return rounded(joined.select("event_id", *autofill.deviation_from_median("value", "median")))


@query(
    f"WITH n AS (SELECT conv_id, turn, regexp_extract_all(translate(lower(text), {quoted(FOLD_SIMILARITY[0])}, {quoted(FOLD_SIMILARITY[1])}), '[a-z0-9]{{2,}}') AS w FROM conversations), "
    f"t AS (SELECT conv_id, turn, t, count(*) AS c FROM (SELECT conv_id, turn, unnest(w) AS t FROM n) WHERE t NOT IN ({_STOP}) GROUP BY 1, 2, 3), "
    "s AS (SELECT conv_id, turn, sqrt(sum(c * c)) AS norm FROM t GROUP BY 1, 2), dt AS (SELECT a.conv_id, a.turn, sum(a.c * b.c) AS dot FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 AND a.t = b.t GROUP BY 1, 2) "
    "SELECT n.conv_id, n.turn, round(coalesce(dot / (a.norm * b.norm), 0), 6) AS similarity FROM n LEFT JOIN dt ON dt.conv_id = n.conv_id AND dt.turn = n.turn "
    "LEFT JOIN s a ON a.conv_id = n.conv_id AND a.turn = n.turn LEFT JOIN s b ON b.conv_id = n.conv_id AND b.turn = n.turn - 1 WHERE n.turn > 0"
)
def turn_similarity(spark, d):
    """Word-count cosine of each answer with the one before it."""
    turns = read_table(spark, f"{d}/conversations.parquet").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("previous"))
    pairs = turns.join(before, ["conv_id", "turn"])
    return rounded(similarity.text_similarity(pairs, ["conv_id", "turn"], "text", "previous"))


@query(
    f"WITH sensors AS ({standins.SENSORS}), {_rank_sql('sensors', ['k', 'patchy', 'user_id'], 'value', 'event_type')} "
    "SELECT s AS event_type, parameter AS parametre, CAST(n AS VARCHAR) AS n, format('{:.2f}', pr) AS pearson FROM co"
)
def report_correlations(spark, d):
    """Correlation rows as printed, per sensor series."""
    table = losses.correlations(sensors(spark, d), ["k", "patchy", "user_id"], "value", ["event_type"])
    return table.select("event_type", F.substring("parameter", 1, 28).alias("parametre"), F.col("n").cast("string").alias("n"), report.decimals("pearson_r", 2).alias("pearson"))


@query(
    "WITH v AS (SELECT event_type, count(*) FILTER (WHERE value > 200) AS violations FROM events GROUP BY event_type) "
    "SELECT event_type, violations, CASE WHEN violations >= 3 THEN 'danger' WHEN violations > 0 THEN 'warn' ELSE 'ok' END AS badge, "
    "CASE WHEN violations > 0 THEN 'down' ELSE 'up' END AS trend, CASE WHEN violations > 0 THEN violations || ' a traiter' ELSE 'Processus stable' END AS libelle FROM v"
)
def alert_badges(spark, d):
    counted = read_table(spark, f"{d}/events.parquet").groupBy("event_type").agg(F.count_if(F.col("value") > 200).alias("violations"))
    return counted.select("event_type", "violations", spc.alert_badge().alias("badge"), *spc.alert_trend("violations"))
