import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plantlens.operators import drift, spc
from helpers import series_frame


def chart(spark, values):
    return spc.analyze_all(series_frame(spark, {"x": values}), ["x"], (), ["seq"]).first()


def test_single_outlier(spark):
    r = chart(spark, np.r_[np.random.default_rng(0).normal(100, 1, 100), 200.0])
    assert r.n == 101 and r.violations >= 1 and r.criticality > 0


def test_constant_short_and_empty_series(spark):
    r = chart(spark, [42.0] * 50)
    assert r.nelson_total == 0 and r["std"] == 0 and r.dominant_pattern == "none"
    assert chart(spark, [1.0, 2.0, 3.0]).nelson_total == 0
    empty = series_frame(spark, {"x": [1.0]}).where("x > 5")
    r = spc.analyze_all(empty, ["x"], (), ["seq"]).first()
    assert (r.n, r["mean"], r.violations, r.dominant_pattern) == (0, 0.0, 0, "none")


def test_trend_dominates_a_ramp(spark):
    r = chart(spark, [float(i) for i in range(10)])
    assert r.nelson_3 == 1 and r.dominant_pattern == "trend"


def test_alternation_needs_fifteen_points(spark):
    assert chart(spark, [0.0, 1.0] * 7).nelson_4 == 0
    assert chart(spark, [0.0, 1.0] * 7 + [0.0]).nelson_4 == 1


def test_column_order_and_sorting(spark):
    rng = np.random.default_rng(2)
    df = series_frame(spark, {"calm": rng.normal(size=100), "wild": np.r_[rng.normal(size=97), 50, -50, 60]})
    table = spc.analyze_all(df, ["calm", "wild"], (), ["seq"])
    assert table.columns == [
        "parameter", "n", "mean", "std", "lcl", "ucl", "violations", "criticality", *spc.RULES, "nelson_total", "dominant_pattern",
    ]
    assert table.first().parameter == "wild"
    alerts = spc.alerts(table).collect()
    assert alerts[0].severity == "danger" and "violation(s) hors limite" in alerts[0].message


def test_order_free_limits_match_the_full_analysis(spark):
    df = series_frame(spark, {"x": np.random.default_rng(4).normal(size=300), "y": np.arange(300.0)})
    full = {r.parameter: r for r in spc.analyze_all(df, ["x", "y"], (), ["seq"]).collect()}
    for r in spc.shewhart(df, ["x", "y"]).collect():
        assert abs(r.ucl - full[r.parameter].ucl) < 1e-9 and r.violations == full[r.parameter].violations


def test_ewma_finds_a_small_shift(spark):
    rng = np.random.default_rng(42)
    df = series_frame(spark, {"x": np.r_[rng.normal(100, 1, 100), rng.normal(101, 1, 100)]})
    r = drift.detect_drift(df, ["x"], (), ["seq"]).first()
    assert r.ewma_violations > 0 and r.drift_detected and r.reason == ""


def test_cusum_jump_and_stable(spark):
    rng = np.random.default_rng(1)
    jump = np.r_[rng.normal(100, 1, 100), rng.normal(103, 1, 100)]
    stable = np.random.default_rng(2).normal(100, 1, 200)
    df = series_frame(spark, {"jump": jump, "stable": stable})
    got = {r.parameter: r for r in drift.detect_drift(df, ["jump", "stable"], (), ["seq"]).collect()}
    assert got["jump"].cusum_signal_up > 0 and got["jump"].cusum_first_idx is not None
    assert got["stable"].cusum_signal_up == 0 and got["stable"].cusum_first_idx is None


def test_short_constant_and_missing_columns_have_reasons(spark):
    df = series_frame(spark, {"short": [1.0, 2.0, 3.0] + [None] * 20, "flat": [5.0] * 23, "dead": [None] * 23})
    df = df.withColumn("dead", F.lit(None).cast("double"))
    got = {r.parameter: r for r in drift.detect_drift(df, ["short", "flat", "dead"], (), ["seq"]).collect()}
    assert got["short"].reason == "EWMA: n=3 < 10 | CUSUM: n=3 < 10"
    assert "constante" in got["flat"].reason and not got["flat"].drift_detected
    assert got["dead"].reason.startswith("EWMA: n=0 < 10") and got["dead"].ewma_first_idx is None


def test_pareto_and_variation(spark):
    scores = spark.createDataFrame([(f"p{i}", float(12 - i)) for i in range(12)], "parameter string, score double")
    rows = spc.pareto(scores, top_n=4).collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4] and abs(rows[-1].cumulative_pct - 100) < 1e-9
    assert rows[-1].cumulative_pct_of_all < 100 and rows[0].tier == "danger" and rows[3].tier == "warn"
    df = series_frame(spark, {"a": [1.0, 3.0], "b": [10.0, 11.0], "zero": [-1.0, 1.0]})
    assert [r.parameter for r in spc.variation_ranking(df, ["a", "b", "zero"]).collect()] == ["a", "b"]


def test_correlation_matrix_of_constant_column(spark):
    df = series_frame(spark, {"a": [1.0, 2.0, 3.0], "b": [2.0, 4.0, 6.0], "c": [5.0, 5.0, 5.0]})
    got = {(r.x, r.y): r.r for r in spc.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == got[("b", "a")] == 1.0 and got[("a", "c")] is None and len(got) == 9


def test_labels(spark):
    df = spark.createDataFrame([("trend", 0), ("autre", 2), ("none", 5)], "dominant_pattern string, violations int")
    got = df.select(spc.pattern_label().alias("l"), spc.alert_badge().alias("b")).collect()
    assert [tuple(r) for r in got] == [("Tendance (derive)", "ok"), ("autre", "warn"), ("Aucun", "danger")]


def test_correlation_matrix_of_many_columns_is_pairwise_complete(spark):
    rng = np.random.default_rng(3)
    wide = pd.DataFrame(rng.normal(size=(400, 40)).cumsum(axis=1) + 1e6, columns=[f"p {i}" for i in range(40)])
    wide = wide.mask(rng.random(wide.shape) < 0.3)
    wide["empty"], wide["still"] = np.nan, 0.1
    expected = wide.corr()
    got = spc.correlation_matrix(spark.createDataFrame(wide).repartition(5), digits=6).toPandas()
    assert len(got) == wide.shape[1] ** 2
    table = got.pivot(index="x", columns="y", values="r").loc[wide.columns, wide.columns].astype(float)
    assert np.allclose(table, expected, atol=2e-6, equal_nan=True)


def test_correlation_matrix_of_infinite_values_and_of_no_rows(spark):
    rows = [(1.0, 2.0, 1.0), (2.0, 1.0, None), (3.0, 5.0, 2.0), (float("inf"), 4.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r.x, r.y): r.r for r in spc.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert np.isnan(got["a", "b"]) and got["a", "c"] == got["c", "a"] == 1.0 and got["b", "c"] == 1.0
    none = {(r.x, r.y): r.r for r in spc.correlation_matrix(df.limit(0), ["a", "b"]).collect()}
    assert none == {("a", "a"): None, ("a", "b"): None, ("b", "a"): None, ("b", "b"): None}
