import numpy as np
import pytest
from pyspark.sql import functions as F

from plantlens.operators import drift, ordered, quality, ranks, spc
from helpers import loop_cusum, loop_ewma, loop_run_rules, series_frame


def shuffled(df):
    return df.orderBy(F.rand(7)).repartition(5)


def test_positions_are_dense_per_series_whatever_the_input_order(spark):
    rows = [("a" if i % 3 else "b", 1000 - i, float(i)) for i in range(500)]
    df = shuffled(spark.createDataFrame(rows, "s string, t int, v double"))
    got = ordered.with_positions(df, ["s"], ["t"], ["v"], 16).toPandas()
    for _, g in got.groupby("s"):
        g = g.sort_values("t").reset_index(drop=True)
        assert list(g.pos) == list(range(len(g)))
        assert (g.n == len(g)).all() and (g.block == g.pos // 16).all()
        assert np.allclose(g.mean_v, g.v.mean()) and np.allclose(g.std_v, g.v.std())


def test_missing_series_name_is_a_series(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "s string, t int")
    got = ordered.with_positions(df, ["s"], ["t"]).collect()
    assert sorted((r.s or "", r.pos, r.n) for r in got) == [("", 0, 2), ("", 1, 2), ("a", 0, 1)]


def test_ties_in_the_order_key_are_broken_by_the_row(spark):
    df = shuffled(spark.createDataFrame([(1, float(i % 7)) for i in range(200)], "t int, v double"))
    got = ordered.with_positions(df, [], ["t"]).orderBy("pos").toPandas()
    assert list(got.v) == sorted(got.v)


@pytest.mark.parametrize("block", [16, 37, 4000])
def test_run_rules_do_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(3)
    series = {
        "walk": np.cumsum(rng.normal(size=700)), "noise": rng.normal(size=700).round(1),
        "saw": np.tile([0.0, 1.0], 350) + np.repeat([0, 3], 350), "calm": np.r_[rng.normal(0, 0.05, 690), 9, -9, 9, -9, 9, -9, 9, -9, 9, -9],
    }
    df = shuffled(series_frame(spark, series))
    got = spc.analyze_all(df, list(series), (), ["seq"], block).toPandas().set_index("parameter")
    for name, values in series.items():
        assert [got.loc[name, r] for r in spc.RULES] == loop_run_rules(values), name


@pytest.mark.parametrize("block", [16, 50, 4000])
def test_drift_charts_equal_the_loops(spark, block):
    rng = np.random.default_rng(5)
    v = np.r_[rng.normal(100, 1, 400), rng.normal(101.2, 1, 900)]
    points = ordered.to_points(shuffled(series_frame(spark, {"v": v})), ["v"], (), ["seq"], "any", block)
    got = drift.cusum_points(points, ["parameter"]).orderBy("pos").toPandas()
    up, down = loop_cusum(v)
    assert np.allclose(got.c_plus, up, atol=1e-9) and np.allclose(got.c_minus, down, atol=1e-9)
    e = drift.ewma_points(points, ["parameter"]).orderBy("pos").toPandas()
    assert np.allclose(e.ewma, loop_ewma(v), rtol=0, atol=1e-10)


@pytest.mark.parametrize("lam", [1.0, 0.9, 0.2, 0.01, 0.0005])
def test_smoothing_of_any_weight(spark, lam, monkeypatch):
    # short blocks force carries over several levels for weak smoothing
    monkeypatch.setattr(drift, "_SMOOTHING_BLOCK", 64)
    v = np.random.default_rng(1).normal(10, 2, 3000)
    points = ordered.to_points(series_frame(spark, {"v": v}), ["v"], (), ["seq"])
    e = drift.ewma_points(points, ["parameter"], lam).orderBy("pos").toPandas()
    assert np.allclose(e.ewma, loop_ewma(v, lam), rtol=0, atol=1e-9)


def test_gaps_across_blocks(spark):
    v = [1.0] * 10 + [None] * 70 + [2.0] + [None] * 3 + [3.0] * 20 + [None] * 30
    df = shuffled(series_frame(spark, {"v": v, "dead": [None] * len(v)}))
    df = df.withColumn("dead", F.lit(None).cast("double"))
    got = {r.column: r.max_gap for r in quality.longest_gaps(df, ["v", "dead"], ["seq"], (), 16).collect()}
    assert got == {"v": 70, "dead": len(v)}


def test_previous_value_along_the_series(spark):
    df = shuffled(series_frame(spark, {"v": np.arange(3000.0)}))
    got = ordered.previous_in_series(df, [], ["seq"], "v", "before").orderBy("seq").toPandas()
    assert np.isnan(got.before[0]) and (got.before[1:].to_numpy() == got.v[:-1].to_numpy()).all()


def test_ranks_and_medians(spark):
    v = [3.0, 1.0, 3.0, 2.0, 3.0, 7.0]
    df = spark.createDataFrame([("k", x) for x in v], "k string, v double")
    counts = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("cnt"))
    got = {r.v: r.rank for r in ranks.average_ranks(counts, ["k"], "v").collect()}
    assert got == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0, 7.0: 6.0}
    assert ranks.exact_medians(df, ["k"], "v").first().median == 3.0
    even = spark.createDataFrame([("k", x) for x in (1.0, 2.0, 4.0, 9.0)], "k string, v double")
    assert ranks.exact_medians(even, ["k"], "v").first().median == 3.0


def test_hot_key_join_is_whole(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("w"))
    joined = ranks.skew_safe_join(rows, table, ["k"], "w", 5000)
    assert joined.count() == 5000 and joined.select("id").distinct().count() == 5000
