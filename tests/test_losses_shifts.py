import math
from statistics import NormalDist

import numpy as np
import pytest

from plantlens.functions import stats
from plantlens.operators import losses, shifts
from plantlens.plans import analysis
from helpers import series_frame


def test_t_tail_against_integration():
    def by_integration(r, n):
        dof, t = n - 2, abs(r) * math.sqrt((n - 2) / (1 - r * r))
        x = np.linspace(t, t + 400, 2_000_001)
        density = np.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi) * (1 + x * x / dof) ** (-(dof + 1) / 2)
        return 2 * np.trapezoid(density, x)

    for r, n in ((0.5, 20), (0.1, 50), (-0.9, 12), (0.02, 300)):
        assert stats.correlation_tail(r, n) == pytest.approx(by_integration(r, n), rel=1e-4)
    assert stats.correlation_tail(1.0, 10) == 0.0 and math.isnan(stats.correlation_tail(0.3, 2))


def test_chi2_tail_known_values():
    # textbook 5 % critical values
    for dof, critical in ((1, 3.841458821), (2, 5.991464547), (3, 7.814727903), (7, 14.06714045), (10, 18.30703805)):
        assert stats.chi2_tail(critical, dof) == pytest.approx(0.05, abs=1e-9)


def test_normal_quantiles_are_exact_enough():
    p = np.concatenate([10.0 ** -np.arange(1, 13), np.linspace(0.001, 0.999, 997), [0.02425, 0.97575, 0.5], 1 - 10.0 ** -np.arange(1, 9)])
    exact = np.array([NormalDist().inv_cdf(x) for x in p])
    assert np.abs(stats.normal_quantiles(p) - exact).max() < 1e-8


def test_shapiro_published_example():
    # Shapiro and Wilk's 1965 weights of eleven men
    w, p = stats.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.7888, abs=5e-4) and p == pytest.approx(0.0067, abs=2e-4)
    assert stats.shapiro_wilk(np.random.default_rng(0).normal(size=200))[1] > 0.05
    assert stats.shapiro_wilk(np.random.default_rng(1).exponential(size=300))[1] < 1e-6


def test_retained_test_follows_normality(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(100, 10, 200)
    e = rng.exponential(1, 200)
    df = series_frame(spark, {"x": x, "e": e, "d": 0.5 * x + rng.normal(0, 2, 200)})
    got = {r.parameter: r for r in losses.correlations(df, ["x", "e"], "d").collect()}
    assert got["x"].test_retenu == "pearson" and got["x"].r == got["x"].pearson_r > 0.8
    assert got["e"].test_retenu == "spearman" and got["x"].p_value < 1e-10
    assert got["x"].pearson_r == pytest.approx(np.corrcoef(x, 0.0 + df.toPandas().d)[0, 1])


def test_what_cannot_be_computed_has_a_reason(spark):
    df = series_frame(
        spark, {"flat": [85.0] * 5, "words": list("abcde"), "few": [1.0, None, None, 2.0, None], "d": [0.0, 1.0, 2.0, 1.0, 4.0]}
    )
    got = {r.parameter: r for r in losses.correlations(df, ["flat", "words", "few"], "d").collect()}
    assert all(r.test_retenu == "NON_CALCULABLE" and r.n == 0 and r.r is None for r in got.values())
    assert "constant" in got["flat"].motif and "non convertible" in got["words"].motif
    assert "moins de 3" in got["few"].motif
    same = series_frame(spark, {"p": [1.0, 2.0, 3.0], "d": [1.0, 1.0, 1.0]})
    assert "defauts constants" in losses.correlations(same, ["p"], "d").first().motif


def test_capability_verdicts(spark):
    rng = np.random.default_rng(0)
    df = series_frame(
        spark, {"tight": rng.normal(100, 0.5, 500), "wide": rng.normal(100, 5, 500), "flat": [85.0] * 500, "out": [120.0] * 500,
                "one": [1.0] + [None] * 499, "words": ["x"] * 500}
    )
    specs = losses.specs_frame(
        spark, {"tight": (95, 105), "wide": (95, 105), "flat": (80, 90), "out": (80, 90), "one": (0, 2), "words": (0, 1),
                "nope": (0, 1), "tight2": (2, 1)}
    )
    got = {r.parameter: r for r in losses.cpk(df, specs).collect()}
    assert got["tight"].verdict == "CAPABLE" and got["wide"].verdict == "NON_CAPABLE"
    assert got["flat"].verdict == "CONSTANTE_DANS_SPECS" and got["flat"].cpk == math.inf
    assert got["out"].verdict == "CONSTANTE_HORS_SPECS" and got["out"].cpk == 0.0
    assert got["one"].verdict == "DONNEES_INSUFFISANTES" and got["nope"].verdict == "COLONNE_ABSENTE"
    assert got["words"].verdict.startswith("ERREUR: Colonne 'words'")


def test_ppm_and_its_errors(spark):
    df = series_frame(spark, {"d": [20.0, 30.0], "neg": [-1.0, 0.0]})
    assert losses.ppm(df, "d", 10_000).first().ppm == 5000.0
    assert losses.ppm(df, "d", 0).first().status == "VOLUME_INVALIDE"
    assert losses.ppm(df, "neg", 10).first().status == "DEFAUTS_INVALIDES"


def test_loss_pipeline(spark):
    rng = np.random.default_rng(7)
    df = series_frame(
        spark, {"temperature": rng.normal(180, 3, 300), "pression": rng.normal(4, 1, 300), "vitesse": [85.0] * 300,
                "defaut": rng.poisson(3, 300).astype(float)}
    )
    specs = losses.specs_frame(spark, {"temperature": (170, 190), "vitesse": (80, 90)})
    result = analysis.analyze_losses(df, ["temperature", "pression", "vitesse"], "defaut", 1e6, specs)
    rows = result.correlations.collect()
    assert [r.test_retenu for r in rows].count("NON_CALCULABLE") == 1 and rows[-1].parameter == "vitesse"
    assert result.cpk.count() == 2 and result.ppm.first().ppm > 0


def test_shift_detection(spark):
    df = series_frame(spark, {"temp": [1.0, 2.0, 3.0], "Equipe_jour": ["A", "B", "A"]})
    assert shifts.detect_shift_column(df) == "Equipe_jour"
    df = series_frame(spark, {"m": [1.0, 2.0, 3.0], "groupe": ["A", "B", "A"]})
    assert shifts.detect_shift_column(df) == "groupe"
    assert shifts.detect_shift_column(series_frame(spark, {"a": [1.0, 2.0], "b": [1.0, 2.0]}).drop("seq")) is None


def test_stability_and_kruskal(spark):
    rng = np.random.default_rng(7)
    label = ["A"] * 50 + ["B"] * 50 + ["C"] * 50 + ["D"] * 2
    shifted = np.r_[rng.normal(180, 1, 50), rng.normal(185, 1, 50), rng.normal(180, 1, 50), 999, 999]
    df = series_frame(spark, {"x": shifted, "same": [5.0] * 152, "shift": label})
    got = {r.parameter: r for r in shifts.compare_shifts(df, "shift", ["x", "same"]).collect()}
    assert got["x"].n_shifts == 3 and got["x"].significatif_5pct and got["x"].p_value < 1e-6
    assert got["same"].h_statistic is None and not got["same"].significatif_5pct
    stability = {(r["shift"], r.parameter): r for r in shifts.shift_stability(df, "shift", ["x"]).collect()}
    assert stability[("D", "x")].cv == 0.0 and stability[("A", "x")].n == 50


def test_shift_analysis_without_shift(spark):
    df = series_frame(spark, {"a": [1.0, 2.0], "b": [1.0, 2.0]})
    assert analysis.analyze_shifts(df, ["a"]).reason.startswith("Aucune colonne shift")
    one = series_frame(spark, {"a": [1.0, 2.0], "shift": ["A", "A"]})
    result = analysis.analyze_shifts(one, ["a"], "shift")
    assert not result.detected and "1 modalite" in result.reason
