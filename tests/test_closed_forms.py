"""Spatial statistics against dense matrices on 60 units, and geodesics against published lengths."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadflow.functions.distance import inverse_km
from dyadflow.operators import models, statistics

N, FEATURES = 60, ["x", "z"]


@pytest.fixture(scope="module")
def dense():
    """Units on a ring with neighbours on either side, some farther off, one without any; y depends on its neighbours."""
    rnd = np.random.default_rng(11)
    w = np.zeros((N, N))
    for i in range(N - 1):
        for j in (i - 1, i + 1, *([(i * 7) % N] if i % 3 == 0 else [])):
            if j % N not in (i, N - 1):
                w[i, j % N] = 1.0
        w[i] /= max(1.0, w[i].sum())
    x = rnd.normal(size=(N, 2))
    y = np.linalg.solve(np.eye(N) - 0.4 * w, 1 + x @ [0.7, -0.3] + rnd.normal(size=N) * (0.3 + np.abs(x[:, 0])))
    return w, x, y


@pytest.fixture(scope="module")
def tables(spark, dense):
    w, x, y = dense
    units = spark.createDataFrame([(f"{i:03d}", float(y[i]), *map(float, x[i])) for i in range(N)], "code string, y double, x double, z double")
    weights = spark.createDataFrame([(f"{i:03d}", f"{j:03d}", float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "orig string, dest string, weight double")
    return units, weights, statistics.ols(units, "y", FEATURES)


def parts(dense):
    w, x, y = dense
    full = np.column_stack([np.ones(N), x])
    b = np.linalg.solve(full.T @ full, full.T @ y)
    e = y - full @ b
    m = np.eye(N) - full @ np.linalg.solve(full.T @ full, full.T)
    return w, x, y, full, b, e, e @ e / N, m, np.trace(w.T @ w + w @ w)


def test_lagrange_multipliers(dense, tables):
    units, weights, fit = tables
    w, x, y, full, b, e, s2, m, t = parts(dense)
    wxb = w @ full @ b
    nj = (wxb @ m @ wxb + t * s2) / s2
    dy, de = e @ w @ y / s2, e @ w @ e / s2
    want = {
        "lm_lag": dy**2 / nj, "lm_error": de**2 / t, "robust_lag": (dy - de) ** 2 / (nj - t), "robust_error": (de - t / nj * dy) ** 2 / (t * (1 - t / nj)),
        "sarma": de**2 / t + (dy - de) ** 2 / (nj - t), "moran_residual": N / w.sum() * (e @ w @ e) / (e @ e),
    }
    got = statistics.lm_spatial_tests(units, weights, "code", fit)
    for name, value in want.items():
        assert got[name] == pytest.approx(value, rel=1e-9), name
    # chi-squared tails: one degree by the error function, two by the exponential
    assert got["sarma_p"] == pytest.approx(np.exp(-want["sarma"] / 2), rel=1e-9)


def test_heteroskedasticity(dense, tables):
    units, _, fit = tables
    *_, full, _, e, s2, _, _ = parts(dense)
    g = e**2
    fitted = full @ np.linalg.solve(full.T @ full, full.T @ g)
    explained = ((fitted - g.mean()) ** 2).sum()
    got = statistics.breusch_pagan(units, fit)
    assert got["koenker_bassett"] == pytest.approx(N * explained / ((g - g.mean()) ** 2).sum(), rel=1e-9)
    assert got["breusch_pagan"] == pytest.approx(explained / (2 * s2**2), rel=1e-9)
    assert got["koenker_bassett_p"] == pytest.approx(np.exp(-got["koenker_bassett"] / 2), rel=1e-9)


def test_durbin(dense, tables):
    units, weights, fit = tables
    w, x, y, full, b, e, s2, m, t = parts(dense)
    wx, wxb = w @ x, w @ full @ b
    z = np.column_stack([wxb, wx])
    j = z.T @ m @ z / s2
    j[0, 0] += t
    d = np.concatenate([[e @ w @ y], wx.T @ e]) / s2
    lm_wx, joint, lag = d[1:] @ np.linalg.solve(j[1:, 1:], d[1:]), d @ np.linalg.solve(j, d), d[0] ** 2 / j[0, 0]
    got = statistics.spatial_durbin_tests(units, weights, "code", fit)
    assert got["lm_wx"] == pytest.approx(lm_wx, rel=1e-8) and got["joint"] == pytest.approx(joint, rel=1e-8) and got["robust_wx"] == pytest.approx(joint - lag, rel=1e-7)
    assert got["lm_wx_p"] == pytest.approx(np.exp(-lm_wx / 2), rel=1e-8)


def test_permutations(spark, dense, tables):
    """Mean and spread of the permutations against those under randomisation; the least p where nothing is larger."""
    units, weights, _ = tables
    w, _, y = dense
    v = y - y.mean()
    moran = N / w.sum() * (v @ w @ v) / (v @ v)
    s0, s1, s2 = w.sum(), ((w + w.T) ** 2).sum() / 2, ((w.sum(0) + w.sum(1)) ** 2).sum()
    kurt = (v**4).mean() / (v**2).mean() ** 2
    second = (N * ((N**2 - 3 * N + 3) * s1 - N * s2 + 3 * s0**2) - kurt * ((N**2 - N) * s1 - 2 * N * s2 + 6 * s0**2)) / ((N - 1) * (N - 2) * (N - 3) * s0**2)
    spread = np.sqrt(second - 1 / (N - 1) ** 2)
    got = statistics.morans_i_permutation(weights, units, "code", "y", permutations=999).head()
    assert got["moran"] == pytest.approx(moran, rel=1e-9)
    assert got["z"] == pytest.approx((moran + 1 / (N - 1)) / spread, rel=0.1, abs=0.15)
    assert 1 / 1000 <= got["p"] <= 1
    smooth = spark.createDataFrame([(f"{i:03d}", float(np.sin(2 * np.pi * i / N))) for i in range(N)], "code string, s double")
    assert statistics.morans_i_permutation(weights, smooth, "code", "s", permutations=199).head()["p"] == pytest.approx(1 / 200)


@pytest.mark.parametrize(
    ("lat1", "lon1", "lat2", "lon2", "metres"),
    [(0, 0, 0.5, 179.5, 19936288.579), (0, 0, 0.5, 179.7, 19944127.421), (-30, 0, 29.9, 179.8, 19989832.82761), (29.9, 10, -30, -170.2, 19989832.82761), (0, 0, 0, 180, 20003931.4586), (90, 0, -90, 0, 20003931.4586), (30, 5, -30, -175, 20003931.4586)],
)
def test_nearly_antipodal(lat1, lon1, lat2, lon2, metres):
    """Published lengths, to the millimetre."""
    assert 1000 * inverse_km(*(np.array([float(x)]) for x in (lat1, lon1, lat2, lon2)))[0] == pytest.approx(metres, abs=1e-3)


def test_fit_table_of_a_poisson_model(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=200)
    y = rnd.poisson(np.exp(0.5 + 0.8 * x)).astype(float)
    model = models.ppml_gravity(spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, x, strict=True)], "y double, x double"), "y", ["x"])
    mu = np.exp(model.intercept + model.coefficients[0] * x)
    log = lambda a, b: np.where(a > 0, a * np.log(np.where(a > 0, a, 1) / b), 0)
    got = {r.measure: r.value for r in models.fit_table(model).collect()}
    deviance, null = 2 * (log(y, mu) - (y - mu)).sum(), 2 * log(y, y.mean()).sum()
    likelihood = (y * np.log(mu) - mu - np.array([math.lgamma(v + 1) for v in y])).sum()
    want = {"n": 200, "df_model": 1, "df_residual": 198, "deviance": deviance, "null_deviance": null, "explained_deviance": 1 - deviance / null, "pearson_chi2": ((y - mu) ** 2 / mu).sum(), "aic": -2 * likelihood + 4}
    assert got == pytest.approx(want, rel=1e-6)


def test_importance_of_edge_features(spark):
    """The feature that makes the flow matters, the other does not; a permutation keeps a column's values."""
    rows = [(f"{i:02d}", f"{j:02d}", float((i * 7 + j * 3) % 11 + 1), float(i % 4)) for i in range(12) for j in range(12) if i != j]
    pairs = spark.createDataFrame(rows, "orig string, dest string, km double, other double")
    truth = pairs.select("orig", "dest", F.col("km").alias("y"))
    score = lambda p: p.join(truth, ["orig", "dest"]).select("y", (F.col("km") + 0 * F.col("other")).alias("p"))
    got = {r.feature: r.importance for r in models.edge_permutation_importance(score, pairs, ["km", "other"]).collect()}
    assert got["km"] > 0.1 and got["other"] == pytest.approx(0, abs=1e-12)
    dealt = models.permuted_edges(pairs, "km", 7)
    assert dealt.columns == pairs.columns and sorted(r.km for r in dealt.collect()) == sorted(r[2] for r in rows)
    assert dealt.join(pairs, ["orig", "dest", "km"]).count() < len(rows) / 2
