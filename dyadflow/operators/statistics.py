"""Regression and spatial diagnostics: moments and cross products are Spark aggregates, small matrices are solved on the driver.

Sums over a weights table (orig, dest, weight) and over units (key, y, features) are single aggregates; what comes to the
driver is a matrix of features by features, whatever the number of units.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dyadflow.errors import PipelineError
from dyadflow.operators.models import numbered
from dyadflow.operators.quality import average_ranks


def normal_p(z: float) -> float:
    """Two-sided p of a standard normal value."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_p(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution, by the series of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, h = df / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16 and n < 10_000:
        n += 1
        term *= h / (a + n)
        total += term
    return max(0.0, 1 - total * math.exp(-h + a * math.log(h) - math.lgamma(a)))


def beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1e-300, 1 + step * d) if 1 + step * d > 0 else 1 / min(-1e-300, 1 + step * d)
        c = 1 + step / c
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_p(t: float, df: int) -> float:
    return beta_tail(df / (df + t * t), df / 2, 0.5)


def f_p(f: float, d1: int, d2: int) -> float:
    return beta_tail(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray]:
    """(rows, cross products) of a constant and these columns over the rows without nulls."""
    names = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    cells = [F.sum(names[i] * names[j]).alias(f"m{i}_{j}") for i in range(len(names)) for j in range(i + 1)]
    found = df.dropna(subset=columns).agg(*cells).head()
    out = np.zeros((len(names), len(names)))
    for i in range(len(names)):
        for j in range(i + 1):
            out[i, j] = out[j, i] = found[f"m{i}_{j}"] or 0.0
    return int(round(out[0, 0])), out


@dataclass
class Ols:
    """An ordinary least squares fit with a constant first."""

    y: str
    features: list[str]
    n: int
    beta: np.ndarray
    xtx: np.ndarray
    sse: float
    sst: float

    def predicted(self):
        return sum((F.col(c) * float(b) for c, b in zip(self.features, self.beta[1:], strict=True)), F.lit(float(self.beta[0])))

    def residuals(self, df: DataFrame, name: str = "e") -> DataFrame:
        return df.dropna(subset=[self.y, *self.features]).withColumn(name, F.col(self.y) - self.predicted())


def ols(df: DataFrame, y: str, features: list[str]) -> Ols:
    """The fit from moments of centred columns, which keeps the matrix well-conditioned."""
    means = df.dropna(subset=[y, *features]).agg(*[F.avg(c).alias(c) for c in [y, *features]]).head()
    if means[y] is None:
        raise PipelineError("no row without nulls")
    centred = df.dropna(subset=[y, *features]).select(*[(F.col(c) - F.lit(float(means[c]))).alias(c) for c in [*features, y]])
    n, m = moments(centred, [*features, y])
    k = len(features)
    slope = np.linalg.solve(m[1 : k + 1, 1 : k + 1], m[1 : k + 1, k + 1])
    at = np.array([means[c] for c in features])
    sst = m[k + 1, k + 1]
    xtx = np.empty((k + 1, k + 1))
    xtx[0, 0], xtx[0, 1:] = n, n * at
    xtx[1:, 0], xtx[1:, 1:] = n * at, m[1 : k + 1, 1 : k + 1] + n * np.outer(at, at)
    return Ols(y, features, n, np.concatenate([[means[y] - slope @ at], slope]), xtx, float(sst - slope @ m[1 : k + 1, k + 1]), float(sst))


def ols_table(fit: Ols, spark) -> DataFrame:
    """(term, value, se, t, p) for the coefficients and for r2, adj_r2, f, aic and bic, which have no se."""
    k, n = len(fit.features) + 1, fit.n
    s2 = fit.sse / (n - k)
    se = np.sqrt(s2 * np.diag(np.linalg.inv(fit.xtx)))
    rows = [(name, float(b), float(e), float(b / e), t_p(float(b / e), n - k)) for name, b, e in zip(["constant", *fit.features], fit.beta, se, strict=True)]
    r2 = 1 - fit.sse / fit.sst
    f = (r2 / (k - 1)) / ((1 - r2) / (n - k))
    likelihood = -n / 2 * (math.log(2 * math.pi * fit.sse / n) + 1)
    rows += [("r2", r2, None, None, None), ("adj_r2", 1 - (1 - r2) * (n - 1) / (n - k), None, None, None), ("f", f, None, None, f_p(f, k - 1, n - k))]
    rows += [("aic", -2 * likelihood + 2 * k, None, None, None), ("bic", -2 * likelihood + k * math.log(n), None, None, None)]
    return spark.createDataFrame([(term, *[None if v is None else float(v) for v in values]) for term, *values in rows], "term string, value double, se double, t double, p double")


def correlations(df: DataFrame, columns: list[str]) -> np.ndarray:
    means = df.dropna(subset=columns).agg(*[F.avg(c).alias(c) for c in columns]).head()
    _, m = moments(df.dropna(subset=columns).select(*[(F.col(c) - F.lit(float(means[c]))).alias(c) for c in columns]), columns)
    m = m[1:, 1:]
    return m / np.sqrt(np.outer(np.diag(m), np.diag(m)))


def vif_eliminate(df: DataFrame, features: list[str], most: float = 10.0) -> tuple[list[str], list[tuple[str, float]]]:
    """(features kept, (feature, its factor) in the order dropped): the largest variance inflation goes while it is above `most`."""
    r, kept, dropped = correlations(df, features), list(range(len(features))), []
    while len(kept) > 1:
        own = r[np.ix_(kept, kept)]
        # the factor is 1 / (1 - R2) of a feature on the others; a feature that these give exactly has an infinite one
        rest = [1 - own[i, j] @ np.linalg.lstsq(own[np.ix_(j, j)], own[j, i], rcond=1e-10)[0] for i in range(len(kept)) for j in [[k for k in range(len(kept)) if k != i]]]
        vif = np.array([1 / x if x > 1e-12 else np.inf for x in rest])
        worst = int(np.argmax(vif))
        if vif[worst] <= most:
            break
        dropped.append((features[kept[worst]], float(vif[worst])))
        kept.pop(worst)
    return [features[i] for i in kept], dropped


def condition_number(fit: Ols) -> float:
    """Of the features with the constant, each scaled to length one."""
    scale = np.sqrt(np.diag(fit.xtx))
    values = np.linalg.eigvalsh(fit.xtx / np.outer(scale, scale))
    return float(np.sqrt(values[-1] / max(values[0], 1e-300)))


def jarque_bera(df: DataFrame, value: str) -> DataFrame:
    """One row (n, skewness, kurtosis, jb); kurtosis is the one in excess of the normal."""
    s, k, n = F.skewness(value), F.kurtosis(value), F.count(value)
    return df.agg(n.alias("n"), s.alias("skewness"), k.alias("kurtosis"), (n / 6.0 * (s * s + k * k / 4)).alias("jb"))


def breusch_pagan(df: DataFrame, fit: Ols) -> dict[str, float]:
    """Breusch-Pagan and its studentised form by Koenker and Bassett, each with its p."""
    rows = fit.residuals(df).withColumn("_g", F.col("e") * F.col("e") / F.lit(fit.sse / fit.n))
    aux = ols(rows, "_g", fit.features)
    bp, kb = (aux.sst - aux.sse) / 2, fit.n * (1 - aux.sse / aux.sst)
    df_ = len(fit.features)
    return {"breusch_pagan": bp, "breusch_pagan_p": chi2_p(bp, df_), "koenker_bassett": kb, "koenker_bassett_p": chi2_p(kb, df_)}


def lagged(units: DataFrame, weights: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """units with w_<column>, the weighted sum over their neighbours, for each column."""
    there = weights.join(units.select(F.col(key).alias("dest"), *columns), "dest")
    sums = there.groupBy(F.col("orig").alias(key)).agg(*[F.sum(F.col("weight") * F.col(c)).alias(f"w_{c}") for c in columns])
    return units.join(sums, key, "left").fillna(0.0, [f"w_{c}" for c in columns])


def weights_trace(weights: DataFrame) -> float:
    """tr(W'W + WW)."""
    back = weights.select(F.col("dest").alias("orig"), F.col("orig").alias("dest"), F.col("weight").alias("_back"))
    found = weights.join(back, ["orig", "dest"], "left").agg(F.sum(F.col("weight") * F.col("weight") + F.coalesce(F.col("weight") * F.col("_back"), F.lit(0.0)))).head()[0]
    return float(found or 0.0)


def lm_spatial_tests(units: DataFrame, weights: DataFrame, key: str, fit: Ols, alpha: float = 0.05) -> dict[str, float | str]:
    """Lagrange multiplier tests for a spatial lag and a spatial error, their robust forms, SARMA, and the model they speak for.

    Moran's I of the residuals comes along. Units with a null leave the table, and so does what the weights say of them.
    """
    rows = fit.residuals(units)
    inside = weights.join(rows.select(F.col(key).alias("orig")), "orig", "left_semi").join(rows.select(F.col(key).alias("dest")), "dest", "left_semi")
    fitted = rows.withColumn("_xb", fit.predicted())
    wide = lagged(fitted, inside, key, ["e", fit.y, "_xb"])
    s = wide.agg(F.sum(F.col("e") * F.col("w_e")).alias("ewe"), F.sum(F.col("e") * F.col(f"w_{fit.y}")).alias("ewy"), F.sum(F.col("w__xb") ** 2).alias("q")).head()
    n, s2, trace = fit.n, fit.sse / fit.n, weights_trace(inside)
    # what of the lagged prediction the features do not explain
    rest = ols(wide, "w__xb", fit.features).sse
    nj = (rest + trace * s2) / s2
    dy, de = s["ewy"] / s2, s["ewe"] / s2
    lag, error = dy**2 / nj, de**2 / trace
    r_lag = (dy - de) ** 2 / (nj - trace)
    r_error = (de - trace / nj * dy) ** 2 / (trace * (1 - trace / nj))
    out: dict[str, float | str] = {"lm_lag": lag, "lm_error": error, "robust_lag": r_lag, "robust_error": r_error}
    out |= {f"{name}_p": chi2_p(float(v), 1) for name, v in list(out.items())}
    s0 = inside.agg(F.sum("weight")).head()[0] or 0.0
    out |= {"sarma": lag + r_error, "sarma_p": chi2_p(lag + r_error, 2), "moran_residual": n / s0 * s["ewe"] / fit.sse if s0 else float("nan")}
    return out | {"model": spatial_model(*(float(out[k]) for k in ("lm_lag_p", "lm_error_p", "robust_lag_p", "robust_error_p")), alpha)}


def spatial_model(lag: float, error: float, robust_lag: float, robust_error: float, alpha: float) -> str:
    """OLS, SLM, SEM or Ambiguous: the simple tests first, the robust ones where both of them speak."""
    if lag >= alpha and error >= alpha:
        return "OLS"
    if (lag < alpha) != (error < alpha):
        return "SLM" if lag < alpha else "SEM"
    if (robust_lag < alpha) != (robust_error < alpha):
        return "SLM" if robust_lag < alpha else "SEM"
    return "Ambiguous"


def spatial_durbin_tests(units: DataFrame, weights: DataFrame, key: str, fit: Ols) -> dict[str, float]:
    """Lagrange multiplier tests for lagged features, jointly with the lag of y, and what the lagged features add to it."""
    rows = lagged(fit.residuals(units).withColumn("_xb", fit.predicted()), weights, key, [*fit.features, fit.y, "_xb"])
    lags = [f"w_{c}" for c in fit.features]
    names = [*fit.features, "w__xb", *lags, "e", f"w_{fit.y}"]
    _, m = moments(rows, names)
    k, n_lags, s2 = len(fit.features) + 1, len(lags), fit.sse / fit.n
    x, z = slice(0, k), slice(k, k + 1 + n_lags)
    # cross products of what the features leave of the lagged prediction and the lagged features
    j = (m[z, z] - m[z, x] @ np.linalg.solve(m[x, x], m[x, z])) / s2
    j[0, 0] += weights_trace(weights)
    e = names.index("e") + 1
    score = np.concatenate([[m[e, names.index(f"w_{fit.y}") + 1]], m[e, k + 1 : k + 1 + n_lags]]) / s2
    lag, wx, joint = score[0] ** 2 / j[0, 0], float(score[1:] @ np.linalg.pinv(j[1:, 1:]) @ score[1:]), float(score @ np.linalg.pinv(j) @ score)
    return {"lm_wx": wx, "lm_wx_p": chi2_p(wx, n_lags), "robust_wx": joint - lag, "robust_wx_p": chi2_p(joint - lag, n_lags), "joint": joint, "joint_p": chi2_p(joint, n_lags + 1)}


def morans_i_permutation(weights: DataFrame, units: DataFrame, key: str, value: str, permutations: int = 999, seed: int = 7) -> DataFrame:
    """One row (moran, z, p): values are dealt to the units anew in each permutation, by a hash of permutation, unit and seed.

    Permutations are rows, so all run at once: units times permutations and edges times permutations rows.
    """
    known = units.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_v"))
    mean = known.agg(F.avg("_v").alias("_m"))
    z = known.join(F.broadcast(mean)).select(key, (F.col("_v") - F.col("_m")).alias("z"))
    place = numbered(z, [key])
    runs = known.sparkSession.range(permutations + 1).withColumnRenamed("id", "run")
    drawn = place.crossJoin(F.broadcast(runs)).withColumn("_h", F.when(F.col("run") == 0, F.col("i")).otherwise(F.xxhash64("run", key, F.lit(seed))))
    # the value of the unit whose hash is the i-th smallest goes to the unit i; a permutation's units are ranked apart from the others'
    ranked = drawn.withColumn("at", F.row_number().over(Window.partitionBy("run").orderBy("_h", "i")) - 1).select("run", F.col("at").alias("i"), "z")
    there = ranked.join(place.select("i", F.col(key).alias("code")), "i").select("run", "code", "z")
    edges = weights.join(known.select(F.col(key).alias("orig")), "orig", "left_semi").join(known.select(F.col(key).alias("dest")), "dest", "left_semi")
    crossed = edges.join(there.withColumnsRenamed({"code": "orig", "z": "a"}), "orig").join(there.withColumnsRenamed({"code": "dest", "z": "b"}), ["run", "dest"])
    scale = z.agg((F.count(F.lit(1)) / F.sum(F.col("z") * F.col("z"))).alias("_scale"))
    cross = crossed.groupBy("run").agg((F.sum(F.col("weight") * F.col("a") * F.col("b")) / F.sum("weight")).alias("_c"))
    each = cross.join(F.broadcast(scale)).select("run", (F.col("_c") * F.col("_scale")).alias("i"))
    seen = F.max(F.when(F.col("run") == 0, F.col("i")))
    found = each.agg(seen.alias("moran"), F.avg(F.when(F.col("run") > 0, F.col("i"))).alias("_m"), F.stddev_pop(F.when(F.col("run") > 0, F.col("i"))).alias("_s"))
    beyond = each.join(F.broadcast(found)).agg(F.count_if((F.col("run") > 0) & (F.abs("i") >= F.abs("moran"))).alias("_n"))
    return found.join(F.broadcast(beyond)).select("moran", ((F.col("moran") - F.col("_m")) / F.col("_s")).alias("z"), ((F.col("_n") + 1) / (permutations + 1)).alias("p"))


def spearman_by_role(units: DataFrame, key: str, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(role, n, spearman) of two columns for each role."""
    out = None
    for role, (a, b) in pairs.items():
        both = units.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        ranks = average_ranks(both, key, a).withColumnRenamed("rank", "_a").join(average_ranks(both, key, b).withColumnRenamed("rank", "_b"), key)
        row = ranks.agg(F.lit(role).alias("role"), F.count(F.lit(1)).alias("n"), F.corr("_a", "_b").alias("spearman"))
        out = row if out is None else out.unionByName(row)
    return out


def gcn_propagate(weights: DataFrame, units: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, columns): features summed over neighbours and the unit itself, each over the root of both ends' degrees."""
    own = units.select(F.col(key).alias("orig"), F.col(key).alias("dest"))
    edges = weights.select("orig", "dest").where("orig <> dest").unionByName(own).distinct()
    degree = edges.groupBy(F.col("dest").alias("_code")).agg(F.count(F.lit(1)).alias("d"))
    given = units.join(degree, F.col(key) == F.col("_code")).select(F.col(key).alias("orig"), *[(F.col(c) / F.sqrt("d")).alias(c) for c in columns])
    sums = edges.join(given, "orig").groupBy(F.col("dest").alias("_code")).agg(*[F.sum(c).alias(c) for c in columns])
    return sums.join(degree, "_code").select(F.col("_code").alias(key), *[(F.col(c) / F.sqrt("d")).alias(c) for c in columns])


def weighted_embedding_mean(vectors: DataFrame, by: list[str], vector: str, weight: str) -> DataFrame:
    """(by, position, mean): weighted means of arrays, element by element; rows without weight do not count."""
    long = vectors.where(F.col(weight) > 0).select(*by, F.col(weight).alias("_w"), F.posexplode(vector).alias("position", "_x"))
    return long.groupBy(*by, "position").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("mean"))
