"""Operators beside SQL: guards, closed forms and hand-made tables."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dyadflow.errors import DecisionRequired, PipelineError
from dyadflow.functions import distance, keys
from dyadflow.operators import geometry, models, panel, quality, route, space, statistics
from dyadflow.sources import tables


def test_key_guards(spark):
    one = lambda c: spark.range(1).select(c).head()[0]
    assert [one(keys.canonical_state(F.lit(x))) for x in ("7", "007", " 31 ")] == ["07", "07", "31"]
    with pytest.raises(PySparkException, match="not a state"):
        one(keys.canonical_state(F.lit("133")))
    assert one(keys.unit_convert(F.lit(300.0), "K", "F")) == pytest.approx(80.33) and one(keys.from_log1p(F.lit(-3.0))) == 0.0
    with pytest.raises(PipelineError, match="no conversion"):
        keys.unit_convert(F.lit(1.0), "m", "C")
    df = spark.createDataFrame([("00001", 1), ("2", 2), (None, 3)], "code string, n int")
    assert keys.assert_code_valid(df.limit(1), "code").count() == 1
    with pytest.raises(PipelineError, match="1 nulls, 1 not of 5"):
        keys.assert_code_valid(df, "code")
    with pytest.raises(PipelineError, match="not text"):
        keys.assert_code_valid(df, "n")
    with pytest.raises(PipelineError, match="cannot rename"):
        keys.rename_final(df, {"code": "n"})
    with pytest.raises(PySparkException, match="no deflator"):
        one(keys.deflate_ppp(F.lit(1.0), F.lit(None).cast("double"), F.lit(2.0), F.lit(False)))


def test_routing_order_and_guards(spark):
    rows = [(3, "99", "1"), (30, "99", "1"), (30, "5", "998"), (30, "40", "998"), (30, "40", "1"), (30, "", "1"), (30, "00", "1"), (30, "5", "1"), (30, None, "1")]
    named = route.classify_origin(F.col("age"), F.col("s"), F.col("u"), not_specified=(["99"], ["998", "999"]), foreign_from=33, non_migrant=["0"])
    got = [r[0] for r in spark.createDataFrame(rows, "age int, s string, u string").select(named).collect()]
    assert got == ["under_age", "not_specified", "not_specified", "not_specified", "foreign", "non_migrant", "non_migrant", "domestic", "non_migrant"]
    moved = route.rebucket_unparseable(spark.createDataFrame([("domestic", None, "x"), ("foreign", None, "x"), ("domestic", "y", "x")], "bucket string, orig string, dest string"))
    assert [r[0] for r in moved.collect()] == ["unparseable_code", "foreign", "domestic"]
    with pytest.raises(PySparkException, match="unparseable destination"):
        route.rebucket_unparseable(spark.createDataFrame([("domestic", "y", None)], "bucket string, orig string, dest string")).collect()
    with pytest.raises(PySparkException, match="not a number"):
        route.record_weights(spark.createDataFrame([("4",), ("",)], "factor string"), False).collect()
    with pytest.raises(PipelineError, match="up to 2"):
        route.require_full_count(spark.createDataFrame([(3.0, 1)], "migrants double, migrants_unweighted long"))
    with pytest.raises(PipelineError, match="there are 2001, 2002"):
        route.filter_year(spark.createDataFrame([("2001",), ("2002",)], "y string"), "y", 1990)
    with pytest.raises(PipelineError, match="no row"):
        route.total_rows_only(spark.createDataFrame([("0001",)], "part string"), "part")
    flags = route.range_flags(spark.createDataFrame([("a", 5.0), ("b", -1.0), ("c", 99.0), ("d", None)], "code string, x double"), "code", {"x": (0, 10)}).head()
    assert flags["n_outside"] == 2 and flags["codes"] == ["b", "c"]
    with pytest.raises(PipelineError, match="1 points"):
        route.bbox_guard(spark.createDataFrame([(1.0, 1.0), (9.0, 1.0)], "lon double, lat double"), (0, 0, 5, 5))


def test_geodesic_closed_forms(spark):
    rows = [(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 90.0, 0.0), (0.0, 0.0, 0.0, 180.0), (5.0, 5.0, 5.0, 5.0), (None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(distance.geodesic_km("a", "b", "c", "d")).collect()]
    quarter = distance.EQUATOR * (1 - distance.FLATTENING / 2 + distance.FLATTENING**2 / 16) * math.pi / 2
    assert got[0] == pytest.approx(distance.EQUATOR * math.pi / 180, abs=1e-6) and got[1] == pytest.approx(quarter, abs=1e-2)
    assert got[2] == pytest.approx(2 * got[1], abs=1e-3) and got[3] == 0 and got[4] is None


def ring(code, points, part=0, hole=0):
    return [(code, part, hole, i, float(x), float(y)) for i, (x, y) in enumerate(points)]


def test_polygons(spark):
    rows = ring("a", [(0, 0), (10, 0), (10, 10), (0, 10)]) + ring("a", [(4, 4), (6, 4), (6, 6), (4, 6)], hole=1) + ring("b", [(20, 0), (30, 0), (25, 10)])
    polygons = spark.createDataFrame(rows, "code string, part int, ring int, seq int, lon double, lat double")
    assert {r[0]: r[1] for r in geometry.polygon_area(polygons, planar=True).collect()} == {"a": 96.0, "b": 50.0}
    points = spark.createDataFrame([(1, 5.0, 5.2), (2, 1.0, 1.1), (3, 25.0, 3.3), (4, 29.0, 8.2), (5, -1.0, 5.2)], "id int, lon double, lat double")
    assert {tuple(r) for r in geometry.point_in_polygon(points, polygons, ["id"], cell=2.0).collect()} == {(2, "a"), (3, "b")}
    inside = {r["code"]: (r["lon"], r["lat"]) for r in geometry.interior_point(polygons).collect()}
    assert inside["a"] == (2.0, 5.0) and inside["b"] == (25.0, 5.0)
    own = spark.createDataFrame([("a", 5.0, 5.2), ("b", 25.0, 3.3)], "code string, lon double, lat double")
    checked = {r["code"]: (r["inside"], r["lon"]) for r in geometry.containment_check(own, polygons, geometry.interior_point(polygons)).collect()}
    assert checked == {"a": (False, 2.0), "b": (True, 25.0)}
    cells = spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 0.0), (2, 9.0, 9.0), (3, 24.0, 8.0), (4, 40.0, 0.0)], "id int, lon double, lat double")
    assert {tuple(r) for r in geometry.cells_touched(cells, polygons.where("ring = 0"), ["id"], 1.0).collect()} >= {(0, "a"), (1, "a"), (2, "a"), (3, "b")}
    sphere = spark.createDataFrame(ring("s", [(-180, 0), (0, 0), (180, 0), (180, 90), (0, 90), (-180, 90)]), polygons.schema)
    assert geometry.polygon_area(sphere).head()[1] == pytest.approx(2 * math.pi * geometry.AUTHALIC_KM**2)
    with pytest.raises(PipelineError, match="only in the geometry"):
        geometry.vintage_check(polygons, polygons.where("code = 'b'"), spark.createDataFrame([], "child string, parent string"))


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("\ufeffent,mun,name\n01,2,Añil\n".encode())
    (tmp_path / "b.csv").write_bytes("ent,mun,name\n3,4,Añil\n".encode("latin-1"))
    both = tables.read_keyed(spark, str(tmp_path / "*.csv"), ["clave"], [("ent", "mun")])
    assert sorted((r["code"], r["name"]) for r in both.collect()) == [("01002", "Añil"), ("03004", "Añil")]
    with pytest.raises(PipelineError, match="no key among the columns ent, mun, name"):
        tables.read_keyed(spark, str(tmp_path / "*.csv"), ["clave"], [("x", "y")])
    for name, body in (("p_1.csv", "k,v\n1,2\n"), ("p_2.csv", "v,k\n5,3\n"), ("p_X_1.csv", "k,v\n9,9\n"), ("q.csv", "k\n1\n")):
        (tmp_path / name).write_text(body)
    files = [str(tmp_path / f"p_{n}.csv") for n in ("1", "2", "X_1")]
    rows, left = tables.read_sharded(spark, files, ["k", "v"], "_X", False)
    assert sorted(map(tuple, rows.collect())) == [("1", "2"), ("3", "5")] and left == files[2:]
    with pytest.raises(PipelineError, match="lacks v; its header is k"):
        tables.read_sharded(spark, [str(tmp_path / "q.csv")], ["k", "v"], "_X", False)
    with pytest.raises(PipelineError, match="run the flows first"):
        tables.read_table(spark, str(tmp_path / "none"), [], "the flows")
    with pytest.warns(UserWarning, match="left out"):
        assert tables.optional_table(spark, str(tmp_path / "none"), []) is None
    cells = spark.createDataFrame([(1, 5.0), (1, -9.0), (1, 0.0), (2, 7.0)], "band int, value double")
    assert [r["value"] for r in tables.raster_cells(cells, 1, 2.0, 1.0, nodata=0.0).collect()] == [11.0, -17.0, None]
    assert [r["value"] for r in tables.raster_cells(cells, 1, weights=True).collect()] == [5.0, None, 0.0]
    with pytest.raises(PipelineError, match="2 different band"):
        tables.expect_n_inputs(cells, "band")
    panel_ = spark.createDataFrame([("a", 0.0), ("b", 2.0)], "orig string, migrants double")
    assert tables.drop_zero_flows(panel_, True)[0].count() == 1 and tables.drop_zero_flows(panel_, False)[1] == {"zero_flows_dropped": False}
    tables.write_positive_only(panel_, str(tmp_path / "pos"), None)
    assert spark.read.option("header", True).csv(str(tmp_path / "pos")).collect()[0][:] == ("b", "2.0")
    tables.write_splits(panel_.withColumn("split", F.lit("train")), str(tmp_path / "splits"), ["orig"], "migrants")
    assert spark.read.parquet(str(tmp_path / "splits")).where("split = 'train'").agg(F.max("log1p_migrants")).head()[0] == pytest.approx(math.log(3))
    tables.write_report_csv(panel_, str(tmp_path / "report"), ["orig"])
    assert spark.read.csv(str(tmp_path / "report")).count() == 3
    made = []

    def of(year):
        made.append(year)
        return spark.createDataFrame([(year * 10,)], "v int")

    for years in ([2001, 2002], [2001, 2002, 2003]):
        got = tables.checkpointed_by_year(spark, str(tmp_path / "years"), years, of)
    assert made == [2001, 2002, 2003] and sorted(r["v"] for r in got.collect()) == [20010, 20020, 20030]


def test_gates(spark):
    same = spark.range(1, 41).select("id", F.col("id").cast("double").alias("a"), (41 - F.col("id")).cast("double").alias("b"))
    with pytest.raises(DecisionRequired):
        quality.require_agreement(quality.source_agreement(same, "id", "a", "b"), 0.45)
    with pytest.raises(PipelineError, match="not within"):
        quality.require_plausible_total(same, "a", 1, 2)
    with pytest.raises(PipelineError, match="differ"):
        quality.code_set_equality(same.withColumn("code", F.col("id")), same.withColumn("code", F.col("id") + 1))
    with pytest.raises(PipelineError, match="only 0.500"):
        quality.coverage_gate(same, same.where("id <= 20"), "id", "a")
    with pytest.raises(PipelineError, match="not in the codebook: b"):
        quality.codebook(same.select("a", "b"), spark.createDataFrame([("a", "x")], "column string, definition string"))
    with pytest.raises(PipelineError, match="nulls"):
        models.null_gate(spark.createDataFrame([(None,)], "a int"), ["a"])
    with pytest.raises(PipelineError, match="no feature"):
        models.feature_group(["src_pop"], ["temp"])
    assert models.null_sentinel_fill(spark.createDataFrame([(None,)], "a double"), ["a"]).head()[0] == models.FLOAT_MIN
    x = spark.createDataFrame([(float(v),) for v in [5, 1, 4, 1, 3, 2, 9, 9]], "v double")
    assert {round(r[0], 3): r[1] for r in quality.exact_quantiles(x, "v", [0.0, 0.3, 0.5, 1.0]).collect()} == {q: pytest.approx(np.quantile([5, 1, 4, 1, 3, 2, 9, 9], q)) for q in (0.0, 0.3, 0.5, 1.0)}
    panel_ = spark.createDataFrame([("a", "b", "train"), ("a", "c", "inference")], "orig string, dest string, split string")
    units = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "test")], "code string, split string")
    with pytest.raises(PipelineError, match="a unit of one set"):
        models.assert_split(panel_, panel_, units)


def frame(n=60, seed=3):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=n), rng.normal(size=n)
    return x, z, 1.5 + 2 * x - 0.7 * z + rng.normal(size=n) * 0.4


def test_regression_against_numpy(spark):
    x, z, y = frame()
    rows = spark.createDataFrame([(f"{i:03}", float(a), float(b), float(c), float(a + b)) for i, (a, b, c) in enumerate(zip(x, z, y, strict=True))], "code string, x double, z double, y double, both double")
    fit = statistics.ols(rows, "y", ["x", "z"])
    design = np.column_stack([np.ones(len(x)), x, z])
    beta, sse, *_ = np.linalg.lstsq(design, y, rcond=None)
    assert fit.beta == pytest.approx(beta) and fit.sse == pytest.approx(sse[0])
    table = {r["term"]: r for r in statistics.ols_table(fit, spark).collect()}
    se = np.sqrt(sse[0] / (len(x) - 3) * np.diag(np.linalg.inv(design.T @ design)))
    assert [table[t]["se"] for t in ("constant", "x", "z")] == pytest.approx(se)
    assert table["r2"]["value"] == pytest.approx(1 - sse[0] / ((y - y.mean()) ** 2).sum())
    kept, dropped = statistics.vif_eliminate(rows, ["x", "z", "both"])
    assert len(kept) == 2 and dropped[0][1] > 1e6
    e = y - design @ beta
    g = e**2 / (sse[0] / len(x))
    fitted = design @ np.linalg.lstsq(design, g, rcond=None)[0]
    assert statistics.breusch_pagan(rows, fit)["breusch_pagan"] == pytest.approx(((fitted - g.mean()) ** 2).sum() / 2)
    scaled = design / np.sqrt((design**2).sum(axis=0))
    assert statistics.condition_number(fit) == pytest.approx(np.linalg.cond(scaled))
    n = len(x)
    w = np.zeros((n, n))
    for i in range(n):
        w[i, [(i - 1) % n, (i + 1) % n]] = 0.5
    weights = spark.createDataFrame([(f"{i:03}", f"{j:03}", float(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "orig string, dest string, weight double")
    s2, trace = sse[0] / n, np.trace(w.T @ w + w @ w)
    m = np.eye(n) - design @ np.linalg.solve(design.T @ design, design.T)
    wxb = w @ design @ beta
    nj = wxb @ m @ wxb / s2 + trace
    dy, de = e @ w @ y / s2, e @ w @ e / s2
    tests = statistics.lm_spatial_tests(rows, weights, "code", fit)
    assert tests["lm_lag"] == pytest.approx(dy**2 / nj) and tests["lm_error"] == pytest.approx(de**2 / trace)
    assert tests["robust_lag"] == pytest.approx((dy - de) ** 2 / (nj - trace)) and tests["moran_residual"] == pytest.approx(e @ w @ e / (e @ e))
    assert statistics.spatial_durbin_tests(rows, weights, "code", fit)["lm_wx"] >= 0
    moran = statistics.morans_i_permutation(weights, rows, "code", "x", permutations=49).head()
    zx = x - x.mean()
    assert moran["moran"] == pytest.approx(zx @ w @ zx / (zx @ zx)) and 0.02 <= moran["p"] <= 1
    assert statistics.spatial_model(0.01, 0.01, 0.5, 0.01, 0.05) == "SEM" and statistics.spatial_model(0.5, 0.4, 0.01, 0.01, 0.05) == "OLS"


def test_distributions():
    assert statistics.chi2_p(5.991, 2) == pytest.approx(0.05, abs=1e-4) and statistics.t_p(2.228, 10) == pytest.approx(0.05, abs=1e-4) and statistics.f_p(3.493, 2, 20) == pytest.approx(0.05, abs=1e-4)


def test_samples_and_importances(spark):
    units = spark.createDataFrame([(f"{i:02}", float(i + 1)) for i in range(12)], "code string, pop double")
    known = panel.build_spine(units).where("orig < dest").withColumn("y", F.lit(3.0))
    made = models.duplicate_negatives(known, "y", ["orig", "dest"], rate=0.25)
    assert made.count() == 66 + 16 and made.where("y = 0").count() == 16
    unseen = models.unseen_pair_negatives(known, units, 20, ["km"], "y")
    assert unseen.count() == 20 and unseen.where("orig <= dest").count() == 0
    assert [r["idx"] for r in models.node_index(units).orderBy("code").collect()] == list(range(12))
    moved = models.permuted(units, "code", "pop", 5)
    assert sorted(r["pop"] for r in moved.collect()) == [float(i + 1) for i in range(12)] and not moved.exceptAll(units).isEmpty()

    def score(u):
        return panel.attach_both_roles(panel.build_spine(u), u).select((F.col("pop_orig") * 2).alias("p"), (F.col("orig").cast("int") * 2 + 2).cast("double").alias("y"))

    found = models.permutation_importance(score, units, "code", ["pop"]).head()
    assert found["feature"] == "pop" and found["importance"] > 0.05


def test_space(spark):
    cells = spark.createDataFrame([("z", 1.0, 2.0), ("z", 4.0, 6.0), ("u", 5.0, 0.0), ("n", None, 3.0)], "zone string, value double, weight double")
    got = {r["zone"]: (r["mean"], r["method"]) for r in space.zonal_mean(cells, "zone").collect()}
    assert got == {"z": (3.25, "population_weighted"), "u": (5.0, "unweighted_fallback"), "n": (None, "no_valid_cells")}
