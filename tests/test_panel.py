import math

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dyadflow.errors import PipelineError
from dyadflow.functions.distance import great_circle_km, internal_distance_km
from dyadflow.functions.keys import compose_code, norm_code
from dyadflow.operators import fold, models, panel, quality, space
from dyadflow.plans import catalog
from dyadflow.sources import tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem", "supplier", "events", "nation", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows, names):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[n] for n in names)) for r in rows), key=repr)


def compared(spark, con, data, name):
    got = catalog.queries()[name](spark, data)
    want = con.sql(catalog.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert plain([r.asDict() for r in got.collect()], names) == plain([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], names)


#: Queries whose gates need more units in both sources than the smallest tables have.
LARGER = {"income_sources_agree"}


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - LARGER))
def test_query_equals_sql(spark, duck, name):
    compared(spark, duck, DATA, name)


@pytest.mark.parametrize("name", sorted(LARGER))
def test_query_equals_sql_on_larger_tables(spark, name):
    with duckdb.connect() as con:
        for t in ("customer", "part", "orders", "lineitem"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
        compared(spark, con, "/root/testdata/sf0.01", name)


def test_codes(spark):
    rows = [("2", "3"), ("02", "003"), ("2.0", "3.0"), (" 9 ", "41"), (None, "1"), ("", "1"), ("x", "1"), ("NaN", "1"), ("2.", "3"), ("2.00", "3")]
    got = spark.createDataFrame(rows, "a string, b string").select(compose_code(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == ["02003"] * 3 + ["09041"] + [None] * 6
    with pytest.raises(PySparkException, match="longer"):
        spark.range(1).select(norm_code(F.lit("123"), 2)).collect()


def test_spine_zeros_and_gates(spark):
    spine = panel.build_spine(spark.createDataFrame([("10",), ("20",), ("30",), ("40",), ("20",), (None,)], "code string"))
    flows = spark.createDataFrame([("10", "20", 7.5, 3), ("20", "10", 4.5, 2), ("30", "20", 1.0, 1)], "orig string, dest string, migrants double, migrants_unweighted long")
    full = panel.classify_zeros(panel.attach_flows(spine, flows), flows)
    assert full.count() == 12 and panel.complete_product(full).head()["complete"]
    assert {(r["orig"], r["dest"]): r["zero_class"] for r in full.where("flow_observed or zero_class = 'sampling_zero_plausible'").collect()} == {("10", "20"): "observed_positive", ("20", "10"): "observed_positive", ("30", "20"): "observed_positive", ("30", "10"): "sampling_zero_plausible"}
    assert full.where("zero_class = 'structural_zero_likely'").count() == 8 and full.where("flow_observed").count() == 3
    assert panel.classify_zeros(panel.attach_flows(spine, flows)).exceptAll(full).isEmpty()
    with pytest.raises(PipelineError, match="duplicate"):
        panel.attach_flows(spine, flows.unionAll(flows))
    lost = panel.orphans(flows, spark.createDataFrame([("10",), ("30",)], "code string")).collect()
    assert sorted((r["side"], r["code"], r["weight"]) for r in lost) == [("dest", "20", 8.5), ("orig", "20", 4.5)]
    audit = panel.join_audit(spark.createDataFrame([("a",), ("b",), ("b",)], "k string"), spark.createDataFrame([("b",), ("c",)], "k string"), ["k"]).head()
    assert audit[:] == (3, 2, 1, 1)


def test_folds(spark):
    xwalk = spark.createDataFrame([("00005", "00004"), ("00009", "00008")], "child string, parent string")
    rows = [("00004", 31), ("00005", 9), ("00008", 6), ("00009", 70), ("00100", 2), (None, 1)]
    people = spark.createDataFrame(rows, "code string, n long")
    once = fold.apply_crosswalk(people, "code", fold.validate_crosswalk(xwalk))
    got = {r["code"]: r["n"] for r in fold.fold_extensive(once, "code", "n").collect()}
    assert got == {"00004": 40, "00008": 76, "00100": 2, None: 1} and sum(got.values()) == sum(n for _, n in rows)
    assert fold.apply_crosswalk(once, "code", xwalk).exceptAll(once).isEmpty() and fold.apply_crosswalk(people, "code", xwalk, "none") is people
    with pytest.raises(NotImplementedError):
        fold.apply_crosswalk(people, "code", xwalk, "allocate")
    for wrong, said in (([("00004", "00003")], "chained"), ([("00005", "00003")], "two parents"), ([("7", "00003")], "of 5")):
        with pytest.raises(PipelineError, match=said):
            fold.validate_crosswalk(xwalk.unionAll(spark.createDataFrame(wrong, xwalk.schema)))
    values = spark.createDataFrame([("a", 10.0, 3.0, 0.5, "s"), ("a", 2.0, 1.0, 0.1, "s"), ("b", 1.0, None, 0.2, "s"), ("b", 4.0, 9.0, 0.2, "s"), ("c", None, None, 0.3, "s")], "code string, x double, w double, se double, source string")
    assert {r["code"]: r["x"] for r in fold.fold_intensive(values, "code", "x", "w").collect()} == {"a": 8.0, "b": 2.5, "c": None}
    assert {r["code"]: (r["se"], r["source"]) for r in fold.fold_income(values, "code", "x", "w", ["se"], "source").collect()} == {"a": (None, "s_harmonized"), "b": (None, "s_harmonized"), "c": (0.3, "s")}
    with pytest.raises(PySparkException, match="unknown"):
        fold.pivot_estimates(spark.createDataFrame([("a", 9, 1.0)], "k string, e int, v double"), "k", "e", "v", {1: "value"}).collect()
    bands = {"x0": (0, 4), "x5": (5, 9), "x10": (10, 14)}
    assert fold.tiling_bands(bands, 5, 14) == ["x5", "x10"] and fold.tiling_bands(bands, 3, 9) is None and fold.tiling_bands(bands, 0, 12) is None
    wide = spark.createDataFrame([("a", "1", None, "3", 3)], "k string, x0 string, x5 string, x10 string, known int")
    assert fold.banded_share(wide, "k", bands, (10, 14), (5, 14), "known").head()[:] == ("a", 3.0, 3.0, 1.0)
    with pytest.raises(PipelineError, match="published"):
        fold.banded_share(wide.withColumn("known", F.lit(9)), "k", bands, (10, 14), (5, 14), "known")


def test_distance(spark):
    d = lambda *x: great_circle_km(*map(F.lit, x))
    got = spark.range(1).select(d(0.0, 0.0, 0.0, 1.0), d(0.0, 0.0, 0.0, 180.0), internal_distance_km(F.lit(math.pi * 100))).head()
    assert got[0] == pytest.approx(math.pi * 6371.0088 / 180) and got[1] == pytest.approx(math.pi * 6371.0088) and got[2] == pytest.approx(6.7)
    with pytest.raises(PySparkException, match="negative"):
        spark.range(1).select(internal_distance_km(F.lit(-1.0))).collect()


def test_quality(spark):
    df = spark.createDataFrame([(1, "x", 1), (2, None, 2), (None, None, 3)], "a int, b string, c int")
    assert {r["column"]: (r["n_missing"], round(r["pct"], 4)) for r in quality.missingness(df).collect()} == {"a": (1, 33.3333), "b": (2, 66.6667), "c": (0, 0.0)}
    same = spark.range(1, 41).select("id", F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"))
    assert quality.source_agreement(same, "id", "a", "b").select(F.round("spearman", 9), "median_ratio").head()[:] == (1.0, 0.5)
    with pytest.raises(PySparkException, match="fewer"):
        quality.source_agreement(same.limit(5), "id", "a", "b").collect()
    assert quality.require_total(same, "a", None, 0.1) == "not run" and quality.require_total(same, "a", 820.0, 0.0) == "passed"


def test_neighbours_and_moran(spark):
    units = spark.createDataFrame([(f"{i}", float(i), float(i >= 3)) for i in range(6)], "code string, x double, v double")
    pairs = panel.attach_both_roles(panel.build_spine(units), units).select("orig", "dest", F.abs(F.col("x_orig") - F.col("x_dest")).alias("d"))
    near = space.knn_weights(pairs, 2, "d")
    assert {r["dest"] for r in near.where("orig = '0'").collect()} == {"1", "2"} and near.count() == 12
    assert space.morans_i(near, units, "code", "v").head()["moran"] > 0.3
    filled = space.idw_fill(units.withColumn("v", F.when(F.col("code") != "2", F.col("v"))), pairs, "code", "v", "d", k=2)
    assert {r["code"]: r["v"] for r in filled.collect()}["2"] == pytest.approx(0.5)


def test_gravity_with_one_binary_covariate(spark):
    rows = spark.createDataFrame([(2.0, 0.0), (4.0, 0.0), (10.0, 1.0), (20.0, 1.0)], "y double, x double")
    model = models.ppml_gravity(rows, "y", ["x"])
    assert model.intercept == pytest.approx(math.log(3), abs=1e-6) and model.coefficients[0] == pytest.approx(math.log(5), abs=1e-6)


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿code ,n\n01,2\n".encode())
    df = tables.read_csv_strings(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["code", "n"] and df.head()[:] == ("01", "2")
    tables.write_table(df, str(tmp_path / "t"), ["code"])
    assert tables.read_projected(spark, str(tmp_path / "t"), ["code"]).head()[0] == "01"
    with pytest.raises(PipelineError, match="positive"):
        tables.write_positive_only(spark.createDataFrame([(0.0,)], "migrants double"), str(tmp_path / "p"))


def test_flows_are_joined_once(spark):
    """Readers of the flows read a written table, not the join of orders and line items."""
    from dyadflow.plans import catalog

    plan = catalog.flows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
