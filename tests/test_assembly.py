"""The assembled panel and its gates, the climate source, covers of polygons, rings of neighbours, negatives by rank, order statistics, small semantics."""

import math
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadflow.errors import PipelineError
from dyadflow.functions.keys import canonical_state
from dyadflow.operators import assemble as a
from dyadflow.operators import fold, geometry, models, neighbours, panel, space
from dyadflow.operators.order import order_statistics, quantiles_by
from dyadflow.sources import tables

CODES = ["00001", "00002", "00003", "00004"]
NAMES = {"orig": "src_code", "dest": "dst_code", "pop_orig": "src_pop", "pop_dest": "dst_pop"}
SPEC = [(c, c, "", "", "", "") for c in ("src_code", "dst_code", "src_pop", "dst_pop", "migrants", "migrants_unweighted", "flow_observed", "zero_class", "km")]


def inputs(spark, flows=None, pop=None):
    flows = [("00001", "00002", 5.0, 2), ("00003", "00001", 1.0, 1)] if flows is None else flows
    pop = [(c, 10 * i) for i, c in enumerate(CODES[:3])] + [("09999", 7)] if pop is None else pop
    return (
        spark.createDataFrame(flows, "orig string, dest string, migrants double, migrants_unweighted long"),
        spark.createDataFrame([(c,) for c in CODES], "code string"),
        [a.UnitTable("population", spark.createDataFrame(pop, "code string, pop long"), {"pop": "pop_orig"}, {"pop": "pop_dest"}, required=True)],
        spark.createDataFrame([(x, y, 1.5) for x in CODES for y in CODES if x < y], "orig string, dest string, km double"),
    )


def build(spark, tmp_path, flows=None, pop=None, **more):
    f, u, t, p = inputs(spark, flows, pop)
    return a.assemble(f, more.pop("universe", u), more.pop("tables", t), str(tmp_path / "panel"), more.pop("spec", SPEC), NAMES, more.pop("pairs", p), ["km"], **more)


def test_panel_and_what_was_counted(spark, tmp_path):
    made = build(spark, tmp_path, positive_csv=str(tmp_path / "positive"))
    rows = {(r.src_code, r.dst_code): r for r in spark.read.parquet(str(tmp_path / "panel")).collect()}
    assert len(rows) == 12 and made.path == str(tmp_path / "panel")
    assert rows["00001", "00002"].asDict() == {"src_code": "00001", "dst_code": "00002", "migrants": 5.0, "migrants_unweighted": 2, "flow_observed": True, "zero_class": "observed_positive", "km": 1.5, "src_pop": 0, "dst_pop": 10}
    # 3 sends and 2 takes; 4 does neither, and has no population
    assert rows["00003", "00002"].zero_class == "sampling_zero_plausible" and rows["00004", "00001"].zero_class == "structural_zero_likely"
    assert rows["00004", "00001"].src_pop is None and rows["00002", "00001"].km is None
    units = made.metrics["units"]
    assert (units["n_units"], units["population_matched"], units["population_unmatched"], units["population_unused"]) == (4, 3, 1, 1)
    assert made.metrics["panel"]["n_positive"] == 2 and made.metrics["panel"]["total"] == 6.0
    book = {r.column: (r.type, r.n_missing) for r in made.codebook.collect()}
    assert book["src_pop"] == ("bigint", 3) and book["km"] == ("double", 6)
    assert spark.read.option("header", True).csv(str(tmp_path / "positive")).count() == 2
    assert made.report().where("step = 'flows' AND metric = 'n_pairs'").head()["value"] == 2


@pytest.mark.parametrize(
    ("flows", "pop", "says"),
    [
        ([("00001", "09999", 5.0, 2)], None, "outside the universe, 5.0 migrants"),
        ([("00001", "00002", 5.0, 2), ("00001", "00002", 1.0, 1)], None, "more than once"),
        ([("00001", "00002", -5.0, 2)], None, "negative"),
        ([("1", "00002", 5.0, 2)], None, "not 5 characters"),
        (None, [("00001", 1), ("00001", 2)], "more than once: population"),
    ],
)
def test_gates_stop_before_anything_is_written(spark, tmp_path, flows, pop, says):
    with pytest.raises(PipelineError, match=says):
        build(spark, tmp_path, flows, pop)
    assert not (tmp_path / "panel").exists()


def test_other_gates(spark, tmp_path):
    with pytest.raises(PipelineError, match="not in the codebook: km"):
        build(spark, tmp_path, spec=SPEC[:-1])
    with pytest.raises(PipelineError, match="differs from the published"):
        build(spark, tmp_path, gates=a.Gates(published_total=10.0, tolerance=0.1))
    twice = spark.createDataFrame([("00001", "00002", 1.0)] * 2, "orig string, dest string, km double")
    with pytest.raises(PipelineError, match="pair values: 1 pairs"):
        build(spark, tmp_path, pairs=twice)
    with pytest.raises(PipelineError, match="population is not there"):
        build(spark, tmp_path, tables=[a.UnitTable("population", None, {}, {}, required=True)])
    assert not (tmp_path / "panel").exists()


def test_choices(spark, tmp_path):
    """Orphans let through, an optional table that is not there, no universe, zeros dropped."""
    f, u, t, p = inputs(spark, [("00001", "00002", 5.0, 2), ("00001", "09998", 3.0, 1)], [(c, 1) for c in CODES])
    with pytest.warns(UserWarning, match="gdp is not there|no universe given"):
        made = a.assemble(f, None, [*t, a.UnitTable("gdp", None, {"x": "x_orig"}, {})], str(tmp_path / "panel"), SPEC, NAMES, p, ["km"], a.Gates(fail_on_orphans=False, published_total=5.0, tolerance=0.01), drop_zeros=True)
    assert [(r.src_code, r.dst_code) for r in made.panel.collect()] == [("00001", "00002")]
    assert made.metrics["flows"]["n_orphans"] == 1 and made.metrics["panel"]["n_rows"] == 12
    assert "zeros were dropped" in {r.column: r.limitation for r in made.codebook.collect()}["migrants"]


def test_climate_provider(spark):
    daily = spark.createDataFrame([("00001", 50.0, 0.5)], "code string, temp double, precip double")
    normal = spark.createDataFrame([("00001", 20.0, 900.0, "n", "1970-2000")], "code string, temp_mean_c double, precip_total_mm double, climate_source string, climate_period string")
    got, window = a.climate_provider("era5_gee", {"climate_gee": daily}, (2016, 2020))
    assert window and [round(x, 9) if isinstance(x, float) else x for x in got.head()] == ["00001", 10.0, 500.0, "era5_land_gee", "2016-2020"]
    got, window = a.climate_provider("zonal", {"climate": normal}, (2016, 2020))
    assert window is False and tuple(got.head()) == ("00001", 20.0, 900.0, "n", "1970-2000")
    with pytest.warns(UserWarning, match="no climate"):
        assert a.climate_provider("worldclim", {"climate_gee": daily}, (2016, 2020)) == (None, None)
    with pytest.raises(PipelineError, match="unknown climate source"):
        a.climate_provider("other", {}, (1, 2))


def in_ring(x, y, ring):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
    return inside


def test_points_by_cell_cover(spark):
    """Stars and a ring with a hole on a layer 50 wide, cells larger and smaller than the polygons; most points need no edge."""
    rnd = random.Random(2)
    shapes = {}
    for i in range(12):
        cx, cy, n = rnd.uniform(5, 45), rnd.uniform(-40, 5), rnd.randrange(3, 30)
        shapes[f"p{i}"] = [[(cx + r * math.cos(6.28318 * k / n), cy + r * math.sin(6.28318 * k / n)) for k in range(n) for r in [rnd.uniform(1, 9)]]]
    shapes["hole"] = [[(10.0, -30.0), (40.0, -30.0), (40.0, 0.0), (10.0, 0.0)], [(20.0, -20.0), (30.0, -20.0), (30.0, -10.0), (20.0, -10.0)]]
    rows = [(code, 0, ring, seq, x, y) for code, rings in shapes.items() for ring, pts in enumerate(rings) for seq, (x, y) in enumerate(pts)]
    polygons = spark.createDataFrame(rows, "code string, part int, ring int, seq int, lon double, lat double")
    pts = [(i, rnd.uniform(-5, 55), rnd.uniform(-50, 15)) for i in range(3000)]
    points = spark.createDataFrame(pts, "id long, lon double, lat double")
    want = {(i, code) for i, x, y in pts for code, rings in shapes.items() if sum(in_ring(x, y, ring) for ring in rings) % 2}
    for size in (0.5, 3.0, 100.0):
        assert {tuple(r) for r in geometry.point_in_polygon(points, polygons, ["id"], cell=size).collect()} == want
    own = points.withColumn("mine", F.lit("hole"))
    assert {tuple(r) for r in geometry.point_in_polygon(own, polygons, ["id"], cell=2.0, own="mine").collect()} == {w for w in want if w[1] == "hole"}
    cover = geometry.cell_cover(polygons.where("code = 'hole'"), 1.0)
    inside, edge = (cover.where(c).count() for c in ("not edge", "edge"))
    # the area is 800; the bounds, 160 long, lie on lines of the grid, so the cells of both their sides are tested
    assert inside == 800 - 160 and edge <= 2 * 160 + 16


def test_nearest_by_rings(spark):
    rnd = np.random.default_rng(4)
    xy = np.concatenate([rnd.uniform(-100, 100, (700, 2)) * [1, 0.8], rnd.normal(0, 0.01, (500, 2)), np.tile([[179.9, 10.0]], (6, 1)), [[-179.9, 10.0], [0.0, 89.9], [180.0, -89.0]]])
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    points = spark.createDataFrame(rows, "code long, lon double, lat double")
    lon, lat = np.radians(xy[:, 0]), np.radians(xy[:, 1])
    a_ = np.sin((lat[:, None] - lat) / 2) ** 2 + np.cos(lat[:, None]) * np.cos(lat) * np.sin((lon[:, None] - lon) / 2) ** 2
    for metric, d in ((neighbours.Degrees(), np.hypot(xy[:, None, 0] - xy[:, 0], xy[:, None, 1] - xy[:, 1])), (neighbours.GreatCircle(), 2 * 6371.0088 * np.arcsin(np.sqrt(np.clip(a_, 0, 1))))):
        np.fill_diagonal(d, np.inf)
        got = {}
        for r in neighbours.nearest(points, points, 4, metric).collect():
            got.setdefault(r.orig, {})[r["rank"]] = (r.dest, r.distance)
        assert len(got) == len(rows)
        for i, found in got.items():
            assert sorted(found) == [1, 2, 3, 4] and len({x for x, _ in found.values()}) == 4
            assert np.allclose([found[k][1] for k in (1, 2, 3, 4)], np.sort(d[i])[:4], rtol=1e-9, atol=1e-6)
    # ties by code: of six equal points each has the first four of the others
    same = {r.orig: r.dest for r in neighbours.nearest(points, points, 4, neighbours.Degrees()).where("orig >= 1200 AND orig < 1206 AND rank = 1").collect()}
    assert same == {1200: 1201} | {i: 1200 for i in range(1201, 1206)}
    few = points.where("code < 3")
    assert neighbours.nearest(few, few, 4, neighbours.Degrees()).count() == 6
    assert neighbours.nearest(points, points.limit(0), 4, neighbours.Degrees()).count() == 0
    assert neighbours.knn_graph(few, 4).agg(F.sum("weight")).head()[0] == pytest.approx(3.0)


def test_negatives_by_rank(spark):
    units = spark.createDataFrame([(c,) for c in "abcdefg"], "code string")
    known = [(x, y) for x in "abcdefg" for y in "abcdefg" if (ord(x) * 7 + ord(y)) % 3 or x == "c"]
    absent = {(x, y) for x in "abcdefg" for y in "abcdefg" if x != y} - set(known)
    table = spark.createDataFrame([*known, ("a", "zz"), ("zz", "a")], "orig string, dest string")
    for n in (1, 5, len(absent)):
        got = [(r.orig, r.dest) for r in models.unseen_pair_negatives(table, units, n, ["km"], "y").collect()]
        assert len(got) == len(set(got)) == n and set(got) <= absent
    with pytest.raises(PipelineError, match=f"{len(absent)} are absent"):
        models.unseen_pair_negatives(table, units, len(absent) + 1, [], "y")


def test_crowded_places_ask_once(spark, monkeypatch):
    """Many points at few places: the lists are those of all pairs, and no round meets more than the first k + 1 of a place."""
    k, met = 3, []
    rnd = np.random.default_rng(3)
    spots = rnd.integers(0, 8, (12, 2)) * 1.5 - 4
    xy = spots[np.arange(600) % 12]
    points = spark.createDataFrame([(int(i), float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(None, 0.0, 0.0)], "code long, lon double, lat double")
    apart = np.hypot(xy[:, None, 0] - xy[:, 0], xy[:, None, 1] - xy[:, 1])
    monkeypatch.setattr(neighbours, "written", lambda df: met.append((w := df.checkpoint()).count()) or w)
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    for targets, own in ((points, range(600)), (points.where("code >= 300"), range(300, 600))):
        got = {}
        for r in neighbours.nearest(points, targets, k, neighbours.Degrees()).collect():
            got.setdefault(r.orig, []).append((r.distance, r.dest, r.rank))
        assert got.keys() == set(range(600))
        for i in range(600):
            want = sorted((apart[i, j], j) for j in own if j != i)[:k]
            assert [(d, r) for _, d, r in sorted(got[i], key=lambda x: x[2])] == [(j, n + 1) for n, (_, j) in enumerate(want)]
    assert max(met) <= (k + 1) * 12


@pytest.mark.parametrize("left", [3, 0])
def test_few_absent_pairs_are_all_given(spark, left):
    units = spark.createDataFrame([(c,) for c in "abcdefg"], "code string")
    every = [(x, y) for x in "abcdefg" for y in "abcdefg" if x != y]
    known = spark.createDataFrame(every[left:], "orig string, dest string")
    got = models.unseen_pair_negatives(known, units, 20, ["km"], "y", at_most=True)
    assert sorted((r.orig, r.dest, r.y, r.km) for r in got.collect()) == [(*p, 0.0, 0.0) for p in every[:left]]


@pytest.mark.parametrize("few", [10_000, 20])
def test_order_statistics(spark, few):
    rnd = np.random.default_rng(5)
    x = np.concatenate([rnd.normal(0, 1, 2000), 10.0 ** rnd.integers(-200, 200, 500), np.full(1000, 3.0), [0.0, -0.0, -1e300, 1e300]]).round(6)
    rows = [(int(i % 3), float(v)) for i, v in enumerate(x)] + [(1, None), (4, None)]
    df = spark.createDataFrame(rows, "g long, x double")
    wanted = [(g, r) for g in range(5) for r in (0, 3, 500, 900, 1150, 10**6)]
    found = order_statistics(df, "x", spark.createDataFrame(wanted, "g long, rank long"), ["g"], cells=16 if few == 20 else 256, few=few)
    values = {g: sorted(v for h, v in rows if h == g and v is not None) for g in range(5)}
    assert {(r.g, r["rank"]): r.x for r in found.collect()} == {(g, r): values[g][r] for g, r in wanted if r < len(values[g])}
    got = {(r.g, r.share): r.quantile for r in quantiles_by(df.where("abs(x) < 1e6"), "x", [0.0, 0.37, 1.0], ["g"]).collect()}
    for (g, share), q in got.items():
        assert q == pytest.approx(np.quantile([v for v in values[g] if abs(v) < 1e6], share))
    assert len(got) == 9
    assert quantiles_by(df.where("g = 4"), "x", [0.5]).count() == 0


def test_small_semantics(spark):
    states = spark.createDataFrame([(x,) for x in ("007", "7.0", " 32 ", "000", "x", "", None)], "s string")
    assert [r[0] for r in states.select(canonical_state(F.col("s"))).collect()] == ["07", "07", "32", "00", None, None, None]
    for wrong in ("-7", "100", "7.5"):
        with pytest.raises(Exception, match="not a state"):
            spark.createDataFrame([(wrong,)], "s string").select(canonical_state(F.col("s"))).collect()
    months = spark.createDataFrame([("a", 1, 1.0)] * 12 + [("b", m, 1.0) for m in range(1, 13)] + [("c", m, None if m == 5 else 1.0) for m in range(1, 13)], "k string, m int, v double")
    assert {r.k: r.complete for r in fold.annual_from_months(months, "k", "m", "v").collect()} == {"a": False, "b": True, "c": False}
    long = lambda *rows: spark.createDataFrame(rows, "k string, e int, v double")
    names = {1: "value", 2: "se"}
    assert fold.pivot_estimates(long(("a", 1, 5.0), ("a", 2, None)), "k", "e", "v", names, "value").count() == 1
    for rows in ([("a", 2, 1.0)], [("a", 1, 0.0)], [("a", 1, None)], [("a", None, 1.0), ("a", 1, 1.0)]):
        with pytest.raises(Exception, match="value|estimate code"):
            fold.pivot_estimates(long(*rows), "k", "e", "v", names, "value").collect()
    with pytest.raises(Exception, match="outside 0..1"):
        fold.band_share(spark.createDataFrame([("a", 20, 5.0), ("a", 50, -3.0)], "k string, age int, n double"), "k", "age", "n", 15, 29).collect()
    weights = spark.createDataFrame([("a", "b", 1.0)], "orig string, dest string, weight double")
    assert {tuple(r) for r in space.spatial_lag(weights, spark.createDataFrame([("a", 2.0), ("b", 3.0)], "code string, x double"), "code", "x").collect()} == {("a", 3.0), ("b", 0.0)}
    cells = spark.createDataFrame([("z", 1.0, 2.0), ("z", 4.0, 1.0), ("z", 9.0, 0.0), ("w", 5.0, 0.0), ("v", None, 1.0)], "zone string, value double, weight double")
    got = {r.zone: (r.mean, r.low, r.high, r.n_cells, r.method) for r in space.zonal_mean(cells, "zone", zones=spark.createDataFrame([(z,) for z in "zwvu"], "zone string")).collect()}
    assert got == {"z": (2.0, 1.0, 4.0, 2, "population_weighted"), "w": (5.0, 5.0, 5.0, 1, "unweighted_fallback"), "v": (None, None, None, 0, "no_valid_cells"), "u": (None, None, None, 0, "no_overlap")}


def jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))


def test_audits_cost_no_job(spark):
    left = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (7, "c")], "k int, v string")
    spark.sparkContext.setJobGroup("counted", "")
    joined, seen = panel.observed_left_join(left, right, ["k"])
    steps = panel.RowCounts()
    kept = steps.watch("kept", steps.watch("joined", joined).where("v = 'b'"))
    assert jobs(spark) == 0
    assert kept.count() == 2
    after = jobs(spark)
    assert seen.get == {"n_left": 4, "n_matched": 3, "n_unmatched": 1} and jobs(spark) == after
    spark.sparkContext.setJobGroup("", "")
    assert [tuple(r) for r in steps.report(spark).collect()] == [("joined", None, 4, None), ("kept", 4, 2, -2)]
    assert {tuple(r) for r in joined.collect()} == {(1, "a"), (2, "b"), (None, None)}
    with pytest.raises(Exception, match="repeated key 1"):
        panel.observed_left_join(left, right.unionByName(right.limit(1)), ["k"])[0].collect()


def test_readers_of_split_files(spark, tmp_path):
    """A file cut into many splits keeps its header and its encoding; a thousand shards are one scan a layout."""
    folder = tmp_path / "with blank"
    folder.mkdir()
    body = "".join(f"{i:05d},x{i}\n" for i in range(20_000))
    (folder / "utf.csv").write_text("﻿code,name\n" + body + "99999,señal\n", encoding="utf-8")
    (folder / "latin.csv").write_bytes(("name,code\n" + "".join(f"y{i},{i:05d}\n" for i in range(5000)) + "señal,88888\n").encode("latin-1"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert {k: [p.rsplit("/", 1)[1] for p in v] for k, v in tables.files_by_encoding(spark, str(folder)).items()} == {"UTF-8": ["utf.csv"], "ISO-8859-1": ["latin.csv"]}
        read = tables.read_csv_smart(spark, str(folder))
        assert read.count() == 25_002 and read.where("name = 'señal'").count() == 2 and read.where("code = '00007'").count() == 2
        assert {h.lstrip("﻿") for h in tables.headers(spark, str(folder)).values()} == {"code,name", "name,code"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    shards = tmp_path / "shards"
    shards.mkdir()
    for i in range(300):
        (shards / f"s{i}_CA.csv").write_text(("a,b\n1,2\n" if i % 2 else "b,a\n2,1\n"))
    (shards / "other.csv").write_text("c\n1\n")
    paths = [str(p) for p in sorted(shards.iterdir())]
    own, rest = tables.read_sharded(spark, paths, ["a", "b"], "_CA", True)
    assert own.distinct().collect() == [("1", "2")] and own.count() == 300 and rest == [str(shards / "other.csv")]
    assert own._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2
    with pytest.raises(PipelineError, match="lacks z; its header is"):
        tables.read_sharded(spark, paths, ["z"], "_CA", True)


def test_years_resume_after_a_break(spark, tmp_path):
    path, made, broken = str(tmp_path / "years"), [], {2017}

    def make(year):
        made.append(year)
        rows = spark.range(3).select((F.col("id") + year).alias("v"))
        return rows.withColumn("v", F.when(F.col("v") == 2019, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("v"))) if year in broken else rows

    with pytest.raises(Exception, match="lost"):
        tables.checkpointed_by_year(spark, path, [2016, 2017, 2018], make)
    # what a broken run may leave: rows without a mark
    spark.range(99).select(F.col("id").alias("v")).write.parquet(f"{path}/year=2018")
    broken.clear()
    got = tables.checkpointed_by_year(spark, path, [2016, 2017, 2018], make)
    assert made == [2016, 2017, 2017, 2018]
    assert {(r.year, r.v) for r in got.collect()} == {(y, y + i) for y in (2016, 2017, 2018) for i in range(3)} and got.count() == 9
    assert tables.checkpointed_by_year(spark, path, [2016, 2018], make).count() == 6 and len(made) == 4
