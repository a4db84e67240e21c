"""Queries of polygons and points: a 5 x 5 set of squares over the 100 x 100 grid, one for each nation, each with a notch in its upper side."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadflow.functions.distance import distance_gap, internal_distance_km, pair_distances
from dyadflow.functions.keys import safe_ratio
from dyadflow.operators import assemble as assembly
from dyadflow.operators import geometry, models, panel, quality, space
from dyadflow.operators import neighbours as near
from dyadflow.plans import standins as s
from dyadflow.plans.catalog import flows, query, r

#: The notch of nation k is 4, 8 or 12 deep: within a square a point is inside below 20 - depth * (10 - |x - 10|) / 10.
NATIONS = "pol AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS code, n_nationkey % 5 * 20 AS x0, n_nationkey // 5 * 20 AS y0, 4 + n_nationkey % 3 * 4 AS depth FROM nation)"
INSIDE = "{x} - x0 > 0 AND {x} - x0 < 20 AND {y} - y0 > 0 AND {y} - y0 < 20 - depth * (10 - abs({x} - x0 - 10)) / 10.0"


def polygons(spark, sf):
    k = F.col("n_nationkey")
    x, y, depth = k % 5 * 20, F.floor(k / 5) * 20, 4 + k % 3 * 4
    corners = [(x, y), (x + 20, y), (x + 20, y + 20), (x + 10, y + 20 - depth), (x, y + 20)]
    rows = F.array(*[F.struct(F.lit(i).alias("seq"), a.cast("double").alias("lon"), b.cast("double").alias("lat")) for i, (a, b) in enumerate(corners)])
    return s.table(spark, sf, "nation").select(F.lpad(k.cast("string"), 5, "0").alias("code"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.inline(rows))


def crosswalk(spark, sf):
    k = F.col("n_nationkey")
    return s.table(spark, sf, "nation").where((k % 3 == 0) & (k < 15)).select(F.lpad(k.cast("string"), 5, "0").alias("child"), F.lpad((k + 1).cast("string"), 5, "0").alias("parent"))


def grid(spark, sf):
    return s.cells(spark, sf).select("col", "row", "weight", "value", (F.col("col") + 0.5).alias("lon"), (F.col("row") + 0.5).alias("lat"))


@query(f"WITH {NATIONS}, {s.CELLS} SELECT code, count(*) AS n_cells, sum(weight) AS weight FROM cells JOIN pol ON {INSIDE.format(x='(col + 0.5)', y='(row_ + 0.5)')} GROUP BY 1")
def cells_in_polygons(spark, sf):
    cells = grid(spark, sf)
    found = geometry.point_in_polygon(cells, polygons(spark, sf), ["col", "row"], cell=10.0)
    return found.join(cells, ["col", "row"]).groupBy("code").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("weight").alias("weight"))


@query(f"""WITH {NATIONS}, {s.CELLS}, c AS (SELECT *, (code IN ('00003', '00007')) AS bare FROM cells JOIN pol ON {INSIDE.format(x='(col + 0.5)', y='(row_ + 0.5)')})
SELECT code, round(CASE WHEN bare THEN avg(value) ELSE sum(CASE WHEN value IS NOT NULL THEN value * weight END) / sum(CASE WHEN value IS NOT NULL THEN weight END) END, 6) AS mean,
  CASE WHEN bare THEN 0.0 ELSE sum(CASE WHEN value IS NOT NULL THEN weight END) END AS weight_sum, CASE WHEN bare THEN 'unweighted_fallback' ELSE 'population_weighted' END AS method FROM c GROUP BY code, bare""")
def zonal_means_of_polygons(spark, sf):
    """Two polygons have no population, so that their means are plain ones."""
    cells = grid(spark, sf)
    found = geometry.point_in_polygon(cells, polygons(spark, sf), ["col", "row"], cell=10.0).join(cells, ["col", "row"])
    bare = F.col("code").isin("00003", "00007")
    return space.zonal_mean(found.withColumn("weight", F.when(~bare, F.col("weight")).otherwise(0.0)), "code").select("code", r("mean", 6), "weight_sum", "method")


@query(f"""WITH {NATIONS}, {s.CELLS}, c AS (SELECT code, col, row_, weight FROM cells JOIN pol ON {INSIDE.format(x='(col + 0.5)', y='(row_ + 0.5)')} WHERE code > '00004')
SELECT pol.code, round(coalesce(sum(weight * (col + 0.5)) / sum(weight), max(CASE WHEN depth > 10 THEN x0 + (10 - 10.0 * (depth - 10) / depth) / 2 ELSE x0 + 10 END)), 6) AS lon, round(coalesce(sum(weight * (row_ + 0.5)) / sum(weight), max(pol.y0) + 10), 6) AS lat,
  CASE WHEN sum(weight) > 0 THEN 'population_weighted' ELSE 'interior_point' END AS method FROM pol LEFT JOIN c ON c.code = pol.code GROUP BY 1""")
def centroids_of_polygons(spark, sf):
    """The first five polygons have no cells, and so get a point inside."""
    cells = grid(spark, sf)
    found = geometry.point_in_polygon(cells, polygons(spark, sf), ["col", "row"], cell=10.0).join(cells, ["col", "row"]).where("code > '00004'")
    return geometry.centroids_with_fallback(found, polygons(spark, sf)).select("code", r("lon", 6), r("lat", 6), "method")


@query(f"WITH {NATIONS} SELECT code, CAST(400 - 10 * depth AS DOUBLE) AS area, round(0.67 * sqrt((400.0 - 10 * depth) / pi()), 6) AS internal_km FROM pol")
def polygon_areas(spark, sf):
    return geometry.polygon_area(polygons(spark, sf), planar=True).select("code", F.round("area_km2", 6).alias("area"), F.round(internal_distance_km(F.col("area_km2")), 6).alias("internal_km"))


@query(f"WITH {NATIONS} SELECT code, round(CASE WHEN depth > 10 THEN x0 + (10 - 10.0 * (depth - 10) / depth) / 2 ELSE x0 + 10 END, 6) AS lon, CAST(y0 + 10 AS DOUBLE) AS lat FROM pol")
def points_inside_polygons(spark, sf):
    return geometry.interior_point(polygons(spark, sf)).select("code", r("lon", 6), "lat")


@query(f"""WITH {NATIONS}, pts AS (SELECT s_suppkey, lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS own, s_suppkey * 37 % 100 + 0.25 AS lon, s_suppkey * 61 % 100 + 0.35 AS lat FROM supplier)
SELECT own AS code, count(*) AS n, count(*) FILTER ({INSIDE.format(x='lon', y='lat')}) AS inside FROM pts JOIN pol ON own = code GROUP BY 1""")
def suppliers_in_their_polygon(spark, sf):
    k = F.col("s_suppkey")
    points = s.table(spark, sf, "supplier").select("s_suppkey", F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("code"), (k * 37 % 100 + 0.25).alias("lon"), (k * 61 % 100 + 0.35).alias("lat"))
    found = geometry.point_in_polygon(points, polygons(spark, sf), ["s_suppkey"], cell=10.0, own="code").withColumn("inside", F.lit(1))
    return points.join(found.drop("code"), "s_suppkey", "left").groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count("inside").alias("inside"))


@query(f"""WITH {NATIONS}, m AS (SELECT CASE WHEN CAST(code AS INT) % 3 = 0 AND CAST(code AS INT) < 15 THEN lpad(CAST(CAST(code AS INT) + 1 AS VARCHAR), 5, '0') ELSE code END AS code, CAST(400 - 10 * depth AS DOUBLE) AS area FROM pol)
SELECT m.code, sum(area) AS area, count(*) AS parts, max(n_name) AS name FROM m JOIN nation ON n_nationkey = CAST(m.code AS INT) GROUP BY 1""")
def polygons_dissolved(spark, sf):
    names = s.table(spark, sf, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("code"), F.col("n_name").alias("name"))
    merged, left = geometry.dissolve(polygons(spark, sf), names, crosswalk(spark, sf))
    parts = merged.groupBy("code").agg(F.count_distinct("part").alias("parts"))
    return geometry.polygon_area(merged, planar=True).join(parts, "code").join(left, "code").select("code", F.round("area_km2", 6).alias("area"), "parts", "name")


@query("SELECT lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS code FROM nation WHERE NOT (n_nationkey % 3 = 0 AND n_nationkey < 15)")
def harmonized_universe(spark, sf):
    """The geometry's codes after the crosswalk, checked against a census that has the children's parents already."""
    xwalk = crosswalk(spark, sf)
    census = polygons(spark, sf).select("code").distinct().join(xwalk.select(F.col("child").alias("code")), "code", "left_anti")
    return quality.code_set_equality(geometry.vintage_check(polygons(spark, sf), census, xwalk), census)


def placed(spark, sf):
    return s.points(spark, sf).withColumn("internal_dist_km", internal_distance_km(F.col("lat") * 10))


@query(f"""WITH {s.UNITS}, {s.POINTS}, {s.DISTANCES} SELECT orig, dest, round(km, 4) AS dist_greatcircle_km, false AS is_diagonal FROM dist
UNION ALL SELECT code, code, round(0.67 * sqrt(lat * 10 / pi()), 4), true FROM points""")
def pair_distance_table(spark, sf):
    """Both distances of all ordered pairs; SQL can say the one on the sphere."""
    spine = panel.build_spine(s.points(spark, sf), include_diagonal=True)
    return pair_distances(spine, placed(spark, sf)).select("orig", "dest", r("dist_greatcircle_km"), "is_diagonal")


@query()
def geodesic_gap(spark, sf):
    """Largest difference between sphere and ellipsoid; see the tests for the ellipsoid's closed forms."""
    return distance_gap(pair_distances(panel.build_spine(s.points(spark, sf)), placed(spark, sf)))


@query(f"""WITH {s.RECORDS}, {s.FLOWS}, {s.UNITS}, {s.POINTS}, t AS (SELECT orig, dest, migrants FROM flows WHERE orig <> dest ORDER BY migrants DESC, orig, dest LIMIT 40)
SELECT orig, dest, migrants, round((migrants - (SELECT min(migrants) FROM t)) / ((SELECT max(migrants) FROM t) - (SELECT min(migrants) FROM t)), 6) AS weight, round(a.lat, 6) AS lat_orig, round(a.lon, 6) AS lon_orig, round(b.lat, 6) AS lat_dest, round(b.lon, 6) AS lon_dest
FROM t LEFT JOIN points a ON a.code = orig LEFT JOIN points b ON b.code = dest""")
def edges_to_draw(spark, sf):
    found = models.top_edges(flows(spark, sf), s.points(spark, sf), 40)
    return found.select("orig", "dest", "migrants", *[r(c, 6) for c in ("weight", "lat_orig", "lon_orig", "lat_dest", "lon_dest")])


#: The covariates of the assembled panel, in SQL: two sources of income, weather of a window in F and m, ages of the records' destinations.
WEATHER = f"weather AS (SELECT {s.Z.format('l_partkey')} AS code, 50 + 400 * (sum(l_discount) / count(*)) AS temp, 10 * (sum(l_tax) / count(*)) AS precip FROM lineitem GROUP BY 1)"
AGES = "ages AS (SELECT dest AS code, CAST(sum(CASE WHEN age BETWEEN 15 AND 29 THEN w END) AS DOUBLE) AS youth, CAST(sum(CASE WHEN age BETWEEN 15 AND 64 THEN w END) AS DOUBLE) AS working FROM records GROUP BY 1)"
ENDS = """o.pop_1 AS src_pop, d.pop_2 AS dst_pop, round(o.income_1, 4) AS src_gdppc, round(d.income_1, 4) AS dst_gdppc, round(o.income_2, 4) AS src_income, round(d.income_2, 4) AS dst_income,
  round(o.temp, 4) AS src_temp, round(d.temp, 4) AS dst_temp, round(o.precip, 4) AS src_precip, round(d.precip, 4) AS dst_precip, o.period AS climate_period, round(o.youth / o.working, 6) AS src_dempres, round(d.youth / d.working, 6) AS dst_dempres"""


def covariates(spark, sf):
    a, b = s.vintages(spark, sf)
    of_part = s.zone("l_partkey").alias("code")
    weather = s.table(spark, sf, "lineitem").groupBy(of_part).agg((50 + 400 * F.avg("l_discount")).alias("temp"), (10 * F.avg("l_tax")).alias("precip"))
    climate, _ = assembly.climate_provider("era5_gee", {"climate_gee": weather}, (2016, 2020))
    age = F.col("age")
    ages = s.records(spark, sf).groupBy(F.col("dest").alias("code")).agg(F.sum(F.when(age.between(15, 29), F.col("w"))).cast("double").alias("youth"), F.sum(F.when(age.between(15, 64), F.col("w"))).cast("double").alias("working"))
    return [
        assembly.UnitTable("population", a.select("code", "pop_1").join(b.select("code", "pop_2"), "code", "full_outer"), {"pop_1": "pop_orig"}, {"pop_2": "pop_dest"}, required=True),
        assembly.UnitTable("gdp", a.select("code", F.round("income_1", 4).alias("gdppc")), {"gdppc": "gdppc_orig"}, {"gdppc": "gdppc_dest"}),
        assembly.UnitTable("income", b.select("code", F.round("income_2", 4).alias("income")), {"income": "income_orig"}, {"income": "income_dest"}),
        assembly.UnitTable("climate", climate.withColumns({c: F.round(c, 4) for c in ("temp_c", "precip_mm")}), {"temp_c": "temp_orig", "precip_mm": "precip_orig", "climate_period": "climate_period"}, {"temp_c": "temp_dest", "precip_mm": "precip_dest"}),
        assembly.UnitTable("demography", ages.select("code", F.round(safe_ratio(F.col("youth"), F.col("working")), 6).alias("dempres")), {"dempres": "dempres_orig"}, {"dempres": "dempres_dest"}),
    ]


PANEL_NAMES = {"orig": "src_code", "dest": "dst_code"} | {f"{c}_{end}": f"{prefix}_{c}" for c in ("pop", "gdppc", "income", "temp", "precip", "dempres") for end, prefix in (("orig", "src"), ("dest", "dst"))}
PANEL_SPEC = [(c, c.replace("_", " "), "", "given tables", "", "") for c in [*PANEL_NAMES.values(), "migrants", "migrants_unweighted", "flow_observed", "zero_class", "dist_km", "climate_period"]]


@query(f"""WITH {s.RECORDS}, {s.UNITS}, {s.FLOWS.replace(' AS (', ' AS MATERIALIZED (', 1)}, {s.VINTAGES}, {s.POINTS}, {s.DISTANCES.replace(' AS (', ' AS MATERIALIZED (', 1)}, {s.PANEL.replace(' AS (', ' AS MATERIALIZED (', 1)}, {WEATHER}, {AGES},
u AS MATERIALIZED (SELECT units.code, pop_1, pop_2, income_1, income_2, (temp - 32) / 1.8 AS temp, precip * 1000 AS precip, CASE WHEN temp IS NOT NULL THEN '2016-2020' END AS period, youth, working
  FROM units LEFT JOIN v1 USING (code) LEFT JOIN v2 USING (code) LEFT JOIN weather USING (code) LEFT JOIN ages USING (code))
SELECT panel.orig AS src_code, panel.dest AS dst_code, migrants, n AS migrants_unweighted, n > 0 AS flow_observed, CASE WHEN n > 0 THEN 'observed_positive'
  WHEN panel.orig IN (SELECT orig FROM flows WHERE orig <> dest) AND panel.dest IN (SELECT dest FROM flows WHERE orig <> dest) THEN 'sampling_zero_plausible' ELSE 'structural_zero_likely' END AS zero_class, round(km, 4) AS dist_km, {ENDS}
FROM panel JOIN u o ON o.code = panel.orig JOIN u d ON d.code = panel.dest JOIN dist ON dist.orig = panel.orig AND dist.dest = panel.dest""")
def assembled_panel(spark, sf):
    """The whole panel with population, two sources of income, climate and demography of both ends, all gates passed."""
    pairs = s.distances(spark, sf).select("orig", "dest", r("km").alias("dist_km"))
    sparse = flows(spark, sf).where("orig <> dest")
    return assembly.assemble(sparse, s.units(spark, sf), covariates(spark, sf), None, PANEL_SPEC, PANEL_NAMES, pairs, ["dist_km"]).panel


#: Customers as points: longitude by balance, latitude by its last digits.
CUSTOMERS = """cust AS MATERIALIZED (SELECT c_custkey AS code, -118 + 31 * ((c_acctbal + 1000) / 11000) AS lon, 14 + 19 * ((CAST(round(c_acctbal * 100) AS BIGINT) + 100000) * 7919 % 10007 / 10007.0::DOUBLE) AS lat,
  CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance FROM customer)"""
SPHERE = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


def customers(spark, sf):
    cents = F.round(F.col("c_acctbal") * 100).cast("long") + 100_000
    lon, lat = -118 + 31 * ((F.col("c_acctbal") + 1000) / 11000), 14 + 19 * (cents * 7919 % 10007 / F.lit(10007.0))
    return s.table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), lon.alias("lon"), lat.alias("lat"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("balance"))


@query(f"""WITH {CUSTOMERS}, near AS (SELECT a.code AS orig, b.code AS dest, sqrt(pow(a.lon - b.lon, 2) + pow(a.lat - b.lat, 2)) AS distance FROM cust a JOIN cust b ON a.code <> b.code)
SELECT orig, dest, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY orig ORDER BY distance, dest) AS INTEGER) AS rank FROM near QUALIFY rank <= 5""")
def nearest_customers(spark, sf):
    """The five nearest of every customer in plain degrees, by a grid and growing rings."""
    points = customers(spark, sf)
    return near.nearest(points, points, 5, near.Degrees()).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {CUSTOMERS}, near AS (SELECT a.code, b.balance, {SPHERE} AS km FROM cust a JOIN cust b ON a.balance IS NULL AND b.balance IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a.code ORDER BY km, b.code) <= 8),
made AS (SELECT code, sum(balance / (km * km)) / sum(1 / (km * km)) AS x FROM near GROUP BY 1)
SELECT cust.code, round(coalesce(balance, x), 2) AS balance, CASE WHEN balance IS NOT NULL THEN 'given' ELSE 'idw_knn_fill' END AS method FROM cust LEFT JOIN made USING (code)""")
def balances_filled_nearby(spark, sf):
    """Missing balances from the eight nearest customers on the sphere."""
    return near.idw_points(customers(spark, sf), "balance").select("code", r("balance", 2), "method")
