"""Polygons as vertex tables (code, part, ring, seq, lon, lat): containment, areas, interior points, dissolving.

A ring's vertices are in order by seq and closed by the first. A point is inside if a ray from it crosses the rings' edges an odd number of times, so
holes need no orientation. Points on an edge may fall to either side. Polygons are covered by the cells of a grid, so that only points near an edge are tested.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadflow.errors import PipelineError
from dyadflow.sources.tables import written

RING = ["code", "part", "ring"]


def edges(polygons: DataFrame) -> DataFrame:
    """(code, part, ring, lon1, lat1, lon2, lat2): each vertex with the next of its ring."""
    by = Window.partitionBy(*RING).orderBy("seq")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(by), F.first(c).over(whole))
    return polygons.select(*RING, F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), after("lon").alias("lon2"), after("lat").alias("lat2"))


def bounded(polygons: DataFrame, size: float) -> DataFrame:
    """(code, c, r): the cells of a grid that an edge runs through, each once; rounding counts a cell too many rather than one too few."""
    e = edges(polygons)
    slack = 1e-9 * size
    low, high = F.least("lon1", "lon2"), F.greatest("lon1", "lon2")
    columns = e.withColumn("c", F.explode(F.sequence(F.floor((low - slack) / size), F.floor((high + slack) / size))))
    # the part of the edge within a column of cells, and the rows of cells that it spans there
    steep = F.when(high > low, (F.col("lat2") - F.col("lat1")) / (F.col("lon2") - F.col("lon1")))
    at = lambda x: F.col("lat1") + steep * (F.least(F.greatest(x, low), high) - F.col("lon1"))
    a, b = F.coalesce(at(F.col("c") * size), "lat1"), F.coalesce(at((F.col("c") + 1) * size), "lat2")
    rows = F.sequence(F.floor((F.least(a, b) - slack) / size), F.floor((F.greatest(a, b) + slack) / size))
    return columns.withColumn("r", F.explode(rows)).select("code", "c", "r").distinct()


def cell_cover(polygons: DataFrame, size: float) -> DataFrame:
    """(code, c, r, edge): the cells of a grid that polygons cover: those that an edge runs through, and those inside.

    A row of cells is crossed along its middle: between an odd and the next crossing lie the cells inside.
    """
    edge = bounded(polygons, size)
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    middle = (F.col("r") + 0.5) * size
    rows = edges(polygons).where("lat1 <> lat2").withColumn("r", F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))).where((F.col("lat1") > middle) != (F.col("lat2") > middle))
    x = F.col("lon1") + (middle - F.col("lat1")) * (F.col("lon2") - F.col("lon1")) / (F.col("lat2") - F.col("lat1"))
    by = Window.partitionBy("code", "r").orderBy("x")  # the crossings of one polygon in one row
    runs = rows.select("code", "r", x.alias("x")).withColumns({"i": F.row_number().over(by), "to": F.lead("x").over(by)}).where("i % 2 = 1 AND to IS NOT NULL")
    inside = runs.withColumn("c", F.explode(F.sequence(F.floor(F.col("x") / size), F.floor(F.col("to") / size)))).select("code", "c", "r").distinct()
    return inside.join(edge, ["code", "c", "r"], "left_anti").withColumn("edge", F.lit(False)).unionByName(edge.withColumn("edge", F.lit(True)))


def point_in_polygon(points: DataFrame, polygons: DataFrame, key: list[str], cell: float = 1.0, own: str | None = None) -> DataFrame:
    """(key, code) of points (key, lon, lat) inside a polygon; with `own`, a column of points, only that polygon is asked.

    Points meet the cells that polygons cover: inside a cell that no edge runs through an equi-join decides; in the other cells a point meets that polygon's edges
    in its row of cells. So the rows are those of the points, and of points near an edge times the edges of one polygon in one row.
    """
    cover = written(cell_cover(polygons, cell))
    at = {"c": F.floor(F.col("lon") / cell), "r": F.floor(F.col("lat") / cell)}
    if own:
        met = points.select(*key, "lon", "lat", F.col(own).alias("_own")).withColumnRenamed("_own", "_code").withColumns(at)
        met = met.join(cover.withColumnRenamed("code", "_code"), ["_code", "c", "r"])
    else:
        met = points.select(*key, "lon", "lat").withColumns(at).join(cover.withColumnRenamed("code", "_code"), ["c", "r"])
    sure = met.where("not edge").select(*key, F.col("_code").alias("_in"))
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    banded = edges(polygons).where("lat1 <> lat2").withColumn("r", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))).select(F.col("code").alias("_code"), "r", "lon1", "lat1", "lon2", "lat2")
    spans = (F.col("lat1") > F.col("lat")) != (F.col("lat2") > F.col("lat"))
    x = F.col("lon1") + (F.col("lat") - F.col("lat1")) * (F.col("lon2") - F.col("lon1")) / (F.col("lat2") - F.col("lat1"))
    crossed = met.where("edge").join(banded, ["_code", "r"]).where(spans & (F.col("lon") < x)).groupBy(*key, F.col("_code").alias("_in")).agg(F.count(F.lit(1)).alias("_n"))
    both = sure.unionByName(crossed.where("_n % 2 = 1").select(*key, "_in"))
    return both.select(*[F.col(k) for k in key if k != "code"], F.col("_in").alias("code"))


def cells_touched(cells: DataFrame, polygons: DataFrame, key: list[str], size: float) -> DataFrame:
    """(key, code) of square cells (key, lon, lat of the lower left corner) whose centre is inside, or that an edge runs through."""
    centred = cells.withColumns({"lon": F.col("lon") + size / 2, "lat": F.col("lat") + size / 2})
    inside = point_in_polygon(centred, polygons, key, size)
    column = F.floor(F.col("lon") / size)
    bounds = edges(polygons).withColumn("c", F.explode(F.sequence(F.floor(F.least("lon1", "lon2") / size), F.floor(F.greatest("lon1", "lon2") / size))))
    # the part of the edge within a column of cells, and the rows of cells that it spans there
    steep = F.when(F.col("lon2") != F.col("lon1"), (F.col("lat2") - F.col("lat1")) / (F.col("lon2") - F.col("lon1")))
    cut = lambda x: F.coalesce(F.col("lat1") + steep * (F.least(F.greatest(x, F.least("lon1", "lon2")), F.greatest("lon1", "lon2")) - F.col("lon1")), F.col("lat1"))
    a, b = cut(F.col("c") * size), F.when(steep.isNull(), F.col("lat2")).otherwise(cut((F.col("c") + 1) * size))
    run = bounds.withColumn("r", F.explode(F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size)))).select("code", "c", "r").distinct()
    touched = cells.withColumns({"c": column, "r": F.floor(F.col("lat") / size)}).join(run, ["c", "r"]).select(*key, "code")
    return inside.unionByName(touched).distinct()


def containment_check(points: DataFrame, polygons: DataFrame, snap: DataFrame | None = None) -> DataFrame:
    """points (code, lon, lat) with `inside`, whether each lies in its own polygon; with snap (code, lon, lat), those outside move there."""
    found = point_in_polygon(points, polygons, ["code"], own="code").withColumn("inside", F.lit(True))
    out = points.join(found, "code", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    if snap is None:
        return out
    moved = out.join(snap.select("code", F.col("lon").alias("_lon"), F.col("lat").alias("_lat")), "code", "left")
    return moved.withColumns({c: F.when(F.col("inside"), F.col(c)).otherwise(F.coalesce(f"_{c}", c)) for c in ("lon", "lat")}).drop("_lon", "_lat")


#: WGS84 radius in km of the sphere of equal area; fixed value.
AUTHALIC_KM = 6371.0071809


def equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Lambert's cylindrical equal-area projection on the sphere of equal area, in km."""
    return AUTHALIC_KM * F.radians(lon), AUTHALIC_KM * F.sin(F.radians(lat))


def polygon_area(polygons: DataFrame, planar: bool = False) -> DataFrame:
    """(code, area_km2): parts add, holes (ring > 0) subtract; with planar, coordinates are km already."""
    x1, y1 = (F.col("lon1"), F.col("lat1")) if planar else equal_area(F.col("lon1"), F.col("lat1"))
    x2, y2 = (F.col("lon2"), F.col("lat2")) if planar else equal_area(F.col("lon2"), F.col("lat2"))
    rings = edges(polygons).groupBy(*RING).agg(F.abs(F.sum(x1 * y2 - x2 * y1) / 2).alias("a"))
    return rings.groupBy("code").agg(F.sum(F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a"))).alias("area_km2"))


def interior_point(polygons: DataFrame) -> DataFrame:
    """(code, lon, lat): the middle of the widest stretch inside (the first of those that tie), on the line half way up; a ring's vertex on that line does no harm."""
    half = polygons.groupBy("code").agg(((F.min("lat") + F.max("lat")) / 2).alias("y"))
    crossed = edges(polygons).join(half, "code").where((F.col("lat1") > F.col("y")) != (F.col("lat2") > F.col("y")))
    at = F.col("lon1") + (F.col("y") - F.col("lat1")) * (F.col("lon2") - F.col("lon1")) / (F.col("lat2") - F.col("lat1"))
    by = Window.partitionBy("code").orderBy("x")
    runs = crossed.select("code", "y", at.alias("x")).withColumns({"i": F.row_number().over(by), "to": F.lead("x").over(by)}).where("i % 2 = 1")
    return runs.groupBy("code").agg(F.max_by(F.struct(((F.col("x") + F.col("to")) / 2).alias("lon"), F.col("y").alias("lat")), F.struct(F.round(F.col("to") - F.col("x"), 9), -F.col("x"))).alias("p")).select("code", "p.lon", "p.lat")


def dissolve(polygons: DataFrame, names: DataFrame, xwalk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(polygons under their parents' codes, (code, name) of what is left): parts are numbered anew, names are the parents' own."""
    step = xwalk.select(F.col("child").alias("code"), "parent")
    moved = polygons.join(step, "code", "left").withColumn("part", F.dense_rank().over(Window.partitionBy(F.coalesce("parent", "code")).orderBy("code", "part")) - 1)
    out = moved.withColumn("code", F.coalesce("parent", "code")).drop("parent")
    return out, names.join(step, "code", "left_anti")


def harmonized_universe(polygons: DataFrame, xwalk: DataFrame) -> DataFrame:
    """The codes of a geometry after the crosswalk, each once."""
    step = xwalk.select(F.col("child").alias("code"), "parent")
    return polygons.select("code").distinct().join(step, "code", "left").select(F.coalesce("parent", "code").alias("code")).distinct()


def vintage_check(geometry: DataFrame, census: DataFrame, xwalk: DataFrame) -> DataFrame:
    """The harmonised codes of a geometry, if the harmonised census has the same; else an error that lists both sides."""
    a, b = harmonized_universe(geometry, xwalk), harmonized_universe(census, xwalk)
    extra, lacking = (sorted(r[0] for r in x.join(y, "code", "left_anti").limit(20).collect()) for x, y in ((a, b), (b, a)))
    if extra or lacking:
        raise PipelineError(f"only in the geometry: {extra}; only in the census: {lacking}")
    return a


def centroids_with_fallback(cells: DataFrame, polygons: DataFrame, zone: str = "code", weight: str = "weight") -> DataFrame:
    """(code, lon, lat, method): weighted mean of cell centres; the interior point of a polygon without weight."""
    live = cells.where(F.col(weight) > 0).groupBy(zone).agg(*[(F.sum(F.col(weight) * F.col(c)) / F.sum(weight)).alias(f"_{c}") for c in ("lon", "lat")])
    inner = interior_point(polygons)
    out = inner.join(live.withColumnRenamed(zone, "code"), "code", "left")
    return out.select("code", F.coalesce("_lon", "lon").alias("lon"), F.coalesce("_lat", "lat").alias("lat"), F.when(F.col("_lon").isNotNull(), "population_weighted").otherwise("interior_point").alias("method"))


