"""Nearest neighbours by a grid and growing rings, without the product of all points.

Targets lie in square cells. A point asks the cells up to `ring` cells away; what lies beyond is at least `ring` cell widths off, so a point is
done once its k-th distance is below that (or the ring holds the whole grid). The others ask again with the ring doubled. Cells are sized so
that a few of them hold k targets on average.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadflow.functions.distance import RADIUS, great_circle_km
from dyadflow.sources.tables import written


@dataclass(frozen=True)
class Degrees:
    """Euclidean distance of (lon, lat) as plain coordinates."""

    wraps: bool = False

    def between(self) -> Column:
        return F.sqrt(F.pow(F.col("lon") - F.col("_lon"), 2) + F.pow(F.col("lat") - F.col("_lat"), 2))

    def beyond(self, width: Column) -> Column:
        return width


@dataclass(frozen=True)
class GreatCircle:
    """Kilometres on the sphere; the grid goes round in longitude."""

    wraps: bool = True

    def between(self) -> Column:
        return great_circle_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))

    def beyond(self, width: Column) -> Column:
        """Nothing across `width` degrees of latitude, nor across a meridian `width` degrees away, is nearer."""
        angle = F.radians(F.least(width, F.lit(90.0)))
        return RADIUS * F.least(F.radians(width), F.asin(F.greatest(F.lit(0.0), F.cos(F.radians("lat"))) * F.sin(angle)))


#: Rows of places and asked cells that one task takes; each meets the few targets of its cell.
FEW_ROWS = 250_000


def nearest(points: DataFrame, targets: DataFrame, k: int, metric: Degrees | GreatCircle, key: str = "code") -> DataFrame:
    """(orig, dest, distance, rank): the k targets nearest to each point, ties by code; a point is not its own target.

    points and targets (key, lon, lat), keys different within each. Fewer than k targets: all of them.

    Points at one place ask once, for k + 1: without a point itself, the first k of these are its own. Of the targets at one place the first k + 1 by
    code come before the others from wherever they are asked, so the others are in no list.
    """
    spark = points.sparkSession
    there = F.col("lon").isNotNull() & F.col("lat").isNotNull() & F.col(key).isNotNull()
    schema = f"orig {dict(points.dtypes)[key]}, dest {dict(targets.dtypes)[key]}, distance double, rank int"
    first = F.row_number().over(Window.partitionBy("_lon", "_lat").orderBy("dest"))
    named = targets.where(there).select(F.col(key).alias("dest"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    targets = written(named.withColumn("_first", first).where(F.col("_first") <= k + 1).drop("_first"))
    box = targets.agg(F.count(F.lit(1)).alias("n"), *[f(f"_{c}").alias(f"{f.__name__}_{c}") for c in ("lon", "lat") for f in (F.min, F.max)]).head()
    if not box["n"]:
        return spark.createDataFrame([], schema)
    span = max(box["max_lon"] - box["min_lon"], box["max_lat"] - box["min_lat"], 1e-9)
    area = max(box["max_lon"] - box["min_lon"], span / 1e3) * max(box["max_lat"] - box["min_lat"], span / 1e3)
    size = math.sqrt(area * k / box["n"])
    columns = 1 << 62
    if metric.wraps:
        columns = max(1, math.floor(360 / size))
        size = 360 / columns
    column = lambda lon: F.floor(F.col(lon) / size)
    turned = lambda c: F.pmod(c, F.lit(columns)) if metric.wraps else c
    celled = targets.select("dest", "_lon", "_lat", turned(column("_lon")).alias("c"), F.floor(F.col("_lat") / size).alias("r"))
    asking = points.where(there).select(F.col(key).alias("orig"), "lon", "lat")
    left = written(asking.select("lon", "lat").distinct().select("lon", "lat", column("lon").alias("_c"), F.floor(F.col("lat") / size).alias("_r")))
    first_row, last_row = math.floor(box["min_lat"] / size), math.floor(box["max_lat"] / size)
    first_column, last_column = math.floor(box["min_lon"] / size), math.floor(box["max_lon"] / size)
    best = Window.partitionBy("lon", "lat").orderBy("distance", "dest")
    lists, ring, waiting = None, 1, left.count()
    while waiting:
        # the ring's rows and columns, cut to the grid (columns that go round are taken once each)
        rows = F.sequence(F.greatest(F.col("_r") - ring, F.lit(first_row)), F.least(F.col("_r") + ring, F.lit(last_row)))
        if metric.wraps:
            cols = F.sequence(F.col("_c") - ring, F.col("_c") + ring) if 2 * ring + 1 < columns else F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long"))
            whole = (2 * ring + 1 >= columns) & (F.col("_r") - ring <= first_row) & (F.col("_r") + ring >= last_row)
            no_cells = (F.col("_r") + ring < first_row) | (F.col("_r") - ring > last_row)
        else:
            cols = F.sequence(F.greatest(F.col("_c") - ring, F.lit(first_column)), F.least(F.col("_c") + ring, F.lit(last_column)))
            whole = (F.col("_r") - ring <= first_row) & (F.col("_r") + ring >= last_row) & (F.col("_c") - ring <= first_column) & (F.col("_c") + ring >= last_column)
            no_cells = (F.col("_r") + ring < first_row) | (F.col("_r") - ring > last_row) | (F.col("_c") + ring < first_column) | (F.col("_c") - ring > last_column)
        # the rows of a task follow from what is asked, as the bytes dealt to it do not tell how many targets they meet
        cells = min(2 * ring + 1, last_row - first_row + 1) * min(2 * ring + 1, columns if metric.wraps else last_column - first_column + 1)
        parts = max(waiting * cells, box["n"]) // FEW_ROWS + 1
        asked = left.where(~no_cells).withColumn("r", F.explode(rows)).withColumn("c", F.explode(cols)).withColumn("c", turned(F.col("c"))).repartition(parts, "c", "r")
        near = asked.join(celled.repartition(parts, "c", "r"), ["c", "r"]).withColumn("distance", metric.between())
        ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1)
        listed = ranked.groupBy("lon", "lat", "_c", "_r").agg(F.sort_array(F.collect_list(F.struct("distance", "dest"))).alias("near"))
        enough = (F.size("near") > k) & (F.element_at("near", -1)["distance"] < metric.beyond(F.lit(ring * size)))
        ready = written(listed.where(enough | whole).select("lon", "lat", "near"))
        lists = ready if lists is None else lists.unionByName(ready)
        # what is done, or has seen the whole grid (of which it may have found nothing), does not ask again
        left = written(left.where(~whole).join(ready.select("lon", "lat"), ["lon", "lat"], "left_anti"))
        ring, waiting = 2 * ring, left.count()
    if lists is None:
        return spark.createDataFrame([], schema)
    own = F.slice(F.filter("near", lambda x: x["dest"] != F.col("orig")), 1, k)
    placed = asking.join(lists, ["lon", "lat"]).select("orig", F.posexplode(own).alias("_at", "_near"))
    return placed.select("orig", "_near.dest", "_near.distance", (F.col("_at") + 1).alias("rank"))


def knn_graph(points: DataFrame, k: int, key: str = "code") -> DataFrame:
    """(orig, dest, weight): the k nearest of each point in plain degrees, row-standardised."""
    found = nearest(points, points, k, Degrees(), key)
    return found.select("orig", "dest", (1.0 / F.count(F.lit(1)).over(Window.partitionBy("orig"))).alias("weight"))


def idw_points(units: DataFrame, value: str, k: int = 8, key: str = "code") -> DataFrame:
    """(key, value, method): nulls become the inverse-square-distance mean of the k nearest units (great circle) that have a value; units (key, lon, lat, value)."""
    known, lacking = units.where(F.col(value).isNotNull()), units.where(F.col(value).isNull())
    near = nearest(lacking.select(key, "lon", "lat"), known.select(key, "lon", "lat"), k, GreatCircle(), key)
    d = F.greatest(F.col("distance"), F.lit(1e-6))
    made = near.join(known.select(F.col(key).alias("dest"), F.col(value).alias("_v")), "dest").groupBy(F.col("orig").alias(key)).agg((F.sum(F.col("_v") / (d * d)) / F.sum(1 / (d * d))).alias("_made"))
    label = F.when(F.col(value).isNotNull(), "given").when(F.col("_made").isNotNull(), "idw_knn_fill").otherwise("missing")
    return units.join(made, key, "left").select(key, F.coalesce(value, "_made").alias(value), label.alias("method"))
