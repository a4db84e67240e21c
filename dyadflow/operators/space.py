"""Cells, points and neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zonal_mean(cells: DataFrame, zone: str, value: str = "value", weight: str = "weight", zones: DataFrame | None = None) -> DataFrame:
    """(zone, mean, plain_mean, low, high, weight_sum, n_cells, method): weighted mean over cells with a value and a positive weight; the plain mean, so labelled, where no weight is positive.

    low, high and n_cells are those of the cells that were averaged. A mean outside them (weights or values went wrong) raises. With zones (zone), those
    without a cell have a row too, labelled no_overlap.
    """
    live = F.col(value).isNotNull() & (F.col(weight) > 0)
    w, v = F.when(live, F.col(weight)), F.when(live, F.col(value))
    weighted = F.sum(w) > 0
    mean = F.coalesce(F.sum(v * w) / F.nullif(F.sum(w), F.lit(0.0)), F.avg(value))
    low, high = (F.when(weighted, f(v)).otherwise(f(value)) for f in (F.min, F.max))
    outside = (mean < low - 1e-9 * (1 + F.abs(low))) | (mean > high + 1e-9 * (1 + F.abs(high)))
    checked = F.when(outside, F.raise_error(F.lit("a weighted mean is outside the range of its cells")).cast("double")).otherwise(mean)
    label = F.when(weighted, "population_weighted").when(F.count(value) > 0, "unweighted_fallback").otherwise("no_valid_cells")
    n = F.when(weighted, F.count(w)).otherwise(F.count(value))
    out = cells.groupBy(zone).agg(checked.alias("mean"), F.avg(value).alias("plain_mean"), low.alias("low"), high.alias("high"), F.coalesce(F.sum(w), F.lit(0.0)).alias("weight_sum"), n.alias("n_cells"), label.alias("method"))
    if zones is None:
        return out
    return zones.select(zone).distinct().join(out, zone, "left").fillna({"weight_sum": 0.0, "n_cells": 0, "method": "no_overlap"})


def regrid_sum(cells: DataFrame, factor: int, weight: str = "weight") -> DataFrame:
    return cells.groupBy(F.floor(F.col("col") / factor).alias("col"), F.floor(F.col("row") / factor).alias("row")).agg(F.sum(weight).alias(weight))


def weighted_centroid(cells: DataFrame, zone: str, weight: str = "weight") -> DataFrame:
    """Centroids over cell centres of positive weight."""
    live = cells.where(F.col(weight) > 0)
    return live.groupBy(zone).agg(*[(F.sum(F.col(weight) * (F.col(c) + 0.5)) / F.sum(weight)).alias(f"center_{c}") for c in ("col", "row")])


def knn_weights(pairs: DataFrame, k: int, distance: str) -> DataFrame:
    """(orig, dest, weight 1/k): the k nearest of each unit, ties by code, from the panel's own pair distances."""
    near = Window.partitionBy("orig").orderBy(distance, "dest")
    return pairs.where("orig <> dest").withColumn("_i", F.row_number().over(near)).where(F.col("_i") <= k).select("orig", "dest", F.lit(1.0 / k).alias("weight"))


def spatial_lag(weights: DataFrame, units: DataFrame, key: str, value: str) -> DataFrame:
    """(key, lag): the weighted sum of the neighbours' values; 0 for a unit that has no neighbour."""
    there = weights.join(units.select(F.col(key).alias("dest"), F.col(value).alias("_v")), "dest")
    lags = there.groupBy(F.col("orig").alias(key)).agg(F.sum(F.col("weight") * F.col("_v")).alias("lag"))
    return units.select(key).distinct().join(lags, key, "full_outer").fillna(0.0, ["lag"])


def morans_i(weights: DataFrame, units: DataFrame, key: str, value: str) -> DataFrame:
    """One row (n, moran)."""
    mean = units.agg(F.avg(value).alias("_m"))
    z = units.join(F.broadcast(mean)).select(F.col(key), (F.col(value) - F.col("_m")).alias("_z"))
    crossed = weights.join(z.select(F.col(key).alias("orig"), F.col("_z").alias("_a")), "orig").join(z.select(F.col(key).alias("dest"), F.col("_z").alias("_b")), "dest")
    over = crossed.agg(F.sum(F.col("weight") * F.col("_a") * F.col("_b")).alias("_cross"), F.sum("weight").alias("_s0"))
    return over.join(F.broadcast(z.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_z") * F.col("_z")).alias("_zz")))).select("n", (F.col("n") / F.col("_s0") * F.col("_cross") / F.col("_zz")).alias("moran"))


def idw_fill(units: DataFrame, pairs: DataFrame, key: str, value: str, distance: str, k: int = 8) -> DataFrame:
    """Nulls become the inverse-square-distance mean of the k nearest units that have a value."""
    known = units.where(F.col(value).isNotNull()).select(F.col(key).alias("dest"), F.col(value).alias("_v"))
    lacking = units.where(F.col(value).isNull()).select(F.col(key).alias("orig"))
    near = pairs.where("orig <> dest").join(lacking, "orig", "left_semi").join(known, "dest").withColumn("_i", F.row_number().over(Window.partitionBy("orig").orderBy(distance, "dest"))).where(F.col("_i") <= k)
    d = F.greatest(F.col(distance), F.lit(1e-6))
    made = near.groupBy(F.col("orig").alias(key)).agg((F.sum(F.col("_v") / (d * d)) / F.sum(1 / (d * d))).alias("_made"))
    label = F.when(F.col(value).isNotNull(), "given").when(F.col("_made").isNotNull(), "idw_knn_fill").otherwise("missing")
    return units.join(made, key, "left").select(key, F.coalesce(value, "_made").alias(value), label.alias("method"))
