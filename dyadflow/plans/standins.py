"""The given tables read as the inputs of a panel: records, units, cells, months. Zones are ids modulo 200."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.functions.distance import great_circle_km

ZONES = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def zone(x: str) -> Column:
    return F.lpad((F.col(x) % ZONES).cast("string"), 5, "0")


def records(spark, sf_dir):
    """Person records: origin by customer, destination by supplier, quantity as weight."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    joined = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(zone("o_custkey").alias("orig"), zone("l_suppkey").alias("dest"), F.col("l_quantity").alias("w"), (F.col("l_partkey") % 90).alias("age"), (F.col("l_orderkey") % 10).alias("sentinel"))


def units(spark, sf_dir):
    """All zones, from the ids of orders' customers and lineitems' parts that name them."""
    ids = table(spark, sf_dir, "customer").select(zone("c_custkey").alias("code")).unionByName(table(spark, sf_dir, "part").select(zone("p_partkey").alias("code")))
    return ids.distinct()


def vintages(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(zone("c_custkey").alias("code")).agg(F.sum(F.abs("c_acctbal")).alias("pop_1"), F.avg("c_acctbal").alias("income_1"))
    b = table(spark, sf_dir, "part").groupBy(zone("p_partkey").alias("code")).agg(F.sum("p_size").alias("pop_2"), F.avg("p_retailprice").alias("income_2"))
    return a, b


def crosswalk(spark, sf_dir):
    """The first 20 triples of zones: the first of each became part of the second."""
    i = F.col("code").cast("int")
    return units(spark, sf_dir).where((i % 3 == 0) & (i < 60)).select(F.col("code").alias("child"), F.lpad((i + 1).cast("string"), 5, "0").alias("parent"))


def points(spark, sf_dir):
    z = F.col("code").cast("int")
    return units(spark, sf_dir).select("code", (14 + 19 * (z * 7919 % 1009) / 1009).alias("lat"), (-118 + 31 * (z * 104729 % 1013) / 1013).alias("lon"))


def distances(spark, sf_dir):
    from dyadflow.operators.panel import attach_both_roles, build_spine

    p = points(spark, sf_dir)
    placed = attach_both_roles(build_spine(p), p)
    return placed.select("orig", "dest", great_circle_km(F.col("lat_orig"), F.col("lon_orig"), F.col("lat_dest"), F.col("lon_dest")).alias("km"))


def cells(spark, sf_dir):
    """A 100 x 100 grid; rows without tax are nodata; 25 square zones of 20 x 20 cells."""
    l = table(spark, sf_dir, "lineitem")
    grid = l.groupBy((F.col("l_partkey") % 100).alias("col"), (F.col("l_orderkey") % 100).alias("row")).agg(
        F.avg(F.when(F.col("l_tax") != 0, F.col("l_discount"))).alias("value"), F.sum("l_quantity").alias("weight")
    )
    return grid.withColumn("zone", F.floor(F.col("col") / 20) * 5 + F.floor(F.col("row") / 20))


#: The same inputs in SQL.
Z = "lpad(CAST({} % 200 AS VARCHAR), 5, '0')"
RECORDS = f"records AS (SELECT {Z.format('o_custkey')} AS orig, {Z.format('l_suppkey')} AS dest, l_quantity AS w, l_partkey % 90 AS age, l_orderkey % 10 AS sentinel FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
UNITS = f"units AS (SELECT DISTINCT {Z.format('c_custkey')} AS code FROM customer UNION SELECT DISTINCT {Z.format('p_partkey')} FROM part)"
VINTAGES = f"""v1 AS (SELECT {Z.format('c_custkey')} AS code, sum(abs(c_acctbal)) AS pop_1, avg(c_acctbal) AS income_1 FROM customer GROUP BY 1),
v2 AS (SELECT {Z.format('p_partkey')} AS code, CAST(sum(p_size) AS BIGINT) AS pop_2, avg(p_retailprice) AS income_2 FROM part GROUP BY 1)"""
CROSSWALK = "xw AS (SELECT code AS child, lpad(CAST(CAST(code AS INT) + 1 AS VARCHAR), 5, '0') AS parent FROM units WHERE CAST(code AS INT) % 3 = 0 AND CAST(code AS INT) < 60)"
POINTS = "points AS (SELECT code, 14 + 19 * (CAST(code AS INT) * 7919 % 1009) / 1009.0::DOUBLE AS lat, -118 + 31 * (CAST(code AS INT) * 104729 % 1013) / 1013.0::DOUBLE AS lon FROM units)"
DISTANCES = """dist AS (SELECT a.code AS orig, b.code AS dest, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS km FROM points a, points b WHERE a.code <> b.code)"""
CELLS = """cells AS (SELECT *, (col // 20) * 5 + row_ // 20 AS zone FROM (SELECT l_partkey % 100 AS col, l_orderkey % 100 AS row_,
  avg(CASE WHEN l_tax <> 0 THEN l_discount END) AS value, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2))"""
FLOWS = "flows AS (SELECT orig, dest, sum(w) AS migrants, count(*) AS n FROM records GROUP BY 1, 2)"
PANEL = """panel AS (SELECT a.code AS orig, b.code AS dest, coalesce(migrants, 0) AS migrants, coalesce(n, 0) AS n
  FROM units a JOIN units b ON a.code <> b.code LEFT JOIN flows f ON f.orig = a.code AND f.dest = b.code)"""
