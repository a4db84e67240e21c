"""Out-of-bag errors against bagging in plain Python."""

import math
import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from dyadflow.operators import forests


def made(spark, points):
    rows = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "id long, x double, _y double")
    return VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)


def cart(bag, depth, least):
    """A regression tree on [(x, y, times)]: a function of x."""
    values = sorted({x for x, _, _ in bag})
    cuts = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]

    def spread(rows):
        w = sum(t for _, _, t in rows)
        mean = sum(y * t for _, y, t in rows) / w
        return sum(t * (y - mean) ** 2 for _, y, t in rows)

    def grow(rows, left):
        mean = sum(y * t for _, y, t in rows) / sum(t for _, _, t in rows)
        best, at = 1e-9, None
        for cut in cuts if left else []:
            below, above = [r for r in rows if r[0] <= cut], [r for r in rows if r[0] > cut]
            if min(len(below), len(above)) >= least and (gain := spread(rows) - spread(below) - spread(above)) > best + 1e-9:
                best, at = gain, cut
        if at is None:
            return lambda x: mean
        low, high = grow([r for r in rows if r[0] <= at], left - 1), grow([r for r in rows if r[0] > at], left - 1)
        return lambda x: low(x) if x <= at else high(x)

    return grow(bag, depth)


def test_bags_are_poisson_and_follow_the_key(spark):
    rows = spark.range(40_000).select("id", *[forests.times_in_bag(["id"], t, 3).alias(f"t{t}") for t in (0, 1)])
    counts = {r["t0"]: r["count"] / 40_000 for r in rows.groupBy("t0").count().collect()}
    for k in range(5):
        assert counts[k] == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.01)
    assert abs(rows.agg(F.corr("t0", "t1")).head()[0]) < 0.02
    again = rows.repartition(3).select("id", forests.times_in_bag(["id"], 0, 3).alias("t0"))
    assert again.exceptAll(rows.select("id", "t0")).isEmpty()


@pytest.mark.parametrize("least", [1, 9])
def test_errors_equal_plain_bagging(spark, least):
    draw = random.Random(least)
    points = [(i * 7 % 20, math.sin(i * 7 % 20) * 3 + draw.gauss(0, 1)) for i in range(160)]
    rows, counts = made(spark, points), [1, 3, 6]
    trees = forests.bagged_trees(rows, ["id"], range(6), least, depth=3, subset="all")
    got = forests.out_of_bag_errors(rows, ["id"], trees, counts)
    times = rows.orderBy("id").select(*[forests.times_in_bag(["id"], t, 7).alias(f"t{t}") for t in range(6)]).collect()
    plain = [cart([(x, y, r[t]) for (x, y), r in zip(points, times, strict=True) if r[t]], 3, least) for t in range(6)]
    for n in counts:
        gaps = []
        for (x, y), r in zip(points, times, strict=True):
            if seen := [plain[t](x) for t in range(n) if not r[t]]:
                gaps.append((sum(seen) / len(seen) - y) ** 2)
        assert got[n] == pytest.approx(sum(gaps) / len(gaps), rel=1e-9)


def test_choice_importances_and_odd_rows(spark):
    rows = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") * 37 % 11).cast("double").alias("b"), ((F.col("id") % 7) * 3.0).alias("y"))
    _, importances, trials = forests.forest_regression(rows, ["a", "b"], "y", ["id"], leaves=[2, 100], trees=[5, 10])
    errors = {(r["min_leaf"], r["trees"]): r["oob_mse"] for r in trials.collect()}
    assert importances["a"] > importances["b"] and set(errors) == {(2, 5), (100, 5), (2, 10)} and errors[2, 5] < errors[100, 5]
    # nulls in features and in y, a row more than once
    odd = rows.select("id", F.when(F.col("id") % 9 > 0, F.col("a")).alias("a"), "b", F.when(F.col("id") % 5 > 0, F.col("y")).alias("y"))
    _, found, _ = forests.forest_regression(odd.unionAll(odd.where("id < 50")), ["a", "b"], "y", ["id"], leaves=[2], trees=[3])
    assert found["a"] > found["b"]


def test_rows_in_every_bag_count_in_no_error(spark):
    rows = made(spark, [(1.0, 2.0), (2.0, 5.0), (3.0, 1.0)])
    trees = forests.bagged_trees(rows, ["id"], range(1), 1)
    assert forests.out_of_bag_errors(rows.where(forests.times_in_bag(["id"], 0, 7) > 0), ["id"], trees, [1]) == {1: None}


def test_partitions_follow_the_rows(spark):
    rows = spark.range(0, 1000, 1, 64).select(F.col("id").alias("orig"), F.col("id").alias("dest"), (F.col("id") * 2.0).alias("_y"))
    kept = forests.dealt(rows, ["orig", "dest"])
    assert kept.rdd.getNumPartitions() == 1 and kept.collect() == rows.orderBy("orig").collect()
    assert forests.dealt(rows, ["orig", "dest"], few=300).rdd.getNumPartitions() == 4
