"""Forests on log flows, tuned by out-of-bag errors.

Spark's forests keep no record of the rows that a tree saw. Here each tree is a forest of one, and how often a row is in the
bag of tree t is a Poisson(1) number that a hash of the row's key and t gives: bags need no table, are the same after a lost
executor, and rows of one key (a pair and its copies) are in a bag together. A row's out-of-bag prediction is the mean of the
trees whose bag it is not in. The first n trees are the forest of n trees, so one set of trees gives the errors of every n.
"""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadflow.operators.models import null_sentinel_fill
from dyadflow.sources.tables import written

#: Draws are whole numbers below this; a double holds each of them.
DRAWS = 1 << 52
#: A row is at most so often in a bag; more than this has a chance below 1e-13.
MOST = 15


def times_in_bag(keys: list[str], tree: int, seed: int) -> Column:
    """How often a row is in the bag of a tree: Poisson with mean 1, from a hash of the row's keys, the tree and the seed."""
    u = F.pmod(F.xxhash64(*keys, F.lit(tree), F.lit(seed)), F.lit(DRAWS)) / DRAWS
    below = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(MOST)]
    times = F.lit(0)
    for chance in below:
        times = times + (u >= chance).cast("int")
    return times


def bagged_trees(rows: DataFrame, keys: list[str], numbers: range, min_leaf: int, depth: int = 5, subset: str = "onethird", bins: int = 32, seed: int = 7, at_once: int = 8) -> list[DecisionTreeRegressionModel]:
    """The trees with the numbers given on rows (keys, features, _y); `at_once` of them are grown at a time.

    A leaf holds at least min_leaf different rows, however often each is in the bag.
    """

    def grow(tree: int) -> DecisionTreeRegressionModel:
        bag = rows.select("features", "_y", times_in_bag(keys, tree, seed).cast("double").alias("_times")).where("_times > 0")
        one = RandomForestRegressor(labelCol="_y", weightCol="_times", bootstrap=False, numTrees=1, minInstancesPerNode=min_leaf, maxDepth=depth, maxBins=bins, featureSubsetStrategy=subset, seed=seed + tree)
        return one.fit(bag).trees[0]

    with ThreadPool(at_once) as pool:
        return pool.map(grow, numbers)


def out_of_bag(rows: DataFrame, keys: list[str], trees: list[DecisionTreeRegressionModel], seed: int = 7) -> DataFrame:
    """rows with _apart, for each tree its prediction, or null where the row is in the tree's bag."""
    scored = rows
    for t, tree in enumerate(trees):
        scored = tree.copy({tree.predictionCol: f"_p{t}"}).transform(scored)
    apart = [F.when(times_in_bag(keys, t, seed) == 0, F.col(f"_p{t}")) for t in range(len(trees))]
    return scored.select(*rows.columns, F.array(*apart).alias("_apart"))


def out_of_bag_errors(rows: DataFrame, keys: list[str], trees: list[DecisionTreeRegressionModel], counts: list[int], seed: int = 7) -> dict[int, float | None]:
    """For each number of trees, the mean squared error of its out-of-bag predictions; all in one pass.

    Rows that are in the bag of every tree have no prediction and count in no error; None where no row has one.
    """
    apart = out_of_bag(rows, keys, trees, seed)
    errors = []
    for n in counts:
        seen = F.filter(F.slice("_apart", 1, n), lambda p: p.isNotNull())
        gap = F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda a, p: a + p) / F.size(seen) - F.col("_y"))
        errors.append(F.avg(gap * gap).alias(str(n)))
    found = apart.agg(*errors).head()
    return {n: found[str(n)] for n in counts}


def dealt(rows: DataFrame, keys: list[str], few: int = 20_000) -> DataFrame:
    """rows, computed once, in as many partitions as their number asks for: a tree is a job for each level, and each of them has a task for each partition."""
    rows = written(rows)
    return rows.repartitionByRange(rows.count() // few + 1, *keys).sortWithinPartitions(*keys)


def forest_regression(rows: DataFrame, features: list[str], y: str, keys: list[str], leaves: list[int], trees: list[int], depth: int = 5, seed: int = 7):
    """(model, importances, table of trials): a forest on log(1 + y), a third of the features at a split.

    The smallest leaf is chosen first, with the first number of trees, then the number of trees, each by the out-of-bag error;
    of equal errors the first given stays. The model is then fitted on all rows. Nulls of features are what `null_sentinel_fill`
    makes of them; rows with a null y are left out.
    """
    filled = null_sentinel_fill(rows.where(F.col(y).isNotNull()), features)
    made = dealt(VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(filled).select(*keys, "features", F.log1p(y).alias("_y")), keys).persist()
    tried: dict[tuple[int, int], float | None] = {}
    worst = lambda error: math.inf if error is None else error

    grown = {}
    for leaf in leaves:
        grown[leaf] = bagged_trees(made, keys, range(trees[0]), leaf, depth, seed=seed)
        tried[leaf, trees[0]] = out_of_bag_errors(made, keys, grown[leaf], trees[:1], seed)[trees[0]]
    leaf = min(leaves, key=lambda k: worst(tried[k, trees[0]]))
    more = grown[leaf] + bagged_trees(made, keys, range(trees[0], max(trees)), leaf, depth, seed=seed)
    tried |= {(leaf, n): e for n, e in out_of_bag_errors(made, keys, more, trees, seed).items()}
    n = min(trees, key=lambda t: worst(tried[leaf, t]))

    model = RandomForestRegressor(labelCol="_y", featureSubsetStrategy="onethird", minInstancesPerNode=leaf, maxDepth=depth, numTrees=n, seed=seed).fit(made)
    made.unpersist()
    trials = rows.sparkSession.createDataFrame([(a, b, e) for (a, b), e in tried.items()], "min_leaf int, trees int, oob_mse double")
    return model, dict(zip(features, map(float, model.featureImportances.toArray()), strict=True)), trials
