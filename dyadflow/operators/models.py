"""Splits by unit, features, negatives, metrics, the gravity model and importances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, GeneralizedLinearRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadflow.errors import PipelineError
from dyadflow.operators.order import quantiles_by
from dyadflow.sources.tables import written


def quantile_cuts(df: DataFrame, value: str, classes: int) -> DataFrame:
    """One row (_cuts): the different values that part so many quantile classes."""
    cuts = quantiles_by(df, value, [i / classes for i in range(1, classes)])
    return cuts.agg(F.array_sort(F.collect_set("quantile")).alias("_cuts"))


def unit_split(units: DataFrame, key: str, value: str, order: Column, test_share: float = 0.2, classes: int = 3) -> DataFrame:
    """(key, stratum, split): within each quantile class of the value, the first share of the units by `order` is the test set."""
    known = units.where(F.col(value).isNotNull())
    # written, as the numbering reads it more than once
    placed = known.join(F.broadcast(quantile_cuts(known, value, classes))).select(key, F.size(F.filter("_cuts", lambda c: c < F.col(value))).alias("stratum"), order.alias("_order"))
    placed = written(numbered(written(placed), ["stratum", "_order", key]))
    sizes = placed.groupBy("stratum").agg(F.min("i").alias("_first"), F.count(F.lit(1)).alias("_n"))  # a row for each class
    test = F.col("i") - F.col("_first") < F.ceil(test_share * F.col("_n"))
    return placed.join(F.broadcast(sizes), "stratum").select(key, "stratum", F.when(test, "test").otherwise("train").alias("split"))


def dyad_split(panel: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """train or test where both ends are; else inference."""
    for role in ("orig", "dest"):
        panel = panel.join(units.select(F.col(key).alias(role), F.col("split").alias(f"_{role}")), role, "left")
    same = F.when(F.col("_orig") == F.col("_dest"), F.col("_orig")).otherwise("inference")
    return panel.withColumn("split", same).drop("_orig", "_dest")


def standardize(df: DataFrame, columns: list[str], fit_on: Column) -> DataFrame:
    """z-scores with the mean and population deviation of the rows that `fit_on` marks; a constant column becomes 0."""
    fitted = df.where(fit_on).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    scaled = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}
    return df.join(F.broadcast(fitted)).withColumns(scaled).select(df.columns)


def flow_metrics(df: DataFrame, y: str, p: str, *by: str) -> DataFrame:
    """Common part of commuters, errors in both spaces and the Poisson loss, for each group."""
    a, b = F.greatest(F.col(y), F.lit(0.0)), F.greatest(F.col(p), F.lit(0.0))
    gap, log_gap = F.col(y) - F.col(p), F.log1p(a) - F.log1p(b)
    return df.groupBy(*by).agg(
        (2 * F.sum(F.least(a, b)) / F.nullif(F.sum(a) + F.sum(b), F.lit(0.0))).alias("cpc"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.sqrt(F.avg(log_gap * log_gap)).alias("rmse_log"),
        (1 - F.sum(gap * gap) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"),
        (1 - F.sum(log_gap * log_gap) / F.nullif(F.var_pop(F.log1p(a)) * F.count(y), F.lit(0.0))).alias("r2_log"),
        F.avg(b - a * F.ln(b + 1e-8)).alias("poisson_nll"),
    )


def quantile_bins(df: DataFrame, x: str, y: str, bins: int | None = None) -> DataFrame:
    """Means of x and y in quantile bins of x, closed on the right; a fifth of the rows, but 2 to 20, where no number is given."""
    bins = bins or min(20, max(2, df.where(F.col(x).isNotNull()).count() // 5))
    placed = df.join(F.broadcast(quantile_cuts(df, x, bins))).withColumn("bin", F.size(F.filter("_cuts", lambda c: c < F.col(x))))
    return placed.groupBy("bin").agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.count(F.lit(1)).alias("n"))


def ppml_gravity(df: DataFrame, y: str, features: list[str]) -> GeneralizedLinearRegressionModel:
    """Poisson regression with a log link."""
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    return GeneralizedLinearRegression(family="poisson", link="log", labelCol=y, maxIter=50).fit(rows)


def gravity_design(panel: DataFrame, flow: str, pop_orig: str, pop_dest: str, distance: str) -> DataFrame:
    """(flow, log_pop_orig, log_pop_dest, log_km) of the rows in which all three can be taken."""
    logs = {"log_pop_orig": pop_orig, "log_pop_dest": pop_dest, "log_km": distance}
    return panel.select(flow, *[F.when(F.col(c) > 0, F.ln(c)).alias(name) for name, c in logs.items()]).dropna()


def coefficient_table(model: GeneralizedLinearRegressionModel, features: list[str]) -> DataFrame:
    """(term, coefficient, se, z, p) of a fitted gravity model."""
    s = model.summary
    # Spark puts the intercept last
    rows = zip([*features, "intercept"], [*map(float, model.coefficients), float(model.intercept)], s.coefficientStandardErrors, s.tValues, s.pValues, strict=True)
    return s.predictions.sparkSession.createDataFrame([tuple(r) for r in rows], "term string, coefficient double, se double, z double, p double")


def fit_table(model: GeneralizedLinearRegressionModel) -> DataFrame:
    """(measure, value) of a fitted gravity model: n, degrees of freedom, deviance, that of the constant alone, the share explained, Pearson's chi-squared and AIC."""
    s = model.summary
    residual, null = float(s.deviance), float(s.nullDeviance)
    pearson = s.residuals("pearson").agg(F.sum(F.pow(F.col("pearsonResiduals"), 2))).head()[0]
    rows = [("n", float(s.numInstances)), ("df_model", float(s.rank - 1)), ("df_residual", float(s.residualDegreeOfFreedom)), ("deviance", residual), ("null_deviance", null)]
    rows += [("explained_deviance", 1 - residual / null if null else None), ("pearson_chi2", float(pearson)), ("aic", float(s.aic))]
    return s.predictions.sparkSession.createDataFrame(rows, "measure string, value double")


def assert_split(panel: DataFrame, split: DataFrame, units: DataFrame, key: str = "code") -> DataFrame:
    """split, if it has the panel's rows, no unit of one set in a dyad of the other, and the same features for both ends."""
    if panel.count() != split.count():
        raise PipelineError("the splits do not add up to the panel")
    for role in ("orig", "dest"):
        of = units.select(F.col(key).alias(role), F.col("split").alias("_unit"))
        if not split.where("split <> 'inference'").join(of, role).where("split <> _unit").isEmpty():
            raise PipelineError(f"a unit of one set is {role} in a dyad of the other")
    ends = [{c.removeprefix(p) for c in split.columns if c.startswith(p)} for p in ("src_", "dst_")]
    if ends[0] != ends[1]:
        raise PipelineError(f"features of one end alone: {sorted(ends[0] ^ ends[1])}")
    return split


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Column i = 0, 1, ..., in the order of these columns: rows are dealt by range and numbered from the ranges' sizes."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn("i", F.col("_at") - F.col("_first") + F.col("_start")).drop("_part", "_at", "_first", "_start")


def duplicate_negatives(rows: DataFrame, y: str, order: list[str], rate: float = 0.3, seed: int = 7) -> DataFrame:
    """rows and floor(rate * n) of them drawn with replacement whose y is 0; which are drawn follows from the seed."""
    n = rows.count()
    # drawing k is a hash of k, so the same rows are drawn however the table is dealt out
    drawn = rows.sparkSession.range(int(rate * n)).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, n))).alias("i"))
    zero = numbered(rows, order).join(drawn, "i").drop("i").withColumn(y, F.lit(0).cast(dict(rows.dtypes)[y]))
    return rows.unionByName(zero.select(rows.columns))


def absent_pairs_by_origin(known: DataFrame, units: DataFrame, key: str = "code", block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """((a, orig, first, absent, shifts), numbered units (i, key)), written: pairs of different units that known lacks, counted and ranked by origin, then destination.

    shifts has, for each number of the origin's own or a known destination in order, that number less its place: the r-th absent destination is r plus
    how many shifts are at most r.
    """
    placed = written(numbered(units.select(key).where(F.col(key).isNotNull()).distinct(), [key]))
    a = placed.select(F.col("i").alias("a"), F.col(key).alias("orig"))
    pairs = known.select("orig", "dest").where("orig <> dest").distinct().join(a, "orig").join(placed.select(F.col("i").alias("b"), F.col(key).alias("dest")), "dest")
    taken = pairs.groupBy("a").agg(F.collect_set("b").alias("b"))  # at most the number of units
    own = a.join(taken, "a", "left").withColumn("b", F.array_sort(F.array_union(F.array("a"), F.coalesce("b", F.array().cast("array<long>")))))
    m = placed.count()
    counted = own.select("a", "orig", (F.lit(m) - F.size("b")).cast("long").alias("absent"), F.transform("b", lambda x, i: x - i).alias("shifts"), F.floor(F.col("a") / block).alias("_block"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.groupBy("_block").agg(F.sum("absent").alias("_n")).select("_block", F.coalesce(F.sum("_n").over(before(Window.orderBy("_block"))), F.lit(0)).alias("_first"))  # a row for each block
    first = F.col("_first") + F.coalesce(F.sum("absent").over(before(Window.partitionBy("_block").orderBy("a"))), F.lit(0))
    return written(counted.join(F.broadcast(totals), "_block").select("a", "orig", first.alias("first"), "absent", "shifts")), placed


def unseen_pair_negatives(known: DataFrame, units: DataFrame, n: int, edge_features: list[str], y: str, key: str = "code", seed: int = 7, at_most: bool = False) -> DataFrame:
    """n different ordered pairs of different units that are not in known, with y and the edge features 0; fewer absent pairs than n raise, or with at_most are all given.

    The absent pairs are ranked by origin and destination and cut into n stretches that differ by one at most; each gives one pair, whose place in the stretch follows from the stretch's number and the seed.
    An empty stretch gives none.
    """
    spark = known.sparkSession
    origins, placed = absent_pairs_by_origin(known, units, key)
    total = origins.agg(F.coalesce(F.sum("absent"), F.lit(0))).head()[0]
    if total < n and not at_most:
        raise PipelineError(f"{n} pairs are wanted, but {total} are absent")
    start, end = (F.expr(f"CAST((CAST(id AS DECIMAL(20, 0)) + {d}) * {total} DIV {max(1, n)} AS BIGINT)") for d in (0, 1))
    # the remainder by an empty stretch is null, and so no rank
    drawn = spark.range(n).select((start + F.pmod(F.col("id") * 7919 + seed * 104729, F.nullif(end - start, F.lit(0)))).alias("rank")).where("rank IS NOT NULL")
    # an origin's ranks are a range: both sides are dealt to cells about as wide as the ranges are on average
    width = max(1, total // max(1, placed.count()))
    ranges = origins.where("absent > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("absent") - 1) / width))))
    met = drawn.withColumn("cell", F.floor(F.col("rank") / width)).join(ranges, "cell").where("rank >= first AND rank < first + absent")
    r = F.col("rank") - F.col("first")
    found = met.select("orig", (r + F.size(F.filter("shifts", lambda x: x <= r))).alias("i")).join(placed, "i")
    return found.select("orig", F.col(key).alias("dest"), F.lit(0.0).alias(y), *[F.lit(0.0).alias(e) for e in edge_features])


def anti_known_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    return pairs.join(known.select("orig", "dest").distinct(), ["orig", "dest"], "left_anti")


def node_frame(rows: DataFrame, key: str = "code") -> DataFrame:
    """One row per unit from rows with src_ and dst_ columns: prefixes stripped, both ends under each other, the first by value of each unit."""
    ends = []
    for prefix in ("src_", "dst_"):
        own = [c for c in rows.columns if c.startswith(prefix)]
        ends.append(rows.select(*[F.col(c).alias(c.removeprefix(prefix)) for c in own]))
    both = ends[0].unionByName(ends[1])
    values = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.min(F.struct(*values)).alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in values])


def feature_group(columns: list[str], words: list[str]) -> list[str]:
    """The columns whose name holds one of the words; none raises."""
    own = [c for c in columns if any(w in c.lower() for w in words)]
    if not own:
        raise PipelineError(f"no feature for {', '.join(words)}")
    return own


def unique_keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in the order given; a row is reduced before it is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    least = F.min(F.struct(*order, F.struct(*rest).alias("_rest"))).alias("_first")
    return df.groupBy(*keys).agg(least).select(*keys, *[F.col(f"_first._rest.{c}").alias(c) for c in rest])


def node_index(units: DataFrame, key: str = "code") -> DataFrame:
    """(key, idx): units numbered from 0 in the order of their codes."""
    return numbered(units.select(key).where(F.col(key).isNotNull()).distinct(), [key]).withColumnRenamed("i", "idx")


def map_to_node_idx(pairs: DataFrame, index: DataFrame, key: str = "code") -> DataFrame:
    """pairs with src_idx and dst_idx; a code that is no unit has none."""
    for role, name in (("orig", "src_idx"), ("dest", "dst_idx")):
        pairs = pairs.join(index.select(F.col(key).alias(role), F.col("idx").alias(name)), role, "left")
    return pairs


def inner_join_features(flows: DataFrame, features: DataFrame, points: DataFrame, key: str = "code") -> DataFrame:
    """Units that have a flow, features and a point; none at all raises."""
    out = flows.join(features, key).join(points, key)
    if out.isEmpty():
        raise PipelineError("no unit has flow, features and point")
    return out


def null_gate(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).head()
    if wrong := {c: counts[c] for c in columns if counts[c]}:
        raise PipelineError(f"nulls: {wrong}")
    return df


#: The smallest single-precision number: fixed value.
FLOAT_MIN = -3.4028234663852886e38


def null_sentinel_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls as the smallest single-precision number, which trees part from all values."""
    return df.na.fill(FLOAT_MIN, columns)


def top_edges(flows: DataFrame, points: DataFrame, n: int, flow: str = "migrants", key: str = "code") -> DataFrame:
    """The n largest flows off the diagonal with a weight of 0 to 1 and the points of both ends."""
    top = flows.where("orig <> dest").orderBy(F.desc(flow), "orig", "dest").limit(n)
    span = top.agg(F.min(flow).alias("_low"), F.max(flow).alias("_high"))
    weight = F.when(F.col("_high") > F.col("_low"), (F.col(flow) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(1.0)
    out = top.join(F.broadcast(span)).select("orig", "dest", flow, weight.alias("weight"))
    for role in ("orig", "dest"):
        out = out.join(points.select(F.col(key).alias(role), *[F.col(c).alias(f"{c}_{role}") for c in ("lat", "lon")]), role, "left")
    return out


def permuted(units: DataFrame, key: str, column: str, seed: int) -> DataFrame:
    """units with the values of one column dealt out anew, each once, in an order that a hash of code and seed gives."""
    named = units.select(key, column).withColumn("_h", F.xxhash64(F.col(key).cast("string"), F.lit(seed)))
    given = numbered(named.select(column, F.col("_h"), F.col(key).alias("_from")), ["_h", "_from"]).select("i", F.col(column).alias("_new"))
    taken = numbered(named.select(key), [key]).join(given, "i").select(key, F.col("_new").alias(column))
    return units.drop(column).join(taken, key)


def permuted_edges(pairs: DataFrame, column: str, seed: int) -> DataFrame:
    """pairs (orig, dest, ...) with the values of one column dealt out anew among the pairs, each once."""
    pair = F.concat_ws("\u0001", "orig", "dest")
    return permuted(pairs.withColumn("_pair", pair), "_pair", column, seed).select(pairs.columns)


def edge_permutation_importance(score: Callable[[DataFrame], DataFrame], pairs: DataFrame, columns: list[str], seed: int = 7) -> DataFrame:
    """(feature, importance): how far the common part of commuters falls when a feature of pairs is permuted among the pairs; score takes the pairs to rows (y, p)."""
    cpc = lambda rows: flow_metrics(rows, "y", "p").select("cpc")
    base = cpc(score(pairs)).withColumnRenamed("cpc", "_base")
    rows = [cpc(score(permuted_edges(pairs, c, seed))).join(F.broadcast(base)).select(F.lit(c).alias("feature"), (F.col("_base") - F.col("cpc")).alias("importance")) for c in columns]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out.orderBy(F.desc("importance"), "feature")


def permutation_importance(score: Callable[[DataFrame], DataFrame], units: DataFrame, key: str, columns: list[str], by: list[str] | None = None, seed: int = 7) -> DataFrame:
    """(by, feature, importance): how far the common part of commuters falls when a unit feature is permuted among the units.

    score takes the unit table to rows (by, y, p) of observed and predicted flows.
    """
    by = by or []
    cpc = lambda rows: flow_metrics(rows, "y", "p", *by).select(*by, "cpc")
    base = cpc(score(units)).withColumnRenamed("cpc", "_base")
    out = None
    for c in columns:
        moved = cpc(score(permuted(units, key, c, seed)))
        row = (moved.join(base, by) if by else moved.join(F.broadcast(base))).select(*by, F.lit(c).alias("feature"), (F.col("_base") - F.col("cpc")).alias("importance"))
        out = row if out is None else out.unionByName(row)
    return out.orderBy(*by, F.desc("importance"), "feature")
