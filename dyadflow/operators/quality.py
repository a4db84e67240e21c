"""Data quality: missing values, summaries, agreement of sources, bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadflow.errors import DecisionRequired, PipelineError
from dyadflow.operators.order import quantiles_by
from dyadflow.sources.tables import written


def missingness(df: DataFrame) -> DataFrame:
    """(column, n_missing, pct), one pass over the table."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in df.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), (F.col("_n") - F.col(c)).alias("n_missing"), (100.0 * (F.col("_n") - F.col(c)) / F.col("_n")).alias("pct")) for c in df.columns])
    return counts.select(F.inline(cells))


def typed_missingness(df: DataFrame) -> DataFrame:
    """missingness with each column's type, the worst first."""
    types = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return missingness(df).withColumn("type", types[F.col("column")]).orderBy(F.desc("pct"), "column")


def value_positions(df: DataFrame, value: str) -> DataFrame:
    """(value, n, below): each different value with its number of rows and that of the rows below it.

    Values are dealt into ranges, as many as shuffles have partitions; a range's first position comes from the ranges' totals, which are few.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    placed = written(counted.repartitionByRange("value").withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = placed.groupBy("_range").agg(F.sum("n").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(totals), "_range").select("value", "n", (F.col("_first") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("below"))


def exact_quantiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(share, quantile), interpolated between neighbours; see order.py."""
    return quantiles_by(df, value, shares)


def summary(df: DataFrame, value: str) -> DataFrame:
    x = F.col(value)
    names = {"p25": 0.25, "mid": 0.5, "p75": 0.75}
    at = exact_quantiles(df, value, list(names.values())).agg(*[F.max(F.when(F.col("share") == q, F.col("quantile"))).alias(name) for name, q in names.items()])
    return df.agg(F.count(x).alias("n"), F.min(x).alias("low"), F.avg(x).alias("mean"), F.max(x).alias("high"), F.sum(x).alias("total")).join(F.broadcast(at)).select("n", "low", "p25", "mid", "mean", "p75", "high", "total")


def value_counts(df: DataFrame, name: str) -> DataFrame:
    counted = df.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(counted.agg(F.sum("n").alias("_all")))).select(name, "n", (100.0 * F.col("n") / F.col("_all")).alias("pct"))


def average_ranks(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, rank): ties share their mean rank. Ranks are read off value_positions, so no task sees all values."""
    ranks = value_positions(df, value).select(F.col("value").alias(value), (F.col("below") + (F.col("n") + 1) / 2).alias("rank"))
    return df.join(ranks, value).select(key, "rank")


def source_agreement(df: DataFrame, key: str, a: str, b: str, least: int = 30) -> DataFrame:
    """How two sources of a value agree where both are positive: n, correlations, median ratio."""
    both = written(df.where((F.col(a) > 0) & (F.col(b) > 0)).select(key, a, b))
    ranks = average_ranks(both, key, a).withColumnRenamed("rank", "_ra").join(average_ranks(both, key, b).withColumnRenamed("rank", "_rb"), key)
    found = both.join(ranks, key).agg(F.count(F.lit(1)).alias("n"), F.corr(F.ln(a), F.ln(b)).alias("r_log"), F.corr(a, b).alias("r_level"), F.corr("_ra", "_rb").alias("spearman"))
    median = exact_quantiles(both.select((F.col(a) / F.col(b)).alias("ratio")), "ratio", [0.5]).agg(F.max("quantile").alias("median_ratio"))
    found = found.join(F.broadcast(median))
    return found.withColumn("n", F.when(F.col("n") < least, F.raise_error(F.lit(f"fewer than {least} units in both sources")).cast("long")).otherwise(F.col("n")))


def bands(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    name = F.when(F.col(value) < low, "below").when(F.col(value) < high, "between").when(F.col(value) >= high, "above").otherwise("missing")
    return df.groupBy(name.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def require_total(df: DataFrame, value: str, expected: float | None, tolerance: float) -> str:
    """'not run' without an expected total; raises beyond the tolerance."""
    if expected is None:
        return "not run"
    total = df.agg(F.sum(value)).head()[0] or 0.0
    if abs(total - expected) > tolerance * abs(expected):
        raise PipelineError(f"total {total} is not {expected}")
    return "passed"


def require_agreement(agreement: DataFrame, threshold: float, column: str = "r_log") -> float:
    """The correlation of two sources, if it reaches the threshold; else someone has to decide which to take."""
    r = agreement.head()[column]
    if r is None or r < threshold:
        raise DecisionRequired(f"{column} is {r}, below {threshold}: state which source to take")
    return r


def require_plausible_total(df: DataFrame, value: str, low: float, high: float) -> float:
    total = df.agg(F.sum(value)).head()[0] or 0.0
    if not low <= total <= high:
        raise PipelineError(f"total {total} is not within {low} and {high}")
    return total


def weighting_delta(df: DataFrame, weighted: str, plain: str) -> DataFrame:
    gap = F.abs(F.col(weighted) - F.col(plain))
    return df.agg(F.avg(gap).alias("mean_delta"), F.max(gap).alias("max_delta"), F.count(gap).alias("n"))


def flow_totals_by_source(panel: DataFrame, flow: str, features: list[str]) -> DataFrame:
    """(orig, outflow, destinations, mean of each feature)."""
    return panel.groupBy("orig").agg(F.sum(flow).alias("outflow"), F.count_if(F.col(flow) > 0).alias("destinations"), *[F.avg(f).alias(f) for f in features])


def node_mean_residual(units: DataFrame, predictions: DataFrame, y: str, p: str, key: str = "code") -> DataFrame:
    """Every unit with the mean of p - y over its outgoing flows and whether it has any."""
    found = predictions.groupBy(F.col("orig").alias(key)).agg(F.avg(F.col(p) - F.col(y)).alias("residual"))
    return units.select(key).join(found, key, "left").withColumn("present", F.col("residual").isNotNull())


def column_mean_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    return df.join(F.broadcast(means)).withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in columns}).select(df.columns)


def group_mean_fill(df: DataFrame, group: Column, columns: dict[str, float]) -> DataFrame:
    """Nulls become the mean of the row's group, and the constant given for a column where the whole group is null."""
    means = df.groupBy(group.alias("_g")).agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    filled = df.withColumn("_g", group).join(means, "_g", "left")
    return filled.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}"), F.lit(float(v))) for c, v in columns.items()}).select(df.columns)


def quantile_classes(df: DataFrame, key: str, value: str, classes: int = 5) -> DataFrame:
    """(key, value, class 0 .. classes - 1): quantile classes of a map, closed on the right; missing values have none."""
    cuts = sorted(r["quantile"] for r in exact_quantiles(df, value, [i / classes for i in range(1, classes)]).collect())
    below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(value))) if cuts else F.lit(0)
    return df.select(key, value, F.when(F.col(value).isNotNull(), below).alias("class"))


def rank_importance(importances: dict[str, float], spark) -> DataFrame:
    """(feature, importance), the largest first."""
    return spark.createDataFrame(sorted(((k, float(v)) for k, v in importances.items()), key=lambda x: (-x[1], x[0])), "feature string, importance double")


def code_set_equality(a: DataFrame, b: DataFrame, code: str = "code") -> DataFrame:
    """a's codes, if b has the same."""
    one, two = (x.select(code).where(F.col(code).isNotNull()).distinct() for x in (a, b))
    if not one.join(two, code, "left_anti").isEmpty() or not two.join(one, code, "left_anti").isEmpty():
        raise PipelineError("the two sets of codes differ")
    return one


def coverage_gate(catalogue: DataFrame, values: DataFrame, code: str, value: str, least: float = 0.95) -> tuple[float, DataFrame]:
    """(share of the catalogue's units with a value, the units without); a share below `least` raises."""
    known = values.where(F.col(value).isNotNull()).select(code).distinct()
    absent = catalogue.select(code).distinct().join(known, code, "left_anti")
    n, lacking = catalogue.select(code).distinct().count(), absent.count()
    share = (n - lacking) / n if n else 0.0
    if share < least:
        raise PipelineError(f"only {share:.3f} of the units have {value}")
    return share, absent


def rows_in_out(steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """(step, rows_in, rows_out, delta) of tables that follow each other, each counted once."""
    sizes = [(i, name, df.agg(F.count(F.lit(1)).alias("rows_out"))) for i, (name, df) in enumerate(steps)]
    rows = None
    for i, name, counted in sizes:
        row = counted.select(F.lit(i).alias("_i"), F.lit(name).alias("step"), "rows_out")
        rows = row if rows is None else rows.unionByName(row)
    before = F.lag("rows_out").over(Window.orderBy("_i"))  # a row for each step
    return rows.select("_i", "step", before.alias("rows_in"), "rows_out", (F.col("rows_out") - before).alias("delta")).orderBy("_i").drop("_i")


def validation_report(panel: DataFrame) -> DataFrame:
    """(check, value, passed): uniqueness, diagonal, negatives, positive share of the whole panel and missing cells."""
    pairs = panel.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("orig", "dest").alias("pairs"), F.count_if(F.col("orig") == F.col("dest")).alias("diagonal"), F.count_if(F.col("migrants") < 0).alias("negative"), F.count_if(F.col("migrants") > 0).alias("positive"), sum((F.count_if(F.col(c).isNull()) for c in panel.columns), F.lit(0)).alias("missing"))
    number = lambda c: F.col(c).cast("double")
    checks = [("rows", number("n"), F.lit(None).cast("boolean")), ("repeated_pairs", number("n") - F.col("pairs"), F.col("n") == F.col("pairs")), ("diagonal", number("diagonal"), F.col("diagonal") == 0), ("negative", number("negative"), F.col("negative") == 0), ("positive_pct", 100.0 * F.col("positive") / F.col("n"), F.col("positive") > 0), ("missing_cells", number("missing"), F.lit(None).cast("boolean"))]
    return pairs.select(F.inline(F.array(*[F.struct(F.lit(name).alias("check"), value.alias("value"), ok.alias("passed")) for name, value, ok in checks])))


def codebook(panel: DataFrame, spec: DataFrame, limitations: dict[str, str] | None = None) -> DataFrame:
    """One row per column: spec (column, definition, units, source, vintage, construction) with type and missing values.

    A column that spec does not describe raises; `limitations` adds what a choice made in the build means for a column.
    """
    described = spec.select("column").distinct()
    names = panel.sparkSession.createDataFrame([(c,) for c in panel.columns], "column string")
    if lacking := [r[0] for r in names.join(described, "column", "left_anti").collect()]:
        raise PipelineError(f"not in the codebook: {', '.join(sorted(lacking))}")
    notes = F.create_map(*[F.lit(x) for pair in (limitations or {"": ""}).items() for x in pair])
    return typed_missingness(panel).join(spec, "column").withColumn("limitation", notes[F.col("column")])
