"""Routing of records to one counted bucket, and weighted flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dyadflow.errors import PipelineError


def classify(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds; a null condition does not hold."""
    out = F.lit(otherwise)
    for name, holds in reversed(rules):
        out = F.when(holds, name).otherwise(out)
    return out


def reconcile(records: DataFrame, bucket: str = "bucket", weight: str = "w") -> DataFrame:
    """(bucket, records, weighted, pct): every record is in exactly one row's count."""
    counted = records.groupBy(bucket).agg(F.count(F.lit(1)).alias("records"), F.sum(weight).alias("weighted"))
    total = counted.agg(F.sum("records").alias("total"))
    return counted.join(F.broadcast(total)).select(bucket, "records", "weighted", (100.0 * F.col("records") / F.col("total")).alias("pct"))


def aggregate_od(records: DataFrame, weight: str = "w") -> DataFrame:
    """Weighted and plain counts of (orig, dest); null codes are groups too."""
    return records.groupBy("orig", "dest").agg(F.sum(weight).alias("migrants"), F.count(F.lit(1)).alias("migrants_unweighted"))


def fold_diagonal(flows: DataFrame, stayers: DataFrame) -> DataFrame:
    """Adds those who stayed (dest, migrants, migrants_unweighted) to the diagonal."""
    own = stayers.select(F.col("dest").alias("orig"), "dest", "migrants", "migrants_unweighted")
    return flows.unionByName(own).groupBy("orig", "dest").agg(F.sum("migrants").alias("migrants"), F.sum("migrants_unweighted").alias("migrants_unweighted"))


def split_diagonal(flows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return flows.where("orig = dest"), flows.where("orig <> dest")


def require_full_count(flows: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    gap = flows.agg(F.max(F.abs(F.col("migrants") - F.col("migrants_unweighted")))).head()[0] or 0.0
    if gap > tolerance:
        raise PipelineError(f"weights differ from one by up to {gap} in a full count")
    return flows


def is_sentinel(field: Column, codes: list[str], width: int) -> Column:
    """Whether a field is one of the codes, as it stands or padded with zeros to `width`."""
    raw = F.trim(field)
    return raw.isin(codes) | F.lpad(raw, width, "0").isin([c.rjust(width, "0") for c in codes])


def classify_origin(age: Column, state: Column, unit: Column, *, least_age: int = 5, not_specified: tuple[list[str], list[str]], foreign_from: int, non_migrant: list[str]) -> Column:
    """under_age, not_specified, foreign, non_migrant or domestic, the first that fits.

    not_specified has the sentinels of the state and of the unit field; a state number of foreign_from or more is abroad.
    The order carries meaning: a sentinel such as 99 would pass for a foreign number, so it is asked first.
    """
    blank = state.isNull() | (F.trim(state) == "")
    rules = [
        ("under_age", age < least_age),
        ("not_specified", is_sentinel(state, not_specified[0], 2) | is_sentinel(unit, not_specified[1], 3)),
        ("foreign", F.trim(state).try_cast("int") >= foreign_from),
        ("non_migrant", blank | is_sentinel(state, non_migrant, 2)),
    ]
    return classify(rules, "domestic")


def rebucket_unparseable(records: DataFrame, bucket: str = "bucket", orig: str = "orig", dest: str = "dest") -> DataFrame:
    """Domestic records without a readable origin become unparseable_code; an unreadable destination raises when the row is read."""
    named = F.when((F.col(bucket) == "domestic") & F.col(orig).isNull(), "unparseable_code").otherwise(F.col(bucket))
    given = F.when(F.col(dest).isNull(), F.raise_error(F.lit("unparseable destination")).cast("string")).otherwise(F.col(dest))
    return records.withColumns({bucket: named, dest: given})


def non_empty(df: DataFrame, problem: str) -> DataFrame:
    if df.isEmpty():
        raise PipelineError(problem)
    return df


def total_rows_only(df: DataFrame, part: str, width: int = 4) -> DataFrame:
    """The rows that stand for the whole unit: part zero, padded to `width`."""
    return non_empty(df.where(F.lpad(F.trim(F.col(part).cast("string")), width, "0") == "0" * width), f"no row with {part} zero")


def drop_aggregate_codes(df: DataFrame, code: str) -> DataFrame:
    """Without national and state totals, whose codes end in 000, and without null codes."""
    return df.where(F.col(code).isNotNull() & ~F.col(code).endswith("000"))


def filter_year(df: DataFrame, column: str, year: int) -> DataFrame:
    kept = df.where(F.col(column).cast("string").try_cast("double") == year)
    if kept.isEmpty():
        # years of a table are few
        seen = sorted(str(r[0]) for r in df.select(column).distinct().limit(50).collect())
        raise PipelineError(f"no row of {year}; there are {', '.join(seen)}")
    return kept


def drop_age_sentinels(df: DataFrame, age: str, most: int = 130) -> DataFrame:
    return df.where((F.col(age) <= most) | F.col(age).isNull())


def dropna_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with all keys, one row with how many were dropped and kept)."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return df.where(whole), df.agg(F.count_if(~whole).alias("dropped"), F.count_if(whole).alias("kept"))


def range_flags(df: DataFrame, code: str, bounds: dict[str, tuple[float, float]], samples: int = 5) -> DataFrame:
    """(column, low, high, n_outside, smallest codes outside) for each column; nothing is clipped."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high"), F.col(c).cast("double").alias("v")) for c, (a, b) in bounds.items()])
    long = df.select(F.col(code).alias("_code"), F.inline(rows)).withColumn("out", (F.col("v") < F.col("low")) | (F.col("v") > F.col("high")))
    counted = long.groupBy("column", "low", "high").agg(F.count_if("out").alias("n_outside"))
    # the first few codes only, by a ranked window that Spark cuts before it shuffles
    first = long.where("out").select("column", "_code").distinct().withColumn("i", F.row_number().over(Window.partitionBy("column").orderBy("_code"))).where(F.col("i") <= samples)
    return counted.join(first.groupBy("column").agg(F.sort_array(F.collect_list("_code")).alias("codes")), "column", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))


def bbox_guard(points: DataFrame, box: tuple[float, float, float, float], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """points, if all lie in the box (west, south, east, north)."""
    west, south, east, north = box
    out = points.agg(F.count_if(~F.col(lon).between(west, east) | ~F.col(lat).between(south, north)).alias("n")).head()["n"]
    if out:
        raise PipelineError(f"{out} points outside the box")
    return points


def select_excluded(records: DataFrame, buckets: list[str], weight: str = "w") -> DataFrame:
    """Flows of the buckets that the panel leaves out, by bucket and destination."""
    kept = records.where(F.col("bucket").isin(buckets))
    return kept.groupBy("bucket", "dest").agg(F.sum(weight).alias("migrants"), F.count(F.lit(1)).alias("migrants_unweighted"))


def record_weights(records: DataFrame, full_count: bool, factor: str = "factor") -> DataFrame:
    """Column w: one for each record of a full count, else its factor; one that is no number raises when the row is read."""
    if full_count:
        return records.withColumn("w", F.lit(1.0))
    number = F.trim(F.col(factor).cast("string")).try_cast("double")
    return records.withColumn("w", F.coalesce(number, F.raise_error(F.lit("factor is not a number")).cast("double")))
