"""Boundary changes and unit tables: crosswalks, folds, bands, months, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadflow.errors import PipelineError


def validate_crosswalk(xwalk: DataFrame, width: int = 5) -> DataFrame:
    """A crosswalk (child, parent) of codes of `width` characters in which no code is both and no child has two parents."""
    if lacking := {"child", "parent"} - set(xwalk.columns):
        raise PipelineError(f"crosswalk without {', '.join(sorted(lacking))}")
    wrong = lambda c: F.coalesce(F.length(c) != width, F.lit(True))
    if n := xwalk.agg(F.count_if(wrong("child") | wrong("parent")).alias("n")).head()["n"]:
        raise PipelineError(f"{n} rows whose codes are not of {width} characters")
    chained = xwalk.join(xwalk.select(F.col("parent").alias("child")).distinct(), "child", "left_semi")
    if chained.limit(1).count():
        raise PipelineError("chained splits")
    if xwalk.groupBy("child").count().where("count > 1").limit(1).count():
        raise PipelineError("a child has two parents")
    return xwalk


def unverified(xwalk: DataFrame) -> int:
    return xwalk.where(~F.coalesce("verified", F.lit(False))).count()


def crosswalk_hits(df: DataFrame, code: str, xwalk: DataFrame) -> DataFrame:
    """(parent, n): how many rows each parent takes in from its children."""
    return df.join(xwalk.select(F.col("child").alias(code), "parent"), code).groupBy("parent").agg(F.count(F.lit(1)).alias("n"))


def apply_crosswalk(df: DataFrame, code: str, xwalk: DataFrame, strategy: str = "fold") -> DataFrame:
    """Child codes become their parent's; others and nulls pass. Spark broadcasts the crosswalk where its size allows.

    Strategy "none" leaves all as it is; to allocate parents to children needs shares that no table has.
    """
    if strategy == "none":
        return df
    if strategy == "allocate":
        raise NotImplementedError("no shares to allocate by")
    if strategy != "fold":
        raise PipelineError(f"no crosswalk strategy {strategy}")
    step = xwalk.select(F.col("child").alias(code), F.col("parent").alias("_parent"))
    return df.join(step, code, "left").withColumn(code, F.coalesce("_parent", code)).drop("_parent").select(df.columns)


def fold_extensive(df: DataFrame, key: str, *values: str) -> DataFrame:
    """Sums; a group of nulls alone stays null."""
    return df.groupBy(key).agg(*[F.sum(v).alias(v) for v in values])


def fold_intensive(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Weighted means of members that have a value; plain means for a group in which one of these lacks its weight."""
    known = F.col(value).isNotNull()
    lacking = F.max(known & F.col(weight).isNull())
    weighted = F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(F.when(known, F.col(weight))), F.lit(0.0))
    return df.groupBy(key).agg(F.when(lacking, F.avg(value)).otherwise(F.coalesce(weighted, F.avg(value))).alias(value), (F.count(F.lit(1)) > 1).alias("folded"))


def fold_income(df: DataFrame, key: str, value: str, weight: str, uncertainty: list[str], source: str) -> DataFrame:
    """fold_intensive with its provenance: where units were folded the uncertainty is null and the source says harmonized."""
    rest = df.groupBy(key).agg(*[F.first(u).alias(u) for u in uncertainty], F.max(source).alias("_source"))
    out = fold_intensive(df, key, value, weight).join(rest, key)
    alone = {u: F.when(~F.col("folded"), F.col(u)) for u in uncertainty}
    return out.withColumns({**alone, source: F.when(F.col("folded"), F.concat("_source", F.lit("_harmonized"))).otherwise(F.col("_source"))}).select(key, value, *uncertainty, source)


def collapse_dimension(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sums over what the keys leave out; unlike fold_extensive a group of nulls alone is 0."""
    return df.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0)).alias(value))


def tiling_bands(columns: dict[str, tuple[int, int]], low: int, high: int) -> list[str] | None:
    """The columns, given with their first and last age, that tile low..high without gap or overlap; None if they cannot."""
    out, at = [], low
    starts = {a: (b, name) for name, (a, b) in columns.items()}
    while at <= high:
        if at not in starts or starts[at][0] > high:
            return None
        out.append(starts[at][1])
        at = starts[at][0] + 1
    return out


def banded_share(df: DataFrame, key: str, columns: dict[str, tuple[int, int]], part: tuple[int, int], whole: tuple[int, int], published: str | None = None, tolerance: float = 0.01) -> DataFrame | None:
    """(key, part, whole, share) from columns of age bands, nulls and non-numbers as 0; None where they do not tile the ages.

    A published total of the whole has to agree over all rows within the tolerance.
    """
    bands = [tiling_bands(columns, *ages) for ages in (part, whole)]
    if not all(bands):
        return None
    number = lambda c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0))
    a, b = (sum((number(c) for c in names), F.lit(0.0)) for names in bands)
    out = df.select(key, a.alias("part"), b.alias("whole"), *([number(published).alias("_published")] if published else []))
    if published:
        sums = out.agg(F.sum("whole").alias("ours"), F.sum("_published").alias("theirs")).head()
        if abs((sums["ours"] or 0) - (sums["theirs"] or 0)) > tolerance * (sums["theirs"] or 0):
            raise PipelineError(f"bands add up to {sums['ours']}, published are {sums['theirs']}")
        out = out.drop("_published")
    return out.withColumn("share", guarded_share(F.col("part"), F.col("whole")))


def guarded_share(part: Column, whole: Column) -> Column:
    """part / whole; null where whole is not positive; a share outside 0..1 raises when the row is read."""
    share = part / whole
    return F.when(whole > 0, F.when((share < 0) | (share > 1), F.raise_error(F.lit("share outside 0..1")).cast("double")).otherwise(share))


def weighted_ages(records: DataFrame, key: str, age: str, weight: str) -> DataFrame:
    return records.where(F.col(key).isNotNull() & F.col(age).isNotNull()).groupBy(key, age).agg(F.sum(weight).alias("n"))


def average_over_years(df: DataFrame, key: str, *values: str) -> DataFrame:
    """Means over years; null years are skipped, units of nulls alone stay null."""
    return df.groupBy(key).agg(*[F.avg(v).alias(v) for v in values])


def modal_method(df: DataFrame, key: str, method: str) -> DataFrame:
    """(key, method, n): the most frequent method, the smallest of those that tie."""
    counted = df.where(F.col(method).isNotNull()).groupBy(key, method).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("order"), F.col(method))).alias("m")).select(key, f"m.{method}", (-F.col("m.order")).alias("n"))


def canonical_alias(df: DataFrame, vintages: dict[int, str], year: int, name: str) -> DataFrame:
    """Column `name` from the vintage of a year; all vintages are there, those that the table lacks as nulls."""
    if year not in vintages:
        raise PipelineError(f"no vintage {year}; there are {sorted(vintages)}")
    for column in vintages.values():
        if column not in df.columns:
            df = df.withColumn(column, F.lit(None).cast("double"))
    return df.withColumn(name, F.col(vintages[year]))


def pivot_estimates(df: DataFrame, key: str, code: str, value: str, names: dict[int, str], point: str | None = None) -> DataFrame:
    """Long estimates to a column for each code; a code that is unknown or null raises, and so does a unit whose estimate `point` is missing or not positive."""
    cells = [F.min(F.when(F.col(code) == c, F.col(value))).alias(name) for c, name in names.items()]
    known = F.when(F.max(F.coalesce(~F.col(code).isin(*names), F.lit(True))), F.raise_error(F.lit("unknown estimate code")).cast("boolean"))
    wide = df.groupBy(key).agg(*cells, known.alias("_known")).where("_known IS NULL").drop("_known")
    if point is None:
        return wide
    at = lambda text: F.raise_error(F.concat(F.lit(f"{text} {point}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(dict(wide.dtypes)[point])
    return wide.withColumn(point, F.when(F.col(point).isNull() | F.isnan(F.col(point).cast("double")), at("no")).when(F.col(point) <= 0, at("not positive:")).otherwise(F.col(point)))


def annual_from_months(df: DataFrame, key: str, month: str, value: str) -> DataFrame:
    """(key, mean, sum, min, max, n_months, complete) over a unit's months; complete: twelve different months have a value."""
    n, months = F.count(value), F.size(F.collect_set(F.when(F.col(value).isNotNull(), F.col(month))))
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"), n.alias("n_months"), (months == 12).alias("complete"))


def band_share(df: DataFrame, key: str, age: str, count: str, low: int, high: int) -> DataFrame:
    """Share of the count whose age lies in low..high; null where the total is not positive, and a share outside 0..1 raises."""
    band = F.sum(F.when(F.col(age).between(low, high), F.col(count)).otherwise(0))
    return df.groupBy(key).agg(band.alias("band"), F.sum(count).alias("total")).withColumn("share", guarded_share(F.col("band"), F.col("total")))


def source_fallback(primary: Column, secondary: Column, name: str) -> list[Column]:
    """The value of the first source that is positive, and where it came from."""
    take = (primary.isNull() | (primary <= 0)) & (secondary > 0)
    value = F.when(take, secondary).otherwise(primary)
    return [value.alias(name), F.when(take, f"{name}_fallback").when(primary.isNull(), "missing").otherwise("primary").alias(f"{name}_source")]


def outer_with_indicator(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    side = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only")
    return a.join(b, key, "full_outer").withColumn("side", side).drop("_l", "_r")
