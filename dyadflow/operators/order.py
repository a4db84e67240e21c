"""Exact order statistics of any number of groups by refined histograms: no sort of the table, no buffer of a group's values.

Each pass counts the values of the cells that still hold a wanted rank, cut into `cells` parts between the least and the greatest value that were seen there: by
magnitude in the first pass, as values may span many of them, then evenly. Counts combine before they are shuffled. A cell with one value, or with at most `few` rows, which are gathered, is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from dyadflow.operators.panel import BROADCAST_CODES
from dyadflow.sources.tables import written


def order_statistics(df: DataFrame, value: str, ranks: DataFrame, by: list[str] | None = None, cells: int = 256, few: int = 10_000) -> DataFrame:
    """(by, rank, value): the values at the wanted ranks (by, rank from 0) of each group's non-null values in order; a rank beyond a group has none.

    Groups with a null key have none.
    """
    by = by or []
    rows = written(values(df, value, by))
    wanted = ranks.groupBy(*by).agg(F.array_sort(F.collect_set(F.col("rank").cast("long"))).alias("ranks"))
    ends = extent(rows, by)
    return refined(rows, (ends.join(wanted, by) if by else ends.crossJoin(wanted)), value, by, cells, few)


def values(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))


def extent(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, low, high, unit): unit is the least magnitude that is not 0."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.min(F.when(F.col("_v") != 0, F.abs("_v"))).alias("unit"))


def refined(rows: DataFrame, live: DataFrame, value: str, by: list[str], cells: int, few: int) -> DataFrame:
    """The ranks of live (by, n, low, high, unit, ranks), pass by pass."""
    keys = [F.col(b) for b in by]
    live = live.select(*by, "low", "high", "unit", "n", F.lit(0).cast("long").alias("below"), F.filter("ranks", lambda x: (x >= 0) & (x < F.col("n"))).alias("ranks"))
    magnitude = lambda c: F.signum(c) * F.when(F.col(c) != 0, 1 + F.ln(F.abs(c)) - F.ln("unit")).otherwise(0.0)
    out, first = None, True
    while True:
        sizes = Observation()
        counted = F.count_if(F.expr(f"low < high AND n <= {few}")).alias("small"), F.count_if(F.expr(f"low < high AND n > {few}")).alias("large")
        live = written(live.where(F.size("ranks") > 0).observe(sizes, *counted))
        even = live.where("low = high").select(*by, F.explode("ranks").alias("rank"), F.col("low").alias(value))
        out = even if out is None else out.unionByName(even)
        if sizes.get["small"]:
            gathered = within(rows, live.where(f"low < high AND n <= {few}"), by).groupBy(*by, "low").agg(F.first(F.struct("below", "ranks")).alias("c"), F.array_sort(F.collect_list("_v")).alias("v"))
            out = out.unionByName(gathered.select(*keys, F.explode("c.ranks").alias("rank"), "c.below", "v").select(*keys, "rank", F.element_at("v", (F.col("rank") - F.col("below") + 1).cast("int")).alias(value)))
        if not sizes.get["large"]:
            return out
        # halves first, as the difference of two large numbers may overflow
        part = (F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        if first:
            span = magnitude("high") - magnitude("low")
            part, first = F.when(span > 0, (magnitude("_v") - magnitude("low")) / span).otherwise(part), False
        placed = within(rows, live.where(f"low < high AND n > {few}"), by).withColumn("cell", F.least(F.floor(part * cells), F.lit(cells - 1)))
        counts = placed.groupBy(*by, "low", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.first(F.struct("below", "ranks", "unit")).alias("c"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "low").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most `cells` rows
        at = counts.withColumn("below", F.col("c.below") + before)
        live = at.select(*by, F.col("least").alias("low"), F.col("most").alias("high"), F.col("c.unit").alias("unit"), "n", "below", F.filter("c.ranks", lambda x: (x >= F.col("below")) & (x < F.col("below") + F.col("n"))).alias("ranks"))


def within(rows: DataFrame, live: DataFrame, by: list[str]) -> DataFrame:
    """Rows that lie in a live cell of their group, with the cell; a row finds its cell in the group's list, as cells lie apart."""
    lists = live.groupBy(*by).agg(F.collect_list(F.struct("low", "high", "unit", "below", "ranks")).alias("_cells"))
    if by:
        met = rows.join(F.broadcast(lists) if lists.count() <= BROADCAST_CODES else lists, by)
    else:
        met = rows.join(F.broadcast(lists))
    own = F.filter("_cells", lambda c: (c["low"] <= F.col("_v")) & (F.col("_v") <= c["high"]))
    return met.select(*by, "_v", F.explode(own).alias("_c")).select(*by, "_v", "_c.*")


def quantiles_by(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None, cells: int = 256, few: int = 10_000) -> DataFrame:
    """(by, share, quantile) of each group, interpolated between neighbours; a group without a value has none."""
    by = by or []
    rows = written(values(df, value, by))
    ends = written(extent(rows, by).where("n > 0"))
    at = lambda f: F.array(*[f(F.lit(float(x)) * (F.col("n") - 1)).cast("long") for x in shares])
    found = refined(rows, ends.withColumn("ranks", F.array_sort(F.array_union(at(F.floor), at(F.ceil)))), value, by, cells, few)
    # each share takes one value or two, by its place between them
    asked = ends.select(*by, "n", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")).withColumn("_at", F.col("share") * (F.col("n") - 1))
    needed = asked.select(*by, "share", "_at", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("rank"))
    low, high = (f(F.struct("rank", F.col(value).alias("v")))["v"] for f in (F.min, F.max))
    return needed.join(found, [*by, "rank"]).groupBy(*by, "share", "_at").agg(low.alias("_a"), high.alias("_b")).select(*by, "share", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))).alias("quantile"))
