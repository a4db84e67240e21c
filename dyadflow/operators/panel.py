"""The dense panel: spine, audited joins, zero classes, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dyadflow.errors import PipelineError


#: A code is a few bytes, so this is some MB at most.
BROADCAST_CODES = 100_000


def build_spine(universe: DataFrame, code: str = "code", include_diagonal: bool = False) -> DataFrame:
    """Every ordered pair of distinct codes. The product is the panel itself: its size is the result's.

    One side is broadcast while there are at most BROADCAST_CODES codes.
    """
    codes = universe.select(code).where(F.col(code).isNotNull()).distinct()
    other = codes.select(F.col(code).alias("dest"))
    pairs = codes.select(F.col(code).alias("orig")).crossJoin(F.broadcast(other) if codes.count() <= BROADCAST_CODES else other)
    return pairs if include_diagonal else pairs.where("orig <> dest")


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise PipelineError(f"duplicate {', '.join(keys)}")
    return df


def audited_left_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A left join that cannot add rows: repeated keys on the right raise."""
    return left.join(assert_unique(right, *on), on, "left")


def join_audit(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """One row (n_left, n_matched, n_unmatched, n_right_unused) of what a left join would find."""
    marked = left.select(*on).withColumn("_l", F.lit(1)).join(assert_unique(right, *on).select(*on, F.lit(1).alias("_r")), on, "full_outer")
    both, l, r = F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.col("_l").isNotNull(), F.col("_r").isNotNull()
    return marked.agg(F.count_if(l).alias("n_left"), F.count_if(both).alias("n_matched"), F.count_if(l & ~r).alias("n_unmatched"), F.count_if(r & ~l).alias("n_right_unused"))


def observed_left_join(left: DataFrame, right: DataFrame, on: list[str], name: str = "join") -> tuple[DataFrame, Observation]:
    """(left join, what it found): n_left, n_matched and n_unmatched are counted while the join is computed, and are there after its first action.

    A key that the right side repeats raises when its row is computed, so the row count cannot change; neither costs a job of its own.
    """
    values = [c for c in right.columns if c not in on]
    once = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_copies"), F.first(F.struct(F.lit(1).alias("_one"), *values)).alias("_v"))
    text = F.concat_ws(", ", *[F.col(c).cast("string") for c in on])
    guarded = once.withColumn("_copies", F.when(F.col("_copies") > 1, F.raise_error(F.concat(F.lit(f"{name}: repeated key "), text)).cast("long")).otherwise(F.col("_copies")))
    seen = Observation(name)
    matched = F.col("_copies").isNotNull()
    joined = left.join(guarded, on, "left").observe(seen, F.count(F.lit(1)).alias("n_left"), F.count_if(matched).alias("n_matched"), F.count_if(~matched).alias("n_unmatched"))
    return joined.select(*left.columns, *[F.col(f"_v.{c}").alias(c) for c in values]), seen


class RowCounts:
    """Rows of the steps of a build, counted while they are computed: watch() each step, act, then report()."""

    def __init__(self):
        self.steps: list[tuple[str, Observation]] = []

    def watch(self, step: str, df: DataFrame) -> DataFrame:
        self.steps.append((step, seen := Observation(f"{len(self.steps)} {step}")))
        return df.observe(seen, F.count(F.lit(1)).alias("n"))

    def report(self, spark: SparkSession) -> DataFrame:
        """(step, rows_in, rows_out, delta), in the order of the steps; it waits for steps that no action has reached."""
        out = [(step, seen.get["n"]) for step, seen in self.steps]
        before = [None, *[n for _, n in out]]
        rows = [(step, b, n, None if b is None else n - b) for (step, n), b in zip(out, before, strict=False)]
        return spark.createDataFrame(rows, "step string, rows_in long, rows_out long, delta long")


def attach_flows(spine: DataFrame, flows: DataFrame) -> DataFrame:
    return audited_left_join(spine, flows, ["orig", "dest"]).fillna(0, ["migrants", "migrants_unweighted"])


def attach_both_roles(panel: DataFrame, units: DataFrame, key: str = "code") -> DataFrame:
    """The unit table joined for either role, its columns suffixed _orig and _dest."""
    values = [c for c in units.columns if c != key]
    assert_unique(units, key)
    for role in ("orig", "dest"):
        panel = panel.join(units.select(F.col(key).alias(role), *[F.col(c).alias(f"{c}_{role}") for c in values]), role, "left")
    return panel


def classify_zeros(panel: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """flow_observed and zero_class: observed, or a zero that sampling can explain (both ends are active), or likely a structural one.

    The active ends are read from flows, the sparse table that the panel was filled from, so that the panel is not computed thrice.
    """
    seen = (panel if flows is None else flows).where("migrants_unweighted > 0")
    senders = seen.select("orig", F.lit(True).alias("_sends")).distinct()
    takers = seen.select("dest", F.lit(True).alias("_takes")).distinct()
    named = F.when(F.col("migrants_unweighted") > 0, "observed_positive").when(F.col("_sends") & F.col("_takes"), "sampling_zero_plausible").otherwise("structural_zero_likely")
    return panel.join(senders, "orig", "left").join(takers, "dest", "left").withColumns({"flow_observed": F.col("migrants_unweighted") > 0, "zero_class": named}).drop("_sends", "_takes")


def complete_product(panel: DataFrame) -> DataFrame:
    """One row of counts that show whether the panel is the full product without its diagonal."""
    return panel.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("orig").alias("n_orig"), F.sum((F.col("orig") == F.col("dest")).cast("long")).alias("n_diagonal"), F.sum((F.col("migrants") < 0).cast("long")).alias("n_negative")
    ).withColumn("complete", (F.col("n_rows") == F.col("n_orig") * (F.col("n_orig") - 1)) & (F.col("n_diagonal") == 0) & (F.col("n_negative") == 0))


def orphans(flows: DataFrame, universe: DataFrame, code: str = "code") -> DataFrame:
    """(side, code, cells, weight) of codes that are not in the universe."""
    sides = [flows.select(F.lit(s).alias("side"), F.col(s).alias(code), "migrants") for s in ("orig", "dest")]
    lost = sides[0].unionByName(sides[1]).join(universe.select(code).distinct(), code, "left_anti")
    return lost.groupBy("side", code).agg(F.count(F.lit(1)).alias("cells"), F.sum("migrants").alias("weight"))


def audit_codes(observed: DataFrame, expected: DataFrame, code: str = "code") -> DataFrame:
    a, b = observed.select(code).distinct(), expected.select(code).distinct()
    return a.join(b, code, "left_anti").withColumn("problem", F.lit("orphan_in_data")).unionByName(b.join(a, code, "left_anti").withColumn("problem", F.lit("absent_from_data")))
