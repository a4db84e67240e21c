"""The assembled panel: covariates of both ends on the full product, with gates that are read off the tables while they are computed.

All tables of units become one wide table, in one pass whose metrics (`Observation`) tell what matched, what did not and what is there twice. The
flows are checked for orphans, repeats and negatives in the pass that writes them. Only when both hold is the product made: the wide table with itself, then flows and
pair values by left joins on the pair. The panel's gates and missing values are metrics of the pass that writes it; it moves to
its place after they hold.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from dyadflow.errors import PipelineError
from dyadflow.functions.keys import rename_final, unit_convert
from dyadflow.operators.panel import BROADCAST_CODES
from dyadflow.sources.tables import shared_dir, write_positive_only, written

PAIR = ["orig", "dest"]


@dataclass(frozen=True)
class UnitTable:
    """Values of units: `orig` and `dest` say which columns go to which end, and their names there; table None: not there, left out."""

    name: str
    table: DataFrame | None
    orig: dict[str, str]
    dest: dict[str, str]
    key: str = "code"
    required: bool = False


@dataclass
class Gates:
    """What a panel has to hold."""

    fail_on_orphans: bool = True
    published_total: float | None = None
    tolerance: float | None = None
    code_width: int = 5


@dataclass
class Assembled:
    """A panel that passed, where it lies, and what was seen on the way."""

    panel: DataFrame
    path: str
    codebook: DataFrame
    metrics: dict[str, dict[str, float]] = field(default_factory=dict)

    def report(self) -> DataFrame:
        """(step, metric, value) of all that the passes counted."""
        rows = [(step, name, float(value)) for step, found in self.metrics.items() for name, value in found.items() if value is not None]
        return self.panel.sparkSession.createDataFrame(rows, "step string, metric string, value double")


def observed(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, Observation]:
    seen = Observation(name)
    return df.observe(seen, *[m.alias(k) for k, m in metrics.items()]), seen


def climate_provider(source: str, tables: dict[str, DataFrame | None], years: tuple[int, int]) -> tuple[DataFrame | None, bool | None]:
    """((code, temp_c, precip_mm, climate_source, climate_period) of the chosen source, whether it describes the window); (None, None) with a warning where its table is not there.

    Normals come in degrees C and mm with their own stamps; the reanalysis in degrees F and metres for the window `years`.
    """
    # fixed values: the names of the two sources
    normals, reanalysis = ("worldclim_zonal", "worldclim", "zonal"), "era5_gee"
    if source not in (*normals, reanalysis):
        raise PipelineError(f"unknown climate source {source}: {normals[0]} or {reanalysis}")
    window = source == reanalysis
    table = tables.get("climate_gee" if window else "climate")
    if table is None:
        warnings.warn(f"the table of {source} is not there; the panel has no climate", stacklevel=2)
        return None, None
    if not window:
        return table.select("code", F.col("temp_mean_c").alias("temp_c"), F.col("precip_total_mm").alias("precip_mm"), "climate_source", "climate_period"), False
    stamps = {"climate_source": F.lit("era5_land_gee"), "climate_period": F.lit(f"{years[0]}-{years[1]}")}
    return table.select("code", unit_convert(F.col("temp").cast("double"), "F", "C").alias("temp_c"), unit_convert(F.col("precip").cast("double"), "m", "mm").alias("precip_mm")).withColumns(stamps), True


def checked_flows(flows: DataFrame, universe: DataFrame, gates: Gates) -> tuple[DataFrame, dict]:
    """Flows by pair, written; orphans, repeated pairs, negatives and codes of another width are counted in that pass, and raise."""
    # the first row of a pair stands for it; a second one raises below
    once = flows.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_copies"), F.min(F.struct("migrants", "migrants_unweighted")).alias("_f"))
    found = once.select(*PAIR, "_copies", F.col("_f.migrants").alias("migrants"), F.col("_f.migrants_unweighted").alias("migrants_unweighted"))
    for role in PAIR:
        found = found.join(universe.select(F.col("code").alias(role), F.lit(True).alias(f"_{role}")), role, "left")
    lost = F.col("_orig").isNull() | F.col("_dest").isNull()
    wide = lambda c: F.col(c).isNull() | (F.length(c) != gates.code_width)
    found, seen = observed(
        found, "flows", n_pairs=F.count(F.lit(1)), n_repeated=F.count_if(F.col("_copies") > 1), n_negative=F.count_if(F.col("migrants") < 0), n_bad_codes=F.count_if(wide("orig") | wide("dest")),
        n_orphans=F.count_if(lost), orphan_weight=F.coalesce(F.sum(F.when(lost, F.col("migrants"))), F.lit(0)), total=F.coalesce(F.sum("migrants"), F.lit(0)),
    )
    found = written(found)
    got = seen.get
    if got["n_bad_codes"]:
        raise PipelineError(f"flows: {got['n_bad_codes']} pairs with a code that is not {gates.code_width} characters")
    if got["n_repeated"]:
        raise PipelineError(f"flows: {got['n_repeated']} pairs are there more than once")
    if got["n_negative"]:
        raise PipelineError(f"flows: {got['n_negative']} negative values")
    if got["n_orphans"] and gates.fail_on_orphans:
        raise PipelineError(f"flows: {got['n_orphans']} pairs with a code outside the universe, {got['orphan_weight']} migrants; joining would lose them")
    return found.where(~lost).select(*PAIR, "migrants", "migrants_unweighted"), got


def wide_units(universe: DataFrame, tables: list[UnitTable], flows: DataFrame, gates: Gates) -> tuple[DataFrame, dict, list[UnitTable]]:
    """One row per unit with the values of all tables and whether it sends and takes, written; repeated keys raise."""
    there = []
    for t in tables:
        if t.table is not None:
            there.append(t)
        elif t.required:
            raise PipelineError(f"{t.name} is not there: run what makes it first")
        else:
            warnings.warn(f"{t.name} is not there; its columns are left out", stacklevel=3)
    wide = universe.select("code", F.lit(True).alias("_unit"))
    metrics = {"n_units": F.count_if("_unit"), "n_bad_codes": F.count_if(F.col("_unit") & (F.col("code").isNull() | (F.length("code") != gates.code_width)))}
    for t in there:
        values = sorted({*t.orig, *t.dest})
        # null keys cannot match, and the first row of a key stands for it until a second one raises
        own = t.table.where(F.col(t.key).isNotNull()).groupBy(F.col(t.key).alias("code")).agg(F.count(F.lit(1)).alias(f"_n_{t.name}"), F.first(F.struct(*[F.col(v) for v in values])).alias(f"_v_{t.name}"))
        wide = wide.join(own, "code", "full_outer")
        n, unit = F.col(f"_n_{t.name}"), F.coalesce("_unit", F.lit(False))
        metrics |= {f"{t.name}_matched": F.count_if(unit & n.isNotNull()), f"{t.name}_unmatched": F.count_if(unit & n.isNull()), f"{t.name}_unused": F.count_if(~unit & n.isNotNull()), f"{t.name}_repeated": F.count_if(n > 1)}
    # a pair is a zero that sampling explains where both of its ends are active
    active = flows.where("migrants_unweighted > 0")
    for role, flag in (("orig", "_sends"), ("dest", "_takes")):
        wide = wide.join(active.select(F.col(role).alias("code"), F.lit(True).alias(flag)).distinct(), "code", "left")
    wide, seen = observed(wide, "units", **metrics)
    wide = written(wide.select("code", "_unit", "_sends", "_takes", *[f"_v_{t.name}" for t in there]))
    got = seen.get
    if got["n_bad_codes"]:
        raise PipelineError(f"universe: {got['n_bad_codes']} codes are not {gates.code_width} characters")
    if twice := [t.name for t in there if got[f"{t.name}_repeated"]]:
        raise PipelineError(f"units that are there more than once: {', '.join(twice)}")
    return wide.where("_unit"), got, there


def full_panel(wide: DataFrame, n_units: int, there: list[UnitTable], flows: DataFrame, pairs: DataFrame | None, values: list[str]) -> DataFrame:
    """Every ordered pair of different units with flows, zero classes, pair values and the values of both ends."""
    ends = {}
    for role, flag in (("orig", "_sends"), ("dest", "_takes")):
        cells = [F.col(f"_v_{t.name}.{c}").alias(name) for t in there for c, name in getattr(t, role).items()]
        ends[role] = wide.select(F.col("code").alias(role), flag, *cells)
    dest = F.broadcast(ends["dest"]) if n_units <= BROADCAST_CODES else ends["dest"]
    panel = ends["orig"].crossJoin(dest).where("orig <> dest").join(flows, PAIR, "left")
    if pairs is not None:
        panel = panel.join(pairs.select(*PAIR, *values), PAIR, "left")
    seen = F.coalesce("migrants_unweighted", F.lit(0)) > 0
    zero = F.when(seen, "observed_positive").when(F.col("_sends") & F.col("_takes"), "sampling_zero_plausible").otherwise("structural_zero_likely")
    flow = [F.coalesce("migrants", F.lit(0)).alias("migrants"), F.coalesce("migrants_unweighted", F.lit(0)).alias("migrants_unweighted"), seen.alias("flow_observed"), zero.alias("zero_class")]
    names = [name for role in PAIR for t in there for name in getattr(t, role).values()]
    return panel.select(*PAIR, *flow, *(values if pairs is not None else []), *names)


def checked_pairs(pairs: DataFrame, values: list[str]) -> tuple[DataFrame, Observation]:
    """Pair values by pair; how many pairs are there twice is known when they have been read."""
    once = pairs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("_copies"), F.first(F.struct(*values)).alias("_p"))
    once, seen = observed(once, "pairs", n_pairs=F.count(F.lit(1)), n_repeated=F.count_if(F.col("_copies") > 1))
    return once.select(*PAIR, "_p.*"), seen


def moved(df: DataFrame, staged: str, path: str) -> None:
    """The staged folder takes the place of `path`."""
    spark = df.sparkSession
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, staged))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise PipelineError(f"cannot move the panel to {path}")


def assemble(
    flows: DataFrame, universe: DataFrame | None, tables: list[UnitTable], path: str | None, spec: list[tuple[str, str, str, str, str, str]], names: dict[str, str] | None = None,
    pairs: DataFrame | None = None, pair_values: list[str] | None = None, gates: Gates | None = None, positive_csv: str | None = None, drop_zeros: bool = False, limitations: dict[str, str] | None = None,
) -> Assembled:
    """Builds, checks and writes the panel to `path` (None: a folder of the shared one), each origin's rows together and in order.

    universe (code); None: the codes of the first table. names: the final names; spec: (column, definition, units, source, vintage, construction) of
    every final column, else it raises. drop_zeros keeps positive flows alone in the panel, after the gates, and says so in the codebook.
    """
    gates, names, limitations = gates or Gates(), names or {}, dict(limitations or {})
    spark = flows.sparkSession
    if universe is None:
        if not tables or tables[0].table is None:
            raise PipelineError("neither a universe nor a table of units to take it from")
        warnings.warn(f"no universe given: it is taken from {tables[0].name}", stacklevel=2)
        universe = tables[0].table.select(F.col(tables[0].key).alias("code"))
    universe = written(universe.select("code").where(F.col("code").isNotNull()).distinct())
    sparse, flow_metrics = checked_flows(flows, universe, gates)
    wide, unit_metrics, there = wide_units(universe, tables, sparse, gates)
    n = unit_metrics["n_units"]
    pair_metrics = None
    if pairs is not None:
        pairs, pair_metrics = checked_pairs(pairs, pair_values or [])
    panel = rename_final(full_panel(wide, n, there, sparse, pairs, pair_values or []), names)
    of = lambda c: names.get(c, c)
    described = {row[0] for row in spec}
    if lacking := [c for c in panel.columns if c not in described]:
        raise PipelineError(f"not in the codebook: {', '.join(lacking)}")
    panel, seen = observed(
        panel, "panel", n_rows=F.count(F.lit(1)), n_diagonal=F.count_if(F.col(of("orig")) == F.col(of("dest"))), n_negative=F.count_if(F.col(of("migrants")) < 0), n_positive=F.count_if(F.col(of("migrants")) > 0),
        total=F.coalesce(F.sum(of("migrants")), F.lit(0)), **{f"missing_{c}": F.count_if(F.col(c).isNull()) for c in panel.columns},
    )
    kept = panel.where(F.col(of("migrants")) > 0) if drop_zeros else panel
    parts = max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    staged = f"{shared_dir(spark)}/panel-{spark._jvm.java.util.UUID.randomUUID()}" if path is None else f"{path}.staged"
    kept.repartition(parts, of("orig")).sortWithinPartitions(of("orig"), of("dest")).write.mode("overwrite").option("compression", "zstd").parquet(staged)
    got = seen.get
    metrics = {"flows": flow_metrics, "units": unit_metrics, **({"pairs": pair_metrics.get} if pair_metrics else {}), "panel": got}
    if pair_metrics and metrics["pairs"]["n_repeated"]:
        raise PipelineError(f"pair values: {metrics['pairs']['n_repeated']} pairs are there more than once")
    if got["n_rows"] != n * (n - 1) or got["n_diagonal"]:
        raise PipelineError(f"the panel has {got['n_rows']} rows and {got['n_diagonal']} on the diagonal, not {n * (n - 1)} and 0")
    if got["n_negative"]:
        raise PipelineError(f"the panel has {got['n_negative']} negative flows")
    if gates.published_total:
        gap = float(got["total"]) / gates.published_total - 1
        metrics["panel"]["reconciliation"] = gap
        if gates.tolerance is not None and abs(gap) > gates.tolerance:
            raise PipelineError(f"the total differs from the published one by {gap:+.3%}, more than {gates.tolerance:.1%}")
    if path is not None:
        moved(panel, staged, path)
        staged = path
    out = spark.read.parquet(staged)
    if positive_csv:
        write_positive_only(out.withColumnRenamed(of("migrants"), "migrants"), positive_csv)
    if drop_zeros:
        limitations[of("migrants")] = "zeros were dropped: the panel is conditioned on a positive flow"
    types, n_rows = dict(out.dtypes), got["n_rows"]
    rows = [(*row, types[row[0]], got[f"missing_{row[0]}"], 100.0 * got[f"missing_{row[0]}"] / n_rows if n_rows else None, limitations.get(row[0])) for row in spec if row[0] in types]
    book = spark.createDataFrame(rows, "column string, definition string, units string, source string, vintage string, construction string, type string, n_missing long, pct_missing double, limitation string")
    return Assembled(out, staged, book, metrics)
