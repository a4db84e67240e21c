"""Reading and writing tables whose codes stay text."""

from __future__ import annotations

import tempfile
import warnings
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadflow.errors import PipelineError
from dyadflow.functions.keys import compose_code, norm_code


def clean_headers(df: DataFrame) -> DataFrame:
    """Column names without a byte-order mark (in either decoding) and outer blanks."""
    return df.toDF(*[c.replace("﻿", "").replace("ï»¿", "").strip() for c in df.columns])


def read_csv_strings(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """Every column as text, so that 01 is not 1."""
    return clean_headers(spark.read.option("header", True).option("encoding", encoding).csv(paths))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; on a local master, where none is named, a folder of its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise PipelineError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df, computed once, from the shared folder; for tables that several joins read."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def read_projected(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def write_table(df: DataFrame, path: str, keys: list[str]) -> None:
    df.withColumns({k: F.col(k).cast("string") for k in keys}).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_positive_only(panel: DataFrame, path: str, compression: str | None = "gzip") -> None:
    """The rows with a flow as CSV; none at all raises. The panel stays as it is."""
    seen = panel.where("migrants > 0")
    if not seen.limit(1).count():
        raise PipelineError("no positive flow to write")
    seen.write.mode("overwrite").option("header", True).option("compression", compression or "none").csv(path)


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, start, value): the lines of text files of any size, as the bytes they are, and where the split that holds each begins."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def files_by_encoding(spark: SparkSession, paths: str | list[str]) -> dict[str, list[str]]:
    """Files by what their bytes are: UTF-8 if all their lines are valid UTF-8, else ISO-8859-1. Lines are judged where they are read; empty files have none."""
    judged = lines(spark, paths).groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    found: dict[str, list[str]] = {}
    for row in judged.collect():  # one row for each file
        found.setdefault("UTF-8" if row["utf8"] else "ISO-8859-1", []).append(unquote(row["file"]))
    return {encoding: sorted(files) for encoding, files in found.items()}


def headers(spark: SparkSession, paths: str | list[str]) -> dict[str, str]:
    """The first line of each file: the first of the split at its beginning."""
    # ids grow within a task, and a split is read by one task
    numbered = lines(spark, paths).where("start = 0").withColumn("at", F.monotonically_increasing_id())
    first = numbered.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    return {unquote(r["file"]): r["header"] for r in first.collect()}  # one row for each file


def by_layout(spark: SparkSession, paths: str | list[str], encoding: str = "UTF-8") -> list[DataFrame]:
    """CSV files as text, a table for each layout of columns: the files of one layout are one scan, however many there are."""
    layouts: dict[str, list[str]] = {}
    for file, header in headers(spark, paths).items():
        layouts.setdefault(header.strip().lstrip("\ufeff"), []).append(file)
    return [read_csv_strings(spark, sorted(files), encoding) for _, files in sorted(layouts.items())]


def read_csv_smart(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """CSV files of either encoding as one table of text, by column name."""
    parts = [part for encoding, files in sorted(files_by_encoding(spark, paths).items()) for part in by_layout(spark, files, encoding)]
    if not parts:
        raise PipelineError(f"no line in {paths}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_sharded(spark: SparkSession, paths: list[str], required: list[str], marker: str, marked: bool) -> tuple[DataFrame, list[str]]:
    """(all shards of one instrument as text, the files of the other, which are left out).

    Files belong to one instrument or the other by whether their name holds `marker`. A shard without a required column raises with its header.
    """
    name = lambda p: p.rstrip("/").rsplit("/", 1)[-1]
    own = [p for p in paths if (marker in name(p)) == marked]
    if not own:
        raise PipelineError(f"no file {'with' if marked else 'without'} {marker} in its name")
    for file, header in headers(spark, own).items():
        names = [h.strip().strip('"').lstrip("\ufeff") for h in header.split(",")]
        if lacking := [c for c in required if c not in names]:
            raise PipelineError(f"{file} lacks {', '.join(lacking)}; its header is {', '.join(names)}")
    shards = [part.select(*required) for part in by_layout(spark, own)]
    if not shards:
        raise PipelineError(f"no line in {own}")
    out = shards[0]
    for shard in shards[1:]:
        out = out.unionByName(shard)
    return out, [p for p in paths if p not in own]


def keyed(df: DataFrame, whole: list[str], parts: list[tuple[str, str]]) -> DataFrame:
    """df with a column code: the first candidate column that is there, or else a (state, unit) pair put together."""
    for name in whole:
        if name in df.columns:
            return df.withColumn("code", norm_code(F.col(name), 5))
    for state, unit in parts:
        if state in df.columns and unit in df.columns:
            return df.withColumn("code", compose_code(F.col(state), F.col(unit)))
    raise PipelineError(f"no key among the columns {', '.join(df.columns)}")


def read_keyed(spark: SparkSession, path: str, whole: list[str], parts: list[tuple[str, str]]) -> DataFrame:
    return keyed(read_csv_smart(spark, path), whole, parts)


def read_table(spark: SparkSession, path: str, keys: list[str], producer: str) -> DataFrame:
    """A written table with its keys as text; what is not there names the step that makes it."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        raise PipelineError(f"{path} is not there: run {producer} first") from e
    return df.withColumns({k: F.col(k).cast("string") for k in keys})


def optional_table(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """The table, or None with a warning where it is not there."""
    try:
        return read_table(spark, path, keys, "its producer")
    except PipelineError:
        warnings.warn(f"{path} is not there; its columns are left out", stacklevel=2)
        return None


def raster_cells(table: DataFrame, band: int, scale: float = 1.0, offset: float = 0.0, nodata: float | None = None, weights: bool = False) -> DataFrame:
    """Cells of one band: nodata becomes null, then value * scale + offset; below 0 is null for weights alone."""
    value = F.col("value").cast("double")
    if nodata is not None:
        value = F.when(value != nodata, value)
    value = value * scale + offset
    return table.where(F.col("band") == band).withColumn("value", F.when(value >= 0, value) if weights else value)


def collapse_time(cells: DataFrame, keys: list[str], year: int | None, time: str = "year") -> DataFrame:
    """The year's cells, or the mean of all years where none is asked for; cells without time stay as they are."""
    if time not in cells.columns:
        return cells.select(*keys, "value")
    if year is not None:
        return cells.where(F.col(time) == year).select(*keys, "value")
    return cells.groupBy(*keys).agg(F.avg("value").alias("value"))


def expect_n_inputs(df: DataFrame, column: str, n: int = 12) -> DataFrame:
    found = df.agg(F.count_distinct(column).alias("n")).head()["n"]
    if found != n:
        raise PipelineError(f"{found} different {column} instead of {n}")
    return df


def drop_zero_flows(panel: DataFrame, drop: bool) -> tuple[DataFrame, dict[str, bool]]:
    """(the panel, without its zeros if so chosen, the choice as the codebook records it)."""
    return (panel.where("migrants > 0") if drop else panel), {"zero_flows_dropped": drop}


def write_splits(rows: DataFrame, path: str, features: list[str], target: str) -> None:
    """Features, target and log(1 + target), partitioned by split."""
    rows.select("split", *features, target, F.log1p(target).alias(f"log1p_{target}")).write.mode("overwrite").partitionBy("split").parquet(path)


def write_report_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A report, which is small, in a fixed order."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def checkpointed_by_year(spark: SparkSession, path: str, years: list[int], make: Callable[[int], DataFrame]) -> DataFrame:
    """make(year) for all years, each written once: a year whose mark is there is not made again.

    A year replaces its own partition alone, and its mark, in `path`.done, is written last: what a run that broke off has left is made anew.
    """
    marks = f"{path}.done"
    try:
        done = {r[0] for r in spark.read.schema("year int").json(marks).distinct().collect()}  # one row for each year
    except AnalysisException:
        done = set()
    for year in years:
        if year not in done:
            made = make(year).drop("year").withColumn("year", F.lit(year))
            made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
            spark.createDataFrame([(year,)], "year int").coalesce(1).write.mode("append").json(marks)
    return spark.read.parquet(path).where(F.col("year").isin(years))
