"""What several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id where ids are compared: it comes after every id.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; on a local master, where none is named, a folder of its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, deleted when Spark ends.

    Like checkpoint() it cuts the lineage. It cuts the size estimates too, which a loop of joins multiplies without end. The
    files are not compressed: codecs keep memory outside the heap, which many small files add up.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "none").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def id_or_last(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def id_or_null(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(LAST_ID))


def row_key(id_col: str, text: Column) -> Column:
    """A key that never is null: rows with one id but different texts stay apart, repeated rows share it."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"))
