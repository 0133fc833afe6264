"""Sources and sinks: tables, source trees, payload files, and written tables in the shared folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Bytes (as the planner estimates them) up to which a table counts as small.
SMALL = 64 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt out over all cores, for work that costs far more than moving it: a file's only row group is one task else. Large ones stay as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else df


def source_tree(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """file_path and source of every file under a folder, one row per file."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("source"))


def payload_files(spark: SparkSession, path: str) -> DataFrame:
    """name and body of every file under a folder, for the pipeline."""
    return source_tree(spark, path).select(F.element_at(F.split("file_path", "/"), -1).alias("name"), F.col("source").alias("body"))


def write(df: DataFrame, path: str, form: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Writes a result as Parquet, ORC, JSON or CSV, into one folder per value of the partition columns."""
    df.write.format(form).partitionBy(*partition_by).save(path)


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tarnwork-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one where none is set and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or _own_folder()).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: its lineage is cut, and lost executors don't matter."""
    path = f"{shared_folder(df.sparkSession)}/tarnwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
