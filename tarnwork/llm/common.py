"""What the operators share: numbered rows, running sums over whole tables, written tables that cut lineage."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tarnwork.functions.text import LOWER, UPPER, ascii_lower
from tarnwork.sources.readers import shared_folder, spread, table

__all__ = ["ascii_lower", "spread", "table"]

#: Space and the five ASCII control characters from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: For str.translate: lower-cases A to Z and nothing else.
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER)}
#: Rows up to which a table of numbers is sent to every task, about 16 bytes each.
MOST_SENT = 500_000
#: Bits of a row's place within its partition in ``monotonically_increasing_id``.
_BITS = 33

_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(path := f"{shared_folder(spark)}/tarnwork/{name}-{uuid.uuid4().hex}")
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a cut lineage that survives lost executors."""
    return kept(df, new_path(df.sparkSession, name))


def kept(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables written within, once what is made of them has been written elsewhere.

    An operator returns a plan that reads its written tables, so only the caller knows when they are done
    with. Without this, they stay in the shared folder's ``tarnwork`` until its owner deletes it.
    """
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            delete(spark, path)
        del _made[before:]


def numbered(docs: DataFrame) -> DataFrame:
    """number and row: all columns of ``docs`` as one struct, so that none clashes, and a number that tells its rows apart, the same whenever it is read.

    That is doc_id where it is unique, which only reads the ids; else the rows are numbered and written.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if again.limit(1).count() == 0:
        return docs.select(F.col("doc_id").cast("long").alias("number"), row)
    return written(docs.select(F.monotonically_increasing_id().alias("number"), row), "numbered")


def running(df: DataFrame, order: list[Column | str], sums: dict[str, str], name: str) -> DataFrame:
    """``df`` with a running row number ``place`` (from 1) and running sums, in an order over the whole table.

    The rows are range-sorted over all tasks and written with their place; each partition adds the
    totals of those before it, a table as long as there are partitions. ``sums``: new column to column.
    """
    rows = df.orderBy(*order).withColumn("at", F.monotonically_increasing_id())
    rows = written(rows, name).withColumn("part", F.shiftright("at", _BITS))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.count("*").alias("rows"), *(F.sum(c).alias(f"in {n}") for n, c in sums.items()))
    bases = totals.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"base {c}") for c in totals.columns[1:]))
    within = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"own {n}": F.sum(c).over(within) for n, c in sums.items()}).join(F.broadcast(bases), "part")
    added = {n: F.col(f"base in {n}") + F.col(f"own {n}") for n in sums}
    added["place"] = F.col("base rows") + F.col("at").bitwiseAND(F.lit((1 << _BITS) - 1)) + 1
    return out.select(*df.columns, *(c.alias(n) for n, c in added.items()))


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder made by ``new_path`` from whatever file system it is on."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ascii_lower_text(text: str) -> str:
    return text.translate(ASCII_LOWER) if not text.isascii() else text.lower()
