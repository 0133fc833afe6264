"""Ranks over a whole table without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tarnwork.sources.readers import written

_BITS = 33


def ranked(df: DataFrame, *order: Column | str, limit: int | None = None) -> DataFrame:
    """Adds rank (int, from 1) in an order; with ``limit``, only the first rows are kept.

    The rows are range-sorted and written with their place in their partition; a partition's offset is
    the number of rows before it, a table as long as there are partitions. Columns may have any name but rank.
    """
    if limit is not None:
        few = df.orderBy(*order).limit(limit)
        return few.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    # The row itself is one column, so that no name clashes with the ones added here.
    rows = written(df.orderBy(*order).select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.monotonically_increasing_id().alias("at")), "ranked")
    part = F.shiftright("at", _BITS).alias("part")
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(part).agg(F.count("*").alias("n"))
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    out = rows.select("row", "at", part).join(F.broadcast(offsets), "part")
    rank = F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << _BITS) - 1)) + 1
    return out.select("row.*", rank.cast("int").alias("rank"))
