"""Order over a whole table without a window over all of it: range partitions, and offsets of their sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelyard.scratch import Scratch

_ROW = (1 << 33) - 1


def ranged(df: DataFrame, order: list, scratch: Scratch, keep: bool = False) -> DataFrame:
    """The rows sorted over the whole table and stored, with ``_part`` (which range) and ``_row`` (place in it, from 0).

    Stored, as ranges are drawn anew each time that a sort is computed.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))
    return scratch.store(df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), place.alias("_row")), keep)


def _offsets(parts: DataFrame, column: str) -> DataFrame:
    """Running sums before each range: a row for each range, so the window is small."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_offset", F.coalesce(F.sum(column).over(before), F.lit(0)))


def numbered(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """The rows with their place (from 1) in an order that has no ties. They are stored once; what reads the result reads only
    the columns that it needs."""
    kept = Scratch(df.sparkSession)
    rows = ranged(df, order, kept, keep=True)
    sizes = kept.store(_offsets(rows.groupBy("_part").agg(F.count("*").alias("_n")), "_n").select("_part", "_offset"), keep=True)
    return rows.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_offset") + F.col("_row") + 1).drop("_part", "_row", "_offset")


def changes(df: DataFrame, order: list, column: str, name: str) -> DataFrame:
    """The rows with the number of the run of equal values of ``column`` that they are in, in the given order; null equals nothing."""
    with Scratch(df.sparkSession) as scratch:
        rows = ranged(df, order, scratch)
        lasts = rows.groupBy("_part").agg(F.max_by(F.struct(column), "_row")[column].alias("_last"))
        before = lasts.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_last"))
        own = Window.partitionBy("_part").orderBy("_row")
        linked = rows.join(F.broadcast(before), "_part")
        previous = F.when(F.col("_row") == 0, F.col("_last")).otherwise(F.lag(column).over(own))
        marked = scratch.store(linked.withColumn("_new", F.coalesce(F.col(column) != previous, F.lit(True)).cast("long")).drop("_last"))
        sums = _offsets(marked.groupBy("_part").agg(F.sum("_new").alias("_n")), "_n").select("_part", "_offset")
        run = F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_offset")
        out = marked.join(F.broadcast(sums), "_part").withColumn(name, run).drop("_part", "_row", "_new", "_offset")
        return Scratch(df.sparkSession).store(out, keep=True)
