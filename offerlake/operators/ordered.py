"""Segmented scan: rows in one order, cut into ranges, finished in parallel.

A plain window over a key sends all rows of the key to one task, and one over
all rows sends everything there. Here the rows are sorted into ranges of the
order (`ranged`) and stored with their number; whatever depends on the order is
worked out inside each range, and one row per range, its *carry*, is scanned to
link the ranges. A key with a third of all rows, or a minute that holds all of
them, is cut into as many ranges as its size asks for. Only rows that are equal
in the whole order stay together.

The source is read for the sort (counted, and sampled for the ranges' bounds); the
stored rows are read once for the ranges and once or twice for the carries. Ranges
hold about RANGE_ROWS rows and are dealt to as many tasks: sorted rows compress so well
that tasks cut by their bytes would hold many ranges, and sort them in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.sources.io import scratch_path

RANGE_ROWS = 100_000


def ranges_for(df: DataFrame, chunk: int | None = None) -> int:
    return max(1, -(-df.count() // (chunk or RANGE_ROWS)))


def ranged(df: DataFrame, order: list[str | Column], ranges: int | None = None) -> DataFrame:
    """``df`` sorted by ``order``, stored, with ``_at`` (a number that grows with the order) and ``_part`` (the range)."""
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    path = scratch_path(df.sparkSession, "ranged")
    dealt.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    stored = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("_at", T.LongType())])).parquet(path)
    return stored.withColumn("_part", F.shiftright("_at", 33))


def neighbors(df: DataFrame, key: str, order: str, cols: list[str], chunk: int | None = None) -> DataFrame:
    """Adds struct columns ``prev`` and ``next`` holding (order, *cols) of the
    previous / next row of the same key (NULL at the ends). Rows of equal
    ``order`` follow each other in any order; ``chunk`` asks for ranges of about
    that many rows."""
    vals = F.struct(F.col(key).alias("key"), F.struct(F.col(order), *[F.col(c) for c in cols]).alias("row"))
    ranges = ranges_for(df, chunk)
    rows = ranged(df, [key, order], ranges)
    w = Window.partitionBy("_part").orderBy("_at")
    local = rows.repartition(ranges, "_part").withColumn("_prev", F.lag(vals).over(w)).withColumn("_next", F.lead(vals).over(w))
    # one row per range: its first and last row; the numbers of these are found first, so that no range is sorted for them
    bounds = rows.groupBy("_part").agg(F.min("_at").alias("lo"), F.max("_at").alias("hi"))
    ends = bounds.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("_at"))
    edges = rows.join(F.broadcast(ends), "_at").groupBy("_part").agg(F.min_by(vals, F.col("_at")).alias("_first"), F.max_by(vals, F.col("_at")).alias("_last"))
    links = edges.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_before"), F.lead("_first").over(Window.orderBy("_part")).alias("_after"))

    def same(side: str, link: str) -> Column:
        near = F.coalesce(side, link)
        return F.when(near["key"].eqNullSafe(F.col(key)), near["row"])

    return (local.join(links, "_part")
            .withColumn("prev", same("_prev", "_before")).withColumn("next", same("_next", "_after"))
            .drop("_prev", "_next", "_before", "_after", "_part", "_at"))


def last_seen(df: DataFrame, order: list[str | Column], value: str, into: str, ranges: int | None = None) -> DataFrame:
    """Adds ``into``: the last ``value`` that is not null among the rows up to each one, in ``order``."""
    ranges = ranges or ranges_for(df)
    rows = ranged(df, order, ranges)
    upto = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.repartition(ranges, "_part").withColumn("_local", F.last(value, ignorenulls=True).over(upto))
    ends = rows.groupBy("_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_at"))).alias("_end"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carry = ends.select("_part", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    return local.join(carry, "_part").withColumn(into, F.coalesce("_local", "_carry")).drop("_local", "_carry", "_part", "_at")
