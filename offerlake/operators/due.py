"""Due-time index: offers that wait for a timeout, kept by the month they fall due.

A sweep asks which waiting offers are past their deadline. Instead of reading
every offer, it reads the slices of the index up to its own month, in which
entries are sorted by due time:

    path/due_slice=<yyyy-MM or none>/...     none: no time to count from, always due

An offer's change is written as an entry in the slice of its new deadline and,
when the old version had one elsewhere, as an entry that ends it there; both
carry the change's version, and inside a slice the highest version of an id
counts. So a change never rewrites a slice, and a sweep needs no other slice.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.functions import ts_lit
from offerlake.operators.lifecycle import RULES, SWEEP_ORDER

ENTRY = "id STRING, status STRING, rule STRING, new_status STRING, due_at TIMESTAMP_NTZ, version BIGINT, live BOOLEAN, due_slice STRING"


def waiting(offers: DataFrame) -> DataFrame:
    """(id, status, rule, new_status, due_at, due_slice) of every offer that waits for a timeout."""
    st, rule, due, new = F.col("status"), F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("string")
    for name in reversed(SWEEP_ORDER):
        statuses, due_of, moves = RULES[name]
        rule, due = F.when(st.isin(statuses), F.lit(name)).otherwise(rule), F.when(st.isin(statuses), due_of()).otherwise(due)
        for f, t in moves.items():
            new = F.when(st == f, F.lit(t)).otherwise(new)
    timed = [s for name in SWEEP_ORDER for s in RULES[name][0]]
    rows = offers.where(st.isin(timed)).select("id", "status", rule.alias("rule"), new.alias("new_status"), due.alias("due_at"))
    return rows.withColumn("due_slice", F.coalesce(F.date_format("due_at", "yyyy-MM"), F.lit("none")))


def _write(entries: DataFrame, path: str, mode: str) -> None:
    entries.repartition("due_slice").sortWithinPartitions("due_slice", "due_at").write.mode(mode).partitionBy("due_slice").parquet(path)


def build(offers: DataFrame, path: str) -> None:
    """The index of a snapshot (version 0)."""
    _write(waiting(offers).withColumn("version", F.lit(0).cast("bigint")).withColumn("live", F.lit(True)), path, "overwrite")


def update(before: DataFrame, after: DataFrame, path: str, version: int) -> None:
    """Enter changed offers: ``before`` and ``after`` hold their rows before and after the change (inserted ones only
    after, deleted ones only before). ``version`` grows from change to change; entering one again changes nothing."""
    old = waiting(before).withColumn("live", F.lit(False))
    new = waiting(after).withColumn("live", F.lit(True))
    ended = old.join(new.select("id", "due_slice"), ["id", "due_slice"], "left_anti")  # in the same slice the new entry ends the old one
    _write(ended.unionByName(new).withColumn("version", F.lit(version).cast("bigint")), path, "append")


def due(spark: SparkSession, path: str, as_of: datetime | str, rules: list[str] | None = None) -> DataFrame:
    """What the sweeps act on: (id, status, rule, new_status, due_at), from the slices up to the month of ``as_of``."""
    month = F.date_format(ts_lit(as_of), "yyyy-MM")
    entries = spark.read.schema(ENTRY).parquet(path).where((F.col("due_slice") <= month) | (F.col("due_slice") == "none"))
    newest = entries.groupBy("due_slice", "id").agg(F.max_by(F.struct("status", "rule", "new_status", "due_at", "live"), F.struct("version", "live")).alias("e"))
    rows = newest.select("id", "e.*").where(F.col("live")).where(F.col("due_at").isNull() | (ts_lit(as_of) > F.col("due_at")))
    if rules is not None:
        rows = rows.where(F.col("rule").isin(rules))
    return rows.select("id", "status", "rule", "new_status", "due_at")


def compact(spark: SparkSession, path: str, out: str) -> None:
    """The index without ended and replaced entries, in a folder of its own."""
    entries = spark.read.schema(ENTRY).parquet(path)
    newest = entries.groupBy("due_slice", "id").agg(F.max_by(F.struct("status", "rule", "new_status", "due_at", "version", "live"), F.struct("version", "live")).alias("e"))
    _write(newest.select("id", "e.*", "due_slice").where("live"), out, "overwrite")
