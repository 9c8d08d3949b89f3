"""Appends that happen once: data first, then an entry in a manifest.

A batch is written to a folder of its own and counts from the moment its entry
appears in ``_manifest``; an entry is created only if there is none of that
batch id, so of two attempts one counts. A batch that was killed before its
entry, or lost the race, leaves a folder that no reader looks at. Readers ask
the manifest which folders count.

    path/data/batch=<batch id>-<attempt>/...
    path/_manifest/<batch id>            {"folder": ..., "replaces": [...]}

`compact` writes the rows of all batches that count as one batch, whose entry
replaces theirs; readers then open one folder and the tail after it. Entries are
small and few: their number is that of the appends since the last compaction.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.schema import AUDIT_SCHEMA

MANIFEST = "_manifest"
ORDER_EVENT_SCHEMA = "id STRING, kind INT, tags STRING"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm


def entries(spark: SparkSession, path: str) -> dict[str, dict]:
    """Every manifest entry by batch id."""
    fs, folder, _ = _file_system(spark, f"{path}/{MANIFEST}")
    if not fs.exists(folder) or not fs.listStatus(folder):
        return {}
    rows = spark.read.text(f"{path}/{MANIFEST}", wholetext=True).collect()
    found = [json.loads(r.value) for r in rows if r.value]
    return {e["batch"]: e for e in found}


def folders(spark: SparkSession, path: str) -> list[str]:
    """The data folders that count: those of all batches but the replaced ones."""
    known = entries(spark, path)
    replaced = {b for e in known.values() for b in e["replaces"]}
    return sorted(e["folder"] for b, e in known.items() if b not in replaced)


def _publish(spark: SparkSession, path: str, batch_id: str, folder: str, replaces: list[str]) -> bool:
    """Create the batch's entry; False if there is one. The entry is written aside and renamed, so it is never half there."""
    fs, final, jvm = _file_system(spark, f"{path}/{MANIFEST}/{batch_id}")
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}/_aside/{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps({"batch": batch_id, "folder": folder, "replaces": replaces}).encode()))
    out.close()
    fs.mkdirs(final.getParent())
    if fs.exists(final):  # rename to an existing file fails on most stores; asked first for those where it would not
        fs.delete(aside, False)
        return False
    if not fs.rename(aside, final):
        fs.delete(aside, False)
        return False
    return True


def append_once(rows: DataFrame, path: str, batch_id: int | str, write: Callable[[DataFrame, str], None]) -> bool:
    """Append ``rows`` as batch ``batch_id`` unless it is there already; whether this call did it.

    ``write(rows, folder)`` writes the data; killed anywhere, the call can be
    made again with the same id.
    """
    spark, batch_id = rows.sparkSession, str(batch_id)
    if batch_id in entries(spark, path):
        return False
    folder = f"data/batch={batch_id}-{uuid.uuid4().hex}"
    write(rows, f"{path}/{folder}")
    return _publish(spark, path, batch_id, folder, [])


def read_committed(spark: SparkSession, path: str, schema, format: str = "parquet") -> DataFrame:
    """The rows of all batches that count."""
    return _load(spark, path, folders(spark, path), schema, format)


def _load(spark: SparkSession, path: str, listed: list[str], schema, format: str) -> DataFrame:
    empty = spark.createDataFrame([], schema)
    if not listed:
        return empty
    # the folders' own partitioning (batch, months) stays visible to the scan and out of the result
    rows = spark.read.format(format).schema(schema).option("basePath", f"{path}/data").load([f"{path}/{f}" for f in listed])
    return rows.select(*empty.columns)


def compact(spark: SparkSession, path: str, schema, write: Callable[[DataFrame, str], None], format: str = "parquet",
            reduce: Callable[[DataFrame], DataFrame] | None = None) -> bool:
    """Replace the batches that count by one batch with their rows, or with what ``reduce`` leaves of them."""
    known = entries(spark, path)
    gone = {b for e in known.values() for b in e["replaces"]}
    live = sorted(b for b in known if b not in gone)
    if len(live) < 2:
        return False
    rows = _load(spark, path, [known[b]["folder"] for b in live], schema, format)
    name = f"compacted-{uuid.uuid4().hex}"
    folder = f"data/batch={name}"
    write(reduce(rows) if reduce else rows, f"{path}/{folder}")
    # the replaced batches' own entries stay: a late retry of one still finds its id taken
    return _publish(spark, path, name, folder, live)


# ---------------------------------------------------------------------------
# the tables that are appended to
# ---------------------------------------------------------------------------
def _write_audit(rows: DataFrame, folder: str) -> None:
    from offerlake.sources.io import append_audit
    append_audit(rows, folder)


def append_audit_once(rows: DataFrame, path: str, batch_id: int | str) -> bool:
    return append_once(rows, path, batch_id, _write_audit)


def read_audit_committed(spark: SparkSession, path: str) -> DataFrame:
    return read_committed(spark, path, AUDIT_SCHEMA).select(*AUDIT_SCHEMA.names)


def compact_audit(spark: SparkSession, path: str) -> bool:
    return compact(spark, path, AUDIT_SCHEMA, _write_audit)


def publish_orders_once(events: DataFrame, path: str, batch_id: int | str) -> bool:
    return append_once(events, path, batch_id, lambda rows, folder: rows.write.json(folder))


def read_published(spark: SparkSession, path: str, schema=ORDER_EVENT_SCHEMA) -> DataFrame:
    return read_committed(spark, path, schema, "json")


# ---------------------------------------------------------------------------
# logs of the newest row per key
# ---------------------------------------------------------------------------
def _parquet(rows: DataFrame, folder: str) -> None:
    rows.write.parquet(folder)


def newest_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of every key the row with the highest ``order``."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("r")).select(*keys, "r.*")


def log_newest(rows: DataFrame, path: str, batch_id: int, keys: list[str], order: str, every: int = 16) -> None:
    """Log a micro-batch's newest row per key once; every ``every`` micro-batches the log becomes one row per key again."""
    spark = rows.sparkSession
    append_once(newest_rows(rows, keys, order), path, batch_id, _parquet)
    if len(folders(spark, path)) > every:
        compact(spark, path, newest_rows(rows, keys, order).schema, _parquet, reduce=lambda all_: newest_rows(all_, keys, order))


def read_newest(spark: SparkSession, path: str, schema, keys: list[str], order: str) -> DataFrame:
    return newest_rows(read_committed(spark, path, schema), keys, order)
