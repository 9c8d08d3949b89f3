"""Unique payment hashes: an index that an append reads in part.

Beside the offers of every committed batch (`sources.commits`) lie their payment
hashes, dealt to BUCKETS folders by hash, and one small filter per bucket:
bitmaps of SLOTS bits in which each hash has one. An append

    1. looks its hashes up in the filters (a fixed size per bucket and batch),
    2. reads the buckets, and only those, in which some hash may be,
    3. writes the rows whose hash is new, with their hashes and filters, as a
       batch that counts once.

So the store itself is never read, and the index only as far as the new rows
reach into it. Hashes of batches that never came to count are not looked at.

    path/data/batch=.../created_month=.../      offers
    path/keys/batch=.../bucket=.../             payment hashes
    path/filters/batch=.../                     bucket, slot group, bitmap
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake import schema as S
from offerlake.functions import ts_lit
from offerlake.sources import commits, io

KEY = "hold_invoice_payment_hash"
BUCKETS = 64
SLOTS = 1 << 20  # bits of one bucket's filter
GROUP_BITS = 32768  # bits of one bitmap row
FILTER_SCHEMA = "bucket INT, slot_group LONG, bits BINARY"
KEY_SCHEMA = f"{KEY} STRING, bucket INT"


def _placed(rows: DataFrame) -> DataFrame:
    """The keys with their bucket and their bit in its filter."""
    slot = F.pmod(F.xxhash64(F.lit(7), KEY), F.lit(SLOTS))
    return rows.select(KEY, F.pmod(F.xxhash64(KEY), F.lit(BUCKETS)).cast("int").alias("bucket"),
                       F.floor(slot / GROUP_BITS).cast("long").alias("slot_group"), (slot % GROUP_BITS).alias("position"))


def _beside(spark: SparkSession, path: str, what: str) -> list[str]:
    """The folders of ``what`` that belong to the batches that count."""
    return [f"{path}/{what}/{f.removeprefix('data/')}" for f in commits.folders(spark, path)]


def filters(spark: SparkSession, path: str) -> DataFrame:
    listed = _beside(spark, path, "filters")
    return spark.read.schema(FILTER_SCHEMA).parquet(*listed) if listed else spark.createDataFrame([], FILTER_SCHEMA)


def may_be_known(new: DataFrame, known: DataFrame) -> DataFrame:
    """The keys of ``new`` whose bit is set in some filter, with their bucket."""
    byte = F.conv(F.hex(F.expr("substring(bits, CAST(position DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    hit = F.floor(byte / F.pow(F.lit(2.0), F.col("position") % 8)) % 2 == 1
    return _placed(new).join(known, ["bucket", "slot_group"]).where(hit).select(KEY, "bucket").distinct()


def known_keys(spark: SparkSession, path: str, new: DataFrame) -> DataFrame:
    """The keys of ``new`` that the store holds already."""
    maybe = may_be_known(new, filters(spark, path))
    buckets = sorted(r.bucket for r in maybe.select("bucket").distinct().collect())  # at most BUCKETS numbers
    if not buckets:
        return spark.createDataFrame([], f"{KEY} STRING")
    stored = spark.read.schema(KEY_SCHEMA).option("basePath", f"{path}/keys").parquet(*_beside(spark, path, "keys"))
    return stored.where(F.col("bucket").isin(buckets)).select(KEY).join(new.select(KEY).distinct(), KEY, "left_semi").distinct()


def _write(rows: DataFrame, folder: str) -> None:
    """A batch's offers, their keys and its filters."""
    io.write_offers(rows.select(*S.OFFER_COLUMNS), folder)
    placed = _placed(rows.sparkSession.read.schema(S.OFFER_SCHEMA).parquet(folder).where(F.col(KEY).isNotNull()))
    placed.select(KEY, "bucket").repartition("bucket").write.partitionBy("bucket").parquet(folder.replace("/data/", "/keys/"))
    bits = F.expr("bitmap_construct_agg(position)").alias("bits")
    placed.groupBy("bucket", "slot_group").agg(bits).repartition("bucket").write.parquet(folder.replace("/data/", "/filters/"))


def append_offers_once(new_rows: DataFrame, path: str, batch_id: int | str, as_of: datetime | str | None = None) -> bool:
    """Insert offers as batch ``batch_id``: one row per payment hash (the first by creation time, then id), none
    whose hash is stored; ``updated_at`` becomes ``as_of`` if that is given. False if the batch is there already.
    Rows without a payment hash cannot clash and are all inserted."""
    spark = new_rows.sparkSession
    if str(batch_id) in commits.entries(spark, path):
        return False
    held = io.scratch_path(spark, "append-batch")
    first = F.min_by(F.struct(*S.OFFER_COLUMNS), F.struct("created_at", "id"))
    keyed = new_rows.where(F.col(KEY).isNotNull()).groupBy(F.col(KEY).alias("_key")).agg(first.alias("r")).select("r.*")
    keyed.unionByName(new_rows.where(F.col(KEY).isNull()).select(*S.OFFER_COLUMNS)).write.parquet(held)
    rows = spark.read.schema(S.OFFER_SCHEMA).parquet(held)
    fresh = rows.join(known_keys(spark, path, rows.where(F.col(KEY).isNotNull())), KEY, "left_anti")
    if as_of is not None:
        fresh = fresh.withColumn("updated_at", ts_lit(as_of))
    return commits.append_once(fresh.select(*S.OFFER_COLUMNS), path, batch_id, _write)


def read_offers_committed(spark: SparkSession, path: str) -> DataFrame:
    return commits.read_committed(spark, path, S.OFFER_SCHEMA).select(*S.OFFER_COLUMNS)


def compact_offers(spark: SparkSession, path: str) -> bool:
    """All batches as one, with one folder per bucket and one filter each."""
    return commits.compact(spark, path, S.OFFER_SCHEMA, _write)
