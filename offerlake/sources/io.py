"""Readers and writers of the offer store, the audit log, rate payloads and
order events.

Tables are Parquet folders partitioned by creation month (``created_month``)
with rows range-partitioned and sorted by ``created_at`` inside, so a date
predicate prunes month folders and then row groups (min/max statistics);
every writer task covers one contiguous time range, so a busy month is
spread over many files and tasks. Readers always pass an explicit schema
(never inferred): columns missing from older files come back NULL, and the
two secret columns of the stored table are simply not part of the read
schema, so they are never read.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake import schema as S
from offerlake.functions import ts_lit
from offerlake.operators import rollup as RU
from offerlake.session import checkpoint_dir

PARTITION_COL = "created_month"


def _month(c: str = "created_at"):
    return F.trunc(F.to_date(F.col(c)), "month")


def _time_ranged(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """Contiguous time ranges per task, sorted inside (writer layout)."""
    return df.repartitionByRange(ts).sortWithinPartitions(ts)

RATE_PAYLOAD_SCHEMA = T.StructType([
    T.StructField("round_id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("fetched_at", T.TimestampNTZType()),
    T.StructField("http_status", T.IntegerType()),
    T.StructField("body", T.StringType()),
])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return f"{checkpoint_dir(spark).rstrip('/')}/offerlake-scratch/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------------------
# offers
# ---------------------------------------------------------------------------
def utc_wall_clock(col: str):
    """An instant (TIMESTAMP) as its UTC wall-clock TIMESTAMP_NTZ, whatever
    the session time zone."""
    return (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.unix_micros(F.col(col)) / F.lit(1_000_000)))


def _instant(value: datetime | str):
    """A UTC wall-clock time as an instant literal, whatever the session time zone."""
    at = value if isinstance(value, datetime) else datetime.fromisoformat(value)
    at = at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at
    return F.timestamp_micros(F.lit(int((at - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))))


def read_offers(spark: SparkSession, path: str, fiat_scale: int = 2, since: datetime | str | None = None,
                until: datetime | str | None = None, instant_timestamps: bool = False,
                flag_status: bool = False) -> DataFrame:
    """Scan an offers table with the fixed schema; secrets are not read and
    late columns missing from old files are NULL. Every row is kept, also one
    with an unknown or NULL status; ``flag_status`` adds ``status_known`` (and
    `offer_status_rejects` lists the others). ``since`` / ``until`` restrict
    created_at; where the folder is partitioned by ``created_month`` they also
    prune its months. ``instant_timestamps`` reads tables whose time columns
    are instants (a TIMESTAMPTZ export) and turns them into UTC wall-clock
    values; the bounds are applied to the stored instants."""
    fields = [f if f.name != "fiat_amount" else T.StructField("fiat_amount", T.DecimalType(18, fiat_scale), True)
              for f in S.OFFER_SCHEMA.fields]
    ts_cols = [f.name for f in fields if isinstance(f.dataType, T.TimestampNTZType)] if instant_timestamps else []
    fields = [T.StructField(f.name, T.TimestampType(), f.nullable) if f.name in ts_cols else f for f in fields]
    df = spark.read.schema(T.StructType(fields)).parquet(path)
    bound = _instant if instant_timestamps else ts_lit
    months = PARTITION_COL in df.columns  # a folder without month folders has no such column
    if since is not None:
        df = df.where(F.col("created_at") >= bound(since))
        if months:
            df = df.where(F.col(PARTITION_COL) >= F.trunc(F.to_date(ts_lit(since)), "month"))
    if until is not None:
        df = df.where(F.col("created_at") < bound(until))
        if months:
            df = df.where(F.col(PARTITION_COL) <= F.trunc(F.to_date(ts_lit(until)), "month"))
    out = df.select(*[utc_wall_clock(c).alias(c) if c in ts_cols else F.col(c) for c in S.OFFER_COLUMNS])
    known = F.coalesce(F.col("status").isin(S.STATUSES), F.lit(False))
    return out.withColumn("status_known", known) if flag_status else out


def offer_status_rejects(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(T.StructType([S.OFFER_SCHEMA["id"], S.OFFER_SCHEMA["status"]])).parquet(path)
    return df.where(~F.col("status").isin(S.STATUSES) | F.col("status").isNull())


def read_offers_jdbc(spark: SparkSession, url: str, table: str = "offers", properties: dict | None = None,
                     lower: str = "2020-01-01", upper: str = "2030-01-01", partitions: int = 64) -> DataFrame:
    """Parallel JDBC scan split on created_at; secret columns are not selected."""
    cols = ", ".join(c for c in S.OFFER_COLUMNS)
    df = spark.read.jdbc(url, f"(SELECT {cols} FROM {table}) t", column="created_at",
                         lowerBound=lower, upperBound=upper, numPartitions=partitions,
                         properties=properties or {})
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.OFFER_SCHEMA.fields])


def bloom_filtered(writer, *columns: str):
    """Parquet Bloom filters on point-lookup columns: a scan for one value skips the row groups that
    cannot hold it, though the files are sorted by time and every row group spans all ids."""
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return writer


def write_offers(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a snapshot partitioned by creation month; with dynamic partition
    overwrite only the months present in ``df`` are replaced."""
    writer = _time_ranged(df).withColumn(PARTITION_COL, _month()).write.mode(mode).option("partitionOverwriteMode", "dynamic")
    bloom_filtered(writer, "id", "hold_invoice_payment_hash").partitionBy(PARTITION_COL).parquet(path)


def append_offers(new_rows: DataFrame, path: str, as_of: datetime | str) -> DataFrame:
    """Insert funded offers: one row per payment hash (the first by creation
    time, then id), none whose hash is already stored, ``updated_at`` = insertion time. Returns the rows that
    were appended."""
    spark = new_rows.sparkSession
    existing = spark.read.schema(T.StructType([S.OFFER_SCHEMA["hold_invoice_payment_hash"]])).parquet(path)
    first = F.min_by(F.struct(*new_rows.columns), F.struct("created_at", "id"))
    fresh = (new_rows.groupBy("hold_invoice_payment_hash").agg(first.alias("r")).select("r.*")
             .join(existing, "hold_invoice_payment_hash", "left_anti")
             .withColumn("updated_at", ts_lit(as_of))
             .select(*S.OFFER_COLUMNS))
    out = scratch_path(spark, "append-stage")
    fresh.write.parquet(out)  # stage once: the anti-join reads the table we append to
    staged = spark.read.parquet(out)
    writer = _time_ranged(staged).withColumn(PARTITION_COL, _month()).write.mode("append")
    bloom_filtered(writer, "id", "hold_invoice_payment_hash").partitionBy(PARTITION_COL).parquet(path)
    return staged


# ---------------------------------------------------------------------------
# audit
# ---------------------------------------------------------------------------
def read_audit(spark: SparkSession, path: str, parse_metadata: bool = False) -> DataFrame:
    df = spark.read.schema(S.AUDIT_SCHEMA).parquet(path).select(*S.AUDIT_COLUMNS)
    if parse_metadata:
        df = df.withColumn("metadata", F.try_parse_json("metadata"))
    return df


def append_audit(rows: DataFrame, path: str) -> None:
    writer = _time_ranged(rows.select(*S.AUDIT_COLUMNS)).withColumn(PARTITION_COL, _month()).write.mode("append")
    bloom_filtered(writer, "id", "offer_id").partitionBy(PARTITION_COL).parquet(path)


# ---------------------------------------------------------------------------
# rates, reports, order events
# ---------------------------------------------------------------------------
def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """Rate payloads stored as JSON lines (one fetch answer per line)."""
    return spark.read.schema(RATE_PAYLOAD_SCHEMA).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") \
        .json(path)


def write_rates(payloads: DataFrame, path: str) -> None:
    (payloads.select(*RATE_PAYLOAD_SCHEMA.names).write.mode("overwrite")
     .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path))


def report_json(rows: DataFrame, totals: DataFrame, domains: DataFrame, weekdays: DataFrame) -> DataFrame:
    """The dashboard document {rows, totals, takerDomainRanking,
    weekdaySuccess} as one JSON string. The inputs are report results (one row per
    period, 1, one per domain, and 7), collected into arrays of one cell; where
    domains are very many, `report_sections` keeps every entry a row of its own."""
    def arr(df: DataFrame, name: str, key) -> DataFrame:
        items = F.collect_list(F.struct(key.alias("k"), F.struct(*df.columns).alias("v")))
        return df.agg(F.transform(F.array_sort(items), lambda x: x["v"]).alias(name))

    day_num = F.create_map(*[F.lit(x) for d in S.WEEKDAYS for x in (d[1], d[0])])
    r = arr(rows, "rows", F.col("date"))
    d = arr(domains, "takerDomainRanking", F.struct(-F.col("avg_fees_percentage"), F.col("taker_domain")))
    w = arr(weekdays, "weekdaySuccess", day_num[F.col("weekday")])
    t = totals.select(F.struct(*totals.columns).alias("totals"))
    doc = r.crossJoin(t).crossJoin(d).crossJoin(w)  # four one-row frames
    return doc.select(F.to_json(F.struct("rows", "totals", "takerDomainRanking", "weekdaySuccess"),
                                {"ignoreNullFields": "false"}).alias("report"))


def report_sections(offers: DataFrame, group_by: str = "weekly") -> DataFrame:
    """The dashboard document as one row per entry. The offers are scanned once, into day states by taker
    domain that are stored in the shared folder; the four sections are merged from these."""
    path = scratch_path(offers.sparkSession, "report-states")
    states = RU.domain_states(offers)
    states.write.parquet(path)
    return RU.report_sections(offers.sparkSession.read.schema(states.schema).parquet(path), group_by)


def write_sections(sections: DataFrame, path: str) -> None:
    """Entries as JSON lines in a folder per section, in the document's order over the files' names."""
    order = [F.col("section"), F.col("rank").desc_nulls_last(), F.col("name")]
    sections.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("section").json(path)


def publish_orders(events: DataFrame, path: str) -> None:
    """File sink for order events (JSON lines); a streaming job reuses it
    from ``foreachBatch``."""
    events.write.mode("append").json(path)


# ---------------------------------------------------------------------------
# co-located layout for repeated joins on the offer id
# ---------------------------------------------------------------------------
def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Store ``df`` bucketed and sorted by ``key`` as an external table.

    Offers, action logs, status events and change feeds all join on the
    offer id; written with the same bucket count on that key, their joins
    (validation, replay, update application, change enrichment) read
    co-partitioned files and need no shuffle of either side."""
    spark = df.sparkSession
    location = path or scratch_path(spark, f"bucketed-{table}")
    (df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
     .option("path", location).saveAsTable(table))
    return spark.table(table)
