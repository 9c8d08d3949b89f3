"""Invoice and payment event reduction.

Per-key reductions use min_by / max_by aggregates (partial aggregation on
the map side), never a collected list, so a payment hash with a huge number
of updates costs the same as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake import schema as S

INVOICE_STATUSES = ["OPEN", "ACCEPTED", "SETTLED", "CANCELED", "UNKNOWN"]
TERMINAL_PAYMENT = ["SUCCEEDED", "FAILED"]


def _map_lookup(mapping: dict[str, str], key: Column, default: str) -> Column:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(m[key], F.lit(default))


def invoice_status(backend: Column, raw: Column) -> Column:
    """Wire state (first backend) or notification type (second backend) ->
    invoice status; anything else is UNKNOWN."""
    return F.when(backend == "lnd", _map_lookup(S.LND_INVOICE_STATES, raw, "UNKNOWN")) \
        .otherwise(_map_lookup(S.NWC_NOTIFICATIONS, raw, "UNKNOWN"))


def normalize_invoice_updates(updates: DataFrame) -> DataFrame:
    status = invoice_status(F.col("backend"), F.col("raw_state"))
    amount = F.when((F.col("backend") == "lnd") & (F.col("raw_state") == "SETTLED"), F.col("amount_paid_sat"))
    return updates.select("backend", "payment_hash", "seq", status.alias("status"),
                          amount.cast("bigint").alias("amount_paid_sat"), "ts")


def normalize_invoice_details(raw: DataFrame) -> DataFrame:
    """Invoice lookups -> common detail record. First backend: value in sats
    (x1000 for msat), settle_date 0 = not settled, expiry relative to
    creation. Second backend: values already in msat, status inferred from
    the settle time."""
    lnd = F.col("backend") == "lnd"
    status = F.when(lnd, _map_lookup(S.LND_INVOICE_STATES, F.col("state"), "UNKNOWN")) \
        .otherwise(F.when(F.col("settle_date") > 0, "SETTLED").otherwise("OPEN"))
    return raw.select(
        "payment_hash", "backend",
        F.when(lnd, F.col("value") * 1000).otherwise(F.col("value")).cast("bigint").alias("amount_msat"),
        F.col("creation_date").cast("bigint").alias("created_at"),
        F.when(lnd, F.nullif(F.col("settle_date"), F.lit(0))).otherwise(F.col("settle_date")).cast("bigint")
        .alias("settled_at"),
        (F.col("creation_date") + F.col("expiry")).cast("bigint").alias("expires_at"),
        status.alias("status"),
        F.col("memo").alias("description"),
        F.lit("incoming").alias("type"))


def invoice_status_latest(normalized: DataFrame) -> DataFrame:
    """Current status per payment hash, and the first ACCEPTED update (the
    one that funds an offer; later updates do not fund again)."""
    accepted = F.col("status") == "ACCEPTED"
    return normalized.groupBy("payment_hash").agg(
        F.max_by("status", "seq").alias("latest_status"),
        F.max("seq").alias("latest_seq"),
        F.min(F.when(accepted, F.col("ts"))).alias("first_accepted_at"),
        F.min(F.when(accepted, F.col("seq"))).alias("first_accepted_seq"),
        F.count_if(F.col("status") == "CANCELED").alias("canceled_updates"),
        F.count(F.lit(1)).alias("updates"))


def filter_invoice_updates(normalized: DataFrame, hashes: DataFrame, hash_col: str = "payment_hash") -> DataFrame:
    keys = hashes.select(F.col(hash_col).alias("payment_hash")).where(F.col("payment_hash").isNotNull())
    return normalized.join(keys, "payment_hash", "left_semi")


def payment_outcome(updates: DataFrame) -> DataFrame:
    """First terminal update of the send stream, else of the tracking
    stream, else 'no definitive status'."""
    terminal = F.col("raw_status").isin(TERMINAL_PAYMENT)
    row = F.struct("raw_status", "fee_sat", "preimage", "failure_reason", "stream", "seq")
    order = F.struct(F.when(F.col("stream") == "send", 0).otherwise(1), F.col("seq"))
    agg = updates.groupBy("payment_hash").agg(
        F.min_by(F.when(terminal, row), F.when(terminal, order)).alias("t"))
    none = F.col("t").isNull()
    return agg.select(
        "payment_hash",
        F.when(none, "UNKNOWN").otherwise(F.col("t.raw_status")).alias("status"),
        F.when(F.col("t.raw_status") == "SUCCEEDED", F.col("t.fee_sat")).cast("bigint").alias("fee_sat"),
        F.when(F.col("t.raw_status") == "SUCCEEDED", F.col("t.preimage")).alias("preimage"),
        (F.when(none, F.lit(S.MESSAGES["no_definitive_status"]))
         .when(F.col("t.raw_status") == "FAILED", F.col("t.failure_reason"))).alias("error"),
        F.col("t.stream").alias("decided_by"))


def payment_result(outcomes: DataFrame) -> DataFrame:
    """Success = no error and a preimage; a missing fee is stored as 0."""
    ok = F.col("error").isNull() & F.col("preimage").isNotNull()
    return outcomes.select("payment_hash", ok.alias("is_success"),
                           F.when(ok, F.coalesce(F.col("fee_sat"), F.lit(0))).cast("bigint").alias("stored_fee_sat"),
                           "error")


def payment_failures(outcomes: DataFrame) -> DataFrame:
    return (outcomes.where(F.col("error").isNotNull())
            .groupBy(F.col("error").alias("reason")).agg(F.count(F.lit(1)).alias("failures")))
