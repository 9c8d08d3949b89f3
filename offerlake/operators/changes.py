"""Joins of change events with current rows, funding of quotes, and the
offer detail view.

Change events are joined to the current tables with plain equi-joins
(Spark picks broadcast only when a side measures small; AQE splits skewed
partitions when one offer receives a large share of the changes). The
"newest audit row per offer" side is a max_by aggregate, so it is one row
per offer before it meets the change stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake import schema as S
from offerlake.functions import uuid_of
from offerlake.sources.io import scratch_path


def changes_enriched(changes: DataFrame, offers: DataFrame) -> DataFrame:
    """Offer change -> current listing row ('offer_changed') or, when the row
    is gone, 'offer_removed'. Changes without an offer id are dropped."""
    rows = offers.select(*S.LISTING_COLUMNS).withColumn("_found", F.lit(True))
    j = (changes.where(F.col("offer_id").isNotNull())
         .join(rows, F.col("offer_id") == F.col("id"), "left"))
    kind = F.when(F.col("_found"), "offer_changed").otherwise("offer_removed")
    return j.select("seq", "operation", "offer_id", kind.alias("type"),
                    *[c for c in S.LISTING_COLUMNS if c != "id"])


AUDIT_VIEW = ["id", "offer_id", "action", "level", "message", "created_at"]


def latest_audit_per_offer(audit: DataFrame) -> DataFrame:
    row = F.struct(*[F.col(c) for c in AUDIT_VIEW])
    return (audit.where(F.col("offer_id").isNotNull())
            .groupBy(F.col("offer_id").alias("_offer"))
            .agg(F.max_by(row, F.struct("created_at", "id")).alias("_latest")))


def audit_changes_enriched(changes: DataFrame, audit: DataFrame) -> DataFrame:
    """Audit change -> the audit row by id; when it is missing and the change
    is not a DELETE, the newest audit row of the offer; DELETE keeps NULL.

    The changes meet the audit once by id; what that leaves open is written,
    and only its offers' audit rows are reduced to the newest. On a stream,
    whose needs are not known beforehand, the newest row is worked out for
    every offer: run a stream by micro-batch instead (`streaming.jobs`)."""
    by_id = audit.select(F.col("id").alias("_aid"), F.struct(*[F.col(c) for c in AUDIT_VIEW]).alias("_row"))
    found = (changes.where(F.col("offer_id").isNotNull())
             .join(by_id, F.col("audit_id") == F.col("_aid"), "left")
             .select("seq", "operation", "offer_id", "audit_id", "_row"))

    def shown(rows: DataFrame, entry) -> DataFrame:
        return rows.select("seq", "operation", "offer_id", "audit_id", F.lit("audit_changed").alias("type"),
                           *[entry[c].alias(f"entry_{c}") for c in AUDIT_VIEW])

    unmet = F.col("_row").isNull() & F.coalesce(F.col("operation") != "DELETE", F.lit(False))
    if changes.isStreaming:
        j = found.join(latest_audit_per_offer(audit), F.col("offer_id") == F.col("_offer"), "left")
        return shown(j, F.coalesce(F.col("_row"), F.when(unmet, F.col("_latest"))))
    path = scratch_path(changes.sparkSession, "audit-changes-met")
    found.write.parquet(path)
    found = changes.sparkSession.read.schema(found.schema).parquet(path)
    left = found.where(unmet)
    wanted = audit.join(left.select(F.col("offer_id").alias("_open")).distinct(), F.col("offer_id") == F.col("_open"), "left_semi")
    newest = left.join(latest_audit_per_offer(wanted), F.col("offer_id") == F.col("_offer"), "left")
    return shown(found.where(~unmet), F.col("_row")).unionByName(shown(newest, F.col("_latest")))


DECISIVE = ["ACCEPTED", "CANCELED", "SETTLED"]


def first_decisions(updates: DataFrame) -> DataFrame:
    """Per payment hash the update that ends its subscription: the first of
    ACCEPTED, CANCELED and SETTLED by ``seq``. On a stream (update mode) the
    state is one row per hash and does not depend on the order of arrival."""
    return (updates.where(F.col("status").isin(DECISIVE)).groupBy("payment_hash")
            .agg(F.min_by(F.struct("status", "ts", "seq"), F.col("seq")).alias("d")).select("payment_hash", "d.*"))


def fund_offers(quotes: DataFrame, updates: DataFrame, offers: DataFrame) -> DataFrame:
    """Quotes (priced, with amounts) + hold-invoice updates -> funding
    outcome per quote, and the new funded offer row.

    Per payment hash the first ACCEPTED / CANCELED / SETTLED update decides
    (later updates change nothing, however late they come). ACCEPTED with a
    hash that already has an offer is reported as already_exists and not
    inserted."""
    first = first_decisions(updates).select("payment_hash", F.struct("status", "ts").alias("_d"))
    existing = offers.select(F.col("hold_invoice_payment_hash").alias("payment_hash")).withColumn("_exists", F.lit(True))
    return funding_rows(quotes.join(first, "payment_hash", "left").join(existing, "payment_hash", "left"))


def funding_rows(joined: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Outcome and offer row of quotes with their decision ``_d`` and ``_exists`` (an offer has the hash)."""
    outcome = (F.when(F.col("_d").isNull(), "pending")
               .when(F.col("_d.status") == "CANCELED", "canceled")
               .when(F.col("_d.status") == "SETTLED", "settled")
               .when(F.col("amount_sats").isNull(), "no_quote")
               .when(F.coalesce(F.col("_exists"), F.lit(False)), "already_exists")
               .otherwise("funded"))
    funded = outcome == "funded"
    return joined.select(
        *(carry or []), "quote_id", "payment_hash", outcome.alias("outcome"),
        F.when(funded, uuid_of(F.col("quote_id") + F.lit(100000000000))).alias("id"),
        F.when(funded, F.col("amount_sats")).alias("amount_sats"),
        F.when(funded, F.col("maker_fees")).alias("maker_fees"),
        F.when(funded, F.col("taker_fees")).alias("taker_fees"),
        F.when(funded, F.col("maker_id")).alias("maker_pubkey"),
        F.when(funded, F.lit("funded")).alias("status"),
        F.when(funded, F.col("_d.ts")).alias("created_at"),
        F.when(funded, F.col("fiat_amount").cast("decimal(18,2)")).alias("fiat_amount"))


def offers_with_audit(offers: DataFrame, audit: DataFrame, limit: int = S.LISTING_LIMIT) -> DataFrame:
    """Detail view: each offer's listing columns with its newest audit lines;
    an offer without any is one row with NULL audit columns."""
    from offerlake.operators.lookups import top_k_per_group
    top = top_k_per_group(audit.where(F.col("offer_id").isNotNull()), ["offer_id"],
                          [F.col("created_at").desc(), F.col("id").desc()], limit, rank_col="audit_rank")
    lines = top.select(F.col("offer_id").alias("id"), F.col("id").alias("audit_id"), "audit_rank",
                       F.col("action").alias("audit_action"), F.col("message").alias("audit_message"),
                       F.col("created_at").alias("audit_created_at"))
    return offers.select(*S.LISTING_COLUMNS).join(lines, "id", "left")
