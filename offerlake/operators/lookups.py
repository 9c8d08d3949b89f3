"""Offer and audit lookups, listings and the public projection.

Point lookups take a DataFrame of keys (the batch form of "WHERE id = ?")
and use a left-semi join; Spark/AQE picks a broadcast only when the key
side measures small at run time. Listings are top-k: a global one becomes
TakeOrderedAndProject; a per-group one is ``row_number() <= k`` which the
optimizer turns into a partial WindowGroupLimit before the shuffle, so a hot
group ships at most k rows per map partition.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake import schema as S
from offerlake.functions import epoch_us, public_view, ts_lit


def offer_by_id(offers: DataFrame, offer_id: str) -> DataFrame:
    return offers.where(F.col("id") == offer_id).limit(1)


def offers_by_ids(offers: DataFrame, ids: DataFrame, id_col: str = "offer_id",
                  columns: list[str] | None = None) -> DataFrame:
    """Batch form of offer_by_id: the listing columns of every offer whose id
    appears in ``ids``."""
    keys = ids.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull())
    out = offers.join(keys, "id", "left_semi")
    return out.select(*(columns or S.LISTING_COLUMNS))


def offer_by_payment_hash(offers: DataFrame, hashes: DataFrame, hash_col: str = "payment_hash") -> DataFrame:
    keys = hashes.select(F.col(hash_col).alias("hold_invoice_payment_hash"))
    return offers.join(keys, "hold_invoice_payment_hash", "left_semi").select(*S.OFFER_COLUMNS)


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int,
                    offset: int = 0, rank_col: str | None = None) -> DataFrame:
    """Rows ``offset+1 .. offset+k`` of each group in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rn = F.row_number().over(w)
    out = df.withColumn("_rn", rn).where((F.col("_rn") > offset) & (F.col("_rn") <= offset + k))
    if rank_col:
        return out.withColumn(rank_col, F.col("_rn").cast("bigint")).drop("_rn")
    return out.drop("_rn")


def offers_by_status(offers: DataFrame, status: str | None = None, limit: int = S.LISTING_LIMIT,
                     offset: int = 0) -> DataFrame:
    """Newest first (id breaks ties). With ``status=None`` every status gets
    its own page."""
    order = [F.col("created_at").desc(), F.col("id")]
    if status is not None:
        return offers.where(F.col("status") == status).orderBy(*order).offset(offset).limit(limit)
    return top_k_per_group(offers, ["status"], order, limit, offset)


def _user_roles(offers: DataFrame) -> DataFrame:
    users = F.array_compact(F.array_distinct(F.array(F.col("maker_pubkey"), F.col("taker_pubkey"))))
    return offers.select(F.explode(users).alias("user_pubkey"), "*")


def my_active_offers(offers: DataFrame, user: str | None = None) -> DataFrame:
    """Offers where the user is maker or taker and the status is active.
    ``user=None`` gives the list of every user (one row per user and offer)."""
    active = offers.where(F.col("status").isin(S.ACTIVE_STATUSES))
    if user is not None:
        return (active.where((F.col("maker_pubkey") == user) | (F.col("taker_pubkey") == user))
                .orderBy(F.col("created_at").desc(), F.col("id")))
    return _user_roles(active)


def my_active_offer(offers: DataFrame) -> DataFrame:
    """Newest active offer per user (ties: smallest id), with pubkeys.

    An aggregate (min_by over a (-created, id) key) rather than a window, so
    partial aggregation absorbs users with very many offers.
    """
    roles = my_active_offers(offers)
    key = F.struct((-epoch_us("created_at")).alias("t"), F.col("id").alias("i"))
    row = F.struct(*public_view(with_pubkeys=True))
    return (roles.groupBy("user_pubkey").agg(F.min_by(row, key).alias("o"))
            .select("user_pubkey", "o.*"))


def my_finished_offers(offers: DataFrame, as_of: datetime | str) -> DataFrame:
    """Active offers filtered by "(not expired and not cancelled) or paid
    less than 24 full hours ago". ``&&`` binds tighter than ``||`` and the
    active list already excludes expired/cancelled, so every active offer
    passes - kept as in the original."""
    roles = my_active_offers(offers)
    hours = F.floor(F.timestamp_diff("MICROSECOND", F.col("taker_paid_at"), ts_lit(as_of)) / 3_600_000_000)
    keep = (~F.col("status").isin("expired", "cancelled")) | (F.col("taker_paid_at").isNotNull() & (hours < 24))
    return roles.where(keep).select("user_pubkey", *public_view(with_pubkeys=True))


def offers_last_hours(offers: DataFrame, as_of: datetime | str, hours: int = S.REBROADCAST_HOURS) -> DataFrame:
    cutoff = ts_lit(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))
    return offers.where(F.col("created_at") >= cutoff).orderBy(F.col("created_at").desc(), F.col("id"))


def recent_offers(offers: DataFrame, limit: int = S.LISTING_LIMIT) -> DataFrame:
    return (offers.orderBy(F.coalesce("updated_at", "created_at").desc(), F.col("id"))
            .limit(limit).select(*S.LISTING_COLUMNS))


def audit_by_offer(audit: DataFrame, offer_id: str | None = None, limit: int = S.LISTING_LIMIT) -> DataFrame:
    """Newest audit lines of one offer, or (offer_id=None) of every offer."""
    order = [F.col("created_at").desc(), F.col("id").desc()]
    if offer_id is not None:
        return audit.where(F.col("offer_id") == offer_id).orderBy(*order).limit(limit)
    return top_k_per_group(audit.where(F.col("offer_id").isNotNull()), ["offer_id"], order, limit)


def audit_by_ids(audit: DataFrame, ids: DataFrame, id_col: str = "audit_id") -> DataFrame:
    keys = ids.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull())
    return audit.join(keys, "id", "left_semi").select(*S.AUDIT_COLUMNS)


def offer_public_view(offers: DataFrame, with_pubkeys: bool = False) -> DataFrame:
    return offers.select(*public_view(with_pubkeys=with_pubkeys))
