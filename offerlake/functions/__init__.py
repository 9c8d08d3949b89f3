"""Column helpers shared by the operators (all built-in Spark expressions)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerlake import schema as S


def ts_lit(value: datetime | str) -> Column:
    """A TIMESTAMP_NTZ literal (source timestamps are NTZ, clock is UTC)."""
    if isinstance(value, datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(value).cast("timestamp_ntz")


def micros_between(start: str | Column, end: str | Column) -> Column:
    """end - start in microseconds (NULL if either side is NULL)."""
    s = F.col(start) if isinstance(start, str) else start
    e = F.col(end) if isinstance(end, str) else end
    return F.timestamp_diff("MICROSECOND", s, e)


def plus_seconds(ts: str | Column, seconds: int | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    n = F.lit(seconds) if isinstance(seconds, int) else seconds
    return c + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n)


EPOCH_NTZ = "1970-01-01 00:00:00"


def epoch_ms(ts: str | Column) -> Column:
    """Epoch milliseconds of a UTC wall-clock TIMESTAMP_NTZ (independent of
    the session time zone)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MILLISECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), c)


def epoch_us(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), c)


def epoch_s(ts: str | Column) -> Column:
    """Epoch seconds, truncated (ms // 1000)."""
    return F.floor(epoch_ms(ts) / 1000).cast("bigint")


def iso_week_label(ts: str | Column) -> Column:
    """ISO week label 'IYYY-"W"IW', e.g. 2024-W01."""
    c = F.col(ts) if isinstance(ts, str) else ts
    d = F.to_date(c)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def iso_weekday(ts: str | Column) -> Column:
    """ISO day of week, 1 = Monday ... 7 = Sunday."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return (F.weekday(F.to_date(c)) + 1).cast("int")


def fee_ceil(sats: str | Column, pct: float | Column) -> Column:
    """ceil(sats * pct / 100) in DOUBLE, evaluated left to right."""
    s = F.col(sats) if isinstance(sats, str) else sats
    p = F.lit(pct) if not isinstance(pct, Column) else pct
    return F.ceil(s.cast("double") * p / F.lit(100.0)).cast("bigint")


def uuid_of(n: str | Column) -> Column:
    c = F.col(n) if isinstance(n, str) else n
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(c.cast("string"), 12, "0"))


def dec(c: Column, precision: int = 20, scale: int = 0) -> Column:
    return c.cast(f"decimal({precision},{scale})")


def exact_ratio(num: Column, den: Column) -> Column:
    """num / den in DECIMAL (18 fractional digits), NULL when den is 0 or NULL."""
    return dec(num) / F.nullif(dec(den), F.lit(0))


def round2(c: Column) -> Column:
    return F.round(c, 2).cast("decimal(18,2)")


def is_success() -> Column:
    return F.col("status") == S.SUCCESS_STATUS


def is_failed() -> Column:
    return F.col("status").isin(S.FAILED_STATUSES)


def feed_status(status: str | Column) -> Column:
    c = F.col(status) if isinstance(status, str) else status
    m = F.create_map(*[F.lit(x) for kv in S.FEED_STATUS.items() for x in kv])
    return m[c]


def public_view(with_pubkeys: bool = False, blank_hash: bool = False) -> list[Column]:
    """The API projection of an offer: epoch-ms times, no secrets."""
    cols = [
        F.col("id"),
        epoch_ms("created_at").alias("created_at"),
        epoch_ms("reserved_at").alias("reserved_at"),
        epoch_ms("blik_received_at").alias("blik_received_at"),
        epoch_ms("settled_at").alias("settled_at"),
        F.col("fiat_amount").cast("double").alias("fiat_amount"),
        F.col("fiat_currency"),
        F.col("amount_sats"),
        F.col("maker_fees"),
        F.col("status"),
        (F.lit("") if blank_hash else F.col("hold_invoice_payment_hash")).alias("hold_invoice_payment_hash"),
        epoch_ms("taker_paid_at").alias("taker_paid_at"),
        F.col("taker_fees"),
    ]
    if with_pubkeys:
        cols += [F.col("maker_pubkey"), F.col("taker_pubkey")]
    return cols
