"""Offer reports: period metrics, totals, domain ranking, weekday profile,
success statistics, sweep summary and fiat profit.

All reports are one scan of `offers` feeding a two-phase hash aggregate with
conditional aggregates (map-side partial aggregation, so a hot period or
domain never funnels raw rows into one task). Date filters are plain
predicates on `created_at` and reach the Parquet scan / partition pruning.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake import schema as S
from offerlake.functions import (dec, exact_ratio, is_failed, is_success,
                                 iso_week_label, iso_weekday, micros_between, plus_seconds,
                                 public_view, round2, ts_lit)

PERIODS = ("daily", "weekly", "monthly")


def _avg_seconds(start: str, end: str) -> Column:
    """AVG(end - start) over successful offers, as epoch seconds of an
    interval rounded to whole microseconds (half-even, like an interval
    average)."""
    us = F.when(is_success(), micros_between(start, end))
    avg_us = F.bround(F.try_divide(F.sum(us).cast("double"), F.count(us).cast("double")), 0)
    return avg_us / F.lit(1_000_000.0)


def _fee_pct() -> Column:
    """Taker invoice fees as % of the net amount, averaged, times 100."""
    ratio = F.when(is_success(),
                   dec(F.col("taker_invoice_fees")) * 100
                   / F.nullif(dec(F.col("amount_sats") - F.col("taker_fees")), F.lit(0)))
    return round2(F.coalesce(F.avg(ratio), F.lit(0)) * 100)


def metric_columns(prefix: str = "") -> list[Column]:
    """The shared metric set. ``prefix='total'`` gives the totals naming."""
    failed = F.count_if(is_failed())
    success = F.count_if(is_success())
    pct = round2(F.lit(100) - exact_ratio(failed, failed + success) * 100)
    profit = F.coalesce(F.sum(F.when(is_success(), F.col("maker_fees") + F.col("taker_fees")
                                     - F.col("taker_invoice_fees"))), F.lit(0)).cast("bigint")
    volume = F.coalesce(F.sum(F.when(is_success(), F.col("fiat_amount"))),
                        F.lit(0)).cast("decimal(38,2)")
    volume_sats = F.coalesce(F.sum(F.when(is_success(), F.col("amount_sats"))), F.lit(0)).cast("bigint")
    fees = F.when(is_success(), F.col("taker_invoice_fees"))
    avg_fees = round2(F.coalesce(exact_ratio(F.sum(fees), F.count(fees)), F.lit(0)))
    if prefix:
        t, o = "total_", "overall_"
        return [failed.alias(t + "failed"), success.alias(t + "success"), profit.alias(t + "profit"),
                volume.alias(t + "volume"), volume_sats.alias(t + "volume_sats"),
                pct.alias(o + "success_percentage"),
                _avg_seconds("created_at", "reserved_at").alias(o + "avg_reserved_seconds"),
                _avg_seconds("created_at", "maker_confirmed_at").alias(o + "avg_total_seconds"),
                avg_fees.alias(o + "avg_taker_invoice_fees"),
                _fee_pct().alias(o + "taker_fees_percentage")]
    return [pct.alias("success_percentage"), failed.alias("failed"), success.alias("success"),
            profit.alias("profit"), volume.alias("volume"), volume_sats.alias("volume_sats"),
            success.alias("success_count"),
            _avg_seconds("created_at", "reserved_at").alias("avg_reserved_seconds"),
            _avg_seconds("created_at", "maker_confirmed_at").alias("avg_total_seconds"),
            avg_fees.alias("avg_taker_invoice_fees"), _fee_pct().alias("taker_fees_percentage")]


def _local(col: str, tz: str) -> Column:
    c = F.col(col)
    if tz.upper() == "UTC":
        return c
    return F.from_utc_timestamp(c.cast("timestamp"), tz).cast("timestamp_ntz")


def metrics_by_period(offers: DataFrame, group_by: str, as_of: datetime | str,
                      tz: str = "UTC") -> DataFrame:
    """Per-period metrics. ``group_by`` is daily / weekly / monthly.

    daily covers the last 29 x 24 h before ``as_of`` (not midnight aligned);
    weekly and monthly cover all history, every period of it.
    """
    if group_by not in PERIODS:
        raise ValueError(f"Invalid groupBy parameter. Must be one of: {', '.join(PERIODS)}")
    df = offers
    local = _local("created_at", tz)
    if group_by == "daily":
        df = df.where(F.col("created_at") >= ts_lit(as_of) - F.expr(f"INTERVAL {S.DAILY_WINDOW_DAYS} DAYS"))
        bucket = F.to_date(local)
        label = F.date_format(F.col("bucket"), "yyyy-MM-dd")
    elif group_by == "weekly":
        bucket = F.date_trunc("week", local).cast("timestamp_ntz")
        label = iso_week_label(F.col("bucket"))
    else:
        bucket = F.date_trunc("month", local).cast("timestamp_ntz")
        label = F.date_format(F.col("bucket"), "yyyy-MM")
    agg = df.groupBy(bucket.alias("bucket")).agg(*metric_columns())
    names = [c for c in agg.columns if c != "bucket"]
    return agg.select(label.alias("date"), *names)


def metrics_totals(offers: DataFrame) -> DataFrame:
    return offers.agg(*metric_columns(prefix="total"))


def taker_domain_ranking(offers: DataFrame) -> DataFrame:
    addr = F.col("taker_lightning_address")
    return (offers
            .where(is_success() & addr.isNotNull() & addr.like("%@%"))
            .groupBy(F.split_part(addr, F.lit("@"), F.lit(2)).alias("taker_domain"))
            .agg(F.count(F.lit(1)).alias("offer_count"), _fee_pct().alias("avg_fees_percentage"))
            .orderBy(F.col("avg_fees_percentage").desc(), F.col("taker_domain")))


def weekday_profile(offers: DataFrame, weekdays: DataFrame | None = None) -> DataFrame:
    """Success count and average offers per calendar day, by ISO weekday.

    The original expands a dense calendar from the first to the last offer
    date and left-joins daily counts. Here the number of calendar days of
    each weekday in that range is computed arithmetically from the two
    bounds, so the plan is one scan + a 7-key aggregate; the bounds come
    from a window over those (at most 7) aggregated rows, and no calendar
    whose size grows with the date span is materialised or broadcast.
    A weekday without offers gets 0 / 0, as in the original.
    """
    d = F.to_date(F.col("created_at"))
    per_day = (offers.groupBy(iso_weekday("created_at").alias("day_num"))
               .agg(F.count_if(is_success()).alias("success_count"),
                    F.count(F.lit(1)).alias("offer_count"),
                    F.min(d).alias("min_d"), F.max(d).alias("max_d")))
    return weekday_rows(per_day, weekdays)


def weekday_rows(per_day: DataFrame, weekdays: DataFrame | None = None) -> DataFrame:
    """The weekday profile of at most 7 rows (day_num, success_count, offer_count, min_d, max_d), one per weekday."""
    if weekdays is None:
        weekdays = per_day.sparkSession.createDataFrame(S.WEEKDAYS, "day_num INT, day_name STRING")
    every = Window.partitionBy()  # at most 7 rows
    lo, hi = F.min("min_d").over(every), F.max("max_d").over(every)
    n_days = F.datediff(hi, lo) + 1
    offset = (F.col("day_num") - (F.weekday(lo) + 1) + 7) % 7
    days_w = F.when(offset >= n_days, F.lit(0)).otherwise(F.floor((n_days - 1 - offset) / 7) + 1)
    stats = per_day.select("day_num", "success_count",
                           round2(exact_ratio(F.col("offer_count"), days_w)).alias("avg_offer_count"))
    # 7-row literal and a <= 7-row result: both sides have a fixed size.
    out = F.broadcast(weekdays).join(F.broadcast(stats), "day_num", "left")
    return (out.select(
        F.col("day_name").alias("weekday"),
        F.coalesce(F.col("success_count"), F.lit(0)).cast("bigint").alias("success_count"),
        F.coalesce(F.col("avg_offer_count"), F.lit(0).cast("decimal(18,2)")).alias("avg_offer_count"),
        F.col("day_num"))
        .orderBy("day_num").drop("day_num"))


def success_stats(offers: DataFrame, as_of: datetime | str) -> DataFrame:
    """Average seconds created -> BLIK received and created -> taker paid,
    lifetime and last 7 days (strictly after as_of - 7 d).

    Durations are summed, truncated to whole seconds, divided by the count
    and rounded half away from zero; 0 when there is nothing to average.
    """
    paid = offers.where(is_success())
    recent = F.col("created_at") > ts_lit(as_of) - F.expr("INTERVAL 7 DAYS")

    def avg_s(end: str, cond: Column | None) -> Column:
        us = micros_between("created_at", end)
        if cond is not None:
            us = F.when(cond, us)
        secs = F.floor(F.sum(us) / 1_000_000)
        n = F.count(us)
        return F.when(n > 0, F.round(secs / n, 0)).otherwise(F.lit(0)).cast("bigint")

    return paid.agg(
        avg_s("blik_received_at", None).alias("lifetime_avg_blik_received_seconds"),
        avg_s("taker_paid_at", None).alias("lifetime_avg_taker_paid_seconds"),
        F.count(F.lit(1)).alias("lifetime_count"),
        avg_s("blik_received_at", recent).alias("last7_avg_blik_received_seconds"),
        avg_s("taker_paid_at", recent).alias("last7_avg_taker_paid_seconds"),
        F.count_if(recent).alias("last7_count"),
    )


def recent_successes(offers: DataFrame, as_of: datetime | str) -> DataFrame:
    """Paid offers of the last 7 days, public view, payment hash blanked."""
    recent = F.col("created_at") > ts_lit(as_of) - F.expr("INTERVAL 7 DAYS")
    return offers.where(is_success() & recent).select(*public_view(blank_hash=True))


def sweep_summary(offers: DataFrame, as_of: datetime | str) -> DataFrame:
    """How many rows each start-up sweep acts on ('due') and how many are
    still inside their window ('within_window')."""
    now = ts_lit(as_of)
    st = F.col("status")
    rule = (F.when(st == "funded", "funded_expiry")
            .when(st == "reserved", "reservation")
            .when(st.isin("blikReceived", "blikSentToMaker"), "blik_confirmation")
            .when(st == "takerCharged", "taker_charged")
            .when(st == "conflict", "conflict"))
    start = (F.when(st == "funded", plus_seconds("created_at", S.FUNDED_EXPIRY_SECONDS))
             .when(st == "reserved", plus_seconds("reserved_at", S.RESERVATION_SECONDS))
             .when(st.isin("blikReceived", "blikSentToMaker"),
                   plus_seconds("blik_received_at", S.BLIK_CONFIRMATION_SECONDS))
             .when(st == "takerCharged", plus_seconds("created_at", S.TAKER_CHARGED_AUTO_CONFIRM_SECONDS))
             .when(st == "conflict", plus_seconds(F.coalesce("updated_at", "created_at"),
                                                  S.CONFLICT_AUTO_DISPUTE_SECONDS)))
    due = start.isNull() | (now > start)
    return (offers.where(rule.isNotNull())
            .groupBy(rule.alias("rule"), F.when(due, "due").otherwise("within_window").alias("outcome"))
            .agg(F.count(F.lit(1)).alias("offer_count")))


def profit_fiat(report: DataFrame, rate: DataFrame, profit_col: str = "profit",
                out_col: str = "profit_fiat") -> DataFrame:
    """profit (sats) / 1e8 x rate; 0 when the rate or the profit is missing
    or zero. ``rate`` is a one-row DataFrame with column ``rate``."""
    p = F.col(profit_col)
    r = F.col("rate")
    value = F.when(r.isNull() | (r == 0) | p.isNull() | (p == 0), F.lit(0.0)) \
        .otherwise(p.cast("double") / 100000000.0 * r)
    # `rate` is a global aggregate: exactly one row, safe to broadcast.
    return report.crossJoin(F.broadcast(rate.select("rate"))).withColumn(out_col, value).drop("rate")
