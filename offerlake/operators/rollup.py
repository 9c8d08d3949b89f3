"""Reports from day states: partial results that merge.

`day_states` reduces the offers of each day to sums and counts from which every
metric of `reports` follows: weekly, monthly and total reports are then merges of
day rows, however many offers the days hold. States are stored by month;
`refresh` works out again only the months in which days changed (as
`snapshots.changed_months` names them) and replaces their rows. A metric of a
merged state equals that of a full scan, as sums and non-null counts are exact
(integers and decimals). Offers without a creation time form a day of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake import schema as S
from offerlake.functions import dec, exact_ratio, is_failed, is_success, iso_week_label, iso_weekday, micros_between, round2
from offerlake.operators.reports import weekday_rows

MONTH = "month"
STATE = ("day DATE, failed BIGINT, success BIGINT, profit BIGINT, volume DECIMAL(38,2), volume_sats BIGINT, fee_sum BIGINT, fee_n BIGINT, "
         "reserved_us DECIMAL(38,0), reserved_n BIGINT, total_us DECIMAL(38,0), total_n BIGINT, ratio_sum DECIMAL(38,12), ratio_n BIGINT")


def _ratio() -> Column:
    """An offer's invoice fees as a share of its net amount, as `reports` averages it."""
    return dec(F.col("taker_invoice_fees")) * 100 / F.nullif(dec(F.col("amount_sats") - F.col("taker_fees")), F.lit(0))


def day_states(offers: DataFrame) -> DataFrame:
    """One row per day of creation: sums and counts of its offers, and the day's month."""
    states = offers.groupBy(F.to_date("created_at").alias("day")).agg(*_sums())
    return states.withColumn(MONTH, F.coalesce(F.date_format("day", "yyyy-MM"), F.lit("none")))


def _sums() -> list[Column]:
    won = lambda c: F.when(is_success(), c)
    reserved, total = won(micros_between("created_at", "reserved_at")), won(micros_between("created_at", "maker_confirmed_at"))
    fees, ratio = won(F.col("taker_invoice_fees")), won(_ratio())
    return [
        F.count_if(is_failed()).alias("failed"), F.count_if(is_success()).alias("success"),
        F.sum(won(F.col("maker_fees") + F.col("taker_fees") - F.col("taker_invoice_fees"))).cast("bigint").alias("profit"),
        F.sum(won(F.col("fiat_amount"))).cast("decimal(38,2)").alias("volume"), F.sum(won(F.col("amount_sats"))).cast("bigint").alias("volume_sats"),
        F.sum(fees).cast("bigint").alias("fee_sum"), F.count(fees).alias("fee_n"),
        F.sum(reserved.cast("decimal(28,0)")).alias("reserved_us"), F.count(reserved).alias("reserved_n"),
        F.sum(total.cast("decimal(28,0)")).alias("total_us"), F.count(total).alias("total_n"),
        F.sum(ratio).cast("decimal(38,12)").alias("ratio_sum"), F.count(ratio).alias("ratio_n")]


def write_states(offers: DataFrame, path: str) -> None:
    """The states of all days, a folder per month."""
    day_states(offers).repartition(MONTH).write.mode("overwrite").partitionBy(MONTH).parquet(path)


def refresh(offers: DataFrame, path: str, months: list[str]) -> None:
    """Replace the states of ``months`` (yyyy-MM, or none) by those of ``offers``; months without offers become empty.

    ``offers`` is filtered by month of creation, which prunes a store that is partitioned by it.
    """
    spark = offers.sparkSession
    dated = sorted(m for m in months if m != "none")
    inside = F.lit(False)
    for m in dated:  # ranges of time, so that the filter reaches the scan
        begin = F.to_timestamp_ntz(F.lit(f"{m}-01 00:00:00"))
        inside = inside | ((F.col("created_at") >= begin) & (F.col("created_at") < begin + F.expr("INTERVAL 1 MONTH")))
    if "none" in months:
        inside = inside | F.col("created_at").isNull()
    fresh = day_states(offers.where(inside))
    empty = spark.createDataFrame([(m,) for m in months], f"{MONTH} STRING").join(fresh.select(MONTH).distinct(), MONTH, "left_anti")
    kept = fresh.unionByName(empty, allowMissingColumns=True)  # a month that lost all offers is written as a row without any
    kept.repartition(MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{STATE}, {MONTH} STRING").parquet(path).where(F.col("failed").isNotNull())


def _merged(prefix: str) -> list[Column]:
    total = lambda c: F.sum(c)
    failed, success = total("failed").cast("bigint"), total("success").cast("bigint")
    failed, success = F.coalesce(failed, F.lit(0).cast("bigint")), F.coalesce(success, F.lit(0).cast("bigint"))
    pct = round2(F.lit(100) - exact_ratio(failed, failed + success) * 100)
    profit = F.coalesce(total("profit"), F.lit(0)).cast("bigint")
    volume = F.coalesce(total("volume"), F.lit(0)).cast("decimal(38,2)")
    volume_sats = F.coalesce(total("volume_sats"), F.lit(0)).cast("bigint")

    def seconds(us: str, n: str) -> Column:
        return F.bround(F.try_divide(total(us).cast("double"), total(n).cast("double")), 0) / F.lit(1_000_000.0)

    fees = round2(F.coalesce(exact_ratio(total("fee_sum"), total("fee_n")), F.lit(0)))
    share = round2(F.coalesce(F.try_divide(total("ratio_sum"), total("ratio_n")), F.lit(0)) * 100)
    reserved, whole = seconds("reserved_us", "reserved_n"), seconds("total_us", "total_n")
    if prefix:
        return [failed.alias("total_failed"), success.alias("total_success"), profit.alias("total_profit"), volume.alias("total_volume"),
                volume_sats.alias("total_volume_sats"), pct.alias("overall_success_percentage"), reserved.alias("overall_avg_reserved_seconds"),
                whole.alias("overall_avg_total_seconds"), fees.alias("overall_avg_taker_invoice_fees"), share.alias("overall_taker_fees_percentage")]
    return [pct.alias("success_percentage"), failed.alias("failed"), success.alias("success"), profit.alias("profit"), volume.alias("volume"),
            volume_sats.alias("volume_sats"), success.alias("success_count"), reserved.alias("avg_reserved_seconds"), whole.alias("avg_total_seconds"),
            fees.alias("avg_taker_invoice_fees"), share.alias("taker_fees_percentage")]


def period_report(states: DataFrame, group_by: str) -> DataFrame:
    """The weekly or monthly report of `reports.metrics_by_period` (UTC), merged from day states."""
    if group_by not in ("weekly", "monthly"):
        raise ValueError("day states merge into weekly or monthly periods")
    unit, label = ("week", iso_week_label(F.col("bucket"))) if group_by == "weekly" else ("month", F.date_format("bucket", "yyyy-MM"))
    per = states.groupBy(F.date_trunc(unit, F.col("day")).cast("timestamp_ntz").alias("bucket")).agg(*_merged(""))
    return per.select(label.alias("date"), *[c for c in per.columns if c != "bucket"])


def totals_report(states: DataFrame) -> DataFrame:
    return states.agg(*_merged("total"))


# -- the dashboard from one scan ---------------------------------------------------
def domain_states(offers: DataFrame) -> DataFrame:
    """Day states by taker domain: one row per day and domain of a paid offer's address; the domain of all others is NULL."""
    addr = F.col("taker_lightning_address")
    domain = F.when(is_success() & addr.like("%@%"), F.split_part(addr, F.lit("@"), F.lit(2)))
    return offers.groupBy(F.to_date("created_at").alias("day"), domain.alias("taker_domain")).agg(F.count("*").alias("offers"), *_sums())


def domain_report(states: DataFrame) -> DataFrame:
    """`reports.taker_domain_ranking` without its order, merged from domain states."""
    share = round2(F.coalesce(F.try_divide(F.sum("ratio_sum"), F.sum("ratio_n")), F.lit(0)) * 100)
    return states.where(F.col("taker_domain").isNotNull()).groupBy("taker_domain").agg(
        F.sum("offers").cast("bigint").alias("offer_count"), share.alias("avg_fees_percentage"))


def weekday_report(states: DataFrame) -> DataFrame:
    """`reports.weekday_profile`, merged from domain states."""
    return weekday_rows(states.groupBy(iso_weekday("day").alias("day_num")).agg(
        F.sum("success").cast("bigint").alias("success_count"), F.sum("offers").cast("bigint").alias("offer_count"),
        F.min("day").alias("min_d"), F.max("day").alias("max_d")))


def report_sections(states: DataFrame, group_by: str) -> DataFrame:
    """The dashboard document as rows (section, rank, name, entry): an entry is one JSON object.

    No row grows with the data: a ranking of very many domains is as many rows, and `io.write_sections` puts
    them in order. ``rank`` sorts the ranking (falling) and the weekdays (rising as negative numbers); entries
    of equal rank go by name. ``states`` is read once per section: store it (`io.report_sections`).
    """
    def rows(section: str, report: DataFrame, rank: Column, name: Column) -> DataFrame:
        entry = F.to_json(F.struct(*report.columns), {"ignoreNullFields": "false"})
        return report.select(F.lit(section).alias("section"), rank.cast("decimal(38,2)").alias("rank"), name.alias("name"), entry.alias("entry"))

    none, day_num = F.lit(None), F.create_map(*[F.lit(x) for d in S.WEEKDAYS for x in (d[1], d[0])])
    periods, totals, domains, days = period_report(states, group_by), totals_report(states), domain_report(states), weekday_report(states)
    return (rows("rows", periods, none, F.col("date")).unionAll(rows("totals", totals, none, F.lit("totals")))
            .unionAll(rows("takerDomainRanking", domains, F.col("avg_fees_percentage"), F.col("taker_domain")))
            .unionAll(rows("weekdaySuccess", days, -day_num[F.col("weekday")], F.col("weekday"))))
