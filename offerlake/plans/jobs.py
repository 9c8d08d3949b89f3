"""Composed batch jobs over stored tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from offerlake import schema as S
from offerlake.operators import feed, lifecycle, reports
from offerlake.sources import io


def startup_job(spark: SparkSession, offers_path: str, snapshot_path: str, feed_path: str,
                as_of: datetime) -> DataFrame:
    """The start-up run: the five sweeps in order over the stored offers,
    written as a new snapshot (date partitions, dynamic overwrite), then the
    order events of the last 12 hours published. Returns the sweep summary.

    The new snapshot is a written table, so the rebroadcast reads it back
    instead of recomputing the sweep lineage."""
    offers = io.read_offers(spark, offers_path)
    summary = reports.sweep_summary(offers, as_of)
    io.write_offers(lifecycle.startup_sweep(offers, as_of), snapshot_path)
    recent = io.read_offers(spark, snapshot_path, since=as_of - timedelta(hours=S.REBROADCAST_HOURS))
    io.publish_orders(feed.rebroadcast_orders(recent, as_of, as_json=True), feed_path)
    return summary


def dashboard_report(spark: SparkSession, offers_path: str, group_by: str, as_of: datetime) -> DataFrame:
    """The dashboard document. The daily view reads only the last 29 days'
    partitions; the other parts scan the columns they need."""
    all_offers = io.read_offers(spark, offers_path)
    period_src = (io.read_offers(spark, offers_path, since=as_of - timedelta(days=S.DAILY_WINDOW_DAYS))
                  if group_by == "daily" else all_offers)
    return io.report_json(reports.metrics_by_period(period_src, group_by, as_of),
                          reports.metrics_totals(all_offers), reports.taker_domain_ranking(all_offers),
                          reports.weekday_profile(all_offers))
