"""Plan shape: no Python UDFs or cartesian products on batch paths, filters
and partition predicates reach the scan, unused columns are pruned."""

from datetime import datetime

from pyspark.sql import Window

import pytest

import __spark_entry__ as E
from offerlake.plans import jobs
from offerlake.sources import io
from offerlake.sources.fixtures import ORDERS_AS_OF, Tables
from tests.conftest import SF_SMALL

# Queries that write (sources, sinks, streams) are exercised elsewhere.
WRITERS = {"read_offers", "read_audit", "append_offers", "append_audit", "read_rates", "publish_orders",
           "read_changes"}
BATCH = sorted(k for k in E.queries() if k not in WRITERS and not k.startswith("stream_"))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", BATCH)
def test_batch_plan_has_no_python_or_cartesian(spark, key):
    plan = plan_of(E.queries()[key](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "PythonUDF"):
        assert bad not in plan, (key, bad)


def test_partition_and_filter_pushdown(spark):
    t = Tables(spark, SF_SMALL)
    path = io.scratch_path(spark, "plan-offers")
    io.write_offers(t.offers, path)
    df = io.read_offers(spark, path, since=datetime(2001, 7, 1))
    plan = plan_of(df)
    assert "PartitionFilters: [isnotnull(created_month" in plan
    assert "PushedFilters: [IsNotNull(created_at), GreaterThanOrEqual(created_at" in plan
    assert df.count() == t.offers.where("created_at >= TIMESTAMP '2001-07-01 00:00:00'").count()


def test_column_pruning(spark):
    plan = plan_of(E.queries()["metrics_totals"](spark, SF_SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in plan


def test_dashboard_and_startup_jobs(spark):
    t = Tables(spark, SF_SMALL)
    path = io.scratch_path(spark, "job-offers")
    io.write_offers(t.offers, path)
    doc = jobs.dashboard_report(spark, path, "daily", ORDERS_AS_OF).first().report
    assert doc.startswith('{"rows":[') and '"weekdaySuccess"' in doc
    snap, feed = io.scratch_path(spark, "snap"), io.scratch_path(spark, "feed")
    summary = {(r.rule, r.outcome): r.offer_count for r in
               jobs.startup_job(spark, path, snap, feed, ORDERS_AS_OF).collect()}
    after = io.read_offers(spark, snap)
    assert after.count() == t.offers.count()
    assert after.where("status = 'funded'").count() == (
        t.offers.where("status = 'funded'").count() - summary.get(("funded_expiry", "due"), 0)
        + summary.get(("reservation", "due"), 0))


def test_bucketed_tables_join_without_shuffle(spark):
    from offerlake.operators import lifecycle as LC
    t = Tables(spark, SF_SMALL)
    offers = io.write_bucketed(t.offers, "offers_by_id", "id", 8)
    events = io.write_bucketed(t.status_events.withColumnRenamed("offer_id", "id"), "events_by_id", "id", 8)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # large-table plan
    try:
        plan = plan_of(offers.join(events.select("id", "seq"), "id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    # the operator result is unchanged on the bucketed layout
    a = LC.apply_status_updates(offers, events.withColumnRenamed("id", "offer_id"))
    b = LC.apply_status_updates(t.offers, t.status_events)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_hot_offer_status_history_matches_window(spark):
    """One offer holding a third of all status events (spanning several
    chunks) gives the same lag/lead as a plain window in DuckDB."""
    import duckdb
    from pyspark.sql import functions as F

    from offerlake.operators import lifecycle as LC
    t = Tables(spark, SF_SMALL)
    ev = t.status_events
    hot = F.col("offer_id") < "00000000-0000-4000-8000-000000000500"   # about a third of the offers
    skewed = ev.select(
        F.when(hot, F.lit("HOT")).otherwise(F.col("offer_id")).alias("offer_id"),
        F.when(hot, F.row_number().over(Window.orderBy("offer_id", "seq")) * 7).otherwise(F.col("seq"))
        .cast("int").alias("seq"),
        "status", "ts")
    hot_rows = skewed.where("offer_id = 'HOT'").agg(F.count("*").alias("n"), F.max("seq").alias("s")).first()
    assert hot_rows.n * 3 > skewed.count() * 0.9 and hot_rows.s // 4096 >= 3  # ~a third, several chunks
    got = LC.status_history(skewed).toArrow()
    con = duckdb.connect()
    con.register("e", skewed.toArrow())
    want = con.sql("""SELECT offer_id, seq, status, ts, lag(status) OVER w AS prev_status,
        CAST(trunc((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1000000.0) AS BIGINT) AS seconds_in_status,
        lead(seq) OVER w IS NULL AS is_current FROM e WINDOW w AS (PARTITION BY offer_id ORDER BY seq)""").arrow()
    if hasattr(want, "read_all"):
        want = want.read_all()
    from tools.check_oracle import rows_of
    assert rows_of(got) == rows_of(want)
    # applying the hot offer's events in order equals the last event's status
    applied = LC.apply_status_updates(
        t.offers.limit(1).withColumn("id", F.lit("HOT")), skewed.withColumn("taker_pubkey", F.lit("x"))
        .withColumn("address", F.lit(None).cast("string")).withColumn("taker_fees", F.lit(None).cast("bigint")))
    last = skewed.where("offer_id = 'HOT'").orderBy(F.col("seq").desc()).first()
    assert applied.first().status == last.status


def test_cli_jobs(spark, tmp_path_factory):
    from offerlake.plans import cli
    t = Tables(spark, SF_SMALL)
    src = io.scratch_path(spark, "cli-offers")
    io.write_offers(t.offers, src)
    out = io.scratch_path(spark, "cli-report")
    cli.main(["report", "--offers", src, "--group-by", "weekly", "--as-of", "2001-08-02 00:00:00", "--out", out])
    doc = spark.read.text(out).first().value
    assert doc.startswith('{"rows":[')
    sweep_out = io.scratch_path(spark, "cli-sweep")
    cli.main(["sweep", "--offers", src, "--as-of", "2001-08-02 00:00:00", "--out", sweep_out])
    assert spark.read.parquet(sweep_out).count() == sum(
        r.offer_count for r in E.queries()["sweep_summary"](spark, SF_SMALL).where("outcome = 'due'").collect())


def test_read_offers_from_instant_timestamps(spark):
    """A store exported with instant timestamps (TIMESTAMPTZ) reads back as
    the same UTC wall-clock rows, even in a non-UTC session."""
    from pyspark.sql import functions as F
    t = Tables(spark, SF_SMALL)
    path = io.scratch_path(spark, "instant-offers")
    ts_cols = [c for c, typ in t.offers.dtypes if typ == "timestamp_ntz"]
    # instants whose UTC wall clock is the NTZ value
    exported = t.offers.select(*[F.to_utc_timestamp(F.col(c).cast("timestamp"), "UTC").alias(c) if c in ts_cols
                                 else F.col(c) for c in t.offers.columns])
    exported.write.parquet(path)
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        back = io.read_offers(spark, path, instant_timestamps=True)
        assert back.exceptAll(t.offers).count() == 0 and t.offers.exceptAll(back).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_python_workers_need_no_installed_package():
    """Queries with Python functions (streamed replay fold, per-offer timers)
    run from another working directory in a plain session: the functions
    are shipped by value."""
    import os
    import subprocess
    import sys

    import duckdb
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.showConsoleProgress", "false").getOrCreate()
spec = importlib.util.spec_from_file_location("entry_mod", "{repo}/__spark_entry__.py")
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
from offerlake.operators import lifecycle as LC
from offerlake.sources.fixtures import Tables
t = Tables(spark, "{SF_SMALL}")
print("STEPS", LC.replay_steps(t.action_log, t.offers, hot_threshold=5).count())
print("TIMERS", m.queries()["stream_deadlines"](spark, "{SF_SMALL}").count())
"""
    out = subprocess.run([sys.executable, "-c", script], cwd="/tmp", capture_output=True, text=True, timeout=600)
    assert "STEPS 8250" in out.stdout, out.stderr[-2000:]
    con = duckdb.connect()
    for name in ("orders", "events", "customer", "nation", "region"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_SMALL}/{name}.parquet')")
    timers = con.execute(f"SELECT count(*) FROM ({E.oracle_sql()['stream_deadlines']})").fetchone()[0]
    assert f"TIMERS {timers}\n" in out.stdout, out.stderr[-2000:]
