"""Payment-hash index, Bloom filters, day-state reports and the due-time index."""

import glob
import json
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake import schema as S
from offerlake.operators import due as D
from offerlake.operators import lifecycle as LC
from offerlake.operators import reports as R
from offerlake.operators import rollup as RU
from offerlake.sources import commits as CM
from offerlake.sources import io
from offerlake.sources import keys as K
from offerlake.sources.fixtures import ORDERS_AS_OF, Tables
from tests.conftest import SF_SMALL

DAY = datetime(2024, 1, 1)


def offers(spark, rows):
    """Offers from dicts of columns."""
    fields = [f for f in S.OFFER_SCHEMA.fields]
    return spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], T.StructType([T.StructField(f.name, f.dataType) for f in fields]))


def row(i, h, **more):
    return {"id": i, "hold_invoice_payment_hash": h, "created_at": DAY, "status": "funded", "amount_sats": 1000, "maker_fees": 5, "maker_pubkey": "m",
            "fiat_amount": Decimal("10.00"), "fiat_currency": "PLN", **more}


# --------------------------------------------------------------------------- payment hashes
def test_append_keeps_hashes_unique(spark, tmp_path):
    r, path, want = random.Random(4), str(tmp_path), {}
    for batch in range(6):
        rows = [row(f"b{batch}-{k}", f"h{r.randrange(60)}", created_at=DAY + timedelta(days=r.randrange(90), seconds=k)) for k in range(20)]
        rows.append(row(f"null-{batch}", None))
        for x in sorted(rows, key=lambda x: (x["created_at"], x["id"])):
            want.setdefault(x["hold_invoice_payment_hash"] or x["id"], x["id"])
        for _ in range(1 + batch % 2):
            done = K.append_offers_once(offers(spark, rows), path, batch, DAY)
        assert done == (batch % 2 == 0)
        if batch == 3:
            assert K.compact_offers(spark, path)
    got = K.read_offers_committed(spark, path).collect()
    assert sorted(x.id for x in got) == sorted(want.values()) and all(x.updated_at == DAY for x in got)


def test_append_reads_the_buckets_of_its_rows_only(spark, tmp_path):
    path = str(tmp_path)
    K.append_offers_once(offers(spark, [row(str(k), f"h{k}") for k in range(500)]), path, 0)
    none = K.may_be_known(offers(spark, [row("x", f"new{k}") for k in range(50)]), K.filters(spark, path))
    assert none.count() <= 2  # a filter of a million bits holds eight hashes
    new = offers(spark, [row("x", "h3"), row("y", "h400"), row("z", "other")])
    known = K.known_keys(spark, path, new)
    assert sorted(x[0] for x in known.collect()) == ["h3", "h400"]
    plan = known._jdf.queryExecution().executedPlan().toString()
    buckets = sorted(x.bucket for x in K.may_be_known(new, K.filters(spark, path)).collect())
    assert len(buckets) <= 3 and f"bucket#" in plan and "PartitionFilters" in plan
    assert all(f"{b}" in plan[plan.index("PartitionFilters"):][:200] for b in buckets)


def test_hashes_of_a_killed_batch_do_not_count(spark, tmp_path, monkeypatch):
    path, rows = str(tmp_path), offers(spark, [row("a", "h1"), row("b", "h2")])

    def die(*a):
        raise RuntimeError("killed")

    publish = CM._publish
    monkeypatch.setattr(CM, "_publish", die)
    with pytest.raises(RuntimeError):
        K.append_offers_once(rows, path, 0)
    monkeypatch.setattr(CM, "_publish", publish)
    assert K.append_offers_once(offers(spark, [row("c", "h1")]), path, 1)  # another batch takes the hash
    assert K.append_offers_once(rows, path, 0)
    assert sorted(x.id for x in K.read_offers_committed(spark, path).collect()) == ["b", "c"]
    assert not K.append_offers_once(rows, path, 0)


def test_append_of_nothing(spark, tmp_path):
    assert K.append_offers_once(offers(spark, []), str(tmp_path), 0)
    assert K.read_offers_committed(spark, str(tmp_path)).count() == 0
    assert K.append_offers_once(offers(spark, [row("a", "h")]), str(tmp_path), 1)
    assert K.read_offers_committed(spark, str(tmp_path)).count() == 1


# --------------------------------------------------------------------------- Bloom filters
def scanned(df):
    """Rows that the scan of a plan gave, from its metrics."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.mark.parametrize("write", [True, False])
def test_point_lookups_skip_row_groups(spark, tmp_path, write):
    rows = spark.range(200000).selectExpr(
        "concat('offer-', lpad(CAST((id * 7919) % 200000 AS STRING), 9, '0')) AS id", "concat('hash-', (id * 104729) % 200000) AS hold_invoice_payment_hash",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS created_at")
    full = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.OFFER_SCHEMA.fields])
    confs = {"parquet.block.size": str(64 * 1024), "parquet.page.size.row.check.min": "10", "parquet.block.size.row.check.min": "10", "parquet.block.size.row.check.max": "1000"}
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for k, v in confs.items():
        hadoop.set(k, v)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        if write:
            io.write_offers(full, f"{tmp_path}/o")
        else:  # the same layout without filters
            full.repartitionByRange("created_at").sortWithinPartitions("created_at").write.parquet(f"{tmp_path}/o")
        got = {}
        for column, value in (("id", "offer-000123456"), ("hold_invoice_payment_hash", "hash-777")):
            hit = io.read_offers(spark, f"{tmp_path}/o").where(F.col(column) == value)
            got[column] = scanned(hit)
            assert hit.count() == 1
    finally:
        for k in confs:
            hadoop.unset(k)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert all((n < 60000) == write for n in got.values()), got


# --------------------------------------------------------------------------- day states
def test_reports_from_day_states(spark, tmp_path):
    t = Tables(spark, SF_SMALL)
    odd = offers(spark, [row("n1", "x1", created_at=None, status="takerPaid"), row("n2", "x2", status="takerPaid", taker_fees=1000, taker_invoice_fees=3),
                         row("n3", "x3", status="takerPaid", taker_fees=None, taker_invoice_fees=None), row("n4", "x4", status="expired", created_at=DAY + timedelta(days=800))])
    table = t.offers.unionByName(odd)
    RU.write_states(table.where("id <> 'n2'"), str(tmp_path))
    changed = table.withColumn("status", F.when(F.col("id") == "n1", "expired").otherwise(F.col("status"))).where("id <> 'n4'")
    RU.refresh(changed, str(tmp_path), ["2024-01", "none", f"{DAY + timedelta(days=800):%Y-%m}", "1901-01"])
    states = RU.read_states(spark, str(tmp_path))
    for unit in ("weekly", "monthly"):
        want = R.metrics_by_period(changed, unit, ORDERS_AS_OF)
        got = RU.period_report(states, unit).select(*want.columns)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
        assert got.dtypes == want.dtypes
    want = R.metrics_totals(changed)
    assert [tuple(r) for r in RU.totals_report(states).select(*want.columns).collect()] == [tuple(r) for r in want.collect()]
    none = R.metrics_totals(changed.limit(0)).collect()
    assert [tuple(r) for r in RU.totals_report(states.limit(0)).collect()] == [tuple(r) for r in none]
    with pytest.raises(ValueError):
        RU.period_report(states, "daily")


def test_refresh_reads_changed_months_only(spark, tmp_path):
    t = Tables(spark, SF_SMALL)
    RU.write_states(t.offers, str(tmp_path))
    before = {f for f in RU.read_states(spark, str(tmp_path)).inputFiles()}
    RU.refresh(t.offers.where("created_at < '1996-05-01'"), str(tmp_path), ["1996-04"])
    after = {f for f in RU.read_states(spark, str(tmp_path)).inputFiles()}
    assert {f.split("month=")[1][:7] for f in before ^ after} == {"1996-04"}


def test_report_sections_equal_the_reports(spark, tmp_path):
    odd = offers(spark, [row("n1", "x1", created_at=None, status="takerPaid", taker_lightning_address="a@late.example"),
                         row("n2", "x2", status="takerPaid", taker_fees=1000, taker_invoice_fees=3, taker_lightning_address="a@b@c"),
                         row("n3", "x3", status="takerPaid", taker_invoice_fees=None, taker_lightning_address="x@"),
                         row("n4", "x4", status="expired", created_at=DAY + timedelta(days=800), taker_lightning_address="a@never.example"),
                         row("n5", "x5", status="takerPaid", taker_lightning_address="no address")])
    table = Tables(spark, SF_SMALL).offers.unionByName(odd)
    for source in (table, table.where("id = 'n4'"), table.limit(0)):
        states = RU.domain_states(source).cache()
        for got, want in [(RU.domain_report(states), R.taker_domain_ranking(source)), (RU.weekday_report(states), R.weekday_profile(source)),
                          (RU.totals_report(states), R.metrics_totals(source)), (RU.period_report(states, "weekly"), R.metrics_by_period(source, "weekly", ORDERS_AS_OF))]:
            got = got.select(*want.columns)
            assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = RU.domain_states(odd)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan
    sections = io.report_sections(table, "monthly")
    io.write_sections(sections, f"{tmp_path}/doc")
    stored = spark.read.json(f"{tmp_path}/doc")
    assert stored.count() == sections.count()
    ranking = [json.loads(x)["entry"] for f in sorted(glob.glob(f"{tmp_path}/doc/section=takerDomainRanking/part-*")) for x in open(f)]
    assert [json.loads(e)["taker_domain"] for e in ranking] == [r.taker_domain for r in R.taker_domain_ranking(table).collect()]


# --------------------------------------------------------------------------- due times
def swept(offers_now, as_of):
    return sorted(tuple(r) for rule in LC.SWEEP_ORDER for r in LC.sweep(offers_now, rule, as_of).withColumn("rule", F.lit(rule)).select("id", "status", "rule", "new_status", "due_at").collect())


def test_due_index_equals_the_sweeps(spark, tmp_path):
    r, path = random.Random(8), str(tmp_path)
    statuses = ["funded", "reserved", "blikReceived", "blikSentToMaker", "takerCharged", "conflict", "takerPaid", "expired"]

    def any_offer(i):
        at = lambda: DAY + timedelta(minutes=r.randrange(60 * 24 * 20)) if r.random() < 0.8 else None
        return row(i, i, status=r.choice(statuses), created_at=at() or DAY, reserved_at=at(), blik_received_at=at(), updated_at=at())

    table = {f"o{k}": any_offer(f"o{k}") for k in range(80)}
    D.build(offers(spark, list(table.values())), path)
    for version in range(1, 5):
        before, after = [], []
        for i in r.sample(sorted(table) + [f"n{version}{k}" for k in range(5)], 25):
            if i in table:
                before.append(table.pop(i))
            if i.startswith("n") or r.random() < 0.8:
                table[i] = any_offer(i)
                after.append(table[i])
        for _ in range(1 + version % 2):
            D.update(offers(spark, before), offers(spark, after), path, version)
        for hours in (0, 30, 24 * 9, 24 * 30):
            as_of = DAY + timedelta(hours=hours)
            assert sorted(tuple(x) for x in D.due(spark, path, as_of).collect()) == swept(offers(spark, list(table.values())), as_of)
    D.compact(spark, path, f"{path}-compact")
    as_of = DAY + timedelta(days=12)
    assert sorted(tuple(x) for x in D.due(spark, f"{path}-compact", as_of).collect()) == swept(offers(spark, list(table.values())), as_of)
    some = D.due(spark, path, as_of, ["conflict", "reservation"])
    assert {x.rule for x in some.collect()} <= {"conflict", "reservation"}


def test_sweep_reads_due_slices_only(spark, tmp_path):
    D.build(offers(spark, [row(f"o{k}", f"h{k}", status="reserved", reserved_at=DAY + timedelta(days=31 * k)) for k in range(30)]), str(tmp_path))
    as_of = DAY + timedelta(days=31 * 4, hours=12)
    found = D.due(spark, str(tmp_path), as_of)
    assert found.count() == 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "due_slice" in plan[plan.index("PartitionFilters: ["):][:120]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert scanned(D.due(spark, str(tmp_path), as_of)) <= 6
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
