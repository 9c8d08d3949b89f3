"""Change capture between stored versions, appends that happen once, live views that come out of the stream."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from offerlake import schema as S
from offerlake.operators import changes as C
from offerlake.sources import commits as CM
from offerlake.sources import io
from offerlake.sources import snapshots as SN
from offerlake.sources.fixtures import Tables
from offerlake.streaming import jobs as J
from offerlake.streaming import views as V
from tests.conftest import SF_SMALL

ROW = "id string, status string, note string, created_at timestamp_ntz"
DAY = datetime(2024, 1, 1)


def version(spark, path, number, rows):
    SN.write_version(spark.createDataFrame(rows, ROW), path, number)


def captured(spark, path):
    return sorted(tuple(r) for r in SN.capture_changes(spark, path, 1, 2).collect())


# --------------------------------------------------------------------------- versions
def test_capture_of_all_kinds(spark, tmp_path):
    at = [DAY + timedelta(days=31 * k) for k in range(6)]
    old = [("same", "a", None, at[0]), ("gone", "a", "x", at[1]), ("new status", "a", "x", at[1]), ("null moves", "x", None, at[2]), ("other month", "a", "x", at[3]),
           ("no time", "a", "x", None), ("twice", "a", "x", at[4]), (None, "a", "x", at[4]), ("kept twice", "a", "x", at[4]), ("kept twice", "b", "x", at[4])]
    new = [("same", "a", None, at[0]), ("new status", "b", "x", at[1]), ("null moves", None, "x", at[2]), ("other month", "a", "x", at[5]), ("no time", "a", "y", None),
           ("twice", "a", "x", at[4]), ("twice", "a", "x", at[4]), (None, "b", "x", at[4]), ("kept twice", "b", "x", at[4]), ("kept twice", "a", "x", at[4]), ("fresh", "a", "x", at[5])]
    version(spark, tmp_path, 1, old)
    version(spark, tmp_path, 2, new)
    assert captured(spark, str(tmp_path)) == sorted([
        ("DELETE", "gone"), ("UPDATE", "new status"), ("UPDATE", "null moves"), ("UPDATE", "other month"), ("UPDATE", "no time"), ("UPDATE", "twice"), ("INSERT", "fresh")])
    assert SN.changed_months(spark, str(tmp_path), 1, 2) == sorted([f"{t:%Y-%m}" for t in at[1:]] + ["none"])


@pytest.mark.parametrize("old,new,want", [([], [], []), ([], [("a", "s", None, DAY)], [("INSERT", "a")]), ([("a", "s", None, DAY)], [], [("DELETE", "a")]),
                                          ([("a", "s", None, DAY)], [("a", "s", None, DAY)], [])])
def test_capture_of_little(spark, tmp_path, old, new, want):
    version(spark, tmp_path, 1, old)
    version(spark, tmp_path, 2, new)
    assert captured(spark, str(tmp_path)) == want


def test_capture_reads_changed_months_only(spark, tmp_path):
    rows = [(f"{m}-{k}", "a", "x", datetime(2024, m, 1 + k)) for m in range(1, 13) for k in range(20)]
    random.Random(1).shuffle(rows)
    version(spark, tmp_path, 1, rows)
    version(spark, tmp_path, 2, [(i, "b" if i == "7-3" else s, n, t) for i, s, n, t in sorted(rows)])
    found = SN.capture_changes(spark, str(tmp_path), 1, 2)
    assert [tuple(r) for r in found.collect()] == [("UPDATE", "7-3")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(created_month") >= 2 and "(created_month" in plan and " = 2024-07)" in plan
    assert "status" not in plan and "note" not in plan  # digests and keys are read, no other column


def test_landed_changes_are_a_stream(spark, tmp_path):
    version(spark, f"{tmp_path}/v", 1, [("a", "s", None, DAY)])
    version(spark, f"{tmp_path}/v", 2, [("b", "s", None, DAY), ("c", "s", None, DAY)])
    found = SN.capture_changes(spark, f"{tmp_path}/v", 1, 2).withColumnRenamed("id", "offer_id").withColumn("change_ts", F.lit(DAY).cast("timestamp_ntz"))
    for _ in range(2):  # landing again replaces
        SN.land_changes(found, f"{tmp_path}/feed", 2)
    stream = J.read_stream(spark, f"{tmp_path}/feed", spark.read.parquet(f"{tmp_path}/feed").drop("version").schema)
    got = spark.read.parquet(J.run_to_files(stream, "captured")).collect()
    assert sorted((r.operation, r.offer_id) for r in got) == [("DELETE", "a"), ("INSERT", "b"), ("INSERT", "c")]
    assert len({r.seq for r in got}) == 3 and all(r.seq >> 44 == 2 for r in got)


# --------------------------------------------------------------------------- manifest
def audit_rows(spark, ids):
    rows = [(i, DAY + timedelta(days=40 * (i % 3)), "INFO", "t", f"m{i}") for i in ids]
    df = spark.createDataFrame(rows, "id long, created_at timestamp_ntz, level string, action string, message string")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.AUDIT_SCHEMA.fields])


def ids_of(spark, path):
    return sorted(r.id for r in CM.read_audit_committed(spark, path).collect())


def test_a_killed_batch_counts_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    assert ids_of(spark, path) == []
    assert CM.append_audit_once(audit_rows(spark, range(5)), path, 0)

    def die(*a):
        raise RuntimeError("killed")

    publish = CM._publish
    monkeypatch.setattr(CM, "_publish", die)  # after the data, before the entry
    with pytest.raises(RuntimeError):
        CM.append_audit_once(audit_rows(spark, range(5, 9)), path, 1)
    monkeypatch.setattr(CM, "_publish", publish)
    assert ids_of(spark, path) == list(range(5))
    assert CM.append_audit_once(audit_rows(spark, range(5, 9)), path, 1)
    assert not CM.append_audit_once(audit_rows(spark, range(5, 9)), path, 1)
    assert ids_of(spark, path) == list(range(9))


def test_of_two_attempts_at_once_one_counts(spark, tmp_path):
    path, seen = str(tmp_path), []

    def slow(rows, folder):
        if not seen:  # another attempt commits while this one writes
            seen.append(folder)
            assert CM.append_once(rows, path, 7, lambda r, f: r.write.parquet(f))
        rows.write.parquet(folder)

    assert not CM.append_once(audit_rows(spark, range(4)), path, 7, slow)
    assert ids_of(spark, path) == list(range(4)) and len(CM.folders(spark, path)) == 1


def test_compaction_keeps_rows_and_ids(spark, tmp_path):
    path = str(tmp_path)
    for b in range(5):
        CM.append_audit_once(audit_rows(spark, range(3 * b, 3 * b + 3)), path, b)
    assert CM.compact_audit(spark, path) and len(CM.folders(spark, path)) == 1
    assert not CM.append_audit_once(audit_rows(spark, range(3)), path, 0)  # a retry that comes after the compaction
    CM.append_audit_once(audit_rows(spark, [15, 16]), path, 5)
    assert len(CM.folders(spark, path)) == 2 and ids_of(spark, path) == list(range(17))
    assert CM.compact_audit(spark, path) and not CM.compact_audit(spark, path)
    assert ids_of(spark, path) == list(range(17))
    # month folders still prune inside a batch
    late = CM.read_audit_committed(spark, path).where("id = 16")
    assert late.count() == 1


def test_log_of_newest_rows_is_compacted(spark, tmp_path):
    path, schema = str(tmp_path), "k string, seq long, v string"
    r, rows = random.Random(2), []
    for batch in range(9):
        part = [(r.choice("abcde"), 100 * batch + i if r.random() < 0.7 else r.randrange(900), f"{batch}-{i}") for i in range(6)]
        part = list({s: (k, s, v) for k, s, v in part if s not in {x[1] for x in rows}}.values())
        rows += part
        for _ in range(1 + batch % 2):  # some micro-batches run twice
            CM.log_newest(spark.createDataFrame(part, schema), path, batch, ["k"], "seq", every=3)
    want = {k: max((s, v) for x, s, v in rows if x == k) for k, _, _ in rows}
    got = {x.k: (x.seq, x.v) for x in CM.read_newest(spark, path, schema, ["k"], "seq").collect()}
    assert got == want and len(CM.folders(spark, path)) <= 4


# --------------------------------------------------------------------------- newest offers
def offer_rows(spark, rows):
    """rows: (id, updated_at or None, created_at or None, status)."""
    df = spark.createDataFrame(rows, "id string, updated_at timestamp_ntz, created_at timestamp_ntz, status string")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit("9.25") if f.name == "fiat_amount" else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.OFFER_SCHEMA.fields])


@pytest.mark.parametrize("seed,cuts,spare", [(1, 1, 2), (1, 7, 2), (2, 12, 0), (3, 5, 40)])
def test_newest_offers_after_any_cut(spark, tmp_path, seed, cuts, spare):
    """Updates, removals and returns of offers, cut into micro-batches and a restart: always the table's newest."""
    r = random.Random(seed)
    tick = lambda: DAY + timedelta(seconds=r.randrange(400), microseconds=r.randrange(3))
    table = {f"o{k:02}": (tick() if k % 3 else None, DAY if k else None, "funded") for k in range(30)}
    start = offer_rows(spark, [(i, *v) for i, v in table.items()])
    events = []
    for seq in range(120):
        i = f"o{r.randrange(36):02}"
        # the newest ones go more often than others, so that lists run short
        if r.random() < 0.5:
            live = sorted(table, key=lambda x: (table[x][0] or table[x][1] or datetime.min), reverse=True)
            i = r.choice(live[:6]) if live else i
            table.pop(i, None)
            events.append((seq, "DELETE", i, "offer_removed", None, None, None))
        else:
            table[i] = (tick(), DAY, r.choice(["funded", "reserved"]))
            events.append((seq, "UPDATE", i, "offer_changed", *table[i]))
    schema = "seq long, operation string, offer_id string, type string, updated_at timestamp_ntz, created_at timestamp_ntz, status string"
    feed, out, ckpt = f"{tmp_path}/feed", f"{tmp_path}/out", f"{tmp_path}/ckpt"
    mixed = events[:]
    if cuts > 5:  # also across micro-batches events may come late
        mixed.sort(key=lambda e: e[0] + r.randrange(25))
    size = -(-len(mixed) // cuts)

    def stream():
        df = J.read_stream(spark, feed, spark.createDataFrame([], schema).schema)
        return df.select("*", *[(F.lit("9.25") if c == "fiat_amount" else F.lit(None)).cast(S.OFFER_SCHEMA[c].dataType).alias(c) for c in S.LISTING_COLUMNS if c not in ("id", *df.columns)])

    for k in range(cuts):
        spark.createDataFrame(mixed[k * size: (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(feed)
        if k in (cuts // 2, cuts - 1):  # the second run resumes from the checkpoint
            V.run_newest_offers(stream(), start, limit=5, shards=3, spare=spare, out=out, checkpoint=ckpt)
    got = [(x.id, x.updated_at, x.created_at, x.status, str(x.fiat_amount)) for x in V.read_newest_offers(spark, out, 5).collect()]
    want = sorted(table.items(), key=lambda x: (-((x[1][0] or x[1][1] or datetime.min) - datetime.min).total_seconds(), x[0]))
    assert got == [(i, *v, "9.25") for i, v in want[:5]]


def test_newest_offers_without_changes_and_without_offers(spark, tmp_path):
    t = Tables(spark, SF_SMALL)
    none = t.offer_changes.limit(0)
    got = [r.id for r in J.stream_recent_offers(spark, none, t.offers).collect()]
    from offerlake.operators.lookups import recent_offers
    assert sorted(got) == sorted(r.id for r in recent_offers(t.offers).collect())
    assert J.stream_recent_offers(spark, t.offer_changes, t.offers.limit(0)).collect() == []


# --------------------------------------------------------------------------- funding
def funded(spark, folder, batches, keep_ms=3_600_000):
    """Outcomes after ``batches`` of (quotes, updates), each its own run on one checkpoint; and the rows of state left."""
    quote = "quote_id long, payment_hash string, ts timestamp_ntz, amount_sats long, maker_fees long, taker_fees long, maker_id string, fiat_amount double"
    update = "payment_hash string, seq int, status string, ts timestamp_ntz"
    offers = offer_rows(spark, [("x", None, DAY, "funded")]).withColumn("hold_invoice_payment_hash", F.lit("taken"))
    left = None
    for k, (quotes, updates) in enumerate(batches):
        q = [(i, h, DAY, 1000 + i, 5, 5, f"m{i}", 12.5) for i, h in quotes]
        u = [(h, n, s, DAY + timedelta(seconds=n, microseconds=1)) for h, n, s in updates]
        spark.createDataFrame(q, quote).coalesce(1).write.mode("append").parquet(f"{folder}/q")
        spark.createDataFrame(u, update).coalesce(1).write.mode("append").parquet(f"{folder}/u")
        streams = [J.read_stream(spark, f"{folder}/{n}", spark.createDataFrame([], s).schema, 100) for n, s in (("q", quote), ("u", update))]
        out = V.funding_outcomes(V.funding_decisions(*streams, keep_ms=keep_ms), streams[0].schema, offers)
        run = (out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ckpt")
               .outputMode("append").trigger(availableNow=True).start())
        run.awaitTermination()
        left = run.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    rows = spark.read.parquet(f"{folder}/out").collect()
    return {(r.quote_id, r.outcome, r.final) for r in rows}, left, rows


def test_quotes_may_come_before_or_after_their_update(spark, tmp_path):
    got, _, rows = funded(spark, tmp_path, [
        ([(1, "a"), (2, "b"), (3, None), (4, "taken")], [("c", 2, "ACCEPTED"), ("a", 1, "OPEN"), (None, 2, "ACCEPTED")]),
        ([(5, "c"), (6, "d")], [("a", 3, "CANCELED"), ("a", 2, "ACCEPTED"), ("taken", 2, "ACCEPTED"), ("d", 2, "SETTLED")]),
        ([(1, "a")], [("a", 4, "CANCELED"), ("b", 9, "CANCELED")])])
    assert got == {(1, "pending", False), (2, "pending", False), (3, "pending", False), (4, "pending", False), (1, "funded", True), (4, "already_exists", True),
                   (5, "funded", True), (6, "settled", True), (2, "canceled", True)}
    assert len(rows) == len(got)
    one = next(r for r in rows if r.quote_id == 1 and r.final)
    assert (one.amount_sats, one.maker_pubkey, one.status, one.created_at) == (1001, "m1", "funded", DAY + timedelta(seconds=2, microseconds=1))


def test_funding_state_ends(spark, tmp_path):
    """Decided hashes and lone updates leave the state; a quote that waits stays."""
    decided = ([(1, "a"), (2, "b")], [("a", 2, "ACCEPTED"), ("b", 2, "CANCELED"), ("alone", 2, "ACCEPTED")])
    later = [([], [(f"z{k}", 1, "OPEN")]) for k in range(3)]
    _, left, _ = funded(spark, f"{tmp_path}/a", [decided, ([(9, "waits")], []), *[([(20 + k, f"w{k}")], []) for k in range(2)]], keep_ms=1)
    assert left == 3  # the three quotes that wait
    _, left, _ = funded(spark, f"{tmp_path}/b", [decided, *later], keep_ms=3_600_000)
    assert left == 3  # kept for repeated and early updates


def test_offer_audit_view_shows_stored_lines(spark):
    """An offer without a change shows its stored lines, one with a change those and the changed ones."""
    t = Tables(spark, SF_SMALL)
    nothing = J.stream_offer_audit(spark, t.audit_changes.limit(0), t.audit)
    want = {r.offer_id: r.n for r in t.audit.where("offer_id is not null").groupBy("offer_id").agg(F.least(F.count("*"), F.lit(50)).alias("n")).collect()}
    assert {r.offer_id: r.n for r in nothing.groupBy("offer_id").agg(F.count("*").alias("n")).collect()} == want
