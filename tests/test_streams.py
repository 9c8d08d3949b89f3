"""Streams at size: state by shard, micro-batches of many files, the state store of the listing."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from offerlake import schema as S
from offerlake.sources.fixtures import Tables
from offerlake.streaming import jobs as J
from offerlake.streaming import shards as Z
from offerlake.streaming import views as V

SF_SMALL = "/root/testdata/sf0.001"


class State:
    """What a function of ``applyInPandasWithState`` sees of its group."""

    def __init__(self, watermark=0):
        self.value, self.watermark, self.timer, self.hasTimedOut = None, watermark, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, at):
        assert at > self.watermark
        self.timer = at


@pytest.mark.parametrize("few", [1, 10_000])
def test_timers_of_a_shard_are_those_of_its_offers(monkeypatch, few):
    """All offers of a shard at once fire what each fires alone, over several micro-batches and with one busy offer."""
    monkeypatch.setattr(J, "FEW", few)
    r = random.Random(few)
    statuses = [*J._TIMED, "settled", "takerPaid", "expired", "created", "odd"]
    batches = [[(f"o{r.randrange(60)}" if r.random() < 0.8 else "busy", r.randrange(40), r.choice(statuses), 1000 * (2000 * b + r.randrange(2500))) for _ in range(400)] for b in range(4)]
    state, alone, got, want = State(), {}, [], []
    for b, rows in enumerate(batches):
        state.watermark = 2_000_000 * b
        pdf = pd.DataFrame(rows, columns=["offer_id", "seq", "status", "ts_ms"])
        for out in J._deadline_fn((0,), iter([pdf[:150], pdf[150:]]), state):
            got += [tuple(None if pd.isna(v) else v for v in x) for x in out.itertuples(index=False)]
        for k in {*pdf["offer_id"], *alone}:
            fired, ignored = [], []
            cur = J._walk(alone.pop(k, J.NOTHING), [pdf[pdf["offer_id"] == k]], fired, ignored)
            cur = J._fire(cur, state.watermark - 1, fired)
            if not (J._over(cur) and state.watermark > cur[6]):
                alone[k] = cur
            want += [(k, *f, None) for f in fired] + [(k, s, None, None, None, n) for s, n in ignored]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 200
    held = Z.unpack(state.value[0])
    assert sorted(held["offer_id"]) == sorted(alone)
    assert {i: d for i, d in zip(held["offer_id"], held["due_ms"].tolist())} == {k: Z.NONE if v[2] is None else v[2] for k, v in alone.items()}


def test_funding_of_a_shard_is_one_call():
    """1,000 quotes and their updates are one call with one state, whichever comes first."""
    state, none = State(), [None] * 500
    quotes = pd.DataFrame({"payment_hash": [f"h{k}" for k in range(500)], "quote": [f"q{k}" for k in range(500)], "status": none, "seq": np.nan, "ts_us": np.nan, "came_ms": 1})
    updates = pd.DataFrame({"payment_hash": [f"h{k}" for k in range(250, 750)], "quote": none, "status": "ACCEPTED", "seq": 2.0, "ts_us": 7.0, "came_ms": 5})
    run = V._funding(1000)
    first = pd.concat(run((0,), iter([quotes]), state))
    assert len(first) == 500 and not first["final"].any() and state.timer is None
    state.watermark = 1
    second = pd.concat(run((0,), iter([updates, updates]), state))
    assert sorted(second["payment_hash"]) == sorted(f"h{k}" for k in range(250, 500)) and second["final"].all() and state.timer == 1005
    state.watermark, state.hasTimedOut = 1006, True
    assert list(run((0,), iter([]), state)) == []
    assert sorted(Z.unpack(state.value[0])["hash"]) == sorted(f"h{k}" for k in range(250))  # the quotes that wait


def test_listing_with_the_sessions_own_state_store(spark):
    """Spark's default store cannot keep the listing's state; the stream brings its own and leaves the session's."""
    name, default = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    was = spark.conf.get(name)
    spark.conf.set(name, default)
    try:
        t = Tables(spark, SF_SMALL)
        from offerlake.operators.lookups import recent_offers
        got = sorted(r.id for r in J.stream_recent_offers(spark, t.offer_changes.limit(50), t.offers).collect())
        assert got == sorted(r.id for r in recent_offers(t.offers).collect()) and len(got) == S.LISTING_LIMIT
        assert spark.conf.get(name) == default
    finally:
        spark.conf.set(name, was)


class Held:
    """A map state and a value state as a processor sees them."""

    def __init__(self):
        self.values, self.wrote = {}, []

    def getMapState(self, *_):
        return Held()

    getValueState = getMapState

    def containsKey(self, key):
        return key in self.values

    def exists(self):
        return None in self.values

    def getValue(self, key):
        return self.values[key]

    def get(self):
        return self.values[None]

    def updateValue(self, key, value):
        self.values[key] = value
        self.wrote.append(key)

    def update(self, value):
        self.values[None] = value


def test_listing_holds_a_snapshot_in_packed_runs(spark, monkeypatch):
    """A shard's snapshot comes and stays packed, no value of its state grows with it, and an event writes its own bucket only."""
    monkeypatch.setattr(V, "PORTION", 300)  # a micro-batch is worked on in parts
    rows = spark.range(9000).selectExpr("cast(id % 2 as int) shard", "concat('o', id) id", "id at", "concat('{', repeat(concat('text ', id % 9), 80), id, '}') body")
    runs = [(r.shard, bytes(r.held)) for r in V._packed(rows.unionByName(rows.where("id = 'o8'").withColumn("at", F.lit(-7))), 2).collect()]
    assert len(runs) == 10 and {s for s, _ in runs} == {0, 1} and sum(len(h) for _, h in runs) < 9000 * 500 / 3
    shard = V.NewestOffers(5, 2)
    shard.init(Held())
    for k in (0, 1):  # Spark may bring a shard's rows in several frames
        shard.handleInitialState((0,), pd.DataFrame({"held": [h for s, h in runs if s == 0][k::2]}), None)
    assert len(shard.runs.values) == 5 and not shard.buckets.values
    live = {f"o{i}": i for i in range(0, 9000, 2)}

    def put(events):
        frame = pd.DataFrame([(sum(map(ord, i)) % V.BUCKETS, i, seq, at, body) for seq, i, at, body in events], columns=["bucket", "id", "seq", "at", "body"])
        out = pd.concat([*shard.handleInputRows((0,), iter([frame[:400], frame[400:]]), None), pd.DataFrame(columns=["id"])])
        for seq, i, at, body in events:
            if seq > V.START:
                live.pop(i, None)
                live.update({i: at} if body else {})
        return out["id"].tolist()

    newest = lambda: sorted(live, key=lambda i: (-live[i], i))[:5]
    assert put([(1, "o8998", 8998, None)]) == newest() and len(shard.buckets.wrote) == 1
    assert put([(2, "o4", 99_999, "{4}")]) == newest()
    assert put([(V.START, "o8996", 0, None)]) == []  # not newer than the snapshot
    assert put([(V.START, "new", 5, "{}")]) == newest()
    assert put([(3 + n, f"o{i}", i, None) for n, i in enumerate(range(8000, 9000, 2))]) == newest()  # the list runs short and is filled again
    assert put([(900, "o8000", 100_000, "{}"), (901, "o8", 1, None)]) == newest()
    assert sorted(shard.runs.wrote) == [(k,) for k in range(5)] and max(len(h) for (h,) in shard.runs.values.values()) < 200_000


def test_listing_bounds_the_memory_of_its_state_store(spark):
    """All partitions of an executor share RocksDB's buffers; the session's own settings come back."""
    from offerlake.session import rocksdb_state
    names = ("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "spark.sql.shuffle.partitions")
    was = [spark.conf.get(name, None) for name in names]
    with rocksdb_state(spark, 3):
        assert [spark.conf.get(name) for name in names] == ["true", "3"]
    assert [spark.conf.get(name, None) for name in names] == was


def test_listing_has_few_partitions_of_state(spark):
    """They follow the cores: an executor keeps each one open that it has worked on."""
    name = "spark.sql.shuffle.partitions"
    was = spark.conf.get(name)
    try:
        spark.conf.set(name, "100000")
        assert V._stores(spark) == max(96, V.STORES * spark.sparkContext.defaultParallelism)
        spark.conf.set(name, "3")
        assert V._stores(spark) == 3
    finally:
        spark.conf.set(name, was)


def test_micro_batches_do_not_grow_in_number(spark, monkeypatch):
    """More rows are more files to a micro-batch, read side by side."""
    monkeypatch.setattr(J, "FILE_ROWS", 100)
    sizes = []
    J.run_foreach_batch(J.landed_stream(spark.range(1600).select("id", F.lit("x").alias("v")), "sizes"), "sizes", lambda df, bid, to: sizes.append(df.count()), mode="append")
    assert len(sizes) == J.LANDED_FILES and sum(sizes) == 1600  # 16 files


def test_audit_is_worked_out_once_for_all_micro_batches(spark, monkeypatch):
    t, kept, plain = Tables(spark, SF_SMALL), [], J.stored
    monkeypatch.setattr(J, "stored", lambda df, name: kept.append(name) or plain(df, name))
    from offerlake.operators import changes as C
    seen, enriched = [], C.audit_changes_enriched
    monkeypatch.setattr(C, "audit_changes_enriched", lambda df, audit: seen.append(len(audit.inputFiles()) and "audit" in audit.inputFiles()[0].split("/")[-2]) or enriched(df, audit))
    J.stream_offer_audit(spark, t.audit_changes, t.audit).count()
    assert kept == ["audit"] and seen and all(seen)
