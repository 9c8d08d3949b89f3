"""Live results that come out of the stream: the newest offers, and funding.

`newest_offers` keeps the listing of the most recently changed offers as state.
Offers are dealt to shards by id. A shard's state holds its changed offers in buckets by id
(state store, on disk) and a short sorted list of its newest ones, wide enough
that offers may leave it; only when it runs short is it filled again from the
shard's own state. The snapshot of all offers, packed into runs by Spark, is the
initial state. The state store is RocksDB, the only one that keeps such state. Every
micro-batch puts out the newest ``limit`` of each shard that changed, so the
listing is read from ``shards * limit`` rows and no table is merged.

`funding_decisions` joins two streams, quotes and hold-invoice updates, by
payment hash. A quote waits for its first decisive update and an update for its
quote, whichever comes first; both together end the wait, and what is left of the hash
is dropped some time later. Hashes are kept and worked on by shard (`shards`).
"""

from __future__ import annotations

import bisect
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from offerlake import schema as S
from offerlake.functions import epoch_us
from offerlake.session import rocksdb_state
from offerlake.sources.io import scratch_path
from offerlake.streaming import shards as Z

# ---------------------------------------------------------------------------
# newest offers
# ---------------------------------------------------------------------------
LISTED = T.StructType([S.OFFER_SCHEMA[c] for c in S.LISTING_COLUMNS])
JSON_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
SHARD_OUT = "shard INT, at LONG, id STRING, body STRING"
NEVER = -(1 << 63)  # an offer without any time comes last


def _shard(shards: int):
    return F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")


def _at():
    return F.coalesce(epoch_us(F.coalesce("updated_at", "created_at")), F.lit(NEVER)).alias("at")


def _listed(rows: DataFrame, shards: int, seq, live) -> DataFrame:
    """(shard, id, seq, at, body): a listing row as JSON text, without one for an offer that is gone."""
    body = F.when(live, F.to_json(F.struct(*S.LISTING_COLUMNS), JSON_TIMES))
    return rows.select(_shard(shards), "id", seq.cast("long").alias("seq"), _at(), body.alias("body"))


START = -1  # the seq of an offer of the snapshot
RUN = 1000  # offers of the snapshot in one value of the state
BUCKETS = 256  # of a shard, for its changed offers
PORTION = 10_000  # changed offers that are worked on at once
STORES = 16  # partitions of the state to a core, at most
CHANGED = ("id", "seq", "at", "body")


def _bucketed(rows: DataFrame) -> DataFrame:
    """With the bucket of an offer in its shard."""
    return rows.withColumn("bucket", F.pmod(F.hash("id"), F.lit(BUCKETS)))


def _runs(batches):
    """(shard, held) of offers sorted by shard: at most RUN offers of one shard as packed Arrow."""
    parts, n, of = [], 0, None

    def run():
        held = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_pydict({"shard": pa.array([of], pa.int32()), "held": pa.array([Z.packed(held)], pa.binary())})

    for batch in batches:
        shard, at = batch.column("shard").to_numpy(), 0
        for end in (*(np.flatnonzero(shard[1:] != shard[:-1]) + 1), len(shard)):
            while at < end:
                if parts and (of != shard[at] or n == RUN):
                    yield run()
                    parts, n = [], 0
                of, take = shard[at], min(end - at, RUN - n)
                parts.append(batch.slice(at, take).select(["id", "at", "body"]))
                at, n = at + take, n + take
    if parts:
        yield run()


def _packed(rows: DataFrame, shards: int) -> DataFrame:
    """(shard, held): the offers of the snapshot in runs. Spark hands all that a shard starts from to Python at
    once and keeps it while the shard is worked on, so it goes there packed."""
    return rows.select("shard", "id", "at", "body").repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_runs, "shard INT, held BINARY")


class NewestOffers(StatefulProcessor):
    """One shard: the snapshot's offers in runs, the changed ones by id in buckets, and its newest ones in order.

    ``spare`` is how many more than ``limit`` the short list may hold. Of an
    offer's events the one with the highest seq counts, whenever it comes;
    a removed offer leaves its seq. A changed offer counts as its bucket has it;
    its place in the run is never written again.
    """

    def __init__(self, limit: int, spare: int):
        self.limit, self.width = limit, limit + spare

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("runs", "run INT", "held BINARY")
        self.buckets = handle.getMapState("buckets", "bucket INT", "held BINARY")
        self.short = handle.getValueState("short", "runs INT, whole BOOLEAN, entries STRING")

    def _short(self) -> tuple[int, bool, list]:
        """The number of runs, whether the short list holds all live offers, and the list."""
        if not self.short.exists():
            return 0, True, []
        runs, whole, text = self.short.get()
        return runs, whole, [tuple(e) for e in json.loads(text)]

    def _bucket(self, bucket: int) -> dict[str, tuple]:
        """(seq, at, body) by id."""
        if not self.buckets.containsKey((bucket,)):
            return {}
        held = Z.unpack(self.buckets.getValue((bucket,))[0])
        ids, *values = (held[c].tolist() for c in CHANGED)
        return dict(zip(ids, zip(*values)))

    def _run(self, run: int) -> bytes:
        return self.runs.getValue((run,))[0]

    def _with_run(self, whole: bool, entries: list, data: bytes, changed=frozenset()) -> tuple[bool, list]:
        """The short list with a run's offers but the changed ones; of rows with one id the newest."""
        held = pa.ipc.open_stream(pa.py_buffer(data)).read_all()
        at = held.column("at").to_numpy()
        if len(entries) == self.width:
            near = at >= -entries[-1][0]
            held, at, whole = held.filter(pa.array(near)), at[near], whole and bool(near.all())
        more = zip((-x for x in at.tolist()), held.column("id").to_pylist(), held.column("body").to_pylist())
        newest: dict[str, tuple] = {}
        for e in sorted([*entries, *(e for e in more if e[1] not in changed)]):
            newest.setdefault(e[1], e)
        entries = list(newest.values())
        return whole and len(entries) <= self.width, entries[: self.width]

    def _fill(self, runs: int) -> tuple[bool, list]:
        """The short list from all live offers of the shard."""
        whole, entries, changed = True, [], set()
        for bucket in range(BUCKETS):
            held = self._bucket(bucket)
            changed.update(held)
            entries = sorted(entries + [(-at, id_, body) for id_, (_, at, body) in held.items() if body is not None])
            whole, entries = whole and len(entries) <= self.width, entries[: self.width]
        for run in range(runs):
            whole, entries = self._with_run(whole, entries, self._run(run), changed)
        return whole, entries

    def _started(self, ids: set, runs: int) -> set:
        """Those of ``ids`` that the snapshot has."""
        return {i for run in range(runs if ids else 0) for i in pa.ipc.open_stream(pa.py_buffer(self._run(run))).read_all().column("id").to_pylist() if i in ids}

    def handleInitialState(self, key, rows: pd.DataFrame, timerValues) -> None:
        runs, whole, entries = self._short()
        for held in rows["held"]:
            held = bytes(held)
            self.runs.updateValue((runs,), (held,))
            runs, (whole, entries) = runs + 1, self._with_run(whole, entries, held)
        self.short.update((runs, whole, json.dumps(entries)))

    def _apply(self, newest: dict[int, dict[str, tuple]], runs: int, whole: bool, entries: list) -> tuple[bool, bool, list]:
        """Whether an offer changed, and the short list after the events of each bucket; the list may run short."""
        changed, listed = False, {e[1] for e in entries}
        for bucket, known in newest.items():
            held = self._bucket(bucket)
            early = self._started({id_ for id_, v in known.items() if v[0] <= START and id_ not in held}, runs)
            known = {id_: v for id_, v in known.items() if id_ not in early and (id_ not in held or held[id_][0] < v[0])}
            if not known:
                continue
            changed, held = True, {**held, **known}
            columns = (list(held), *zip(*held.values()))
            self.buckets.updateValue((bucket,), (Z.pack({n: np.array(v, np.int64 if n in ("seq", "at") else object) for n, v in zip(CHANGED, columns)}),))
            for id_, (_, at, body) in known.items():
                if id_ in listed:
                    entries, listed = [e for e in entries if e[1] != id_], listed - {id_}
                # below the list's end there may be others that the list does not hold
                if body is not None and (whole or (entries and (-at, id_) < entries[-1][:2])):
                    bisect.insort(entries, (-at, id_, body))
                    listed.add(id_)
                    if len(entries) > self.width:
                        whole = False
                        listed.discard(entries.pop()[1])
        return changed, whole, entries

    def handleInputRows(self, key, rows, timerValues):
        runs, whole, entries = self._short()
        changed, newest, n = False, {}, 0

        def applied():
            nonlocal changed, whole, entries, newest, n
            some, whole, entries = self._apply(newest, runs, whole, entries)
            changed, newest, n = changed or some, {}, 0

        for pdf in rows:
            for bucket, id_, seq, at, body in zip(*(pdf[c].tolist() for c in ("bucket", "id", "seq", "at", "body"))):
                known = newest.setdefault(int(bucket), {})
                if id_ not in known or seq > known[id_][0]:
                    n += id_ not in known
                    known[id_] = (int(seq), int(at), body if isinstance(body, str) else None)
            if n >= PORTION:
                applied()
        applied()
        if not whole and len(entries) < self.limit:
            whole, entries = self._fill(runs)
        if changed:
            self.short.update((runs, whole, json.dumps(entries)))
            out = [(key[0], -at, id_, body) for at, id_, body in entries[: self.limit]] or [(key[0], 0, None, None)]
            yield pd.DataFrame(out, columns=["shard", "at", "id", "body"])

    def close(self) -> None:
        pass


def newest_offers(changes: DataFrame, offers: DataFrame, limit: int = S.LISTING_LIMIT, shards: int | None = None, spare: int | None = None) -> DataFrame:
    """Stream of the newest ``limit`` offers of each shard that a micro-batch changed.

    changes: a stream of `changes_enriched`; offers: the snapshot it starts from.
    A shard without any offer puts out one row without id.
    """
    shards = shards or int(offers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spare = 3 * limit if spare is None else spare
    start = _packed(_listed(offers.where(F.col("id").isNotNull()), shards, F.lit(START), F.lit(True)), shards)
    events = _bucketed(_listed(changes.withColumn("id", F.col("offer_id")), shards, F.col("seq"), F.col("type") == "offer_changed"))
    return events.groupBy("shard").transformWithStateInPandas(
        NewestOffers(limit, spare), outputStructType=SHARD_OUT, outputMode="Update", timeMode="None",
        initialState=start.groupBy("shard"))


def _stores(spark) -> int:
    """Partitions of the state: an executor that has worked on one keeps it open with threads and buffers of its
    own, so their number follows the cores and not the rows; more shards are more groups to a partition."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(96, STORES * spark.sparkContext.defaultParallelism))


def _first_view(offers: DataFrame, limit: int, shards: int) -> DataFrame:
    """What the shards hold before the first change: at most ``limit`` rows each."""
    from offerlake.operators.lookups import top_k_per_group
    rows = offers.where(F.col("id").isNotNull()).select(_shard(shards), _at(), *S.LISTING_COLUMNS)
    top = top_k_per_group(rows, ["shard"], [F.col("at").desc(), F.col("id")], limit)  # before their text is made
    return _listed(top, shards, F.lit(START), F.lit(True)).select("shard", "at", "id", "body")


def run_newest_offers(changes: DataFrame, offers: DataFrame, limit: int = S.LISTING_LIMIT, shards: int | None = None, spare: int | None = None,
                      out: str | None = None, checkpoint: str | None = None) -> str:
    """Run `newest_offers` over what is available now. Every micro-batch writes the whole view, at most
    shards * limit rows, as the folder of its number; a batch that is run again writes the same."""
    spark = offers.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out, checkpoint = out or scratch_path(spark, "newest"), checkpoint or scratch_path(spark, "ckpt-newest")
    mark = spark.createDataFrame([(-1, 0, None, None)], SHARD_OUT)  # a view without offers is a view as well
    _first_view(offers, limit, shards).unionByName(mark).write.mode("ignore").parquet(f"{out}/batch=-1")

    def write(df: DataFrame, batch_id: int) -> None:
        now = df.persist()
        before = df.sparkSession.read.schema(SHARD_OUT).parquet(f"{out}/batch={batch_id - 1}")
        view = before.join(now.select("shard").distinct(), "shard", "left_anti").unionByName(now.where("id is not null"))
        view.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        now.unpersist()

    stream = newest_offers(changes, offers, limit, shards, spare)
    with rocksdb_state(spark, _stores(spark)):
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return out


def read_newest_offers(spark, out: str, limit: int = S.LISTING_LIMIT) -> DataFrame:
    """The listing as the last micro-batch left it."""
    rows = spark.read.schema(SHARD_OUT + ", batch INT").parquet(out)
    last = rows.agg(F.max("batch")).first()[0]  # the number of the newest folder
    top = rows.where((F.col("batch") == last) & F.col("id").isNotNull()).orderBy(F.col("at").desc(), F.col("id")).limit(limit)
    return top.select(F.from_json("body", LISTED, JSON_TIMES).alias("r")).select("r.*")


# ---------------------------------------------------------------------------
# funding from two streams
# ---------------------------------------------------------------------------
FUNDING_OUT = "payment_hash STRING, quote STRING, status STRING, ts_us LONG, final BOOLEAN"


def _funding(keep_ms: int):
    """One shard of payment hashes: for each its waiting quote, its decision and, once there is an end, when it is dropped."""
    import numpy as np

    empty = {"hash": np.empty(0, object), "quote": np.empty(0, object), "status": np.empty(0, object), "seq": np.empty(0, np.int64),
             "ts_us": np.empty(0, np.int64), "done": np.empty(0, bool), "gone_ms": np.empty(0, np.int64)}

    def run(key, pdfs, state: GroupState):
        held = Z.unpack(state.get[0]) if state.exists else empty
        rows = Z.rows_of([] if state.hasTimedOut else pdfs, ["payment_hash", "quote", "status", "seq", "ts_us", "came_ms"])
        hashes, code = Z.numbered(held["hash"], rows["payment_hash"].to_numpy(object))
        n = len(hashes)
        quote, status = (Z.extended(held[c], n, None) for c in ("quote", "status"))
        seq, ts_us, gone = (Z.extended(held[c], n, Z.NONE) for c in ("seq", "ts_us", "gone_ms"))
        done, waiting = Z.extended(held["done"], n, False), ~pd.isna(quote)
        came = np.full(n, Z.NONE)
        np.maximum.at(came, code, Z.whole(rows["came_ms"]))
        touched = came != Z.NONE

        asked = rows.assign(k=code)[rows["quote"].notna()].sort_values(["k", "quote"]).drop_duplicates("k")
        at = asked["k"].to_numpy()
        new = ~done[at] & ~waiting[at]
        quote[at[new]] = asked["quote"].to_numpy(object)[new]

        decided = rows.assign(k=code)[rows["status"].notna()].sort_values(["k", "seq", "status", "ts_us"]).drop_duplicates("k")
        at, first = decided["k"].to_numpy(), Z.whole(decided["seq"])
        new = ~done[at] & ((seq[at] == Z.NONE) | (first < seq[at]))
        seq[at[new]], ts_us[at[new]], status[at[new]] = first[new], Z.whole(decided["ts_us"])[new], decided["status"].to_numpy(object)[new]

        live = touched & ~done & ~pd.isna(quote)
        final, pending = live & ~pd.isna(status), live & pd.isna(status) & ~waiting
        out = pd.concat([pd.DataFrame({"payment_hash": hashes[m], "quote": quote[m], "status": status[m] if f else None,
                                       "ts_us": pd.array(ts_us[m] if f else [None] * int(m.sum()), "Int64"), "final": f})
                         for m, f in ((final, True), (pending, False)) if m.any()] or [pd.DataFrame()])
        done |= final
        quote[done] = None
        ends = done | pd.isna(quote)  # only a quote waits without an end
        gone[touched] = np.where(ends, came + keep_ms, Z.NONE)[touched]
        watermark = state.getCurrentWatermarkMs()
        keep = touched | (gone == Z.NONE) | (gone >= watermark)
        if keep.any():
            state.update((Z.pack({c: v[keep] for c, v in zip(empty, (hashes, quote, status, seq, ts_us, done, gone))}),))
            timed = gone[keep & (gone != Z.NONE)]
            if len(timed):
                state.setTimeoutTimestamp(max(int(timed.min()), watermark + 1))
        elif state.exists:
            state.remove()
        if len(out):
            yield out

    return run


def funding_decisions(quotes: DataFrame, updates: DataFrame, keep_ms: int = 3_600_000) -> DataFrame:
    """Stream of (payment_hash, quote, status, ts_us, final) from a stream of priced quotes and one of updates.

    A quote comes out once when it arrives without its update (final false) and
    once with the update that decides it. The updates of one hash come in the
    order of their seq, as from a feed that is keyed by hash; within a
    micro-batch they may stand in any order. Of two quotes with one hash in a
    micro-batch the first by its text counts, later ones are no quotes of that
    invoice; a quote without a payment hash is never decided. No row is too
    late, whatever its time. A decided hash, and an update without a quote, are
    kept for ``keep_ms`` after they came, so that repeated and early updates
    find them, and then dropped.
    """
    from offerlake.operators.changes import DECISIVE
    none = F.lit(None)
    body = F.to_json(F.struct(*quotes.columns), JSON_TIMES).alias("quote")
    left = quotes.where(F.col("payment_hash").isNotNull()).select(
        "payment_hash", body, none.cast("string").alias("status"), none.cast("long").alias("seq"), none.cast("long").alias("ts_us"))
    right = updates.where(F.col("status").isin(DECISIVE) & F.col("payment_hash").isNotNull() & F.col("ts").isNotNull()).select(
        "payment_hash", none.cast("string").alias("quote"), "status", F.col("seq").cast("long").alias("seq"), epoch_us("ts").alias("ts_us"))
    # the watermark follows the time of arrival, of which no row is late
    both = left.unionByName(right).withColumn("came", F.current_timestamp()).withWatermark("came", "0 seconds").withColumn("came_ms", F.unix_millis("came"))
    met = both.withColumn("shard", Z.shard_of("payment_hash")).groupBy("shard").applyInPandasWithState(
        _funding(keep_ms), outputStructType=FUNDING_OUT, stateStructType=Z.STATE,
        outputMode="append", timeoutConf=GroupStateTimeout.EventTimeTimeout)
    alone = quotes.where(F.col("payment_hash").isNull()).select(
        "payment_hash", body, none.cast("string").alias("status"), none.cast("long").alias("ts_us"), F.lit(False).alias("final"))
    return met.unionByName(alone)


def funding_outcomes(decisions: DataFrame, quote_schema: T.StructType, offers: DataFrame) -> DataFrame:
    """Funding outcome of every decision: the stream meets the stored offers by payment hash."""
    from offerlake.functions import EPOCH_NTZ
    from offerlake.operators.changes import funding_rows
    ts = F.lit(EPOCH_NTZ).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("ts_us") / F.lit(1_000_000))
    rows = decisions.select("final", F.from_json("quote", quote_schema, JSON_TIMES).alias("q"), F.when(F.col("final"), F.struct("status", ts.alias("ts"))).alias("_d"))
    existing = offers.select(F.col("hold_invoice_payment_hash").alias("payment_hash")).where("payment_hash is not null").distinct().withColumn("_exists", F.lit(True))
    return funding_rows(rows.select("final", "q.*", "_d").join(existing, "payment_hash", "left"), ["final"])
