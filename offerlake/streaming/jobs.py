"""Structured Streaming versions of the operators.

The operators take and return streaming DataFrames, so they attach to any
source: the stateless ones are the batch functions themselves
(`enrich_audit`, `validate_requests`, `changes_enriched`,
`audit_changes_enriched`), the stateful ones are `rate_rounds`,
`deadline_timers`, `changes.first_decisions` and
`lifecycle.status_update_aggregates`. Sinks are file sinks or
``foreachBatch`` writers with a checkpoint under the shared checkpoint
folder, so a restarted query resumes where it stopped.

The ``stream_*`` functions run one operator over a landed folder of files in
several micro-batches and return what its sink holds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from offerlake import schema as S
from offerlake.sources import commits
from offerlake.sources.io import scratch_path
from offerlake.streaming import shards as Z

LANDED_FILES = 4
FILE_BYTES = 64 << 20
FILE_ROWS = 100_000


def files_for(df: DataFrame, least: int = LANDED_FILES) -> int:
    """A number of files that keeps each near FILE_BYTES, by the planner's size estimate."""
    return max(least, -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // FILE_BYTES))


def land_files(df: DataFrame, name: str, files: int | None = None) -> tuple[str, T.StructType]:
    """Write ``df`` as a folder of Parquet files (a replayable source), as many
    as its size asks for; the files hold the rows in no particular order."""
    path = scratch_path(df.sparkSession, f"src-{name}")
    df.repartition(files or files_for(df)).write.parquet(path)
    return path, df.schema


def landed_stream(df: DataFrame, name: str) -> DataFrame:
    """``df`` landed and read as a stream of LANDED_FILES micro-batches. The files of a micro-batch follow the
    number of rows (the planner's estimate of a join is the product of its sides) and are read side by side."""
    files = max(LANDED_FILES, -(-df.count() // FILE_ROWS))
    path, schema = land_files(df, name, files)
    return read_stream(df.sparkSession, path, schema, -(-files // LANDED_FILES))


def landing_steps(df: DataFrame, path: str, order: str, steps: int = 4, files: int | None = None):
    """Land ``df`` the way a feed arrives: ``steps`` equal spans of the
    timestamp ``order`` one after another, each written by parallel tasks
    as ``files`` files, by default as many as its share of the rows asks for.
    Rows without a time come with the first. Yields the files a span has at most."""
    at = F.unix_micros(F.col(order).cast("timestamp"))
    lo, hi, n = df.agg(F.min(at), F.max(at), F.count("*")).first()
    files = files or max(LANDED_FILES, -(-n // (steps * FILE_ROWS)))
    width = ((hi or 0) - (lo or 0)) // steps + 1
    step = F.coalesce(F.floor((at - F.lit(lo or 0)) / F.lit(width)), F.lit(0))
    for k in range(steps):
        df.where(step == k).repartition(files).write.mode("append").parquet(path)
        yield files


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own: what every micro-batch reads is worked out once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = 1) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def run_to_files(stream: DataFrame, name: str, mode: str = "append", out: str | None = None,
                 checkpoint: str | None = None) -> str:
    """Run a stream over everything available now into a Parquet file sink.
    Pass stable ``out`` / ``checkpoint`` locations for a production job so a
    restarted query resumes from its checkpoint (exactly-once file sink);
    without them each call is a fresh one-shot run."""
    spark = stream.sparkSession
    out = out or scratch_path(spark, f"sink-{name}")
    ckpt = checkpoint or scratch_path(spark, f"ckpt-{name}")
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def run_foreach_batch(stream: DataFrame, name: str, fn, mode: str = "update", out: str | None = None,
                      checkpoint: str | None = None) -> str:
    """Run a stream with a ``foreachBatch`` writer; ``fn(batch_df, batch_id,
    out_path)`` must be idempotent per batch id (it is re-run after a
    failure). Stable ``out`` / ``checkpoint`` locations make it resumable."""
    spark = stream.sparkSession
    out = out or scratch_path(spark, f"sink-{name}")
    ckpt = checkpoint or scratch_path(spark, f"ckpt-{name}")
    q = (stream.writeStream.foreachBatch(lambda df, bid: fn(df, bid, out))
         .option("checkpointLocation", ckpt).outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def _batch_writer(df: DataFrame, batch_id: int, out: str) -> None:
    # One folder per batch id: a retried batch overwrites its own folder.
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


# ---------------------------------------------------------------------------
# stateless
# ---------------------------------------------------------------------------
def stream_enrich_audit(spark: SparkSession, records: DataFrame) -> DataFrame:
    from offerlake.operators.audit import enrich_audit
    out = run_to_files(enrich_audit(landed_stream(records, "log-records")), "audit")
    return spark.read.schema(S.AUDIT_SCHEMA).parquet(out)


def stream_validate_requests(spark: SparkSession, requests: DataFrame) -> DataFrame:
    from offerlake.operators.feed import validate_requests
    out = run_to_files(validate_requests(landed_stream(requests, "requests")), "validated")
    return spark.read.parquet(out)


def read_changes(spark: SparkSession, changes: DataFrame, name: str = "changes") -> DataFrame:
    """The change feed as a stream (files landed by the capture job)."""
    return landed_stream(changes, name)


# ---------------------------------------------------------------------------
# stream-static joins
# ---------------------------------------------------------------------------
def stream_offer_changes(spark: SparkSession, changes: DataFrame, offers: DataFrame) -> DataFrame:
    from offerlake.operators.changes import changes_enriched
    stream = changes_enriched(read_changes(spark, changes, "offer-changes"), offers)
    return spark.read.parquet(run_to_files(stream, "offer-changes"))


def stream_audit_changes(spark: SparkSession, changes: DataFrame, audit: DataFrame) -> DataFrame:
    """Each micro-batch of changes meets the audit; only its own offers' audit rows are reduced."""
    from offerlake.operators.changes import AUDIT_VIEW, audit_changes_enriched
    audit = stored(audit.select(*AUDIT_VIEW), "audit")
    out = run_foreach_batch(read_changes(spark, changes, "audit-changes"), "audit-changes",
                            lambda df, bid, to: _batch_writer(audit_changes_enriched(df, audit), bid, to), mode="append")
    return spark.read.parquet(out).drop("batch_id", "batch")


# ---------------------------------------------------------------------------
# latest-per-key
# ---------------------------------------------------------------------------
def stream_recent_offers(spark: SparkSession, changes: DataFrame, offers: DataFrame,
                         limit: int = S.LISTING_LIMIT) -> DataFrame:
    """Live top-N listing: the snapshot of all offers first, then upserts by
    id from the enriched change stream (changed -> replace, removed ->
    delete); the view is the true top N by coalesce(updated_at, created_at),
    kept by the stream itself (`views.newest_offers`)."""
    from offerlake.operators.changes import changes_enriched
    from offerlake.streaming import views
    enriched = changes_enriched(read_changes(spark, changes, "recent"), offers)
    return views.read_newest_offers(spark, views.run_newest_offers(enriched, offers, limit), limit)


def stream_offer_audit(spark: SparkSession, changes: DataFrame, audit: DataFrame, offer_id: str | None = None,
                       limit: int = S.LISTING_LIMIT) -> DataFrame:
    """Per-offer audit view on a stream: the stored lines of every offer first;
    then an entry of the stream replaces the one with its id or is added. Each
    offer shows its newest ``limit`` entries. ``offer_id`` restricts the view
    to one offer."""
    from offerlake.operators.changes import AUDIT_VIEW, audit_changes_enriched
    from offerlake.operators.lookups import top_k_per_group
    audit = stored(audit.select(*AUDIT_VIEW), "audit")
    before, keys = audit.where(F.col("offer_id").isNotNull()), ["offer_id", "entry_id"]
    feed = read_changes(spark, changes, "offer-audit")
    if offer_id is not None:
        feed, before = feed.where(F.col("offer_id") == offer_id), before.where(F.col("offer_id") == offer_id)
    shown = ["seq", "offer_id", *[f"entry_{c}" for c in AUDIT_VIEW if c != "offer_id"]]

    def log(df: DataFrame, batch_id: int, to: str) -> None:
        entries = audit_changes_enriched(df, audit).where(F.col("entry_id").isNotNull()).select(*shown)
        commits.log_newest(entries, to, batch_id, keys, "seq")

    path = run_foreach_batch(feed, "offer-audit", log, mode="append")
    types = {"seq": feed.schema["seq"].dataType, "offer_id": feed.schema["offer_id"].dataType, **{f"entry_{c}": audit.schema[c].dataType for c in AUDIT_VIEW}}
    latest = commits.read_newest(spark, path, T.StructType([T.StructField(c, types[c]) for c in [*keys, *[c for c in shown if c not in keys]]]), keys, "seq").drop("seq")
    # the newest of the stored lines are enough: a line that is not among them could only come up if the stream
    # removed one, and it only replaces or adds
    lines = top_k_per_group(before, ["offer_id"], [F.col("created_at").desc(), F.col("id").desc()], limit).select(
        "offer_id", *[F.col(c).alias(f"entry_{c}") for c in AUDIT_VIEW if c != "offer_id"])
    both = latest.unionByName(lines.join(latest.select(*keys), keys, "left_anti"))
    top = top_k_per_group(both, ["offer_id"], [F.col("entry_created_at").desc(), F.col("entry_id").desc()], limit, rank_col="entry_rank")
    return top.select("offer_id", "entry_rank", *[f"entry_{c}" for c in AUDIT_VIEW if c != "offer_id"])


# ---------------------------------------------------------------------------
# streaming aggregation
# ---------------------------------------------------------------------------
def rate_rounds(payloads: DataFrame, late: str | None = None) -> DataFrame:
    """Sum and number of the valid rates of each fetch round, updated with
    every payload however late it comes. ``late`` bounds the state instead:
    rounds that much older than the newest payload are closed."""
    from offerlake.operators.pricing import parse_rates
    parsed = parse_rates(payloads).where(F.col("rate").isNotNull())
    keys = [F.col("round_id")]
    if late is not None:
        parsed = parsed.withColumn("event_time", F.col("fetched_at").cast("timestamp")).withWatermark("event_time", late)
        keys.append(F.window("event_time", f"{S.RATE_VALIDITY_MINUTES} minutes"))
    return parsed.groupBy(*keys).agg(F.min("fetched_at").alias("fetched_at"),
                                     F.sum(F.col("rate").cast("decimal(24,8)")).alias("_sum"), F.count("rate").alias("n_sources"))


def stream_rates(spark: SparkSession, payloads: DataFrame) -> DataFrame:
    """Average rate per fetch round over a stream of payloads."""
    rate = (F.col("_sum").cast("double") / F.col("n_sources")).alias("rate")
    rounds = rate_rounds(landed_stream(payloads, "rates")).select("round_id", "fetched_at", rate, "n_sources")
    log = run_foreach_batch(rounds, "rates", lambda df, bid, to: commits.log_newest(df.withColumn("batch_id", F.lit(bid).cast("long")), to, bid, ["round_id"], "batch_id"))
    return commits.read_newest(spark, log, T.StructType([*rounds.schema.fields, T.StructField("batch_id", T.LongType())]), ["round_id"], "batch_id").drop("batch_id")


# ---------------------------------------------------------------------------
# funding
# ---------------------------------------------------------------------------
def stream_fund_offers(spark: SparkSession, priced_quotes: DataFrame, updates: DataFrame,
                       offers: DataFrame) -> DataFrame:
    """Funding outcome of every quote from a stream of priced quotes and one of
    hold-invoice updates (`views.funding_decisions`); the stored offers are a
    table that the stream meets. The newest of a quote's at most two results."""
    from offerlake.streaming import views
    quotes, path = landed_stream(priced_quotes, "priced-quotes"), scratch_path(spark, "src-quote-updates")
    *_, files = landing_steps(updates, path, "ts", LANDED_FILES)
    decided = views.funding_decisions(quotes, read_stream(spark, path, updates.schema, files_per_trigger=files))
    results = spark.read.parquet(run_to_files(views.funding_outcomes(decided, quotes.schema, offers), "fund"))
    cols = [c for c in results.columns if c not in ("final", "quote_id")]
    return results.groupBy("quote_id").agg(F.max_by(F.struct(*cols), F.col("final")).alias("r")).select("quote_id", "r.*")


# ---------------------------------------------------------------------------
# per-offer timers (custom stateful operator)
# ---------------------------------------------------------------------------
_TIMED = {"funded": ("created", S.FUNDED_EXPIRY_SECONDS, "expired"),
          "reserved": ("reserved", S.RESERVATION_SECONDS, "funded"),
          "blikReceived": ("blik", S.BLIK_CONFIRMATION_SECONDS, "expiredBlik"),
          "blikSentToMaker": ("blik", S.BLIK_CONFIRMATION_SECONDS, "expiredSentBlik"),
          "takerCharged": ("created", S.TAKER_CHARGED_AUTO_CONFIRM_SECONDS, "settled"),
          "conflict": ("event", S.CONFLICT_AUTO_DISPUTE_SECONDS, "dispute")}

#: Statuses without a timer that no action leaves: an offer's timers end with their event.
TERMINAL = frozenset(S.STATUSES) - set(_TIMED) - {f for _, moves in S.TRANSITIONS.values() for f in moves}
DEADLINE_OUT = "offer_id STRING, status STRING, timeout_status STRING, due_ms LONG, fired_ms LONG, ignored_seq INT"
DEADLINE_STATE = "status STRING, seq INT, due_ms LONG, created_ms LONG, reserved_ms LONG, blik_ms LONG, entered_ms LONG"
NOTHING = (None, -1, None, None, None, None, None)


def _enter(state: tuple, status: str, at_ms: int) -> tuple:
    """The offer takes ``status`` at ``at_ms``; its deadline, if any, is set."""
    _, seq, _, created_ms, reserved_ms, blik_ms, _ = state
    if status == "funded" and created_ms is None:
        created_ms = at_ms
    if status == "reserved":
        reserved_ms = at_ms
    if status == "blikReceived":
        blik_ms = at_ms
    due = None
    if status in _TIMED:
        base, secs, _ = _TIMED[status]
        start = {"created": created_ms, "reserved": reserved_ms, "blik": blik_ms}.get(base)
        due = (at_ms if start is None else start) + secs * 1000
    return status, seq, due, created_ms, reserved_ms, blik_ms, at_ms


def _fire(state: tuple, upto_ms: int, fired: list[tuple]) -> tuple:
    """Fire every timer due by ``upto_ms``: the timeout status becomes the
    offer's status and may set the next timer, which fires at once if it is
    already late."""
    while state[2] is not None and state[2] <= upto_ms:
        status, _, due, *_, entered = state
        at = max(due, entered)
        fired.append((status, _TIMED[status][2], due, at))
        state = _enter(state, _TIMED[status][2], at)
    return state


def _walk(state: tuple, pdfs, fired: list[tuple], ignored: list[tuple]) -> tuple:
    """Take new status events in order; before each one, the timers due by its
    time fire. An event with a known or older sequence number changes nothing
    and is noted."""
    rows = [(int(r.seq), r.status, int(r.ts_ms)) for pdf in pdfs for r in pdf.itertuples(index=False)]
    for seq, status, ts_ms in sorted(rows):
        if seq > state[1]:
            state = _fire(state, ts_ms, fired)
            state = _enter((state[0], seq, *state[2:]), status, ts_ms)
        else:
            ignored.append((status, seq))
    return state


def _over(state: tuple) -> bool:
    """The offer's last event is a terminal status: nothing is waited for any more."""
    return state[0] in TERMINAL and state[2] is None


def _fired(offer_id: str, fired: list[tuple], ignored: list[tuple] = ()) -> pd.DataFrame:
    rows = [(offer_id, *f, None) for f in fired] + [(offer_id, status, None, None, None, seq) for status, seq in ignored]
    out = pd.DataFrame(rows, columns=["offer_id", "status", "timeout_status", "due_ms", "fired_ms", "ignored_seq"])
    return out.astype({"due_ms": "Int64", "fired_ms": "Int64", "ignored_seq": "Int32"})


_NAMES = list(_TIMED)  # a timed status as a number; _END and _OTHER are the ones without a timer
_END, _OTHER = len(_NAMES), len(_NAMES) + 1
_CODE = {**{s: k for k, s in enumerate(_NAMES)}, **{s: _END for s in TERMINAL}}
_AFTER = np.array([_CODE.get(to, _OTHER) for _, _, to in _TIMED.values()], np.int64)
FEW = 32  # fewer offers than this are walked one by one


class Timers:
    """The timers of a shard's offers as arrays: `_enter`, `_fire` and `_walk` for all of them at once."""

    COLUMNS = ("offer_id", "code", "seq", "due_ms", "created_ms", "reserved_ms", "blik_ms", "entered_ms")

    def __init__(self, data: bytes | None, rows: pd.DataFrame):
        held = Z.unpack(data) if data is not None else {c: np.empty(0, object if c == "offer_id" else np.int64) for c in self.COLUMNS}
        self.ids, self.place = Z.numbered(held["offer_id"], rows["offer_id"].to_numpy(object))
        n = len(self.ids)
        fill = {"code": _OTHER, "seq": -1}
        self.code, self.seq, self.due, self.created, self.reserved, self.blik, self.entered = (
            Z.extended(held[c], n, fill.get(c, Z.NONE)) for c in self.COLUMNS[1:])
        self.rows, self.fired, self.ignored = rows, [], []

    def enter(self, k: np.ndarray, code: np.ndarray, at: np.ndarray) -> None:
        new = (code == _CODE["funded"]) & (self.created[k] == Z.NONE)
        self.created[k[new]] = at[new]
        for status, times in (("reserved", self.reserved), ("blikReceived", self.blik)):
            new = code == _CODE[status]
            times[k[new]] = at[new]
        due = np.full(len(k), Z.NONE)
        for c, (base, secs, _) in enumerate(_TIMED.values()):
            hit = code == c
            held = {"created": self.created, "reserved": self.reserved, "blik": self.blik}.get(base)
            start = at[hit] if held is None else np.where(held[k[hit]] == Z.NONE, at[hit], held[k[hit]])
            due[hit] = start + secs * 1000
        self.code[k], self.due[k], self.entered[k] = code, due, at

    def fire(self, k: np.ndarray, upto) -> None:
        upto = np.broadcast_to(upto, len(k))
        while len(k):
            late = (self.due[k] != Z.NONE) & (self.due[k] <= upto)
            k, upto = k[late], upto[late]
            code, due = self.code[k], self.due[k]
            at = np.maximum(due, self.entered[k])
            self.fired.append((k, code, due, at))
            if len(k):
                self.enter(k, _AFTER[code], at)

    def walk(self) -> None:
        if not len(self.rows):
            return
        ev = pd.DataFrame({"k": self.place, "seq": Z.whole(self.rows["seq"]), "status": self.rows["status"].to_numpy(object), "ts": Z.whole(self.rows["ts_ms"])})
        ev = ev.sort_values(["k", "seq", "status", "ts"], ignore_index=True)
        known = ev.duplicated(["k", "seq"]).to_numpy() | (ev["seq"].to_numpy() <= self.seq[ev["k"].to_numpy()])
        old = ev[known]
        self.ignored.append((old["k"].to_numpy(), old["status"].to_numpy(object), old["seq"].to_numpy()))
        ev = ev[~known]
        k, seq, status, ts = ev["k"].to_numpy(), ev["seq"].to_numpy(), ev["status"].to_numpy(object), ev["ts"].to_numpy()
        code = ev["status"].map(_CODE).fillna(_OTHER).to_numpy().astype(np.int64)
        begin = Z.firsts(k)
        size = np.diff(np.append(begin, len(k)))
        turn = 0
        while True:  # every offer's next event at once
            begin, size = begin[size > turn], size[size > turn]
            if len(begin) < FEW:
                break
            at = begin + turn
            self.fire(k[at], ts[at])
            self.enter(k[at], code[at], ts[at])
            self.seq[k[at]] = seq[at]
            turn += 1
        for b, n in zip(begin.tolist(), size.tolist()):  # few offers with many events
            self._walk_one(int(k[b]), list(zip(seq[b + turn: b + n].tolist(), status[b + turn: b + n], ts[b + turn: b + n].tolist())))

    def _walk_one(self, k: int, events: list[tuple]) -> None:
        times = (self.due, self.created, self.reserved, self.blik, self.entered)
        state = (_NAMES[self.code[k]] if self.code[k] < _END else None, int(self.seq[k]), *(None if t[k] == Z.NONE else int(t[k]) for t in times))
        fired: list[tuple] = []
        for seq, status, ts_ms in events:
            state = _fire(state, ts_ms, fired)
            state = _enter((state[0], seq, *state[2:]), status, ts_ms)
        self.code[k], self.seq[k] = _CODE.get(state[0], _OTHER), state[1]
        for t, v in zip(times, state[2:]):
            t[k] = Z.NONE if v is None else v
        if fired:
            was, _, due, at = zip(*fired)
            self.fired.append((np.full(len(fired), k), np.array([_CODE[s] for s in was]), np.array(due), np.array(at)))

    def over(self) -> np.ndarray:
        return (self.code == _END) & (self.due == Z.NONE)

    def packed(self, keep: np.ndarray) -> bytes:
        every = (self.ids, self.code, self.seq, self.due, self.created, self.reserved, self.blik, self.entered)
        return Z.pack({c: v[keep] for c, v in zip(self.COLUMNS, every)})

    def results(self):
        names, after = np.array(_NAMES, object), np.array([to for _, _, to in _TIMED.values()], object)
        for k, code, due, at in self.fired:
            if len(k):
                yield pd.DataFrame({"offer_id": self.ids[k], "status": names[code], "timeout_status": after[code], "due_ms": due, "fired_ms": at,
                                    "ignored_seq": pd.array([None] * len(k), "Int32")})
        for k, status, seq in self.ignored:
            if len(k):
                none = pd.array([None] * len(k), "Int64")
                yield pd.DataFrame({"offer_id": self.ids[k], "status": status, "timeout_status": None, "due_ms": none, "fired_ms": none, "ignored_seq": pd.array(seq, "Int32")})


def _deadline_fn(key, pdfs, state: GroupState):
    """A shard's timers: every offer's events in sequence order, due timers before
    each, then those the watermark has passed; the earliest pending timer of the
    shard is its event-time timeout. An offer's state stays, so that later deadlines
    count from its own times, until a terminal status lies behind the watermark."""
    rows = Z.rows_of([] if state.hasTimedOut else pdfs, ["offer_id", "seq", "status", "ts_ms"])
    timers = Timers(state.get[0] if state.exists else None, rows)
    timers.walk()
    watermark = state.getCurrentWatermarkMs()
    timers.fire(np.arange(len(timers.ids)), watermark - 1)
    over = timers.over()
    keep = ~(over & (timers.entered < watermark))
    if keep.any():
        state.update((timers.packed(keep),))
        ends = np.where(over, timers.entered + 1, timers.due)[keep]
        ends = ends[ends != Z.NONE]
        if len(ends):
            state.setTimeoutTimestamp(max(int(ends.min()), watermark + 1))
    elif state.exists:
        state.remove()
    yield from timers.results()


class DeadlineProcessor(StatefulProcessor):
    """The same timers with ``transformWithState``: one value state and at
    most one event-time timer per offer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.offer = handle.getValueState("offer", DEADLINE_STATE)

    def _settle(self, key, before: tuple, cur: tuple, watermark: int, fired: list[tuple], ignored: list[tuple], timer_gone: bool = False):
        cur = _fire(cur, watermark - 1, fired)
        if before[2] is not None and before[2] != cur[2] and not timer_gone:
            self.handle.deleteTimer(before[2])
        if _over(cur) and watermark > cur[6]:
            self.offer.clear()
        else:
            if cur[2] is not None and (cur[2] != before[2] or timer_gone):
                self.handle.registerTimer(cur[2])
            if _over(cur):
                self.handle.registerTimer(cur[6] + 1)
            self.offer.update(cur)
        if fired or ignored:
            yield _fired(key[0], fired, ignored)

    def handleInputRows(self, key, rows, timerValues):
        before, fired, ignored = (tuple(self.offer.get()) if self.offer.exists() else NOTHING), [], []
        cur = _walk(before, rows, fired, ignored)
        yield from self._settle(key, before, cur, timerValues.getCurrentWatermarkInMs(), fired, ignored)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.offer.exists():
            before = tuple(self.offer.get())
            yield from self._settle(key, before, before, timerValues.getCurrentWatermarkInMs(), [], [], timer_gone=True)

    def close(self) -> None:
        pass


def deadline_timers(events: DataFrame, delay: str = "1 minute", impl: str = "group_state") -> DataFrame:
    """Timeout transitions (times as epoch milliseconds of the UTC wall clock)
    of a stream of status events with columns offer_id, seq, status, ts_ms.

    An offer's events are taken by ``seq``; a timer fires before the first
    event at or after its due time, or once the watermark (newest event time
    less ``delay``) has passed it, whichever is seen first - so the result
    does not depend on how the events are cut into micro-batches, as long as
    none is later than ``delay``. ``fired_ms`` is the due time, or the time
    the status was entered if that is later.

    Events that change nothing come out as rows with ``ignored_seq``: those
    with a sequence number that the offer has passed, and those without a time.
    An offer's state ends when the watermark passes its terminal status.

    ``impl='group_state'`` uses ``applyInPandasWithState`` on shards of offers (`shards`);
    ``impl='transform_with_state'`` the Spark 4 stateful processor API, which
    needs the RocksDB state store (`session.BASE_CONF`)."""
    none = F.lit(None)
    untimed = events.where(F.col("ts_ms").isNull()).select(
        "offer_id", "status", none.cast("string").alias("timeout_status"), none.cast("long").alias("due_ms"), none.cast("long").alias("fired_ms"), F.col("seq").cast("int").alias("ignored_seq"))
    stream = events.where(F.col("ts_ms").isNotNull()).withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", delay)
    if impl == "transform_with_state":
        timed = stream.groupBy("offer_id").transformWithStateInPandas(
            DeadlineProcessor(), outputStructType=DEADLINE_OUT, outputMode="Append", timeMode="EventTime")
    else:
        timed = stream.withColumn("shard", Z.shard_of("offer_id")).groupBy("shard").applyInPandasWithState(
            _deadline_fn, outputStructType=DEADLINE_OUT, stateStructType=Z.STATE,
            outputMode="append", timeoutConf=GroupStateTimeout.EventTimeTimeout)
    return timed.unionByName(untimed)


def stream_deadlines(spark: SparkSession, events: DataFrame, delay: str = "1 minute",
                     impl: str = "group_state", steps: int = 4) -> DataFrame:
    """`deadline_timers` over events landed in ``steps`` spans of time, one
    micro-batch each. Offers whose deadline lies beyond the newest event time
    less ``delay`` stay pending."""
    from offerlake.functions import EPOCH_NTZ, epoch_ms
    src = events.select("offer_id", "seq", "status", epoch_ms("ts").alias("ts_ms"), "ts")
    path, sink, ckpt = (scratch_path(spark, f"{n}-deadlines") for n in ("src", "sink", "ckpt"))
    for _ in landing_steps(src, path, "ts", steps):  # whatever number of files a span has, it is one micro-batch
        stream = read_stream(spark, path, src.schema, files_per_trigger=None).drop("ts")
        run_to_files(deadline_timers(stream, delay, impl), "deadlines", out=sink, checkpoint=ckpt)
    out = spark.read.schema(DEADLINE_OUT).parquet(sink).where("ignored_seq is null")
    epoch = F.lit(EPOCH_NTZ).cast("timestamp_ntz")

    def ntz(ms_col: str):
        return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col(ms_col) / 1000)

    return out.select("offer_id", "status", "timeout_status", ntz("due_ms").alias("due_at"),
                      ntz("fired_ms").alias("fired_at"))


# ---------------------------------------------------------------------------
# order-feed publishing
# ---------------------------------------------------------------------------
def stream_publish_orders(spark: SparkSession, changes: DataFrame, offers: DataFrame) -> DataFrame:
    """Every offer change publishes the offer's current order event. Each
    micro-batch is written by ``foreachBatch`` into its own folder, so a
    retried batch rewrites the same output."""
    from offerlake.operators.feed import order_tags
    stream = read_changes(spark, changes, "publish").where(F.col("offer_id").isNotNull())
    rows = stream.join(offers.withColumnRenamed("id", "offer_id"), "offer_id").withColumnRenamed("offer_id", "id")
    events = rows.select("seq", "id", F.lit(S.ORDER_EVENT_KIND).alias("kind"),
                         F.to_json(order_tags()).alias("tags"))

    def write(df: DataFrame, batch_id: int, out: str) -> None:
        df.write.mode("overwrite").json(f"{out}/batch={batch_id}")

    out = run_foreach_batch(events, "publish", write, mode="append")
    return spark.read.schema("seq LONG, id STRING, kind INT, tags STRING").json(out).drop("batch")


# ---------------------------------------------------------------------------
# status updates as a stateful stream
# ---------------------------------------------------------------------------
def stream_apply_status_updates(spark: SparkSession, events: DataFrame, offers: DataFrame) -> DataFrame:
    """The per-field "last writer" aggregation of `apply_status_updates` as a
    streaming aggregation (state per offer in the state store, update mode).
    Each micro-batch logs the offers it changed; the newest entry per offer
    in the log is merged onto the current rows."""
    from offerlake.operators.lifecycle import merge_status_updates, status_update_aggregates
    agg = status_update_aggregates(landed_stream(events, "status-updates"))
    log = run_foreach_batch(agg, "status-updates", lambda df, bid, to: commits.log_newest(df.withColumn("batch_id", F.lit(bid).cast("long")), to, bid, ["id"], "batch_id"))
    latest = commits.read_newest(spark, log, T.StructType([*agg.schema.fields, T.StructField("batch_id", T.LongType())]), ["id"], "batch_id")
    return merge_status_updates(offers, latest.drop("batch_id"))
