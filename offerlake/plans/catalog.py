"""The query catalogue: every registered operator as (Spark plan, DuckDB oracle).

Each entry reads the test-data parquet of one scale factor through
`Tables`, so its work grows with the input. ``__spark_entry__`` only wires
this module to the driver contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from offerlake.plans import oracle as O
from offerlake.sources.fixtures import ORDERS_AS_OF, Tables, with_fixtures

QueryFn = Callable[[Tables], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(key: str, sql: str | None = None, *fixtures: str):
    def deco(fn: QueryFn) -> QueryFn:
        if key in REGISTRY:
            raise KeyError(f"duplicate query key {key}")
        REGISTRY[key] = (fn, with_fixtures(sql, *fixtures) if sql else None)
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: (lambda spark, sf_dir, _fn=fn: _fn(Tables(spark, sf_dir)))
            for k, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: sql for k, (_, sql) in REGISTRY.items() if sql}


_LOADED = False


def _load() -> None:
    global _LOADED
    if _LOADED:
        return
    _LOADED = True
    from offerlake.plans import queries_all  # noqa: F401  (registers everything)


# ---------------------------------------------------------------------------
# §2.3 reports
# ---------------------------------------------------------------------------
def _reports() -> None:
    from offerlake.operators import reports as R

    register("metrics_daily", O.metrics_period_sql("daily"), "offers")(
        lambda t: R.metrics_by_period(t.offers, "daily", ORDERS_AS_OF))
    register("metrics_weekly", O.metrics_period_sql("weekly"), "offers")(
        lambda t: R.metrics_by_period(t.offers, "weekly", ORDERS_AS_OF))
    register("metrics_monthly", O.metrics_period_sql("monthly"), "offers")(
        lambda t: R.metrics_by_period(t.offers, "monthly", ORDERS_AS_OF))
    register("metrics_totals", O.METRICS_TOTALS, "offers")(lambda t: R.metrics_totals(t.offers))

    def rolled_up(t: Tables):
        """Day states of offers of which some months changed since, refreshed for those."""
        from pyspark.sql import functions as F

        from offerlake.operators import rollup as RU
        from offerlake.sources import io as IO
        path = IO.scratch_path(t.spark, "day-states")
        changed = F.col("created_at").between("1997-03-01", "1997-06-15")
        RU.write_states(t.offers.withColumn("status", F.when(changed, F.lit("expired")).otherwise(F.col("status"))), path)
        RU.refresh(t.offers, path, ["1997-03", "1997-04", "1997-05", "1997-06"])
        return RU.read_states(t.spark, path)

    def merged(report):
        from offerlake.operators import rollup as RU
        return lambda t: report(RU, rolled_up(t))

    register("rollup_weekly", O.metrics_period_sql("weekly"), "offers")(merged(lambda ru, s: ru.period_report(s, "weekly")))
    register("rollup_monthly", O.metrics_period_sql("monthly"), "offers")(merged(lambda ru, s: ru.period_report(s, "monthly")))
    register("rollup_totals", O.METRICS_TOTALS, "offers")(merged(lambda ru, s: ru.totals_report(s)))
    register("taker_domain_ranking", O.TAKER_DOMAIN_RANKING, "offers")(
        lambda t: R.taker_domain_ranking(t.offers))
    register("weekday_profile", O.WEEKDAY_PROFILE, "offers")(lambda t: R.weekday_profile(t.offers))
    register("success_stats", O.SUCCESS_STATS, "offers")(
        lambda t: R.success_stats(t.offers, ORDERS_AS_OF))
    register("recent_successes", O.RECENT_SUCCESSES, "offers")(
        lambda t: R.recent_successes(t.offers, ORDERS_AS_OF))
    register("sweep_summary", O.SWEEP_SUMMARY, "offers")(
        lambda t: R.sweep_summary(t.offers, ORDERS_AS_OF))


# ---------------------------------------------------------------------------
# §2.2 lookups
# ---------------------------------------------------------------------------
def _lookups() -> None:
    from pyspark.sql import functions as F

    from offerlake.operators import lookups as L

    register("offer_by_id", O.OFFER_BY_ID, "offers", "offer_changes")(
        lambda t: L.offers_by_ids(t.offers, t.offer_changes))
    register("offer_by_payment_hash", O.OFFER_BY_PAYMENT_HASH, "offers", "invoice_updates")(
        lambda t: L.offer_by_payment_hash(
            t.offers, t.invoice_updates.where(F.col("raw_state").isin("ACCEPTED", "hold_invoice_accepted"))))
    register("offers_by_status", O.OFFERS_BY_STATUS, "offers")(
        lambda t: L.offers_by_status(t.offers).select(*O.S.OFFER_COLUMNS))
    register("my_active_offers", O.MY_ACTIVE_OFFERS, "offers")(
        lambda t: L.my_active_offers(t.offers).select("user_pubkey", *O.S.OFFER_COLUMNS))
    register("my_active_offer", O.MY_ACTIVE_OFFER, "offers")(lambda t: L.my_active_offer(t.offers))
    register("my_finished_offers", O.MY_FINISHED_OFFERS, "offers")(
        lambda t: L.my_finished_offers(t.offers, ORDERS_AS_OF))
    register("offers_last_hours", O.OFFERS_LAST_HOURS, "offers")(
        lambda t: L.offers_last_hours(t.offers, ORDERS_AS_OF, hours=168))
    register("recent_offers", O.RECENT_OFFERS, "offers")(lambda t: L.recent_offers(t.offers))
    register("audit_by_offer", O.AUDIT_BY_OFFER, "audit")(
        lambda t: L.audit_by_offer(t.audit).select(*O.S.AUDIT_COLUMNS))
    register("audit_by_id", O.AUDIT_BY_ID, "audit", "audit_changes")(
        lambda t: L.audit_by_ids(t.audit, t.audit_changes))
    register("offer_public_view", O.OFFER_PUBLIC_VIEW, "offers")(lambda t: L.offer_public_view(t.offers))
    register("offer_public_view_pubkeys", O.OFFER_PUBLIC_VIEW_PUBKEYS, "offers")(
        lambda t: L.offer_public_view(t.offers, with_pubkeys=True))


# ---------------------------------------------------------------------------
# §2.9 audit enrichment
# ---------------------------------------------------------------------------
def _audit() -> None:
    from offerlake.operators import audit as A

    register("enrich_audit", O.ENRICH_AUDIT, "audit")(lambda t: A.enrich_audit(t.log_records))
    register("infer_level", O.INFER_LEVEL, "log_records")(
        lambda t: t.log_records.select("record_id", A.infer_level().alias("level")))
    register("infer_action", O.INFER_ACTION, "log_records")(
        lambda t: t.log_records.select("record_id", A.infer_action().alias("action")))
    register("infer_offer_id", O.INFER_OFFER_ID, "log_records")(
        lambda t: t.log_records.select("record_id", A.infer_offer_id().alias("offer_id")))
    register("normalize_offer_id", O.NORMALIZE_OFFER_ID, "log_records")(
        lambda t: t.log_records.select("record_id", A.normalize_offer_id("offer_id").alias("offer_id")))
    register("cleanse_audit", O.CLEANSE_AUDIT, "log_records")(
        lambda t: A.cleanse_audit(t.log_records).select("record_id", "offer_id"))


# ---------------------------------------------------------------------------
# §2.8 order feed and messaging
# ---------------------------------------------------------------------------
def _feed() -> None:
    from offerlake.operators import feed as FD

    register("feed_status", O.FEED_STATUS, "offers")(lambda t: FD.feed_status_of(t.offers))
    register("order_events", O.ORDER_EVENTS, "offers")(lambda t: FD.order_events(t.offers, as_json=True))
    register("order_expiration", O.ORDER_EXPIRATION, "offers")(lambda t: FD.order_expiration(t.offers))
    register("rebroadcast_orders", O.REBROADCAST_ORDERS, "offers")(
        lambda t: FD.rebroadcast_orders(t.offers, ORDERS_AS_OF, hours=168, as_json=True))
    register("status_fanout", O.STATUS_FANOUT, "offers")(lambda t: FD.status_fanout(t.offers))
    register("validate_requests", O.VALIDATE_REQUESTS, "requests")(
        lambda t: FD.validate_requests(t.requests))
    register("validate_typed_requests", O.VALIDATE_TYPED_REQUESTS, "typed_requests")(
        lambda t: FD.validate_requests(t.typed_requests))


# ---------------------------------------------------------------------------
# §2.6 pricing and fees
# ---------------------------------------------------------------------------
def rounds_of(t: Tables):
    from offerlake.operators import pricing as P
    return P.average_rate(P.parse_rates(t.rate_payloads))


def priced_quotes(t: Tables):
    from offerlake.operators import pricing as P
    return P.rate_at(t.quotes, rounds_of(t))


def _pricing() -> None:
    from pyspark.sql import functions as F

    from offerlake.operators import pricing as P
    from offerlake.operators import reports as R

    register("parse_rates", O.PARSE_RATES, "rate_payloads")(lambda t: P.parse_rates(t.rate_payloads))
    register("average_rate", O.AVERAGE_RATE, "rate_payloads")(rounds_of)
    register("rate_at", O.RATE_AT, "rate_payloads", "quotes")(priced_quotes)
    register("quote_offer", O.QUOTE_OFFER, "rate_payloads", "quotes")(lambda t: P.quote_offer(priced_quotes(t)))
    register("taker_net_amount", O.TAKER_NET_AMOUNT, "offers")(lambda t: P.taker_net_amount(t.offers))
    register("invoice_tolerance", O.INVOICE_TOLERANCE, "action_log", "offers")(
        lambda t: P.check_invoice_tolerance(t.action_log, t.offers))

    def _amount_match(t: Tables):
        net = P.taker_net_amount(t.offers.where(F.col("taker_invoice").isNotNull()))
        k = F.substring("id", 25, 12).cast("bigint")
        inv = (F.when(k % 5 == 0, F.lit(0)).when(k % 5 == 1, F.col("net_at_payment") + 1)
               .otherwise(F.col("net_at_payment")))
        df = net.select("id", inv.cast("bigint").alias("invoice_amount_sats"),
                        F.col("net_at_payment").alias("expected_sats"))
        return df.withColumn("error", P.invoice_amount_match(F.col("invoice_amount_sats"), F.col("expected_sats")))

    register("invoice_amount_match", O.INVOICE_AMOUNT_MATCH, "offers")(_amount_match)
    register("fee_limit", O.FEE_LIMIT, "offers")(lambda t: P.fee_limit(t.offers))
    register("sendable_range", O.SENDABLE_RANGE, "offers", "addresses")(
        lambda t: P.sendable_range(t.offers, t.addresses))
    register("amount_limit_check", O.AMOUNT_LIMIT_CHECK, "offers")(lambda t: P.amount_limit_check(t.offers))
    register("metrics_profit_fiat", O.METRICS_PROFIT_FIAT, "offers", "rate_payloads")(
        lambda t: R.profit_fiat(R.metrics_by_period(t.offers, "monthly", ORDERS_AS_OF).select("date", "profit"),
                                P.latest_rate(rounds_of(t))))


# ---------------------------------------------------------------------------
# §2.7 invoice and payment events
# ---------------------------------------------------------------------------
def _payments() -> None:
    from pyspark.sql import functions as F

    from offerlake.operators import payments as PM

    register("normalize_invoice_updates", O.NORMALIZE_INVOICE_UPDATES, "invoice_updates")(
        lambda t: PM.normalize_invoice_updates(t.invoice_updates))
    register("normalize_invoice_details", O.NORMALIZE_INVOICE_DETAILS, "invoices_raw")(
        lambda t: PM.normalize_invoice_details(t.invoices_raw))
    register("invoice_status_latest", O.INVOICE_STATUS_LATEST, "invoice_updates")(
        lambda t: PM.invoice_status_latest(PM.normalize_invoice_updates(t.invoice_updates)))
    register("filter_invoice_updates", O.FILTER_INVOICE_UPDATES, "invoice_updates", "offers")(
        lambda t: PM.filter_invoice_updates(
            PM.normalize_invoice_updates(t.invoice_updates),
            t.offers.where(F.col("status") == "funded"), "hold_invoice_payment_hash"))
    register("payment_outcome", O.PAYMENT_OUTCOME, "payment_updates")(
        lambda t: PM.payment_outcome(t.payment_updates))
    register("payment_result", O.PAYMENT_RESULT, "payment_updates")(
        lambda t: PM.payment_result(PM.payment_outcome(t.payment_updates)))
    register("payment_failures", O.PAYMENT_FAILURES, "payment_updates")(
        lambda t: PM.payment_failures(PM.payment_outcome(t.payment_updates)))


# ---------------------------------------------------------------------------
# §2.5 lifecycle
# ---------------------------------------------------------------------------
def invoice_update_rows(t: Tables):
    from pyspark.sql import functions as F
    pu = t.payment_updates
    k = F.substring("payment_hash", 5, 20)
    return pu.where((F.col("seq") == 1) | (F.col("raw_status") == "SUCCEEDED")).select(
        F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(k, 12, "0")).alias("offer_id"),
        F.when(F.col("seq") == 1, F.concat(F.lit("inv-"), k, F.lit("-r"))).alias("taker_invoice"),
        F.when(F.col("raw_status") == "SUCCEEDED", F.col("fee_sat")).cast("bigint").alias("taker_invoice_fees"),
        "ts")


def invoice_change_rows(t: Tables):
    from pyspark.sql import functions as F
    req = t.requests.select("sender", "ts", F.from_json(
        "body", "struct<method:string,params:map<string,string>>").alias("r"))
    return (req.where(F.col("r.method") == "update_taker_invoice")
            .select(F.col("r.params")["offer_id"].alias("offer_id"), "sender",
                    F.col("r.params")["bolt11"].alias("bolt11"), "ts")
            .where(F.col("offer_id").isNotNull() & F.col("bolt11").isNotNull()))


def _lifecycle() -> None:
    from pyspark.sql import functions as F

    from offerlake.operators import lifecycle as LC

    for rule, key in [("funded_expiry", "sweep_funded"), ("reservation", "sweep_reserved"),
                      ("blik_confirmation", "sweep_blik"), ("taker_charged", "sweep_taker_charged"),
                      ("conflict", "sweep_conflict")]:
        register(key, O.sweep_sql(rule), "offers")(
            lambda t, _r=rule: LC.sweep(t.offers, _r, ORDERS_AS_OF))

    def sweep_due_q(t: Tables):
        from offerlake.operators import due as D
        from offerlake.sources import io as IO
        path = IO.scratch_path(t.spark, "due-index")
        older = F.substring("id", 25, 12).cast("bigint") % 4 == 0  # what a quarter of the offers looked like before
        before = t.offers.where(older).withColumn("status", F.lit("funded")).withColumn("created_at", F.expr("created_at - INTERVAL 40 DAYS"))
        D.build(before.unionByName(t.offers.where(~older)), path)
        for _ in range(2):  # entering a change again changes nothing
            D.update(before, t.offers.where(older), path, 1)
        return D.due(t.spark, path, ORDERS_AS_OF)

    register("sweep_due", O.SWEEP_DUE, "offers")(sweep_due_q)
    register("startup_sweep", O.STARTUP_SWEEP, "offers")(lambda t: LC.startup_sweep(t.offers, ORDERS_AS_OF))
    register("deadlines", O.DEADLINES, "offers")(lambda t: LC.deadlines(t.offers, ORDERS_AS_OF))
    register("revert_to_funded", O.REVERT_TO_FUNDED, "offers")(
        lambda t: LC.revert_to_funded(t.offers, ORDERS_AS_OF))
    register("status_history", O.STATUS_HISTORY, "status_events")(
        lambda t: LC.status_history(t.status_events))
    register("apply_status_updates", O.APPLY_STATUS_UPDATES, "offers", "status_events")(
        lambda t: LC.apply_status_updates(t.offers, t.status_events))
    register("apply_invoice_updates", O.APPLY_INVOICE_UPDATES, "offers", "payment_updates")(
        lambda t: LC.apply_invoice_updates(t.offers, invoice_update_rows(t)))
    register("apply_cancellations", O.APPLY_CANCELLATIONS, "offers", "action_log")(
        lambda t: LC.apply_cancellations(t.offers, t.action_log.where(F.col("action") == "cancel_offer"),
                                         ORDERS_AS_OF))
    register("apply_invoice_change", O.APPLY_INVOICE_CHANGE, "offers", "requests")(
        lambda t: LC.apply_invoice_change(t.offers, invoice_change_rows(t)))
    register("validate_actions", O.VALIDATE_ACTIONS, "action_log", "offers")(
        lambda t: LC.validate_actions(t.action_log, t.offers))
    register("replay_actions", O.REPLAY_ACTIONS, "action_log", "offers")(
        lambda t: LC.replay_actions(t.action_log, t.offers))
    register("replay_steps", O.REPLAY_STEPS, "action_log", "offers")(
        lambda t: LC.replay_steps(t.action_log, t.offers))


# ---------------------------------------------------------------------------
# §2.4 joins on changes
# ---------------------------------------------------------------------------
def _joins() -> None:
    from offerlake.operators import changes as C
    from offerlake.operators import pricing as P

    register("changes_enriched", O.CHANGES_ENRICHED, "offer_changes", "offers")(
        lambda t: C.changes_enriched(t.offer_changes, t.offers))
    register("audit_changes_enriched", O.AUDIT_CHANGES_ENRICHED, "audit_changes", "audit")(
        lambda t: C.audit_changes_enriched(t.audit_changes, t.audit))
    register("fund_offers", O.FUND_OFFERS, "rate_payloads", "quotes", "quote_updates", "offers")(
        lambda t: C.fund_offers(P.quote_offer(priced_quotes(t)), t.quote_updates, t.offers))
    register("offers_with_audit", O.OFFERS_WITH_AUDIT, "offers", "audit")(
        lambda t: C.offers_with_audit(t.offers, t.audit))


# ---------------------------------------------------------------------------
# §2.1 sources and sinks
# ---------------------------------------------------------------------------
def funded_offer_rows(t: Tables):
    """New offers produced by funding, in the stored-table shape."""
    from pyspark.sql import functions as F

    from offerlake import schema as S
    from offerlake.operators import changes as C
    from offerlake.operators import pricing as P
    f = C.fund_offers(P.quote_offer(priced_quotes(t)), t.quote_updates, t.offers).where(F.col("outcome") == "funded")
    cols = {"hold_invoice_payment_hash": F.col("payment_hash"), "fiat_currency": F.lit("PLN")}
    return f.select(*[(cols[c] if c in cols else
                       (F.col(c) if c in f.columns else F.lit(None))).cast(S.OFFER_SCHEMA[c].dataType).alias(c)
                      for c in S.OFFER_COLUMNS])


def _sources() -> None:
    from pyspark.sql import functions as F

    from offerlake import schema as S
    from offerlake.operators import feed as FD
    from offerlake.sources import commits as CM
    from offerlake.sources import io as IO
    from offerlake.sources import snapshots as SN
    from offerlake.sources.fixtures import EVENTS_AS_OF

    def read_offers_q(t: Tables):
        spark = t.spark
        path = IO.scratch_path(spark, "offers-table")
        k = F.substring("id", 25, 12).cast("bigint")
        new_shape = t.offers.where(k % 2 == 0).withColumn("blik_code", F.lit("123456")) \
            .withColumn("hold_invoice_preimage", F.lit("secret"))
        old_shape = t.offers.where(k % 2 == 1).drop(*S.OFFER_LATE_COLUMNS).withColumn("hold_invoice_preimage",
                                                                                     F.lit("secret"))
        new_shape.write.parquet(path)
        old_shape.write.mode("append").parquet(path)
        return IO.read_offers(spark, path)

    register("read_offers", O.READ_OFFERS, "offers")(read_offers_q)

    def read_audit_q(t: Tables):
        path = IO.scratch_path(t.spark, "audit-table")
        IO.append_audit(t.audit, path)
        return IO.read_audit(t.spark, path)

    register("read_audit", O.READ_AUDIT, "audit")(read_audit_q)

    def append_offers_q(t: Tables):
        path = IO.scratch_path(t.spark, "offers-append")
        IO.write_offers(t.offers, path)
        k = F.substring("id", 25, 12).cast("bigint")
        new = funded_offer_rows(t)
        replays = t.offers.where(k % 150 == 0)  # already stored: must not be appended again
        IO.append_offers(new.unionByName(new).unionByName(replays), path, EVENTS_AS_OF)
        return IO.read_offers(t.spark, path)

    def append_offers_indexed_q(t: Tables):
        from offerlake.sources import keys as K
        path = IO.scratch_path(t.spark, "offers-indexed")
        K.append_offers_once(t.offers, path, "stored")
        k = F.substring("id", 25, 12).cast("bigint")
        new = funded_offer_rows(t)
        for _ in range(2):  # the second time is a retry
            K.append_offers_once(new.unionByName(new).unionByName(t.offers.where(k % 150 == 0)), path, "funded", EVENTS_AS_OF)
        return K.read_offers_committed(t.spark, path)

    register("append_offers_indexed", O.APPEND_OFFERS, "offers", "rate_payloads", "quotes", "quote_updates")(append_offers_indexed_q)
    register("append_offers", O.APPEND_OFFERS, "offers", "rate_payloads", "quotes", "quote_updates")(append_offers_q)

    def append_audit_q(t: Tables):
        path = IO.scratch_path(t.spark, "audit-append")
        for batch in (0, 1, 0):  # the first batch is sent again: it counts once
            CM.append_audit_once(t.audit.where(F.col("id") % 2 == batch), path, batch)
        return CM.read_audit_committed(t.spark, path)

    register("append_audit", O.READ_AUDIT, "audit")(append_audit_q)

    def read_rates_q(t: Tables):
        path = IO.scratch_path(t.spark, "rates-json")
        IO.write_rates(t.rate_payloads, path)
        return IO.read_rates(t.spark, path)

    register("read_rates", O.READ_RATES, "rate_payloads")(read_rates_q)

    def publish_orders_q(t: Tables):
        path = IO.scratch_path(t.spark, "orders-feed")
        for _ in range(2):  # a retry of the same batch publishes nothing
            CM.publish_orders_once(FD.order_events(t.offers, as_json=True), path, "startup")
        return CM.read_published(t.spark, path)

    register("publish_orders", O.ORDER_EVENTS, "offers")(publish_orders_q)

    def capture_changes_q(t: Tables):
        path = IO.scratch_path(t.spark, "offer-versions")
        k, touched = F.substring("id", 25, 12).cast("bigint") % 10, F.coalesce(F.month("created_at") % 3 == 1, F.lit(False))
        SN.write_version(t.offers.where(~touched | (k != 0)).withColumn(
            "status", F.when(touched & (k == 2), F.lit("funded")).otherwise(F.col("status"))), path, 1)
        SN.write_version(t.offers.where(~touched | (k != 1)), path, 2)
        return SN.capture_changes(t.spark, path, 1, 2).withColumnRenamed("id", "offer_id")

    register("capture_changes", O.CAPTURE_CHANGES, "offers")(capture_changes_q)

    def capture_audit_changes_q(t: Tables):
        path = IO.scratch_path(t.spark, "audit-versions")
        k = F.col("id") % 10
        SN.write_version(t.audit.where(k != 0).withColumn("message", F.when(k == 2, F.lit("draft")).otherwise(F.col("message"))), path, 1)
        SN.write_version(t.audit.where(k != 1), path, 2)
        return SN.capture_changes(t.spark, path, 1, 2, "id", "bigint", {"offer_id": "string"}).withColumnRenamed("id", "audit_id")

    register("capture_audit_changes", O.CAPTURE_AUDIT_CHANGES, "audit")(capture_audit_changes_q)

    def report_json_q(t: Tables):
        from offerlake.operators import reports as R
        return IO.report_json(R.metrics_by_period(t.offers, "weekly", ORDERS_AS_OF), R.metrics_totals(t.offers),
                              R.taker_domain_ranking(t.offers), R.weekday_profile(t.offers))

    register("report_json", O.REPORT_JSON, "offers")(report_json_q)
    register("report_sections", O.REPORT_SECTIONS, "offers")(lambda t: IO.report_sections(t.offers, "weekly"))


# ---------------------------------------------------------------------------
# §2.10 streaming (each compared with its batch twin)
# ---------------------------------------------------------------------------
def _streams() -> None:
    from offerlake.operators import pricing as P
    from offerlake.streaming import jobs as J

    register("read_changes", O.READ_CHANGES, "offer_changes")(
        lambda t: t.spark.read.parquet(J.run_to_files(J.read_changes(t.spark, t.offer_changes), "changes")))
    register("stream_enrich_audit", O.ENRICH_AUDIT, "audit")(
        lambda t: J.stream_enrich_audit(t.spark, t.log_records))
    register("stream_validate_requests", O.VALIDATE_REQUESTS, "requests")(
        lambda t: J.stream_validate_requests(t.spark, t.requests))
    register("stream_offer_changes", O.CHANGES_ENRICHED, "offer_changes", "offers")(
        lambda t: J.stream_offer_changes(t.spark, t.offer_changes, t.offers))
    register("stream_audit_changes", O.AUDIT_CHANGES_ENRICHED, "audit_changes", "audit")(
        lambda t: J.stream_audit_changes(t.spark, t.audit_changes, t.audit))
    register("stream_recent_offers", O.STREAM_RECENT_OFFERS, "offer_changes", "offers")(
        lambda t: J.stream_recent_offers(t.spark, t.offer_changes, t.offers))
    register("stream_rates", O.AVERAGE_RATE, "rate_payloads")(lambda t: J.stream_rates(t.spark, t.rate_payloads))
    register("stream_fund_offers", O.FUND_OFFERS, "rate_payloads", "quotes", "quote_updates", "offers")(
        lambda t: J.stream_fund_offers(t.spark, P.quote_offer(priced_quotes(t)), t.quote_updates, t.offers))
    register("stream_offer_audit", O.STREAM_OFFER_AUDIT, "audit_changes", "audit")(
        lambda t: J.stream_offer_audit(t.spark, t.audit_changes, t.audit))
    register("stream_deadlines", O.STREAM_DEADLINES, "status_events")(
        lambda t: J.stream_deadlines(t.spark, t.status_events))
    register("stream_apply_status_updates", O.APPLY_STATUS_UPDATES, "offers", "status_events")(
        lambda t: J.stream_apply_status_updates(t.spark, t.status_events, t.offers))
    register("stream_publish_orders", O.STREAM_PUBLISH_ORDERS, "offer_changes", "offers")(
        lambda t: J.stream_publish_orders(t.spark, t.offer_changes, t.offers))
