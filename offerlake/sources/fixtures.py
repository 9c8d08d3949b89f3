"""Canonical domain tables derived from the TPC-H-style test parquet.

Every fixture is a short list of *stages*; a stage is a list of
``(column, SQL expression)`` pairs (plus an optional filter) evaluated over the
previous stage. Spark runs the stages with ``selectExpr`` / ``where`` (all
JVM-side, so scans keep column pruning and filter pushdown); the same text,
with a handful of dialect macros expanded, becomes a DuckDB CTE for the
oracle queries. No hashing, no randomness, no ``now()``: a fixture is a pure
function of its input rows.

Macros inside expressions:
``{add_s:TS:N}`` -> TS + N seconds, ``{div:A:B}`` -> integer division,
``{unix_s:TS}`` -> epoch seconds, ``{gen:N}`` -> one output row per 1..N.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from offerlake import schema as S

# Fixed clocks of the fixtures: one for tables built on `orders`, one for
# tables built on `events`.
ORDERS_AS_OF = datetime(2001, 8, 2, 0, 0, 0)
EVENTS_AS_OF = datetime(2024, 1, 31, 0, 0, 0)
ORDERS_AS_OF_SQL = "TIMESTAMP '2001-08-02 00:00:00'"
EVENTS_AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"

_MACRO = re.compile(r"\{(add_s|div|unix_s|gen|uuid):([^{}]*)\}")


def _expand(expr: str, dialect: str) -> str:
    def one(m: re.Match) -> str:
        name, args = m.group(1), m.group(2).split("::")
        if name == "add_s":
            ts, n = args
            return (f"({ts} + make_dt_interval(0, 0, 0, {n}))" if dialect == "spark"
                    else f"({ts} + to_seconds({n}))")
        if name == "div":
            a, b = args
            return f"(({a}) div ({b}))" if dialect == "spark" else f"(({a}) // ({b}))"
        if name == "unix_s":
            (ts,) = args
            return (f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})" if dialect == "spark"
                    else f"(epoch_ms({ts}) // 1000)")
        if name == "gen":
            (n,) = args
            return f"explode(sequence(1, {n}))" if dialect == "spark" else f"unnest(range(1, {n} + 1))"
        if name == "uuid":
            (n,) = args
            return f"('00000000-0000-4000-8000-' || lpad(CAST({n} AS STRING), 12, '0'))"
        raise ValueError(name)

    prev = None
    while prev != expr:  # macros may nest
        prev, expr = expr, _MACRO.sub(one, expr)
    return expr


@dataclass
class Stage:
    cols: list[tuple[str, str]]
    where: str | None = None
    keep: bool = False  # carry all previous columns (`*`) as well
    distinct: bool = False


@dataclass
class Fixture:
    name: str
    source: str  # base table name or another fixture
    stages: list[Stage] = field(default_factory=list)
    final: list[str] | None = None  # output column order

    def spark(self, base: DataFrame) -> DataFrame:
        df = base
        for st in self.stages:
            exprs = [f"{_expand(e, 'spark')} AS {n}" for n, e in st.cols]
            df = df.selectExpr(*(["*"] if st.keep else []), *exprs)
            if st.where:
                df = df.where(_expand(st.where, "spark"))
            if st.distinct:
                df = df.distinct()
        return df.select(*self.final) if self.final else df

    def duck(self) -> str:
        sql = f"SELECT * FROM {self.source}"
        for st in self.stages:
            exprs = ", ".join(f"{_expand(e, 'duck')} AS {n}" for n, e in st.cols)
            sel = ("*, " if st.keep else "") + exprs
            sql = f"SELECT {sel} FROM ({sql}) t"
            if st.where:
                sql = f"SELECT * FROM ({sql}) w WHERE {_expand(st.where, 'duck')}"
            if st.distinct:
                sql = f"SELECT DISTINCT * FROM ({sql}) d"
        if self.final:
            sql = f"SELECT {', '.join(self.final)} FROM ({sql}) f"
        return sql


def _case(expr: str, mapping: list[tuple[str, str]], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in mapping)
    return f"CASE {expr} {whens} ELSE {default} END"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# --------------------------------------------------------------------------
# offers: one row per order (k = o_orderkey, m = k % 30)
# --------------------------------------------------------------------------
_STATUS_BY_M = ([(str(i), "'takerPaid'") for i in range(0, 12)] +
                [("12", "'expired'"), ("13", "'expired'"), ("14", "'cancelled'"),
                 ("15", "'funded'"), ("16", "'reserved'"), ("17", "'blikReceived'"),
                 ("18", "'blikSentToMaker'"), ("19", "'expiredBlik'"),
                 ("20", "'expiredSentBlik'"), ("21", "'takerCharged'"),
                 ("22", "'invalidBlik'"), ("23", "'conflict'"), ("24", "'dispute'"),
                 ("25", "'makerConfirmed'"), ("26", "'settled'"), ("27", "'payingTaker'"),
                 ("28", "'takerPaymentFailed'"), ("29", "'takerPaid'")])

OFFERS = Fixture("offers", "orders", [
    Stage([("k", "o_orderkey"), ("m", "o_orderkey % 30"), ("cust", "o_custkey"),
           ("price", "o_totalprice"), ("odate", "o_orderdate")]),
    Stage([("status", _case("m", _STATUS_BY_M)),
           ("amount_sats", "CAST(floor(price) AS BIGINT)"),
           ("created_at", "{add_s:odate::(k * 7919) % 86400}")], keep=True),
    Stage([
        ("id", "{uuid:k}"),
        ("maker_fees", "{div:amount_sats * 5 + 999::1000}"),
        ("taker_fees", "CASE WHEN k % 37 = 0 THEN NULL ELSE {div:amount_sats * 5 + 999::1000} END"),
        ("maker_pubkey", "'maker-' || CAST(cust AS STRING)"),
        ("taker_pubkey", "CASE WHEN m BETWEEN 12 AND 15 THEN NULL "
                         "ELSE 'taker-' || CAST((k * 31) % 997 AS STRING) END"),
        ("taker_lightning_address",
         "CASE WHEN m BETWEEN 12 AND 16 THEN NULL WHEN k % 3 <> 0 THEN 'user' || CAST(cust AS STRING) || '@' || "
         + _case("k % 5", [("0", "'wallet-a.example'"), ("1", "'wallet-b.example'"),
                           ("2", "'wallet-c.example'")], "'wallet-d.example'")
         + " WHEN k % 33 = 0 THEN 'no-domain' ELSE NULL END"),
        ("taker_invoice", "CASE WHEN m BETWEEN 12 AND 16 THEN NULL ELSE 'inv-' || CAST(k AS STRING) END"),
        ("taker_invoice_fees", "CASE WHEN status = 'takerPaid' AND k % 41 <> 0 THEN k % 11 END"),
        ("hold_invoice_payment_hash", "'hash-' || CAST(k AS STRING)"),
        ("updated_at", "CASE WHEN k % 23 = 0 THEN NULL ELSE {add_s:created_at::60 + k % 600} END"),
        ("reserved_at", "CASE WHEN m BETWEEN 12 AND 15 THEN NULL ELSE {add_s:created_at::20 + k % 97} END"),
        ("blik_received_at", "CASE WHEN m BETWEEN 12 AND 16 THEN NULL ELSE {add_s:created_at::40 + k % 101} END"),
        ("maker_confirmed_at", "CASE WHEN status IN ('takerPaid', 'makerConfirmed', 'settled', 'payingTaker', "
                               "'takerPaymentFailed') THEN {add_s:created_at::150 + k % 113} END"),
        ("settled_at", "CASE WHEN status IN ('takerPaid', 'settled', 'payingTaker', 'takerPaymentFailed') "
                       "THEN {add_s:created_at::300 + k % 127} END"),
        ("taker_paid_at", "CASE WHEN status = 'takerPaid' THEN {add_s:created_at::450 + k % 131} END"),
        ("fiat_amount", "CAST(price AS DECIMAL(18,2))"),
        ("fiat_currency", "CASE WHEN k % 19 = 0 THEN 'EUR' ELSE 'PLN' END"),
    ], keep=True),
], final=S.OFFER_COLUMNS)

# --------------------------------------------------------------------------
# log_records: raw logger calls (from events, e = event_id, u = user_id)
# --------------------------------------------------------------------------
_U = "{uuid:(u * 101) % 20000}"
_LOG_MESSAGES = [
    ("0", f"'Offer ' || {_U} || ' status updated to funded.'"),
    ("1", f"'Maker maker-' || CAST(u AS STRING) || ' confirmed payment for offer ' || {_U}"),
    ("2", "'Taker taker-' || CAST(u AS STRING) || ' reserved an offer'"),
    ("3", f"'Reservation timer expired for offer ' || {_U}"),
    ("4", f"'Warning: offer ' || {_U} || ' is reserved but has no reserved_at timestamp.'"),
    ("5", "'Failed to pay taker. Reason: ' || etype"),
    ("6", "'Expired funded offer check complete. Marked 0 offers as expired.'"),
    ("7", f"'Request ' || upper({_U}) || ' processed'"),
    ("8", "'Rate refreshed from ' || CAST(e % 3 AS STRING) || ' sources'"),
    ("9", f"'CRITICAL exception while talking to backend about ' || {_U}"),
]

LOG_RECORDS = Fixture("log_records", "events", [
    Stage([("e", "event_id"), ("u", "user_id"), ("etype", "event_type"), ("ts0", "ts"), ("props0", "props")]),
    Stage([
        ("record_id", "e"),
        ("ts", "ts0"),
        ("level", "CASE WHEN e % 7 = 0 THEN 'FINE' WHEN e % 13 = 0 THEN 'SEVERE' "
                  "WHEN e % 17 = 0 THEN 'WARNING' ELSE NULL END"),
        ("logger_name", "CASE WHEN e % 2 = 0 THEN 'service' ELSE '' END"),
        ("message", _case("e % 10", _LOG_MESSAGES)),
        ("action", "CASE e % 4 WHEN 1 THEN 'system.event' WHEN 2 THEN 'offer.reserve' "
                   "WHEN 3 THEN NULL ELSE NULL END"),
        ("offer_id", _case("e % 6", [("0", _U), ("1", f"' ' || {_U} || ' '"), ("2", "'check'"),
                                     ("3", "''"), ("4", "NULL"), ("5", f"'x ' || {_U}")])),
        ("error", "CASE WHEN e % 10 = 5 THEN 'timeout' END"),
        ("metadata", "props0"),
    ]),
])

# --------------------------------------------------------------------------
# change feeds (from events)
# --------------------------------------------------------------------------
_OPERATION = "CASE WHEN event_type = 'error' THEN 'DELETE' WHEN event_type = 'signup' THEN 'INSERT' ELSE 'UPDATE' END"

OFFER_CHANGES = Fixture("offer_changes", "events", [
    Stage([("seq", "event_id"), ("operation", _OPERATION),
           ("offer_id", "CASE WHEN event_id % 50 = 0 THEN NULL ELSE {uuid:(user_id * 101) % 20000} END"),
           ("change_ts", "ts")]),
])

AUDIT_CHANGES = Fixture("audit_changes", "events", [
    Stage([("seq", "event_id"), ("operation", _OPERATION),
           ("offer_id", "CASE WHEN event_id % 50 = 0 THEN NULL ELSE {uuid:(user_id * 101) % 20000} END"),
           ("audit_id", "CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 11 = 0 "
                        "THEN event_id + 1000000000 ELSE event_id END"),
           ("change_ts", "ts")]),
])

# --------------------------------------------------------------------------
# requests: encrypted-request payloads after decryption (from events)
# --------------------------------------------------------------------------
_METHOD_NAMES = list(S.REQUEST_METHODS) + ["list_offers", None]


def _param_json(name: str) -> str:
    if name == "fiat_amount":
        return "'\"fiat_amount\":' || CAST(CAST(value AS DECIMAL(12,2)) AS STRING)"
    if name == "offer_id":
        return "'\"offer_id\":\"' || {uuid:(user_id * 101) % 20000} || '\"'"
    if name == "blik_code":
        return "'\"blik_code\":\"' || lpad(CAST(event_id % 1000000 AS STRING), 6, '0') || '\"'"
    if name == "bolt11":
        return "'\"bolt11\":\"lnbc' || CAST(event_id AS STRING) || '\"'"
    if name == "taker_lightning_address":
        return "'\"taker_lightning_address\":\"user' || CAST(user_id AS STRING) || '@wallet-a.example\"'"
    if name == "taker_invoice":
        return "'\"taker_invoice\":\"lnbc' || CAST(event_id AS STRING) || '\"'"
    raise ValueError(name)


def _params_for(method: str | None, drop_first: bool) -> str:
    req = S.REQUEST_METHODS.get(method, []) if method else []
    names: list[str] = []
    for p in req:
        if isinstance(p, list):
            names.append(p[0])  # the address alternative
        else:
            names.append(p)
    if method == "get_info":
        names = ["extra"] if drop_first else []
    if drop_first and names:
        names = names[1:]
    parts = [_param_json(n) for n in names if n != "extra"]
    if not parts:
        return "''"
    return " || ',' || ".join(parts)


REQUESTS = Fixture("requests", "events", [
    Stage([
        ("e", "event_id"), ("ts", "ts"),
        ("sender", "CASE WHEN event_id % 3 = 0 THEN 'taker-' || CAST(((user_id * 101) % 20000 * 31) % 997 AS STRING) "
                   "ELSE 'maker-' || CAST(user_id AS STRING) END"),
        ("mname", _case("event_id % 18", [(str(i), _q(m) if m else "NULL") for i, m in enumerate(_METHOD_NAMES)])),
        ("params", "CASE WHEN event_id % 7 = 0 THEN "
         + _case("event_id % 18", [(str(i), _params_for(m, True)) for i, m in enumerate(_METHOD_NAMES)], "''")
         + " ELSE "
         + _case("event_id % 18", [(str(i), _params_for(m, False)) for i, m in enumerate(_METHOD_NAMES)], "''")
         + " END"),
    ]),
    Stage([
        ("request_id", "e"), ("sender", "sender"),
        ("body", "CASE WHEN e % 97 = 0 THEN '{\"id\":\"req-' || CAST(e AS STRING) || '\",\"method\":' "
                 "ELSE '{' || CASE WHEN e % 23 = 0 THEN '' ELSE '\"id\":\"req-' || CAST(e AS STRING) || '\",' END"
                 " || CASE WHEN mname IS NULL THEN '' ELSE '\"method\":\"' || mname || '\",' END"
                 " || '\"params\":{' || params || '}}' END"),
        ("ts", "ts"),
    ]),
])

# Requests with values of other types, by request_id % 9: 0 offer_id a number, 1 offer_id true, 2 fiat_amount text, 3 maker_id a list,
# 4 blik_code an object, 5 id a number, 6 params a list, 7 method a number, 8 as they are.
def _with_param(old: str, new: str) -> str:
    """The body with parameter ``old`` under another name and ``new`` in front of the others."""
    return (f"replace(replace(body, '\"{old}\"', '\"old_{old}\"'), '\"params\":{{', '\"params\":{{{new}' || "
            f"CASE WHEN body LIKE '%\"params\":{{}}%' THEN '' ELSE ',' END)")


TYPED_REQUESTS = Fixture("typed_requests", "requests", [
    Stage([("request_id", "request_id"), ("sender", "sender"), ("body", _case("request_id % 9", [
        ("0", _with_param("offer_id", '"offer_id":17')), ("1", _with_param("offer_id", '"offer_id":true')),
        ("2", _with_param("fiat_amount", '"fiat_amount":"abc"')), ("3", _with_param("maker_id", '"maker_id":[1.5]')),
        ("4", _with_param("blik_code", '"blik_code":{"a":null}')), ("5", "replace(body, '{\"id\":\"', '{\"id\":5,\"text_id\":\"')"),
        ("6", "replace(body, '\"params\":', '\"params\":[],\"p\":')"), ("7", "replace(body, '\"method\":\"', '\"method\":5,\"name\":\"')"),
    ], "body")), ("ts", "ts")]),
])

# --------------------------------------------------------------------------
# pricing inputs (from events)
# --------------------------------------------------------------------------
QUOTES = Fixture("quotes", "events", [
    Stage([("quote_id", "event_id"), ("fiat_amount", "value"), ("ts", "ts"),
           ("payment_hash", "CASE WHEN event_id % 25 = 1 THEN 'hash-' ELSE 'hash-q' END || CAST(event_id AS STRING)"),
           ("maker_id", "'maker-' || CAST(user_id AS STRING)")],
          where="quote_id % 2 = 1"),
])

# Hold-invoice updates of the quotes: OPEN, then ACCEPTED; by quote_id % 10: 3 and 4 CANCELED, 5 SETTLED,
# 7 nothing; a third ACCEPTED for 1, 4 and 5, and for 6 the only one, two days late.
QUOTE_UPDATES = Fixture("quote_updates", "quotes", [
    Stage([("q", "quote_id"), ("h", "payment_hash"), ("t", "ts"), ("i", "{gen:3}")]),
    Stage([("payment_hash", "h"), ("seq", "CAST(i AS INT)"),
           ("status", "CASE WHEN i = 1 THEN 'OPEN' WHEN i = 2 AND q % 10 IN (3, 4) THEN 'CANCELED' "
                      "WHEN i = 2 AND q % 10 = 5 THEN 'SETTLED' WHEN i = 2 AND q % 10 NOT IN (6, 7) THEN 'ACCEPTED' "
                      "WHEN i = 3 AND q % 10 IN (1, 4, 5, 6) THEN 'ACCEPTED' END"),
           ("ts", "{add_s:t::CASE WHEN i = 1 THEN 1 WHEN i = 2 THEN 30 WHEN q % 10 = 6 THEN 172800 ELSE 60 END}")], where="status IS NOT NULL"),
])

_RATE_BODY = _case("s", [
    ("0", "'{\"bitcoin\":{\"pln\":' || r || '}}'"),
    ("1", "'{\"BTC\":' || r || ',\"USD\":' || CAST(CAST(value AS DECIMAL(12,2)) AS STRING) || ',\"base\":\"PLN\"}'"),
    ("2", "'{\"USD\":{\"last\":1.0},\"PLN\":{\"15m\":' || r || ',\"last\":' || r || ',\"symbol\":\"PLN\"}}'"),
])

RATE_PAYLOADS = Fixture("rate_payloads", "events", [
    Stage([("e", "event_id"), ("fetched_at", "ts"), ("value", "value"), ("s0", "{gen:3}")],
          where="e % 2 = 0"),
    Stage([("e", "e"), ("fetched_at", "fetched_at"), ("value", "value"), ("s", "s0 - 1"),
           ("key", "e + 2 * (s0 - 1)")]),
    Stage([("r", "CASE WHEN key % 38 = 0 THEN '0' "
                 "WHEN key % 26 = 0 THEN '\"' || CAST(CAST(250000 + value AS DECIMAL(12,2)) AS STRING) || '\"' "
                 "ELSE CAST(CAST(250000 + value + " + _case("s", [("1", "1000"), ("2", "-1000")], "0")
                 + " AS DECIMAL(12,2)) AS STRING) END")], keep=True),
    Stage([("round_id", "e"),
           ("source", _case("s", [(str(i), _q(n)) for i, (n, _) in enumerate(S.RATE_SOURCES)])),
           ("fetched_at", "fetched_at"),
           ("http_status", "CASE WHEN key % 14 = 0 THEN 500 ELSE 200 END"),
           ("body", "CASE WHEN key % 22 = 0 THEN '{}' WHEN key % 14 = 0 THEN 'Internal Server Error' ELSE "
                    + _RATE_BODY + " END")]),
])

# --------------------------------------------------------------------------
# payment-backend events (from offers)
# --------------------------------------------------------------------------
INVOICE_UPDATES = Fixture("invoice_updates", "offers", [
    Stage([("k", "CAST(substr(id, 25) AS BIGINT)"), ("hash", "hold_invoice_payment_hash"),
           ("status", "status"), ("amount_sats", "amount_sats"), ("created_at", "created_at"),
           ("i", "{gen:3}")]),
    Stage([
        ("backend", "CASE WHEN k % 2 = 0 THEN 'lnd' ELSE 'nwc' END"),
        ("payment_hash", "hash"),
        ("seq", "CAST(i AS INT)"),
        ("raw_state", "CASE WHEN k % 2 = 0 THEN "
         + _case("i", [("1", "CASE WHEN k % 17 = 0 THEN 'DRAFT' ELSE 'OPEN' END"),
                       ("2", "CASE WHEN k % 7 = 0 THEN 'CANCELED' ELSE 'ACCEPTED' END"),
                       ("3", "'SETTLED'")])
         + " ELSE "
         + _case("i", [("1", "'hold_invoice_created'"),
                       ("2", "CASE WHEN k % 7 = 0 THEN 'holdInvoiceCanceled' ELSE 'hold_invoice_accepted' END"),
                       ("3", "'holdInvoiceSettled'")])
         + " END"),
        ("amount_paid_sat", "CASE WHEN k % 2 = 0 THEN amount_sats END"),
        ("ts", "{add_s:created_at::5 * i}"),
        ("keep_row", "i < 3 OR (status = 'takerPaid' AND k % 7 <> 0)"),
    ], where="keep_row"),
], final=["backend", "payment_hash", "seq", "raw_state", "amount_paid_sat", "ts"])

_FAIL_REASONS = [("0", "'FAILURE_REASON_NO_ROUTE'"), ("1", "'FAILURE_REASON_TIMEOUT'"),
                 ("2", "'FAILURE_REASON_INSUFFICIENT_BALANCE'")]

PAYMENT_UPDATES = Fixture("payment_updates", "offers", [
    Stage([("k", "CAST(substr(id, 25) AS BIGINT)"), ("inv", "taker_invoice"), ("status", "status"),
           ("t0", "coalesce(settled_at, created_at)"), ("i", "{gen:3}")],
          where="status IN ('takerPaid', 'takerPaymentFailed')"),
    Stage([
        ("payment_hash", "'pay-' || CAST(k AS STRING)"),
        ("stream", "CASE WHEN i = 1 OR (i = 2 AND k % 13 <> 0) THEN 'send' ELSE 'track' END"),
        ("seq", "CAST(i AS INT)"),
        ("terminal", "(i = 2 AND k % 13 <> 0) OR (i = 3 AND k % 26 <> 0)"),
        ("k", "k"), ("status", "status"), ("t0", "t0"), ("i", "i"),
    ], where="i < 3 OR k % 13 = 0"),
    Stage([
        ("raw_status", "CASE WHEN NOT terminal THEN 'IN_FLIGHT' WHEN status = 'takerPaid' THEN 'SUCCEEDED' ELSE 'FAILED' END"),
        ("fee_sat", "CASE WHEN terminal AND status = 'takerPaid' THEN k % 11 ELSE 0 END"),
        ("preimage", "CASE WHEN terminal AND status = 'takerPaid' THEN 'pre-' || CAST(k AS STRING) ELSE '' END"),
        ("failure_reason", "CASE WHEN terminal AND status <> 'takerPaid' THEN " + _case("k % 3", _FAIL_REASONS)
         + " ELSE 'FAILURE_REASON_NONE' END"),
        ("ts", "{add_s:t0::i}"),
    ], keep=True),
], final=["payment_hash", "stream", "seq", "raw_status", "fee_sat", "preimage", "failure_reason", "ts"])

INVOICES_RAW = Fixture("invoices_raw", "offers", [
    Stage([
        ("backend", "CASE WHEN CAST(substr(id, 25) AS BIGINT) % 2 = 0 THEN 'lnd' ELSE 'nwc' END"),
        ("payment_hash", "hold_invoice_payment_hash"),
        ("value", "amount_sats + maker_fees"),
        ("creation_date", "{unix_s:created_at}"),
        ("settle_date", "CASE WHEN settled_at IS NULL THEN 0 ELSE {unix_s:settled_at} END"),
        ("expiry", "86400"),
        ("state", "CASE WHEN status IN ('expired', 'cancelled') THEN 'CANCELED' "
                  "WHEN settled_at IS NOT NULL THEN 'SETTLED' WHEN status = 'funded' THEN 'ACCEPTED' "
                  "WHEN status = 'dispute' THEN 'SETTLED' ELSE 'ACCEPTED' END"),
        ("memo", "'Payment ' || CAST(fiat_amount AS STRING) || ' ' || fiat_currency"),
    ]),
])

ADDRESSES = Fixture("addresses", "offers", [
    Stage([("a", "taker_lightning_address")], where="a LIKE '%@%'", distinct=True),
    Stage([("lightning_address", "a"), ("h", "length(a) % 7")]),
    Stage([
        ("tag", "CASE WHEN h = 0 THEN 'withdrawRequest' ELSE 'payRequest' END"),
        ("status", "CASE WHEN h = 1 THEN 'ERROR' ELSE 'OK' END"),
        ("callback", "CASE WHEN h = 2 THEN NULL ELSE 'https://' || split_part(lightning_address, '@', 2) "
                     "|| '/cb/' || split_part(lightning_address, '@', 1) END"),
        ("min_sendable", "CAST(1000 AS BIGINT)"),
        ("max_sendable", "CASE WHEN h = 3 THEN CAST(50000000 AS BIGINT) ELSE CAST(100000000000 AS BIGINT) END"),
    ], keep=True),
], final=["lightning_address", "tag", "status", "callback", "min_sendable", "max_sendable"])

# --------------------------------------------------------------------------
# action_log: one of 12 scripted scenarios per order (scenario = k % 12).
# Steps are (action, actor role, invoice amount offset or None).
# --------------------------------------------------------------------------
HAPPY = [("fund", "system"), ("reserve", "taker"), ("submit_blik", "taker"),
         ("get_blik", "maker"), ("confirm_payment", "maker"), ("pay_taker", "system")]
SCENARIOS = [
    HAPPY,
    [("fund", "system"), ("reserve", "taker"), ("submit_blik", "taker2"), ("submit_blik", "taker")],
    [("fund", "system"), ("submit_blik", "taker"), ("cancel_offer", "taker"), ("cancel_offer", "maker")],
    HAPPY[:4] + [("mark_blik_invalid", "maker"), ("reserve", "taker")],
    HAPPY[:4] + [("mark_blik_invalid", "maker"), ("reserve", "taker2")],
    HAPPY[:4] + [("mark_blik_invalid", "maker"), ("mark_blik_charged", "taker"), ("open_dispute", "maker")],
    HAPPY[:5] + [("pay_taker_failed", "system"), ("retry_taker_payment", "taker2"),
                 ("retry_taker_payment", "taker")],
    [("fund", "system"), ("cancel_offer", "maker"), ("reserve", "taker")],
    [("fund", "system"), ("reserve", "taker"), ("cancel_reservation", "taker"), ("reserve", "taker2")],
    HAPPY[:4] + [("expire_blik", "system"), ("mark_blik_charged", "taker"), ("confirm_payment", "maker")],
    HAPPY + [("retry_taker_payment", "taker")],
    [("reserve", "taker"), ("fund", "system"), ("get_blik", "maker"), ("expire_funded", "system")],
]
SCENARIO_STEPS = [(si, j + 1, a, role) for si, steps in enumerate(SCENARIOS) for j, (a, role) in enumerate(steps)]

# action_log = orders joined with the literal step table on k % 12 (each order
# gets exactly its scenario's steps); in Spark the step table is a fixed-size
# broadcast.
_ACTION_COLS = [
    ("offer_id", "{uuid:o_orderkey}"),
    ("seq", "CAST(step AS INT)"),
    ("action", "action"),
    ("actor", _case("role", [("'maker'", "'maker-' || CAST(o_custkey AS STRING)"),
                             ("'taker'", "'taker-' || CAST((o_orderkey * 31) % 997 AS STRING)"),
                             ("'taker2'", "'taker-x' || CAST(o_orderkey AS STRING)")], "'system'")),
    ("ts", "{add_s:{add_s:o_orderdate::(o_orderkey * 7919) % 86400}::10 * step}"),
    ("invoice_amount_sats", "CASE WHEN action = 'submit_blik' AND sc = 1 AND role = 'taker' THEN "
                            "CAST(floor(o_totalprice) AS BIGINT) - "
                            "{div:CAST(floor(o_totalprice) AS BIGINT) * 5 + 999::1000} + 50 END"),
]


def action_log_duck() -> str:
    values = ", ".join(f"({sc}, {st}, '{a}', '{r}')" for sc, st, a, r in SCENARIO_STEPS)
    cols = ", ".join(f"{_expand(e, 'duck')} AS {n}" for n, e in _ACTION_COLS)
    return (f"SELECT {cols} FROM orders o JOIN (VALUES {values}) AS s(sc, step, action, role) "
            f"ON s.sc = o.o_orderkey % 12")


def action_log_spark(orders: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F
    steps = orders.sparkSession.createDataFrame(SCENARIO_STEPS, "sc INT, step INT, action STRING, role STRING")
    j = orders.join(F.broadcast(steps), F.col("o_orderkey") % 12 == F.col("sc"))
    return j.selectExpr(*[f"{_expand(e, 'spark')} AS {n}" for n, e in _ACTION_COLS])


SIMPLE_FIXTURES = {f.name: f for f in [
    OFFERS, LOG_RECORDS, OFFER_CHANGES, AUDIT_CHANGES, REQUESTS, QUOTES, RATE_PAYLOADS,
    INVOICE_UPDATES, PAYMENT_UPDATES, INVOICES_RAW, ADDRESSES, QUOTE_UPDATES, TYPED_REQUESTS]}

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# status_events: the offer's own timestamps as an ordered event list.
_SE_STEPS = [(1, "funded", "created_at", "NULL", "NULL", "NULL"),
             (2, "reserved", "reserved_at", "taker_pubkey", "NULL", "NULL"),
             (3, "blikReceived", "blik_received_at", "NULL", "taker_lightning_address", "NULL"),
             (4, "makerConfirmed", "maker_confirmed_at", "NULL", "NULL", "NULL"),
             (5, "settled", "settled_at", "NULL", "NULL", "NULL"),
             (6, "takerPaid", "taker_paid_at", "NULL", "NULL", "taker_fees")]
_SE_STORED = ", ".join(f"'{s[1]}'" for s in _SE_STEPS)


def status_events_duck() -> str:
    parts = [f"SELECT id AS offer_id, CAST({seq} AS INTEGER) AS seq, '{st}' AS status, {ts} AS ts, "
             f"CAST({tp} AS VARCHAR) AS taker_pubkey, CAST({ad} AS VARCHAR) AS address, "
             f"CAST({tf} AS BIGINT) AS taker_fees FROM offers WHERE {ts} IS NOT NULL"
             for seq, st, ts, tp, ad, tf in _SE_STEPS]
    parts.append("SELECT id, CAST(9 AS INTEGER), status, coalesce(updated_at, created_at), NULL, NULL, NULL "
                 f"FROM offers WHERE status NOT IN ({_SE_STORED})")
    return " UNION ALL ".join(parts)


def status_events_spark(offers: DataFrame) -> DataFrame:
    structs = [f"named_struct('seq', {seq}, 'status', '{st}', 'ts', {ts}, "
               f"'taker_pubkey', CAST({tp} AS STRING), 'address', CAST({ad} AS STRING), "
               f"'taker_fees', CAST({tf} AS BIGINT))"
               for seq, st, ts, tp, ad, tf in _SE_STEPS]
    structs.append(f"named_struct('seq', CASE WHEN status IN ({_SE_STORED}) THEN NULL ELSE 9 END, "
                   "'status', status, 'ts', coalesce(updated_at, created_at), "
                   "'taker_pubkey', CAST(NULL AS STRING), 'address', CAST(NULL AS STRING), "
                   "'taker_fees', CAST(NULL AS BIGINT))")
    return (offers.selectExpr("id AS offer_id", f"inline(array({', '.join(structs)}))")
            .where("ts IS NOT NULL AND seq IS NOT NULL")
            .selectExpr("offer_id", "CAST(seq AS INT) AS seq", "status", "ts", "taker_pubkey",
                        "address", "taker_fees"))


class Tables:
    """Lazily built fixture DataFrames for one test-data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self._build(name)
        return self._cache[name]

    def _build(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.base(name)
        if name == "status_events":
            return status_events_spark(self["offers"])
        if name == "action_log":
            return action_log_spark(self["orders"])
        if name == "audit":
            from offerlake.operators.audit import enrich_audit
            return enrich_audit(self["log_records"])
        fx = SIMPLE_FIXTURES[name]
        return fx.spark(self[fx.source])


# DuckDB CTE text per fixture; `audit` is filled in by the audit operator module
# (its oracle is the enrichment SQL itself).
FIXTURE_DEPS = {
    "offers": [], "log_records": [], "offer_changes": [], "audit_changes": [],
    "requests": [], "quotes": [], "rate_payloads": [], "action_log": [],
    "invoice_updates": ["offers"], "payment_updates": ["offers"], "invoices_raw": ["offers"],
    "addresses": ["offers"], "status_events": ["offers"], "audit": ["log_records"],
    "quote_updates": ["quotes"], "typed_requests": ["requests"],
}


def fixture_sql(name: str) -> str:
    if name == "status_events":
        return status_events_duck()
    if name == "action_log":
        return action_log_duck()
    if name == "audit":
        from offerlake.plans.oracle import AUDIT_SQL
        return AUDIT_SQL
    return SIMPLE_FIXTURES[name].duck()


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the DuckDB CTEs of the named fixtures (and their deps)."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in FIXTURE_DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({fixture_sql(n)})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
