"""DuckDB SQL twins of the registered queries (the correctness oracle).

Written independently of the Spark plans, in the shape of the original SQL
where one exists. Exact ``ROUND(a / b, 2)`` over integers uses integer
half-up arithmetic (``rnd2``) because DuckDB divides DECIMALs in DOUBLE.
"""

from __future__ import annotations

from offerlake import schema as S
from offerlake.sources.fixtures import EVENTS_AS_OF_SQL, ORDERS_AS_OF_SQL

NOW = ORDERS_AS_OF_SQL
EV_NOW = EVENTS_AS_OF_SQL


def rnd2(num: str, den: str) -> str:
    """ROUND(num / den, 2) exactly, half away from zero, as DECIMAL(18,2)."""
    n, d = f"CAST({num} AS BIGINT)", f"CAST({den} AS BIGINT)"
    return (f"CAST(CASE WHEN {d} = 0 OR {d} IS NULL THEN NULL ELSE "
            f"CAST(sign({n}) * ((abs({n}) * 200 + {d}) // (2 * {d})) AS DECIMAL(18,0)) * 0.01 END "
            f"AS DECIMAL(18,2))")


SUCC = "status = 'takerPaid'"
FAIL = "status IN ('expired', 'cancelled')"


def _avg_secs(end: str) -> str:
    us = f"(epoch_us({end}) - epoch_us(created_at))"
    return (f"round_even(CAST(SUM({us}) FILTER (WHERE {SUCC}) AS DOUBLE) / "
            f"COUNT({us}) FILTER (WHERE {SUCC}), 0) / 1000000.0")


# mean routing fee of the paid offers, in hundredths of a per cent of the net amount
_FEE_SHARE = "(taker_invoice_fees * 100.0 / NULLIF(amount_sats - taker_fees, 0))"
FEE_PCT = (f"CAST(ROUND(CASE WHEN COUNT({_FEE_SHARE}) FILTER (WHERE {SUCC}) = 0 THEN 0 ELSE SUM({_FEE_SHARE}) FILTER (WHERE {SUCC}) "
           f"/ COUNT({_FEE_SHARE}) FILTER (WHERE {SUCC}) END * 100, 2) AS DECIMAL(18,2))")


def metrics_select(total: bool = False) -> str:
    failed = f"COUNT(*) FILTER (WHERE {FAIL})"
    success = f"COUNT(*) FILTER (WHERE {SUCC})"
    cols = {
        "success_percentage": rnd2(f"100 * {success}", f"{failed} + {success}"),
        "failed": failed,
        "success": success,
        "profit": f"CAST(COALESCE(SUM(maker_fees + taker_fees - taker_invoice_fees) FILTER (WHERE {SUCC}), 0) AS BIGINT)",
        "volume": f"CAST(COALESCE(SUM(fiat_amount) FILTER (WHERE {SUCC}), 0) AS DECIMAL(38,2))",
        "volume_sats": f"CAST(COALESCE(SUM(amount_sats) FILTER (WHERE {SUCC}), 0) AS BIGINT)",
        "success_count": success,
        "avg_reserved_seconds": _avg_secs("reserved_at"),
        "avg_total_seconds": _avg_secs("maker_confirmed_at"),
        "avg_taker_invoice_fees": "COALESCE(" + rnd2(
            f"SUM(taker_invoice_fees) FILTER (WHERE {SUCC})",
            f"COUNT(taker_invoice_fees) FILTER (WHERE {SUCC})") + ", CAST(0 AS DECIMAL(18,2)))",
        "taker_fees_percentage": FEE_PCT,
    }
    if total:
        ren = {"failed": "total_failed", "success": "total_success", "profit": "total_profit",
               "volume": "total_volume", "volume_sats": "total_volume_sats",
               "success_percentage": "overall_success_percentage",
               "avg_reserved_seconds": "overall_avg_reserved_seconds",
               "avg_total_seconds": "overall_avg_total_seconds",
               "avg_taker_invoice_fees": "overall_avg_taker_invoice_fees",
               "taker_fees_percentage": "overall_taker_fees_percentage"}
        return ", ".join(f"{v} AS {ren[k]}" for k, v in cols.items() if k in ren)
    return ", ".join(f"{v} AS {k}" for k, v in cols.items())


def metrics_period_sql(group_by: str) -> str:
    if group_by == "daily":
        bucket, label, where = ("CAST(created_at AS DATE)", "strftime(bucket, '%Y-%m-%d')",
                                f"WHERE created_at >= {NOW} - INTERVAL 29 DAY")
    elif group_by == "weekly":
        bucket, label, where = "date_trunc('week', created_at)", "strftime(bucket, '%G-W%V')", ""
    else:
        bucket, label, where = "date_trunc('month', created_at)", "strftime(bucket, '%Y-%m')", ""
    return (f"SELECT {label} AS date, * EXCLUDE (bucket) FROM ("
            f"SELECT {bucket} AS bucket, {metrics_select()} FROM offers {where} "
            f"GROUP BY 1) p")


METRICS_TOTALS = f"SELECT {metrics_select(total=True)} FROM offers"

TAKER_DOMAIN_RANKING = f"""
WITH paid AS (
  SELECT *, string_split(taker_lightning_address, '@') AS halves FROM offers WHERE {SUCC} AND contains(taker_lightning_address, '@'))
SELECT halves[2] AS taker_domain, COUNT(*) AS offer_count, {FEE_PCT} AS avg_fees_percentage
FROM paid GROUP BY halves[2] ORDER BY 3 DESC, 1
"""

# Days of each weekday between the first and the last offer are counted from the day numbers alone.
WEEKDAY_PROFILE = f"""
WITH span AS (SELECT CAST(MIN(created_at) AS DATE) AS lo, CAST(MAX(created_at) AS DATE) AS hi FROM offers),
day_list AS (SELECT lo + CAST(unnest(range(0, hi - lo + 1)) AS INTEGER) AS d FROM span),
per_name AS (SELECT isodow(d) AS n, COUNT(*) AS days FROM day_list GROUP BY ALL),
per_offer AS (SELECT isodow(created_at) AS n, COUNT(*) AS made, COUNT(*) FILTER (WHERE {SUCC}) AS paid FROM offers GROUP BY ALL)
SELECT names.label AS weekday, CAST(COALESCE(paid, 0) AS BIGINT) AS success_count,
       COALESCE({rnd2("COALESCE(made, 0)", "days")}, CAST(0 AS DECIMAL(18,2))) AS avg_offer_count
FROM (VALUES {", ".join(f"({n}, '{d}')" for n, d in S.WEEKDAYS)}) names(n, label)
LEFT JOIN per_name USING (n) LEFT JOIN per_offer USING (n)
ORDER BY n
"""


def _stat(end: str, recent: bool) -> str:
    cond = f"{SUCC}" + (f" AND created_at > {NOW} - INTERVAL 7 DAY" if recent else "")
    us = f"(epoch_us({end}) - epoch_us(created_at))"
    n = f"COUNT({us}) FILTER (WHERE {cond})"
    return (f"CAST(CASE WHEN {n} > 0 THEN round((SUM({us}) FILTER (WHERE {cond})) // 1000000 / {n}) "
            f"ELSE 0 END AS BIGINT)")


SUCCESS_STATS = f"""
SELECT {_stat('blik_received_at', False)} AS lifetime_avg_blik_received_seconds,
       {_stat('taker_paid_at', False)} AS lifetime_avg_taker_paid_seconds,
       COUNT(*) AS lifetime_count,
       {_stat('blik_received_at', True)} AS last7_avg_blik_received_seconds,
       {_stat('taker_paid_at', True)} AS last7_avg_taker_paid_seconds,
       COUNT(*) FILTER (WHERE created_at > {NOW} - INTERVAL 7 DAY) AS last7_count
FROM offers WHERE {SUCC}
"""

PUBLIC_VIEW = """id, epoch_ms(created_at) AS created_at, epoch_ms(reserved_at) AS reserved_at,
  epoch_ms(blik_received_at) AS blik_received_at, epoch_ms(settled_at) AS settled_at,
  CAST(fiat_amount AS DOUBLE) AS fiat_amount, fiat_currency, amount_sats, maker_fees, status,
  {hash} AS hold_invoice_payment_hash, epoch_ms(taker_paid_at) AS taker_paid_at, taker_fees"""

RECENT_SUCCESSES = (f"SELECT {PUBLIC_VIEW.format(hash=chr(39) * 2)} FROM offers "
                    f"WHERE {SUCC} AND created_at > {NOW} - INTERVAL 7 DAY")

SWEEP_SUMMARY = f"""
SELECT rule, CASE WHEN due_at IS NULL OR {NOW} > due_at THEN 'due' ELSE 'within_window' END AS outcome,
       COUNT(*) AS offer_count
FROM (
  SELECT CASE status WHEN 'funded' THEN 'funded_expiry' WHEN 'reserved' THEN 'reservation'
           WHEN 'blikReceived' THEN 'blik_confirmation' WHEN 'blikSentToMaker' THEN 'blik_confirmation'
           WHEN 'takerCharged' THEN 'taker_charged' WHEN 'conflict' THEN 'conflict' END AS rule,
         CASE status WHEN 'funded' THEN created_at + INTERVAL 600 SECOND
           WHEN 'reserved' THEN reserved_at + INTERVAL 30 SECOND
           WHEN 'blikReceived' THEN blik_received_at + INTERVAL 120 SECOND
           WHEN 'blikSentToMaker' THEN blik_received_at + INTERVAL 120 SECOND
           WHEN 'takerCharged' THEN created_at + INTERVAL 3600 SECOND
           WHEN 'conflict' THEN coalesce(updated_at, created_at) + INTERVAL 3600 SECOND END AS due_at
  FROM offers
) s WHERE rule IS NOT NULL
GROUP BY 1, 2
"""


# ---------------------------------------------------------------------------
# §2.2 lookups
# ---------------------------------------------------------------------------
LISTING = ", ".join(S.LISTING_COLUMNS)
OFFER_COLS = ", ".join(S.OFFER_COLUMNS)
AUDIT_COLS = ", ".join(S.AUDIT_COLUMNS)
ACTIVE = ", ".join(f"'{s}'" for s in S.ACTIVE_STATUSES)
PUBLIC = PUBLIC_VIEW.format(hash="hold_invoice_payment_hash")
PUBLIC_PK = PUBLIC + ", maker_pubkey, taker_pubkey"

OFFER_BY_ID = f"""SELECT {LISTING} FROM offers
WHERE id IN (SELECT offer_id FROM offer_changes WHERE offer_id IS NOT NULL)"""

OFFER_BY_PAYMENT_HASH = f"""SELECT {OFFER_COLS} FROM offers WHERE hold_invoice_payment_hash IN
(SELECT payment_hash FROM invoice_updates WHERE raw_state IN ('ACCEPTED', 'hold_invoice_accepted'))"""

OFFERS_BY_STATUS = f"""SELECT {OFFER_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY status ORDER BY created_at DESC, id) AS rn FROM offers
) WHERE rn <= 50"""

_ROLES = f"""(SELECT maker_pubkey AS user_pubkey, * FROM offers WHERE status IN ({ACTIVE})
  UNION ALL
  SELECT taker_pubkey AS user_pubkey, * FROM offers
  WHERE status IN ({ACTIVE}) AND taker_pubkey IS NOT NULL AND taker_pubkey <> maker_pubkey)"""

MY_ACTIVE_OFFERS = f"SELECT user_pubkey, {OFFER_COLS} FROM {_ROLES} r"

MY_ACTIVE_OFFER = f"""SELECT user_pubkey, {PUBLIC_PK} FROM (
  SELECT *, row_number() OVER (PARTITION BY user_pubkey ORDER BY created_at DESC, id) AS rn FROM {_ROLES} r
) WHERE rn = 1"""

MY_FINISHED_OFFERS = f"""SELECT user_pubkey, {PUBLIC_PK} FROM {_ROLES} r
WHERE status NOT IN ('expired', 'cancelled')
   OR (taker_paid_at IS NOT NULL AND (epoch_us({NOW}) - epoch_us(taker_paid_at)) // 3600000000 < 24)"""

OFFERS_LAST_HOURS = f"SELECT {OFFER_COLS} FROM offers WHERE created_at >= {NOW} - INTERVAL 168 HOUR"

RECENT_OFFERS = f"SELECT {LISTING} FROM offers ORDER BY coalesce(updated_at, created_at) DESC, id LIMIT 50"

AUDIT_BY_OFFER = f"""SELECT {AUDIT_COLS} FROM (
  SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY created_at DESC, id DESC) AS rn
  FROM audit WHERE offer_id IS NOT NULL
) WHERE rn <= 50"""

AUDIT_BY_ID = f"""SELECT {AUDIT_COLS} FROM audit
WHERE id IN (SELECT audit_id FROM audit_changes WHERE audit_id IS NOT NULL)"""

OFFER_PUBLIC_VIEW = f"SELECT {PUBLIC} FROM offers"
OFFER_PUBLIC_VIEW_PUBKEYS = f"SELECT {PUBLIC_PK} FROM offers"

# ---------------------------------------------------------------------------
# §2.9 audit enrichment
# ---------------------------------------------------------------------------


def _contains_any(words: list[str]) -> str:
    return " OR ".join(f"contains(lower(message), '{w}')" for w in words)


LEVEL_EXPR = (f"coalesce(level, CASE WHEN {_contains_any(S.SEVERE_WORDS)} THEN 'SEVERE' "
              f"WHEN {_contains_any(S.WARNING_WORDS)} THEN 'WARNING' ELSE 'INFO' END)")
ACTION_EXPR = ("CASE WHEN action IS NULL OR action = 'system.event' THEN CASE "
               + " ".join(f"WHEN {_contains_any(w)} THEN '{a}'" for w, a in S.ACTION_RULES)
               + " ELSE 'system.event' END ELSE action END")
LOGGER_ID_EXPR = (f"coalesce(CASE WHEN trim(offer_id) <> '' AND regexp_matches(trim(offer_id), '{S.UUID_IN_TEXT}') "
                  f"THEN trim(offer_id) END, nullif(regexp_extract(message, '{S.UUID_IN_TEXT}', 0), ''))")


def _db_normalize(x: str) -> str:
    return f"CASE WHEN trim({x}) <> '' AND regexp_matches(trim({x}), '{S.UUID_WHOLE}') THEN trim({x}) END"


AUDIT_SQL = f"""SELECT CAST(record_id AS BIGINT) AS id, {_db_normalize(LOGGER_ID_EXPR)} AS offer_id,
  {ACTION_EXPR} AS action, {LEVEL_EXPR} AS level, logger_name, message, error,
  CAST(NULL AS VARCHAR) AS stack_trace, metadata, ts AS created_at FROM log_records"""

ENRICH_AUDIT = f"SELECT {AUDIT_COLS} FROM audit"
INFER_LEVEL = f"SELECT record_id, {LEVEL_EXPR} AS level FROM log_records"
INFER_ACTION = f"SELECT record_id, {ACTION_EXPR} AS action FROM log_records"
INFER_OFFER_ID = f"SELECT record_id, {LOGGER_ID_EXPR} AS offer_id FROM log_records"
NORMALIZE_OFFER_ID = f"SELECT record_id, {_db_normalize('offer_id')} AS offer_id FROM log_records"
CLEANSE_AUDIT = ("SELECT record_id, CASE WHEN offer_id IS NULL OR regexp_matches(offer_id, "
                 "'^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$', 'i') THEN offer_id END "
                 "AS offer_id FROM log_records")

# ---------------------------------------------------------------------------
# §2.8 order feed and messaging
# ---------------------------------------------------------------------------
FEED_CASE = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.FEED_STATUS.items()) + " END"
FEED_STATUS = f"SELECT id, status, {FEED_CASE} AS feed_status FROM offers"

EXPIRATION_EXPR = "CASE WHEN status = 'funded' THEN epoch_ms(created_at + INTERVAL 600 SECOND) // 1000 END"
ORDER_EXPIRATION = f"SELECT id, {EXPIRATION_EXPR} AS expiration FROM offers"


def _tags(with_expiration: bool) -> str:
    fa = "regexp_replace(CAST(fiat_amount AS VARCHAR), '0+$', '')"
    fa = f"CASE WHEN suffix({fa}, '.') THEN {fa} || '0' ELSE {fa} END"
    exp = (f"CASE WHEN {EXPIRATION_EXPR} IS NOT NULL THEN ['expiration', CAST({EXPIRATION_EXPR} AS VARCHAR)] END"
           if with_expiration else "NULL")

    def secs(c: str) -> str:
        return f"coalesce(CAST(epoch_ms({c}) // 1000 AS VARCHAR), '')"

    items = [
        "['d', id]", "['k', 'sell']", "['f', fiat_currency]", f"['s', {FEED_CASE}]",
        "['amt', CAST(amount_sats AS VARCHAR)]", f"['fa', {fa}]", "['pm', 'BLIK']", "['premium', '0.0']",
        f"['source', 'https://{S.FRONTEND_DOMAIN}/offers/' || id]", "['network', 'mainnet']",
        "['layer', 'lightning']", "['name', '']", "['bond', '0']", exp, f"['y', '{S.PLATFORM}']",
        "['z', 'order']", f"['reserved_at', {secs('reserved_at')}]",
        "['created_at', CAST(epoch_ms(created_at) // 1000 AS VARCHAR)]", f"['paid_at', {secs('taker_paid_at')}]",
        "CASE WHEN taker_fees > 0 THEN ['taker_fees', CAST(taker_fees AS VARCHAR)] END",
        "CASE WHEN maker_fees > 0 THEN ['maker_fees', CAST(maker_fees AS VARCHAR)] END",
    ]
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


ORDER_EVENTS = f"SELECT id, 38383 AS kind, CAST(to_json({_tags(False)}) AS VARCHAR) AS tags FROM offers"
REBROADCAST_ORDERS = (f"SELECT id, 38383 AS kind, CAST(to_json({_tags(True)}) AS VARCHAR) AS tags FROM offers "
                      f"WHERE created_at >= {NOW} - INTERVAL 168 HOUR")

_BODY = ("json_object('offer_id', id, 'payment_hash', hold_invoice_payment_hash, 'status', status, "
         "'created_at', epoch_ms(created_at) // 1000, 'reserved_at', epoch_ms(reserved_at) // 1000, "
         "'timestamp', epoch_ms(coalesce(updated_at, created_at)) // 1000)")
STATUS_FANOUT = f"""SELECT id AS offer_id, status, 'maker' AS role, maker_pubkey AS recipient, CAST({_BODY} AS VARCHAR) AS body FROM offers
UNION ALL
SELECT id, status, 'taker', taker_pubkey, CAST({_BODY} AS VARCHAR) FROM offers WHERE taker_pubkey IS NOT NULL AND taker_pubkey <> ''"""


_JSON_NAMES = {"String": ["VARCHAR"], "int": ["BIGINT", "UBIGINT"], "double": ["DOUBLE", "HUGEINT"], "bool": ["BOOLEAN"], "List<dynamic>": ["ARRAY"],
               "_Map<String, dynamic>": ["OBJECT"]}


def _type_error_sql(prefix: str) -> str:
    """The first parameter of another type than the one it is read as; NULL without one."""
    per_method = []
    for m, req in S.REQUEST_METHODS.items():
        names = [x for r in req for x in (r if isinstance(r, list) else [r])] + (["maker_id"] if m == "initiate_offer" else [])
        whens = []
        for n in names:
            wanted, good = ("num", ("int", "double")) if n == "fiat_amount" else ("String", ("String",))
            for name, kinds in _JSON_NAMES.items():
                if name not in good:
                    whens.append(f"WHEN json_type(body, '$.params.{n}') IN ({', '.join(f"'{k}'" for k in kinds)}) "
                                 f"THEN '{prefix}type ''{name}'' is not a subtype of type ''{wanted}?'' in type cast'")
        # in the order of the parameters, not of the kinds
        if whens:
            per_method.append(f"WHEN '{m}' THEN CASE {' '.join(whens)} END")
    return f"CASE mth {' '.join(per_method)} END"


def _typed_validate_sql() -> str:
    prefix = S.MESSAGES["request_error_prefix"]
    shaped = """coalesce(json_type(body) = 'OBJECT' AND coalesce(json_type(body, '$.id') IN ('VARCHAR', 'NULL'), true)
        AND coalesce(json_type(body, '$.method') IN ('VARCHAR', 'NULL'), true) AND coalesce(json_type(body, '$.params') IN ('OBJECT', 'NULL'), true), false)"""
    sound = "(SELECT * REPLACE (CASE WHEN json_valid(body) THEN body END AS body) FROM typed_requests)"
    checked = _validate_sql().replace("json_valid(body)", shaped).replace("FROM requests", f"FROM {sound}")
    return f"""SELECT c.* EXCLUDE (status, error_code, error_message),
  CASE WHEN t.e IS NULL THEN status ELSE 'error' END AS status, CASE WHEN t.e IS NULL THEN error_code ELSE 'INTERNAL_ERROR' END AS error_code,
  coalesce(t.e, error_message) AS error_message
FROM ({checked}) c JOIN (
  SELECT request_id, CASE WHEN {shaped} AND json_extract_string(body, '$.id') IS NOT NULL THEN {_type_error_sql(prefix.removesuffix("Exception: "))} END AS e
  FROM (SELECT *, json_extract_string(body, '$.method') AS mth FROM {sound})) t USING (request_id)"""


def _validate_sql() -> str:
    prefix = S.MESSAGES["request_error_prefix"]

    def p(name: str) -> str:
        return f"json_extract_string(body, '$.params.{name}')"

    missing = []
    for m, req in S.REQUEST_METHODS.items():
        conds = []
        for r in req:
            if isinstance(r, list):
                conds.append("(" + " AND ".join(f"{p(x)} IS NULL" for x in r) + ")")
            else:
                conds.append(f"{p(r)} IS NULL")
        if not conds:
            continue
        if len(req) == 1:
            msg = S.MESSAGES["missing_param"] + req[0]
        elif m == "submit_blik":
            msg = S.MESSAGES["missing_params_submit_blik"]
        else:
            msg = S.MESSAGES["missing_params"] + ", ".join(x for x in req if isinstance(x, str))
        missing.append((m, " OR ".join(conds), msg))
    miss_cond = " OR ".join(f"(mth = '{m}' AND ({c}))" for m, c, _ in missing)
    miss_msg = "CASE " + " ".join(f"WHEN mth = '{m}' AND ({c}) THEN '{prefix}{msg}'" for m, c, msg in missing) + " END"
    known = ", ".join(f"'{m}'" for m in S.REQUEST_METHODS)
    return f"""
SELECT request_id, sender, rid AS id, mth AS method,
  CASE WHEN NOT ok THEN 'dropped' WHEN rid IS NULL OR mth IS NULL OR mth NOT IN ({known}) OR {miss_cond}
       THEN 'error' ELSE 'routed' END AS status,
  CASE WHEN NOT ok THEN 'PARSE_ERROR' WHEN rid IS NULL OR mth IS NULL THEN 'INVALID_REQUEST'
       WHEN mth NOT IN ({known}) OR {miss_cond} THEN 'INTERNAL_ERROR' END AS error_code,
  CASE WHEN NOT ok THEN '{S.MALFORMED_REQUEST}' WHEN rid IS NULL OR mth IS NULL THEN '{S.MESSAGES["invalid_request"]}'
       WHEN mth NOT IN ({known}) THEN '{prefix}{S.MESSAGES["unknown_method"]}' || mth
       ELSE {miss_msg} END AS error_message,
  CASE WHEN ok THEN {p('offer_id')} END AS offer_id, ts
FROM (SELECT *, json_valid(body) AS ok,
        CASE WHEN json_valid(body) THEN json_extract_string(body, '$.id') END AS rid,
        CASE WHEN json_valid(body) THEN json_extract_string(body, '$.method') END AS mth FROM requests) r"""


VALIDATE_REQUESTS = _validate_sql()
VALIDATE_TYPED_REQUESTS = _typed_validate_sql()

# ---------------------------------------------------------------------------
# §2.6 pricing and fees
# ---------------------------------------------------------------------------
_PATH = "CASE source " + " ".join(f"WHEN '{s}' THEN '{p}'" for s, p in S.RATE_SOURCES) + " END"
PARSED_RATES_CTE = f"""parsed AS (
  SELECT round_id, source, fetched_at,
         CASE WHEN http_status = 200 AND json_valid(body)
                   AND json_type(body, {_PATH}) IN ('BIGINT', 'UBIGINT', 'DOUBLE')
              THEN CAST(json_extract(body, {_PATH}) AS DOUBLE) END AS rate
  FROM rate_payloads)"""
ROUNDS_CTE = """rounds AS (
  SELECT round_id, MIN(fetched_at) AS fetched_at,
         CAST(SUM(CAST(rate AS DECIMAL(24,8))) AS DOUBLE) / COUNT(rate) AS rate, COUNT(rate) AS n_sources
  FROM parsed WHERE rate IS NOT NULL GROUP BY round_id)"""

PARSE_RATES = (f"WITH {PARSED_RATES_CTE} SELECT round_id, source, fetched_at, rate, "
               f"CASE WHEN rate > 0 THEN rate END AS rate_strict FROM parsed")
AVERAGE_RATE = f"WITH {PARSED_RATES_CTE}, {ROUNDS_CTE} SELECT * FROM rounds"
RATE_AT_CTE = f"""{PARSED_RATES_CTE}, {ROUNDS_CTE},
priced AS (
  SELECT q.quote_id, q.fiat_amount, q.ts, q.payment_hash, q.maker_id, r.rate,
         r.round_id AS rate_round_id, r.fetched_at AS rate_fetched_at,
         CASE WHEN r.round_id IS NULL THEN 'error'
              WHEN epoch_us(q.ts) - epoch_us(r.fetched_at) < 300000000 THEN 'fresh' ELSE 'stale' END AS rate_status
  FROM quotes q ASOF LEFT JOIN rounds r ON q.ts >= r.fetched_at)"""
RATE_AT = f"WITH {RATE_AT_CTE} SELECT * FROM priced"


def _fee(sats: str, pct: float) -> str:
    return f"CAST(ceil(CAST({sats} AS DOUBLE) * {pct} / 100.0) AS BIGINT)"


_SATS = "CAST(round(fiat_amount * (1.0 / CASE WHEN rate > 0 THEN rate END) * 100000000.0) AS BIGINT)"
QUOTE_OFFER = f"""WITH {RATE_AT_CTE}
SELECT *, {_SATS} AS amount_sats, {_fee(_SATS, S.MAKER_FEE_PCT)} AS maker_fees,
       {_fee(_SATS, S.TAKER_FEE_PCT)} AS taker_fees, {_SATS} + {_fee(_SATS, S.MAKER_FEE_PCT)} AS total_amount_sats,
       CASE WHEN rate IS NULL THEN '{S.MESSAGES["rate_unavailable"]}'
            WHEN rate <= 0 THEN '{S.MESSAGES["rate_not_finite"]}' END AS error
FROM priced"""

NET_SUBMIT = f"amount_sats - coalesce(taker_fees, {_fee('amount_sats', S.TAKER_FEE_PCT)})"
NET_PAY = f"amount_sats - {_fee('amount_sats', S.TAKER_FEE_PCT)}"
TAKER_NET_AMOUNT = (f"SELECT id, amount_sats, taker_fees, {NET_SUBMIT} AS net_at_submit, "
                    f"{NET_PAY} AS net_at_payment FROM offers")
INVOICE_TOLERANCE = f"""
SELECT a.offer_id, a.seq, a.invoice_amount_sats, o.net AS net_at_submit,
       CASE WHEN a.invoice_amount_sats > o.net + 10 THEN 'too_large'
            WHEN a.invoice_amount_sats < o.net - 100 THEN 'too_small' ELSE 'ok' END AS verdict
FROM action_log a JOIN (SELECT id, {NET_SUBMIT} AS net FROM offers) o ON o.id = a.offer_id
WHERE a.invoice_amount_sats IS NOT NULL"""
INVOICE_AMOUNT_MATCH = f"""
SELECT id, invoice_amount_sats, expected_sats,
       CASE WHEN invoice_amount_sats <> 0 AND invoice_amount_sats <> expected_sats
              THEN format('{S.MESSAGES["invoice_amount_mismatch"].replace("%d", "{}")}', invoice_amount_sats, expected_sats)
            WHEN invoice_amount_sats = 0 AND (expected_sats IS NULL OR expected_sats <= 0)
              THEN '{S.MESSAGES["zero_amount_invoice"]}' END AS error
FROM (SELECT id, {NET_PAY} AS expected_sats,
             CASE CAST(substr(id, 25) AS BIGINT) % 5 WHEN 0 THEN 0 WHEN 1 THEN {NET_PAY} + 1
                  ELSE {NET_PAY} END AS invoice_amount_sats
      FROM offers WHERE taker_invoice IS NOT NULL) t"""
FEE_LIMIT = """SELECT id, taker_fees, CAST(ceil(CAST(taker_fees AS DOUBLE) * 0.2) AS BIGINT) AS fee_limit_sat,
  taker_invoice_fees AS paid_fee_sat, taker_invoice_fees <= CAST(ceil(CAST(taker_fees AS DOUBLE) * 0.2) AS BIGINT) AS within_limit
FROM offers WHERE status = 'takerPaid'"""
SENDABLE_RANGE = f"""
SELECT o.id, o.taker_lightning_address, ({NET_PAY.replace('amount_sats', 'o.amount_sats')}) * 1000 AS amount_msat,
  CASE WHEN NOT contains(o.taker_lightning_address, '@') THEN 'not_an_address'
       WHEN a.tag IS NULL THEN 'unresolved'
       WHEN a.status = 'ERROR' THEN 'error_status'
       WHEN a.tag <> 'payRequest' THEN 'invalid_tag'
       WHEN a.callback IS NULL OR a.min_sendable IS NULL OR a.max_sendable IS NULL THEN 'missing_fields'
       WHEN ({NET_PAY.replace('amount_sats', 'o.amount_sats')}) * 1000 < a.min_sendable
         OR ({NET_PAY.replace('amount_sats', 'o.amount_sats')}) * 1000 > a.max_sendable THEN 'out_of_range'
       ELSE 'ok' END AS reason
FROM offers o LEFT JOIN addresses a ON a.lightning_address = o.taker_lightning_address
WHERE o.taker_lightning_address IS NOT NULL"""
AMOUNT_LIMIT_CHECK = f"""SELECT * FROM (
  SELECT id, amount_sats, fiat_currency,
         CASE WHEN amount_sats < {S.MIN_AMOUNT_SATS} THEN 'below_min' WHEN amount_sats > {S.MAX_AMOUNT_SATS} THEN 'above_max'
              WHEN upper(fiat_currency) NOT IN ('PLN') THEN 'unsupported_currency' END AS reason
  FROM offers) t WHERE reason IS NOT NULL"""
METRICS_PROFIT_FIAT = f"""WITH {PARSED_RATES_CTE}, {ROUNDS_CTE},
latest AS (SELECT arg_max(rate, {{"t": fetched_at, "r": round_id}}) AS rate FROM rounds),
report AS ({metrics_period_sql('monthly')})
SELECT report.date, report.profit,
       CASE WHEN latest.rate IS NULL OR latest.rate = 0 OR report.profit IS NULL OR report.profit = 0 THEN 0.0
            ELSE CAST(report.profit AS DOUBLE) / 100000000.0 * latest.rate END AS profit_fiat
FROM report CROSS JOIN latest"""

# ---------------------------------------------------------------------------
# §2.7 invoice and payment events
# ---------------------------------------------------------------------------
_LND = "CASE raw_state " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.LND_INVOICE_STATES.items()) + " ELSE 'UNKNOWN' END"
_NWC = "CASE raw_state " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.NWC_NOTIFICATIONS.items()) + " ELSE 'UNKNOWN' END"
NORMALIZED_UPDATES = f"""SELECT backend, payment_hash, seq, CASE WHEN backend = 'lnd' THEN {_LND} ELSE {_NWC} END AS status,
  CAST(CASE WHEN backend = 'lnd' AND raw_state = 'SETTLED' THEN amount_paid_sat END AS BIGINT) AS amount_paid_sat, ts
FROM invoice_updates"""
NORMALIZE_INVOICE_UPDATES = NORMALIZED_UPDATES
NORMALIZE_INVOICE_DETAILS = f"""SELECT payment_hash, backend,
  CAST(CASE WHEN backend = 'lnd' THEN value * 1000 ELSE value END AS BIGINT) AS amount_msat,
  CAST(creation_date AS BIGINT) AS created_at,
  CAST(CASE WHEN backend = 'lnd' THEN nullif(settle_date, 0) ELSE settle_date END AS BIGINT) AS settled_at,
  CAST(creation_date + expiry AS BIGINT) AS expires_at,
  CASE WHEN backend = 'lnd' THEN {_LND.replace('raw_state', 'state')}
       WHEN settle_date > 0 THEN 'SETTLED' ELSE 'OPEN' END AS status,
  memo AS description, 'incoming' AS type
FROM invoices_raw"""
INVOICE_STATUS_LATEST = f"""SELECT payment_hash, arg_max(status, seq) AS latest_status, MAX(seq) AS latest_seq,
  MIN(ts) FILTER (WHERE status = 'ACCEPTED') AS first_accepted_at,
  MIN(seq) FILTER (WHERE status = 'ACCEPTED') AS first_accepted_seq,
  COUNT(*) FILTER (WHERE status = 'CANCELED') AS canceled_updates, COUNT(*) AS updates
FROM ({NORMALIZED_UPDATES}) n GROUP BY payment_hash"""
FILTER_INVOICE_UPDATES = (f"SELECT * FROM ({NORMALIZED_UPDATES}) n WHERE payment_hash IN "
                          f"(SELECT hold_invoice_payment_hash FROM offers WHERE status = 'funded')")
OUTCOME_SQL = """SELECT payment_hash,
  CASE WHEN t IS NULL THEN 'UNKNOWN' ELSE t.raw_status END AS status,
  CAST(CASE WHEN t.raw_status = 'SUCCEEDED' THEN t.fee_sat END AS BIGINT) AS fee_sat,
  CASE WHEN t.raw_status = 'SUCCEEDED' THEN t.preimage END AS preimage,
  CASE WHEN t IS NULL THEN '{S.MESSAGES["no_definitive_status"]}'
       WHEN t.raw_status = 'FAILED' THEN t.failure_reason END AS error,
  t.stream AS decided_by
FROM (SELECT payment_hash,
        arg_min({'raw_status': raw_status, 'fee_sat': fee_sat, 'preimage': preimage,
                 'failure_reason': failure_reason, 'stream': stream, 'seq': seq},
                CASE WHEN stream = 'send' THEN 0 ELSE 1 END * 1000000 + seq)
          FILTER (WHERE raw_status IN ('SUCCEEDED', 'FAILED')) AS t
      FROM payment_updates GROUP BY payment_hash) a"""
OUTCOME_SQL = OUTCOME_SQL.replace('{S.MESSAGES["no_definitive_status"]}', S.MESSAGES["no_definitive_status"])
PAYMENT_OUTCOME = OUTCOME_SQL
PAYMENT_RESULT = f"""SELECT payment_hash, (error IS NULL AND preimage IS NOT NULL) AS is_success,
  CAST(CASE WHEN error IS NULL AND preimage IS NOT NULL THEN coalesce(fee_sat, 0) END AS BIGINT) AS stored_fee_sat, error
FROM ({OUTCOME_SQL}) o"""
PAYMENT_FAILURES = f"SELECT error AS reason, COUNT(*) AS failures FROM ({OUTCOME_SQL}) o WHERE error IS NOT NULL GROUP BY 1"

# ---------------------------------------------------------------------------
# §2.5 lifecycle
# ---------------------------------------------------------------------------
_RULES_SQL = {
    "funded_expiry": (["funded"], "created_at + INTERVAL 600 SECOND", {"funded": "expired"}),
    "reservation": (["reserved"], "reserved_at + INTERVAL 30 SECOND", {"reserved": "funded"}),
    "blik_confirmation": (["blikReceived", "blikSentToMaker"], "blik_received_at + INTERVAL 120 SECOND",
                          {"blikReceived": "expiredBlik", "blikSentToMaker": "expiredSentBlik"}),
    "taker_charged": (["takerCharged"], "created_at + INTERVAL 3600 SECOND", {"takerCharged": "settled"}),
    "conflict": (["conflict"], "coalesce(updated_at, created_at) + INTERVAL 3600 SECOND", {"conflict": "dispute"}),
}


def _new_status(moves: dict) -> str:
    return "CASE status " + " ".join(f"WHEN '{f}' THEN '{t}'" for f, t in moves.items()) + " END"


def sweep_sql(rule: str) -> str:
    sts, due, moves = _RULES_SQL[rule]
    ins = ", ".join(f"'{x}'" for x in sts)
    return (f"SELECT id, status, {_new_status(moves)} AS new_status, {due} AS due_at FROM offers "
            f"WHERE status IN ({ins}) AND ({due} IS NULL OR {NOW} > {due})")


DEADLINES = " UNION ALL ".join(
    f"SELECT id, status, '{rule}' AS rule, due_at, timeout_status, "
    f"CAST(trunc((epoch_us(due_at) - epoch_us({NOW})) / 1000000.0) AS BIGINT) AS remaining_seconds, "
    f"(due_at IS NULL OR {NOW} > due_at) AS overdue "
    f"FROM (SELECT id, status, {due} AS due_at, {_new_status(moves)} AS timeout_status FROM offers "
    f"WHERE status IN ({', '.join(repr(x) for x in sts)})) t"
    for rule, (sts, due, moves) in _RULES_SQL.items())

_SWEEP_NEW = "CASE " + " ".join(
    f"WHEN status = '{f}' AND ({due} IS NULL OR {NOW} > {due}) THEN '{t}'"
    for sts, due, moves in _RULES_SQL.values() for f, t in moves.items()) + " END"


def _startup_cols() -> str:
    cols = []
    for c in S.OFFER_COLUMNS:
        if c == "status":
            cols.append("coalesce(_new, status) AS status")
        elif c == "updated_at":
            cols.append(f"CASE WHEN _new IS NOT NULL THEN {NOW} ELSE updated_at END AS updated_at")
        elif c in ("maker_confirmed_at", "settled_at"):
            cols.append(f"CASE WHEN _new = 'settled' THEN {NOW} ELSE {c} END AS {c}")
        elif c in ("taker_pubkey", "reserved_at", "taker_lightning_address", "taker_invoice",
                   "taker_invoice_fees", "blik_received_at"):
            cols.append(f"CASE WHEN _new IN ('funded', 'expired', 'cancelled') THEN NULL ELSE {c} END AS {c}")
        else:
            cols.append(c)
    return ", ".join(cols)


STARTUP_SWEEP = f"SELECT {_startup_cols()} FROM (SELECT *, {_SWEEP_NEW} AS _new FROM offers) s"

REVERT_TO_FUNDED = f"""SELECT id, status AS old_status, 'funded' AS status, CAST(NULL AS VARCHAR) AS taker_pubkey,
  CAST(NULL AS TIMESTAMP) AS reserved_at, CAST(NULL AS VARCHAR) AS taker_lightning_address,
  CAST(NULL AS TIMESTAMP) AS blik_received_at, {NOW} AS updated_at,
  created_at + INTERVAL 600 SECOND AS funded_expires_at, {NOW} > created_at + INTERVAL 600 SECOND AS expires_immediately
FROM offers WHERE status IN ('reserved', 'expiredBlik', 'invalidBlik')"""

STATUS_HISTORY = """SELECT offer_id, seq, status, ts,
  lag(status) OVER w AS prev_status,
  CAST(trunc((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1000000.0) AS BIGINT) AS seconds_in_status,
  lead(seq) OVER w IS NULL AS is_current
FROM status_events WINDOW w AS (PARTITION BY offer_id ORDER BY seq)"""

_FIELD_WRITES_SQL = {
    "taker_pubkey": ("status = 'reserved'", "taker_pubkey"),
    "reserved_at": ("status = 'reserved'", "ts"),
    "blik_received_at": ("status = 'blikReceived'", "ts"),
    "taker_lightning_address": ("status = 'blikReceived'", "address"),
    "maker_confirmed_at": ("status = 'makerConfirmed'", "ts"),
    "settled_at": ("status = 'settled'", "ts"),
    "taker_paid_at": ("status = 'takerPaid'", "ts"),
    "taker_fees": ("status = 'takerPaid'", "taker_fees"),
    "taker_invoice": ("false", "NULL"),
    "taker_invoice_fees": ("false", "NULL"),
}
_CLEARED_SQL = {"taker_pubkey", "reserved_at", "blik_received_at", "taker_lightning_address",
                "taker_invoice", "taker_invoice_fees"}


def _apply_status_sql() -> str:
    aggs = ["arg_max({'status': status, 'ts': ts}, seq) AS _last"]
    for f, (cond, val) in _FIELD_WRITES_SQL.items():
        touch = f"({cond})" + (" OR status IN ('funded', 'expired', 'cancelled')" if f in _CLEARED_SQL else "")
        aggs.append(f"arg_max({{'v': CASE WHEN {cond} THEN {val} END}}, seq) FILTER (WHERE {touch}) AS _{f}")
    cols = []
    for c in S.OFFER_COLUMNS:
        if c == "status":
            cols.append("coalesce(u._last.status, o.status) AS status")
        elif c == "updated_at":
            cols.append("CASE WHEN u._last IS NOT NULL THEN u._last.ts ELSE o.updated_at END AS updated_at")
        elif c in _FIELD_WRITES_SQL:
            typ = "BIGINT" if c in ("taker_fees", "taker_invoice_fees") else (
                "TIMESTAMP" if c.endswith("_at") else "VARCHAR")
            cols.append(f"CASE WHEN u._{c} IS NOT NULL THEN CAST(u._{c}.v AS {typ}) ELSE o.{c} END AS {c}")
        else:
            cols.append(f"o.{c}")
    return (f"SELECT {', '.join(cols)} FROM offers o LEFT JOIN ("
            f"SELECT offer_id, {', '.join(aggs)} FROM status_events "
            f"WHERE NOT (status = 'reserved' AND taker_pubkey IS NULL) AND ts IS NOT NULL GROUP BY offer_id"
            f") u ON u.offer_id = o.id")


APPLY_STATUS_UPDATES = _apply_status_sql()

INVOICE_UPDATE_ROWS = """SELECT '00000000-0000-4000-8000-' || lpad(substr(payment_hash, 5), 12, '0') AS offer_id,
  CASE WHEN seq = 1 THEN 'inv-' || substr(payment_hash, 5) || '-r' END AS taker_invoice,
  CASE WHEN raw_status = 'SUCCEEDED' THEN fee_sat END AS taker_invoice_fees, ts
FROM payment_updates WHERE seq = 1 OR raw_status = 'SUCCEEDED'"""


def _replace_cols(repl: dict[str, str], prefix: str = "o.") -> str:
    return ", ".join(f"{repl[c]} AS {c}" if c in repl else f"{prefix}{c}" for c in S.OFFER_COLUMNS)


APPLY_INVOICE_UPDATES = f"""WITH upd AS ({INVOICE_UPDATE_ROWS}),
latest AS (SELECT offer_id,
  arg_max(taker_invoice, ts) FILTER (WHERE taker_invoice IS NOT NULL) AS inv,
  max(ts) FILTER (WHERE taker_invoice IS NOT NULL) AS inv_ts,
  arg_max(taker_invoice_fees, ts) FILTER (WHERE taker_invoice_fees IS NOT NULL) AS fee,
  max(ts) FILTER (WHERE taker_invoice_fees IS NOT NULL) AS fee_ts
  FROM upd GROUP BY offer_id)
SELECT {_replace_cols({"taker_invoice": "coalesce(l.inv, o.taker_invoice)",
                       "taker_invoice_fees": "coalesce(l.fee, o.taker_invoice_fees)",
                       "updated_at": "coalesce(greatest(l.inv_ts, l.fee_ts), o.updated_at)"})}
FROM offers o LEFT JOIN latest l ON l.offer_id = o.id"""

_CANCEL_HIT = "(c.id IS NOT NULL)"
APPLY_CANCELLATIONS = f"""WITH ok AS (
  SELECT DISTINCT a.offer_id AS id FROM action_log a JOIN offers o ON o.id = a.offer_id
  WHERE a.action = 'cancel_offer' AND a.actor = o.maker_pubkey AND o.status = 'funded')
SELECT {_replace_cols(dict({"status": f"CASE WHEN {_CANCEL_HIT} THEN 'cancelled' ELSE o.status END",
                            "updated_at": f"CASE WHEN {_CANCEL_HIT} THEN {NOW} ELSE o.updated_at END"},
                           **{c: f"CASE WHEN {_CANCEL_HIT} THEN NULL ELSE o.{c} END" for c in _CLEARED_SQL}))}
FROM offers o LEFT JOIN ok c ON c.id = o.id"""

INVOICE_CHANGE_ROWS = """SELECT json_extract_string(body, '$.params.offer_id') AS offer_id, sender,
  json_extract_string(body, '$.params.bolt11') AS bolt11, ts
FROM requests WHERE json_valid(body) AND json_extract_string(body, '$.method') = 'update_taker_invoice'
  AND json_extract_string(body, '$.params.offer_id') IS NOT NULL
  AND json_extract_string(body, '$.params.bolt11') IS NOT NULL"""
APPLY_INVOICE_CHANGE = f"""WITH chg AS ({INVOICE_CHANGE_ROWS}),
own AS (SELECT c.* FROM chg c JOIN offers o ON o.id = c.offer_id WHERE c.sender = o.taker_pubkey),
latest AS (SELECT offer_id, arg_max(bolt11, {{'t': ts, 'b': bolt11}}) AS bolt11, max(ts) AS ts FROM own GROUP BY offer_id)
SELECT {_replace_cols({"taker_invoice": "coalesce(l.bolt11, o.taker_invoice)",
                       "updated_at": "coalesce(l.ts, o.updated_at)"})}
FROM offers o LEFT JOIN latest l ON l.offer_id = o.id"""


# Who may do what from which status, and the status that follows (from the survey's table).
MOVES = """
fund system - funded
reserve any funded reserved
reserve any invalidBlik reserved
reserve any expiredBlik reserved
reserve any expiredSentBlik reserved
submit_blik taker reserved blikReceived
get_blik maker blikReceived blikSentToMaker
get_blik maker blikSentToMaker blikSentToMaker
mark_blik_invalid maker takerCharged conflict
mark_blik_invalid maker blikSentToMaker invalidBlik
mark_blik_invalid maker expiredSentBlik invalidBlik
mark_blik_charged taker invalidBlik conflict
mark_blik_charged taker expiredSentBlik takerCharged
open_dispute maker conflict dispute
confirm_payment maker conflict settled
confirm_payment maker takerCharged settled
confirm_payment maker blikSentToMaker settled
confirm_payment maker expiredSentBlik settled
cancel_reservation taker reserved funded
cancel_reservation taker expiredBlik funded
cancel_reservation taker invalidBlik funded
cancel_offer maker funded cancelled
pay_taker system settled takerPaid
pay_taker_failed system settled takerPaymentFailed
retry_taker_payment taker * takerPaid
expire_funded system funded expired
expire_reservation system reserved funded
expire_blik system blikReceived expiredBlik
expire_blik system blikSentToMaker expiredSentBlik
auto_confirm system takerCharged settled
auto_dispute system conflict dispute
"""
_MOVE_ROWS = ", ".join("(" + ", ".join("NULL" if x == "-" else f"'{x}'" for x in line.split()) + ")" for line in MOVES.split("\n") if line)

VALIDATE_ACTIONS = f"""WITH moves(action, role, src, dst) AS (VALUES {_MOVE_ROWS}),
roles AS (SELECT DISTINCT action, role FROM moves),
asked AS (
  SELECT a.*, o.status AS cur, o.blik_received_at IS NOT NULL AS blik, o.taker_invoice IS NOT NULL AS invoiced, roles.role,
    a.invoice_amount_sats - ({NET_SUBMIT}) AS over_net,
    CASE roles.role WHEN 'maker' THEN a.actor IS NOT NULL AND a.actor IS NOT DISTINCT FROM o.maker_pubkey
      WHEN 'taker' THEN a.actor IS NOT NULL AND a.actor IS NOT DISTINCT FROM o.taker_pubkey
      WHEN 'system' THEN coalesce(a.actor, 'system') = 'system' ELSE true END AS may,
    coalesce(a.actor = o.taker_pubkey, false) AS is_taker
  FROM action_log a LEFT JOIN offers o ON o.id = a.offer_id LEFT JOIN roles ON roles.action = a.action),
moved AS (
  SELECT asked.*, moves.dst FROM asked
  LEFT JOIN moves ON moves.action = asked.action AND (moves.src IS NOT DISTINCT FROM asked.cur OR (moves.src = '*' AND asked.cur IS NOT NULL))),
judged AS (
  SELECT *, CASE WHEN role IS NULL THEN 'unknown_action'
    WHEN action = 'fund' THEN CASE WHEN dst IS NULL THEN 'already_exists' END
    WHEN cur IS NULL THEN 'not_found'
    WHEN NOT may THEN 'wrong_actor'
    WHEN dst IS NULL THEN 'wrong_state'
    WHEN action = 'reserve' AND cur IN ('invalidBlik', 'expiredBlik') AND NOT is_taker THEN 'wrong_actor'
    WHEN action = 'get_blik' AND NOT blik THEN 'missing_blik_code'
    WHEN action = 'retry_taker_payment' AND NOT invoiced THEN 'no_invoice'
    WHEN action = 'submit_blik' AND over_net > 10 THEN 'invoice_too_large'
    WHEN action = 'submit_blik' AND over_net < -100 THEN 'invoice_too_small' END AS reason
  FROM moved)
SELECT offer_id, seq, action, actor, cur AS status, reason IS NULL AS accepted, reason,
  CASE WHEN reason IS NULL THEN dst ELSE cur END AS new_status,
  CASE WHEN reason IS NULL AND action = 'retry_taker_payment' AND cur = 'takerPaid' THEN 'retry_on_paid' END AS warning
FROM judged"""

# ---------------------------------------------------------------------------
# §2.4 joins on changes
# ---------------------------------------------------------------------------
CHANGES_ENRICHED = f"""SELECT c.seq, c.operation, c.offer_id,
  CASE WHEN o.id IS NOT NULL THEN 'offer_changed' ELSE 'offer_removed' END AS type,
  {', '.join('o.' + x for x in S.LISTING_COLUMNS if x != 'id')}
FROM offer_changes c LEFT JOIN offers o ON o.id = c.offer_id WHERE c.offer_id IS NOT NULL"""

_AV = ["id", "offer_id", "action", "level", "message", "created_at"]
AUDIT_CHANGES_ENRICHED = f"""WITH latest AS (
  SELECT offer_id, arg_max({{{', '.join(f"'{x}': {x}" for x in _AV)}}}, {{'c': created_at, 'i': id}}) AS r
  FROM audit WHERE offer_id IS NOT NULL GROUP BY offer_id)
SELECT c.seq, c.operation, c.offer_id, c.audit_id, 'audit_changed' AS type,
  {', '.join(f"CASE WHEN a.id IS NOT NULL THEN a.{x} WHEN c.operation <> 'DELETE' THEN l.r.{x} END AS entry_{x}" for x in _AV)}
FROM audit_changes c LEFT JOIN audit a ON a.id = c.audit_id LEFT JOIN latest l ON l.offer_id = c.offer_id
WHERE c.offer_id IS NOT NULL"""

FUND_OFFERS = f"""WITH {RATE_AT_CTE},
q AS (SELECT *, {_SATS} AS amount_sats, {_fee(_SATS, S.MAKER_FEE_PCT)} AS maker_fees,
             {_fee(_SATS, S.TAKER_FEE_PCT)} AS taker_fees FROM priced),
d AS (SELECT payment_hash, arg_min({{'status': status, 'ts': ts}}, seq) AS d FROM quote_updates
      WHERE status IN ('ACCEPTED', 'CANCELED', 'SETTLED') GROUP BY payment_hash),
r AS (SELECT q.*, d.d,
        CASE WHEN d.d IS NULL THEN 'pending' WHEN d.d.status = 'CANCELED' THEN 'canceled'
             WHEN d.d.status = 'SETTLED' THEN 'settled'
             WHEN q.amount_sats IS NULL THEN 'no_quote'
             WHEN q.payment_hash IN (SELECT hold_invoice_payment_hash FROM offers) THEN 'already_exists'
             ELSE 'funded' END AS outcome
      FROM q LEFT JOIN d ON d.payment_hash = q.payment_hash)
SELECT quote_id, payment_hash, outcome,
  CASE WHEN outcome = 'funded' THEN '00000000-0000-4000-8000-' || lpad(CAST(quote_id + 100000000000 AS VARCHAR), 12, '0') END AS id,
  CASE WHEN outcome = 'funded' THEN amount_sats END AS amount_sats,
  CASE WHEN outcome = 'funded' THEN maker_fees END AS maker_fees,
  CASE WHEN outcome = 'funded' THEN taker_fees END AS taker_fees,
  CASE WHEN outcome = 'funded' THEN maker_id END AS maker_pubkey,
  CASE WHEN outcome = 'funded' THEN 'funded' END AS status,
  CASE WHEN outcome = 'funded' THEN d.ts END AS created_at,
  CASE WHEN outcome = 'funded' THEN CAST(fiat_amount AS DECIMAL(18,2)) END AS fiat_amount
FROM r"""

OFFERS_WITH_AUDIT = f"""SELECT {', '.join('o.' + x for x in S.LISTING_COLUMNS)}, t.id AS audit_id, t.rn AS audit_rank,
  t.action AS audit_action, t.message AS audit_message, t.created_at AS audit_created_at
FROM offers o LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY created_at DESC, id DESC) AS rn
  FROM audit WHERE offer_id IS NOT NULL QUALIFY rn <= 50) t ON t.offer_id = o.id"""

# ---------------------------------------------------------------------------
# §2.1 sources and sinks, §2.10 streams (batch twins)
# ---------------------------------------------------------------------------
_ODD = "CAST(substr(id, 25) AS BIGINT) % 2 = 1"
READ_OFFERS = "SELECT " + ", ".join(
    f"CASE WHEN {_ODD} THEN NULL ELSE {c} END AS {c}" if c in S.OFFER_LATE_COLUMNS else c
    for c in S.OFFER_COLUMNS) + " FROM offers"
READ_AUDIT = ENRICH_AUDIT
READ_RATES = "SELECT round_id, source, fetched_at, CAST(http_status AS INTEGER) AS http_status, body FROM rate_payloads"

_FUNDED_COLS = ["quote_id", "payment_hash", "id", "amount_sats", "maker_fees", "taker_fees", "maker_pubkey",
                "status", "created_at", "fiat_amount"]
FUNDED_ROWS = f"SELECT {', '.join(_FUNDED_COLS)} FROM ({FUND_OFFERS}) f WHERE outcome = 'funded'"

APPEND_OFFERS = f"""SELECT {OFFER_COLS} FROM offers
UNION ALL
SELECT id, amount_sats, maker_fees, taker_fees, maker_pubkey, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
  CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), payment_hash, status, created_at, {EV_NOW}, CAST(NULL AS TIMESTAMP),
  CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP),
  fiat_amount, 'PLN'
FROM ({FUNDED_ROWS}) n"""

READ_CHANGES = "SELECT seq, operation, offer_id, change_ts FROM offer_changes"

# Removed offers are gone from the table and changed ones are in it as they are now.
STREAM_RECENT_OFFERS = f"""SELECT {', '.join(S.LISTING_COLUMNS)} FROM offers
ORDER BY coalesce(updated_at, created_at) DESC, id LIMIT 50"""

# All stored lines of every offer, with the stream's entries added or in the place of those with their id.
STREAM_OFFER_AUDIT = f"""WITH e AS ({AUDIT_CHANGES_ENRICHED}),
entries AS (
  SELECT offer_id, {', '.join(f'entry_{x}' for x in _AV if x != 'offer_id')} FROM e WHERE entry_id IS NOT NULL
  UNION SELECT offer_id, {', '.join(f'{x} AS entry_{x}' for x in _AV if x != 'offer_id')} FROM audit WHERE offer_id IS NOT NULL)
SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY entry_created_at DESC, entry_id DESC) AS entry_rank
FROM entries QUALIFY entry_rank <= 50"""

_TOTAL_ORDER = ["total_failed", "total_success", "total_profit", "total_volume", "total_volume_sats",
                "overall_success_percentage", "overall_avg_reserved_seconds", "overall_avg_total_seconds",
                "overall_avg_taker_invoice_fees", "overall_taker_fees_percentage"]
REPORT_JSON = f"""WITH rws AS ({metrics_period_sql('weekly')}),
tot AS ({METRICS_TOTALS}),
dom AS ({TAKER_DOMAIN_RANKING}),
wk AS ({WEEKDAY_PROFILE})
SELECT CAST(to_json({{
  'rows': (SELECT list(r ORDER BY r.date) FROM rws r),
  'totals': (SELECT {{{', '.join(f"'{c}': t.{c}" for c in _TOTAL_ORDER)}}} FROM tot t),
  'takerDomainRanking': (SELECT list(d ORDER BY d.avg_fees_percentage DESC, d.taker_domain) FROM dom d),
  'weekdaySuccess': (SELECT list(w ORDER BY CASE w.weekday {' '.join(f"WHEN '{n}' THEN {i}" for i, n in S.WEEKDAYS)} END)
                     FROM wk w)
}}) AS VARCHAR) AS report"""

REPORT_SECTIONS = f"""WITH rws AS ({metrics_period_sql('weekly')}),
tot AS ({METRICS_TOTALS}),
dom AS ({TAKER_DOMAIN_RANKING}),
wk AS ({WEEKDAY_PROFILE})
SELECT 'rows' AS section, CAST(NULL AS DECIMAL(38,2)) AS rank, r.date AS name, CAST(to_json(r) AS VARCHAR) AS entry FROM rws r
UNION ALL SELECT 'totals', NULL, 'totals', CAST(to_json({{{', '.join(f"'{c}': t.{c}" for c in _TOTAL_ORDER)}}}) AS VARCHAR) FROM tot t
UNION ALL SELECT 'takerDomainRanking', CAST(d.avg_fees_percentage AS DECIMAL(38,2)), d.taker_domain, CAST(to_json(d) AS VARCHAR) FROM dom d
UNION ALL SELECT 'weekdaySuccess', -CASE w.weekday {' '.join(f"WHEN '{n}' THEN {i}" for i, n in S.WEEKDAYS)} END, w.weekday,
  CAST(to_json(w) AS VARCHAR) FROM wk w"""

STREAM_PUBLISH_ORDERS = (f"SELECT c.seq, o.id, 38383 AS kind, CAST(to_json({_tags(False)}) AS VARCHAR) AS tags "
                         f"FROM offer_changes c JOIN offers o ON o.id = c.offer_id")

# Every event opens a stay in a status that ends with the offer's next event (or, for the last one, with the
# watermark); a deadline inside the stay fires. Reverting to funded opens a second stay with the funded deadline.
_DAY_MS = {"funded": (S.FUNDED_EXPIRY_SECONDS, "made"), "reserved": (S.RESERVATION_SECONDS, "ms"),
           "blikReceived": (S.BLIK_CONFIRMATION_SECONDS, "ms"), "blikSentToMaker": (S.BLIK_CONFIRMATION_SECONDS, "coded"),
           "takerCharged": (S.TAKER_CHARGED_AUTO_CONFIRM_SECONDS, "made"), "conflict": (S.CONFLICT_AUTO_DISPUTE_SECONDS, "ms")}
STREAM_DEADLINES = f"""WITH ev AS (
  SELECT offer_id, seq, status, epoch_ms(ts) AS ms, lead(epoch_ms(ts)) OVER w AS next_ms,
    coalesce(first_value(CASE WHEN status = 'funded' THEN epoch_ms(ts) END IGNORE NULLS) OVER w, epoch_ms(ts)) AS made,
    coalesce(last_value(CASE WHEN status = 'blikReceived' THEN epoch_ms(ts) END IGNORE NULLS) OVER w, epoch_ms(ts)) AS coded
  FROM status_events WHERE ts IS NOT NULL
  WINDOW w AS (PARTITION BY offer_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
stay AS (
  SELECT *, coalesce(next_ms, (SELECT max(ms) - 60001 FROM ev)) AS until_ms,
    CASE status {' '.join(f"WHEN '{st}' THEN {base} + {secs * 1000}" for st, (secs, base) in _DAY_MS.items())} END AS due,
    CASE status WHEN 'funded' THEN 'expired' WHEN 'reserved' THEN 'funded' WHEN 'blikReceived' THEN 'expiredBlik'
      WHEN 'blikSentToMaker' THEN 'expiredSentBlik' WHEN 'takerCharged' THEN 'settled' WHEN 'conflict' THEN 'dispute' END AS next_status
  FROM ev),
one AS (SELECT *, greatest(due, ms) AS fired FROM stay WHERE due <= until_ms),
reverted AS (
  SELECT offer_id, fired, until_ms, CASE WHEN has THEN made ELSE fired END + {S.FUNDED_EXPIRY_SECONDS * 1000} AS due
  FROM (SELECT one.*, EXISTS (SELECT 1 FROM ev e WHERE e.offer_id = one.offer_id AND e.status = 'funded' AND e.seq <= one.seq) AS has
        FROM one WHERE next_status = 'funded') r),
found AS (
  SELECT offer_id, status, next_status, due, fired FROM one
  UNION ALL SELECT offer_id, 'funded', 'expired', due, greatest(due, fired) FROM reverted WHERE due <= until_ms)
SELECT offer_id, status, next_status AS timeout_status, TIMESTAMP '1970-01-01 00:00:00' + to_milliseconds(due) AS due_at,
  TIMESTAMP '1970-01-01 00:00:00' + to_milliseconds(fired) AS fired_at
FROM found"""


def _replay_sql() -> str:
    """Sequential fold of every offer's action log as a recursive CTE: step
    n joins the state after step n-1 with the offer's n-th action."""
    from offerlake.operators.lifecycle import decide_reason_sql, decide_status_sql, decide_warning_sql
    refs = {"action": "x.action", "status": "s.status", "actor": "x.actor", "maker": "x.maker",
            "taker": "s.taker", "has_blik": "s.has_blik", "has_invoice": "s.has_invoice", "verdict": "x.verdict"}
    qrefs = {k: "q." + v.split(".", 1)[1] if v.startswith("x.") else "q.s_" + v.split(".", 1)[1]
             for k, v in refs.items()}
    reason = decide_reason_sql(refs)
    ns = decide_status_sql(qrefs, "q.r")
    warn = decide_warning_sql(qrefs, "q.r")
    clears = f"(({ns}) IN ('funded', 'expired', 'cancelled'))"
    ok = "(q.r IS NULL)"
    return f"""WITH RECURSIVE acts AS (
  SELECT a.offer_id, CAST(a.seq AS INTEGER) AS seq, a.action, a.actor, o.maker_pubkey AS maker,
         CASE WHEN a.invoice_amount_sats IS NULL THEN NULL
              WHEN a.invoice_amount_sats > o.net + 10 THEN 'too_large'
              WHEN a.invoice_amount_sats < o.net - 100 THEN 'too_small' ELSE 'ok' END AS verdict,
         row_number() OVER (PARTITION BY a.offer_id ORDER BY a.seq) AS n
  FROM action_log a LEFT JOIN (SELECT id, maker_pubkey, {NET_SUBMIT} AS net FROM offers) o ON o.id = a.offer_id),
steps AS (
  SELECT offer_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS taker,
         false AS has_blik, false AS has_invoice, CAST(NULL AS INTEGER) AS seq, CAST(NULL AS VARCHAR) AS action,
         CAST(NULL AS VARCHAR) AS actor, CAST(NULL AS VARCHAR) AS status_before, CAST(NULL AS VARCHAR) AS reason,
         CAST(NULL AS VARCHAR) AS warning
  FROM (SELECT DISTINCT offer_id FROM acts) d
  UNION ALL
  SELECT q.offer_id, q.n, {ns},
         CASE WHEN {ok} AND q.action = 'reserve' THEN q.actor WHEN {ok} AND {clears} THEN NULL ELSE q.s_taker END,
         CASE WHEN {ok} AND q.action = 'submit_blik' THEN true WHEN {ok} AND {clears} THEN false ELSE q.s_has_blik END,
         CASE WHEN {ok} AND q.action = 'submit_blik' THEN true WHEN {ok} AND {clears} THEN false ELSE q.s_has_invoice END,
         q.seq, q.action, q.actor, q.s_status, q.r, {warn}
  FROM (SELECT x.offer_id, x.n, x.seq, x.action, x.actor, x.maker, x.verdict, s.status AS s_status,
               s.taker AS s_taker, s.has_blik AS s_has_blik, s.has_invoice AS s_has_invoice, {reason} AS r
        FROM steps s JOIN acts x ON x.offer_id = s.offer_id AND x.n = s.n + 1) q)
SELECT offer_id, seq, action, actor, status_before, status AS status_after, reason IS NULL AS accepted, reason,
       warning, taker AS taker_after
FROM steps WHERE n > 0"""


REPLAY_STEPS = _replay_sql()
REPLAY_ACTIONS = f"""SELECT offer_id, arg_max(status_after, seq) AS final_status, arg_max(taker_after, seq) AS taker_pubkey,
  COUNT(*) AS n_actions, COUNT(*) FILTER (WHERE accepted) AS n_accepted, COUNT(*) FILTER (WHERE NOT accepted) AS n_rejected,
  COUNT(warning) AS n_warnings,
  arg_min({{'seq': seq, 'action': action, 'reason': reason}}, seq) FILTER (WHERE NOT accepted) AS first_rejected
FROM ({REPLAY_STEPS}) st GROUP BY offer_id"""


# Two versions of the offers: in the first, some later ones are missing, some have an older status and some are there that go later;
# only offers created in January, April, July or October differ.
_TOUCHED = "month(created_at) % 3 = 1 AND CAST(substr(id, 25, 12) AS BIGINT) % 10"
CAPTURE_CHANGES = f"""SELECT CASE WHEN {_TOUCHED} = 0 THEN 'INSERT' WHEN {_TOUCHED} = 1 THEN 'DELETE' ELSE 'UPDATE' END AS operation, id AS offer_id
FROM offers WHERE {_TOUCHED} IN (0, 1) OR ({_TOUCHED} = 2 AND status IS DISTINCT FROM 'funded')"""
CAPTURE_AUDIT_CHANGES = """SELECT CASE id % 10 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'DELETE' ELSE 'UPDATE' END AS operation, id AS audit_id, offer_id
FROM audit WHERE id % 10 IN (0, 1) OR (id % 10 = 2 AND message IS DISTINCT FROM 'draft')"""


SWEEP_DUE = " UNION ALL ".join(f"SELECT id, status, '{r}' AS rule, new_status, due_at FROM ({sweep_sql(r)})"
                               for r in ("funded_expiry", "reservation", "blik_confirmation", "taker_charged", "conflict"))
