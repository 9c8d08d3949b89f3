"""Schemas and fixed values of the offer domain.

Everything under "FIXED VALUES" must equal the behaviour being reproduced
(status names, method names, timeouts, fee defaults); it is data, not logic.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must stay exactly as written)
# ---------------------------------------------------------------------------

# The 18 offer statuses, in declaration order. 'created' is never stored.
STATUSES = [
    "created", "funded", "expired", "cancelled", "reserved", "blikReceived",
    "blikSentToMaker", "expiredBlik", "expiredSentBlik", "takerCharged",
    "invalidBlik", "conflict", "dispute", "makerConfirmed", "settled",
    "payingTaker", "takerPaymentFailed", "takerPaid",
]

# Statuses listed by "my active offers" (note: no expired, cancelled,
# dispute or settled).
ACTIVE_STATUSES = [
    "created", "funded", "reserved", "blikReceived", "blikSentToMaker",
    "expiredBlik", "expiredSentBlik", "takerCharged", "invalidBlik",
    "conflict", "makerConfirmed", "payingTaker", "takerPaymentFailed",
    "takerPaid",
]

SUCCESS_STATUS = "takerPaid"
FAILED_STATUSES = ["expired", "cancelled"]

# Public order-feed status per offer status.
FEED_STATUS = {
    "created": "pending", "funded": "pending",
    "reserved": "in-progress", "blikReceived": "in-progress",
    "blikSentToMaker": "in-progress", "makerConfirmed": "in-progress",
    "settled": "in-progress", "payingTaker": "in-progress",
    "takerPaymentFailed": "in-progress", "invalidBlik": "in-progress",
    "expiredBlik": "in-progress", "expiredSentBlik": "in-progress",
    "takerCharged": "in-progress",
    "takerPaid": "success",
    "cancelled": "canceled", "expired": "canceled",
    "conflict": "dispute", "dispute": "dispute",
}

# Deadlines in seconds.
FUNDED_EXPIRY_SECONDS = 600
RESERVATION_SECONDS = 30
BLIK_CONFIRMATION_SECONDS = 120
TAKER_CHARGED_AUTO_CONFIRM_SECONDS = 3600
CONFLICT_AUTO_DISPUTE_SECONDS = 3600

# Fees and limits.
MAKER_FEE_PCT = 0.5
TAKER_FEE_PCT = 0.5
TAKER_FEE_LIMIT_FACTOR = 0.2
MIN_AMOUNT_SATS = 1000
MAX_AMOUNT_SATS = 250000
SUPPORTED_CURRENCIES = "PLN"
INVOICE_TOLERANCE_OVER_SATS = 10
INVOICE_TOLERANCE_UNDER_SATS = 100
RATE_VALIDITY_MINUTES = 5

# Report periods and listing sizes.
DAILY_WINDOW_DAYS = 29
LISTING_LIMIT = 50
REBROADCAST_HOURS = 12

# Order-feed event constants.
ORDER_EVENT_KIND = 38383
ORDER_TYPE = "sell"
PAYMENT_METHODS = ["BLIK"]
PLATFORM = "offerlake"            # deployment setting (platform tag)
NETWORK = "mainnet"
LAYER = "lightning"
DOCUMENT = "order"
BOND = "0"
PREMIUM = "0.0"
FRONTEND_DOMAIN = "offers.example"  # deployment setting (source link host)

# Weekday labels, ISO numbering (1 = Monday).
WEEKDAYS = [(1, "Mon"), (2, "Tue"), (3, "Wed"), (4, "Thu"), (5, "Fri"),
            (6, "Sat"), (7, "Sun")]

# Rate sources and the JSON path of the rate in each body.
RATE_SOURCES = [
    ("CoinGecko", "$.bitcoin.pln"),
    ("Yadio", "$.BTC"),
    ("Blockchain.info", "$.PLN.last"),
]

# Audit level inference: substrings (case-insensitive) of info messages.
SEVERE_WORDS = ["error", "exception", "failed", "critical"]
WARNING_WORDS = ["warning"]

# Audit action inference, rules applied in this order; first match wins.
ACTION_RULES = [
    (["status updated", "status:"], "offer.status_change"),
    (["maker "], "maker.action"),
    (["taker "], "taker.action"),
    (["timer", "timeout", "expired"], "timer.action"),
]
DEFAULT_ACTION = "system.event"

# uuid shapes: anywhere in a text (word bounded) and a whole string.
UUID_IN_TEXT = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
UUID_WHOLE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
UUID_WHOLE_CI = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

# Request methods and the parameters each one requires. A list of
# alternatives means "at least one of".
REQUEST_METHODS = {
    "get_info": [],
    "initiate_offer": ["fiat_amount"],
    "reserve_offer": ["offer_id"],
    "submit_blik": ["offer_id", "blik_code", ["taker_lightning_address", "taker_invoice"]],
    "get_blik": ["offer_id"],
    "confirm_payment": ["offer_id"],
    "get_my_active_offer": [],
    "get_my_finished_offers": [],
    "cancel_offer": ["offer_id"],
    "cancel_reservation": ["offer_id"],
    "mark_blik_invalid": ["offer_id"],
    "mark_blik_charged": ["offer_id"],
    "open_dispute": ["offer_id"],
    "update_taker_invoice": ["offer_id", "bolt11"],
    "retry_taker_payment": ["offer_id"],
    "get_successful_offers_stats": [],
}

# Wire invoice states of the first payment backend, and notification types of
# the second one, mapped to invoice status.
LND_INVOICE_STATES = {"OPEN": "OPEN", "SETTLED": "SETTLED", "CANCELED": "CANCELED",
                      "ACCEPTED": "ACCEPTED"}
NWC_NOTIFICATIONS = {"hold_invoice_accepted": "ACCEPTED",
                     "holdInvoiceSettled": "SETTLED",
                     "holdInvoiceCanceled": "CANCELED"}

# Error and result texts, as the original answers or stores them.
MESSAGES = {
    "rate_unavailable": "Failed to fetch BTC/PLN rate from all sources.",
    "rate_not_finite": "Unsupported operation: Infinity or NaN toInt",
    "invoice_amount_mismatch": "Invoice amount %d does not match expected amount %d sats",
    "zero_amount_invoice": "Amount must be provided for a zero-amount invoice.",
    "no_definitive_status": "Payment stream completed without definitive status, and tracking did not resolve it.",
    "invalid_request": "Missing method or id",
    "request_error_prefix": "Exception: Error processing request: Exception: ",
    "unknown_method": "Unknown method: ",
    "missing_param": "Missing required parameter: ",
    "missing_params": "Missing required parameters: ",
    "missing_params_submit_blik": "Missing required parameters: offer_id, blik_code, taker_lightning_address",
}
# Our own texts (no counterpart in the original).
MALFORMED_REQUEST = "Malformed request body"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

OFFER_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("amount_sats", T.LongType(), False),
    T.StructField("maker_fees", T.LongType(), False),
    T.StructField("taker_fees", T.LongType(), True),
    T.StructField("maker_pubkey", T.StringType(), False),
    T.StructField("taker_pubkey", T.StringType(), True),
    T.StructField("taker_lightning_address", T.StringType(), True),
    T.StructField("taker_invoice", T.StringType(), True),
    T.StructField("taker_invoice_fees", T.LongType(), True),
    T.StructField("hold_invoice_payment_hash", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("updated_at", T.TimestampNTZType(), True),
    T.StructField("reserved_at", T.TimestampNTZType(), True),
    T.StructField("blik_received_at", T.TimestampNTZType(), True),
    T.StructField("maker_confirmed_at", T.TimestampNTZType(), True),
    T.StructField("settled_at", T.TimestampNTZType(), True),
    T.StructField("taker_paid_at", T.TimestampNTZType(), True),
    T.StructField("fiat_amount", T.DecimalType(18, 2), True),
    T.StructField("fiat_currency", T.StringType(), True),
])
OFFER_COLUMNS = [f.name for f in OFFER_SCHEMA.fields]

# Columns of the stored table that never leave the reader.
OFFER_SECRET_COLUMNS = ["blik_code", "hold_invoice_preimage"]
# Columns missing from the older table shape; the reader adds them as NULL.
OFFER_LATE_COLUMNS = ["taker_invoice_fees", "fiat_amount", "fiat_currency"]

AUDIT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("offer_id", T.StringType(), True),
    T.StructField("action", T.StringType(), False),
    T.StructField("level", T.StringType(), False),
    T.StructField("logger_name", T.StringType(), False),
    T.StructField("message", T.StringType(), False),
    T.StructField("error", T.StringType(), True),
    T.StructField("stack_trace", T.StringType(), True),
    T.StructField("metadata", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), False),
])
AUDIT_COLUMNS = [f.name for f in AUDIT_SCHEMA.fields]

# Ten columns of the dashboard's offer listing.
LISTING_COLUMNS = ["id", "status", "amount_sats", "fiat_amount", "created_at",
                   "updated_at", "reserved_at", "maker_confirmed_at",
                   "settled_at", "taker_paid_at"]

# ---------------------------------------------------------------------------
# FIXED VALUES: the offer state machine
# ---------------------------------------------------------------------------
# action -> (who may do it, {from status: to status}). None as a from-status
# means "offer does not exist yet"; "*" means any status (no guard).
TRANSITIONS = {
    "fund": ("system", {None: "funded"}),
    "reserve": ("any", {"funded": "reserved", "invalidBlik": "reserved",
                        "expiredBlik": "reserved", "expiredSentBlik": "reserved"}),
    "submit_blik": ("taker", {"reserved": "blikReceived"}),
    "get_blik": ("maker", {"blikReceived": "blikSentToMaker", "blikSentToMaker": "blikSentToMaker"}),
    "mark_blik_invalid": ("maker", {"takerCharged": "conflict", "blikSentToMaker": "invalidBlik",
                                    "expiredSentBlik": "invalidBlik"}),
    "mark_blik_charged": ("taker", {"invalidBlik": "conflict", "expiredSentBlik": "takerCharged"}),
    "open_dispute": ("maker", {"conflict": "dispute"}),
    "confirm_payment": ("maker", {"conflict": "settled", "takerCharged": "settled",
                                  "blikSentToMaker": "settled", "expiredSentBlik": "settled"}),
    "cancel_reservation": ("taker", {"reserved": "funded", "expiredBlik": "funded", "invalidBlik": "funded"}),
    "cancel_offer": ("maker", {"funded": "cancelled"}),
    "pay_taker": ("system", {"settled": "takerPaid"}),
    "pay_taker_failed": ("system", {"settled": "takerPaymentFailed"}),
    "retry_taker_payment": ("taker", {"*": "takerPaid"}),
    "expire_funded": ("system", {"funded": "expired"}),
    "expire_reservation": ("system", {"reserved": "funded"}),
    "expire_blik": ("system", {"blikReceived": "expiredBlik", "blikSentToMaker": "expiredSentBlik"}),
    "auto_confirm": ("system", {"takerCharged": "settled"}),
    "auto_dispute": ("system", {"conflict": "dispute"}),
}
# Re-reserving from these statuses is only allowed for the same taker.
SAME_TAKER_RESERVE = ["invalidBlik", "expiredBlik"]
# Statuses whose write clears the taker-side fields.
CLEARING_STATUSES = ["funded", "expired", "cancelled"]
