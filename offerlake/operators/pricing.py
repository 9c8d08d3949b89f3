"""Rate parsing and averaging, the as-of rate join, quotes and fee checks.

The as-of join (`rate_at`) merges quotes and rounds in time order and carries
the last round along, range by range (`ordered.last_seen`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake import schema as S
from offerlake.functions import fee_ceil, micros_between
from offerlake.operators.ordered import last_seen

BUCKET_SECONDS = S.RATE_VALIDITY_MINUTES * 60
# Per source: the JSON path of the rate (schema.RATE_SOURCES) as a one-field
# schema; from_json with a DOUBLE leaf returns NULL for strings, booleans,
# objects and bad bodies, i.e. it keeps numbers only (the `is num` rule).
def _path_schema(path: str) -> tuple[str, tuple[str, ...]]:
    parts = tuple(path.removeprefix("$.").split("."))
    ddl = "DOUBLE"
    for name in reversed(parts[1:]):
        ddl = f"STRUCT<{name}: {ddl}>"
    return f"{parts[0]} {ddl}", parts


_RATE_SCHEMAS = {source: _path_schema(path) for source, path in S.RATE_SOURCES}
_JSON_OPTS = {"allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}


def _rate_value(source: str) -> Column:
    ddl, path = _RATE_SCHEMAS[source]
    node = F.from_json(F.col("body"), ddl, _JSON_OPTS)
    for p in path:
        node = node[p]
    return node


def parse_rates(payloads: DataFrame) -> DataFrame:
    """One rate per (round, source): the number at the source's JSON path;
    NULL for a non-200 answer, a bad body or a non-number. ``rate_strict``
    additionally requires a positive value (dashboard rule). Only the
    matching source's parser runs for a row (CASE branches are lazy)."""
    rate = F.lit(None).cast("double")
    for source, _ in reversed(S.RATE_SOURCES):
        rate = F.when(F.col("source") == source, _rate_value(source)).otherwise(rate)
    rate = F.when(F.col("http_status") == 200, rate)
    return payloads.select("round_id", "source", "fetched_at", rate.alias("rate"),
                           F.when(rate > 0, rate).alias("rate_strict"))


def average_rate(parsed: DataFrame, rate_col: str = "rate") -> DataFrame:
    """Mean of the valid rates of each fetch round; rounds without any valid
    rate give no row. Summed in DECIMAL so the mean does not depend on the
    order partial sums arrive in."""
    r = F.col(rate_col)
    exact = r.cast("decimal(24,8)")
    return (parsed.where(r.isNotNull())
            .groupBy("round_id")
            .agg(F.min("fetched_at").alias("fetched_at"),
                 (F.sum(exact).cast("double") / F.count(r)).alias("rate"),
                 F.count(r).alias("n_sources")))


def rate_at(quotes: DataFrame, rounds: DataFrame, ts_col: str = "ts", key: str = "quote_id") -> DataFrame:
    """For each quote: the newest averaged rate fetched at or before it.
    ``rate_status`` is 'fresh' (age < 5 full minutes), 'stale' (older, the
    last known rate) or 'error' (no rate yet, rate NULL).

    Quotes and rounds are merged, not joined: sorted by time and cut into
    ranges, each range carries its last round along, and the last round of
    every range is handed to the ranges after it (`ordered.last_seen`). The work
    is linear in the rows, however many share a minute. A quote without a time
    has no rate ('error'), a round without one serves nobody."""
    rounded = rounds.where(F.col("fetched_at").isNotNull()).select(
        F.col("fetched_at").alias("_t"), F.lit(0).alias("_side"), F.col("round_id").alias("_tie"), F.struct("fetched_at", "round_id", "rate").alias("_round"))
    asked = quotes.select(F.col(ts_col).alias("_t"), F.lit(1).alias("_side"), F.xxhash64(key).alias("_tie"), F.struct(*quotes.columns).alias("_q"))
    both = rounded.unionByName(asked.where(F.col("_t").isNotNull()), allowMissingColumns=True)
    # at equal times a round comes before the quotes it serves
    seen = last_seen(both, ["_t", "_side", "_tie"], "_round", "_r").where(F.col("_q").isNotNull()).select("_q", "_r")
    timeless = asked.where(F.col("_t").isNull()).select("_q")
    out = seen.unionByName(timeless, allowMissingColumns=True).select("_q.*", "_r")
    age_us = micros_between(F.col("_r.fetched_at"), F.col(ts_col))
    status = (F.when(F.col("_r").isNull(), "error")
              .when(age_us < BUCKET_SECONDS * 1_000_000, "fresh").otherwise("stale"))
    return (out.select(*[c for c in quotes.columns],
                       F.col("_r.rate").alias("rate"), F.col("_r.round_id").alias("rate_round_id"),
                       F.col("_r.fetched_at").alias("rate_fetched_at"), status.alias("rate_status")))


def quote_offer(priced: DataFrame, maker_pct: float = S.MAKER_FEE_PCT,
                taker_pct: float = S.TAKER_FEE_PCT) -> DataFrame:
    """sats = round(fiat x (1 / rate) x 1e8); fees = ceil(sats x pct / 100);
    total = sats + maker fees. Rows without a rate carry the error text."""
    ok = F.col("rate").isNotNull() & (F.col("rate") > 0)
    btc = F.col("fiat_amount") * (F.lit(1.0) / F.when(ok, F.col("rate")))
    sats = F.round(btc * F.lit(100000000.0), 0).cast("bigint")
    return priced.select(
        "*",
        F.when(ok, sats).alias("amount_sats"),
        F.when(ok, fee_ceil(sats, maker_pct)).alias("maker_fees"),
        F.when(ok, fee_ceil(sats, taker_pct)).alias("taker_fees"),
        F.when(ok, sats + fee_ceil(sats, maker_pct)).alias("total_amount_sats"),
        F.when(F.col("rate").isNull(), F.lit(S.MESSAGES["rate_unavailable"]))
        .when(~ok, F.lit(S.MESSAGES["rate_not_finite"])).alias("error"),
    )


def taker_net_amount(offers: DataFrame, pct: float = S.TAKER_FEE_PCT) -> DataFrame:
    """Net amount for the taker's invoice: at BLIK submission the stored
    taker fee is used (recomputed when missing); at payment it is always
    recomputed from today's percentage."""
    amt = F.col("amount_sats")
    return offers.select(
        "id", "amount_sats", "taker_fees",
        (amt - F.coalesce(F.col("taker_fees"), fee_ceil(amt, pct))).alias("net_at_submit"),
        (amt - fee_ceil(amt, pct)).alias("net_at_payment"))


def invoice_tolerance(invoice_amount: Column, net: Column) -> Column:
    """Verdict for a taker-supplied invoice against the expected net amount."""
    return (F.when(invoice_amount > net + S.INVOICE_TOLERANCE_OVER_SATS, "too_large")
            .when(invoice_amount < net - S.INVOICE_TOLERANCE_UNDER_SATS, "too_small")
            .otherwise("ok"))


def check_invoice_tolerance(submissions: DataFrame, offers: DataFrame) -> DataFrame:
    """BLIK submissions that carry an invoice, checked against the offer."""
    net = taker_net_amount(offers).select(F.col("id").alias("offer_id"), "net_at_submit")
    subs = submissions.where(F.col("invoice_amount_sats").isNotNull())
    return (subs.join(net, "offer_id")
            .select("offer_id", "seq", "invoice_amount_sats", "net_at_submit",
                    invoice_tolerance(F.col("invoice_amount_sats"), F.col("net_at_submit")).alias("verdict")))


def invoice_amount_match(invoice_amount: Column, expected: Column) -> Column:
    """Payment-time check of a decoded invoice amount; NULL means OK."""
    return (F.when((invoice_amount != 0) & (invoice_amount != expected),
                   F.format_string(S.MESSAGES["invoice_amount_mismatch"], invoice_amount, expected))
            .when((invoice_amount == 0) & (expected.isNull() | (expected <= 0)),
                  F.lit(S.MESSAGES["zero_amount_invoice"])))


def fee_limit(offers: DataFrame, factor: float = S.TAKER_FEE_LIMIT_FACTOR) -> DataFrame:
    """Routing-fee limit ceil(taker_fees x 0.2) against the fee actually paid."""
    limit = F.ceil(F.col("taker_fees").cast("double") * F.lit(factor)).cast("bigint")
    return offers.where(F.col("status") == S.SUCCESS_STATUS).select(
        "id", "taker_fees", limit.alias("fee_limit_sat"), F.col("taker_invoice_fees").alias("paid_fee_sat"),
        (F.col("taker_invoice_fees") <= limit).alias("within_limit"))


def sendable_range(offers: DataFrame, addresses: DataFrame, pct: float = S.TAKER_FEE_PCT) -> DataFrame:
    """Can the net amount be paid to the taker's lightning address? Uses the
    resolved address table; reasons follow the resolution order."""
    a = addresses.select(F.col("lightning_address").alias("taker_lightning_address"),
                         "tag", F.col("status").alias("addr_status"), "callback", "min_sendable", "max_sendable")
    o = offers.where(F.col("taker_lightning_address").isNotNull()).select(
        "id", "taker_lightning_address", "amount_sats")
    msat = (F.col("amount_sats") - fee_ceil("amount_sats", pct)) * 1000
    reason = (F.when(~F.col("taker_lightning_address").contains("@"), "not_an_address")
              .when(F.col("tag").isNull(), "unresolved")
              .when(F.col("addr_status") == "ERROR", "error_status")
              .when(F.col("tag") != "payRequest", "invalid_tag")
              .when(F.col("callback").isNull() | F.col("min_sendable").isNull() | F.col("max_sendable").isNull(),
                    "missing_fields")
              .when((msat < F.col("min_sendable")) | (msat > F.col("max_sendable")), "out_of_range")
              .otherwise("ok"))
    return o.join(a, "taker_lightning_address", "left").select(
        "id", "taker_lightning_address", msat.alias("amount_msat"), reason.alias("reason"))


def amount_limit_check(offers: DataFrame, min_sats: int = S.MIN_AMOUNT_SATS, max_sats: int = S.MAX_AMOUNT_SATS,
                       currencies: str = S.SUPPORTED_CURRENCIES) -> DataFrame:
    """Data-quality report: offers outside the advertised amount range or
    currency list (advertised, not enforced, by the service)."""
    supported = F.transform(F.split(F.lit(currencies), ","), lambda c: F.upper(F.trim(c)))
    amt = F.col("amount_sats")
    reason = (F.when(amt < min_sats, "below_min").when(amt > max_sats, "above_max")
              .when(~F.array_contains(supported, F.upper(F.col("fiat_currency"))), "unsupported_currency"))
    return offers.select("id", "amount_sats", "fiat_currency", reason.alias("reason")).where(F.col("reason").isNotNull())


def latest_rate(rounds: DataFrame) -> DataFrame:
    """One-row DataFrame: the newest averaged rate."""
    return rounds.agg(F.max_by(F.col("rate"), F.struct("fetched_at", "round_id")).alias("rate"))
