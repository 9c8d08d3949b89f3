"""Order-feed and messaging projections and request validation.

Everything is a per-row projection (no shuffle): tag arrays are built with
``array`` + ``array_compact``, JSON bodies with ``to_json(struct)``; the
request rule table is a fixed 16-row literal joined by broadcast.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake import schema as S
from offerlake.functions import epoch_s, feed_status, plus_seconds


def feed_status_of(offers: DataFrame) -> DataFrame:
    return offers.select("id", "status", feed_status("status").alias("feed_status"))


def double_text(c: Column) -> Column:
    """How a double prints in the original runtime (shortest form, at least
    one decimal), computed from the exact DECIMAL value."""
    s = F.regexp_replace(c.cast("string"), "0+$", "")
    return F.when(s.endswith("."), F.concat(s, F.lit("0"))).otherwise(s)


def order_expiration(offers: DataFrame) -> DataFrame:
    """Funded offers expire created_at + 600 s (epoch seconds); others none."""
    return offers.select("id", _expiration().alias("expiration"))


def _expiration() -> Column:
    return F.when(F.col("status") == "funded",
                  epoch_s(plus_seconds("created_at", S.FUNDED_EXPIRY_SECONDS)))


def _tag(name: str, *values: Column) -> Column:
    return F.array(F.lit(name), *values)


def order_tags(expiration: Column | None = None) -> Column:
    """The tag list of an order event, in the fixed order; optional tags are
    NULL and removed by array_compact."""
    def text_or_empty(ts: str) -> Column:
        return F.coalesce(epoch_s(ts).cast("string"), F.lit(""))

    tags = [
        _tag("d", F.col("id")),
        _tag("k", F.lit(S.ORDER_TYPE)),
        _tag("f", F.col("fiat_currency")),
        _tag("s", feed_status("status")),
        _tag("amt", F.col("amount_sats").cast("string")),
        _tag("fa", double_text(F.col("fiat_amount"))),
        _tag("pm", *[F.lit(p) for p in S.PAYMENT_METHODS]),
        _tag("premium", F.lit(S.PREMIUM)),
        _tag("source", F.concat(F.lit(f"https://{S.FRONTEND_DOMAIN}/offers/"), F.col("id"))),
        _tag("network", F.lit(S.NETWORK)),
        _tag("layer", F.lit(S.LAYER)),
        _tag("name", F.lit("")),
        _tag("bond", F.lit(S.BOND)),
        (F.when(expiration.isNotNull(), _tag("expiration", expiration.cast("string")))
         if expiration is not None else F.lit(None).cast("array<string>")),
        _tag("y", F.lit(S.PLATFORM)),
        _tag("z", F.lit(S.DOCUMENT)),
        _tag("reserved_at", text_or_empty("reserved_at")),
        _tag("created_at", epoch_s("created_at").cast("string")),
        _tag("paid_at", text_or_empty("taker_paid_at")),
        F.when(F.col("taker_fees") > 0, _tag("taker_fees", F.col("taker_fees").cast("string"))),
        F.when(F.col("maker_fees") > 0, _tag("maker_fees", F.col("maker_fees").cast("string"))),
    ]
    return F.array_compact(F.array(*tags))


def order_events(offers: DataFrame, with_expiration: bool = False, as_json: bool = False) -> DataFrame:
    """Order events (kind 38383). ``as_json`` renders the tag list as the
    JSON text that goes on the wire."""
    exp = _expiration() if with_expiration else None
    tags = order_tags(exp)
    return offers.select("id", F.lit(S.ORDER_EVENT_KIND).alias("kind"),
                         (F.to_json(tags) if as_json else tags).alias("tags"))


def rebroadcast_orders(offers: DataFrame, as_of: datetime | str, hours: int = S.REBROADCAST_HOURS,
                       as_json: bool = False) -> DataFrame:
    from offerlake.operators.lookups import offers_last_hours
    return order_events(offers_last_hours(offers, as_of, hours), with_expiration=True, as_json=as_json)


def status_fanout(offers: DataFrame) -> DataFrame:
    """One status message to the maker and one to the taker (if any); the
    JSON body keeps NULL fields. The message time is the row's last change."""
    body = F.to_json(F.named_struct(
        F.lit("offer_id"), F.col("id"),
        F.lit("payment_hash"), F.col("hold_invoice_payment_hash"),
        F.lit("status"), F.col("status"),
        F.lit("created_at"), epoch_s("created_at"),
        F.lit("reserved_at"), epoch_s("reserved_at"),
        F.lit("timestamp"), epoch_s(F.coalesce("updated_at", "created_at")),
    ), {"ignoreNullFields": "false"})
    taker = F.when(F.col("taker_pubkey") != "", F.col("taker_pubkey"))
    recipients = F.array_compact(F.array(
        F.struct(F.lit("maker").alias("role"), F.col("maker_pubkey").alias("recipient")),
        F.when(taker.isNotNull(), F.struct(F.lit("taker").alias("role"), taker.alias("recipient")))))
    return (offers.select(F.col("id").alias("offer_id"), "status", body.alias("body"),
                          F.explode(recipients).alias("r"))
            .select("offer_id", "status", "r.role", "r.recipient", "body"))


# ---------------------------------------------------------------------------
# request validation
# ---------------------------------------------------------------------------
_PREFIX = S.MESSAGES["request_error_prefix"]


# Parameters that are read with a type, in the order in which they are read; all others are text as well.
_NUMBERS = {"fiat_amount"}
_OPTIONAL = {"initiate_offer": ["maker_id"]}
# Names of JSON values in the service's type errors, by the variant types' first word.
_TYPE_NAMES = {"STRING": "String", "BIGINT": "int", "DECIMAL": "double", "DOUBLE": "double", "FLOAT": "double", "BOOLEAN": "bool",
               "ARRAY": "List<dynamic>", "OBJECT": "_Map<String, dynamic>"}


def typed_params(method: str) -> list[tuple[str, str]]:
    """(parameter, type it is read as) of a method, in reading order."""
    names = [x for p in S.REQUEST_METHODS[method] for x in (p if isinstance(p, list) else [p])] + _OPTIONAL.get(method, [])
    return [(n, "num" if n in _NUMBERS else "String") for n in names]


def _rule_rows() -> list[tuple]:
    rows = []
    for method, req in S.REQUEST_METHODS.items():
        required = [p for p in req if isinstance(p, str)]
        any_of = next((p for p in req if isinstance(p, list)), [])
        if len(req) == 1:
            msg = S.MESSAGES["missing_param"] + required[0]
        elif method == "submit_blik":
            msg = S.MESSAGES["missing_params_submit_blik"]
        elif req:
            msg = S.MESSAGES["missing_params"] + ", ".join(required)
        else:
            msg = None
        rows.append((method, required, any_of, msg, typed_params(method)))
    return rows


def request_rules(spark: SparkSession) -> DataFrame:
    typed = T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())])
    schema = T.StructType([T.StructField("rule_method", T.StringType()),
                           T.StructField("required", T.ArrayType(T.StringType())),
                           T.StructField("any_of", T.ArrayType(T.StringType())),
                           T.StructField("missing_message", T.StringType()),
                           T.StructField("typed", T.ArrayType(typed))])
    return spark.createDataFrame(_rule_rows(), schema)


_REQ_SCHEMA = "struct<id:string,method:string,params:map<string,string>,_corrupt:string>"
_REQ_OPTS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


def _kind(value: Column) -> Column:
    """A JSON value's type name in the service's errors; NULL for null and for what is not there."""
    names = F.create_map(*[F.lit(x) for pair in _TYPE_NAMES.items() for x in pair])
    return F.element_at(names, F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))


def _fits(kind: Column, wanted: Column) -> Column:
    return kind.isNull() | F.when(wanted == "num", kind.isin("int", "double")).otherwise(kind == wanted)


def validate_requests(requests: DataFrame) -> DataFrame:
    """Parse each request body and route it, or produce the error the
    service would answer with. Malformed JSON is dropped without an answer
    (status 'dropped'), and so are a body that is no object, an id or method
    that is no text and params that are no object. Parameters have types: the
    first one of the wrong type, in reading order, is the error, before any
    missing one; JSON null counts as missing."""
    spark = requests.sparkSession
    # Malformed text lands in the corrupt-record field; the variant knows the values' types.
    parsed = requests.select("request_id", "sender", "ts", F.from_json(F.col("body"), _REQ_SCHEMA, _REQ_OPTS).alias("req"), F.try_parse_json("body").alias("v"))
    part = lambda path: F.try_variant_get("v", path, "variant")
    parsed = parsed.select("request_id", "sender", "ts", "req", F.col("v").isNull().alias("untyped"), _kind(F.col("v")).alias("k_body"), _kind(part("$.id")).alias("k_id"),
                           _kind(part("$.method")).alias("k_method"), _kind(part("$.params")).alias("k_params"),
                           F.transform_values(F.try_variant_get("v", "$.params", "map<string,variant>"), lambda _, x: _kind(x)).alias("kinds"))
    object_, text = "_Map<String, dynamic>", "String"
    shaped = (F.col("k_body") == object_) & (F.coalesce("k_id", F.lit(text)) == text) & (F.coalesce("k_method", F.lit(text)) == text) \
        & (F.coalesce("k_params", F.lit(object_)) == object_)
    # a body that the variant parser alone refuses (a key twice) is read as text, without types
    parsed = parsed.withColumn("valid_json", F.col("req").isNotNull() & F.col("req._corrupt").isNull() & (F.col("untyped") | F.coalesce(shaped, F.lit(False))))
    # Fixed 16-row rule table: size is a constant, broadcast is safe.
    joined = parsed.join(F.broadcast(request_rules(spark)),
                         F.col("req.method") == F.col("rule_method"), "left")
    params = F.coalesce(F.col("req.params"), F.create_map().cast("map<string,string>"))
    has_required = F.forall("required", lambda p: F.element_at(params, p).isNotNull())
    has_any = (F.size("any_of") == 0) | F.exists("any_of", lambda p: F.element_at(params, p).isNotNull())
    misfits = F.filter(F.transform("typed", lambda p: F.struct(p["type"].alias("type"), F.element_at("kinds", p["name"]).alias("kind"))),
                       lambda x: ~_fits(x["kind"], x["type"]))
    misfit = F.get(misfits, F.lit(0))
    mistyped = misfit.isNotNull()
    type_error = F.concat(F.lit(_PREFIX.removesuffix("Exception: ") + "type '"), misfit["kind"], F.lit("' is not a subtype of type '"), misfit["type"], F.lit("?' in type cast"))
    bad_json = ~F.col("valid_json")
    missing_id = F.col("req.id").isNull() | F.col("req.method").isNull()
    unknown = F.col("rule_method").isNull()
    missing = ~(has_required & has_any)
    status = (F.when(bad_json, "dropped").when(missing_id | unknown | mistyped | missing, "error").otherwise("routed"))
    code = (F.when(bad_json, "PARSE_ERROR").when(missing_id, "INVALID_REQUEST")
            .when(unknown | mistyped | missing, "INTERNAL_ERROR"))
    message = (F.when(bad_json, F.lit(S.MALFORMED_REQUEST))
               .when(missing_id, F.lit(S.MESSAGES["invalid_request"]))
               .when(unknown, F.concat(F.lit(_PREFIX + S.MESSAGES["unknown_method"]), F.col("req.method")))
               .when(mistyped, type_error)
               .when(missing, F.concat(F.lit(_PREFIX), F.col("missing_message"))))
    return joined.select(
        "request_id", "sender",
        F.when(~bad_json, F.col("req.id")).alias("id"),
        F.when(~bad_json, F.col("req.method")).alias("method"),
        status.alias("status"), code.alias("error_code"), message.alias("error_message"),
        F.when(~bad_json, F.col("req.params")["offer_id"]).alias("offer_id"),
        "ts")
