"""Audit-log enrichment: level, action and offer-id inference, id
normalisation and cleansing. Pure column expressions (regex, lower,
contains), so batch and streaming share them and they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake import schema as S


def _any_contains(text: Column, words: list[str]) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | text.contains(w)
    return cond


def infer_level(message: str | Column = "message", level: str | Column = "level") -> Column:
    """Explicit levels are kept; an info call (NULL level) becomes SEVERE /
    WARNING / INFO from words in the message (case-insensitive)."""
    msg = F.lower(F.col(message) if isinstance(message, str) else message)
    lvl = F.col(level) if isinstance(level, str) else level
    inferred = (F.when(_any_contains(msg, S.SEVERE_WORDS), "SEVERE")
                .when(_any_contains(msg, S.WARNING_WORDS), "WARNING")
                .otherwise("INFO"))
    return F.coalesce(lvl, inferred)


def infer_action_from_message(message: str | Column = "message") -> Column:
    msg = F.lower(F.col(message) if isinstance(message, str) else message)
    out = None
    for words, action in S.ACTION_RULES:
        cond = _any_contains(msg, words)
        out = F.when(cond, action) if out is None else out.when(cond, action)
    return out.otherwise(S.DEFAULT_ACTION)


def infer_action(action: str | Column = "action", message: str | Column = "message") -> Column:
    a = F.col(action) if isinstance(action, str) else action
    return F.when(a.isNull() | (a == S.DEFAULT_ACTION), infer_action_from_message(message)).otherwise(a)


def uuid_in_text(text: str | Column) -> Column:
    """First uuid-looking token in the text, NULL if none."""
    t = F.col(text) if isinstance(text, str) else text
    return F.nullif(F.regexp_extract(t, S.UUID_IN_TEXT, 0), F.lit(""))


def logger_normalize_offer_id(candidate: str | Column) -> Column:
    """Trimmed candidate if it *contains* a uuid, else NULL."""
    c = F.trim(F.col(candidate) if isinstance(candidate, str) else candidate)
    return F.when((c != "") & c.rlike(S.UUID_IN_TEXT), c)


def normalize_offer_id(candidate: str | Column) -> Column:
    """Storage rule: trimmed candidate if the whole string is a uuid."""
    c = F.trim(F.col(candidate) if isinstance(candidate, str) else candidate)
    return F.when((c != "") & c.rlike(S.UUID_WHOLE), c)


def infer_offer_id(offer_id: str | Column = "offer_id", message: str | Column = "message") -> Column:
    """Explicit id when it contains a uuid, else the first uuid of the
    message. An explicit id that merely *contains* a uuid wins here and is
    nulled later by `normalize_offer_id`; the message is then not used."""
    return F.coalesce(logger_normalize_offer_id(offer_id), uuid_in_text(message))


def cleanse_offer_id(offer_id: str | Column = "offer_id") -> Column:
    """Existing rows: a non-uuid offer_id becomes NULL (case-insensitive)."""
    c = F.col(offer_id) if isinstance(offer_id, str) else offer_id
    return F.when(c.isNull() | c.rlike(S.UUID_WHOLE_CI), c)


def cleanse_audit(audit: DataFrame) -> DataFrame:
    return audit.withColumn("offer_id", cleanse_offer_id("offer_id"))


def enrich_audit(records: DataFrame) -> DataFrame:
    """Raw logger records -> stored audit rows (schema.AUDIT_SCHEMA)."""
    return records.select(
        F.col("record_id").cast("bigint").alias("id"),
        normalize_offer_id(infer_offer_id("offer_id", "message")).alias("offer_id"),
        infer_action("action", "message").alias("action"),
        infer_level("message", "level").alias("level"),
        F.col("logger_name"),
        F.col("message"),
        F.col("error"),
        F.lit(None).cast("string").alias("stack_trace"),
        F.col("metadata"),
        F.col("ts").alias("created_at"),
    )
