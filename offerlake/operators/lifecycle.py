"""The offer state machine as data work: sweeps, deadlines, reverts, status
history, update application, action validation and replay.

The transition rule comes from ``schema.TRANSITIONS`` in three encodings:
- a generated SQL CASE, parameterised by column references, used for
  `validate_actions` and the DuckDB oracle;
- `decide`, its Python twin, used by the streamed fold for very long action
  logs;
- a constant decision table built from `decide`, used by the JVM fold in
  `replay_steps`.
A test evaluates the CASE over every input combination and compares it with
`decide`.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake import schema as S
from offerlake.functions import micros_between, plus_seconds, ts_lit
from offerlake.operators.ordered import neighbors

# ---------------------------------------------------------------------------
# transition rule as SQL text
# ---------------------------------------------------------------------------


def _in(ref: str, values) -> str:
    return f"{ref} IN ({', '.join(repr(v) for v in values)})"


def decide_reason_sql(r: dict[str, str]) -> str:
    """Rejection reason (NULL = accepted). ``r`` maps action, status, actor,
    maker, taker, has_blik, has_invoice, verdict to SQL references."""
    is_maker = f"coalesce({r['maker']} = {r['actor']}, false)"
    is_taker = f"coalesce({r['taker']} = {r['actor']}, false)"
    parts = [f"WHEN NOT {_in(r['action'], S.TRANSITIONS)} THEN 'unknown_action'",
             f"WHEN {r['action']} = 'fund' THEN CASE WHEN {r['status']} IS NULL THEN NULL ELSE 'already_exists' END",
             f"WHEN {r['status']} IS NULL THEN 'not_found'"]
    for action, (role, moves) in S.TRANSITIONS.items():
        if action == "fund":
            continue
        froms = [f for f in moves if f is not None]
        state_bad = "false" if froms == ["*"] else f"NOT {_in(r['status'], froms)}"
        actor_bad = {"maker": f"NOT {is_maker}", "taker": f"NOT {is_taker}",
                     "system": f"{r['actor']} <> 'system'", "any": "false"}[role]
        checks = []
        if action == "reserve":
            checks.append((state_bad, "wrong_state"))
            checks.append((f"{_in(r['status'], S.SAME_TAKER_RESERVE)} AND NOT {is_taker}", "wrong_actor"))
        else:
            checks.append((actor_bad, "wrong_actor"))
            checks.append((state_bad, "wrong_state"))
        if action == "get_blik":
            checks.append((f"NOT {r['has_blik']}", "missing_blik_code"))
        if action == "retry_taker_payment":
            checks.append((f"NOT {r['has_invoice']}", "no_invoice"))
        if action == "submit_blik":
            checks.append((f"coalesce({r['verdict']}, 'ok') = 'too_large'", "invoice_too_large"))
            checks.append((f"coalesce({r['verdict']}, 'ok') = 'too_small'", "invoice_too_small"))
        inner = " ".join(f"WHEN {c} THEN '{why}'" for c, why in checks)
        parts.append(f"WHEN {r['action']} = '{action}' THEN CASE {inner} ELSE NULL END")
    return "CASE " + " ".join(parts) + " END"


def decide_status_sql(r: dict[str, str], reason_sql: str) -> str:
    """New status if accepted, else the current one."""
    whens = []
    for action, (_, moves) in S.TRANSITIONS.items():
        for f, t in moves.items():
            if f is None or f == "*":
                whens.append(f"WHEN {r['action']} = '{action}' THEN '{t}'")
            else:
                whens.append(f"WHEN {r['action']} = '{action}' AND {r['status']} = '{f}' THEN '{t}'")
    return f"CASE WHEN ({reason_sql}) IS NULL THEN CASE {' '.join(whens)} END ELSE {r['status']} END"


def decide_warning_sql(r: dict[str, str], reason_sql: str) -> str:
    """The retry action has no status guard; a retry on a paid offer is
    accepted and flagged."""
    return (f"CASE WHEN {r['action']} = 'retry_taker_payment' AND {r['status']} = 'takerPaid' "
            f"AND ({reason_sql}) IS NULL THEN 'retry_on_paid' END")


# ---------------------------------------------------------------------------
# sweeps and deadlines
# ---------------------------------------------------------------------------
RULES = {
    # rule: (statuses, due time, new status per status)
    "funded_expiry": (["funded"], lambda: plus_seconds("created_at", S.FUNDED_EXPIRY_SECONDS),
                      {"funded": "expired"}),
    "reservation": (["reserved"], lambda: plus_seconds("reserved_at", S.RESERVATION_SECONDS),
                    {"reserved": "funded"}),
    "blik_confirmation": (["blikReceived", "blikSentToMaker"],
                          lambda: plus_seconds("blik_received_at", S.BLIK_CONFIRMATION_SECONDS),
                          {"blikReceived": "expiredBlik", "blikSentToMaker": "expiredSentBlik"}),
    "taker_charged": (["takerCharged"], lambda: plus_seconds("created_at", S.TAKER_CHARGED_AUTO_CONFIRM_SECONDS),
                      {"takerCharged": "settled"}),
    "conflict": (["conflict"], lambda: plus_seconds(F.coalesce("updated_at", "created_at"),
                                                    S.CONFLICT_AUTO_DISPUTE_SECONDS),
                 {"conflict": "dispute"}),
}
SWEEP_ORDER = ["funded_expiry", "reservation", "blik_confirmation", "taker_charged", "conflict"]


def _rule_frame(offers: DataFrame, rule: str) -> tuple[DataFrame, Column, Column]:
    statuses, due, moves = RULES[rule]
    st = F.col("status")
    new = None
    for f, t in moves.items():
        new = F.when(st == f, t) if new is None else new.when(st == f, t)
    return offers.where(st.isin(statuses)), due(), new


def sweep(offers: DataFrame, rule: str, as_of: datetime | str) -> DataFrame:
    """Rows a start-up sweep acts on: past the deadline (strictly after), or
    missing the timestamp the deadline is measured from."""
    df, due, new = _rule_frame(offers, rule)
    acted = due.isNull() | (ts_lit(as_of) > due)
    return df.where(acted).select("id", "status", new.alias("new_status"), due.alias("due_at"))


def deadlines(offers: DataFrame, as_of: datetime | str) -> DataFrame:
    """Due time and remaining whole seconds (negative when overdue) for every
    offer waiting on one of the five timed rules. One pass over the offers:
    the rule, due time and timeout status are CASE expressions on status."""
    st = F.col("status")
    rule = due = new = None
    for name in SWEEP_ORDER:
        statuses, due_fn, moves = RULES[name]
        hit = st.isin(statuses)
        rule = F.when(hit, F.lit(name)) if rule is None else rule.when(hit, F.lit(name))
        due = F.when(hit, due_fn()) if due is None else due.when(hit, due_fn())
        for f, t in moves.items():
            new = F.when(st == f, F.lit(t)) if new is None else new.when(st == f, F.lit(t))
    timed = [s_ for n in SWEEP_ORDER for s_ in RULES[n][0]]
    out = offers.where(st.isin(timed)).select("id", "status", rule.alias("rule"), due.alias("due_at"),
                                              new.alias("timeout_status"))
    rem_us = micros_between(ts_lit(as_of), F.col("due_at"))
    return out.select("*", F.when(rem_us.isNotNull(), (rem_us / 1_000_000).cast("bigint")).alias("remaining_seconds"),
                      (F.col("due_at").isNull() | (ts_lit(as_of) > F.col("due_at"))).alias("overdue"))


def _clear_taker_fields(cond: Column) -> dict[str, Column]:
    cleared = ["taker_pubkey", "reserved_at", "taker_lightning_address", "taker_invoice",
               "taker_invoice_fees", "blik_received_at"]
    return {c: F.when(cond, F.lit(None)).otherwise(F.col(c)).cast(S.OFFER_SCHEMA[c].dataType).alias(c)
            for c in cleared}


def startup_sweep(offers: DataFrame, as_of: datetime | str) -> DataFrame:
    """The start-up job: the five sweeps in order, applied to a snapshot.

    The sweeps read disjoint statuses, so one pass decides every row; the
    new snapshot keeps all columns with the field effects of each new
    status (clearing for funded/expired, confirm + settle times for the
    auto-confirm)."""
    now = ts_lit(as_of)
    new = None
    for rule in SWEEP_ORDER:
        statuses, due, moves = RULES[rule]
        acted = F.col("status").isin(statuses) & (due().isNull() | (now > due()))
        for f, t in moves.items():
            c = acted & (F.col("status") == f)
            new = F.when(c, t) if new is None else new.when(c, t)
    df = offers.withColumn("_new", new)
    changed = F.col("_new").isNotNull()
    clears = F.col("_new").isin(S.CLEARING_STATUSES)
    settled = F.col("_new") == "settled"
    cleared = _clear_taker_fields(clears)
    cols = []
    for c in S.OFFER_COLUMNS:
        if c == "status":
            cols.append(F.coalesce("_new", "status").alias(c))
        elif c == "updated_at":
            cols.append(F.when(changed, now).otherwise(F.col(c)).alias(c))
        elif c in ("maker_confirmed_at", "settled_at"):
            cols.append(F.when(settled, now).otherwise(F.col(c)).alias(c))
        elif c in cleared:
            cols.append(cleared[c])
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def revert_to_funded(offers: DataFrame, as_of: datetime | str) -> DataFrame:
    """reserved / expiredBlik / invalidBlik -> funded: taker fields cleared,
    the funded deadline counted again from the original created_at."""
    src = offers.where(F.col("status").isin("reserved", "expiredBlik", "invalidBlik"))
    due = plus_seconds("created_at", S.FUNDED_EXPIRY_SECONDS)
    return src.select(
        "id", F.col("status").alias("old_status"), F.lit("funded").alias("status"),
        F.lit(None).cast("string").alias("taker_pubkey"), F.lit(None).cast("timestamp_ntz").alias("reserved_at"),
        F.lit(None).cast("string").alias("taker_lightning_address"),
        F.lit(None).cast("timestamp_ntz").alias("blik_received_at"),
        ts_lit(as_of).alias("updated_at"), due.alias("funded_expires_at"),
        (ts_lit(as_of) > due).alias("expires_immediately"))


# ---------------------------------------------------------------------------
# event application
# ---------------------------------------------------------------------------
def status_history(events: DataFrame) -> DataFrame:
    """Per status event: the previous status, seconds spent in this status
    (until the next event) and whether it is the current one."""
    nb = neighbors(events.select("offer_id", "seq", "status", "ts"), "offer_id", "seq", ["status", "ts"])
    return nb.select(
        "offer_id", "seq", "status", "ts",
        F.col("prev.status").alias("prev_status"),
        (micros_between(F.col("ts"), F.col("next.ts")) / 1_000_000).cast("bigint").alias("seconds_in_status"),
        F.col("next").isNull().alias("is_current"))


# Which statuses write which offer field, and with what value (event column).
_FIELD_WRITES = {
    "taker_pubkey": [(["reserved"], "taker_pubkey")],
    "reserved_at": [(["reserved"], "ts")],
    "blik_received_at": [(["blikReceived"], "ts")],
    "taker_lightning_address": [(["blikReceived"], "address")],
    "maker_confirmed_at": [(["makerConfirmed"], "ts")],
    "settled_at": [(["settled"], "ts")],
    "taker_paid_at": [(["takerPaid"], "ts")],
    "taker_fees": [(["takerPaid"], "taker_fees")],
    "taker_invoice": [],
    "taker_invoice_fees": [],
}
_CLEARED = {"taker_pubkey", "reserved_at", "blik_received_at", "taker_lightning_address",
            "taker_invoice", "taker_invoice_fees"}


def status_update_aggregates(events: DataFrame) -> DataFrame:
    """Per offer: the last event (status, ts) and, for every field, the value
    written by the last event that touches it (set or clear). Events
    missing a required value (reserved without taker) are rejected as in
    the original. Plain aggregates, so the same expression runs as a
    streaming aggregation."""
    valid = events.where(~((F.col("status") == "reserved") & F.col("taker_pubkey").isNull())
                         & F.col("ts").isNotNull())
    st = F.col("status")
    aggs = [F.max_by(F.struct("status", "ts"), "seq").alias("_last")]
    for field, writes in _FIELD_WRITES.items():
        value = None
        touch = F.lit(False)
        for statuses, src in writes:
            cond = st.isin(statuses)
            touch = touch | cond
            value = F.when(cond, F.col(src)) if value is None else value.when(cond, F.col(src))
        if field in _CLEARED:
            clear = st.isin(S.CLEARING_STATUSES)
            touch = touch | clear
        v = (value if value is not None else F.lit(None)).cast(S.OFFER_SCHEMA[field].dataType)
        aggs.append(F.max_by(F.struct(v.alias("v")), F.when(touch, F.col("seq"))).alias(f"_{field}"))
    return valid.groupBy(F.col("offer_id").alias("id")).agg(*aggs)


def merge_status_updates(offers: DataFrame, upd: DataFrame) -> DataFrame:
    """Current rows with the aggregated updates applied; untouched fields
    keep their value."""
    joined = offers.join(upd, "id", "left")
    cols = []
    for c in S.OFFER_COLUMNS:
        if c == "status":
            cols.append(F.coalesce(F.col("_last.status"), F.col("status")).alias(c))
        elif c == "updated_at":
            cols.append(F.when(F.col("_last").isNotNull(), F.col("_last.ts")).otherwise(F.col(c)).alias(c))
        elif c in _FIELD_WRITES:
            cols.append(F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return joined.select(*cols)


def apply_status_updates(offers: DataFrame, events: DataFrame) -> DataFrame:
    """Apply ordered status events to the current rows.

    Applying a chain of updates field by field equals taking, for every
    field, the value written by the *last* event that touches it; that is a
    set of max_by aggregates per offer - partial aggregation, no per-offer
    list - followed by one join."""
    return merge_status_updates(offers, status_update_aggregates(events))


def apply_invoice_updates(offers: DataFrame, updates: DataFrame) -> DataFrame:
    """Set taker_invoice / taker_invoice_fees from the latest update per
    offer (``updates``: offer_id, taker_invoice?, taker_invoice_fees?, ts);
    each write also sets updated_at."""
    latest = updates.groupBy(F.col("offer_id").alias("id")).agg(
        F.max_by(F.struct("taker_invoice", "ts"), F.when(F.col("taker_invoice").isNotNull(), F.col("ts"))).alias("_inv"),
        F.max_by(F.struct("taker_invoice_fees", "ts"),
                 F.when(F.col("taker_invoice_fees").isNotNull(), F.col("ts"))).alias("_fee"))
    j = offers.join(latest, "id", "left")
    cols = []
    for c in S.OFFER_COLUMNS:
        if c == "taker_invoice":
            cols.append(F.coalesce(F.col("_inv.taker_invoice"), F.col(c)).alias(c))
        elif c == "taker_invoice_fees":
            cols.append(F.coalesce(F.col("_fee.taker_invoice_fees"), F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.coalesce(F.greatest(F.col("_inv.ts"), F.col("_fee.ts")), F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def apply_cancellations(offers: DataFrame, cancels: DataFrame, as_of: datetime | str) -> DataFrame:
    """Conditional update: an offer is cancelled when some cancel request
    names it, comes from its maker and the offer is funded; the seven
    taker-side fields are cleared. Other rows are unchanged."""
    asked = cancels.select(F.col("offer_id").alias("_offer"), F.col("actor").alias("_by")).distinct()
    j = offers.join(asked, (F.col("id") == F.col("_offer")) & (F.col("maker_pubkey") == F.col("_by")), "left")
    hit = F.col("_by").isNotNull() & (F.col("status") == "funded")
    cleared = {c: F.when(hit, F.lit(None)).otherwise(F.col(c)).cast(S.OFFER_SCHEMA[c].dataType).alias(c)
               for c in _CLEARED}
    cols = []
    for c in S.OFFER_COLUMNS:
        if c == "status":
            cols.append(F.when(hit, F.lit("cancelled")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(hit, ts_lit(as_of)).otherwise(F.col(c)).alias(c))
        elif c in cleared:
            cols.append(cleared[c])
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def apply_invoice_change(offers: DataFrame, changes: DataFrame) -> DataFrame:
    """A taker replaces the invoice of their own offer (``changes``:
    offer_id, sender, bolt11, ts). Only the sender equal to the offer's
    taker counts; the latest such change wins and sets updated_at."""
    latest = changes.groupBy(F.col("offer_id").alias("_offer"), F.col("sender").alias("_by")).agg(
        F.max_by(F.struct("bolt11", "ts"), F.struct("ts", "bolt11")).alias("_chg"))
    j = offers.join(latest, (F.col("id") == F.col("_offer")) & (F.col("taker_pubkey") == F.col("_by")), "left")
    cols = []
    for c in S.OFFER_COLUMNS:
        if c == "taker_invoice":
            cols.append(F.coalesce(F.col("_chg.bolt11"), F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.coalesce(F.col("_chg.ts"), F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


# ---------------------------------------------------------------------------
# actions
# ---------------------------------------------------------------------------
def _verdict(net: Column) -> Column:
    from offerlake.operators.pricing import invoice_tolerance
    return F.when(F.col("invoice_amount_sats").isNotNull(), invoice_tolerance(F.col("invoice_amount_sats"), net))


def _net_at_submit() -> Column:
    from offerlake.functions import fee_ceil
    amt = F.col("amount_sats")
    return amt - F.coalesce(F.col("taker_fees"), fee_ceil(amt, S.TAKER_FEE_PCT))


VALIDATE_REFS = {"action": "action", "status": "cur_status", "actor": "actor", "maker": "maker_pubkey",
                 "taker": "taker_pubkey", "has_blik": "(blik_received_at IS NOT NULL)",
                 "has_invoice": "(taker_invoice IS NOT NULL)", "verdict": "verdict"}


def validate_actions(actions: DataFrame, offers: DataFrame) -> DataFrame:
    """Each requested action against the offer's current row: accepted or
    the reason (not_found, wrong_actor, wrong_state, ...), plus the status
    it would move to."""
    # One join with the current rows brings both the state and the amounts.
    cur = offers.select(F.col("id").alias("offer_id"), F.col("status").alias("cur_status"), "maker_pubkey",
                        "taker_pubkey", "blik_received_at", "taker_invoice", "amount_sats", "taker_fees")
    j = actions.join(cur, "offer_id", "left").withColumn("verdict", _verdict(_net_at_submit()))
    reason = decide_reason_sql(VALIDATE_REFS)
    return j.select(
        "offer_id", "seq", "action", "actor", F.col("cur_status").alias("status"),
        F.expr(f"({reason}) IS NULL").alias("accepted"),
        F.expr(reason).alias("reason"),
        F.expr(decide_status_sql(VALIDATE_REFS, reason)).alias("new_status"),
        F.expr(decide_warning_sql(VALIDATE_REFS, reason)).alias("warning"))


REPLAY_REFS = {"action": "x.action", "status": "acc.status", "actor": "x.actor", "maker": "x.maker",
               "taker": "acc.taker", "has_blik": "acc.has_blik", "has_invoice": "acc.has_invoice",
               "verdict": "x.verdict"}

STEP_SCHEMA = ("offer_id STRING, seq INT, action STRING, actor STRING, status_before STRING, "
               "status_after STRING, accepted BOOLEAN, reason STRING, warning STRING, taker_after STRING")


def decide(action, status, actor, maker, taker, has_blik, has_invoice, verdict):
    """Python twin of the generated SQL rule (used for offers whose action
    log is too long for one in-row fold). Returns (reason, new_status,
    warning)."""
    if action not in S.TRANSITIONS:
        return "unknown_action", status, None
    if action == "fund":
        return (None, "funded", None) if status is None else ("already_exists", status, None)
    if status is None:
        return "not_found", status, None
    role, moves = S.TRANSITIONS[action]
    froms = [f for f in moves if f is not None]
    state_bad = False if froms == ["*"] else status not in froms
    is_maker = maker is not None and actor is not None and maker == actor
    is_taker = taker is not None and actor is not None and taker == actor
    actor_bad = {"maker": not is_maker, "taker": not is_taker,
                 "system": actor is not None and actor != "system", "any": False}[role]
    if action == "reserve":
        checks = [(state_bad, "wrong_state"), (status in S.SAME_TAKER_RESERVE and not is_taker, "wrong_actor")]
    else:
        checks = [(actor_bad, "wrong_actor"), (state_bad, "wrong_state")]
    if action == "get_blik":
        checks.append((not has_blik, "missing_blik_code"))
    if action == "retry_taker_payment":
        checks.append((not has_invoice, "no_invoice"))
    if action == "submit_blik":
        checks.append(((verdict or "ok") == "too_large", "invoice_too_large"))
        checks.append(((verdict or "ok") == "too_small", "invoice_too_small"))
    reason = next((why for bad, why in checks if bad), None)
    if reason is not None:
        return reason, status, None
    new = moves.get(status, moves.get("*"))
    warning = "retry_on_paid" if action == "retry_taker_payment" and status == "takerPaid" else None
    return None, new, warning


def _fold_sorted_batches(batches):
    """mapInPandas body: rows arrive sorted by (offer_id, seq); the state of
    the current offer is carried across Arrow batches, nothing is buffered."""
    import pandas as pd
    cur = None
    status = taker = None
    has_blik = has_inv = False
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if r.offer_id != cur:
                cur, status, taker, has_blik, has_inv = r.offer_id, None, None, False, False
            reason, new, warn = decide(r.action, status, r.actor, r.maker, taker, has_blik, has_inv,
                                       r.verdict if isinstance(r.verdict, str) else None)
            ok = reason is None
            before = status
            if ok:
                clears = new in S.CLEARING_STATUSES
                if r.action == "reserve":
                    taker = r.actor
                elif clears:
                    taker = None
                if r.action == "submit_blik":
                    has_blik = has_inv = True
                elif clears:
                    has_blik = has_inv = False
                status = new
            out.append((r.offer_id, int(r.seq), r.action, r.actor, before, status, ok, reason, warn, taker))
        yield pd.DataFrame(out, columns=["offer_id", "seq", "action", "actor", "status_before", "status_after",
                                         "accepted", "reason", "warning", "taker_after"])


# Decision table for the in-JVM fold: every combination of (action, status,
# actor is maker, actor is taker, actor is "system", per-action flag) maps to
# one packed int (reason id, new status id, warning bit), built once from
# `decide` so the fold does an array lookup instead of interpreting a CASE.
ACTIONS = list(S.TRANSITIONS)
STATUS_CODES = S.STATUSES + [None]          # index 18 = "no offer"
REASONS = [None, "unknown_action", "already_exists", "not_found", "wrong_state", "wrong_actor",
           "missing_blik_code", "no_invoice", "invoice_too_large", "invoice_too_small"]
VERDICTS = [None, "too_large", "too_small"]
_NA, _NS = len(ACTIONS) + 1, len(STATUS_CODES)


def _lut_index(a: int, s: int, m: int, t: int, sysf: int, f: int) -> int:
    return ((((a * _NS + s) * 2 + m) * 2 + t) * 2 + sysf) * 3 + f


def decision_table() -> list[int]:
    out = [0] * (_NA * _NS * 2 * 2 * 2 * 3)
    for a in range(_NA):
        action = ACTIONS[a] if a < len(ACTIONS) else "__unknown__"
        for si, status in enumerate(STATUS_CODES):
            for m in (0, 1):
                for t in (0, 1):
                    for sysf in (0, 1):
                        for f in (0, 1, 2):
                            actor = "system" if sysf else "someone"
                            maker = actor if m else "other-maker"
                            taker = actor if t else "other-taker"
                            reason, new, warn = decide(action, status, actor, maker, taker,
                                                       f == 1, f == 1, VERDICTS[f] if f else None)
                            out[_lut_index(a, si, m, t, sysf, f)] = (
                                REASONS.index(reason) * 64 + STATUS_CODES.index(new) * 2 + (1 if warn else 0))
    return out


def _code(col: Column, values: list) -> Column:
    """Index of col in ``values`` (last index + 1 when absent / NULL)."""
    m = F.create_map(*[F.lit(x) for i, v in enumerate(values) if v is not None for x in (v, i)])
    return F.coalesce(m[col], F.lit(len(values) if None not in values else values.index(None)))


MAX_BROADCAST_HOT = 100_000  # hot offer ids broadcast at most (a few MB)


def replay_steps(actions: DataFrame, offers: DataFrame, hot_threshold: int = 1000) -> DataFrame:
    """Replay every offer's action log in seq order from "no offer" and
    return one decision row per action (status before / after, accepted or
    the reason, warning, taker after).

    Offers with at most ``hot_threshold`` actions (nearly all) fold inside
    the JVM: higher-order ``aggregate`` over the offer's sorted action list,
    each step one lookup in the constant decision table. Longer logs are
    never collected: their rows are sorted by (offer, seq) and folded by
    ``mapInPandas`` with the state carried in a few variables, so memory
    stays bounded however hot the offer is."""
    makers = offers.select(F.col("id").alias("offer_id"), F.col("maker_pubkey").alias("maker"),
                           "amount_sats", "taker_fees")
    acts = (actions.join(makers, "offer_id", "left").withColumn("verdict", _verdict(_net_at_submit()))
            .select("offer_id", F.col("seq").cast("int").alias("seq"), "action", "actor", "maker", "verdict"))
    # Sizes from the raw log: only offer_id is read for this pass. The hot
    # ids are fetched behind a size check: none (the usual case) -> no split
    # at all; up to MAX_BROADCAST_HOT -> broadcast split; more -> shuffle join.
    sizes = actions.groupBy("offer_id").agg(F.count(F.lit(1)).alias("_n"))
    hot_ids = sizes.where(F.col("_n") > hot_threshold).select("offer_id")
    probe = [r.offer_id for r in hot_ids.limit(MAX_BROADCAST_HOT + 1).collect()]
    if not probe:
        normal, hot = acts, None
    elif len(probe) <= MAX_BROADCAST_HOT:
        small = F.broadcast(actions.sparkSession.createDataFrame([(x,) for x in probe], "offer_id STRING"))
        normal, hot = acts.join(small, "offer_id", "left_anti"), acts.join(small, "offer_id", "left_semi")
    else:
        normal, hot = acts.join(hot_ids, "offer_id", "left_anti"), acts.join(hot_ids, "offer_id", "left_semi")

    # State-independent parts of each step, in generated code.
    coded = normal.select(
        "offer_id", "seq", "action", "actor",
        _code(F.col("action"), ACTIONS).alias("a"),
        F.coalesce(F.col("maker") == F.col("actor"), F.lit(False)).cast("int").alias("m"),
        F.coalesce(F.col("actor") == "system", F.lit(False)).cast("int").alias("sysf"),
        _code(F.col("verdict"), VERDICTS).alias("v"))
    grouped = coded.groupBy("offer_id").agg(F.array_sort(F.collect_list(F.struct(
        "seq", "action", "actor", "a", "m", "sysf", "v"))).alias("acts"))
    i_get, i_retry, i_submit = (ACTIONS.index(x) for x in ("get_blik", "retry_taker_payment", "submit_blik"))
    idx = (f"((((x.a * {_NS} + acc.s) * 2 + x.m) * 2 + CAST(coalesce(acc.taker = x.actor, false) AS INT)) * 2 "
           f"+ x.sysf) * 3 + CASE x.a WHEN {i_get} THEN CAST(acc.has_blik AS INT) "
           f"WHEN {i_retry} THEN CAST(acc.has_invoice AS INT) WHEN {i_submit} THEN x.v ELSE 0 END")
    clear_codes = ", ".join(str(STATUS_CODES.index(c)) for c in S.CLEARING_STATUSES)
    i_reserve = ACTIONS.index("reserve")
    step_type = ("ARRAY<STRUCT<seq: INT, action: STRING, actor: STRING, s_before: INT, code: INT, "
                 "taker_after: STRING>>")
    zero = (f"named_struct('s', {STATUS_CODES.index(None)}, 'taker', CAST(NULL AS STRING), 'has_blik', false, "
            f"'has_invoice', false, 'steps', CAST(array() AS {step_type}))")
    ok = "(c DIV 64 = 0)"
    ns = "CAST((c % 64) DIV 2 AS INT)"
    clears = f"({ns} IN ({clear_codes}))"
    taker_next = (f"CASE WHEN {ok} AND x.a = {i_reserve} THEN x.actor WHEN {ok} AND {clears} THEN NULL "
                  "ELSE acc.taker END")
    state = f"""named_struct(
        's', {ns},
        'taker', {taker_next},
        'has_blik', CASE WHEN {ok} AND x.a = {i_submit} THEN true WHEN {ok} AND {clears} THEN false
                         ELSE acc.has_blik END,
        'has_invoice', CASE WHEN {ok} AND x.a = {i_submit} THEN true WHEN {ok} AND {clears} THEN false
                            ELSE acc.has_invoice END,
        'steps', concat(acc.steps, array(named_struct('seq', x.seq, 'action', x.action, 'actor', x.actor,
            's_before', acc.s, 'code', c, 'taker_after', {taker_next}))))"""
    # The table is a constant inside the expression (folded to one literal),
    # not a column, so it is never copied into rows.
    lut = "array(" + ",".join(map(str, decision_table())) + ")"
    step = f"element_at(transform(array(element_at({lut}, {idx} + 1)), c -> {state}), 1)"
    folded = (grouped
              .select("offer_id", F.expr(f"aggregate(acts, {zero}, (acc, x) -> {step})").alias("st"))
              .select("offer_id", F.inline("st.steps")))
    names = F.array(*[F.lit(x) for x in STATUS_CODES])
    reasons = F.array(*[F.lit(x) for x in REASONS])
    code = F.col("code")
    decoded = folded.select(
        "offer_id", "seq", "action", "actor",
        F.element_at(names, F.col("s_before") + 1).alias("status_before"),
        F.element_at(names, F.floor((code % 64) / 2).cast("int") + 1).alias("status_after"),
        (F.floor(code / 64) == 0).alias("accepted"),
        F.element_at(reasons, F.floor(code / 64).cast("int") + 1).alias("reason"),
        F.when(code % 2 == 1, F.lit("retry_on_paid")).alias("warning"),
        "taker_after")

    if hot is None:
        return decoded
    # Range partitioning samples the keys, so distinct hot offers land in
    # different tasks (hashing could put two of them together).
    streamed = (hot.repartitionByRange("offer_id").sortWithinPartitions("offer_id", "seq")
                .mapInPandas(_fold_sorted_batches, STEP_SCHEMA))
    return decoded.unionByName(streamed)


def replay_actions(actions: DataFrame, offers: DataFrame, hot_threshold: int = 1000) -> DataFrame:
    """Per offer: final status and taker, counts, and the first rejected
    step - aggregates over `replay_steps` (partial aggregation, so a long
    log adds rows, not memory)."""
    steps = replay_steps(actions, offers, hot_threshold)
    rejected = F.when(~F.col("accepted"), F.struct("seq", "action", "reason"))
    return steps.groupBy("offer_id").agg(
        F.max_by("status_after", "seq").alias("final_status"),
        F.max_by("taker_after", "seq").alias("taker_pubkey"),
        F.count(F.lit(1)).alias("n_actions"),
        F.count_if("accepted").alias("n_accepted"),
        F.count_if(~F.col("accepted")).alias("n_rejected"),
        F.count("warning").alias("n_warnings"),
        F.min_by(rejected, F.when(~F.col("accepted"), F.col("seq"))).alias("first_rejected"))
