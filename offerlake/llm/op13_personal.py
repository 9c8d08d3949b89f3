"""Operator 13, personal data by bootstrapped contextual extraction.

Base: emails, IP addresses, card and phone numbers by their formats (`base_spans`).
These spans are the seeds. Every seed and every other *candidate*, a word with a
digit or an at sign, stands in lexical patterns: its two words to the left, and
its left and right word. Patterns and instances (normalised candidates) are the
two sides of a graph whose edges Spark counts and scores in ROUNDS rounds:

    pattern   share of known instances of one kind among all its instances,
              accepted from SUPPORT known instances and CONFIDENCE on
    instance  1 - product of (1 - confidence) over its accepted patterns,
              known for the next round from CONFIDENCE on

so that confident patterns discover identifiers that no format describes, and
these in turn induce patterns. A candidate is reported as `found_<kind>` where
it stands in an accepted pattern and its instance is known; it needs DIGITS
digits or an at sign, and never overlaps a base span.

On Spark: one pass over the texts writes base spans and occurrences, without
texts, to the shared folder. Edges are distinct (pattern, instance) pairs,
reduced before they move, so a phrase or identifier with a third of all
occurrences is one row per map task; scores are joined by 64-bit hashes, and
skewed joins are split by AQE. No list of patterns or instances is collected.

Defined results: null and empty texts have no spans and the hash of the empty
string; repeated rows and null ids are rows of their own; positions are code
points. Matches that fail a check (octets over 255, digits, Luhn) are dropped
without a second try inside them. Words are cut at space and 0x09-0x0D; a
pattern word is lower-cased, its edge punctuation goes, its digits become 0 and
of very long ones the nearest LONGEST characters count; the text's edges count
as a word. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from offerlake.llm import textops as X
from offerlake.llm.stored import stored

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 2
SUPPORT = 5
CONFIDENCE = 0.8
DIGITS = 4
LONGEST = 64  # characters of a pattern word that count, those next to the place
SLICE_BYTES = 1 << 20

SPACE = " \t\n\x0b\x0c\r"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is tried from its start only: inside it, the same text would follow
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
GAP = re.compile(r"[\x20\x09-\x0D]")
EDGE = "\"'`.,;:!?()[]{}<>|*#$%&=~^_/\\"
NOT_DIGIT = re.compile(r"[^0-9]+")
NUMBER = re.compile(r"[0-9]")
PLACED = "array<struct<kind:int,start:int,end:int>>"
READ = f"row long, doc_id long, spans {PLACED}, seen array<struct<kind:int,start:int,end:int,instance:long,patterns:array<long>>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str):
    """Each at sign ends one run of local characters, cut at the previous match."""
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and (c := text[begin - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            begin -= 1
        after = at + 1
        # a run that failed is not walked again: it ends in an at sign, which no run holds
        if begin < at and (m := DOMAIN.match(text, after)):
            yield begin, m.end()
            free = after = m.end()
        else:
            free = after
        at = text.find("@", after)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the formats' matches, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if _octets(m.group())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _octets(address: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in address.split("."))


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _word_left(text: str, at: int) -> tuple[int, int]:
    """The last LONGEST characters at most of the word that ends before ``at``, apart from white space."""
    while at > 0 and text[at - 1] in SPACE:
        at -= 1
    begin, least = at, max(0, at - LONGEST)
    while begin > least and text[begin - 1] not in SPACE:
        begin -= 1
    return begin, at


def _word_right(text: str, at: int) -> tuple[int, int]:
    n = len(text)
    while at < n and text[at] in SPACE:
        at += 1
    m = GAP.search(text, at, at + LONGEST)
    return at, (m.start() if m else min(n, at + LONGEST))


def _plain(word: str) -> str:
    return NUMBER.sub("0", word.lower().strip(EDGE) or word.lower())


def contexts(text: str, begin: int, end: int) -> list[int]:
    """The pattern hashes of a place: the rest of its own words belongs to the neighbours."""
    a, b = _word_left(text, begin)
    first = _plain(text[a:b])
    c, d = _word_left(text, a)
    e, f = _word_right(text, end)
    return [_hash(f"2\x00{_plain(text[c:d])}\x00{first}"), _hash(f"1\x00{first}\x00{_plain(text[e:f])}")]


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Words with enough digits or an at sign, without edge punctuation, that meet no base span."""
    taken = sorted((a, b) for _, a, b in spans)
    out, k, at = [], 0, 0
    while m := MARK.search(text, at):
        begin = m.start()
        while begin > at and text[begin - 1] not in SPACE:
            begin -= 1
        stop = GAP.search(text, m.end())
        end = at = stop.start() if stop else len(text)
        while begin < end and text[begin] in EDGE:
            begin += 1
        while end > begin and text[end - 1] in EDGE:
            end -= 1
        while k < len(taken) and taken[k][1] <= begin:
            k += 1
        if k < len(taken) and taken[k][0] < end:
            continue
        if begin < end and ("@" in (word := text[begin:end]) or len(NUMBER.findall(word)) >= DIGITS):
            out.append((begin, end))
    return out


def instance(text: str, begin: int, end: int) -> int:
    return _hash(text[begin:end].lower())


def read(text: str) -> tuple[list[tuple], list[tuple]]:
    """Base spans, and all occurrences (kind or -1, start, end, instance, patterns) of seeds and candidates."""
    if not MARK.search(text):
        return [], []
    spans = base_spans(text)
    places = [(k, a, b) for k, a, b in spans] + [(-1, a, b) for a, b in candidates(text, spans)]
    return spans, [(k, a, b, instance(text, a, b), contexts(text, a, b)) for k, a, b in places]


def _lists(rows: list[list], build) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), build([x for r in rows for x in r]))


def _structs(items: list[tuple], names: list[str]) -> pa.Array:
    columns = []
    for i, name in enumerate(names):
        values = [x[i] for x in items]
        kind = pa.list_(pa.int64()) if name == "patterns" else pa.int64() if name == "instance" else pa.int32()
        columns.append(pa.array(values, kind))
    return pa.StructArray.from_arrays(columns, names)


def occurrences(docs: DataFrame) -> DataFrame:
    """One row per document: row number, id, base spans, occurrences. Written once, so the numbers stay."""

    def scan(batches):
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for block in X.slices(batch, "text", SLICE_BYTES):
                both = [read(t or "") for t in block.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(at, at + len(both)), pa.int64()), block.column(0),
                    _lists([s for s, _ in both], lambda x: _structs(x, ["kind", "start", "end"])),
                    _lists([o for _, o in both], lambda x: _structs(x, ["kind", "start", "end", "instance", "patterns"]))], names=["row", "doc_id", "spans", "seen"])
                at += len(both)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(scan, READ), "personal-read")


def discovered(seen: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Accepted patterns (pattern, kind, sure) and known instances (instance, kind, sure).

    seen: kind, instance, patterns of every occurrence.
    """
    edges = stored(seen.select("instance", F.explode("patterns").alias("pattern")).distinct(), "personal-edges")
    known = stored(seen.where("kind >= 0").groupBy("instance", "kind").agg(F.lit(1.0).alias("sure")), "personal-known")
    seeds, sizes, accepted = known, edges.groupBy("pattern").agg(F.count("*").alias("n_all")), None
    for _ in range(rounds):
        held = edges.join(known, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("n_known"), F.sum("sure").alias("weight"))
        rated = held.where(F.col("n_known") >= support).join(sizes, "pattern").withColumn("sure", F.round(F.col("weight") / F.col("n_all"), 9))
        # a pattern speaks for one kind: at 0.8 or more of its instances, no other kind reaches as much
        accepted = stored(rated.where(F.col("sure") >= confidence).select("pattern", "kind", "sure"), "personal-patterns")
        doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("sure"))))
        raised = edges.join(accepted, "pattern").groupBy("instance", "kind").agg(F.round(1 - F.exp(doubt), 9).alias("sure"))
        fresh = raised.join(seeds.select("instance").distinct(), "instance", "left_anti")
        known = stored(seeds.unionByName(fresh), "personal-known")
    return accepted, known


def found_spans(rows: DataFrame, patterns: DataFrame, known: DataFrame) -> DataFrame:
    """(row, kind, start, end) of the occurrences that an accepted pattern and a known instance agree on."""
    open_ = rows.select("row", F.explode("seen").alias("s")).where("s.kind < 0").select(
        "row", "s.start", "s.end", "s.instance", F.explode("s.patterns").alias("pattern"))
    held = open_.join(patterns.select("pattern", "kind"), "pattern").select("row", "start", "end", "instance", "kind").distinct()
    sure = held.join(known.select("instance", "kind", "sure"), ["instance", "kind"])
    # of two kinds the surer one, then the first
    return sure.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("sure", -F.col("kind"))).alias("kind"))


def _text(name: str, spans: str) -> str:
    names = ", ".join(f"'{name}{k}'" for k in KINDS)
    return f"transform(array_sort({spans}), x -> concat(array({names})[x.kind], ':', x.start, ':', x.end))"


def personal_data(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per document: doc_id, base spans and found spans as arrays of (kind, start, end)."""
    rows = occurrences(docs)
    patterns, known = discovered(rows.select(F.explode("seen").alias("s")).select("s.kind", "s.instance", "s.patterns"), rounds, support, confidence)
    found = found_spans(rows, patterns, known).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("found"))
    return rows.select("row", "doc_id", "spans").join(found, "row", "left").select(
        "doc_id", "spans", F.coalesce("found", F.expr(f"CAST(array() AS {PLACED})")).alias("found"))


def query(docs: DataFrame) -> DataFrame:
    rows = personal_data(docs)
    base, more = _text("", "spans"), _text("found_", "found")
    counts = [F.expr(f"CAST(size(filter(spans, x -> x.kind = {i})) AS BIGINT)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(F.array_join(F.expr(base), ","), 256).alias("base_sha256"),
                       F.array_join(F.expr(f"concat({base}, {more})"), ",").alias("spans"))
