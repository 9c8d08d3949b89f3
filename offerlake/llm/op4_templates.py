"""Operator 4, benchmark decontamination by template canonicalisation.

Method: numbers, names and units become typed placeholders; windows of WIDTH
template tokens of documents and benchmark items are hash-joined; along each
alignment (document position minus item position) an item's placeholder value
must stand for one value of the document, so that a re-parameterised question
(other numbers or names, consistently) is caught and a chance template match is
not. Each place of the item has one vote; windows with a place that differs
from its value's majority are dropped, and a value without a majority drops the
alignment. Two values of the item may become equal. A pair is reported when consistent windows cover at least SHARE of the item's words.

Tokens: a word without the punctuation at its ends, in lower case. NUM: digits,
with signs, separators and per cent, or an English number word; UNIT: a unit
name directly after a NUM; NAME: a capitalised word that is no stop word. Windows need MIN_LITERAL tokens
that are no placeholders. Items shorter than WIDTH are one window of their own
length, with at least half of it literal.

Windows with fewer literals (items dense in numbers or names), copies that
change words' case and alignments without a consistent value have no common
template. They count where they are verbatim: windows also meet on the hash of
their plain lower-cased words, with no least number of literals, and cover the
item's words whatever the templates say.

Only document windows whose hash hits a bitmap of the benchmark's hashes leave
the scan; the bitmap has 1 MiB whatever the benchmark's size, so
it is safe to send to every task, and the join after it is exact.

Defined results: null or empty texts and items have no windows and are never
reported; a null doc_id or item_id is never reported; repeated rows of a
document are one document; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from offerlake.llm import exchange as E, textops as X
from offerlake.llm.op10_rules import STOP_WORDS

WIDTH = 8
MIN_LITERAL = 4
SHARE = 0.5
UNITS = frozenset((
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t gram grams kilogram kilograms ton tons tonne tonnes oz lb lbs pound pounds "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur gbp percent % $ € £ km/h mph hz khz mhz ghz w kw mw kwh v volt volts a amp amps j kj cal kcal "
    "° °c °f degree degrees kb mb gb tb bit bits byte bytes").split())
NUMBER_WORDS = frozenset((
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half twice").split())
EDGE = re.compile(r"^[^\w%$€£°]+|[^\w%$€£°]+$")
NUMBER = re.compile(r"[+\-$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%)?$")
STOP = frozenset(STOP_WORDS)
LITERAL, NUM, UNIT, NAME = range(4)
SLICE_BYTES = 1 << 21  # text bytes held as tokens at a time
PLAIN = np.uint64(0xA0761D6478BD642F)  # tells verbatim windows from templates
WINDOWS = "id long, pos int, width int, size int, plain boolean, hash long, slots array<string>, at array<int>"


def token(word: str) -> tuple[int, str]:
    """(kind, core) of one word; a UNIT still needs a NUM before it."""
    core = EDGE.sub("", word) or word
    low = core.lower()
    if NUMBER.match(core) or low in NUMBER_WORDS:
        return NUM, low
    if low in UNITS:
        return UNIT, low
    if len(core) > 1 and core[0].isupper() and low not in STOP:
        return NAME, low
    return LITERAL, low


def _tokens(block: pa.RecordBatch):
    """Row, kind, canonical and plain hash of every word, and the words' cores."""
    buf, offsets = X.text_buffer(block.column(1))
    starts, ends, row = X.word_spans(buf, offsets)
    unique, order, first, place = X.distinct(X.word_hashes(buf, starts, ends))
    raw, pick = buf.tobytes(), order[first]
    words = [raw[s:e].decode() for s, e in zip(starts[pick].tolist(), ends[pick].tolist())]
    seen = [token(w) for w in words]
    kinds, cores = np.array([k for k, _ in seen], np.int8), [c for _, c in seen]
    joined = [c.encode() for c in cores]
    stop = np.cumsum([len(c) for c in joined]) if joined else np.zeros(0, np.int64)
    begin = np.concatenate(([0], stop[:-1])) if joined else stop
    literal = X.word_hashes(np.frombuffer(b"".join(joined), np.uint8), begin, stop)
    kind = kinds[place] if len(place) else np.zeros(0, np.int8)
    after = np.zeros(len(kind), bool)
    if len(kind) > 1:
        after[1:] = (kind[:-1] == NUM) & (row[1:] == row[:-1])
    kind = np.where((kind == UNIT) & ~after, LITERAL, kind)
    marks = X.mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(X.BASE))
    low = literal[place] if len(place) else np.zeros(0, np.uint64)
    code = np.where(kind == LITERAL, low, marks[kind]).astype(np.uint64)
    return row, kind, code, low, place, cores


def template_windows(texts: DataFrame, widths: list[int], bitmap: bytes | None) -> DataFrame:
    """Windows of (id long, text) rows: all of them, or those whose hash is in the bitmap.

    With WIDTH among several widths, a shorter width takes whole texts of that
    length only where ``bitmap`` is None (benchmark items), else every window.
    """

    def make(batches):
        for batch in batches:
            for block in X.slices(batch, "text", SLICE_BYTES):
                row, kind, code, low, place, cores = _tokens(block)
                size = np.bincount(row, minlength=block.num_rows) if len(row) else np.zeros(block.num_rows, np.int64)
                first = np.cumsum(size) - size
                literals = np.concatenate(([0], np.cumsum(kind == LITERAL)))
                ids = np.asarray(block.column(0))
                for width, plain in ((w, p) for w in widths for p in (False, True)):
                    hashes, at = X.windows(low if plain else code, row, width)
                    if plain:
                        hashes = X.mix(hashes ^ PLAIN)
                        ok = np.ones(len(at), bool)
                    else:
                        need = MIN_LITERAL if width == WIDTH else (width + 1) // 2
                        ok = literals[at + width] - literals[at] >= need
                    if bitmap is None:
                        if width < WIDTH:
                            ok &= size[row[at]] == width
                    else:
                        ok &= E.hits(bitmap, hashes)
                    hashes, at = hashes[ok], at[ok]
                    if not len(at):
                        continue
                    where = [[j for j in range(width) if kind[i + j] != LITERAL] for i in at.tolist()]
                    slots = [[cores[place[i + j]] for j in js] for i, js in zip(at.tolist(), where)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[row[at]].astype(np.int64)), pa.array((at - first[row[at]]).astype(np.int32)),
                        pa.array(np.full(len(at), width, np.int32)), pa.array(size[row[at]].astype(np.int32)),
                        pa.array(np.full(len(at), plain)), pa.array(hashes.view(np.int64)), pa.array(slots, pa.list_(pa.string())),
                        pa.array(where, pa.list_(pa.int32()))],
                        names=["id", "pos", "width", "size", "plain", "hash", "slots", "at"])

    return texts.mapInArrow(X.lean(make), WINDOWS)


def _consistent(line: list[dict]) -> list[dict]:
    """The windows of one alignment whose item values all stand for their majority value.

    A value that has no value of the document at more than half of its places
    leaves none.
    """
    places = {(a, r["ipos"] + i): b for r in line for i, a, b in zip(r["at"], r["islots"], r["dslots"])}
    votes: dict[str, Counter] = {}
    for (a, _), b in places.items():
        votes.setdefault(a, Counter())[b] += 1
    to = {}
    for a, seen in votes.items():
        to[a], n = seen.most_common(1)[0]
        if 2 * n <= seen.total():
            return []
    return [r for r in line if all(to[a] == b for a, b in zip(r["islots"], r["dslots"]))]


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, item_words, covered, n_slots, n_changed) of every contaminated pair.

    n_slots counts the item's distinct placeholder values in the matched
    windows, n_changed those that have another value in the document.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    bench = template_windows(items, list(range(1, WIDTH + 1)), None)
    widths = sorted(r.width for r in bench.select("width").distinct().collect())  # WIDTH values at most
    found = template_windows(texts, widths, E.bitmap(bench, "hash")).select(F.col("id").alias("doc_id"), "pos", "width", "plain", "hash", F.col("slots").alias("dslots"))
    right = bench.select(F.col("id").alias("item_id"), F.col("pos").alias("ipos"), "width", "size", "plain", "hash", F.col("slots").alias("islots"), "at")
    joined = found.join(right, ["hash", "width", "plain"]).select("doc_id", "item_id", "pos", "ipos", "width", "size", "plain", "islots", "dslots", "at")
    near = joined.repartition("doc_id").sortWithinPartitions("doc_id", "item_id")

    def judge(rows):
        lines: dict[int, list] = {}
        for r in rows:
            if not r["plain"]:
                lines.setdefault(r["pos"] - r["ipos"], []).append(r)
        covered, slots = set(), {}
        for line in lines.values():
            for r in _consistent(line):
                covered.update(range(r["ipos"], r["ipos"] + r["width"]))
                slots.update(zip(r["islots"], r["dslots"]))
        for r in rows:
            if r["plain"]:
                covered.update(range(r["ipos"], r["ipos"] + r["width"]))
                for a in r["islots"]:
                    slots.setdefault(a, a)
        if len(covered) >= share * rows[0]["size"]:
            return {"doc_id": rows[0]["doc_id"], "item_id": rows[0]["item_id"], "item_words": rows[0]["size"], "covered": len(covered),
                    "n_slots": len(slots), "n_changed": sum(a != b for a, b in slots.items())}
        return None

    names = ["doc_id", "item_id", "item_words", "covered", "n_slots", "n_changed"]
    kind = pa.schema([(n, pa.int64()) for n in names])

    def decide(batches):
        held: list[dict] = []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if held and (r["doc_id"], r["item_id"]) != (held[0]["doc_id"], held[0]["item_id"]):
                    out.append(judge(held))
                    held = []
                held.append(r)
            yield pa.RecordBatch.from_pylist([x for x in out if x], schema=kind)
        if held:
            yield pa.RecordBatch.from_pylist([x for x in [judge(held)] if x], schema=kind)

    return near.mapInArrow(X.lean(decide), ", ".join(f"{n} long" for n in names))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their columns as they were."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("leaked_id")).distinct()
    return docs.join(bad, F.col("doc_id") == F.col("leaked_id"), "left_anti")


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark)
