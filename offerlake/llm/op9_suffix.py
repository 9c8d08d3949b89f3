"""Operator 9, suffix-array dedup: repeated byte strings of a minimum length.

Method: threshold-bounded interval expansion. On the Burrows-Wheeler transform
of a text, breadth-first backward extension of suffix-array intervals derives
the common-prefix values in increasing order; it stops at the minimum length,
and neighbours without a value by then share at least that many bytes.

One suffix array cannot span a corpus. Texts are cut so that equal strings
always meet: the smallest GRAM-byte hash inside a LENGTH-byte window (its
anchor) depends on the window alone. Each block asks which of its anchors
occur twice; around those it sends the windows' bytes (a segment) to the
anchor's bucket, where segments are transformed and expanded in batches of
about BATCH bytes. Segments that are equal are sent and sorted once, with
their number of copies; an anchor with more text than a batch (a passage that
very many documents share) is divided by window offset and by the bytes that
all its windows share, until the parts fit.

Defined results: null and empty texts have 0 bytes; texts shorter than LENGTH
lose nothing; repeated rows and null ids are rows of their own (and copies of
each other); strings never cross rows. Anchors are compared by 64-bit hash,
strings by their bytes. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from offerlake.llm import exchange as E, textops as X

LENGTH = 400
GRAM = 48
BATCH = 1 << 19
SEPARATOR = 0xFF  # never occurs in UTF-8
FIRST = 8  # depth of the first sort
SCHEMA = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


# -- the transform and its expansion ------------------------------------------
def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotations of ``text`` sorted by their first ``depth`` bytes or more, and the
    starts of the groups that agree in FIRST bytes."""
    n = len(text)
    ring = np.concatenate([text, np.resize(text, FIRST)])
    key = np.zeros(n, np.uint64)
    for j in range(FIRST):
        key = (key << np.uint64(8)) | ring[j: j + n].astype(np.uint64)
    order = np.argsort(key)
    first = X.group_starts(key[order])
    size = np.diff(np.append(first, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, size)
    tied = order[np.repeat(size > 1, size)]
    at = FIRST
    while at < depth and len(tied):
        old = rank[tied]
        pair = (old.astype(np.uint64) << np.uint64(32)) | rank[(tied + at) % n].astype(np.uint64)
        o = np.argsort(pair)
        tied, pair = tied[o], pair[o]
        old = (pair >> np.uint64(32)).astype(np.int64)
        begin = X.group_starts(pair)
        size = np.diff(np.append(begin, len(pair)))
        parent = X.group_starts(old)
        offset = np.arange(len(pair)) - np.repeat(parent, np.diff(np.append(parent, len(pair))))
        rank[tied] = np.repeat((old + offset)[begin], size)
        tied = tied[np.repeat(size > 1, size)]
        at *= 2
    return np.argsort(rank, kind="stable"), first


def equal_prefixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotations in order, and which of them start a new ``depth``-byte prefix."""
    n = len(text)
    order, first = suffix_order(text, depth)
    bwt = text[order - 1]
    back = np.argsort(bwt, kind="stable")  # row of the k-th row's predecessor
    step = np.empty(n, np.int64)
    step[back] = np.arange(n)
    column = bwt[back]
    same = column[1:] == column[:-1]
    after, before = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    after[back[:-1][same]] = back[1:][same]
    before[back[1:][same]] = back[:-1][same]

    known = np.zeros(n + 1, bool)
    known[first] = known[0] = known[n] = True
    lo, hi = first, np.append(first[1:], n) - 1
    for _ in range(FIRST, depth):  # prefixes of each length in turn, extended by one byte to the left
        one = lo == hi
        new_lo = new_hi = step[lo[one]]
        many_lo, many_hi = lo[~one], hi[~one]
        if len(many_lo):
            size = many_hi - many_lo + 1
            row = np.arange(size.sum()) + np.repeat(many_lo - np.cumsum(size) + size, size)
            ends = np.sort(step[row[after[row] > np.repeat(many_hi, size)]])
            begins = np.sort(step[row[before[row] < np.repeat(many_lo, size)]])
            new_lo, new_hi = np.concatenate([new_lo, begins]), np.concatenate([new_hi, ends])
        fresh = ~known[new_hi + 1]
        lo, hi = new_lo[fresh], new_hi[fresh]
        if not len(lo):
            break
        known[hi + 1] = True
    return order, known[:n]


def repeated_starts(segments: list[bytes], copies: list[int], length: int) -> list[np.ndarray]:
    """For each segment, which of its windows also start elsewhere (or in a copy)."""
    text = np.frombuffer(b"".join(s + bytes([SEPARATOR]) for s in segments), np.uint8)
    size = np.array([len(s) + 1 for s in segments])
    weight = np.repeat(np.minimum(np.array(copies), 2), size)
    order, new = equal_prefixes(text, length)
    begin = np.flatnonzero(new)
    total = np.add.reduceat(weight[order], begin)
    again = np.empty(len(text), bool)
    again[order] = np.repeat(total > 1, np.diff(np.append(begin, len(text))))
    at = np.cumsum(size) - size
    return [again[a: a + n - length] for a, n in zip(at.tolist(), size.tolist())]


# -- segments around anchors ---------------------------------------------------
def segments_of(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """(anchor hash, anchor, first window, last window, row) of every segment."""
    width = length - GRAM + 1
    chunk = 1 << 19
    out: list[list[np.ndarray]] = [[] for _ in range(4)]
    sizes = np.diff(offsets)
    valid = np.zeros(len(buf) + 1, np.int8)  # windows inside one row
    long_rows = np.flatnonzero(sizes >= length)
    valid[offsets[long_rows]] += 1
    valid[offsets[long_rows] + sizes[long_rows] - length + 1] -= 1
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    for lo in range(0, len(buf), chunk):
        hi = min(len(buf), lo + chunk)
        ok = valid[lo:hi]
        if not ok.any():
            continue
        prefix = X.poly(X.BYTE_VALUE[buf[lo: hi + length - 1]])
        grams = len(prefix) - GRAM
        if grams < width:
            continue
        h = X.mix((prefix[GRAM:] - prefix[:-GRAM]) * X.power_tables(len(prefix))[1][:grams])
        mask = np.uint64((1 << 20) - 1)
        key = (h & ~mask) | np.arange(grams, dtype=np.uint64)
        pad = -grams % width
        grid = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
        fore = np.minimum.accumulate(grid, axis=1).ravel()
        rear = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        count = grams - width + 1
        least = (np.minimum(rear[:count], fore[width - 1: width - 1 + count]) & mask).astype(np.int64)
        at = np.flatnonzero(ok[:count])
        anchor = least[at]
        cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))))
        last = np.append(cut[1:], len(at)) - 1
        # smallest hashes are small: mixed again, they spread evenly over the buckets
        for k, v in enumerate((X.mix(h[anchor[cut]]), anchor[cut] + lo, at[cut] + lo, at[last] + lo)):
            out[k].append(v)
    if not out[0]:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty, empty
    key, anchor, begin, end = (np.concatenate(x) for x in out)
    return key, anchor, begin, end, np.searchsorted(offsets, begin, side="right") - 1


def _divide(group: list, copies: list[int], length: int, lo: int, hi: int, batch: int):
    """Split one anchor's segments until each part fits a batch.

    group: (bytes, first window's offset from the anchor, [(item, shift)]);
    ``lo`` and ``hi`` bound the windows' offsets. Equal windows have equal
    offsets and equal shared bytes, so they stay in one part.
    """
    if sum(len(g[0]) for g in group) <= batch or lo == hi:
        yield group
        return
    mid = (lo + hi) // 2
    for a, b in ((lo, mid), (mid + 1, hi)):
        parts: dict[bytes, dict] = {}
        for data, at, items in group:
            x, y = max(a, at), min(b, at + len(data) - length)
            if x <= y:
                same = parts.setdefault(data[b - at: a + length - at], {})  # bytes in all windows of [a, b]
                same.setdefault((data[x - at: y - at + length], x), []).extend((i, s + x - at) for i, s in items)
        for same in parts.values():
            if sum(copies[i] for items in same.values() for i, _ in items) > 1:
                yield from _divide([(d, x, items) for (d, x), items in same.items()], copies, length, a, b, batch)


# -- the operator ---------------------------------------------------------------
def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def repeated_strings(docs: DataFrame, length: int = LENGTH, buckets: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: sizes, maximal removed byte spans [start, end), kept bytes.

    Columns named in ``carry`` come along in a struct ``carried``.
    """

    def anchors(block):
        key = np.sort(segments_of(*X.text_buffer(block.column(1)), length)[0])
        first = X.group_starts(key)
        twice = np.diff(np.append(first, len(key))) > 1
        return key[first], lambda lo, hi: X.pack_bits(twice[lo:hi])

    def repeated(keys, extras):
        every, twice = np.concatenate(keys), np.concatenate([X.unpack_bits(x) for x in extras])
        _, order, first, place = X.distinct(every)
        total = np.add.reduceat(1 + twice[order].astype(np.int64), first)
        return [X.pack_bits(x) for x in np.split((total > 1)[place], np.cumsum([len(k) for k in keys])[:-1])]

    def send(block, answers, number, mark):
        buf, offsets = X.text_buffer(block.column(1))
        key, anchor, begin, end, row = segments_of(buf, offsets, length)
        unique, _, _, place = X.distinct(key)
        again = np.concatenate([X.unpack_bits(a) for a in answers])[place] if answers else np.zeros(0, bool)
        pick = np.flatnonzero(again)
        pick = pick[np.argsort(key[pick], kind="stable")]
        raw = buf.tobytes()
        distinct: dict[tuple, list[int]] = {}
        for i, k, a, s, e in zip(pick.tolist(), key[pick].tolist(), anchor[pick].tolist(), begin[pick].tolist(), end[pick].tolist()):
            distinct.setdefault((k, a - s, raw[s: e + length]), []).append(i)
        items = list(distinct.items())
        keys = np.array([k for (k, _, _), _ in items], np.uint64)

        def extra(lo, hi):
            part = items[lo:hi]
            where = np.concatenate([np.array(v, np.int64) for _, v in part])
            sizes, shifts, times = (np.array(x) for x in zip(*((len(d), s, len(v)) for (_, s, d), v in part)))
            return X.dump([sizes, shifts, times, row[where], begin[where] - offsets[row[where]]], b"".join(d for (_, _, d), _ in part))

        yield from E.rows_of(number, mark, keys, extra, p)

    def expand(keys, extras):
        # equal segments of all blocks become one item with all its places
        held: dict[int, dict] = {}
        for b, (ks, raw) in enumerate(zip(keys, extras)):
            (sizes, shifts, times, rows, at), data = X.load(raw)
            stop, last = np.cumsum(sizes).tolist(), np.cumsum(times).tolist()
            for k, s, lo, hi, x, y in zip(ks.tolist(), shifts.tolist(), [0, *stop], stop, [0, *last], last):
                held.setdefault(k, {}).setdefault((data[lo:hi], -s), []).append((b, rows[x:y], at[x:y]))
        found: list[list[np.ndarray]] = [[] for _ in keys]

        def settle(entries):
            """entries: (bytes, number of copies, [(places, shift)])."""
            flags = repeated_starts([e[0] for e in entries], [e[1] for e in entries], length)
            for again, (_, _, where) in zip(flags, entries):
                begin, end = _runs(again)
                if not len(begin):
                    continue
                for places, shift in where:
                    for b, rows, at in places:
                        base = (at + shift)[:, None]
                        found[b].append(np.stack([np.repeat(rows, len(begin)), (base + begin).ravel(), (base + end - 1 + length).ravel()], axis=1))

        batch, size = [], 0
        for segments in held.values():
            items = list(segments.items())
            copies = [sum(len(rows) for _, rows, _ in places) for _, places in items]
            group = [(d, s, [(i, 0)]) for i, ((d, s), _) in enumerate(items)]
            lo, hi = min(s for _, s, _ in group), max(s + len(d) - length for d, s, _ in group)
            for part in _divide(group, copies, length, lo, hi, BATCH):
                batch += [(d, sum(copies[i] for i, _ in where), [(items[i][1], shift) for i, shift in where]) for d, _, where in part]
                size += sum(len(d) for d, _, _ in part)
                if size >= BATCH:
                    settle(batch)
                    batch, size = [], 0
        if batch:
            settle(batch)
        return [X.pack(np.concatenate(f).ravel()) if f else None for f in found]

    def remove(block, answers, number, mark):
        buf, offsets = X.text_buffer(block.column(1))
        step = np.zeros(len(buf) + 1, np.int32)
        for a in answers:
            if a is not None:
                row, lo, hi = X.unpack(a, np.int64).reshape(-1, 3).T
                np.add.at(step, offsets[row] + lo, 1)
                np.add.at(step, offsets[row] + hi, -1)
        gone = np.cumsum(step[:-1]) > 0
        raw, kept, spans, removed = buf.tobytes(), [], [], []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            mask = gone[lo:hi]
            n = int(mask.sum())
            begin, end = _runs(mask) if n else ((), ())
            removed.append(n)
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(begin, end)])
            kept.append(buf[lo:hi][~mask].tobytes() if n else raw[lo:hi])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()),
                                          *block.columns[2:]], names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "carried"][: 3 + block.num_columns])

    held = [F.struct(*carry).alias("carried")] if carry else []
    docs = E.settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *held))
    schema = SCHEMA + (f", carried {docs.schema['carried'].dataType.simpleString()}" if carry else "")
    p = buckets or E.bucket_count(docs)
    known = E.answering(E.asking(docs, "doc_id", "text", anchors, p), repeated)
    sent = E.meeting(docs, "doc_id", "text", known, send, E.ASK)
    return E.meeting(docs, "doc_id", "text", E.answering(sent, expand), remove, schema)


def query(docs: DataFrame) -> DataFrame:
    return repeated_strings(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
