"""Operator 2, substring dedup: repeated fixed-length word windows.

Method: Rabin-Karp hashes of every 13-word window; Spark counts them by hash
bucket (`exchange`: each block of documents sends every distinct window hash
once, with the smallest doc_id it has there); windows that also start in a
document with a smaller doc_id merge into maximal removal intervals.

Defined results: null or empty text has no words and nothing removed; a null
doc_id ranks after every other id, so such rows never remove others' words;
rows with equal doc_id are one document for the comparison and one result row
each; other columns are ignored. Windows are compared by 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from offerlake.llm import exchange as E, textops as X

WINDOW = 13
SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"
LAST = np.iinfo(np.int64).max


def _windows(block: pa.RecordBatch, width: int):
    """Window hashes of a block with their documents' ids, and the words."""
    buf, offsets = X.text_buffer(block.column(1))
    ids = np.asarray(block.column(0).fill_null(LAST)).astype(np.int64)
    starts, ends, row = X.word_spans(buf, offsets)
    keys, at = X.windows(X.word_hashes(buf, starts, ends), row, width)
    return buf, offsets, ids, starts, ends, row, keys, at


def _distinct(keys: np.ndarray, ids: np.ndarray):
    """Distinct keys, the smallest id of each, and each item's place among them."""
    unique, order, first, place = X.distinct(keys)
    least = np.minimum.reduceat(ids[order], first) if len(first) else np.zeros(0, np.int64)
    return unique, least, place


def repeated_windows(docs: DataFrame, width: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """One row per document: counts, maximal removed word spans, kept text.

    Spans are [start, end) word positions.
    """

    def ask(block):
        *_, ids_of_rows, _, _, row, keys, at = _windows(block, width)
        unique, least, _ = _distinct(keys, ids_of_rows[row[at]])
        return unique, lambda lo, hi: X.pack(least[lo:hi])

    def answer(keys, extras):
        least = [X.unpack(x, np.int64) for x in extras]
        every, ids = np.concatenate(keys), np.concatenate(least)
        _, lowest, place = _distinct(every, ids)
        elsewhere = lowest[place] < ids
        cut = np.cumsum([len(k) for k in keys])[:-1]
        return [X.pack_bits(x) for x in np.split(elsewhere, cut)]

    def use(block, answers):
        buf, offsets, ids, starts, ends, row, keys, at = _windows(block, width)
        owner = ids[row[at]]
        unique, least, place = _distinct(keys, owner)
        flags = np.concatenate([X.unpack_bits(a) for a in answers]) if answers else np.zeros(0, bool)
        gone = at[flags[place] | (least[place] < owner)] if len(at) else at
        step = np.zeros(len(starts) + 1, np.int32)
        np.add.at(step, gone, 1)
        np.add.at(step, gone + width, -1)
        cover = np.cumsum(step[:-1]) > 0
        n, rows = len(ids), len(offsets) - 1
        first = np.searchsorted(row, np.arange(rows + 1))
        words = np.diff(first)
        removed = np.bincount(row[cover], minlength=rows) if len(row) else np.zeros(rows, np.int64)
        raw = buf.tobytes()
        texts, spans = [], []
        for r in range(n):
            lo, hi = first[r], first[r + 1]
            parts = raw[offsets[r]: offsets[r + 1]].split()
            if not removed[r]:
                spans.append([])
            else:
                mask = cover[lo:hi]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
                parts = [parts[i] for i in np.flatnonzero(~mask)]
            texts.append(b" ".join(parts).decode())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([block.column(0).cast(pa.int64()), pa.array(words.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(spans, kind), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return E.exchange(docs, "doc_id", "text", ask, answer, use, SCHEMA, buckets)


def query(docs: DataFrame) -> DataFrame:
    """The registered result: counts and the digest of the kept words."""
    out = repeated_windows(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
