"""Operator 1, language-model scoring: stupid backoff over corpus counts.

Method: the counts of all 1-, 2- and 3-grams of the corpus are held by hash
bucket. Each block of documents sends its distinct n-grams with their counts to
the buckets (a trigram travels under its first bigram, so the bucket knows both
counts), gets the corpus totals back, joins them to its documents' n-grams and
sums the log scores per document.

A document is scored on the counts of all *other* documents (its own counts
are subtracted), so every backoff level is used:

    S(w | u v) = c(u v w) / c(u v)             if c(u v w) > 0
                 ALPHA * S(w | v)              otherwise
    S(w | v)   = c(v w) / c(v)                 if c(v w) > 0
                 ALPHA * S(w)                  otherwise
    S(w)       = c(w) / N, or 1 / (N + 1)      if c(w) = 0

with N the words of the other documents. A document's first word is scored by
S(w), its second by S(w | v).

Defined results: null and empty texts have 0 words, score null and counts 0;
repeated rows are documents of their own (each raises the other's counts);
null ids are kept; other columns are ignored. N-grams are compared by 64-bit
hash, a trigram's last word by 32 bits within its bigram.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from offerlake.llm import exchange as E, textops as X

ALPHA = 0.4
ALL = np.uint64(0x5851F42D4C957F2D)  # the key under which the number of words is counted
SCHEMA = "doc_id long, n_words long, log_score double, n_trigram long, n_bigram long, n_unigram long, n_unseen long"
LOW = np.uint64(32)


def _own(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How often each item's key occurs in its own row."""
    _, _, first, place = X.distinct(X.mix(keys ^ X.mix(row.astype(np.uint64) + np.uint64(1))))
    return np.diff(np.append(first, len(keys)))[place]


class _Grams:
    """A block's n-grams: contexts (1- and 2-grams) and the trigrams under them."""

    def __init__(self, block: pa.RecordBatch):
        buf, offsets = X.text_buffer(block.column(1))
        starts, ends, self.row = X.word_spans(buf, offsets)
        words = X.word_hashes(buf, starts, ends)
        self.n = len(words)
        self.one, _ = X.windows(words, self.row, 1)
        self.two, self.at2 = X.windows(words, self.row, 2)
        inner = np.flatnonzero(self.at2[1:] == self.at2[:-1] + 1)
        inner = inner[self.row[self.at2[inner]] == self.row[self.at2[inner] + 2]] if len(inner) else inner
        self.at3 = self.at2[inner]
        tail = words[self.at3 + 2] >> LOW
        context = np.concatenate([self.one, self.two, np.array([ALL])])
        self.keys, _, first, self.place = X.distinct(context)
        self.counts = np.diff(np.append(first, len(context)))
        self.counts[self.place[-1]] += self.n - 1
        self.three = (self.place[self.n + inner].astype(np.uint64) << LOW) | tail
        self.last, _, first3, self.place3 = X.distinct(self.three)
        self.counts3 = np.diff(np.append(first3, len(self.three)))
        self.under = np.searchsorted(self.last >> LOW, np.arange(len(self.keys) + 1, dtype=np.uint64))

    def extra(self, lo: int, hi: int) -> bytes:
        a, b = self.under[lo], self.under[hi]
        tails = (self.last[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return X.dump([self.counts[lo:hi], np.diff(self.under[lo: hi + 1]), self.counts3[a:b]], X.pack(tails))


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key's count over all lists, and its place among the distinct keys."""
    _, order, first, place = X.distinct(keys)
    return np.add.reduceat(counts[order], first)[place] if len(keys) else counts, place


def backoff_scores(docs: DataFrame, alpha: float = ALPHA, buckets: int | None = None) -> DataFrame:
    """One row per document: words, summed natural log score, words scored at each level."""

    def ask(block):
        grams = _Grams(block)
        return grams.keys, grams.extra

    def answer(keys, extras):
        loaded = [X.load(x) for x in extras]
        counts, fan, counts3 = (np.concatenate([a[i] for a, _ in loaded]) for i in range(3))
        tails = np.concatenate([X.unpack(t, np.uint32) for _, t in loaded]).astype(np.uint64)
        total, place = _totals(np.concatenate(keys), counts)
        total3, _ = _totals((np.repeat(place, fan).astype(np.uint64) << LOW) | tails, counts3)
        cut = np.cumsum([len(k) for k in keys])[:-1]
        cut3 = np.cumsum([len(a[2]) for a, _ in loaded])[:-1]
        return [X.dump([a, b], b"") for a, b in zip(np.split(total, cut), np.split(total3, cut3))]

    def use(block, answers):
        g, rows = _Grams(block), block.num_rows
        got = [X.load(a)[0] for a in answers]
        total = np.concatenate([a for a, _ in got])[g.place]
        total3 = np.concatenate([b for _, b in got])[g.place3]
        del got, g.keys, g.last, g.place, g.place3
        c1 = total[: g.n] - _own(g.one, g.row)
        c2, c3 = np.zeros(g.n, np.int64), np.zeros(g.n, np.int64)
        c2[g.at2] = total[g.n: -1] - _own(g.two, g.row[g.at2])
        c3[g.at3] = total3 - _own(g.three, g.row[g.at3])
        all_words = total[-1]
        del total, total3, g.one, g.two, g.three
        words = np.bincount(g.row, minlength=rows)
        others = (all_words - words)[g.row].astype(float)
        first = np.cumsum(words) - words
        order = np.minimum(np.arange(g.n) - first[g.row], 2)  # words of context
        level = np.zeros(g.n, np.int64)
        score = np.where(c1 > 0, c1 / np.maximum(others, 1), 1 / (others + 1))
        level[c1 > 0] = 1
        two = np.flatnonzero((order >= 1) & (np.roll(c2, 1) > 0))
        score[two], level[two] = c2[two - 1] / c1[two - 1], 2
        three = np.flatnonzero((order == 2) & (np.roll(c3, 2) > 0))
        score[three], level[three] = c3[three - 2] / c2[three - 2], 3
        backed = order - np.maximum(level - 1, 0)
        logs = np.log(score) + backed * np.log(alpha)
        summed = np.bincount(g.row, weights=logs, minlength=rows)
        counts = [pa.array(np.bincount(g.row[level == k], minlength=rows)) for k in (3, 2, 1, 0)]
        yield pa.RecordBatch.from_arrays([block.column(0), pa.array(words), pa.array(summed, mask=words == 0), *counts],
                                         names=["doc_id", "n_words", "log_score", "n_trigram", "n_bigram", "n_unigram", "n_unseen"])

    docs = E.settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return E.exchange(docs, "doc_id", "text", ask, answer, use, SCHEMA, buckets or 2 * E.bucket_count(docs))


def query(docs: DataFrame) -> DataFrame:
    """Scores with the mean log score per word, rounded for comparison."""
    return backoff_scores(docs).select(
        "doc_id", "n_words", F.round(F.col("log_score") / F.col("n_words"), 6).alias("mean_log_score"),
        "n_trigram", "n_bigram", "n_unigram", "n_unseen")
