"""Operator 5, token counts without token ids.

Method: the tokenizer never joins characters across white space, so a text's
count is the sum over its white-space-delimited pre-tokens. Each block of
documents sends its distinct pre-tokens to the hash bucket that owns them; the
bucket counts the pieces of every distinct pre-token once and answers; the
block joins the answers to its documents' pre-token frequencies and sums.

The library decides everything inside a pre-token (normalisation, splitting,
special strings), so the counts are its own.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
and null ids give one result row each; other columns are ignored.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from offerlake.llm import exchange as E, textops as X

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
BATCH = 20_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def counter(vocabulary: str):
    """A function from texts to their token counts, by the vocabulary's own library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = vocabulary if os.path.isabs(vocabulary) else vocabulary_path(vocabulary)
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch(texts, add_special_tokens=False)]


def _words(block: pa.RecordBatch):
    buf, offsets = X.text_buffer(block.column(1))
    starts, ends, row = X.word_spans(buf, offsets)
    return buf, offsets, starts, ends, row, X.word_hashes(buf, starts, ends)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens.

    ``vocabulary``: a tokenizers .json whose pre-tokens never span white space,
    by name in the public collection or as an absolute path on every machine.
    """

    def ask(block):
        buf, _, starts, ends, _, hashes = _words(block)
        unique, order, first, _ = X.distinct(hashes)
        raw, pick = buf.tobytes(), order[first]
        lo_byte, hi_byte = starts[pick].tolist(), ends[pick].tolist()
        return unique, lambda lo, hi: X.squeeze(b" ".join([raw[s:e] for s, e in zip(lo_byte[lo:hi], hi_byte[lo:hi])]))

    def answer(keys, extras):
        lists = [X.unsqueeze(x).split(b" ") for x in extras]
        seen = dict.fromkeys(w for words in lists for w in words)
        count, distinct = counter(vocabulary), list(seen)
        for at in range(0, len(distinct), BATCH):
            part = distinct[at: at + BATCH]
            seen.update(zip(part, count([w.decode() for w in part])))
        return [X.pack(np.fromiter((seen[w] for w in words), np.uint32, len(words))) for words in lists]

    def use(block, answers):
        _, offsets, _, _, row, hashes = _words(block)
        _, _, _, place = X.distinct(hashes)
        sizes = np.concatenate([X.unpack(a, np.uint32) for a in answers]) if answers else np.zeros(0, np.uint32)
        total = np.bincount(row, weights=sizes[place], minlength=block.num_rows) if len(row) else np.zeros(block.num_rows)
        yield pa.RecordBatch.from_arrays([block.column(0), pa.array(np.diff(offsets)), pa.array(total.astype(np.int64))], names=["doc_id", "n_bytes", "n_tokens"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return E.exchange(docs, "doc_id", "text", ask, answer, use, SCHEMA, buckets)


def query(docs: DataFrame) -> DataFrame:
    out = token_counts(docs)
    return out.select("*", (F.col("n_tokens") > LIMIT).alias("over_limit"))
