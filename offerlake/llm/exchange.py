"""Ask-and-answer exchange: documents query a table that is spread by hash.

Counting every window of a corpus as Spark rows moves several times the text.
Here each *block* (some megabytes of documents) asks once per distinct hash:
its sorted hashes go, packed, to the bucket that owns their range; the bucket
merges the blocks' lists and answers in the same order; the answers come back
to the block, which meets its documents again there.

    asks    = documents -> mapInArrow  -> (bucket, block, keys, extra)
    answers = asks.groupBy(bucket).applyInArrow -> (block, bucket, answer)
    result  = blocks.cogroup(answers) by block

A key that occurs in every document costs a bucket one entry per block, and
the buckets are ranges of a uniform hash, so no key makes one task large.
Blocks are cut from the partitions of the input. They are made twice; a check
sum travels with the answers and a block that was cut differently the second
time fails instead of giving wrong rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from offerlake.llm import textops as X
from offerlake.session import checkpoint_dir

BUCKET_BYTES = 16 << 20  # input bytes for each bucket
ASK = "bucket int, block long, mark long, keys binary, extra binary"
ANSWER = "block long, bucket int, mark long, answer binary"


SLOT_BITS = 23


def bitmap(df: DataFrame, column: str) -> bytes:
    """Which leading SLOT_BITS bits occur among a column's 64-bit hashes: 1 MiB, however
    many rows there are. At most 256 rows of 4 KiB reach the driver."""
    slot = F.shiftrightunsigned(F.col(column), 64 - SLOT_BITS)
    rows = df.select(slot.alias("s")).groupBy(F.expr("bitmap_bucket_number(s + 1)").alias("k")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(s + 1))").alias("bits")).collect()
    out = bytearray(1 << (SLOT_BITS - 3))
    for r in rows:
        at = (r.k - 1) * len(r.bits)
        out[at: at + len(r.bits)] = r.bits
    return bytes(out)


def hits(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the bitmap's column."""
    slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    return (np.frombuffer(bits, np.uint8)[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def settled(docs: DataFrame) -> DataFrame:
    """``docs`` with partitions that are the same each time they are computed.

    A scan is; a plan with a shuffle is written to the shared checkpoint folder.
    """
    if "Exchange" not in docs._jdf.queryExecution().executedPlan().toString():
        return docs
    checkpoint_dir(docs.sparkSession)
    return docs.checkpoint()


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the plan (for a scan: its files)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucket_count(df: DataFrame) -> int:
    """Buckets in proportion to the input; at least the shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return max(least, min(-(-size // BUCKET_BYTES), 1 << 20)) if size < 1 << 50 else least


def blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Numbered blocks of a partition."""
    part = TaskContext.get().partitionId()
    seq = 0
    for batch in batches:
        for piece in X.slices(batch, text):
            yield (part << 24) + seq, piece
            seq += 1


def mark_of(block: pa.RecordBatch, id_col: str, text: str) -> int:
    """Check sum of a block: its rows' ids and text lengths, in order."""
    ids = np.asarray(block.column(block.schema.get_field_index(id_col)).fill_null(-1)).astype(np.int64).view(np.uint64)
    sizes = np.diff(X.text_buffer(block.column(block.schema.get_field_index(text)))[1]).astype(np.uint64)
    place = np.arange(1, len(ids) + 1, dtype=np.uint64)
    return int((X.mix(ids * np.uint64(31) + sizes) * place).sum().view(np.int64)) if len(ids) else 0


def spread(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Cut points of sorted 64-bit keys into ``buckets`` equal hash ranges."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges, side="left"), [len(keys)]))


def rows_of(number: int, mark: int, keys: np.ndarray, extra: Callable | None, p: int) -> Iterator[pa.RecordBatch]:
    """One block's sorted keys as a row for each bucket that owns some of them."""
    cut = spread(keys, p)
    for b in range(p):
        lo, hi = cut[b], cut[b + 1]
        if hi > lo:
            yield pa.RecordBatch.from_arrays([
                pa.array([b], pa.int32()), pa.array([number], pa.int64()), pa.array([mark], pa.int64()),
                pa.array([X.pack_sorted(keys[lo:hi])], pa.binary()), pa.array([extra(lo, hi) if extra else None], pa.binary())],
                names=["bucket", "block", "mark", "keys", "extra"])


def asking(docs: DataFrame, id_col: str, text: str, ask: Callable, p: int) -> DataFrame:
    """Every block's questions; ask(block) -> (sorted uint64 keys, None or a
    function of [lo, hi) that gives the bytes that go with those keys)."""

    def run(batches):
        for number, block in blocks(batches, text):
            yield from rows_of(number, mark_of(block, id_col, text), *ask(block), p)

    return docs.mapInArrow(X.lean(run), ASK)


def answering(asks: DataFrame, answer: Callable) -> DataFrame:
    """Each bucket's answers; answer(list of keys, list of extras) -> one bytes value per list."""

    def run(table: pa.Table) -> pa.Table:
        out = answer([X.unpack_sorted(x) for x in table["keys"].to_pylist()], table["extra"].to_pylist())
        X.give_back()
        return pa.table({"block": table["block"], "bucket": table["bucket"], "mark": table["mark"], "answer": pa.array(out, pa.binary())})

    return asks.groupBy("bucket").applyInArrow(run, ANSWER)


def meeting(docs: DataFrame, id_col: str, text: str, answers: DataFrame, use: Callable, schema: str) -> DataFrame:
    """Blocks with their answers, one per bucket in bucket order.

    use(block, answers, number, mark) -> RecordBatches of ``schema``.
    """

    def held(batches):
        for number, block in blocks(batches, text):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(block)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "held"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for raw in left["held"].to_pylist():
            block = pa.ipc.open_stream(raw).read_all().combine_chunks().to_batches()[0]
            mark = mark_of(block, id_col, text)
            if any(m != mark for m in set(right["mark"].to_pylist())):
                raise RuntimeError("the input's partitions changed between two reads")
            got = sorted(zip(right["bucket"].to_pylist(), right["answer"].to_pylist()))
            out.extend(use(block, [a for _, a in got], left["block"][0].as_py(), mark))
        X.give_back()
        return pa.Table.from_batches(out) if out else empty

    from pyspark.sql.pandas.types import to_arrow_schema

    kept = docs.mapInArrow(X.lean(held), "block long, held binary")
    empty = pa.Table.from_batches([], schema=to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema))
    return kept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def exchange(docs: DataFrame, id_col: str, text: str, ask: Callable, answer: Callable, use: Callable, schema: str, buckets: int | None = None) -> DataFrame:
    """The three steps over ``docs`` (an integer ``id_col``, a string ``text``)."""
    docs = settled(docs.select(id_col, text))
    asks = asking(docs, id_col, text, ask, buckets or bucket_count(docs))
    return meeting(docs, id_col, text, answering(asks, answer), lambda block, got, number, mark: use(block, got), schema)
