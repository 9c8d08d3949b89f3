"""Operator 12, vector code compression: integer product codes with LAESA search.

Method: every component x becomes floor(256 * x); a vector is cut into PARTS
consecutive parts, each coded by the nearest of ENTRIES codebook entries of its
position. The first PIVOTS entries a codebook starts with are fixed pivots.
The squared distances of every part to its pivots are computed once and stored
with the vectors. In each round the pivots' distances to the current entries
give, by the triangle inequality, a lower bound |d(part, pivot) - d(pivot,
entry)| for every entry; entries are tried in the order of their bounds and a
part is done as soon as the next bound exceeds the best exact distance. Exact
distances are integers, and bounds are lowered by more than their rounding
error, so ties go to the lower index as if all entries had been evaluated.

On Spark: one pass stores integers and pivot distances as Parquet in the shared
folder; each round is one scan that emits sums per (position, entry), reduced
by Spark; only the codebooks (ENTRIES vectors) pass through the driver, whose
size no table changes. Sums per label are joined back by label, broadcast only
where Spark measures them as small.

Defined results: rows whose vector is null or holds a null, NaN or infinite
component go. Vectors shorter than the longest kept one, and lengths that are
no multiple of PARTS, count as filled up with zeros; empty vectors are all
zeros. The codebooks start with the smallest ids (a null id starts none; equal
ids in the order of their integers), with fewer than ENTRIES where there are
fewer such rows; without any, the first vectors in the order of their integers
start them. Repeated rows are rows of their own, null labels are one label, an
empty table gives no rows. A component of 2**20 or more in magnitude fails the
query: its squares would leave 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from offerlake.llm.stored import stored

PARTS, ENTRIES, ROUNDS, PIVOTS = 16, 64, 2, 4
SCALE = 256
LARGEST = 1 << 20
CHUNK = 4096  # parts searched at a time
READY = "vec_id long, label int, v array<int>, reach array<long>"
CODED = "vec_id long, label int, code string, error long, evaluated long"


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): the integer vectors of all rows with a whole, finite vector."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    inside = F.when(F.forall(x, lambda c: F.abs(c) < LARGEST), x).otherwise(F.raise_error(F.lit(f"a component is {LARGEST} or more in magnitude")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding")
    return rows.where(x.isNotNull()).where(finite).select(
        "vec_id", "label", F.transform(inside, lambda c: F.floor(c.cast("double") * SCALE).cast("int")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` integers, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten()).astype(np.int64)
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances between the rows of two integer matrices."""
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)


def nearest(part: np.ndarray, reach: np.ndarray, book: np.ndarray, toward: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each part's nearest entry, its squared distance and how many entries were evaluated.

    reach: squared distances part-pivot; toward: squared distances entry-pivot.
    """
    n = len(part)
    near, far = np.sqrt(reach.astype(np.float64))[:, None, :], np.sqrt(toward.astype(np.float64))[None, :, :]
    # lowered by more than the roots' rounding errors
    bound = np.maximum((np.abs(near - far) - 1e-12 * (near + far)).max(axis=2), 0.0) ** 2 * (1 - 1e-12)
    order = np.argsort(bound, axis=1, kind="stable")
    code, best, tried = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    alive = np.arange(n)
    for j in range(len(book)):
        entry = order[alive, j]
        on = bound[alive, entry] <= best[alive]
        alive, entry = alive[on], entry[on]
        if not len(alive):
            break
        d = ((part[alive] - book[entry]) ** 2).sum(axis=1)
        tried[alive] += 1
        better = (d < best[alive]) | ((d == best[alive]) & (entry < code[alive]))
        code[alive[better]], best[alive[better]] = entry[better], d[better]
    return code, best, tried


def coded(batch: pa.RecordBatch, books: np.ndarray, toward: list[np.ndarray], width: int):
    """Per slice of a batch: the rows, their integers, codes, squared distances and evaluations, by part."""
    step = width // PARTS
    for at in range(0, batch.num_rows, CHUNK):
        rows = batch.slice(at, CHUNK)
        v, reach = matrix(rows.column(2), width), matrix(rows.column(3), PARTS * toward[0].shape[1])
        code, best, tried = (np.empty((rows.num_rows, PARTS), np.int64) for _ in range(3))
        for p in range(PARTS):
            pivots = toward[p].shape[1]
            code[:, p], best[:, p], tried[:, p] = nearest(v[:, p * step: (p + 1) * step], reach[:, p * pivots: (p + 1) * pivots], books[p], toward[p])
        yield rows, v, code, best, tried


def refined(ready: DataFrame, books: np.ndarray, pivots: np.ndarray, width: int) -> np.ndarray:
    """One round: every entry becomes the floored mean of the parts nearest to it."""
    n, step = books.shape[1], width // PARTS
    toward = [squares(books[p], pivots[p]) for p in range(PARTS)]

    def add(batches):
        total = np.zeros((PARTS, n, step + 1), np.int64)
        for batch in batches:
            for _, v, code, _, _ in coded(batch, books, toward, width):
                for p in range(PARTS):
                    np.add.at(total[p, :, 0], code[:, p], 1)
                    np.add.at(total[p, :, 1:], code[:, p], v[:, p * step: (p + 1) * step])
        slot = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total.ravel()[slot])], names=["slot", "total"])

    # at most PARTS * ENTRIES * (step + 1) rows: the size of the codebooks, not of the table
    sums = ready.mapInArrow(add, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).collect()
    total = np.zeros(PARTS * n * (step + 1), np.int64)
    for r in sums:
        total[r.slot] = r.total
    total = total.reshape(PARTS, n, step + 1)
    count = total[:, :, :1]
    return np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), books)


def compress(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, evaluated) of every kept row, and the codebooks (part, entry, position)."""
    rows = kept(vectors)
    longest = rows.agg(F.max(F.size("v")).alias("n")).first().n
    if longest is None:
        return rows.sparkSession.createDataFrame([], CODED), np.zeros((PARTS, 0, 0), np.int64)
    width = -(-longest // PARTS) * PARTS
    step = width // PARTS
    first = rows.orderBy(F.col("vec_id").isNull(), "vec_id", "v").limit(ENTRIES).collect()
    first = [r for r in first if r.vec_id is not None] or first
    start = np.array([list(r.v) + [0] * (width - len(r.v)) for r in first], np.int64)
    books = start.reshape(len(first), PARTS, step).transpose(1, 0, 2).copy()
    pivots = books[:, :PIVOTS].copy()

    def measure(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                v = matrix(part.column(2), width)
                reach = np.concatenate([squares(v[:, p * step: (p + 1) * step], pivots[p]) for p in range(PARTS)], axis=1)
                ends = pa.array(np.arange(len(v) + 1) * reach.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, pa.array(reach.ravel()))], names=["vec_id", "label", "v", "reach"])

    ready = stored(rows.mapInArrow(measure, READY), "vector-parts")
    for _ in range(ROUNDS):
        books = refined(ready, books, pivots, width)
    toward = [squares(books[p], pivots[p]) for p in range(PARTS)]

    def write(batches):
        for batch in batches:
            for part, _, code, best, tried in coded(batch, books, toward, width):
                text = [row.tobytes().hex() for row in code.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text), pa.array(best.sum(axis=1)), pa.array(tried.sum(axis=1))],
                                                 names=["vec_id", "label", "code", "error", "evaluated"])

    return stored(ready.mapInArrow(write, CODED), "vector-codes"), books


def query(vectors: DataFrame) -> DataFrame:
    rows, books = compress(vectors)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = rows.join(sums, rows.label.eqNullSafe(sums.of))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
