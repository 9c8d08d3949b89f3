"""Operator 8, MinHash near-dedup with sequential Bayesian verification.

Method: documents with equal shingle sets form a class; each class is one
signature of HASHES minima, banded into BANDS keys. Classes that share a key
are candidates. A candidate pair's signatures are compared batch by batch and
the pair is dropped once the posterior probability that its similarity reaches
the threshold falls below MISS; survivors are verified on their full shingle
sets. Links are contracted to connected components.

No bucket is expanded into all its pairs. Round one verifies, for every class,
the pair with the smallest class it shares a key with; members of a bucket that
are then joined need no more comparison. What is left are pairs of differently
labelled classes inside a bucket. Buckets of up to SMALL members list them.
The members of larger buckets go, once each, with their shingle sets to blocks
of about BLOCK; blocks that share a bucket are compared, signature matrix
against signature matrix and then set against set, and give at most the links
that join two components, fewer than they have members.

A class is known by one of its rows, so rows of one doc_id may hold different
texts. Sets are made for verification only where a bitmap of fixed size says
that the document shares a key with another; they are written once.

Defined results: text without words has an empty set, is linked with nothing
and kept; texts of under WIDTH words are one shingle; a null doc_id is linked
with nothing, has a null component and is kept; repeated rows give one result
row each; rows of one doc_id are one document, whose texts are linked with each
other; the shingles are compared by 64-bit hash. Other columns are ignored.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from offerlake.llm import exchange as E, textops as X
from offerlake.llm.graph import components
from offerlake.llm.stored import stored
from offerlake.session import checkpoint_dir

WIDTH = 5
HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
BATCH = 16
MISS = 1e-6
SMALL, BLOCK = 32, 256
CHUNK = 1 << 15
SLICE_BYTES = 1 << 21  # text bytes shingled at a time
SET_KEY = ["n_shingles", "d1", "d2"]
PROFILE = "row long, doc_id long, n_shingles long, d1 long, d2 long, sig binary, bands array<long>"


def shingles(buf: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row and their rows, in row order."""
    buf = X.LOWER[buf]
    starts, ends, row = X.word_spans(buf, offsets)
    words = X.word_hashes(buf, starts, ends)
    keys, at = X.windows(words, row, width)
    rows = row[at]
    size = np.bincount(row, minlength=len(offsets) - 1) if len(row) else np.zeros(len(offsets) - 1, np.int64)
    short = (size[row] < width) if len(row) else np.zeros(0, bool)
    if short.any():
        w, r = words[short], row[short]
        for n in range(1, width):
            mine = size[r] == n
            if mine.any():
                k, i = X.windows(w[mine], r[mine], n)
                keys, rows = np.concatenate([keys, k]), np.concatenate([rows, r[mine][i]])
    both = X.mix(keys ^ X.mix(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both)
    pick = order[X.group_starts(both[order])]
    pick = pick[np.argsort(rows[pick], kind="stable")]
    return keys[pick], rows[pick]


def _functions() -> tuple[np.ndarray, np.ndarray]:
    seeds = X.mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
    return seeds[:HASHES] | np.uint64(1), seeds[HASHES:]


def signatures(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """MinHash signatures (uint32, rows x HASHES) of non-empty consecutive sets."""
    mult, add = _functions()
    out = np.empty((len(sizes), HASHES), np.uint32)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        part = keys[base: ends[to - 1]]
        begin = (ends[at:to] - sizes[at:to] - base).astype(np.int64)
        for i in range(HASHES):
            out[at:to, i] = np.minimum.reduceat(((part * mult[i] + add[i]) >> np.uint64(32)).astype(np.uint32), begin)
        at = to
    return out


def digests(keys: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of consecutive sets; 0 for empty ones."""
    full = np.flatnonzero(size)
    d1, d2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
    if len(full):
        begin = np.cumsum(size[full]) - size[full]
        d1[full] = np.add.reduceat(X.mix(keys + np.uint64(1)), begin)
        d2[full] = np.bitwise_xor.reduceat(X.mix(keys ^ np.uint64(X.BASE)), begin)
    return d1, d2


def profiles(docs: DataFrame) -> DataFrame:
    """Per row: a number, id, set size, set digests, 16-bit signature, band keys."""

    def make(batches):
        salt = X.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for block in X.slices(batch, "text", SLICE_BYTES):
                buf, offsets = X.text_buffer(block.column(1))
                keys, rows = shingles(buf, offsets)
                size = np.bincount(rows, minlength=block.num_rows).astype(np.int64)
                full = np.flatnonzero(size)
                d1, d2 = digests(keys, size)
                sig, bands = [None] * block.num_rows, [None] * block.num_rows
                if len(full):
                    s = signatures(keys, size[full])
                    short = s.astype(np.uint16)
                    pairs = s.reshape(len(full), BANDS, ROWS).astype(np.uint64)
                    key = np.broadcast_to(salt, (len(full), BANDS)).copy()
                    for j in range(ROWS):
                        key = X.mix(key ^ (pairs[:, :, j] + np.uint64(j)))
                    key = key.view(np.int64)
                    for k, r in enumerate(full.tolist()):
                        sig[r], bands[r] = short[k].tobytes(), key[k]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(at, at + block.num_rows)), block.column(0), pa.array(size), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                    pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["row", "doc_id", "n_shingles", "d1", "d2", "sig", "bands"])
                at += block.num_rows

    return docs.mapInArrow(X.lean(make), PROFILE)


def least_matches(percent: int, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes seen, matches needed): fewer mean P(similarity >= threshold) < miss.

    With a uniform prior the posterior is a Beta distribution, and
    P(s >= t | m of n) = P(Binomial(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def _bayes(left: np.ndarray, right: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Which of the aligned signature pairs survive all batches."""
    alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int64), 0
    for n, need in bounds:
        matches[alive] += (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        alive, done = alive[matches[alive] >= need], n
    return alive


def _matrix(column: pa.Array) -> np.ndarray:
    buf, _ = X.text_buffer(column)
    return np.frombuffer(buf.tobytes(), np.uint16).reshape(-1, HASHES)


def survivors(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) that pass the size bound and the posterior bounds."""
    bounds = least_matches(percent)

    def prune(batches):
        for batch in batches:
            keep = _bayes(_matrix(batch.column(2)), _matrix(batch.column(3)), bounds)
            out = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1)], names=["a", "b"])

    left = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return both.select("a", "b", "sa", "sb").mapInArrow(X.lean(prune), "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose full shingle sets reach the threshold."""

    def exact(batches):
        for batch in batches:
            for part in X.slices(batch, "sa", SLICE_BYTES):
                n, flat = part.num_rows, []
                for i in (2, 3):
                    buf, offsets = X.text_buffer(part.column(i))
                    rows = np.repeat(np.arange(n), np.diff(offsets) // 8)
                    flat.append((X.mix(np.frombuffer(buf.tobytes(), np.uint64) ^ X.mix(rows.astype(np.uint64) + np.uint64(1))), rows))
                (ka, ra), (kb, rb) = flat
                shared = np.bincount(ra[np.isin(ka, kb)], minlength=n)
                union = np.bincount(ra, minlength=n) + np.bincount(rb, minlength=n) - shared
                out = part.take(pa.array(np.flatnonzero((100 * shared >= percent * union) & (shared > 0))))
                yield pa.RecordBatch.from_arrays([out.column(0), out.column(1)], names=["a", "b"])

    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(X.lean(exact), "a long, b long")


def _listed(few: DataFrame) -> DataFrame:
    """Pairs of different components in small buckets."""
    left = few.select("key", F.col("rep").alias("a"), F.col("comp").alias("ca"))
    right = few.select("key", F.col("rep").alias("b"), F.col("comp").alias("cb"))
    return left.join(right, "key").where("a > b and ca != cb").select("a", "b").distinct()


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, set): the sorted shingle hashes, as bytes, of the classes in ``wanted`` (rep, doc_id, set_key)."""
    bits = E.bitmap(wanted.select(F.xxhash64("doc_id").alias("h")), "h")

    def make(batches):
        for batch in batches:
            some = batch.filter(pa.array(E.hits(bits, np.asarray(batch.column(0)).view(np.uint64)))).select([1])
            for block in X.slices(some, "text", SLICE_BYTES):
                keys, rows = shingles(*X.text_buffer(block.column(0)))
                size = np.bincount(rows, minlength=block.num_rows).astype(np.int64)
                d1, d2 = digests(keys, size)
                cut = np.concatenate(([0], np.cumsum(size))).tolist()
                sets = [np.sort(keys[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(sets, pa.binary())], names=[*SET_KEY, "set"])

    numbered = docs.where("doc_id is not null").select(F.xxhash64("doc_id").alias("h"), "text")
    made = numbered.mapInArrow(X.lean(make), "n_shingles long, d1 long, d2 long, set binary")
    return stored(wanted.select("rep", *SET_KEY).join(made, SET_KEY).select("rep", "set").dropDuplicates(["rep"]), "shingle-sets")


def _links_of_blocks(one, two, same: bool, percent: int, bounds) -> list[tuple[int, int]]:
    """Links between two blocks that join components not joined before."""
    (rx, cx, sx, tx), (ry, cy, sy, ty) = one, two
    sizes, found = np.array([len(t) for t in ty]), []
    for i in range(len(rx)):
        other = np.flatnonzero((cy != cx[i]) & ((ry < rx[i]) if same else True))
        n = len(tx[i])
        other = other[100 * np.minimum(sizes[other], n) >= percent * np.maximum(sizes[other], n)]
        other = other[_bayes(np.broadcast_to(sx[i], (len(other), HASHES)), sy[other], bounds)]
        if not len(other):
            continue
        flat = np.concatenate([ty[j] for j in other])
        at = np.minimum(np.searchsorted(tx[i], flat), n - 1)
        shared = np.add.reduceat((tx[i][at] == flat).astype(np.int64), np.cumsum(sizes[other]) - sizes[other])
        for j in other[100 * shared >= percent * (sizes[other] + n - shared)].tolist():
            if cx[i] != cy[j]:
                found.append((max(rx[i], ry[j]), min(rx[i], ry[j])))
                old, new = max(cx[i], cy[j]), min(cx[i], cy[j])
                cx[cx == old], cy[cy == old] = new, new
    return found


def _blocked(many: DataFrame, signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components in large buckets; many: key, size, rep, comp."""
    bounds = least_matches(percent)
    home = many.groupBy("rep").agg(F.max(F.struct("size", "key")).alias("h"), F.min("comp").alias("comp"))
    home = home.select("rep", "comp", F.xxhash64("h.key", F.pmod(F.xxhash64("rep"), F.ceil(F.col("h.size") / BLOCK))).alias("blk"))
    at = many.select("key", "rep").join(home.select("rep", "blk"), "rep").select("key", "blk").distinct()
    pairs = at.join(at.select("key", F.col("blk").alias("blk2")), "key").where("blk <= blk2").select("blk", "blk2").distinct()
    rows = home.join(signed.select("rep", "sig"), "rep").join(sets, "rep")
    blocks = rows.groupBy("blk").agg(F.collect_list(F.struct("rep", "comp", "sig", "set")).alias("rows"))
    twin = blocks.select(F.col("blk").alias("blk2"), F.col("rows").alias("rows2"))

    def read(cell):
        v = cell.values
        return (np.asarray(v.field("rep")), np.array(v.field("comp")), _matrix(v.field("sig")), [np.frombuffer(x, np.uint64) for x in v.field("set").to_pylist()])

    def compare(batches):
        for batch in batches:
            for x, y, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                one = read(x)
                two = one if same else read(y)
                found = _links_of_blocks(one, two, same, percent, bounds)
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    joined = pairs.join(blocks, "blk").join(twin, "blk2").select("rows", "rows2", (F.col("blk") == F.col("blk2")).alias("same"))
    return joined.mapInArrow(X.lean(compare), "a long, b long")


def _same_document(some: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between the classes that rows of one doc_id belong to, named by their smallest ids."""
    per = some.groupBy("doc_id").agg(*[f(c).alias(f"{n}_{c}") for c in SET_KEY for n, f in (("lo", F.min), ("hi", F.max))])
    several = per.where(" or ".join(f"lo_{c} != hi_{c}" for c in SET_KEY)).select("doc_id")
    own = some.join(several, "doc_id").select("doc_id", *SET_KEY).distinct().join(reps.select("least", *SET_KEY), SET_KEY)
    return own.select(F.col("least").alias("a"), F.col("doc_id").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = profiles(docs).checkpoint()
    some = made.where("n_shingles > 0 and doc_id is not null")
    reps = some.groupBy(*SET_KEY).agg(F.min("row").alias("rep"), F.min("doc_id").alias("least"))
    classes = (some.drop("doc_id").join(reps, SET_KEY).where("row = rep")
               .select("rep", "least", *SET_KEY, F.col("n_shingles").alias("n"), "sig", "bands").checkpoint())
    banded = classes.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("center")).where("size > 1")
    members = banded.join(shared, "key").checkpoint()
    wanted = members.select("rep").distinct().join(classes.select("rep", F.col("least").alias("doc_id"), *SET_KEY), "rep")
    sets = shingle_sets(docs, wanted)

    signed = classes.select("rep", "n", "sig")
    first = members.where("rep != center").groupBy(F.col("rep").alias("a")).agg(F.min("center").alias("b"))
    links = verified(survivors(first, signed, percent), sets, percent).checkpoint()
    # labels only spare comparisons here: the class a class was linked to, followed for a few steps
    step = links.select(F.col("a").alias("rep"), F.col("b").alias("comp"))
    for _ in range(2):
        on = step.select(F.col("rep").alias("comp"), F.col("comp").alias("next"))
        step = step.join(on, "comp", "left").select("rep", F.coalesce("next", "comp").alias("comp"))
    placed = members.join(step, "rep", "left").select("key", "size", "rep", F.coalesce("comp", "rep").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    left_over = placed.join(mixed, "key").checkpoint()
    listed = verified(survivors(_listed(left_over.where(F.col("size") <= SMALL)), signed, percent), sets, percent)
    blocked = _blocked(left_over.where(F.col("size") > SMALL), signed, sets, percent)
    # a class goes by its smallest id from here on: classes of one such id share that document
    name = classes.select("rep", "least")
    named = links.unionByName(listed).unionByName(blocked).join(name.select(F.col("rep").alias("a"), F.col("least").alias("x")), "a").join(
        name.select(F.col("rep").alias("b"), F.col("least").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = components(named.unionByName(_same_document(some, reps)))

    whole = reps.join(found.select(F.col("node").alias("least"), "component"), "least", "left").select(
        *SET_KEY, F.coalesce("component", "least").alias("component"))
    out = made.select("doc_id", *SET_KEY).join(whole, SET_KEY, "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, 85)
