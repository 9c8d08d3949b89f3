"""Operator 11, conversation prefix trie by composable fingerprints.

Conversation c is rebuilt from a head, the first h turns of conversation
c - c % EVERY, and its own turns after its first h; h = crc32(c) % HEADS. Every
distinct sequence of first d rebuilt turns is a node of the trie.

Method: a sequence's fingerprint is the monoid product of its turns', kept as
(length, sum of value * BASE**place modulo a prime) in three lanes; (m, x)
times (n, y) is (m + n, x + y * BASE**m). The turns' running products are
computed once per stored conversation. Those of a rebuilt one follow from them
symbolically, head product times own suffix product, so that no rebuilt text
exists anywhere: a rebuilt turn is a depth, a fingerprint and a reference (the
digests of a stored turn). Rows of equal depth and fingerprint are one node.
Equality is verified, not assumed: a digest that stands for two texts, or a
node whose members differ in their last turn or in their parent, fails the
query, and so by induction equal nodes are equal sequences.

Skew: turns are sorted into ranges of (conversation, turn, role, text), so a
conversation of any length spreads over tasks; a range's product is one row,
and the products of the ranges before it are combined for each. Counts and
smallest members are reduced before they move. Sums over subtrees use pointer
doubling over the nodes with two members or more (a node with one has one leaf
and saves nothing): as many rounds as the depth has binary digits. The ids of a
node's ends are written in blocks of 4096 ids and hashed as a stream.

Defined results: rows without conv_id belong to no conversation. Null turns
come first; rows of one turn number are ordered by role and text. Null role
and text are empty. Repeated rows are turns of their own. Empty texts are turns
without words. An empty table has no node. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from offerlake.llm.stored import stored

EVERY, HEADS = 20, 4
#: Modulus and base of each fingerprint lane.
LANES = ((2147483647, 911382323), (2147483629, 972663749), (2147483587, 763549867))
FIRST, BEFORE, DIGESTS = ["p0", "p1", "p2"], ["q0", "q1", "q2"], ["h1", "h2"]
BLOCK_BITS = 12


def powers(exponent: str, lane: int) -> str:
    """SQL of BASE ** exponent modulo the lane's prime, for 0 <= exponent < 2**32."""
    p, base = LANES[lane]
    out = ""
    for byte in range(4):
        table = ", ".join(f"{pow(base, e << (8 * byte), p)}L" for e in range(256))
        digit = f"array({table})[CAST(shiftright({exponent}, {8 * byte}) & 255 AS INT)]"
        out = f"({out} * {digit}) % {p}" if out else digit
    return out


def turns(conversations: DataFrame) -> DataFrame:
    """Turns in order: conv_id, at (a number in the order of the whole table), digests, n_words.

    Texts are sorted into ranges and written without them; ``at >> 33`` is the range.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.where("conv_id is not null").withColumn("copy", F.monotonically_increasing_id())
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return stored(dealt.select("conv_id", F.monotonically_increasing_id().alias("at"), F.xxhash64(F.lit(1), "role", "text").alias("h1"),
                               F.xxhash64(F.lit(2), "text", "role").alias("h2"), words.alias("n_words")), "trie-turns")


def verify_digests(conversations: DataFrame) -> None:
    """Fail if one pair of digests stands for two different turns."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(role.alias("role"), text.alias("text"))
    per = rows.groupBy(F.xxhash64(F.lit(1), "role", "text"), F.xxhash64(F.lit(2), "text", "role")).agg(
        *[f(c).alias(f"{n}_{c}") for c in ("role", "text") for n, f in (("lo", F.min), ("hi", F.max))])
    if not per.where("lo_role != hi_role or lo_text != hi_text").isEmpty():
        raise RuntimeError("two different turns have the same digests")


def products(stored_turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every turn with its place and its conversation's products up to it (p) and before it (q);
    and one row per conversation and range, with its number of turns."""
    per = Window.partitionBy("part", "conv_id").orderBy("at")
    rows = stored_turns.withColumn("part", F.shiftright("at", 33)).withColumn("nth", F.row_number().over(per).cast("long") - 1)
    for k, (p, _) in enumerate(LANES):
        rows = rows.withColumn(f"v{k}", F.expr(f"(pmod(xxhash64({k}, h1, h2), {p - 1}) + 1) * ({powers('nth', k)}) % {p}"))
    run = per.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in range(len(LANES)):
        rows = rows.withColumn(f"s{k}", F.sum(f"v{k}").over(run))
    ranges = rows.groupBy("part", "conv_id").agg(F.count("*").alias("n"), *[F.sum(f"v{k}").alias(f"t{k}") for k in range(len(LANES))])
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ranges.withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")))
    for k, (p, _) in enumerate(LANES):
        carry = carry.withColumn(f"w{k}", F.expr(powers("ahead", k)))
        carry = carry.withColumn(f"c{k}", F.coalesce(F.sum(F.expr(f"(t{k} % {p}) * w{k} % {p}")).over(earlier), F.lit(0)) % p)
    known = carry.drop("n", "t0", "t1", "t2")
    rows = rows.join(known, ["part", "conv_id"])
    out = rows.select("conv_id", "part", (F.col("ahead") + F.col("nth")).alias("place"), *DIGESTS, "n_words",
                      *[F.expr(f"(c{k} + (s{k} % {p}) * w{k}) % {p}").alias(f"p{k}") for k, (p, _) in enumerate(LANES)],
                      *[F.expr(f"(c{k} + ((s{k} - v{k}) % {p}) * w{k}) % {p}").alias(f"q{k}") for k, (p, _) in enumerate(LANES)])
    done = stored(out, "trie-products")
    return done, done.groupBy("conv_id", "part").agg(F.count("*").alias("n"))


def _pick(prefix: str, n: Column, field: str) -> Column:
    """Field of the n-th (from 1) of the first turns, whose structs are named prefix0, prefix1, ..."""
    out = F.lit(None).cast("long")
    for i in range(HEADS - 1):
        out = F.when(n == i + 1, F.col(f"{prefix}{i}.{field}")).otherwise(out)
    return out


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Rows of all rebuilt conversations: conv_id, depth, fingerprint p, parent's q, digests, n_words, whether it ends here."""
    verify_digests(conversations)
    rows, ranges = products(turns(conversations))
    lengths = ranges.groupBy("conv_id").agg(F.sum("n").alias("n_own"))
    fields = F.struct(*DIGESTS, "n_words", *FIRST)
    heads = rows.where(F.col("place") < HEADS - 1).groupBy("conv_id").agg(
        *[F.max(F.when(F.col("place") == i, fields)).alias(f"f{i}") for i in range(HEADS - 1)])
    summary = stored(lengths.join(heads, "conv_id"), "trie-conversations")
    base = summary.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"), *[F.col(f"f{i}").alias(f"b{i}") for i in range(HEADS - 1)])
    plan = summary.withColumn("base", F.col("conv_id") - F.col("conv_id") % EVERY).join(base, "base", "left")
    plan = plan.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    plan = plan.withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))))
    plan = plan.withColumn("total", F.col("k") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0).cast("long")))
    zero = F.lit(0).cast("long")
    for i in range(len(LANES)):
        plan = plan.withColumn(f"head{i}", F.coalesce(_pick("b", F.col("k"), f"p{i}"), zero)).withColumn(f"own{i}", F.coalesce(_pick("f", F.col("h"), f"p{i}"), zero))
    plan = stored(plan, "trie-heads")

    none = F.lit(None).cast("long")
    tops = plan.select("conv_id", zero.alias("depth"), *[zero.alias(c) for c in FIRST], *[none.alias(c) for c in BEFORE + DIGESTS], zero.alias("n_words"), (F.col("total") == 0).alias("ends"))
    step = F.explode(F.array(*[F.struct(F.lit(i + 1).cast("long").alias("depth"), F.col(f"b{i}").alias("t"),
                                        F.struct(*[(F.col(f"b{i - 1}.{c}") if i else zero).alias(c) for c in FIRST]).alias("up")) for i in range(HEADS - 1)]))
    head = plan.select("conv_id", "k", "total", step.alias("s")).where("s.depth <= k").select(
        "conv_id", "s.depth", *[F.col(f"s.t.{c}").alias(c) for c in FIRST], *[F.col(f"s.up.{c}").alias(q) for c, q in zip(FIRST, BEFORE)],
        *[F.col(f"s.t.{c}").alias(c) for c in DIGESTS], F.col("s.t.n_words").alias("n_words"), (F.col("s.depth") == F.col("total")).alias("ends"))
    # a long conversation's plan is joined once per range, so that no key holds more than one range
    wide = ranges.select("conv_id", "part").join(plan.select("conv_id", "h", "k", "total", *[f"{x}{i}" for x in ("head", "own") for i in range(len(LANES))]), "conv_id")
    own = rows.join(wide, ["conv_id", "part"]).where("place >= h")
    shift = [f"element_at(array({', '.join(f'{pow(pow(b, -1, p), e, p)}L' for e in range(HEADS))}), CAST(h - k + 1 AS INT))" for p, b in LANES]
    depth = F.expr("k + place - h + 1")
    tail = own.select("conv_id", depth.alias("depth"),
                      *[F.expr(f"(head{i} + pmod(p{i} - own{i}, {p}) * {shift[i]}) % {p}").alias(f"p{i}") for i, (p, _) in enumerate(LANES)],
                      *[F.expr(f"(head{i} + pmod(q{i} - own{i}, {p}) * {shift[i]}) % {p}").alias(f"q{i}") for i, (p, _) in enumerate(LANES)],
                      *DIGESTS, "n_words", (depth == F.col("total")).alias("ends"))
    return stored(tops.unionByName(head).unionByName(tail), "trie-rebuilt")


def _nodes(rows: DataFrame) -> DataFrame:
    """One row per node, its members verified to be equal."""
    key = ["depth", *FIRST]
    checked = DIGESTS + BEFORE
    per = rows.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("n_words").alias("n_words"),
                                 *[f(c).alias(f"{n}_{c}") for c in checked for n, f in (("lo", F.min), ("hi", F.max))])
    same = " and ".join(f"lo_{c} <=> hi_{c}" for c in checked)
    sure = F.when(F.expr(same), F.col("conv_id")).otherwise(F.raise_error(F.lit("two different prefixes have the same fingerprint")))
    return per.select(*key, sure.alias("conv_id"), "n_convs", "n_words", *[F.col(f"lo_{c}").alias(c) for c in BEFORE])


def _summed(nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of the nodes with several members, over their subtrees.

    After round k a node holds the sums of its descendants within distance
    2 ** k and points at its ancestor at that distance.
    """
    shared = nodes.where("n_convs > 1")
    now = stored(shared.select("conv_id", "depth", F.col("parent_conv_id").alias("up"), (F.col("n_single") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
                               ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved_tokens")), "trie-sums")
    deepest = now.agg(F.max("depth").alias("d")).first().d or 0
    far = 1
    while far <= deepest:
        above = now.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("conv_id"), (F.col("depth") - far).alias("depth")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_tokens"))
        ahead = now.select(F.col("conv_id").alias("up"), F.col("depth").alias("at"), F.col("up").alias("next"))
        moving = now.where(F.col("depth") >= 2 * far).withColumn("at", F.col("depth") - far).join(ahead, ["up", "at"], "left")
        pointed = moving.select("conv_id", "depth", F.col("next").alias("up"), "n_leaves", "saved_tokens").unionByName(
            now.where(F.col("depth") < 2 * far).withColumn("up", F.lit(None).cast("long")))
        now = stored(pointed.join(above, ["conv_id", "depth"], "left").select(
            "conv_id", "depth", "up", (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("more_tokens", F.lit(0))).alias("saved_tokens")), "trie-sums")
        far *= 2
    return now.select("conv_id", "depth", "n_leaves", "saved_tokens")


def _end_hashes(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, ascending and joined by commas, as a stream over id blocks."""
    key = ["depth", *FIRST]
    blocks = rows.where("ends").groupBy(*key, F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def digest(batches):
        held, state = None, None
        for batch in batches:
            out = []
            cells = [batch.column(i).to_pylist() for i in range(len(key))]
            for *node, ids in zip(*cells, batch.column(len(key) + 1).to_pylist()):
                if node != held:
                    if held is not None:
                        out.append((*held, state.hexdigest()))
                    held, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield rows_of(out)
        if held is not None:
            yield rows_of([(*held, state.hexdigest())])

    def rows_of(out):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string() if i == len(key) else pa.int64()) for i, c in enumerate(zip(*out))], names=[*key, "ends_sha256"])

    sorted_blocks = blocks.repartition(*key).sortWithinPartitions(*key, "block")
    return sorted_blocks.mapInArrow(digest, ", ".join(f"{c} long" for c in key) + ", ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the rebuilt conversations' trie."""
    rows = rebuilt(conversations)
    key = ["depth", *FIRST]
    found = stored(_nodes(rows), "trie-nodes")
    up = [(F.col("depth") - 1).alias("depth"), *[F.col(q).alias(p) for p, q in zip(FIRST, BEFORE)]]
    children = found.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"), F.sum((F.col("n_convs") == 1).cast("long")).alias("n_single"))
    nodes = found.join(children, key, "left").fillna(0, ["n_children", "n_single"])
    parents = found.select((F.col("depth") + 1).alias("depth"), *[F.col(p).alias(q) for p, q in zip(FIRST, BEFORE)], F.col("conv_id").alias("parent_conv_id"))
    nodes = stored(nodes.join(parents, ["depth", *BEFORE], "left"), "trie-linked")
    out = nodes.join(_summed(nodes), ["conv_id", "depth"], "left").join(_end_hashes(rows), key, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
                      F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def query(conversations: DataFrame) -> DataFrame:
    return prefix_trie(conversations)
