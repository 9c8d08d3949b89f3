"""Operator 3, chat formatting: multi-party perspective rotation.

Method: for every speaker of a conversation the dialogue is rendered once with
that speaker as the assistant and every other speaker as a named user; only
the assistant's words (and the end mark that closes them) are marked for
training. Built-in DataFrame functions only.

A conversation is rendered in pieces of PIECE_TURNS turn numbers, so that one
of any length never has to fit into one row; ordinary conversations are one
piece. A piece begins with the turns of the CONTEXT_TURNS turn numbers before
it as context, which is rendered but never trained. A *hot* piece of more than
PART_ROWS turns (ties, null turns, the null conversation) is cut into parts of
PART_ROWS by running position: hot rows alone are sorted into ranges and
numbered, one row per piece and range links the numbers, so that a piece with
a third of all rows is spread over as many tasks as its size asks for.

Texts are shuffled once, by (conv_id, piece, part), those of hot pieces twice
more; which pieces are hot and which speakers a conversation has is worked out
on narrow rows.

Defined results: null text is empty; a null role is the speaker "unknown"; a
role in SYSTEM_ROLES is no participant, its turns stay system turns and are
never trained; a conversation with system turns only gives one row with null
perspective; a null conv_id is one conversation of its own; null turns come
first, in a piece of their own (piece null), and are no context; ties of turn are
ordered by role and text, and repeated rows are repeated turns. The first part
of a piece has the context, the others none, and hot pieces are no context for
the next. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from offerlake.llm.stored import stored

PIECE_TURNS = 64
CONTEXT_TURNS = 8
PART_ROWS = 256
SYSTEM_ROLES = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _segment(turn: Column, perspective: Column) -> Column:
    """head (never trained), body, whether the body is trained."""
    role = turn["role"]
    mine = role.eqNullSafe(perspective)
    head = F.concat(F.lit(OPEN), F.when(role.isin(*SYSTEM_ROLES), F.lit("system")).when(mine, F.lit("assistant"))
                    .otherwise(F.concat(F.lit("user name="), role)), F.lit("\n"))
    return F.struct(head.alias("head"), F.concat(turn["text"], F.lit(CLOSE)).alias("body"), (mine & ~turn["context"]).alias("mine"))


def parted(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The turns of hot pieces with their part, by running position in (turn, role, text)."""
    order = ["conv_id", "piece", "turn", "role", "text"]
    # the row number ends the order, so that equal turns can lie in several ranges
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie")
    at = F.monotonically_increasing_id()
    placed = stored(ranged.drop("tie").withColumn("at", at).withColumn("run", F.struct("conv_id", "piece", F.shiftright("at", 33).alias("range"))), "chat-hot")
    # a piece's rows in a range have consecutive numbers
    runs = placed.groupBy("run").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("run.conv_id", "run.piece").orderBy("run.range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("run", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.col("at") - F.col("first") + F.col("before")
    return placed.join(runs, "run").withColumn("part", F.floor(place / part_rows)).select(*order, "part")


def rotate(turns: DataFrame, piece_turns: int = PIECE_TURNS, context_turns: int = CONTEXT_TURNS, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per (conv_id, piece, part, perspective): text, trained spans, counts.

    Spans are [start, end) code points of the row's text.
    """
    t = turns.select(
        "conv_id", F.floor(F.col("turn") / piece_turns).alias("piece"), "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.struct("conv_id", "piece").alias("key")  # a struct is equal to another where nulls are
    speakers = (t.where(~F.col("role").isin(*SYSTEM_ROLES)).select(F.struct("conv_id").alias("talk"), F.col("role").alias("perspective")).distinct())
    cells = t.groupBy(key).agg(F.count("*").alias("n"))
    pieces = cells.select("key", F.struct("key.conv_id").alias("talk"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / part_rows))).alias("part"))
    views = pieces.join(speakers, "talk", "left").select("key", "part", "perspective")

    # a written table has a known size: the planner broadcasts a short list, and shuffles texts for a long one only
    hot = stored(cells.where(F.col("n") > part_rows).select("key"), "chat-hot-pieces")
    keyed = t.withColumn("key", key)
    cut = parted(keyed.join(hot, "key", "left_semi").drop("key"), part_rows)
    calm = keyed.join(hot, "key", "left_anti")
    here = F.struct("piece", F.lit(False).alias("context"))
    late = F.col("turn") - F.col("piece") * piece_turns >= piece_turns - context_turns
    there = F.struct((F.col("piece") + 1).alias("piece"), F.lit(True).alias("context"))
    both_ways = calm.withColumn("to", F.explode(F.when(late, F.array(here, there)).otherwise(F.array(here))))
    placed = both_ways.select("conv_id", "to.piece", F.lit(0).cast("long").alias("part"), "turn", "role", "text", "to.context").unionByName(
        cut.withColumn("context", F.lit(False)))

    held = placed.groupBy(key, "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "context"))).alias("turns"))
    both = held.join(views, ["key", "part"])  # a piece that holds nothing but context has no view
    parts = both.withColumn("parts", F.transform("turns", lambda x: _segment(x, F.col("perspective"))))
    empty = F.array().cast("array<struct<start:long,end:long>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["head"])
        end = start + F.char_length(p["body"])
        spans = F.when(p["mine"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans"))
    context = F.size(F.filter("turns", lambda x: x["context"])).cast("long")
    return parts.select(
        "key.conv_id", "key.piece", "part", "perspective",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("text"),
        F.aggregate("parts", zero, step, lambda a: a["spans"]).alias("spans"),
        (F.size("parts") - context).alias("n_turns"), context.alias("n_context"))


def query(turns: DataFrame) -> DataFrame:
    """The rotated dialogues with their mask as text: "start-end" runs joined by commas."""
    out = rotate(turns)
    runs = F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return out.select("conv_id", "piece", "part", "perspective", "text", F.array_join(runs, ",").alias("train_spans"),
                      F.size("spans").cast("long").alias("n_trained"), "n_turns", "n_context")
