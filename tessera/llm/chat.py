"""Perspective rotation of multi-party dialogues, in DataFrame functions only.

A dialogue is rendered once for each participant: that speaker as the assistant, every other one as
a named user, fixed roles (system) as they are.  The unit is a message of a rendering, with its text
segment, its place in the rendered string and its loss mask, so a dialogue of any length, for any
number of participants, is never one row or one task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch

#: Roles that aren't participants and keep their own header.
FIXED = ("system",)
OPEN, SEP, CLOSE = "<|", "|>\n", "\n<|end|>\n"
#: Beginnings of texts by which messages are dealt.
PREFIX = 64


def rotate(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", fixed: tuple[str, ...] = FIXED) -> DataFrame:
    """A row for each message of each dialogue's rendering for each participant.

    Returns ``conv_id, perspective, seq, turn, chat_role, name, segment, mask, from_char, to_char``.
    Joining a perspective's segments by ``seq`` gives its rendered string; ``from_char`` and
    ``to_char`` bound the message's own text in it, and ``mask`` is true where the loss counts (the
    perspective's own messages).  ``name`` is null for the assistant and fixed roles.

    Messages sort by turn, role and text, nulls last.  A null text is an empty message; very long ones
    stay whole.  A message with a null role is a nameless user's and makes no perspective.  Messages
    with a null conv_id form one dialogue.  Repeated rows are repeated messages, and are one row until
    the end.  A dialogue without participants, or an empty table, gives no rows.  Other columns are
    ignored, whatever their names.

    Messages are dealt by ranges of their order, so a dialogue with a third of all rows, or one whose
    turns are all equal or null, is many tasks' work; counts and lengths run in two levels, inside
    the ranges and over the ranges' sums.  Texts are joined last, and are in no window.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "chat")
    said = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("speaker"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(text).isNull().alias("untold"))
    said = said.groupBy(*said.columns).agg(F.count("*").alias("copies"))
    order = [F.col("conv_id"), F.asc_nulls_last("turn"), F.asc_nulls_last("speaker"), F.col("untold")]
    ranges = said.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order, F.substring("text", 1, PREFIX)).sortWithinPartitions(*order, "text")
    said = scratch.table(ranges.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("mid")), "said")

    is_fixed = F.coalesce(F.col("speaker").isin(*fixed), F.lit(False)) if fixed else F.lit(False)
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    chat_role = F.when(own, "assistant").when(is_fixed, F.col("speaker")).otherwise("user")
    name = F.when(~own & ~is_fixed, F.col("speaker"))
    head = F.concat(F.lit(OPEN), chat_role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit(SEP))
    people = said.where(F.col("speaker").isNotNull() & ~is_fixed).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    parts = said.select("conv_id", "part").distinct()
    who = people.join(parts, F.col("conv_id").eqNullSafe(F.col("c"))).select("c", F.col("part").alias("p"), "perspective")
    slim = said.select("conv_id", "part", "mid", "copies", "speaker", F.length("text").alias("chars"))
    seen = slim.join(who, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")
    seen = seen.select("conv_id", "part", "mid", "copies", "perspective", F.length(head).cast("long").alias("head"), (F.length(head) + F.col("chars") + F.lit(len(CLOSE))).cast("long").alias("len"))
    rows = Window.partitionBy("conv_id", "perspective", "part").orderBy("mid").rowsBetween(Window.unboundedPreceding, 0)
    seen = seen.select("*", (F.sum("copies").over(rows) - F.col("copies")).alias("nth"), (F.sum(F.col("copies") * F.col("len")).over(rows) - F.col("copies") * F.col("len")).alias("before"))
    over = Window.partitionBy("c", "q").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    bases = seen.groupBy(F.col("conv_id").alias("c"), F.col("perspective").alias("q"), F.col("part").alias("p")).agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("len")).alias("l"))
    bases = bases.select("c", "q", "p", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n0"), F.coalesce(F.sum("l").over(over), F.lit(0)).alias("l0"))
    placed = seen.join(bases, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("q")) & (F.col("part") == F.col("p")))
    placed = placed.select("mid", "perspective", "len", "head", (F.col("n0") + F.col("nth")).alias("nth"), (F.col("l0") + F.col("before")).alias("before"))
    done = placed.join(said.select("mid", "conv_id", "turn", "speaker", "text", "copies"), "mid").select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("k"))
    start = F.col("before") + F.col("k") * F.col("len") + F.col("head")
    return done.select("conv_id", "perspective", (F.col("nth") + F.col("k") + 1).cast("long").alias("seq"), "turn", chat_role.alias("chat_role"), name.alias("name"), F.concat(head, "text", F.lit(CLOSE)).alias("segment"), own.alias("mask"), start.cast("long").alias("from_char"), (start + F.length("text")).cast("long").alias("to_char"))
