"""Chat formatting: every dialogue from every participant's side, with loss
masks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def perspectives(messages: DataFrame, context_roles: tuple[str, ...] = ("system",), part_size: int = 512) -> DataFrame:
    """``(conv_id, speaker, part, n_messages, text, mask)``: the dialogue with
    ``speaker`` as the assistant.

    A participant is any role but null and ``context_roles``. The speaker's own
    messages open with ``assistant``, context messages with their role, all
    others with ``user name=<role>`` (white space and ``<|>`` in a name become
    ``_``; a null role is ``user``). ``mask`` lists the character spans
    ``start:end`` (end exclusive, in ``text``) to be learned: the speaker's
    texts with their end marks; all else is masked out. ``<|`` inside a text is
    written ``< |``.

    Messages go by turn (null first), then role and text; every row is a message,
    also one that repeats another in full (equal messages are counted before they
    are sorted and dealt out again after), and a null text is empty. A dialogue is
    rendered whole up to ``part_size`` messages and goes on in further parts
    beyond, so one huge conversation is cut into rows of bounded size and never
    meets in one task: messages are numbered from a range partitioning by
    conversation and order. Messages with a null conversation form one dialogue; a
    null or empty role speaks like any other but a null one has no perspective. A
    conversation without a participant, and an empty table, has no rows. Very long
    texts are rendered whole. Other columns are not read.
    """
    key = ["conv_id", "turn", "role", "body"]
    said = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role",
                           F.coalesce(F.col("text"), F.lit("")).alias("body")).groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    dealt = materialize(said.repartitionByRange(*key).withColumn("slice", F.spark_partition_id()), "dealt")
    # number the messages: inside a conversation's slice, then past the slices before
    inside = Window.partitionBy("conv_id", "slice").orderBy("turn", "role", "body")
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (dealt.groupBy("conv_id", "slice").agg(F.sum("copies").alias("n"))
             .select(F.col("conv_id").alias("c"), F.col("slice").alias("s"),
                     F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    ends = (dealt.withColumn("i", F.sum("copies").over(inside))
            .join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("slice") == F.col("s")))
            .select("conv_id", "role", "body", (F.col("first") + F.col("i") - F.col("copies")).alias("lo"),
                    (F.col("first") + F.col("i") - 1).alias("hi")))
    # the copies of a message: first the parts they reach, then their places in a part
    part = F.floor(F.col("lo") / part_size), F.floor(F.col("hi") / part_size)
    numbered = (ends.withColumn("part", F.explode(F.sequence(*part)))
                .withColumn("i", F.explode(F.sequence(F.greatest("lo", F.col("part") * part_size),
                                                      F.least("hi", (F.col("part") + 1) * part_size - 1))))
                .drop("lo", "hi"))
    speakers = (dealt.where(F.col("role").isNotNull() & ~F.col("role").isin(list(context_roles)))
                .select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct())
    name = F.regexp_replace("role", r"[\s<|>]", "_")
    own = F.coalesce(F.col("role") == F.col("speaker"), F.lit(False))
    head = (F.when(own, "assistant").when(F.col("role").isNull(), "user")
            .when(F.col("role").isin(list(context_roles)), name).otherwise(F.concat(F.lit("user name="), name)))
    seen = (numbered.join(speakers, F.col("conv_id").eqNullSafe(F.col("c")))
            .select("conv_id", "speaker", "part", "i", own.alias("own"), F.concat(F.lit(OPEN), head, F.lit("\n")).alias("head"),
                    F.concat(F.replace("body", F.lit("<|"), F.lit("< |")), F.lit(CLOSE)).alias("said")))
    so_far = Window.partitionBy("conv_id", "speaker", "part").orderBy("i")
    spans = seen.withColumn("end", F.sum(F.length("head") + F.length("said") + 1).over(so_far) - 1)
    span = F.concat_ws(":", F.col("end") - F.length("said"), F.col("end"))
    rows = spans.groupBy("conv_id", "speaker", "part").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.array_sort(F.collect_list(F.struct("i", F.concat("head", "said", F.lit("\n")).alias("t"),
                                             F.when(F.col("own"), span).alias("m")))).alias("all"))
    return rows.select("conv_id", "speaker", F.col("part").cast("long").alias("part"), "n_messages",
                       F.array_join(F.col("all.t"), "").alias("text"),
                       F.array_join(F.filter("all.m", lambda x: x.isNotNull()), ",").alias("mask"))
