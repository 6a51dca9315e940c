"""Chat formatting by multi-party perspective rotation.

Every participant of a dialogue gets the dialogue rendered from their side: their turns are
the assistant's, the others' are named users', and a mask marks what a model would learn.
The result has one row per (conversation, perspective, turn) with the rendered segment and
its place in the whole rendering, so a dialogue of any length is spread over tasks instead
of being gathered into one string; joining the segments in order gives the rendering.

Places are prefix sums over bounded chunks of turns plus the totals of earlier chunks.

Defined results: turns are ordered by (turn, role, text), null turns first; a null text is
empty; a null role is the participant ``unknown``; rows without a conversation id form one
conversation with a null id; repeated rows are repeated turns; the roles in ``neutral``
take no perspective and keep their role; a conversation without participants and an empty
table give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talentgrid.llm.common import key_of, text_or_empty

CHUNK = 1024
NEUTRAL = ("system", "tool")


def rotate(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text",
           neutral=NEUTRAL) -> DataFrame:
    """(conv_id, perspective, position, role, name, segment, mask, seg_start, seg_end): the
    masked characters are those of the text and end mark of the perspective's own turns;
    starts and ends count code points within the rendering, end exclusive."""
    t = turns.select(F.col(conv_col).alias("conv_id"), key_of(F.col(conv_col)).alias("ck"),
                     F.col(turn_col).alias("turn"),
                     F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("who"),
                     text_or_empty(text_col).alias("body"),
                     F.coalesce(F.floor(F.col(turn_col) / CHUNK), F.lit(-2 ** 62)).alias("chunk"))
    # a few speakers a conversation: distinct is combined before its shuffle
    people = t.filter(~F.col("who").isin(*neutral)).select("ck", F.col("who").alias("perspective")).distinct()
    own, plain = F.col("who") == F.col("perspective"), F.col("who").isin(*neutral)
    x = t.join(people, "ck")
    x = x.withColumn("role", F.when(own, "assistant").when(plain, F.col("who")).otherwise("user"))
    x = x.withColumn("name", F.when(~own & ~plain, F.col("who")))
    head = F.concat(F.lit("<|im_start|>"), F.col("role"),
                    F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("\n"))
    x = x.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, F.col("body"), F.lit("<|im_end|>\n")))
    x = x.withColumn("mask", own).withColumn("n", F.length("segment").cast("long"))
    per = x.groupBy("ck", "perspective", "chunk").agg(F.sum("n").alias("chars"), F.count("*").alias("turns"))
    upto = W.partitionBy("ck", "perspective").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("ck", "perspective", "chunk", F.coalesce(F.sum("chars").over(upto), F.lit(0)).alias("chars0"),
                     F.coalesce(F.sum("turns").over(upto), F.lit(0)).alias("turns0"))
    inside = W.partitionBy("ck", "perspective", "chunk").orderBy(F.col("turn").asc_nulls_first(), "who", "body")
    x = x.withColumn("k", F.row_number().over(inside)) \
        .withColumn("run", F.sum("n").over(inside.rowsBetween(W.unboundedPreceding, 0)))
    x = x.join(per, ["ck", "perspective", "chunk"])
    end = F.col("chars0") + F.col("run")
    start = end - F.col("n")
    return x.select("conv_id", "perspective", (F.col("turns0") + F.col("k") - 1).cast("long").alias("position"),
                    "role", "name", "segment", "mask", start.alias("seg_start"), end.alias("seg_end"),
                    F.when(F.col("mask"), start + F.col("head")).alias("mask_start"))
