"""Chat request intent from the user turns of a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentgrid import vocab as V


def _any_contains(text: Column, kws: list[str]) -> Column:
    hit = F.lit(False)
    for kw in kws:
        hit = hit | text.contains(kw.lower())
    return hit


def _border(tail: Column, heads: Column, reach: int) -> Column:
    """What a keyword that crosses this border may lie in: ``reach`` characters on either side."""
    return F.concat(F.right(tail, F.lit(reach)), F.left(F.array_join(heads, ""), F.lit(reach)))


def turn_borders(turns: DataFrame, reach: int, conv_col: str, order_col: str, text_col: str,
                 parts: int | None = None) -> DataFrame:
    """(conv, text) for every border between two turns of a conversation, each turn followed by a
    space: the last ``reach`` characters before it and the first ``reach`` behind it, which may be
    several short turns.

    Turns are range-partitioned by conversation and order, so a long conversation lies in several
    tasks, each with a stretch of it; borders inside a stretch come from a window over the heads of
    its turns, borders between stretches from a second one over one row a stretch. Texts don't
    travel beyond ``reach`` characters of their ends.
    """
    ends = turns.select(conv_col, order_col, F.left(text_col, F.lit(reach)).alias("_head"),
                        F.right(text_col, F.lit(reach)).alias("_tail"))
    keys = [conv_col, order_col, "_head", "_tail"]
    spread = ends.repartitionByRange(parts, *keys) if parts else ends.repartitionByRange(*keys)
    x = spread.withColumn("_part", F.spark_partition_id())
    w = Window.partitionBy(conv_col, "_part").orderBy(*keys[1:])
    # a turn has its space at least, so no more than ``reach`` turns can matter on either side
    x = x.withColumn("_next", F.collect_list("_head").over(w.rowsBetween(1, reach))) \
        .withColumn("_so_far", F.right(F.array_join(F.collect_list("_tail").over(w.rowsBetween(-reach, 0)), ""), F.lit(reach))) \
        .withColumn("_first", F.lag("_part").over(w).isNull())
    inside = x.filter(F.size("_next") > 0).select(conv_col, _border(F.col("_tail"), F.col("_next"), reach).alias("_text"))
    start = F.when(F.col("_first"), F.left(F.concat("_head", F.array_join("_next", "")), F.lit(reach)))
    end = F.when(F.size("_next") == 0, F.col("_so_far"))
    stretches = x.groupBy(conv_col, "_part").agg(F.max(start).alias("_head"), F.max(end).alias("_tail"))
    v = Window.partitionBy(conv_col).orderBy("_part")
    stretches = stretches.withColumn("_next", F.collect_list("_head").over(v.rowsBetween(1, reach)))
    return inside.unionByName(stretches.filter(F.size("_next") > 0).select(
        conv_col, _border(F.col("_tail"), F.col("_next"), reach).alias("_text")))


def message_intent(turns: DataFrame, intents=None, conv_col: str = "conv_id", role_col: str = "role",
                   text_col: str = "text", order_col: str = "turn", resume: DataFrame | None = None,
                   resume_min_len: int = 100, parts: int | None = None) -> DataFrame:
    """Intent per conversation: ``cv_evaluation`` when a résumé longer than
    ``resume_min_len`` is attached; else the first intent group with a keyword in the
    user turns (lower-cased, each followed by a space, concatenated); else ``general``.

    A keyword without white space lies in one turn, so flags of single turns are OR-ed by a plain
    aggregation (partial, map-side). For keywords with spaces the borders between turns are
    searched as well (see :func:`turn_borders`; ``parts`` ranges of turns).

    Null texts are empty turns; turns of equal order are taken by their first, then last characters; a null conversation
    is one of its own.
    """
    intents = V.INTENT_KEYWORDS if intents is None else intents
    low = F.concat(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(" "))
    users = turns.filter(F.col(role_col) == "user").select(conv_col, order_col, low.alias("_text"))
    x = turns.select(conv_col, F.when(F.col(role_col) == "user", low).alias("_text"))
    spaced = [kw for _, kws in intents for kw in kws if any(ch.isspace() for ch in kw)]
    if spaced:
        reach = max(len(kw.lower()) for kw in spaced) - 1
        if reach:
            x = x.unionByName(turn_borders(users, reach, conv_col, order_col, "_text", parts))
    out = x.groupBy(conv_col).agg(*[F.max(_any_contains(F.col("_text"), kws).cast("int")).alias(f"_i{i}")
                                    for i, (_, kws) in enumerate(intents)])
    hits = [F.col(f"_i{i}") == 1 for i in range(len(intents))]
    intent = F.lit("general")
    for (name, _), h in reversed(list(zip(intents, hits))):
        intent = F.when(F.coalesce(h, F.lit(False)), F.lit(name)).otherwise(intent)
    if resume is not None:
        out = out.join(resume, conv_col, "left")
        intent = F.when(F.length(F.coalesce(F.col("resume_content"), F.lit(""))) > resume_min_len,
                        F.lit("cv_evaluation")).otherwise(intent)
    return out.select(conv_col, intent.alias("intent"))
