"""Mixing sources to target weights by a low-discrepancy schedule.

The schedule is a row of slots. Slot ``i`` takes the point ``frac((i + 1) * golden ratio)``
and maps it through the cumulative slot shares of the sources, so every stretch of the
schedule holds each source in proportion, to within a few slots. The slots of a source are
ranked; rank ``r`` takes block ``r mod n_blocks`` in epoch ``r div n_blocks``. The blocks of
a source are equal runs of words over its documents in a shuffled (md5) order.

Nothing is gathered per source: prefix sums and ranks are taken inside bounded buckets
(leading md5 digits, slot chunks) on top of per-bucket totals, so a source holding a third
of all rows is spread like any other.

Defined results: a null or wordless text has size 0 and is never taken; null sources form
one source ordered last; repeated rows are separate documents; an empty table gives an
empty mix. Columns besides id, text and source are not looked at, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talentgrid.llm.common import WORD, key_of, stored

#: Fractional part of the golden ratio.
PHI = 0.6180339887498949
BLOCK_WORDS = 256
MIN_BLOCKS = 32
SLOT_CHUNK = 65536
BUCKET_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """(id, source, src, size, key): ``key`` shuffles, ``src`` is a non-null source key."""
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), key_of(F.col(source_col)).alias("src"),
        word_count(F.col(text_col)).alias("size"), F.md5(key_of(F.col(id_col))).alias("key"))


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: (src, source, source_size, weight, target).

    Sources by code point (null last) get the weights in turn and share ``share`` times all
    words; no target is above ``cap`` times its source, the excess going to the others by
    weight. In order of ``cap * size / weight`` the capped sources are a prefix, so the
    repeated resharing ends in one closed form. The windows run over one row per source."""
    s = sizes.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                            (order % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    every = W.partitionBy()
    by_ratio = W.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(every) * F.lit(float(share))
                     - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    s = s.withColumn("per_weight", F.col("left") / F.sum("weight").over(rest))
    s = s.withColumn("capped", F.col("most") <= F.col("per_weight") * F.col("weight"))
    s = s.withColumn("first", F.struct((-F.row_number().over(by_ratio)).alias("o"), "left",
                                       F.sum("weight").over(rest).alias("w")))
    level = F.max(F.when(~F.col("capped"), F.col("first"))).over(every)
    return s.withColumn("level", level).select(
        "src", "source", "source_size", "weight",
        F.when(F.col("capped") | F.col("level").isNull(), F.col("most"))
         .otherwise(F.col("weight") * F.col("level.left") / F.col("level.w")).alias("target"))


def planned(goal: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Block width, number of blocks and slot share of every source, with the cumulative
    bounds of the shares in [0, 1)."""
    size, target = F.col("source_size"), F.col("target")
    g = goal.withColumn("width", F.greatest(F.lit(1), F.least(
        F.lit(block_words), F.ceil(size / MIN_BLOCKS))).cast("long"))
    g = g.withColumn("n_blocks", F.ceil(size / F.col("width")).cast("long"))
    epochs = F.when(size > 0, F.floor(target / size)).otherwise(0)
    g = g.withColumn("slots", epochs * F.col("n_blocks") + (target - epochs * size) / F.col("width"))
    upto = W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    g = g.withColumn("upto", F.sum("slots").over(upto)).withColumn("all_slots", F.sum("slots").over(W.partitionBy()))
    return g.withColumn("hi", F.try_divide("upto", "all_slots")) \
            .withColumn("lo", F.try_divide(F.col("upto") - F.col("slots"), F.col("all_slots")))


def schedule(plan: DataFrame, cap: float = 2.0) -> DataFrame:
    """(slot, src, block, epoch) of every scheduled block, from :func:`planned`."""
    spark = plan.sparkSession
    # two scalars: the number of slots and of sources
    row = plan.agg(F.max("all_slots").alias("m"), F.count("*").alias("s")).first()
    n_slots, cells = int(math.ceil(row.m or 0)), max(1024, 4 * row.s)
    point = F.pmod((F.col("id") + 1).cast("double") * F.lit(PHI), F.lit(1.0))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), point.alias("u")) \
        .withColumn("cell", F.floor(F.col("u") * cells).cast("int"))
    # a source meets only the points of the cells that its share touches
    cell = lambda c: F.least(F.floor(F.col(c) * cells), F.lit(cells)).cast("int")
    spans = plan.filter("slots > 0").select("src", "lo", "hi", "n_blocks",
                                            F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell"))
    hit = slots.join(spans, "cell").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))) \
        .select("slot", "src", "n_blocks", F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk"))
    per = hit.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    upto = W.partitionBy("src").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("src", "chunk", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("src", "chunk").orderBy("slot")) - 1
    ranked = hit.withColumn("r", rank).join(per, ["src", "chunk"]).withColumn("r", F.col("r") + F.col("before"))
    out = ranked.select("slot", "src", (F.col("r") % F.col("n_blocks")).alias("block"),
                        F.floor(F.col("r") / F.col("n_blocks")).alias("epoch"))
    return out.filter(F.col("epoch") < math.ceil(cap))


def placed(sizes: DataFrame) -> DataFrame:
    """Adds ``start``, the words before a document in its source's shuffled order."""
    n = sizes.count()
    digits = max(1, math.ceil(math.log(max(1, n / BUCKET_ROWS), 16)))
    x = sizes.withColumn("bucket", F.substring("key", 1, digits))
    per = x.groupBy("src", "bucket").agg(F.sum("size").alias("w"))
    upto = W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("src", "bucket", F.coalesce(F.sum("w").over(upto), F.lit(0)).alias("before"))
    inside = W.partitionBy("src", "bucket").orderBy("key", "size").rowsBetween(W.unboundedPreceding, 0)
    return x.withColumn("run", F.sum("size").over(inside)).join(per, ["src", "bucket"]) \
        .select("id", "source", "src", "size", "key", (F.col("before") + F.col("run") - F.col("size")).alias("start"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=(5, 2, 1),
        share: float = 1.5, cap: float = 2.0, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """``(documents, segments)``.

    documents: one row per input row (id, source, src, size, key, start, source_size, target).
    segments: the mix itself in schedule order, (slot, epoch, src, start, from_word, n_words):
    slot ``slot`` plays ``n_words`` words of the document placed at ``start`` of source
    ``src``, beginning at its word ``from_word``."""
    sizes = stored(sized(docs, id_col, text_col, source_col), "mix-sizes")
    plan = stored(planned(targets(sizes, weights, share, cap), block_words).coalesce(1), "mix-plan")
    where = stored(placed(sizes), "mix-placed")
    some = where.filter("size > 0").join(plan.select("src", "width", "n_blocks"), "src")
    first, last = F.floor(F.col("start") / F.col("width")), \
        F.floor((F.col("start") + F.col("size") - 1) / F.col("width"))
    parts = some.select("src", "start", "size", "width", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("start"), F.col("block") * F.col("width"))
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("width"))
    parts = parts.select("src", "block", "start", (lo - F.col("start")).alias("from_word"), (hi - lo).alias("n_words"))
    segments = parts.join(schedule(plan, cap), ["src", "block"]) \
        .select("slot", "epoch", "src", "start", "from_word", "n_words")
    return where.join(plan.select("src", "source_size", "target"), "src"), segments


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row per document: (id, source, size, source_size, target, taken), ``taken`` being
    the words that the mix plays of it, repeats counted."""
    where, segments = mix(docs, **options)
    # a document with words is known by its source and place
    got = segments.groupBy("src", "start").agg(F.sum("n_words").alias("got"))
    some = where.filter("size > 0").join(got, ["src", "start"], "left")
    cols = ["id", "source", "size", "source_size", "target"]
    return some.select(*cols, F.coalesce("got", F.lit(0)).alias("taken")) \
        .unionByName(where.filter("size = 0").select(*cols, F.lit(0).cast("long").alias("taken")))
