"""De-duplication and result merging.

``keep_first`` is an aggregation, not a window: ``min_by(row, order)`` per key runs
partially on the map side, so a key holding a third of all rows is reduced to one row
per map task before the shuffle and no task ever holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.operators.match import top_k_per_group


def keep_first(df: DataFrame, keys: list, order_col: str) -> DataFrame:
    """First row (smallest ``order_col``) of every key; null keys compare equal."""
    cols = df.columns
    key_cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    named = [c.alias(f"_k{i}") for i, c in enumerate(key_cols)]
    return (df.select(*named, F.struct(*cols).alias("_r"), F.col(order_col).alias("_o"))
            .groupBy(*[f"_k{i}" for i in range(len(named))])
            .agg(F.min_by("_r", "_o").alias("_r"))
            .select("_r.*"))


def truncate_input(c: Column, limit: int = 2000, keep: int = 1997) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, keep), F.lit("..."))).otherwise(c)


def dedup_examples(df: DataFrame, order_col: str = "ord") -> DataFrame:
    """Training examples: inputs over 2000 chars cut to 1997 + "...", then keep the first
    example per (instruction, input[:100])."""
    x = df.withColumn("input", truncate_input(F.col("input")))
    return keep_first(x, ["instruction", F.substring("input", 1, 100)], order_col)


def greedy_dedup(df: DataFrame, key1: str, key2_cols: list[str], order_col: str = "ord",
                 key1_implies_key2: bool = False) -> DataFrame:
    """Exact order-dependent de-duplication: a row is dropped when an earlier *kept* row
    shares ``key1`` or the ``key2_cols`` tuple (nulls equal, in either key); otherwise kept.
    ``order_col`` is unique. Returns ``df`` with a boolean ``kept`` column.

    Only (order, key hashes) go through the rounds, and of rows with both keys equal only
    the first. A row all of whose earlier key-mates are dropped is kept, and its key-mates
    are dropped; decided rows leave the state, so every round is smaller than the last.
    The first undecided row is always decided, so the rounds end by themselves; their
    number is that of the longest chain of alternating decisions. Each round is written to
    the shared checkpoint folder.

    ``key1_implies_key2``: when equal ``key1`` values always come with equal ``key2`` tuples
    (e.g. ``key1`` is the md5 offer id over non-empty title/company/…), every conflict is a
    ``key2`` conflict and one keep-first pass on ``key2`` is the exact answer.
    """
    if key1_implies_key2:
        first = keep_first(df.select(*key2_cols, order_col), key2_cols, order_col) \
            .select(order_col, F.lit(True).alias("kept"))
        return df.join(first, order_col, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    from talentgrid.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    def digest(*cols):
        # nulls are told apart from every value and equal each other
        return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)])), 256)

    keys = df.select(digest(key1).alias("k1"), digest(*key2_cols).alias("k2"), F.col(order_col).alias("o"))
    open_rows = keys.groupBy("k1", "k2").agg(F.min("o").alias("o")).checkpoint()
    kept = []
    while not open_rows.isEmpty():
        first1 = open_rows.groupBy("k1").agg(F.min("o").alias("f1"))
        first2 = open_rows.groupBy("k2").agg(F.min("o").alias("f2"))
        state = open_rows.join(first1, "k1").join(first2, "k2")
        now = state.filter((F.col("f1") == F.col("o")) & (F.col("f2") == F.col("o"))).select("k1", "k2", "o").checkpoint()
        kept.append(now.select("o"))
        open_rows = open_rows.join(now.select("k1"), "k1", "left_anti").join(now.select("k2"), "k2", "left_anti").checkpoint()
    done = df.select(F.col(order_col).alias("o")).limit(0) if not kept else kept[0]
    for more in kept[1:]:
        done = done.unionByName(more)
    done = done.select(F.col("o").alias(order_col), F.lit(True).alias("kept"))
    return df.join(done, order_col, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def not_already_present(scraped: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``scraped`` whose key is not in ``present`` (left anti join)."""
    return scraped.join(present.select(*keys).distinct(), keys, "left_anti")


def hybrid_merge(vector: DataFrame, scraped: DataFrame, k: int, group: str = "cv_id",
                 id_col: str = "offer_id") -> DataFrame:
    """Vector results ∪ scraped results not already present (vector side wins on id),
    re-sorted by score with ties in list order (vector rows first, each side in its own
    rank order), re-ranked and cut to ``k``. Inputs: (group, id, score, rank)."""
    v = vector.select(group, id_col, "score", F.lit(0).alias("_side"), F.col("rank").alias("_r"),
                      F.lit("vector").alias("source"))
    s = not_already_present(scraped, vector, [group, id_col]).select(
        group, id_col, "score", F.lit(1).alias("_side"), F.col("rank").alias("_r"), F.lit("scraped").alias("source"))
    u = v.unionByName(s)
    out = top_k_per_group(u, [group], [F.col("score").desc(), F.col("_side").asc(), F.col("_r").asc()], k)
    return out.drop("_side", "_r")
