"""Invariants on the driver tables: rank = 1..n per CV, at most k rows, scores within their
caps, de-duplication idempotent."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from talentgrid.operators import dedup as DD

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.mark.parametrize("name,cap", [("match_rules_topk", 1.0), ("match_weighted_topk", 1.0),
                                      ("match_bonus_topk", None), ("match_embedding_topk", 1.0)])
def test_rank_contiguous_and_capped(spark, name, cap):
    df = E.queries()[name](spark, SF)
    per = df.groupBy("cv_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"),
                                  F.countDistinct("rank").alias("d"), F.max("score").alias("smax"))
    for r in per.collect():
        assert r.lo == 1 and r.hi == r.n == r.d and r.n <= 5
        if cap is not None:
            assert r.smax <= cap + 1e-12
    # scores are non-increasing with rank
    bad = df.alias("a").join(df.alias("b"), (F.col("a.cv_id") == F.col("b.cv_id")) & (F.col("a.rank") + 1 == F.col("b.rank"))) \
        .filter(F.col("a.score") < F.col("b.score")).count()
    assert bad == 0


def test_dedup_idempotent(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    x = d.select(F.col("doc_id").alias("ord"), F.md5(F.lower("text")).alias("id"),
                 F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("company"))
    once = DD.greedy_dedup(x, "id", ["title", "company"], "ord").filter("kept").drop("kept")
    twice = DD.greedy_dedup(once, "id", ["title", "company"], "ord").filter("kept").drop("kept")
    assert once.count() == twice.count() > 0
    kf = DD.keep_first(x, ["id"], "ord")
    assert DD.keep_first(kf, ["id"], "ord").count() == kf.count() == x.select("id").distinct().count()
