import math
import random

import pytest
from pyspark.sql import functions as F

from talentgrid.llm import topk


def brute(rows, k):
    vs = []
    for uid, (i, e) in enumerate(rows):
        if e is not None and all(x is not None and math.isfinite(x) for x in e):
            vs.append((uid, i, [math.floor(64 * x) for x in e]))
    out = []
    for u, i, q in vs:
        if i is None or i % 20:
            continue
        scores = [(-sum(a * b for a, b in zip(q, c)), j is None, j or 0, j) for v, j, c in vs if v != u]
        out += [(i, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def made(seed, n, d, spread=1.0):
    rng = random.Random(seed)
    hot = [rng.gauss(0, 1) for _ in range(d)]
    rows = [(i, hot if i % 3 == 0 else [rng.gauss(0, 1) * spread ** j for j in range(d)]) for i in range(n)]
    return rows + [(None, [1.0] * d), (5000, None), (5020, [1.0, None] + [0.0] * (d - 2)), (5040, [float("nan")] * d),
                   (5060, [float("inf")] + [0.0] * (d - 1)), (5080, []), (5100, [2.0]), (20, [0.5] * d), (rows[1][0], rows[1][1])]


@pytest.mark.parametrize("spread", [1.0, 0.5])
def test_equals_brute_force(spark, monkeypatch, spread):
    for name, value in (("BLOCK", 100), ("CHUNK", 7), ("HEAD", 30), ("TILE", 32), ("QUERY_TILE", 8)):
        monkeypatch.setattr(topk, name, value)
    rows = made(3, 400, 12, spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("norm", F.lit("x")).withColumn("id", F.lit(1))
    got = topk.search(df, F.col("vec_id") % 20 == 0, 5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 5)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.search(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0, 5).count() == 0
    rows = [(0, [1.0, 2.0]), (1, [0.5, -1.0]), (2, [1.0, 2.0])]
    got = topk.search(spark.createDataFrame(rows, schema), F.col("vec_id") % 20 == 0, 20)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 2, 64 * 64 + 128 * 128), (0, 2, 1, 64 * 32 - 128 * 64)]


def test_huge_components_stay_exact(spark):
    big = 2.0 ** 24
    rows = [(0, [big, 1.0]), (1, [big, 1.0]), (2, [big, 1.015625]), (3, [-big, 0.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 3)
    assert [(r.id, r.score) for r in sorted(got.collect(), key=lambda r: r["rank"])] == \
        [(2, 2 ** 60 + 64 * 65), (1, 2 ** 60 + 64 * 64), (3, -2 ** 60)]
