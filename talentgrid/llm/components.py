"""Connected components of a distributed edge list."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.common import stored


class Forest:
    """Union by smaller root."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while (p := up.get(top, top)) != top:
            top = p
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True


def _contract(it):
    """Every batch of edges becomes stars around its local roots."""
    for batch in it:
        f = Forest()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            f.join(a, b)
        hi = [x for x in f.up if f.root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(hi, pa.string()), pa.array([f.root(x) for x in hi], pa.string())], ["hi", "lo"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), strings; the root is the smallest
    node of the component.

    Edges are first contracted locally, then large-star and small-star rounds alternate
    until the stars no longer change; the rounds grow with the logarithm of the longest
    chain, and each is written to the shared folder."""
    e = edges.select(F.col("a").alias("hi"), F.col("b").alias("lo")).filter("hi <> lo").mapInArrow(_contract, "hi string, lo string")
    e = stored(e.distinct(), "components")
    mark = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")) \
                .unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        mark = now
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = stored(small.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct(), "components")
