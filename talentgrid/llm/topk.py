"""Exact top-k inner-product search by norm order and rotated partial sums.

Vectors are ordered by descending length and cut into blocks. All vectors are rotated to
the principal axes of their second moments, so the first axes carry most of every product;
for the rest Cauchy-Schwarz bounds what can still come. Each query first meets the head
(the longest vectors), whose k-th score is its threshold; it then visits only the blocks
whose longest vector could still reach that threshold. Inside a block, tiles of candidates
are passed by descending length: a tile that cannot reach any threshold ends the block, and
a pair whose partial sum plus residual bound stays below the threshold is dropped. What is
left is scored exactly in integers, and the thresholds rise.

Work units are (block, chunk of queries), both of bounded size; a unit returns at most k
rows per query. The driver sees the moments (dimension squared), the block lengths (one
number per block) and the head (``HEAD`` vectors).

Defined results: vectors that are null or hold null or non-finite components take no part;
shorter vectors count as filled up with zeros; rows are told apart even if their ids
repeat, a query leaving out only its own row; rows without an id are candidates, behind
others in ties; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talentgrid.llm.common import stored

BLOCK = 32768
CHUNK = 16384
HEAD = 4096
TILE = 1024
QUERY_TILE = 256
LEVELS = 4
#: Products of vectors up to this length are exact in doubles.
EXACT = 2.0 ** 52
_LAST = int(np.iinfo("int64").max)


def prepared(vectors: DataFrame, query: Column, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(uid, id, v, norm, is_query) with integer components as doubles, equally long."""
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("e"),
                       F.coalesce(query, F.lit(False)).alias("is_query"))
    x = x.filter(F.col("e").isNotNull()).filter(F.forall("e", lambda c: F.coalesce(
        ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), F.lit(False))))
    width = x.agg(F.max(F.size("e"))).first()[0] or 0
    v = F.concat(F.transform("e", lambda c: F.floor(F.lit(float(scale)) * c).cast("double")),
                 F.array_repeat(F.lit(0.0), F.lit(width) - F.size("e")))
    x = x.select("id", "is_query", v.alias("v"), F.monotonically_increasing_id().alias("uid"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    return stored(x.withColumn("norm", norm), "topk-vectors")


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _moments(it):
    total = None
    for batch in it:
        m = _matrix(batch.column(0))
        if len(m):
            total = m.T @ m if total is None else total + m.T @ m
    if total is not None:
        d = len(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(list(total))], ["i", "row"])


def rotation(vectors: DataFrame) -> np.ndarray:
    """Principal axes, strongest first."""
    part = vectors.select("v").mapInArrow(_moments, "i long, row array<double>")
    sums = part.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    d = max((r.i for r in sums), default=-1) + 1
    m = np.zeros((d, d))
    for r in sums:
        m[r.i, r.j] = r.x
    values, axes = np.linalg.eigh(m) if d else (np.zeros(0), np.zeros((0, 0)))
    return axes[:, ::-1].copy()


def _exact(a: np.ndarray, b: np.ndarray, big: bool) -> np.ndarray:
    """Row-wise integer products."""
    if not big:
        return np.einsum("ij,ij->i", a, b).astype("int64")
    out = [sum(int(x) * int(y) for x, y in zip(p, q)) for p, q in zip(a, b)]
    return np.array([min(max(s, -_LAST - 1), _LAST) for s in out], "int64")


class Side:
    """Vectors with their rotated components and, for each of ``LEVELS`` prefixes of the
    axes, the length of what lies beyond it."""

    def __init__(self, uid, ids, v, axes):
        self.uid, self.v = uid, v
        self.ids = ids
        d = v.shape[1] if len(v) else 0
        self.turned = v @ axes if d else np.zeros((len(v), 0))
        self.norm = np.sqrt((v * v).sum(1)) if len(v) else np.zeros(0)
        self.cuts = [d * (i + 1) // LEVELS for i in range(LEVELS)]
        square = np.cumsum(self.turned ** 2, 1)
        total = square[:, -1] if d else np.zeros(len(v))
        self.rest = [np.sqrt(np.maximum(total - square[:, c - 1], 0.0)) if c else self.norm for c in self.cuts]


def best(queries: Side, cands: Side, k: int, theta: np.ndarray):
    """Per query the k best of the candidates that reach ``theta``: lists of
    (score, id, uid), and the raised thresholds. Candidates come by descending length."""
    big = bool(len(queries.norm) and len(cands.norm) and queries.norm.max() * cands.norm.max() >= EXACT)
    found = []
    theta = theta.copy()
    for q0 in range(0, len(queries.uid), QUERY_TILE):
        q = slice(q0, min(q0 + QUERY_TILE, len(queries.uid)))
        n = q.stop - q.start
        t = theta[q]
        score = [np.zeros(0, "int64")] * n
        place = [np.zeros(0, "int64")] * n
        qn = queries.norm[q]
        for c0 in range(0, len(cands.uid), TILE):
            c = slice(c0, min(c0 + TILE, len(cands.uid)))
            slack = 1e-9 * (1 + qn * cands.norm[c0])
            if not (qn * cands.norm[c0] + slack >= t).any():
                break
            # partial sums over more and more axes, until nothing or little is left
            least = (t - slack)[:, None]
            part, live, at = np.zeros((n, c.stop - c.start)), None, 0
            for cut, qr, cr in zip(queries.cuts, queries.rest, cands.rest):
                part += queries.turned[q, at:cut] @ cands.turned[c, at:cut].T
                at = cut
                live = part + np.outer(qr[q], cr[c]) >= least
                few = np.count_nonzero(live)
                if few * 64 < live.size:
                    break
            qi, ci = np.nonzero(live)
            other = queries.uid[q][qi] != cands.uid[c][ci]
            qi, ci = qi[other], ci[other]
            if not len(qi):
                continue
            s = _exact(queries.v[q][qi], cands.v[c][ci], big)
            keep = s >= t[qi]
            qi, ci, s = qi[keep], ci[keep] + c0, s[keep]
            for i, a, b in zip(*_groups(qi)):
                sc, pl = np.concatenate([score[i], s[a:b]]), np.concatenate([place[i], ci[a:b]])
                if len(sc) > k:
                    o = np.lexsort((cands.uid[pl], cands.ids[pl], -sc))[:k]
                    sc, pl = sc[o], pl[o]
                    t[i] = max(t[i], sc[-1])
                score[i], place[i] = sc, pl
        for i in range(n):
            o = np.lexsort((cands.uid[place[i]], cands.ids[place[i]], -score[i]))[:k]
            found.append((score[i][o], place[i][o]))
            if len(o) == k:
                t[i] = max(t[i], score[i][o[-1]])
        theta[q] = t
    return found, theta


def _groups(sorted_ids):
    """Runs of equal values of a sorted array: (value, start, end)."""
    edge = np.flatnonzero(np.diff(sorted_ids)) + 1
    starts = np.concatenate([[0], edge]) if len(sorted_ids) else np.zeros(0, int)
    return sorted_ids[starts], starts, np.concatenate([edge, [len(sorted_ids)]]) if len(sorted_ids) else starts


def _side(table, axes, order=False) -> Side:
    ids = np.asarray(table.column("id").fill_null(_LAST))  # behind all others in ties
    uid = np.asarray(table.column("uid"))
    v = _matrix(table.column("v"))
    if order:
        o = np.lexsort((uid, -np.asarray(table.column("norm"))))
        uid, ids, v = uid[o], ids[o], v[o]
    return Side(uid, ids, v, axes)


def search(vectors: DataFrame, query: Column, k: int, id_col="vec_id", vec_col="embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, id, score): for every row where ``query`` holds, the k rows of
    highest inner product of the vectors floor(scale * x), ties to the smaller id."""
    spark = vectors.sparkSession
    rows = prepared(vectors, query, id_col, vec_col, scale)
    n = rows.count()
    axes = rotation(rows)
    # blocks by descending length; the row number parts equal lengths
    blocks = rows.repartitionByRange(max(1, math.ceil(n / BLOCK)), F.col("norm").desc(), F.col("uid")) \
        .select("uid", "id", "v", "norm", F.spark_partition_id().alias("block"))
    blocks = stored(blocks, "topk-blocks")
    longest = blocks.groupBy("block").agg(F.max("norm").alias("norm")).orderBy("block").collect()
    numbers = np.array([r.block for r in longest], "int32")
    # never rising, whatever the range bounds made of equal lengths
    reach = np.maximum.accumulate(np.array([r.norm for r in longest])[::-1])[::-1]
    head = blocks.orderBy(F.col("norm").desc(), "uid").limit(HEAD).toArrow()  # HEAD rows at most
    shared = spark.sparkContext.broadcast((head, axes, numbers, reach))

    def thresholds(it):
        head, axes, numbers, reach = shared.value
        top = _side(head, axes, order=True)
        for batch in it:
            q = _side(batch, axes)
            _, theta = best(q, top, k, np.full(len(q.uid), -np.inf))
            # the blocks that can reach the threshold come first
            slack = 1e-9 * (1 + np.abs(theta))
            last = [int(np.searchsorted(-(reach * m + s), -t, side="right")) if np.isfinite(t) else len(reach)
                    for m, t, s in zip(q.norm, theta, np.where(np.isfinite(theta), slack, 0))]
            visit = [numbers[:x] for x in last]
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("id"), batch.column("v"), pa.array(theta), pa.array(visit, pa.list_(pa.int32()))],
                ["uid", "id", "v", "theta", "visit"])

    queries = rows.filter("is_query").select("uid", "id", "v") \
        .mapInArrow(thresholds, "uid long, id long, v array<double>, theta double, visit array<int>")
    queries = stored(queries, "topk-queries")
    chunks = max(1, math.ceil(queries.count() / CHUNK))
    chunk = F.pmod(F.xxhash64("uid"), F.lit(chunks)).cast("int")
    left = queries.withColumn("chunk", chunk).select("uid", "id", "v", "theta", "chunk", F.explode("visit").alias("block"))
    # a block goes only to the chunks that visit it
    visits = left.select(F.col("block").alias("at"), F.col("chunk").alias("to")).distinct()
    right = blocks.join(visits, blocks["block"] == visits["at"]).select("uid", "id", "v", "norm", "block", F.col("to").alias("chunk"))

    def unit(q, c):
        _, axes, _, _ = shared.value
        a, b = _side(q, axes), _side(c, axes, order=True)
        found, _ = best(a, b, k, np.asarray(q.column("theta"), dtype="float64"))
        sizes = [len(s) for s, _ in found]
        at = np.repeat(np.arange(len(found)), sizes)
        place = np.concatenate([p for _, p in found]) if found else np.zeros(0, "int64")
        score = np.concatenate([s for s, _ in found]) if found else np.zeros(0, "int64")
        ids = b.ids[place] if len(b.uid) else np.zeros(0, "int64")
        return pa.table({"quid": a.uid[at], "query_id": a.ids[at], "id": pa.array(ids, pa.int64(), mask=ids == _LAST),
                         "uid": b.uid[place] if len(b.uid) else ids, "score": score})

    hits = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")) \
        .applyInArrow(unit, "quid long, query_id long, id long, uid long, score long")
    by = W.partitionBy("quid").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "uid")
    return hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
