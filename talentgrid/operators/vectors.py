"""Embedding operators: exact top-k similarity over a metric index, vector search, centroids
and composite embeddings.

Exact nearest neighbours: items are clustered by angle (centres fitted on a bounded sample, at
most ``MAX_CLUSTERS`` of them). A cluster's centre and radius bound the cosine of any of its items
with a query, and its domains bound the domain part, so a query visits only the clusters whose
bound reaches its ``k``-th best score so far. Neighbouring clusters share a bin of bounded size (a
large cluster is cut over bins of its own), and a query is sent once to a bin, however many of its
clusters it visits there. A visit is one cogroup (bin, chunk of queries) whose pandas function does
NumPy matrix products of the queries with the clusters they visit and emits only per-query top-k; a
final ``row_number() <= k`` window (partial limit before the shuffle) merges them.
Only the index (one centre per cluster) is sent to every task. On vectors
without any structure the bounds rule out little, and the work nears that of all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.functions.vectors import l2_normalize, to_double
from talentgrid.operators.match import top_k_per_group
from talentgrid.session import materialize

KNN_SCHEMA = "qid long, iid long, cos double, dsim double, score double, ord long"


#: Queries of a product, items of its slabs, and domains that take a column of it.
QUERIES, SLAB, COLUMNS = 512, 4096, 32


def _runs(ranked: np.ndarray, domains: np.ndarray, columns: int):
    """Cuts of ``ranked`` into at most ``QUERIES`` queries of at most ``columns`` domains."""
    at = 0
    while at < len(ranked):
        some = ranked[at:at + QUERIES]
        _, first = np.unique(domains[some], return_index=True)
        if len(first) > columns:
            some = some[:np.sort(first)[columns]]
        yield some
        at += len(some)


def _below(floor: np.ndarray) -> np.ndarray:
    """Rounded down: no score in single precision lies between a floor and its rounding."""
    return np.nextafter(floor.astype(np.float32), np.float32(-np.inf))


def _kept(r: np.ndarray, c: np.ndarray, about: np.ndarray, n: int, k: int, floor: np.ndarray, slack: float):
    """The candidates (row, item, score about) that ``k`` others of the row do not rule out, and
    the rows' floors risen accordingly."""
    order = np.lexsort((-about, r))
    r, c, about = r[order], c[order], about[order]
    begin = np.searchsorted(r, np.arange(n))
    full = np.flatnonzero(np.diff(np.r_[begin, len(r)]) >= k)
    floor = floor.copy()
    floor[full] = np.maximum(floor[full], about[begin[full] + k - 1] - 2 * slack)
    keep = about >= floor[r]
    return r[keep], c[keep], about[keep], floor


def _block_top_k(index: MetricIndex, k: int, w_cos: float, w_dom: float, related: dict, exclude_self: bool):
    """Top-k of every query over the items of a bin, in the clusters ``visit`` names or, with a
    threshold ``theta``, in those whose bound reaches it.

    All pairs of a chunk of queries and a slab of items are scored by one product in single
    precision, whose error ``slack`` bounds; the domain part is in its last columns, one for each
    domain of the chunk. Only pairs about as high as the row's k-th best so far (at first
    ``theta``) are taken out of it, and what is left of them is scored again in double precision."""
    cols = ["qid", "iid", "cos", "dsim", "score", "ord"]

    def fn(q: pd.DataFrame, it: pd.DataFrame) -> pd.DataFrame:
        if q.empty or it.empty:
            return pd.DataFrame({c: [] for c in cols})
        # of equal vectors of one domain only the first by order can be among the k best; the rest
        # by cluster, so that a cluster is a slice
        it = it.sort_values(["ord", "iid"])
        same = it.assign(vec=[np.asarray(v).tobytes() for v in it["vec"]]).groupby(["domain", "vec"], dropna=False, sort=False).cumcount()
        it = it[(same <= k).to_numpy()].sort_values("cl", kind="stable")
        cl, begin = np.unique(it["cl"].to_numpy(), return_index=True)
        end = np.r_[begin[1:], len(it)]
        iv = np.vstack(it["vec"].to_numpy()).astype(np.float64)
        inn = np.linalg.norm(iv, axis=1)
        iid, iord = it["iid"].to_numpy(), it["ord"].to_numpy()
        qv = np.vstack(q["vec"].to_numpy()).astype(np.float64)
        qn, qid = np.linalg.norm(qv, axis=1), q["qid"].to_numpy()
        # domain codes: two missing domains are the same
        code, names = pd.factorize(np.concatenate([it["domain"].to_numpy(object), q["domain"].to_numpy(object)]), use_na_sentinel=False)
        ic, qc, place = code[:len(it)], code[len(it):], {x: i for i, x in enumerate(names)}
        rel = {a: [place[b] for b in bs if b in place] for a, bs in (related or {}).items()}
        rel = {place[a]: np.unique(bs) for a, bs in rel.items() if a in place and bs}

        def similar(a: int, items: np.ndarray) -> np.ndarray:
            return np.where(items == a, 1.0, np.where(np.isin(items, rel[a]), 0.5, 0.0) if a in rel else 0.0)

        dim, columns = iv.shape[1], min(COLUMNS, len(np.unique(qc))) if w_dom else 0
        slack = (dim + 2 * columns + 8) * 2.0 ** -23 * (abs(w_cos) + abs(w_dom))
        items = np.zeros((len(it), dim + columns), np.float32)
        items[:, :dim] = _units(iv)
        unit = _units(qv)
        theta, visit = q["theta"].to_numpy("float64", na_value=-np.inf), q["visit"].to_numpy()
        parts = {c: [] for c in cols}
        by_id = np.argsort(iid, kind="stable")

        def itself(some: np.ndarray):
            """(row, item) of the items of a query's own id, of which there may be several."""
            a, b = (np.searchsorted(iid[by_id], qid[some], side) for side in ("left", "right"))
            row = np.repeat(np.arange(len(some)), b - a)
            return row, by_id[np.arange(len(row)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[row]]

        def settled(some: np.ndarray, r: np.ndarray, c: np.ndarray):
            """Scores of the candidates in double precision and the places of each row's k best."""
            cos, dsim = np.zeros(len(r)), np.zeros(len(r))
            for a in range(0, len(r), 1 << 14):
                x, y = some[r[a:a + (1 << 14)]], c[a:a + (1 << 14)]
                length = qn[x] * inn[y]
                with np.errstate(invalid="ignore"):
                    cos[a:a + (1 << 14)] = np.where(length == 0, 0.0, np.einsum("ij,ij->i", qv[x], iv[y]) / np.where(length == 0, 1.0, length))
            for a in np.unique(qc[some]):
                mine = qc[some][r] == a
                dsim[mine] = similar(a, ic[c[mine]])
            score = w_cos * cos + w_dom * dsim
            order = np.lexsort((iid[c], iord[c], -score, r))
            fine = np.isfinite(score) & (qid[some][r] != iid[c]) if exclude_self else np.isfinite(score)
            order = order[fine[order]]
            begun = np.searchsorted(r[order], np.arange(len(some)))
            return cos, dsim, score, order[np.arange(len(order)) - begun[r[order]] < k]

        # queries of like directions together: a chunk then visits few clusters
        near, _ = index.nearest(unit)
        product, high = np.empty(QUERIES * SLAB, np.float32), np.empty(QUERIES * SLAB, bool)
        for some in _runs(np.lexsort((qid, qc, near)), qc, columns or len(names)):
            m = len(some)
            if visit[some[0]] is None:
                bound = index.bounds(unit[some], q["domain"].to_numpy(object)[some].tolist(), w_cos, w_dom, related or {}, cl)
                go = (bound >= theta[some][:, None]) & np.isfinite(bound)
            else:
                go = np.stack([np.isin(cl, visit[i]) for i in some])
            if not go.any():
                continue
            at = np.concatenate([np.arange(begin[c], end[c]) for c in np.flatnonzero(go.any(0))])
            left = np.zeros((m, dim + columns), np.float32)
            left[:, :dim] = w_cos * unit[some]
            if columns:
                doms, which = np.unique(qc[some], return_inverse=True)
                left[np.arange(m), dim + which] = w_dom
                for j, a in enumerate(doms):
                    items[:, dim + j] = similar(a, ic)
            floor, (own_row, own_item) = theta[some] - slack - _SLACK, itself(some) if exclude_self else ((), ())
            r, c, about = np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)
            for s in range(0, len(at), SLAB):
                here = at[s:s + SLAB]
                n = len(here)
                block = items[here[0]:here[-1] + 1] if here[-1] - here[0] == n - 1 else items[here]
                score = np.matmul(left, block.T, out=product[:m * n].reshape(m, n))
                if len(own_row):
                    column = np.searchsorted(here, own_item)
                    inside = np.flatnonzero(here[np.minimum(column, n - 1)] == own_item)
                    score[own_row[inside], column[inside]] = -np.inf
                over = np.greater_equal(score, _below(floor)[:, None], out=high[:m * n].reshape(m, n))
                many = np.flatnonzero(np.count_nonzero(over, axis=1) > 16 * k)
                if len(many):  # a low floor: the slab's own k-th best is one as well
                    kth = np.partition(score[many], n - k, axis=1)[:, n - k]
                    floor[many] = np.maximum(floor[many], kth.astype(np.float64) - 2 * slack)
                    over[many] = score[many] >= _below(floor[many])[:, None]
                found = np.flatnonzero(over)
                r, c, about = np.r_[r, found // n], np.r_[c, here[found % n]], np.r_[about, score.ravel()[found]]
                if len(r) > 16 * k * m:
                    r, c, about, floor = _kept(r, c, about, m, k, floor, slack)
                    if len(r) > 8 * k * m:  # many about equal
                        order = settled(some, r, c)[-1]
                        r, c, about = r[order], c[order], about[order]
            r, c, _, _ = _kept(r, c, about, m, k, floor, slack)
            cos, dsim, score, order = settled(some, r, c)
            for name, x in zip(cols, (qid[some][r], iid[c], cos, dsim, score, iord[c])):
                parts[name].append(x[order])
        # one frame per group, assembled from flat arrays
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in parts.items()})
    return fn


#: The metric index: at most so many clusters, of about so many items; centres are fitted on a
#: bounded sample.
MAX_CLUSTERS = 4096
CLUSTER_ROWS = 1024
SAMPLE_PER_CLUSTER = 16
ROUNDS = 4
#: Distinct domains that a cluster lists; more count as any.
DOMAINS = 64
#: Items of a similarity matrix.
MAX_MATRIX = 4096
_SLACK = 1e-9
#: Queries that meet the index at once.
_ROWS = 1024
#: Items that a query's threshold is found on, at least.
FIRST_ROWS = 256


class MetricIndex:
    """Clusters of items: unit centres, the largest angle to an item, sizes and domains. Cluster
    ``len(centres)`` holds the zero vectors, whose cosine is 0 with everything."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres

    def describe(self, rows):
        """``rows``: (cl, radius, n, domains), one per cluster that has items."""
        n = len(self.centres) + 1
        self.radius, self.size = np.zeros(n), np.zeros(n, "int64")
        self.domains: list = [()] * n
        for cl, radius, size, domains in rows:
            self.radius[cl], self.size[cl], self.domains[cl] = radius, size, domains
        return self

    def nearest(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, angle) of unit vectors; zero vectors go to the cluster of their own."""
        zero = ~unit.any(1)
        cos = unit @ self.centres.T
        cl = cos.argmax(1)
        angle = np.arccos(np.clip(cos[np.arange(len(unit)), cl], -1, 1))
        return np.where(zero, len(self.centres), cl), np.where(zero, 0.0, angle)

    def bounds(self, unit: np.ndarray, domains: list, w_cos: float, w_dom: float, related: dict, clusters: np.ndarray | None = None,
               centre: bool = False) -> np.ndarray:
        """Upper bounds on the score of every (query, cluster), or of the given clusters; -inf for
        empty clusters. ``centre``: the scores of the clusters' centres instead, no bounds."""
        of = np.arange(len(self.centres) + 1) if clusters is None else clusters
        real = of < len(self.centres)
        cos = np.zeros((len(unit), len(of)))
        x = np.clip(unit @ self.centres[of[real]].T, -1, 1)
        # the cosine of the angle less the radius, or 1 within the radius
        radius = np.minimum(self.radius[of[real]] + 1e-7, np.pi)
        cos[:, real] = x if centre else np.where(x >= np.cos(radius), 1.0, x * np.cos(radius) + np.sqrt((1 - x) * (1 + x)) * np.sin(radius))
        cos[~unit.any(1)] = 0.0
        out = w_cos * cos
        if w_dom:
            best = {}
            for d in set(domains):
                rel = related.get(d, ())
                best[d] = np.array([1.0 if ds is None or d in ds else 0.5 if any(x in rel for x in ds) else 0.0 for ds in (self.domains[c] for c in of)])
            out += w_dom * np.stack([best[d] for d in domains])
        return np.where(self.size[of] > 0, out + _SLACK, -np.inf)


def _units(vecs) -> np.ndarray:
    v = np.vstack(vecs).astype(np.float64)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def _kind(df: DataFrame) -> str:
    """Vectors of floats travel as such, half as wide; they become doubles, unchanged, where they are
    multiplied."""
    return "array<float>" if df.schema["vec"].dataType.simpleString() == "array<float>" else "array<double>"


def _usable(df: DataFrame, id_col: str) -> DataFrame:
    """Rows with an id and a vector of finite numbers; written once, as several jobs read them."""
    order = [F.col("ord").cast("long").alias("ord")] if "ord" in df.columns else []
    x = materialize(df.select(F.col(id_col).cast("long").alias(id_col), F.col("vec").cast(_kind(df)).alias("vec"),
                              F.col("domain").cast("string").alias("domain"), *order))
    fine = F.forall("vec", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    return x.filter(F.col(id_col).isNotNull() & F.col("vec").isNotNull() & fine & (F.size("vec") > 0))


def fit_index(items: DataFrame, n: int, cluster_rows: int = CLUSTER_ROWS) -> MetricIndex:
    """Centres by spherical k-means on at most ``SAMPLE_PER_CLUSTER`` items a cluster, taken by
    the hash of their id."""
    k = max(1, min(MAX_CLUSTERS, math.ceil(n / cluster_rows)))
    share = min(1.0, 1.2 * k * SAMPLE_PER_CLUSTER / max(1, n))
    x = items if share >= 1 else items.filter(F.pmod(F.xxhash64("iid"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = x.select("vec").limit(k * SAMPLE_PER_CLUSTER).toPandas()["vec"]  # k * SAMPLE_PER_CLUSTER rows at most
    unit = _units(sample) if len(sample) else np.zeros((0, 1))
    unit = unit[unit.any(1)]
    if not len(unit):
        return MetricIndex(np.zeros((1, unit.shape[1])))
    centres = unit[np.linspace(0, len(unit) - 1, min(k, len(unit))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centres)
    return MetricIndex(centres)


def indexed(items: DataFrame, cluster_rows: int = CLUSTER_ROWS) -> tuple[DataFrame, MetricIndex]:
    """(iid, vec, domain, ord, cl) of every usable item, stored, and the index over them."""
    items = _usable(items, "iid")
    index = fit_index(items, items.count(), cluster_rows)

    def assign(it):
        for df in it:
            if len(df):
                cl, angle = index.nearest(_units(df["vec"]))
                yield df.assign(cl=cl, angle=angle)

    placed = materialize(items.mapInPandas(assign, f"iid long, vec {_kind(items)}, domain string, ord long, cl long, angle double"))
    # one row per cluster
    stats = placed.groupBy("cl").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    names = placed.select("cl", "domain").distinct()
    few = names.groupBy("cl").agg(F.count("*").alias("d")).filter(F.col("d") <= DOMAINS).join(names, "cl")
    listed: dict = {}
    for cl, domain in few.select("cl", "domain").collect():  # DOMAINS rows a cluster at most
        listed.setdefault(cl, set()).add(domain)
    return placed, index.describe([(r.cl, r.radius, r.n, listed.get(r.cl)) for r in stats.collect()])


#: Bytes of the vectors of a bin, and of a chunk of queries.
BIN_BYTES = 32 << 20


def _bins(index: MetricIndex, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first bin, number of bins) of every cluster: small clusters fill bins of ``rows`` items in
    the order of the coarse direction they point to, larger ones are cut over bins of their own."""
    n = len(index.centres)
    coarse = index.centres[np.linspace(0, n - 1, max(1, math.isqrt(n))).astype(int)]
    order = np.r_[np.argsort((index.centres @ coarse.T).argmax(1), kind="stable"), n]
    first, parts, at, held = np.zeros(n + 1, "int64"), np.ones(n + 1, "int64"), 0, 0
    for c in order:
        size = int(index.size[c])
        if size > rows or held + size > rows:
            at, held = at + (held > 0), 0
        first[c] = at
        if size > rows:
            parts[c] = math.ceil(size / rows)
            at += parts[c]
        else:
            held += size
    return first, parts


def _units_of(left: DataFrame, placed: DataFrame, first: np.ndarray, parts: np.ndarray, chunks: int):
    """Query and item rows of the units (bin, chunk): a query has one row per bin of ``bins``; items
    go to the chunks that visit their bin, and nowhere else."""
    table = placed.sparkSession.createDataFrame([(c, int(f), int(p)) for c, (f, p) in enumerate(zip(first, parts))], "cl long, first long, parts long")  # MAX_CLUSTERS rows at most
    chunk = F.pmod(F.xxhash64("qid"), F.lit(chunks)).alias("chunk")
    left = left.select("qid", "vec", "domain", "visit", "theta", chunk, F.explode("bins").alias("bin"))
    wanted = left.select(F.col("bin").alias("met"), F.col("chunk").alias("by")).distinct()
    right = placed.join(F.broadcast(table), "cl").withColumn("bin", F.col("first") + F.pmod(F.xxhash64("iid"), F.col("parts")))
    right = right.join(wanted, F.col("bin") == F.col("met")).select("iid", "vec", "domain", "ord", "cl", "bin", F.col("by").alias("chunk"))
    return left, right


def knn_blocked(queries: DataFrame, items: DataFrame, k: int, w_cos: float = 1.0, w_dom: float = 0.0,
                related: dict | None = None, exclude_self: bool = False,
                block_rows: int | None = None, cluster_rows: int = CLUSTER_ROWS) -> DataFrame:
    """Exact top-``k`` items per query by ``w_cos·cosine + w_dom·domain_similarity``
    (1 same domain, 0.5 related — directed, 0 else), ties by item ``ord``, then id.

    queries: (qid long, vec array, domain string); items: (iid long, vec array, domain, ord long)
    → (qid, iid, cos, dsim, score, ord, rank). Rows without an id or whose vector is null, empty or
    holds null or non-finite numbers take no part; a zero vector has cosine 0 with all.

    Every query first meets the clusters of nearest centre that hold ``FIRST_ROWS`` items; its ``k``-th
    score there is the threshold, and it then visits the clusters whose bound (cosine at the angle to
    the centre less the radius, and the best domain similarity) reaches it. Only the threshold and
    the bins travel with a query; which clusters it visits is worked out from the index again.

    ``block_rows``: items of a bin and queries of a chunk, by default ``BIN_BYTES`` of vectors.
    """
    placed, index = indexed(items, cluster_rows)
    if not index.size.any():
        return placed.sparkSession.createDataFrame([], KNN_SCHEMA + ", rank int")
    queries = _usable(queries, "qid")
    related = related or {}
    need = max(k + int(exclude_self), FIRST_ROWS)
    rows = block_rows or max(1024, BIN_BYTES // (8 * max(1, index.centres.shape[1])))
    first, parts = _bins(index, rows)

    # the bins of every cluster, as rows of a table
    last = int((first + parts).max())
    held = np.zeros((len(first), last), np.float32)
    for c in range(len(first)):
        held[c, first[c]:first[c] + parts[c]] = 1

    def some_rows(it):
        for df in it:
            for at in range(0, len(df), _ROWS):
                yield df.iloc[at:at + _ROWS]

    def nearest(it):
        for df in some_rows(it):
            score = index.bounds(_units(df["vec"]), df["domain"].tolist(), w_cos, w_dom, related, centre=True)
            order = np.argsort(-score, axis=1, kind="stable")
            met = np.cumsum(index.size[order], axis=1)
            n = np.minimum((met < need).sum(1) + 1, int((index.size > 0).sum()))
            visit = [o[:m] for o, m in zip(order, n)]
            yield df.assign(theta=None, visit=visit, bins=[np.flatnonzero(held[v].any(0)) for v in visit])

    def reached(it):
        for df in some_rows(it):
            bound = index.bounds(_units(df["vec"]), df["domain"].tolist(), w_cos, w_dom, related)
            theta = df["theta"].fillna(-np.inf).to_numpy()
            go = (bound >= theta[:, None]) & np.isfinite(bound)
            to = go.astype(np.float32) @ held > 0
            yield df.assign(theta=theta, visit=None, bins=[np.flatnonzero(g) for g in to])

    shape = f"qid long, vec {_kind(queries)}, domain string, theta double, visit array<long>, bins array<long>"
    q = materialize(queries.mapInPandas(nearest, shape))
    nbins = len({int(b) for f, p, n in zip(first, parts, index.size) if n for b in range(f, f + p)})
    cores = placed.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, math.ceil(q.count() / rows), math.ceil(2 * cores / nbins))
    unit = _block_top_k(index, k, w_cos, w_dom, related, exclude_self)
    best = [F.col("score").desc(), F.col("ord").asc(), F.col("iid").asc()]

    def met(queries):
        left, right = _units_of(queries, placed, first, parts, chunks)
        part = left.groupBy("bin", "chunk").cogroup(right.groupBy("bin", "chunk")).applyInPandas(unit, KNN_SCHEMA)
        return top_k_per_group(part, ["qid"], best, k)

    theta = met(q).groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).alias("theta"))
    # the clusters met first are visited again: every item is met once
    again = q.select("qid", "vec", "domain").join(theta, "qid", "left").mapInPandas(reached, shape)
    return met(materialize(again))


def embedding_match(cvs: DataFrame, offers: DataFrame, k: int = 3, related: dict | None = None,
                    exclude_self: bool = False) -> DataFrame:
    """0.7·cosine + 0.3·domain similarity, top-``k`` offers per CV."""
    return knn_blocked(cvs, offers, k, 0.7, 0.3, related, exclude_self)


def vector_search(queries: DataFrame, items: DataFrame, limit: int = 5, exclude_self: bool = False) -> DataFrame:
    """Top-``limit`` by cosine first, then keep the query-domain matches — or all of them
    when none matches (the limit applies before the filter, so fewer may remain)."""
    top = knn_blocked(queries, items, limit, 1.0, 0.0, None, exclude_self)
    from pyspark.sql import Window
    any_match = F.max(F.col("dsim")).over(Window.partitionBy("qid"))
    return (top.withColumn("_any", any_match)
            .filter((F.col("dsim") == 1.0) | (F.col("_any") == 0.0)).drop("_any"))


def centroids(df: DataFrame, key: str, vec_col: str = "embedding") -> DataFrame:
    """Mean vector per key: (key, centroid array<double>, n). Components are averaged
    with a grouped aggregation over (key, position); no group gathers rows."""
    comp = df.select(key, F.posexplode(to_double(vec_col)).alias("pos", "v"))
    per = comp.groupBy(key, "pos").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    return (per.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("m")))).alias("_c"),
                 F.max("n").alias("n"))
            .select(key, F.transform("_c", lambda e: e["m"]).alias("centroid"), "n"))


def composite_embedding(df: DataFrame, domain_vectors: DataFrame, key: str, vec_col: str = "embedding",
                        w_text: float = 0.7, w_domain: float = 0.3) -> DataFrame:
    """Normalised w_text·v + w_domain·domain_vector; rows whose domain has no vector keep
    the raw vector, unnormalised. ``domain_vectors``: (key, dvec). Plain equi-join: AQE
    turns it into a broadcast only when the measured size is under the threshold."""
    j = df.join(domain_vectors, key, "left")
    mixed = F.zip_with(to_double(vec_col), F.col("dvec"), lambda a, b: a * w_text + b * w_domain)
    return j.withColumn("composite", F.when(F.col("dvec").isNull(), to_double(vec_col)).otherwise(l2_normalize(mixed)))


def similarity_matrix(items: DataFrame) -> DataFrame:
    """All-pairs cosine of a small item set (qid, iid, cos), such as per-label centroids. Its
    result grows with the square of the items: more than ``MAX_MATRIX`` are refused."""
    n = items.count()
    if n > MAX_MATRIX:
        raise ValueError(f"a similarity matrix of {n} items has {n * n} rows; at most {MAX_MATRIX} items are allowed")
    q = items.select(F.col("iid").alias("qid"), "vec", "domain")
    return knn_blocked(q, items, max(1, n), 1.0, 0.0).select("qid", "iid", "cos")
