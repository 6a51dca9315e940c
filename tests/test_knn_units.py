"""The search for nearest vectors: one search per result, a first threshold near the last one, and
units that hold no matrix of all their pairs in double precision."""

import tracemalloc
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from talentgrid.operators import match as M
from talentgrid.operators import vectors as VX


def test_hybrid_match_searches_vectors_once(spark):
    """The merge reads the vector results twice; the search behind them is in its plan no more."""
    rng = np.random.default_rng(1)
    cv_vec = spark.createDataFrame([(i, rng.normal(size=4).tolist(), "d") for i in range(20)], "qid long, vec array<double>, domain string")
    of_vec = spark.createDataFrame([(i, rng.normal(size=4).tolist(), "d", i) for i in range(30)], "iid long, vec array<double>, domain string, ord long")
    cvs = spark.createDataFrame([(i, "d", [f"w{i % 3}"]) for i in range(20)], "cv_id long, domain string, skills array<string>")
    offers = spark.createDataFrame([(i, "d", f"w{i % 5}", i) for i in range(30)], "offer_id long, domain string, text string, ord long")
    out = M.hybrid_match(cv_vec, of_vec, cvs, offers, k=3)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInPandas") == 1  # the rules scorer's
    assert out.count() == 60


def _mixed(seed, n):
    """Groups with a common part, and far vectors that make their clusters wide: the bound of most
    clusters is 1 for every query."""
    rng = np.random.default_rng(seed)
    group = rng.integers(0, 20, n)
    v = 0.15 * rng.normal(size=(n, 40))
    v[:, 0] += 1
    v[np.arange(n), 1 + group] += 1
    far = rng.random(n) < 0.1
    v[far] = 0.1 * rng.normal(size=(far.sum(), 40))
    v[far, 0] += 0.3
    v[np.flatnonzero(far), rng.integers(21, 40, far.sum())] += 1
    return v


def test_first_threshold_is_near_the_last(spark, monkeypatch, tmp_path):
    v = _mixed(2, 2000)
    items = spark.createDataFrame([(i, v[i].tolist(), "d", i) for i in range(2000)], "iid long, vec array<double>, domain string, ord long")
    plain, folder = VX._block_top_k, str(tmp_path)

    def noting(*args, **kw):
        unit = plain(*args, **kw)

        def fn(q, it):
            if len(q) and q["visit"].iloc[0] is None:
                q[["qid", "theta"]].to_csv(f"{folder}/{uuid.uuid4().hex}.csv", index=False)
            return unit(q, it)
        return fn

    monkeypatch.setattr(VX, "_block_top_k", noting)
    got = {}
    queries = items.filter("iid % 500 = 7").select(F.col("iid").alias("qid"), "vec", "domain")
    for r in VX.knn_blocked(queries, items, 5, cluster_rows=100).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.iid))
    unit = VX._units(v)
    cos = unit @ unit.T
    for i in range(7, 2000, 500):
        assert [x for _, x in sorted(got[i])] == np.lexsort((np.arange(2000), -np.round(cos[i], 12)))[:5].tolist(), i
    theta = pd.concat([pd.read_csv(f) for f in tmp_path.glob("*.csv")]).drop_duplicates("qid").set_index("qid")["theta"]
    reach = (cos[theta.index] >= theta.to_numpy()[:, None] - 1e-9).sum(1)
    assert len(theta) == 4 and reach.max() < 200, reach  # 5 at the least


def _unit_case(seed, n_items, n_queries, dim, domains, clusters=1, repeated=False):
    rng = np.random.default_rng(seed)
    x, q = rng.normal(size=(n_items, dim)), rng.normal(size=(n_queries, dim))
    names = np.array([f"d{i}" if i else None for i in range(domains)], object)
    idom, qdom = names[rng.integers(0, domains, n_items)], names[rng.integers(0, domains, n_queries)]
    if repeated:  # many ids and vectors come often, some with another length; some are zero
        x[n_items // 2:] = x[rng.integers(0, 9, n_items - n_items // 2)] * rng.choice([1.0, 2.0, 0.5], (n_items - n_items // 2, 1))
        q[::2] = x[rng.integers(0, n_items, len(q[::2]))]
        x[:20], q[:5] = 0, 0
    index = VX.MetricIndex(VX._units(rng.normal(size=(clusters, dim))))
    cl, angle = index.nearest(VX._units(x))
    index.describe([(c, angle[cl == c].max(), (cl == c).sum(), set(idom[cl == c].tolist())) for c in np.unique(cl)])
    iid = rng.integers(0, n_queries, n_items) if repeated else np.arange(n_items)
    it = pd.DataFrame({"iid": iid, "vec": list(x), "domain": idom, "ord": rng.permutation(n_items), "cl": cl})
    queries = pd.DataFrame({"qid": np.arange(n_queries), "vec": list(q), "domain": qdom, "visit": None, "theta": -np.inf})
    return index, queries, it, x, q


@pytest.mark.parametrize("w_cos,w_dom,self_out,domains", [(1.0, 0.0, True, 4), (0.7, 0.3, True, 4), (0.7, 0.3, False, 60)])
def test_unit_equals_all_pairs(monkeypatch, w_cos, w_dom, self_out, domains):
    """Few and many domains in a chunk, slabs smaller than a cluster, repeated ids, ties."""
    monkeypatch.setattr(VX, "QUERIES", 40)
    monkeypatch.setattr(VX, "SLAB", 64)
    monkeypatch.setattr(VX, "COLUMNS", 8)
    index, queries, it, x, q = _unit_case(4, 900, 120, 6, domains, 7, True)
    rel = {"d1": ["d2", "d3", "elsewhere"], "d2": ["d1"]}
    out = VX._block_top_k(index, 4, w_cos, w_dom, rel, self_out)(queries, it)
    got = {}
    for r in out.itertuples():
        got.setdefault(r.qid, []).append((-round(r.score, 9), r.ord, r.iid, r.dsim))
    for i in range(len(q)):
        want, seen = [], {}
        for j in np.lexsort((it["iid"], it["ord"])):
            a, b = queries["domain"][i], it["domain"][j]
            same = (b, x[j].tobytes())
            seen[same] = seen.get(same, -1) + 1
            if seen[same] > 4 or self_out and it["iid"][j] == i:
                continue
            den = np.linalg.norm(q[i]) * np.linalg.norm(x[j])
            dsim = 1.0 if a == b else 0.5 if b in rel.get(a, []) else 0.0
            want.append((-round(w_cos * (q[i] @ x[j] / den if den else 0.0) + w_dom * dsim, 9), it["ord"][j], it["iid"][j], dsim))
        assert sorted(got[i]) == sorted(want)[:4], i


@pytest.mark.parametrize("w_cos,w_dom", [(1.0, 0.0), (0.7, 0.3)])
def test_unit_holds_no_matrix_of_its_pairs(w_cos, w_dom):
    """Ten times the pairs a product holds: what the unit takes beside its vectors stays below two
    products' worth."""
    index, queries, it, x, q = _unit_case(5, 40_000, 512, 16, 10)
    fn = VX._block_top_k(index, 3, w_cos, w_dom, {"d1": ["d2"]}, True)
    tracemalloc.start()
    out = fn(queries, it)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 512 * 3
    assert peak < 64 << 20, peak >> 20


def test_floats_travel_as_floats(spark):
    """Vectors of floats are sent half as wide and give the rows of the same numbers as doubles."""
    rng = np.random.default_rng(6)
    items = spark.createDataFrame([(i, rng.normal(size=8).tolist(), f"d{i % 3}", i) for i in range(300)], "iid long, vec array<float>, domain string, ord long")
    assert VX.indexed(items)[0].schema["vec"].dataType.simpleString() == "array<float>"
    rows = []
    for kind in ("array<float>", "array<double>"):
        x = items.withColumn("vec", F.col("vec").cast(kind))
        rows.append(sorted(tuple(r) for r in VX.knn_blocked(x.select(F.col("iid").alias("qid"), "vec", "domain"), x, 4, 0.7, 0.3, {}, True).collect()))
    assert rows[0] == rows[1] and len(rows[0]) == 1200
