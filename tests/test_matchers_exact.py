"""The candidate-generation matchers must equal brute force over all pairs, including a
hot profile holding most offers and CVs without skills."""

import random

from pyspark.sql import functions as F

import pytest

from talentgrid.operators import match as M

SKILLS = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
DOMAINS = ["d0", "d1", "d2"]
WEIGHTS = {"d0": {"alpha": 0.08, "kw0": 0.07}, "d1": {"beta": 0.06, "kw1": 0.05}, "d2": {"kw2": 0.04, "gamma": 0.07}}


def _data(seed):
    rnd = random.Random(seed)
    offers = []
    for i in range(60):
        hot = i % 3 != 0      # two thirds of offers share one profile
        words = ["alpha", "beta"] if hot else rnd.sample(SKILLS + ["kw0", "kw1", "kw2"], rnd.randint(0, 4))
        title = " ".join(rnd.sample(words, min(1, len(words))))
        text = (title + " " + " ".join(words) + " filler").lower()
        offers.append((i, "d0" if hot else rnd.choice(DOMAINS), text, title.lower(), round(rnd.random(), 3), i))
    cvs = []
    for j in range(25):
        sk = [s.capitalize() for s in rnd.sample(SKILLS, rnd.randint(0, 4))]
        cvs.append((j, rnd.choice(DOMAINS), sk))
    cvs.append((99, "d1", ["Alpha", "Beta", "Alpha"]))      # duplicated skill
    return cvs, offers


def _frames(spark, cvs, offers):
    c = spark.createDataFrame(cvs, "cv_id long, domain string, skills array<string>")
    o = spark.createDataFrame(offers, "offer_id long, domain string, text string, title_lower string, "
                                      "raw_score double, ord long")
    return c, o


def _topk(scored, k):
    out = {}
    for cv, lst in scored.items():
        lst.sort(key=lambda x: (-x[1], x[2]))
        out[cv] = [(oid, round(s, 9)) for oid, s, _ in lst[:k]]
    return out


def _got(df):
    out = {}
    for r in df.orderBy("cv_id", "rank").collect():
        out.setdefault(r.cv_id, []).append((r.offer_id, round(r.score, 9)))
    return out


@pytest.mark.parametrize("seed,ms", [(1, 0.3), (2, 0.3), (6, 0.75), (7, 0.85)])
def test_rules_equals_brute_force(spark, seed, ms):
    cvs, offers = _data(seed)
    c, o = _frames(spark, cvs, offers)
    k = 4
    got = _got(M.match_rules(c, o, k=k, min_score=ms))
    exp = {}
    for cv, dom, sk in cvs:
        lst = []
        for oid, odom, text, _, _, ordv in offers:
            h = sum(1 for s in sk if s.lower() in text)
            sb = min(0.6, (h / len(sk)) * 0.6) if sk else 0.0
            s = min(1.0, (0.1 + (0.3 if odom == dom else 0.0)) + sb)
            if s >= ms:
                lst.append((oid, s, ordv))
        exp[cv] = lst
    exp = {k_: v for k_, v in _topk(exp, k).items() if v}
    assert exp and got == exp


def test_bonus_equals_brute_force(spark):
    cvs, offers = _data(3)
    c, o = _frames(spark, cvs, offers)
    got = _got(M.match_bonus(c, o, k=3))
    exp = {}
    for cv, dom, sk in cvs:
        lst = []
        for oid, odom, text, _, raw, ordv in offers:
            h = sum(1 for s in sk if s.lower() in text)
            lst.append((oid, (raw + (0.2 if odom == dom else 0.0)) + min(0.3, h * 0.05), ordv))
        exp[cv] = lst
    assert got == _topk(exp, 3)


def test_weighted_equals_brute_force(spark):
    cvs, offers = _data(4)
    c, o = _frames(spark, cvs, offers)
    got = _got(M.match_weighted(c, o, WEIGHTS, k=3))
    exp = {}
    for cv, dom, sk in cvs:
        low = [s.lower() for s in sk]
        w = {}
        for i, s in enumerate(low):
            w[s] = 15 if i < 3 else 10
        lst = []
        for oid, _, text, title, _, ordv in offers:
            su = 0
            for s in low:
                if s in text:
                    su += w[s] + (5 if s in title else 0)
            ku = sum(int(round(v * 100)) for kw, v in WEIGHTS[dom].items() if kw in text)
            lst.append((oid, min(100, 20 + min(50, su) + min(30, ku)) / 100.0, ordv))
        exp[cv] = lst
    assert got == _topk(exp, 3)


def test_plan_has_no_cartesian_and_limits_windows(spark):
    cvs, offers = _data(5)
    c, o = _frames(spark, cvs, offers)
    df = M.match_rules(c, o, k=3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "WindowGroupLimit" in plan


def test_hybrid_match_equals_composition(spark):
    from talentgrid.operators import dedup as DD
    from talentgrid.operators import vectors as VX
    cvs, offers = _data(8)
    c, o = _frames(spark, cvs, offers)
    import random
    rnd = random.Random(3)
    cv_vec = spark.createDataFrame([(cv, [rnd.random() for _ in range(4)], dom) for cv, dom, _ in cvs],
                                   "qid long, vec array<double>, domain string")
    of_vec = spark.createDataFrame([(oid, [rnd.random() for _ in range(4)], dom, ordv)
                                    for oid, dom, _, _, _, ordv in offers],
                                   "iid long, vec array<double>, domain string, ord long")
    got = sorted((r.cv_id, r.rank, r.offer_id, r.source)
                 for r in M.hybrid_match(cv_vec, of_vec, c, o, k=3, min_score=0.3).collect())
    vec = VX.vector_search(cv_vec, of_vec, limit=3).select(
        F.col("qid").alias("cv_id"), F.col("iid").alias("offer_id"), F.col("cos").alias("score"), "rank")
    scr = M.match_rules(c, o, k=3, min_score=0.3).select("cv_id", "offer_id", "score", "rank")
    exp = sorted((r.cv_id, r.rank, r.offer_id, r.source) for r in DD.hybrid_merge(vec, scr, 3).collect())
    assert got == exp and len(got) > 0


def test_knn_blocks_and_ties_equal_brute_force(spark):
    import math
    from talentgrid.operators import vectors as VX
    rnd = random.Random(11)
    base = [[rnd.choice([0.0, 1.0, 2.0]) for _ in range(3)] for _ in range(6)]
    items = [(i, base[i % 6], f"d{i % 3}", 100 - i) for i in range(30)]     # many exact ties
    queries = [(q, base[(q * 5) % 6], f"d{q % 3}") for q in range(12)]
    rel = {"d0": ["d1"], "d2": ["d0"]}
    qdf = spark.createDataFrame(queries, "qid long, vec array<double>, domain string")
    idf = spark.createDataFrame(items, "iid long, vec array<double>, domain string, ord long")
    got = sorted((r.qid, r.rank, r.iid) for r in
                 VX.knn_blocked(qdf, idf, 4, 0.7, 0.3, rel, exclude_self=True, block_rows=7).collect())

    def cosine(a, b):
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        return 0.0 if na * nb == 0 else sum(x * y for x, y in zip(a, b)) / (na * nb)
    exp = []
    for q, qv, qd in queries:
        sc = []
        for i, iv, idom, o in items:
            if i == q:
                continue
            ds = 1.0 if idom == qd else (0.5 if idom in rel.get(qd, []) else 0.0)
            sc.append((-(0.7 * cosine(qv, iv) + 0.3 * ds), o, i))
        sc.sort()
        exp += [(q, r + 1, i) for r, (_, _, i) in enumerate(sc[:4])]
    assert got == sorted(exp)


def _plain_rules(cvs, offers, k, ms=0.0, separate=False):
    exp = {}
    for cv, dom, sk in cvs:
        low = [s.lower() for s in sk or [] if s is not None]
        lst = []
        for oid, odom, title, desc, ordv in offers:
            both = f"{title or ''}\0{desc or ''}" if separate else f"{title or ''} {desc or ''}"
            h = sum(1 for s in low if s and s in both.lower())
            same = (odom or "") == (dom or "") and (not separate or bool(dom))
            sb = min(0.6, (h / len(low)) * 0.6) if low else 0.0
            s = min(1.0, (0.1 + (0.3 if same else 0.0)) + sb)
            if s >= ms:
                lst.append((oid, s, ordv))
        exp[cv] = lst
    return {c: v for c, v in _topk(exp, k).items() if v}


@pytest.mark.parametrize("separate", [False, True])
def test_cvs_of_any_domain_and_any_skill(spark, separate):
    """Null, empty and unlisted domains on both sides, free, repeated, null and empty skill
    lists, skills over the border of title and description."""
    rnd = random.Random(21)
    words = [f"w{i}" for i in range(40)]
    doms = ["d0", "d1", None, "", "nowhere"]
    offers = [(i, rnd.choice(doms[:4]), " ".join(rnd.sample(words, 3)), " ".join(rnd.sample(words, rnd.randint(0, 12))) or None, i % 50)
              for i in range(120)]
    cvs = [(j, rnd.choice(doms), rnd.sample(words, rnd.randint(0, 6)) + ([f"{rnd.choice(words)} {rnd.choice(words)}"] if j % 3 == 0 else []))
           for j in range(40)]
    cvs += [(90, None, None), (91, "nowhere", []), (92, "d0", ["W1", "w1", None, "no such thing"]), (93, None, ["zzz"])]
    c = spark.createDataFrame(cvs, "cv_id long, domain string, skills array<string>")
    o = spark.createDataFrame(offers, "offer_id long, domain string, title string, description string, ord long")
    o = o.withColumn("text", F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))))
    got = {}
    for r in M.match_rules(c, o, k=4, separate=separate).collect():
        got.setdefault(r.cv_id, []).append((r.rank, r.offer_id, round(r.score, 9)))
    want = _plain_rules(cvs, [(i, d, t, x, (n, i)) for i, d, t, x, n in offers], 4, separate=separate)
    assert set(got) == {cv for cv, _, _ in cvs}
    assert {cv: [x[1:] for x in sorted(v)] for cv, v in got.items()} == want


def test_threshold_reads_few_pairs(spark):
    """With 150 skills the postings read hold a small part of the pairs that share a skill."""
    rnd = random.Random(22)
    skills = [f"skill{i:03d}" for i in range(150)]
    often = [1 / (i + 1) for i in range(150)]
    offers = [(i, f"d{i % 4}", " ".join(set(rnd.choices(skills, often, k=10))), i) for i in range(1500)]
    cvs = [(j, f"d{j % 5}", list(dict.fromkeys(rnd.choices(skills, often, k=8)))) for j in range(150)]
    c = spark.createDataFrame(cvs, "cv_id long, domain string, skills array<string>")
    o = spark.createDataFrame(offers, "offer_id long, domain string, text string, ord long")
    index, prof, scorer = M.rules_search(c, o, 3)
    head = M.visits(prof, scorer, index.most, 0, 1, F.lit(None).cast("double"))
    rows = M.search(c, index, prof, scorer, 3)
    theta = rows.groupBy("pid").agg(F.min("score").alias("kth"))
    rest = M.visits(prof.join(theta, "pid"), scorer, index.most, 1, None, F.col("kth"))
    read = M._met(head, index, scorer).count() + M._met(rest, index, scorer).count()
    shared = sum(1 for _, _, sk in cvs for _, _, text, _ in offers if set(sk) & set(text.split()))
    assert read < 0.25 * shared
    got = {}
    for r in rows.collect():
        got.setdefault(r.cv_id, []).append((r.rank, r.offer_id, round(r.score, 9)))
    want = _plain_rules(cvs, [(i, d, "", t, n) for i, d, t, n in offers], 3)
    assert {cv: [x[1:] for x in sorted(v)] for cv, v in got.items()} == want


def _plain_knn(queries, items, k, w_cos, w_dom, rel, self_out):
    import numpy as np
    fine = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)
    out = {}
    for q, qv, qd in queries:
        sc = []
        for i, iv, idom, o in items:
            if not fine(qv) or not fine(iv) or self_out and q == i:
                continue
            a, b = np.array(qv), np.array(iv)
            den = np.linalg.norm(a) * np.linalg.norm(b)
            ds = 1.0 if idom == qd else (0.5 if idom in rel.get(qd, []) else 0.0)
            sc.append((-round(w_cos * (0.0 if den == 0 else float(a @ b) / den) + w_dom * ds, 9), o, i))
        sc.sort()
        out[q] = [(i, -s) for s, _, i in sc[:k]]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("w_cos,w_dom,self_out", [(1.0, 0.0, False), (0.7, 0.3, True)])
def test_metric_index_equals_brute_force(spark, w_cos, w_dom, self_out):
    """Clustered vectors in small clusters and units, with zero, null and broken ones and ties;
    far fewer clusters are visited than there are (query, cluster) pairs."""
    import numpy as np
    from talentgrid.operators import vectors as VX
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 16))
    doms = ["d0", "d1", "d2", None]
    vec = lambda c: (centre[c] + 0.12 * rng.normal(size=16)).tolist()
    items = [(i, vec(i % 12), doms[i % 4], i * 13 % 997) for i in range(900)]
    items += [(2000 + i, items[i][1], items[i][2], items[i][3]) for i in range(5)]                   # copies
    items += [(3000, [0.0] * 16, "d0", 1), (3001, None, "d0", 2), (3002, [float("nan")] * 16, "d1", 3), (3003, [None] * 16, "d1", 4)]
    queries = [(i, items[i][1], items[i][2]) for i in range(0, 900, 9)] + [(5000, [0.0] * 16, "d1"), (5001, None, "d0"), (5002, vec(3), "elsewhere")]
    rel = {"d0": ["d1"], "d2": ["d0"]}
    qdf = spark.createDataFrame(queries, "qid long, vec array<double>, domain string")
    idf = spark.createDataFrame(items, "iid long, vec array<double>, domain string, ord long")
    got = {}
    for r in VX.knn_blocked(qdf, idf, 4, w_cos, w_dom, rel, self_out, block_rows=30, cluster_rows=40).collect():
        got.setdefault(r.qid, []).append((r.rank, r.iid, round(r.score, 9)))
    want = _plain_knn(queries, items, 4, w_cos, w_dom, rel, self_out)
    assert {q: [s for _, _, s in sorted(v)] for q, v in got.items()} == {q: [s for _, s in v] for q, v in want.items()}
    assert {q: [i for _, i, _ in sorted(v)] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    # visits that the bounds leave, at the true thresholds
    placed, index = VX.indexed(idf, 40)
    some = [(q, v, d) for q, v, d in queries if q < 5000]
    bound = index.bounds(VX._units([v for _, v, _ in some]), [d for _, _, d in some], w_cos, w_dom, rel)
    theta = np.array([want[q][-1][1] for q, _, _ in some])
    assert (bound >= theta[:, None]).mean() < 0.35
    assert VX.knn_blocked(qdf, idf.limit(0), 3).count() == 0 and VX.knn_blocked(qdf.limit(0), idf, 3).count() == 0


def test_similarity_matrix_refuses_many(spark):
    from talentgrid.operators import vectors as VX
    many = spark.range(VX.MAX_MATRIX + 1).selectExpr("id as iid", "array(1.0D) as vec", "'c' as domain", "id as ord")
    with pytest.raises(ValueError):
        VX.similarity_matrix(many)
