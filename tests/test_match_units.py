"""Units of the matchers: blocks of classes and chunks of profiles give what all pairs give, and
carry no skill profile of an offer along with a pair."""

import random

import pytest
from pyspark.sql import functions as F

from talentgrid.operators import match as M


def _case(seed, n_offers=120, n_cvs=40):
    rnd = random.Random(seed)
    words = [f"skill{i:02d}" for i in range(60)]
    often = [1 / (i + 1) for i in range(60)]
    offers = [(i if i % 17 else None, f"d{i % 3}", " ".join(set(rnd.choices(words, often, k=25))), "skill00 skill05" if i % 2 else "", round(rnd.random(), 2), i // 2)
              for i in range(n_offers)]
    cvs = [(j, rnd.choice(["d0", "d1", None]), rnd.choices(words, often, k=6)) for j in range(n_cvs)]
    return cvs, offers


@pytest.mark.parametrize("kind", ["rules", "bonus", "weighted"])
def test_small_units_equal_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(M, "BLOCK_CLASSES", 25)
    monkeypatch.setattr(M, "CHUNK_PROFILES", 4)
    cvs, offers = _case(3)
    c = spark.createDataFrame(cvs, "cv_id long, domain string, skills array<string>")
    o = spark.createDataFrame(offers, "offer_id long, domain string, text string, title_lower string, raw_score double, ord long")
    weights = {"d0": {"skill03": 0.2, "skill10": 0.05}, "d1": {"skill04": 0.1}}
    run = {"rules": lambda: M.match_rules(c, o, k=4), "bonus": lambda: M.match_bonus(c, o, k=4),
           "weighted": lambda: M.match_weighted(c, o, weights, k=4)}[kind]
    got = {}
    for r in run().collect():
        got.setdefault(r.cv_id, []).append((r.rank, r.offer_id, round(r.score, 9), r.matched_skills))
    for cv, dom, sk in cvs:
        rows = []
        for oid, od, text, title, raw, ordv in offers:
            has = [s for s in sk if s in text]
            same = (od or "") == (dom or "")
            if kind == "rules":
                s = min(1.0, (0.1 + (0.3 if same else 0.0)) + min(0.6, len(has) / len(sk) * 0.6))
            elif kind == "bonus":
                s = (raw + (0.2 if same else 0.0)) + min(0.3, len(has) * 0.05)
            else:
                last = {x: i for i, x in enumerate(sk)}
                u = sum((15 if last[x] < 3 else 10) + (5 if x in title else 0) for x in has)
                kw = min(30, sum(round(w * 100) for k, w in weights.get(dom, {}).items() if k in text))
                s = min(100, 20 + min(50, u) + kw) / 100
            rows.append((-s, ordv, -1 if oid is None else oid, oid, len(has)))
        rows.sort(key=lambda x: x[:3])
        assert [x[1:] for x in sorted(got[cv])] == [(oid, round(-s, 9), h) for s, _, _, oid, h in rows[:4]], cv


def test_units_carry_no_profiles(spark):
    """Offers of 300 skills each: what goes to the units is their posting lists, each entry once per
    chunk that names the skill, not the profile once per skill."""
    words = [f"w{i:03d}" for i in range(300)]
    offers = [(i, "d", " ".join(words) + f" x{i}", i) for i in range(40)]
    cvs = [(j, "d", [words[j], words[j + 1], f"x{j}"]) for j in range(299)]
    c = spark.createDataFrame(cvs, "cv_id long, domain string, skills array<string>").withColumn("skills", F.slice("skills", 1, 3))
    o = spark.createDataFrame(offers, "offer_id long, domain string, text string, ord long")
    index, prof, scorer = M.rules_search(c, o, 3)
    assert not {"prof", "tprof"} & set(index.members.columns)
    left, right = M._units(index, prof, scorer)
    assert "prof" not in right.columns and left.count() == prof.count()
    named = prof.select("pid", F.explode("sk.no").alias("no")).count()
    entries = right.agg(F.sum(F.size("cids"))).first()[0]
    assert entries <= named * 40
    assert [r.offer_id for r in M.match_rules(c, o, k=1).filter("cv_id < 40").orderBy("cv_id").collect()] == list(range(40))


@pytest.mark.parametrize("rows", [40, 300, None])
def test_bins_of_clusters_equal_all_pairs(spark, monkeypatch, rows):
    """Bins smaller and larger than a cluster, many chunks of queries in a unit; copies of a vector
    stay ties, first by order."""
    import numpy as np
    from talentgrid.operators import vectors as VX
    rng = np.random.default_rng(8)
    v = rng.normal(size=(600, 8)).astype("float64")
    v[400:] = v[rng.integers(0, 20, 200)]
    ords = rng.permutation(600)
    items = spark.createDataFrame([(i, v[i].tolist(), f"d{i % 3}", int(ords[i])) for i in range(600)], "iid long, vec array<double>, domain string, ord long")
    queries = items.select(F.col("iid").alias("qid"), "vec", "domain")
    got = {}
    for r in VX.knn_blocked(queries, items, 4, exclude_self=True, block_rows=rows, cluster_rows=60).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.iid))
    norm = np.linalg.norm(v, axis=1)
    for i in range(600):
        cos = np.round(v @ v[i] / (norm * norm[i]), 12)
        cos[i] = -2
        assert [x for _, x in sorted(got[i])] == np.lexsort((ords, -cos))[:4].tolist(), i


def test_a_query_goes_once_to_a_bin(spark):
    """However many clusters a query visits, its vector is sent once per bin."""
    import numpy as np
    from talentgrid.operators import vectors as VX
    rng = np.random.default_rng(9)
    items = spark.createDataFrame([(i, rng.normal(size=8).tolist(), "d", i) for i in range(500)], "iid long, vec array<double>, domain string, ord long")
    placed, index = VX.indexed(items, 20)
    assert (index.size > 0).sum() >= 20
    first, parts = VX._bins(index, 250)
    held = {}
    for c, n in enumerate(index.size):
        held[first[c]] = held.get(first[c], 0) + int(n)
        assert parts[c] == 1
    assert len([b for b, n in held.items() if n]) <= 4 and max(held.values()) <= 250
    q = items.select(F.col("iid").alias("qid"), "vec", "domain", F.lit(0.0).alias("theta"), F.array(F.lit(0).cast("long")).alias("visit"),
                     F.array(*[F.lit(int(b)).cast("long") for b in set(first)]).alias("bins"))
    left, right = VX._units_of(q, placed, first, parts, 3)
    assert left.count() == 500 * len(set(first)) and right.count() == 500 * 3
