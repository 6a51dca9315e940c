"""Blocks of the matchers: the search stands once in a plan, and profiles go only to the blocks that
could better what they have."""

import uuid

import pytest

from talentgrid.operators import match as M


def _case(spark):
    words = ["alpha", "beta", "gamma", "delta"]
    # all words and keywords in many offers: the capped score is reached early in the order
    offers = [(i, f"offer{i} " + " ".join(words if i % 3 else words[:1]) + (" key lock" if i % 2 else ""), "alpha" if i % 5 == 0 else "", 1000 - i)
              for i in range(400)]
    cvs = [(j, ["x", None, "y"][j % 3], [*words, f"offer{j}"] if j % 4 else [f"offer{j}"]) for j in range(60)]
    return (spark.createDataFrame(cvs, "cv_id long, domain string, skills array<string>"),
            spark.createDataFrame(offers, "offer_id long, text string, title_lower string, ord long"), cvs, offers)


def test_weighted_search_stands_once_in_the_plan(spark):
    """The names of the skills found come with the profile, not from a second run of the search."""
    c, o, _, _ = _case(spark)
    plan = M.match_weighted(c, o, {"x": {"key": 0.2}}, k=3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1


@pytest.mark.parametrize("block", [40, 1 << 16])
def test_profiles_go_only_to_blocks_that_could_better_them(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(M, "BLOCK_CLASSES", block)
    plain, folder = M._unit_search, str(tmp_path)

    def noting(*args, **kw):
        unit = plain(*args, **kw)

        def fn(profiles, rows):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(len(profiles) if len(rows) else 0))
            return unit(profiles, rows)
        return fn

    monkeypatch.setattr(M, "_unit_search", noting)
    c, o, cvs, offers = _case(spark)
    weights = {"x": {"key": 0.2, "lock": 0.1}, "y": {"key": 0.05}}
    got = {}
    for r in M.match_weighted(c, o, weights, k=3).collect():
        got.setdefault(r.cv_id, []).append((r.rank, r.offer_id, round(r.score, 9), r.matched_skills, sorted(r.skill_matches)))
    for cv, dom, sk in cvs:
        rows = []
        for oid, text, title, ordv in offers:
            has = [s for s in sk if s in text]
            u = sum((15 if sk.index(s) < 3 else 10) + (5 if s in title else 0) for s in has)
            kw = min(30, sum(round(w * 100) for x, w in weights.get(dom, {}).items() if x in text))
            rows.append((-min(100, 20 + min(50, u) + kw) / 100, ordv, oid, len(has), sorted(has)))
        rows.sort()
        assert [x[1:] for x in sorted(got[cv])] == [(oid, -s, h, has) for s, _, oid, h, has in rows[:3]], cv
    met = sum(int(f.read_text()) for f in tmp_path.iterdir())
    per_group = 400 / block if block < 400 else 1
    assert met < 60 * per_group * 0.75 if block < 400 else met == 60, met


def test_posting_lists_of_a_batch():
    import pandas as pd
    x = pd.DataFrame({"grp": ["a", "a", "b", "a"], "block": [0, 0, 1, 0], "cid": [7, 3, 5, 9],
                      "prof": [[1, 2], [2], [1], []], "tprof": [[2, 8], [], None, [1]]})
    out = sorted((r.grp, r.block, r.no, sorted(r.cids), sorted(r.tcids)) for df in M._lists([x]) for r in df.itertuples())
    assert out == [("a", 0, 1, [7], []), ("a", 0, 2, [3, 7], [7]), ("b", 1, 1, [5], [])]
