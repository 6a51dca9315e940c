import random

from talentgrid.operators import dedup as DD


def _greedy(rows):
    kept, seen_ids, seen_tc = [], set(), set()
    for o, i, t, c in sorted(rows):
        if i in seen_ids or (t, c) in seen_tc:
            continue
        kept.append(o)
        seen_ids.add(i)
        seen_tc.add((t, c))
    return set(kept)


def test_greedy_matches_sequential(spark):
    rnd = random.Random(7)
    rows = []
    for case in range(40):
        n = rnd.randint(1, 12)
        for j in range(n):
            rows.append((case * 100 + j, f"{case}-i{rnd.randint(0, 3)}", rnd.choice([None, "t1", "t2"]),
                         f"{case}-" + rnd.choice(["c1", "c2"])))
    df = spark.createDataFrame(rows, "ord long, id string, title string, company string")
    got = {r.ord for r in DD.greedy_dedup(df, "id", ["title", "company"], "ord").filter("kept").collect()}
    exp = set()
    for case in range(40):
        exp |= _greedy([r for r in rows if r[0] // 100 == case])
    assert got == exp


def test_chain_case_two_passes_would_fail(spark):
    # a(t1,i1) b(t2,i1) c(t2,i3): greedy keeps a and c
    df = spark.createDataFrame([(1, "i1", "t1", "x"), (2, "i1", "t2", "x"), (3, "i3", "t2", "x")],
                               "ord long, id string, title string, company string")
    got = {r.ord for r in DD.greedy_dedup(df, "id", ["title", "company"], "ord").filter("kept").collect()}
    assert got == {1, 3}


def test_keep_first_and_examples(spark):
    df = spark.createDataFrame([(3, "k", "x"), (1, "k", "y"), (2, None, "z"), (5, None, "w")],
                               "ord long, key string, v string")
    got = sorted((r.ord, r.v) for r in DD.keep_first(df, ["key"], "ord").collect())
    assert got == [(1, "y"), (2, "z")]
    ex = spark.createDataFrame([(1, "I", "a" * 2500, "o", "d"), (2, "I", "a" * 150, "o", "d"), (3, "J", "b", "o", "d")],
                               "ord long, instruction string, input string, output string, domain string")
    out = sorted((r.ord, len(r.input)) for r in DD.dedup_examples(ex).collect())
    assert out == [(1, 2000), (3, 1)]


def test_hybrid_merge(spark):
    v = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.5, 2)], "cv_id long, offer_id string, score double, rank int")
    s = spark.createDataFrame([(1, "a", 0.99, 1), (1, "c", 0.5, 1), (1, "d", 0.7, 2)],
                              "cv_id long, offer_id string, score double, rank int")
    out = [(r.offer_id, r.source) for r in DD.hybrid_merge(v, s, 3).orderBy("rank").collect()]
    assert out == [("a", "vector"), ("d", "scraped"), ("b", "vector")]


def test_fast_path_when_ids_imply_title_company(spark):
    from pyspark.sql import functions as F
    from talentgrid.functions.ids import offer_id
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["Dev", "Ops"]), rnd.choice(["A", "B"]), rnd.choice(["Paris", "Lyon"]),
             rnd.choice(["x", "y"])) for i in range(40)]
    df = spark.createDataFrame(rows, "ord long, title string, company string, location string, description string") \
        .withColumn("id", offer_id("title", "company", "location", "description"))
    slow = {r.ord for r in DD.greedy_dedup(df, "id", ["title", "company"], "ord").filter("kept").collect()}
    fast = {r.ord for r in DD.greedy_dedup(df, "id", ["title", "company"], "ord", key1_implies_key2=True)
            .filter(F.col("kept")).collect()}
    assert slow == fast and len(fast) == 4


def test_null_ids_are_one_key(spark):
    rows = [(1, None, "a", "x"), (2, None, "b", "x"), (3, "i", "b", "x"), (4, "j", None, None), (5, "k", None, None)]
    df = spark.createDataFrame(rows, "ord long, id string, title string, company string")
    out = DD.greedy_dedup(df, "id", ["title", "company"], "ord")
    assert out.count() == 5
    assert {r.ord for r in out.filter("kept").collect()} == _greedy(rows) == {1, 3, 4}


def test_long_chain(spark):
    """Each row conflicts with the one before; every other one stays."""
    rows = [(i, f"i{i // 2}", f"t{(i + 1) // 2}", "x") for i in range(140)]
    df = spark.createDataFrame(rows, "ord long, id string, title string, company string").coalesce(1)
    got = {r.ord for r in DD.greedy_dedup(df, "id", ["title", "company"], "ord").filter("kept").collect()}
    assert got == _greedy(rows) and len(got) == 70
