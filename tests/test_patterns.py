"""Terms found by the automaton against str.count."""

import random

from talentgrid.operators import patterns


def _plain(text, terms):
    return sorted((no, (text or "").count(t)) for no, t in terms if t and t in (text or ""))


def test_equals_count(spark, monkeypatch):
    rnd = random.Random(1)
    terms = [(i, "".join(rnd.choice("abé ") for _ in range(rnd.randint(1, 5)))) for i in range(300)] + [(900, None), (901, ""), (902, "aa"), (903, "aa")]
    rows = [(i % 40, "".join(rnd.choice("abé c") for _ in range(rnd.randint(0, 300)))) for i in range(60)]
    rows += [(1, None), (1, ""), (None, "aaaaa"), (2, "a" * 20000)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    t = spark.createDataFrame(terms, "no long, term string")
    want = sorted(((i, x, _plain(x, terms)) for i, x in rows), key=str)
    for chunk in (patterns.CHUNK_TERMS, 50):   # also in many chunks
        monkeypatch.setattr(patterns, "CHUNK_TERMS", chunk)
        got = patterns.find_terms(df, "text", t)
        assert got.columns == ["id", "text", "hits"]
        assert sorted(((r.id, r.text, [tuple(h) for h in r.hits]) for r in got.collect()), key=str) == want
    assert patterns.find_terms(df, "text", t.limit(0)).filter("size(hits) > 0").count() == 0
    assert patterns.find_terms(df.limit(0), "text", t).count() == 0


def test_hundred_thousand_terms(spark):
    t = spark.range(100_000).selectExpr("id as no", "concat('k', id, ' ') as term")
    df = spark.createDataFrame([(7, "x k12 k99999 k5"), (7, "k12 k12 k100000 ")], "id long, text string")
    got = sorted([[tuple(h) for h in r.hits] for r in patterns.find_terms(df, "text", t).collect()])
    assert got == [[(12, 1), (99999, 1)], [(12, 2)]]
