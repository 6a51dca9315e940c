import random
import re

from pyspark.sql import functions as F

from talentgrid.llm import pii
from tests.llm.helpers import SCHEMA, awkward_rows, documents, prose

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    worth = [int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits))]
    return sum(worth) % 10 == 0


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                  "card": lambda d=digits: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(5)
    parts = ["a", "b.c", "@", "x@y.z", "1", "12", "255", "256", "007", ".", "-", " ", "+", "(", ")", "+1", "4111111111111111",
             "4111 1111 1111 1111", "é", "\n", "_", "%", "1.2.3.4", "5.6", "+49 30 1234567", "😀", "00", "9"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(1500)]
    rows += [(None, None), (5000, ""), (5002, "a" * 100000), (5003, "+" + "(" * 50000), (5005, "a@b.c " * 1000), (5006, "1." * 20000)]
    got = {r.id: [(s.start, s.kind, s.end) for s in r.base] for r in pii.base(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: plain(t) for i, t in rows} == got


def test_very_long_digit_runs(spark):
    rows = [(1, "1" * 200000), (2, "1 " * 100000), (3, "x4111 1111-1111 1111y"), (4, "0" * 12)]
    got = {r.id: [(s.start, s.kind, s.end) for s in r.base] for r in pii.base(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: plain(t) for i, t in rows}


def corpus():
    rows = [(i, f"dear zorblax quux contact joe{i % 2}@x.org or the manager plonk and some words", "en", "a") for i in range(8)]
    return rows + [(100 + i, f"the manager and some words dear contact or number{i}", "en", "b") for i in range(60)]


def test_terms_that_disclose(spark):
    rows = corpus()
    got = {r.id: r for r in pii.spans(documents(spark, rows, clash=True)).collect()}
    words = {w for i, t, *_ in rows for s in got[i].terms for w in [t[s.start:s.end]]}
    assert words == {"zorblax", "quux", "plonk"}
    assert all(not got[i].terms and not got[i].base for i in range(100, 160))


def test_terms_far_from_the_entity(spark):
    """A name in the heading and an address in the footer; every occurrence is marked, words
    that touch a span are not."""
    filler = " ".join(f"the manager and some words dear contact or line{i % 3}" for i in range(20))
    rows = [(i, f"Zorblax report\n{filler}\nétazorjoe@x.org\n{filler} ZORBLAX quux7joe@x.org, +49 30 1234567, joe@x.org 😀zorblax", "en", "a") for i in range(4)]
    rows += [(100 + i, filler + f" number{i}", "en", "b") for i in range(60)]
    rows.append(rows[0])
    got = {r.id: [rows[0][1][t.start:t.end] for t in r.terms] for r in pii.spans(documents(spark, rows)).collect() if r.terms}
    assert got == {i: ["Zorblax", "report", "ZORBLAX", "zorblax"] for i in range(4)}
    assert not any("zorblax" in r.text.lower() for r in pii.sanitise(documents(spark, rows)).collect())


def test_disclosure_share_equals_its_formula(spark):
    import math
    rows = corpus()
    df = documents(spark, rows)
    near = pii.contexts(pii.base(df))
    pairs = {(r.entity, r.term): r.share for r in pii.disclosures(near, df, F.col("text"), len(rows), generalise_at=-9.0).collect()}
    n, has = len(rows), lambda w: [i for i, t, *_ in rows if w in t.split()]
    for (entity, term), share in pairs.items():
        e = [i for i, t, *_ in rows if entity[2:] in t]
        both = [i for i in e if term in rows[[r[0] for r in rows].index(i)][1].split()]
        want = math.log2(n * len(both) / (len(e) * len(has(term)))) / math.log2(n / len(e))
        assert abs(share - want) < 1e-9
    assert len(pairs) >= 10


def test_sanitise(spark):
    df = documents(spark, corpus() + awkward_rows(), clash=True)
    out = pii.sanitise(df)
    assert out.columns == df.columns and out.count() == df.count()
    texts = {r.doc_id: r.text for r in out.filter("doc_id = 100 or doc_id is null or doc_id = 1").collect()}
    first = pii.sanitise(documents(spark, corpus())).filter("doc_id = 0").first().text
    assert first == "dear [TERM] [TERM] contact [EMAIL] or the manager [TERM] and some words" \
        or first == "dear   contact [EMAIL] or the manager  and some words"
    assert None in texts
    removed = pii.sanitise(documents(spark, corpus()), remove_at=0.0).filter("doc_id = 0").first().text
    assert "zorblax" not in removed and "[TERM]" not in removed
    assert pii.sanitise(spark.createDataFrame([], SCHEMA)).count() == 0
    both = spark.createDataFrame([(1, "x 1.2.3.4@b.c y +1.2.3.4.5.6.7.8.9 z")], "doc_id long, text string")
    assert pii.sanitise(both).first().text == "x [EMAIL] y [PHONE] z"


def test_only_sql_functions(spark):
    plan = pii.spans(documents(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_terms_counted_alike_with_and_without_broadcast(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, f"{prose(rng, 30)} mail{i % 5}@x.org secret{i % 5} project{i % 7}", "en", "a") for i in range(80)]
    docs = documents(spark, rows)
    show = lambda: sorted(map(str, pii.spans(docs).select("id", "terms").collect()))
    some = show()
    assert any("removed=True" in r for r in some)
    monkeypatch.setattr(pii, "BROADCAST_TERMS", -1)
    assert show() == some


def test_counting_parts_first_changes_nothing(spark, monkeypatch):
    rng = random.Random(31)
    rows = [(i, f"{prose(rng, 20)} mail{i % 6}@x.org secret{i % 6} project{i % 7} often{i % 2}", "en", "a") for i in range(90)]
    rows += [(1000 + i, f"{prose(rng, 20)} often{i % 2} project{i % 7}", None, None) for i in range(300)] + [(None, None, None, None)] * 3
    docs = documents(spark, rows)
    near = pii.contexts(pii.base(docs))
    show = lambda **x: sorted(map(str, pii.disclosures(near, docs, F.col("text"), len(rows), **x).collect()))
    some, low = show(), show(generalise_at=0.3)
    assert any("secret" in r for r in some) and not any("often" in r for r in some) and len(low) > len(some)
    monkeypatch.setattr(pii, "COUNTED_FIRST", ())
    assert show() == some and show(generalise_at=0.3) == low
