import os
import re

import pytest
from pyspark.sql import functions as F

from talentgrid.llm import quality
from talentgrid.llm.common import stored
from tests.llm.helpers import awkward_rows, documents

SPACE = "\x20\x09\x0A\x0B\x0C\x0D"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = {g: 0 for g in grams}
    for g in grams:
        count[g] += 1
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


TEXTS = ["", None, "one", "a b c a b c a b", "x y x y x y", "same\nsame\n same\nsame\n\n \t\nend", "é😀 | # **   b\x0bc\x0cd\re",
         "w " * 20000, "\n" * 500, "a b c\na b c\n" * 3, "1 2 3 4 1 2 3 9 2 3 4"]


def test_measures_equal_plain_counting(spark):
    rows = [(i, t, "en", "a") for i, t in enumerate(TEXTS)] + awkward_rows()
    m = quality.measures(documents(spark, rows, clash=True), F.col("text"))
    got = m.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], *plain(r[1])) for r in rows), key=str)


def test_base_rule_and_posterior(spark):
    import math
    rows = [(1, "w " * 49, "en", "a"), (2, " ".join(f"w{i}" for i in range(50)), "en", "a"), (3, "a b c " * 30, "en", "a"), (4, None, None, None)]
    v = quality.votes(quality.measures(documents(spark, rows), F.col("text")))
    assert {r.doc_id: r.base_failed for r in v.select("row.doc_id", "base_failed").collect()} == {1: True, 2: False, 3: True, 4: True}
    weights = [0.5 + j for j in range(len(quality.RULES))]
    for r in quality.scored(v, weights).collect():
        want = 1 / (1 + math.exp(-sum(a * w for a, w in zip(r.votes, weights))))
        assert abs(r.quality - want) < 1e-12 and r.kept == (not r.base_failed and want >= 0.5)


def test_em_learns_which_rules_agree(spark):
    """Two rules that agree beat a third that contradicts them."""
    rows = [([1, 1, -1],)] * 200 + [([-1, -1, 1],)] * 100 + [([1, 1, 1],)] * 50 + [([0, 0, 0],)] * 5
    w = quality.fit(spark.createDataFrame(rows, "votes array<int>"))
    assert w[0] > 2 * w[2] and w[1] > 2 * w[2] and all(x > 0 for x in w)
    assert quality.fit(spark.createDataFrame([], "votes array<int>")) == []


def _varied(n, words=("river", "stone", "winter", "garden", "light", "morning", "silver", "road", "answer", "letter")):
    return [f"{words[(i * 7 + i // 10) % 10]}{chr(97 + i % 23)}{chr(97 + i // 23)}" for i in range(n)]


CLEAN = {
    "danda": "\n".join(" ".join(f"शब्द{chr(0x0915 + (i * 5 + j) % 30)}{chr(0x0915 + (i + j * 7) % 29)}" for j in range(20)) + "।" for i in range(6)),
    "verse": "\n".join(" ".join(_varied(126)[i * 6:i * 6 + 6]) + ("," if i % 2 else "") for i in range(21)),
    "list": "\n".join("- " + " ".join(_varied(140)[i * 4:i * 4 + 4]) for i in range(35)),
    "quotes": "\n".join("“" + " ".join(_varied(144)[i * 18:i * 18 + 18]).capitalize() + ".”" for i in range(8)),
    "no stops": "\n".join(" ".join(_varied(120)[i * 20:i * 20 + 20]) for i in range(6)),
}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables not present")
def test_clean_texts_of_other_forms_are_kept(spark):
    """Among ordinary documents: a lone bad vote doesn't reject, two that agree do."""
    ordinary = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    noisy = "\n".join(" ".join(w + "#*" for w in _varied(200)[i * 20:i * 20 + 20]) for i in range(10))
    rows = [(-1 - i, t, "en", "a") for i, t in enumerate([*CLEAN.values(), noisy])]
    v = quality.votes(quality.measures(ordinary.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), F.col("text")))
    weights, prior = quality.estimate(v)
    assert 0 < prior <= 3
    s = quality.scored(v, weights, prior=prior).filter("row.doc_id < 0").select("row.doc_id", "kept", "votes").collect()
    assert {r.doc_id: r.kept for r in s} == {**{-1 - i: True for i in range(len(CLEAN))}, -1 - len(CLEAN): False}
    one = {r.doc_id: sum(x < 0 for x in r.votes) for r in s}
    assert one[-5] == 1 and one[-6] >= 2  # lines without stops: one bad vote; symbols: several


def test_the_share_of_good_documents(spark):
    """Without votes it stays a half; with rules that agree it follows the documents, within bounds."""
    none = spark.createDataFrame([([0, 0],)] * 50, "votes array<int>")
    assert quality.estimate(none) == ([pytest.approx(1.7346, abs=1e-3)] * 2, 0.0)
    many = spark.createDataFrame([([1, 1],)] * 800 + [([-1, -1],)] * 200, "votes array<int>")
    assert 1.2 < quality.estimate(many)[1] < 1.5
    few = spark.createDataFrame([([1, 1],)] * 100 + [([-1, -1],)] * 900, "votes array<int>")
    assert quality.estimate(few)[1] == 0.0


def test_empty(spark):
    v = quality.votes(quality.measures(documents(spark, []), F.col("text")))
    assert quality.scored(v, quality.fit(v)).count() == 0


def test_only_sql_functions(spark):
    v = quality.votes(quality.measures(documents(spark, awkward_rows()), F.col("text")))
    plan = quality.scored(v, [1.0] * len(quality.RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_verdict_against_labels(spark):
    docs = spark.read.parquet(SF + "/documents.parquet").select("doc_id", "text")
    v = stored(quality.votes(quality.measures(docs, F.col("text"))), "votes")
    s = quality.scored(v, quality.fit(v)).filter("not base_failed").select("row.doc_id", "kept")
    s = s.join(spark.read.parquet(SF + "/labels.parquet").select("doc_id", F.col("quality").alias("good")), "doc_id")
    rate = {r.good: r.k for r in s.groupBy("good").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()}
    assert rate[1] > 0.99 and rate[0] < 0.05
