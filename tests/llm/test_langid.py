import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from talentgrid.llm import langid, queries
from tests.llm.helpers import awkward_rows, documents


def rows(seed=1, n=60):
    rng = random.Random(seed)
    sounds = {"aa": ["ba", "ko", "mi", "ta"], "bb": ["str", "eng", "isch", "ver"], "cc": ["eau", "ille", "que", "é"]}
    out = []
    for i in range(n):
        lang = list(sounds)[i % 3]
        out.append((i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(40)), lang, "s"))
    return out


def plain_model(train):
    trees = {}
    for _, text, lang, _ in train:
        if text is not None and lang is not None:
            for w in text.encode().split():
                x = b" " + w + b" "
                for i in range(1, len(x)):
                    for k in range(min(i, langid.ORDER) + 1):
                        trees.setdefault(lang, {}).setdefault(x[i - k:i], Counter())[x[i]] += 1
    return trees


def plain_bits(tree, text):
    bits = 0.0
    for w in text.encode().split():
        x = b" " + w + b" "
        for i in range(1, len(x)):
            for k in range(min(i, langid.ORDER), -1, -1):
                seen = tree.get(x[i - k:i])
                if seen is None:
                    continue
                total, kinds = sum(seen.values()), len(seen)
                if x[i] in seen:
                    bits -= math.log2(seen[x[i]] / (total + kinds))
                    break
                bits -= math.log2(kinds / (total + kinds))
            else:
                bits += 8
    return bits


def test_code_lengths_and_choice(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_WORDS", 30)
    monkeypatch.setattr(langid, "MAX_GRAMS", 200)
    train = rows()
    test = rows(2, 30) + awkward_rows()
    df = documents(spark, train).withColumnRenamed("doc_id", "id")
    langs, trees = langid.fit(df.select("id", "text", "lang"))
    want = plain_model(train)
    assert {x: {c: (n, s) for c, (n, s) in t.items()} for x, t in zip(langs, trees)} == \
        {x: {c: (sum(s.values()), dict(s)) for c, s in t.items()} for x, t in want.items()}
    got = {(r.id, r.lang_pred, round(r.score, 9)) for r in langid.predict(documents(spark, test, clash=True), (langs, trees)).collect()}
    expect = set()
    for i, text, *_ in test:
        if text is None or not any(c.isalpha() for c in text):
            expect.add((i, "und", 0.0))
            continue
        bits = [plain_bits(want[x], text) for x in langs]
        best = min(range(3), key=lambda k: bits[k])
        expect.add((i, langs[best], round(1 / sum(2.0 ** max(-1000, min(bits) - b) for b in bits), 9)))
    assert got == expect


def test_nothing_learned_and_empty(spark):
    none = documents(spark, []).select(F.col("doc_id").alias("id"), "text", "lang")
    model = langid.fit(none)
    assert {r.lang_pred for r in langid.predict(documents(spark, awkward_rows()), model).collect()} == {"und"}
    assert langid.predict(documents(spark, []), model).count() == 0


def test_sample_is_bounded(spark):
    df = documents(spark, rows(1, 90)).select(F.col("doc_id").alias("id"), "text", "lang")
    assert langid.sample(df, max_docs=5).groupBy("lang").count().agg(F.max("count")).first()[0] == 5
    size = langid.sample(df, max_bytes=2000).withColumn("b", F.octet_length("text")).groupBy("lang").agg(F.sum("b").alias("b"))
    assert size.agg(F.max("b")).first()[0] <= 2000


def test_sample_counts_copies_once_and_long_texts_last(spark):
    """2000 equal rows are one text; a text beyond the bytes does not end the sample."""
    some = [(i, t, "aa", "s") for i, t, lang, _ in rows(3, 60) if lang == "aa"]
    long = [(1000 + i, "ba ko " * 2000, "aa", "s") for i in range(5)]
    df = documents(spark, some + long + [(5000, "mi ta ko", "aa", "s")] * 2000).select(F.col("doc_id").alias("id"), "text", "lang")
    got = Counter(r.text for r in langid.sample(df, max_bytes=10_000).collect())
    assert got == Counter([t for _, t, *_ in some] + ["mi ta ko"])
    # only a text beyond the bytes: it is taken all the same
    only = documents(spark, long[:1]).select(F.col("doc_id").alias("id"), "text", "lang")
    assert langid.sample(only, max_bytes=100).count() == 1


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_held_out_accuracy(spark):
    got = queries.QUERIES["op6_language_id"](spark, SF).filter("held_out")
    lang = spark.read.parquet(SF + "/documents.parquet").select("doc_id", "lang")
    hit = got.join(lang, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert hit > 0.97
