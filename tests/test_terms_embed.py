"""Key terms with only part of the counts broadcast; vectors normalised once; texts cut once."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from talentgrid.functions import vectors as FV
from talentgrid.operators import ml as ML
from talentgrid.operators import terms as TM


@pytest.mark.parametrize("shared", [0, 5, 200_000])
def test_key_terms_of_frequent_and_rare_terms(spark, monkeypatch, shared):
    monkeypatch.setattr(TM, "SHARED_TERMS", shared)
    rnd = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(80)]
    docs = [(i % 50 if i % 9 else None, " ".join(rnd.choices(words, [1 / (j + 1) for j in range(80)], k=30)) if i % 7 else None) for i in range(90)]
    got = {}
    for r in TM.key_terms(spark.createDataFrame(docs, "id long, text string"), "id", "text", 4, []).collect():
        got.setdefault(r.id, []).append((r.term_rank, r.term, r.tf, r.df, round(r.tfidf, 9)))
    tf = {}
    for i, t in docs:
        tf.setdefault(i, Counter()).update((t or "").split())
    df = Counter(w for c in tf.values() for w in c)
    for i, c in tf.items():
        want = sorted((-n * math.log(len(docs) / df[w]), w, n) for w, n in c.items())[:4]
        assert sorted(got.get(i, [])) == [(r + 1, w, n, df[w], round(-s, 9)) for r, (s, w, n) in enumerate(want)]


def test_terms_are_not_shuffled_by_document(spark):
    """Only the n best of a document leave it: the (id, term) rows have no exchange of their own."""
    docs = spark.range(200).select("id", F.lit("alpha beta gamma delta epsilon zeta eta theta iota kappa").alias("text"))
    plan = TM.key_terms(docs, "id", "text", 2, [])._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan, "texts are cut into terms before, and only ranked rows are read here"


def test_normalising_takes_the_norm_once(spark):
    v = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda x: x.cast("double")).alias("v"))
    plan = v.select(FV.l2_normalize("v").alias("u"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("sqrt") == 1
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([None, 1.0],)], "v array<double>")
    assert [r.u for r in rows.select(FV.l2_normalize("v").alias("u")).collect()] == [[0.6, 0.8], [0.0, 0.0], None, [None, None]]


def test_training_reads_texts_once_per_side(spark):
    """The texts of the training side are cut into tokens once, however many passes the fits take."""
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    tagged = F.udf(seen, "string")
    rows = spark.createDataFrame([(f"{'red blue' if i % 2 else 'green'} word{i % 5}", float(i % 2)) for i in range(40)], "t string, label double")
    ev = spark.createDataFrame([("red blue", 1.0), ("green", 0.0), (None, 0.0)], "t string, label double")
    model, pred = ML.train_domain_classifier(rows.withColumn("t", tagged("t")), "t", "label", ev)
    assert [r.prediction for r in pred.collect()][:2] == [1.0, 0.0]
    assert read.value == 40
    assert len(model.stages) == 4


def test_embedding_reads_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    rows = spark.createDataFrame([(i, f"a b{i % 3} c{i}" if i % 4 else None) for i in range(20)], "id long, t string")
    out = ML.embed_texts(rows.withColumn("t", F.udf(seen, "string")("t")), "t", dim=16)
    got = out.select("id", "embedding").collect()
    assert len(got) == 20 and read.value <= 20
