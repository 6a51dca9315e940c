import os

from pyspark.sql import functions as F

from talentgrid import vocab as V
from talentgrid.functions import text as T
from talentgrid.operators import offers as OF
from talentgrid.operators import skills as S
from talentgrid.operators import training as TR
from talentgrid.sources import writers as W


def test_small_operators(spark, tmpdir_path):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (2, "c")], "ord long, v string")
    assert [r.ord for r in OF.cap(df, 2, "ord").collect()] == [1, 2]
    assert OF.cap(df, 0, "ord").count() == 3
    assert OF.point_lookup(df, "ord", 2).first().v == "c"
    d = spark.createDataFrame([("civil_btp",), ("finance",), (None,)], "d string")
    got = [r.c for r in d.select(TR.canonical_domain(F.col("d")).alias("c")).collect()]
    assert got == ["genie_civil_btp", "finance", None]
    got = [r.c for r in d.select(OF.inherit_domain(None, d, "d").alias("c")).collect()]
    assert got == ["civil_btp", "finance", None]
    lab = [r.l for r in d.select(T.domain_label("d").alias("l")).collect()]
    assert lab[0] == "Civil Btp"
    docs = spark.createDataFrame([("kanban scrum",), ("python scrum",)], "text string")
    ds = S.distinct_skills(S.extract_skills(docs, V.TECHNICAL_SKILLS, limit=None), V.TECHNICAL_SKILLS)
    assert sorted((r.skill_ord, r.skill) for r in ds.collect())[0] == (0, "Python")


def test_writers_and_parsers(spark, tmpdir_path):
    offers = spark.createDataFrame([("b1", "1", "Dev", "A", "Paris", "d", 1), ("b1", "2", "Ops", "B", "Lyon", "e", 1)],
                                   "batch string, id string, title string, company string, location string, "
                                   "description string, version int")
    env = W.write_offer_batches(offers.drop("version"), os.path.join(tmpdir_path, "env"), "2025-01-01").first()
    assert env["count"] == 2 and env.timestamp == "2025-01-01"
    assert spark.read.json(os.path.join(tmpdir_path, "env", "jobs")).count() == 2
    W.write_offers(offers, os.path.join(tmpdir_path, "o.csv"))
    W.write_offers(offers, os.path.join(tmpdir_path, "o_parquet"), partition_by=["batch"])
    assert spark.read.parquet(os.path.join(tmpdir_path, "o_parquet")).count() == 2
    upd = spark.createDataFrame([("b2", None, "Dev", "A", "Paris", "d", 2)], offers.schema)
    up = W.upsert_collection(offers, upd, "id", "version").collect()
    assert len(up) == 3   # the row without id gets the md5 id, distinct from "1"
    W.write_evaluation_report(spark.createDataFrame([(0.5, 3)], "accuracy double, samples long"),
                              os.path.join(tmpdir_path, "rep"))
    assert spark.read.json(os.path.join(tmpdir_path, "rep")).first().samples == 3
    ts = spark.createDataFrame([("2025-04-06T04:23:17.580189",), ("2025-04-06T04:23:17",), ("bad",)], "s string")
    got = [r.t for r in ts.select(T.parse_iso_ts("s").alias("t")).collect()]
    assert got[0].microsecond == 580189 and got[1].second == 17 and got[2] is None
    j = spark.createDataFrame([('{"k": 7, "a": {"b": "x"}}',)], "p string")
    assert j.select(T.json_field("p", "$.a.b").alias("x")).first().x == "x"


def test_intent_spaced_and_plain(spark):
    from talentgrid.operators.intent import message_intent
    turns = spark.createDataFrame([
        (1, 0, "user", "Bonjour"), (1, 1, "assistant", "skill"), (1, 2, "user", "quelles compétences ?"),
        (2, 0, "user", "mock"), (2, 1, "user", "interview please"),
        (3, 0, "user", "hello there"), (3, 1, "user", "friend"),
        (4, 0, "user", "rien")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.intent for r in message_intent(turns).collect()}
    assert got == {1: "competences", 2: "entretien", 3: "general", 4: "general"}
    spaced = [("greet", ["there friend"]), ("other", ["xyz"])]
    got = {r.conv_id: r.intent for r in message_intent(turns, spaced).collect()}
    assert got[3] == "greet" and got[1] == "general"
    res = spark.createDataFrame([(4, "x" * 150)], "conv_id long, resume_content string")
    got = {r.conv_id: r.intent for r in message_intent(turns, resume=res).collect()}
    assert got[4] == "cv_evaluation"


def test_caller_vocabulary_of_any_size(spark, monkeypatch):
    from talentgrid.operators import classify as C
    from talentgrid.operators import patterns
    docs = spark.createDataFrame([(1, "python and java")], "doc_id long, text string")
    vdf = V.vocab_frame(spark, {"it": ["python", "java"]})
    hits = C.keyword_hits(docs, vdf, "doc_id", "text", how="inner")
    assert hits.count() == 2
    monkeypatch.setattr(patterns, "CHUNK_TERMS", 1)      # forces the chunked path
    docs2 = spark.createDataFrame([(1, "python and java"), (2, "nothing")], "doc_id long, text string")
    got = sorted((r.doc_id, r.keyword) for r in C.keyword_hits(docs2, vdf, "doc_id", "text").collect())
    assert got == [(1, "java"), (1, "python"), (2, None)]


def test_classifiers_score_rows_not_ids(spark):
    """Equal ids stay rows of their own; a vocabulary of 100,000 words changes nothing."""
    from talentgrid.operators import classify as C
    docs = spark.createDataFrame([(1, "python"), (1, "Python python audit"), (None, None), (2, "zz")], "doc_id long, text string")
    vocab = {"it": ["python"], "fin": ["audit"]}
    large = {"it": ["python", *(f"k{i}x" for i in range(100_000))], "fin": ["audit"]}
    for v in (vocab, large):
        got = C.domain_scores_fallback(docs, v).select("doc_id", "score_0", "score_1", "main_domain").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, [
            (1, 0.525, 0.5, "it"), (1, 0.6, 0.525, "it"), (None, 0.5, 0.5, "it"), (2, 0.5, 0.5, "it")]))
    got = C.domain_scores_basic(docs, vocab, []).select("doc_id", "domain", "score").collect()
    assert sorted(map(tuple, got)) == [(1, "fin", 1.0), (1, "it", 1.0), (1, "it", 1.0)]
    got = C.classify_confidence(docs, vocab, default_domain="none").collect()
    assert sorted((r.classification, r.confidence) for r in got) == [("it", 0.2), ("it", 0.2), ("none", 0.5), ("none", 0.5)]


def test_split_keeps_null_ids_and_ranks_no_stratum(spark):
    from talentgrid.operators import training
    rows = [(None if i % 3 == 0 else i, "a" if i % 2 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label string")
    out = training.stratified_split(df, "label", "id", 0.25)
    got = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert sum(got.values()) == 60 and got[None, "eval"] == 8 and got["a", "eval"] == 8
    plain = training.random_split(df, "id", 0.1)
    assert {r.split: r["count"] for r in plain.groupBy("split").count().collect()} == {"eval": 6, "train": 54}
    # many equal hashes never lie in one ranking: every digit of the hash is refined
    many = spark.range(5000).selectExpr("id", "'x' as label")
    out = training.stratified_split(many, "label", "id", 0.3, small=4)
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"eval": 1500, "train": 3500}
    h = sorted((__import__("hashlib").md5(f"{i}|42".encode()).hexdigest(), i) for i in range(5000))
    assert {r.id for r in out.filter("split = 'eval'").collect()} == {i for _, i in h[:1500]}


def test_classifier_takes_null_texts(spark):
    from talentgrid.operators import ml
    rows = [(i, None if i % 7 == 0 else f"word{i % 2} text", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    _, pred = ml.train_domain_classifier(df, "text", "label", df)
    assert pred.count() == 40 and pred.columns.count("text") == 1


def test_null_labels_and_texts_keep_their_rows(spark):
    from talentgrid.operators import ml, training
    rows = [(i, None if i % 3 == 0 else f"l{i % 3}", None if i % 5 == 0 else f"text {i % 4}") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, label string, text string")
    out = training.stratified_split(df, "label", "id").groupBy("label", "split").count().collect()
    assert sum(r["count"] for r in out) == 30
    assert {r.label: r["count"] for r in out if r.split == "eval"} == {None: 2, "l1": 2, "l2": 2}
    assert ml.embed_texts(df, dim=16).count() == 30
    assert ml.batch_embedding_map(df, dim=16).count() == 30


def test_deeply_nested_page():
    from talentgrid.operators import html_cards as HC
    selectors = {"card": [("div", "job")]}
    page = "<ul>" + "<li>" * 5000 + "<div class='job'>x</div>"
    tree = HC._Tree()
    tree.feed(page)
    assert [HC._text(n) for n in HC._select(tree.root, selectors["card"][0])] == ["x"]
    assert HC._text(tree.root) == "x"
