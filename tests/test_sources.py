import json
import os

from pyspark.sql import functions as F

from talentgrid.operators import classify as C
from talentgrid.operators import match as M
from talentgrid.operators import offers as OF
from talentgrid.operators import training as TR
from talentgrid.sources import readers as R
from talentgrid.sources import writers as W
from talentgrid import vocab as V
from conftest import FIX


def _write(path, obj):
    with open(path, "w", encoding="utf-8") as f:
        json.dump(obj, f, ensure_ascii=False)


def _offer(i, title, company, domain="informatique_reseaux", country="France", score=0.5, **kw):
    d = {"id": i, "title": title, "company": company, "domain": domain, "country": country, "score": score,
         "description": f"{title} chez {company}"}
    d.update(kw)
    return d


def test_read_offers_two_shapes_and_priority(spark, tmpdir_path):
    d = tmpdir_path
    _write(os.path.join(d, "batch_1.json"), {"date": "x", "success_count": 2, "failed_count": 0, "total_count": 2,
                                             "jobs": [_offer("a", "Dev", "A", score=0.2),
                                                      _offer("b", "Ops", "B", score=0.9)]})
    _write(os.path.join(d, "indeed_2.json"), _offer("a", "Dev dup", "A2", score=0.99))
    _write(os.path.join(d, "indeed_3.json"), {"title": "No company"})
    _write(os.path.join(d, "emergency_backup_4.json"), {"jobs": [_offer("c", "Fin", "C", domain="finance")]})
    with open(os.path.join(d, "broken.json"), "w") as f:
        f.write("{not json")
    allo = R.read_offers(spark, d)
    assert sorted(r.id for r in allo.collect()) == ["a", "a", "b", "c"]
    pri = [r.id for r in R.read_offers_prioritised(spark, d, max_results=3).collect()]
    assert pri == ["b", "c", "a"]          # cap in file order (batch first), then sort by score
    fin = [r.id for r in R.read_offers_prioritised(spark, d, domain="finance", max_results=5).collect()]
    assert fin == ["c"]
    re_ = sorted((r.id, r.title) for r in R.read_offers_reimport(spark, d).collect())
    assert re_ == [("a", "Dev"), ("b", "Ops"), ("c", "Fin")]


def test_read_cv_text_encodings_and_batch_match(spark, tmpdir_path):
    d = tmpdir_path
    with open(os.path.join(d, "cv_utf8.txt"), "w", encoding="utf-8") as f:
        f.write("Développeur Python, Docker et Kubernetes, cloud AWS.")
    with open(os.path.join(d, "cv_latin.txt"), "wb") as f:
        f.write("Comptabilité, audit et contrôle de gestion, trésorerie.".encode("latin-1"))
    cv = R.read_cv_text(spark, d)
    texts = {r.cv_id: r.text for r in cv.collect()}
    assert texts["cv_latin"].startswith("Comptabilité") and "Développeur" in texts["cv_utf8"]
    # batch match: analyse every CV and rank offers in one plan
    a = C.analyze_documents(cv, id_col="cv_id").select("cv_id", F.col("main_domain").alias("domain"), "skills")
    offers = spark.createDataFrame([
        (1, "informatique_reseaux", "devops python docker kubernetes", 1),
        (2, "finance", "audit comptable", 2)], "offer_id long, domain string, text string, ord long")
    top = {r.cv_id: r.offer_id for r in M.match_rules(a, offers, k=1, min_score=0.3)
           .collect()}
    assert top == {"cv_utf8": 1, "cv_latin": 2}


def test_annotations_feedback_and_templates(spark, tmpdir_path):
    ann = R.read_annotations(spark, os.path.join(FIX, "annotations.json"))
    rows = {r.cv_id: r for r in ann.collect()}
    assert rows["cv_test_finance"].main_domain == "finance" and len(rows["cv_test_complex"].skills) == 13
    sessions, ratings = R.read_feedback(spark, os.path.join(FIX, "history.json"))
    assert sessions.count() == 1 and ratings.count() == 3
    files = spark.createDataFrame([("/x/cv_a.txt",), ("/y/cv_b.pdf",)], "path string")
    t = {r.cv_id for r in OF.annotation_template(files).collect()}
    assert t == {"cv_a", "cv_b"}


def test_training_sources_and_writers(spark, tmpdir_path):
    d = tmpdir_path
    with open(os.path.join(d, "resume_data.csv"), "w", encoding="utf-8") as f:
        f.write('Resume,Category,Skills\n"Ingénieur réseau\nexpérimenté en cloud",IT,"AWS, Docker"\n"court",IT,\n')
    _write(os.path.join(d, "jobs.json"), [{"description": "Poste de comptable senior à Paris", "role": "Accountant"}])
    src = R.read_training_sources(spark, [os.path.join(d, "resume_data.csv"), os.path.join(d, "jobs.json")])
    ex = TR.build_examples(src)
    got = sorted((r.domain, r.instruction.startswith("Analyse ce CV")) for r in ex.collect())
    assert got == [("finance", False), ("informatique_reseaux", True)]
    dist = W.write_training_set(ex, os.path.join(d, "train_csv"))
    assert {r.domain: r.n for r in dist.collect()} == {"finance": 1, "informatique_reseaux": 1}
    back = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"') \
        .csv(os.path.join(d, "train_csv"))
    assert back.count() == 2
    # envelope / nested run output
    res = spark.createDataFrame([("c1", 1, "o1", 0.9), ("c1", 2, "o2", 0.5)], "cv_id string, rank int, offer_id string, score double")
    ana = spark.createDataFrame([("c1", "finance", ["SAP"])], "cv_id string, main_domain string, skills array<string>")
    run = W.matching_run(ana, res, {"top_k": 5, "min_score": 0.3}, "2025-01-01T00:00:00")
    W.write_matching_run(run, os.path.join(d, "runs"))
    r = spark.read.json(os.path.join(d, "runs")).first()
    assert [x.offer_id for x in r.results] == ["o1", "o2"] and r.parameters.top_k == 5


def test_upserts_and_ingest(spark):
    old = spark.createDataFrame([("s1", "a", 1), ("s2", "b", 1)], "session_id string, v string, n int")
    new = spark.createDataFrame([("s1", "a2", 2), ("s3", "c", 2)], "session_id string, v string, n int")
    got = sorted((r.session_id, r.v) for r in W.upsert_feedback(old, new).collect())
    assert got == [("s1", "a2"), ("s2", "b"), ("s3", "c")]
    offers = spark.createDataFrame([("Dev", "A", "Paris", "desc"), ("", "B", "Lyon", "x")],
                                   "title string, company string, location string, description string")
    ok, bad, cnt = W.ingest_offers(offers)
    c = cnt.first()
    assert (c.success_count, c.failed_count, c.total_count) == (1, 1, 2) and c.success_rate == 50.0
    m = ok.first().metadata
    assert m.domain == "informatique_reseaux" and m.country == "France" and m.source == "indeed"
    assert ok.first().content == "Dev - A\n\ndesc"


def test_format_results_bonus(spark):
    jobs = spark.createDataFrame([
        ("job1", 0.75, ("Développeur Python", "Tech Solutions", "Paris", "informatique_reseaux"),
         "Nous recherchons un développeur Python expérimenté."),
        ("job2", 0.65, ("Data Engineer", "Data Corp", "Lyon", "informatique_reseaux"), "Poste de Data Engineer.")],
        "id string, score double, metadata struct<title:string,company:string,location:string,domain:string>, "
        "content string")
    f = OF.format_offers(jobs)
    for cv_domain, exp in [("informatique_reseaux", 0.95), ("finance", 0.75)]:
        dm = F.col("domain") == F.lit(cv_domain)
        s = f.select("id", M.bonus_score(F.col("score"), F.lit(0), dm).alias("s"), dm.alias("dm")) \
            .orderBy(F.col("s").desc()).first()
        assert s.id == "job1" and abs(s.s - exp) < 1e-12


def test_domain_similarity_and_prompt(spark):
    df = spark.createDataFrame([("civil_btp", "genie_industriel"), ("finance", "finance"), ("finance", "civil_btp")],
                               "a string, b string")
    got = [r.s for r in df.select(M.domain_similarity(F.col("a"), F.col("b"), V.RELATED_DOMAINS).alias("s")).collect()]
    assert got == [0.5, 1.0, 0.0]
    p = {r.domain: r.prompt for r in C.domain_prompt({"finance": ["audit", "bilan"]}, spark).collect()}
    assert p["finance"] == "Domaine: Finance. Mots-clés: audit, bilan"
    assert M.page_size(None) == 5


def test_ingest_scraped_and_storage_summary(spark, tmpdir_path):
    df = spark.createDataFrame([("1", "Comptable", "audit finance bilan", None, 1), ("2", "", "x", None, 2),
                                ("3", "Dev", "python", "informatique_reseaux", 3)],
                               "id string, title string, description string, domain string, ord long")
    out = {r.id: r.domain for r in W.ingest_scraped(df, vocab={"finance": ["audit", "bilan"], "it": ["python"]}).collect()}
    assert out == {"1": "finance", "3": "informatique_reseaux"}
    assert {r.domain for r in W.ingest_scraped(df, domain_override="x").collect()} == {"x"}
    for name in ["batch_1.json", "indeed_2.json", "emergency_backup_3.json"]:
        _write(os.path.join(tmpdir_path, name), {})
    s = {r.file_class: r.files for r in R.storage_summary(spark, tmpdir_path, "2100-01-01 00:00:00").collect()}
    assert s == {0: 1, 1: 1, 2: 1}


def test_ingest_scraped_repeated_and_null_ids(spark):
    rows = [("1", "A", "audit bilan", None, 1), ("1", "B", "python python", None, 2), (None, "C", "audit", None, 3),
            (None, "D", "python", None, 4), ("1", "A", "audit bilan", None, 5)]
    df = spark.createDataFrame(rows, "id string, title string, description string, domain string, ord long")
    out = {r.ord: r.domain for r in W.ingest_scraped(df, vocab={"finance": ["audit", "bilan"], "it": ["python"]}).collect()}
    assert out == {1: "finance", 2: "it", 3: "finance", 4: "it", 5: "finance"}


def test_prompt_dataset_and_small_helpers(spark, tmpdir_path):
    d = tmpdir_path
    with open(os.path.join(d, "cv_data.csv"), "w", encoding="utf-8") as f:
        f.write("text,category\n" + "\n".join(f'"Profil numéro {i} avec expérience",IT' for i in range(3)) + "\n")
    out = TR.prompt_dataset(spark, [os.path.join(d, "cv_data.csv")], ["informatique_reseaux", "finance"], 5,
                            os.path.join(d, "prompts"))
    rows = out.collect()
    assert len(rows) == 5 and all(r.formatted_text.startswith("<s>[INST] ") for r in rows)
    assert sum(1 for r in rows if r.variant >= 0) == 2
    # A6 text csv, H8 fallback id, H17 percent, A15 embeddings writer
    txt = R.read_text_csv(spark, os.path.join(d, "cv_data.csv"), "text")
    assert txt.count() == 3
    from talentgrid.functions.ids import fallback_offer_id
    from talentgrid.functions.text import percent
    x = spark.createDataFrame([(None, "Dev", "A", "Desc", 0.125)], "id string, t string, c string, d string, p double")
    r = x.select(fallback_offer_id("id", "t", "c", "d").alias("i"), percent("p").alias("pc")).first()
    import hashlib
    assert r.i == hashlib.md5("dev|A|desc".encode()).hexdigest() and r.pc == 13
    emb = spark.createDataFrame([([0.1, 0.2], "t", "finance", 0.9)], "embedding array<double>, text string, "
                                                                     "classification string, confidence double")
    meta = W.write_embeddings(emb, os.path.join(d, "emb"), "cv.csv", "text").first()
    assert meta.dim == 2 and meta.n == 1
    assert R.read_embeddings(spark, os.path.join(d, "emb", "data")).count() == 1
