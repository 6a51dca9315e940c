"""Golden values recomputed from the application's recorded evaluations."""

import json
import os

from pyspark.sql import functions as F

from talentgrid import vocab as V
from talentgrid.operators import classify as C
from talentgrid.operators import evaluate as EV
from conftest import FIX

IT = """
        Ingénieur en développement logiciel avec 5 ans d'expérience en Python, JavaScript et React.
        Compétences en DevOps avec Docker et Kubernetes. Expérience dans le développement d'API REST
        et d'applications web. Certification AWS Solutions Architect.
        """
FIN = """
        Analyste financier avec 8 ans d'expérience en contrôle de gestion et comptabilité.
        Expertise en analyse budgétaire, reporting financier et audit interne.
        Maîtrise des outils SAP Finance et Excel avancé.
        """
AUTO = """
        Ingénieur automaticien spécialisé en programmation d'automates Siemens et Schneider.
        Développement de solutions SCADA et mise en place de systèmes de supervision industrielle.
        Expérience en robotique et systèmes embarqués.
        """


def _analyze(spark, rows):
    df = spark.createDataFrame(rows, "doc_id string, text string")
    return {r.doc_id: r for r in C.analyze_documents(df, V.FALLBACK_KEYWORDS, V.TECHNICAL_SKILLS).collect()}


def test_unit_texts_main_domain(spark):
    out = _analyze(spark, [("it", IT), ("fin", FIN), ("auto", AUTO)])
    assert out["it"].main_domain == "informatique_reseaux" and abs(out["it"].main_score - 0.70) < 1e-9
    assert out["fin"].main_domain == "finance" and abs(out["fin"].main_score - 0.70) < 1e-9
    assert out["auto"].main_domain == "automatismes_info_industrielle" and abs(out["auto"].main_score - 0.65) < 1e-9
    assert len(out["it"].skills) > 0


def _cv_rows():
    d = os.path.join(FIX, "cv_test")
    return [(f[:-4], open(os.path.join(d, f), encoding="utf-8").read()) for f in sorted(os.listdir(d))]


def test_annotated_cvs_accuracy_and_skills(spark):
    ann = json.load(open(os.path.join(FIX, "annotations.json"), encoding="utf-8"))
    out = _analyze(spark, _cv_rows())
    # the complex CV ties 1.0 / 1.0 between IT and automation: first domain in order wins
    assert out["cv_test_complex"].main_domain == "informatique_reseaux"
    assert out["cv_test_complex"].score_0 == 1.0 and out["cv_test_complex"].score_1 == 1.0
    assert out["cv_test_finance"].main_domain == "finance"
    assert out["cv_test_genie_civil"].main_domain == "genie_civil_btp"
    rows = [(k, a["main_domain"], out[k].main_domain, a["skills"], list(out[k].skills)) for k, a in ann.items()]
    df = spark.createDataFrame(rows, "cv_id string, true_domain string, pred_domain string, "
                                     "true_skills array<string>, pred_skills array<string>")
    acc = EV.domain_accuracy(df).first()
    assert abs(acc.accuracy - 2 / 3) < 1e-12 and acc.samples == 3
    prf = EV.skills_prf(df).first()
    assert abs(prf.precision - 0.4148148148148148) < 1e-12
    assert abs(prf.recall - 0.3538461538461539) < 1e-12
    assert abs(prf.f1 - 0.38093058733791) < 1e-12
    cm = {(r.true_label, r.pred_label): r.n for r in EV.confusion_matrix(df, V.DOMAINS).collect()}
    assert len(cm) == 25
    assert cm[("automatismes_info_industrielle", "informatique_reseaux")] == 1
    assert cm[("finance", "finance")] == 1 and cm[("genie_civil_btp", "genie_civil_btp")] == 1
    assert sum(cm.values()) == 3


def test_domain_test_texts(spark):
    data = json.load(open(os.path.join(FIX, "domain_test.json"), encoding="utf-8"))
    rows = [(str(i), d["text"]) for i, d in enumerate(data)]
    out = _analyze(spark, rows)
    pairs = [(str(i), d["expected_domain"], out[str(i)].main_domain, d["expected_skills"], list(out[str(i)].skills))
             for i, d in enumerate(data)]
    df = spark.createDataFrame(pairs, "cv_id string, true_domain string, pred_domain string, "
                                      "true_skills array<string>, pred_skills array<string>")
    assert EV.domain_accuracy(df).first().accuracy == 1.0
    prf = EV.skills_prf(df).first()
    assert abs(prf.precision - 0.8861111111111111) < 1e-12
    assert abs(prf.recall - 0.7133333333333333) < 1e-12
    assert abs(prf.f1_of_means - 0.7903901817760796) < 1e-12


def test_guess_and_classify(spark):
    df = spark.createDataFrame([("1", "Développeur Python", "cloud devops"), ("2", "Chef", "rien du tout")],
                               "doc_id string, title string, description string")
    g = {r.doc_id: r.guessed_domain for r in C.guess_domain(df).collect()}
    assert g["1"] == "informatique_reseaux"
    c = {r.doc_id: (r.classification, r.confidence)
         for r in C.classify_confidence(df.withColumn("text", F.concat_ws(" ", "title", "description"))).collect()}
    assert c["1"][0] == "informatique_reseaux" and c["2"] == ("informatique_reseaux", 0.5)


def test_vocabulary_sanity():
    assert list(V.DOMAIN_KEYWORDS) == V.DOMAINS
    assert all(len(v) > 5 for v in V.DOMAIN_KEYWORDS.values())
    for d, rel in V.DOMAIN_RELATIONS.items():
        assert all(r in V.DOMAINS for r in rel)
    assert len(V.TECHNICAL_SKILLS) == 127 and len(V.COMMON_SKILLS) == 45


def test_functional_core_texts(spark):
    out = _analyze(spark, [("a", "Ingénieur en développement logiciel avec expérience en Python et DevOps")])
    assert out["a"].main_domain == "informatique_reseaux" and len(out["a"].skills) > 0
    job = spark.createDataFrame([("j", "Développeur Python Senior",
                                  "Nous recherchons un développeur Python avec expérience en DevOps et AWS")],
                                "doc_id string, title string, description string")
    assert C.guess_domain(job).first().guessed_domain == "informatique_reseaux"


def test_basic_and_extended_analysers_on_unit_text(spark):
    df = spark.createDataFrame([("it", IT)], "doc_id string, text string")
    basic = {r.domain: r.score for r in C.domain_scores_basic(df).collect()}
    # "web" and "javascript", "react" hit developpement_web; skills JavaScript/React add 0.5 each
    assert basic["developpement_web"] > basic.get("cybersecurite", 0)
    ext = {r.domain: r.score for r in C.domain_scores_extended(
        df, V.DOMAIN_KEYWORDS, V.TECHNICAL_SKILLS, {"Python": "informatique_reseaux", "Docker": "informatique_reseaux"}
    ).collect()}
    assert max(ext, key=ext.get) == "informatique_reseaux" and all(0 <= v <= 1 for v in ext.values())
