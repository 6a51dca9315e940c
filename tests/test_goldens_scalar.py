import json
import os

from pyspark.sql import functions as F

from talentgrid.functions import ids as IDS
from talentgrid.functions import text as T
from talentgrid.operators import feedback as FB
from talentgrid.operators import html_cards as HC
from talentgrid.sources import readers as R
from conftest import FIX

SALARY = [
    ("Salaire: entre 40K€ et 50K€ selon expérience", "40K"),
    ("30k à 45k€", "30k à 45k"),
    ("30 000 - 45 000 €", "000 €"),
    ("30 000 - 45 000 EUR", "30 000 - 45 000"),
    ("10 ans d'expérience", "10"),
    ("45000-55000 € par an", "55000 €"),
    ("12000-18000 MAD par mois", "12000-18000"),
    ("10000-15000dh", "10000-15000"),
    ("30-45 KDH", "45 K"),
    ("5 ans", None),
    ("entre 40\u00a0000 € et 50 000 €", "000 €"),
]


def test_salary_goldens(spark):
    df = spark.createDataFrame([(s,) for s, _ in SALARY], "t string")
    got = [r.s for r in df.select(T.extract_salary("t").alias("s")).collect()]
    assert got == [e for _, e in SALARY]


def test_location_and_ids(spark):
    df = spark.createDataFrame([("Paris - 75001",), (" 12 rue, Lyon ",), ("Nowhere",)], "l string")
    fr = [r.x for r in df.select(T.normalize_location("l", "fr").alias("x")).collect()]
    assert fr == ["Paris", "Lyon", "France"]
    ma = [r.x for r in df.select(T.normalize_location("l", "ma").alias("x")).collect()]
    assert ma == ["Maroc", "Maroc", "Maroc"]
    o = spark.createDataFrame([("Développeur Python", "Test Inc.", "Paris", "Poste de développeur Python")],
                              "title string, company string, location string, description string")
    assert o.select(IDS.offer_id("title", "company", "location", "description").alias("i")).first().i == \
        "0b539465af997b59344c270b95a970aa"


def test_session_id_and_agreement(spark):
    tr = json.load(open(os.path.join(FIX, "test_results.json"), encoding="utf-8"))
    df = spark.createDataFrame([(tr["cv_analysis"]["main_domain"], tr["cv_analysis"]["skills"], tr["timestamp"])],
                               "d string, s array<string>, ts string")
    assert df.select(IDS.session_id("d", "s", "ts").alias("x")).first().x == "88b2a6aee6d8cb0e12d72f9880c54dba"
    sessions, ratings = R.read_feedback(spark, os.path.join(FIX, "history.json"))
    stats = FB.feedback_stats(sessions.select("cv_domain", F.col("feedback.overall_rating").alias("overall_rating")),
                              FB.valid_ratings(ratings))
    allrow = [r for r in stats.collect() if r.domain == "__all__"][0]
    assert abs(allrow.agreement_pct - 57.77614476666666) < 1e-9
    assert allrow.avg_overall == 4.0 and allrow.sessions == 1


CARD = """<section><div class="job-card"><h2 class="job-title">{title}</h2><div class="job-location">{place}</div>
<div class="company-name">{firm}</div><div class="job-description"><ul><li>{text}</li></ul></div></div></section>"""
CARDS = [("Boulanger de nuit", "Marseille (13)", "Four & Fils", "Horaires décalés. Salaire : 31K€ brut."),
         ("Chargé de paie", "Toulouse", "Cabinet Orme", "Logiciel de paie, rigueur, télétravail."),
         ("Grutier", "Quelque part", "Levage Sud", "Rémunération 38K€, panier repas.")]


def test_html_cards_sample(spark):
    html = "<main>" + "".join(CARD.format(title=t, place=p, firm=f.replace("&", "&amp;"), text=x) for t, p, f, x in CARDS) + "</main>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    cards = HC.card_offers(HC.html_cards(pages, HC.SAMPLE_SELECTORS), "fr").orderBy("card_pos").collect()
    assert [c.title for c in cards] == [t for t, _, _, _ in CARDS]
    assert [c.company for c in cards] == [f for _, _, f, _ in CARDS]
    assert [c.location for c in cards] == ["Marseille", "Toulouse", "France"]
    assert [c.salary for c in cards] == ["31K", None, "38K"]


def test_html_to_text(spark):
    h = '<html><head><script>var t="</p>";</script><style>p{}</style></head><body><p>A &amp; B</p><!-- c --><p>C</p></body></html>'
    df = spark.createDataFrame([(h,)], "h string")
    assert df.select(T.html_to_text("h").alias("t")).first().t == "A & B C"


def test_truncate_search_query_url(spark):
    df = spark.createDataFrame([("informatique_reseaux", ["Python", "Docker", "AWS", "Git"]), ("x", [])],
                               "d string, s array<string>")
    q = [r.q for r in df.select(T.search_query("d", "s").alias("q")).collect()]
    assert q == ['(développeur OR devops OR ingénieur) "Python" "Docker" "AWS"', "développeur OR ingénieur"]
    u = df.select(T.url_quote(F.lit("a b/c")).alias("u")).first().u
    assert u == "a%20b/c"
    t = spark.createDataFrame([("x" * 250,)], "t string").select(T.truncate("t", 200).alias("t")).first().t
    assert len(t) == 203 and t.endswith("...")
