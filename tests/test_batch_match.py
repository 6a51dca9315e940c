"""A failing CV gives an error row and stops nothing."""

from pyspark.sql import functions as F

from talentgrid.operators import classify as C
from talentgrid.operators import match as M


def _analyse(cvs):
    return C.analyze_documents(cvs, id_col="cv_id").select("cv_id", F.col("main_domain").alias("domain"), "skills")


def _run(spark, files, **kw):
    f = spark.createDataFrame(files, "path string, content binary")
    offers = spark.createDataFrame([(1, "informatique_reseaux", "devops python docker kubernetes", 1), (2, "finance", "audit comptable", 2)],
                                   "offer_id long, domain string, text string, ord long")
    return {r.path: r for r in M.batch_match(f, offers, _analyse, **kw).collect()}


FILES = [("/a/it.txt", b"Developpeur Python, Docker et Kubernetes, cloud AWS."), ("/a/fin.TXT", "Comptabilité, audit et trésorerie.".encode("latin-1")),
         ("/a/scan.pdf", b"%PDF"), ("/a/empty.txt", b" \n"), ("/a/lost.txt", None), ("/a/photo.png", b"x"), ("/b/it.txt", b"Python et Docker")]


def test_error_rows(spark):
    got = _run(spark, FILES, k=1, min_score=0.3)
    assert set(got) == {p for p, _ in FILES if not p.endswith("png")}
    assert got["/a/it.txt"].results[0].offer_id == 1 and got["/a/fin.TXT"].results[0].offer_id == 2
    assert got["/a/it.txt"].cv_id == got["/b/it.txt"].cv_id == "it" and got["/b/it.txt"].results[0].offer_id == 1
    bad = {p: r.error for p, r in got.items() if r.error}
    assert set(bad) == {"/a/scan.pdf", "/a/empty.txt", "/a/lost.txt"} and "pdf" in bad["/a/scan.pdf"]
    assert all(got[p].results == [] and got[p].main_domain is None for p in bad)


def test_fallback_has_no_offers_and_extractors_may_fail(spark):
    def extract(path, content):
        if b"PDF" in content:
            raise KeyError("broken page")
        return content.decode("latin-1")
    got = _run(spark, FILES, use_fallback=True, extract=extract)
    assert got["/a/it.txt"].main_domain == "informatique_reseaux" and all(r.results == [] for r in got.values())
    assert got["/a/scan.pdf"].error == "KeyError: 'broken page'"
    assert _run(spark, []) == {}
