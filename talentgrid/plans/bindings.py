"""Test bindings: how the recruitment operators map onto the driver's tables.

The synthetic prose holds no recruitment words, so queries pass *test vocabularies*
through the very same operators: the four "domains" are the four languages of
``documents`` (keywords = frequent function words, space-delimited so that the
substring rule still discriminates), which makes ``documents.lang`` a genuine ground
truth for the evaluation operators. CVs are ``documents``; job offers are ``pages``
(title = the page ``<title>``, description = visible text), matching the reference
flow "raw pages → offer cards → matching".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.functions.text import html_to_text

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# test vocabulary: domain = language, keywords = frequent function words
LANG_VOCAB = {
    "en": [" the ", " and ", " of ", " that ", " with "],
    "fr": [" la ", " des ", " que ", " une ", " pour "],
    "de": [" die ", " der ", " und ", " nicht ", " sich "],
    "es": [" los ", " del ", " las ", " por ", " para "],
}
LANGS = list(LANG_VOCAB.keys())

# test skill vocabulary (ordered; display case kept, matched lower-cased)
TEST_SKILLS = ["The", "And", "That", "With", "From", "Pour", "Dans", "Avec", "Nicht", "Sich",
               "Para", "Por", "License", "Token"]

# weighted keywords per domain for the weighted scorer
LANG_WEIGHTS = {
    "en": {" the ": 0.08, " and ": 0.07, " of ": 0.05, " that ": 0.06, " with ": 0.05, " from ": 0.04},
    "fr": {" la ": 0.08, " des ": 0.07, " que ": 0.05, " une ": 0.06, " pour ": 0.05, " dans ": 0.04},
    "de": {" die ": 0.08, " der ": 0.07, " und ": 0.05, " nicht ": 0.06, " sich ": 0.05, " mit ": 0.04},
    "es": {" los ": 0.08, " del ": 0.07, " las ": 0.05, " por ": 0.06, " para ": 0.05, " con ": 0.04},
}

# directed relation graph between the test domains (similarity 0.5)
LANG_RELATED = {"en": ["de"], "fr": ["es"], "de": ["en"], "es": ["fr", "en"]}

# competence vocabulary for the coverage operator
LANG_COMPETENCES = {
    "en": {"articles": [" the ", " a ", " an "], "linkers": [" and ", " or ", " but ", " with "]},
    "fr": {"articles": [" le ", " la ", " les ", " une "], "linkers": [" et ", " ou ", " avec "]},
    "de": {"articles": [" der ", " die ", " das "], "linkers": [" und ", " oder ", " mit "]},
    "es": {"articles": [" el ", " la ", " los ", " las "], "linkers": [" y ", " o ", " con "]},
}

# intent keywords for chat turns (first group wins)
TEST_INTENTS = [("competences", ["und", "der"]), ("entretien", ["the", "and"])]
# keywords with spaces: some lie within a turn, some only across the end of one
TEST_SPACED_INTENTS = [("competences", [". the ", "? und "]), ("entretien", [". de ", "en la"]), ("across", [". a"])]


# natural key per table: used to spread a table whose scan yields too few splits
TABLE_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "embeddings": "vec_id",
              "events": "user_id", "labels": "doc_id", "benchmark": "item_id", "orders": "o_orderkey",
              "lineitem": "l_orderkey", "part": "p_partkey", "customer": "c_custkey", "supplier": "s_suppkey"}


# tables whose rows carry long texts or vectors: per-row work dominates, so an
# under-split scan is spread over the cores; the small numeric tables are read as they are
SPREAD_TABLES = {"documents", "pages", "conversations", "embeddings", "benchmark", "events"}


def table(spark: SparkSession, sf_dir: str, name: str, where=None) -> DataFrame:
    """A driver table; ``where`` (a Column) is applied at the scan, so it is pushed into
    the Parquet reader before any spreading."""
    from talentgrid.session import spread
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if where is not None:
        df = df.filter(where)
    return spread(df, TABLE_KEYS.get(name)) if name in SPREAD_TABLES else df


def cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CVs = documents: (cv_id, text, lang)."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("cv_id"), "text", "lang")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers = pages: (offer_id, title, description, url)."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.col("page_id").alias("offer_id"),
        F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"),
        html_to_text("html").alias("description"),
        "url")


TEST_TITLES = ["Nicht", "Token", "License", "Para", "Avec"]
TEST_DEFAULT_TITLES = ["Untitled", "Generic", "Other"]


def cv_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cv_id, domain, main_score, skills): fallback analysis of every document."""
    from talentgrid.operators.classify import analyze_documents
    docs = cvs(spark, sf_dir)
    from talentgrid.session import materialize
    a = analyze_documents(docs, LANG_VOCAB, TEST_SKILLS, id_col="cv_id")
    # narrow and consumed by several branches of the matchers: computed once
    return materialize(a.select("cv_id", F.col("main_domain").alias("domain"), "main_score", "skills"))


def open_cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CVs as a caller may bring them: a quarter without a domain, a quarter of a domain that no
    offer has, all with a skill of their own words behind the vocabulary's."""
    from talentgrid.operators.skills import matched_terms
    from talentgrid.session import materialize
    d = table(spark, sf_dir, "documents")
    low = F.lower(F.col("text"))
    own = F.regexp_extract(low, "[a-z]{6,}", 0)
    skills = F.concat(F.slice(matched_terms(low, TEST_SKILLS), 1, 10), F.when(own != "", F.array(own)).otherwise(F.array().cast("array<string>")))
    m = F.pmod("doc_id", F.lit(4))
    domain = F.when(m == 0, F.lit(None).cast("string")).when(m == 1, F.lit("elsewhere")).otherwise(F.col("lang"))
    return materialize(d.select(F.col("doc_id").alias("cv_id"), domain.alias("domain"), skills.alias("skills")))


def cv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a folder of CV files: (path, content); among the text files a PDF, an empty
    one and one that is no CV."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = F.pmod("doc_id", F.lit(97))
    ending = F.when(m == 0, F.lit(".pdf")).when(m == 1, F.lit(".png")).otherwise(F.lit(".txt"))
    return d.select(F.concat(F.lit("/cvs/"), F.col("doc_id").cast("string"), ending).alias("path"),
                    F.when(m == 2, F.lit(" ")).otherwise(F.col("text")).cast("binary").alias("content"))


def analyser():
    """The fallback analysis of CV texts (cv_id, text) with the test vocabularies."""
    from talentgrid.operators.classify import analyze_documents

    def run(cvs: DataFrame) -> DataFrame:
        return analyze_documents(cvs, LANG_VOCAB, TEST_SKILLS, id_col="cv_id").select("cv_id", F.col("main_domain").alias("domain"), "skills")
    return run


def landed_sessions(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """Events as feedback sessions arriving in 16 files: every event gives its user's session
    anew, with one rating; writes the files to ``folder``."""
    e = feedback_events(spark, sf_dir)
    rating = F.struct("system_score", "user_rating")
    s = e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("version"), F.col("cv_domain").alias("domain"),
                 (F.col("event_id") % 6).alias("overall_rating"), F.array(rating).alias("ratings"))
    s.repartition(16, F.pmod("version", F.lit(16))).write.parquet(folder)
    return folder


def offer_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(offer_id, domain, raw_score, text, title_lower, ord): offers with their text
    lower-cased once and their domain from the same fallback classifier."""
    from talentgrid.operators.classify import domain_scores_fallback
    o = offers(spark, sf_dir).select(
        "offer_id", F.lower(F.col("title")).alias("title_lower"),
        F.lower(F.concat_ws(" ", "title", "description")).alias("text"))
    a = domain_scores_fallback(o, LANG_VOCAB, id_col="offer_id", text_col="text",
                               carry=["title_lower", "text"], lowered=True)
    from talentgrid.session import materialize
    return materialize(a.select("offer_id", F.col("main_domain").alias("domain"),
                                F.col("main_score").alias("raw_score"), "text", "title_lower",
                                F.col("offer_id").alias("ord")))


# basic analyser vocabulary (no surrounding spaces, so skills can contain keywords)
BASIC_VOCAB = {
    "en": ["the", "and", "that"],
    "fr": ["pour", "dans", "avec"],
    "de": ["nicht", "sich", "und"],
    "es": ["para", "por", "los"],
}
# extended analyser: duplicated keyword on purpose (counts twice), skill → domain map
EXT_VOCAB = {
    "en": [" the ", " and ", " of ", " that ", " with ", " the ", "that"],
    "fr": [" la ", " des ", " que ", " une ", " pour ", "pour"],
    "de": [" die ", " der ", " und ", " nicht ", " sich ", "nicht"],
    "es": [" los ", " del ", " las ", " por ", " para ", "para"],
}
EXT_SKILL_DOMAIN = {"The": "en", "And": "en", "Pour": "fr", "Avec": "fr", "Nicht": "de", "Para": "es",
                    "Por": "es"}


# embeddings: domain = "L<label>", related labels are the neighbours label±1 (directed both ways)
EMB_RELATED = {f"L{i}": [f"L{j}" for j in (i - 1, i + 1) if 0 <= j <= 9] for i in range(10)}


def embedding_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(iid, vec, domain, ord) from the embeddings table."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("iid"), F.col("embedding").alias("vec"),
                    F.concat(F.lit("L"), F.col("label").cast("string")).alias("domain"),
                    F.col("vec_id").alias("ord"))


def embedding_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_items(spark, sf_dir).select(F.col("iid").alias("qid"), "vec", "domain")


def offer_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offer cards from pages: title, company (url host), location (url language), description."""
    o = offers(spark, sf_dir)
    return o.select("offer_id", "title",
                    F.regexp_extract("url", r"://([^/]+)", 1).alias("company"),
                    F.regexp_extract("url", r"/(en|fr|de|es)/", 1).alias("location"),
                    "description")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training examples from documents: instruction per language, input = text."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("ord"),
                    F.concat(F.lit("Analyse ce texte ("), F.col("lang"), F.lit(").")).alias("instruction"),
                    F.col("text").alias("input"), F.lit("-").alias("output"), F.col("lang").alias("domain"))


def whole_word_skills(text_lower, skills: list[str]):
    """Annotator stand-in: vocabulary skills present as whole ASCII words (stricter than
    the substring extractor, so precision < 1)."""
    # literal patterns (compiled once per task), kept in vocabulary order; look-arounds
    # express "not preceded / followed by a-z" without alternation backtracking
    return F.array_compact(F.array(*[F.when(text_lower.contains(s.lower())
                                            & text_lower.rlike(f"(?<![a-z]){s.lower()}(?![a-z])"), F.lit(s))
                                     for s in skills]))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cv_id, true_domain = lang, true_skills) for every document."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("cv_id"), F.col("lang").alias("true_domain"),
                    whole_word_skills(F.lower(F.col("text")), TEST_SKILLS).alias("true_skills"))


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feedback: a session is (user_id, event_type) with domain = event_type;
    every event is a job rating (system score = value/100 capped at 1, user rating =
    props.k mod 7 — 0 and 6 are invalid), overall rating = user_id mod 6 (0 = not given)."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "ts", F.col("event_type").alias("cv_domain"),
                    F.least(F.lit(1.0), F.col("value") / F.lit(100.0)).alias("system_score"),
                    (F.get_json_object("props", "$.k").cast("long") % 7).alias("user_rating"),
                    (F.col("user_id") % 6).alias("overall_rating"),
                    F.when(F.col("event_type") != "error", F.concat(F.lit("offer_"), F.col("event_id").cast("string")))
                    .alias("job_id"))


TEST_CATEGORY_MAP = {"en": "anglais", "fr": "francais", "de": "allemand"}
TEST_TRAIN_DOMAINS = ["anglais", "francais", "allemand", "autre"]
QUOTA = 200


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw training sources: long texts come from a "resume" file, short
    ones from a "jobs" file; category = language; skills = the test skills in the text."""
    from talentgrid.operators.skills import matched_terms
    d = table(spark, sf_dir, "documents")
    sk = matched_terms(F.lower(F.col("text")), TEST_SKILLS)
    return d.select(F.col("doc_id").alias("ord"), "text", F.col("lang").alias("category"),
                    F.concat(F.when(F.col("n_chars") > 2000, F.lit("resume_")).otherwise(F.lit("jobs_")),
                             F.col("source"), F.lit(".csv")).alias("source"),
                    F.when(F.size(sk) > 0, F.array_join(sk, ", ")).alias("skills"))

TEST_INTENTS_SPACEFREE = [("competences", ["und", "der"]), ("entretien", ["the", "and"])]

# key-term stop words for the test corpus: the fixed French list plus frequent function words
KEY_STOP = ["le", "la", "les", "un", "une", "des", "et", "ou", "de", "du", "ce", "cette", "ces",
            "the", "and", "that", "with", "for", "der", "die", "und", "das", "los", "las", "del", "que", "por",
            "para", "pour", "dans"]


def training_files(spark: SparkSession, sf_dir: str) -> list[str]:
    """Training files of three layouts: documents as two CSV folders, pages as a folder of JSON
    arrays (500 pages a file)."""
    import uuid
    from talentgrid.session import scratch_path
    base = scratch_path(spark, f"training-files-{uuid.uuid4().hex[:8]}")
    d = table(spark, sf_dir, "documents").filter("text is not null and text <> ''")
    d = d.withColumn("text", F.regexp_replace("text", r"\r\n?", "\n"))
    csv = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    d.filter("lang = 'en'").select("doc_id", F.col("text").alias("Resume_str"), F.col("lang").alias("Category")) \
        .write.options(**csv).csv(f"{base}/resumes.csv")
    d.filter("lang is distinct from 'en'").select(F.col("source").alias("Key Skills"), F.col("lang").alias("Job_Title"), "doc_id",
                                                  F.col("text").alias("Full Text")).write.options(**csv).csv(f"{base}/offers.csv")
    p = table(spark, sf_dir, "pages").select(
        F.floor(F.col("page_id") / 500).alias("part"),
        F.struct(F.col("html").alias("description"), F.col("url").alias("role"), F.array(F.lit("a"), F.col("page_id").cast("string")).alias("skills")).alias("o"))
    p.groupBy("part").agg(F.to_json(F.collect_list("o")).alias("value")).repartition("part") \
        .write.partitionBy("part").text(f"{base}/pages.json")
    return [f"{base}/resumes.csv", f"{base}/offers.csv", f"{base}/pages.json"]


STORED_BUCKETS = 64
