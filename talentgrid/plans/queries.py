"""Registered queries: each binds operators to the driver's tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column names
equal those of the SQL twin in ``talentgrid.plans.oracle``. Floating results are
rounded to 6 decimals (never at a tie) so engines agree bit-for-bit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.operators import classify as C
from talentgrid.plans import bindings as B
from talentgrid.operators import skills as S
from talentgrid.operators import match as M
from talentgrid.operators import vectors as VX
from talentgrid.functions import vectors as FV
from talentgrid.functions import ids as IDS
from talentgrid.operators import dedup as DD
from talentgrid.operators import evaluate as EV
from talentgrid.operators import feedback as FB
from talentgrid.operators import training as TR
from talentgrid.operators import intent as IN
from talentgrid.operators import html_cards as HC
from talentgrid.functions import text as T
from talentgrid.operators import offers as OF
from talentgrid.operators import terms as TM
from talentgrid.streaming import streams as ST
from talentgrid.operators import ml as ML

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ------------------------------------------------------------------ classification
@register("domain_scores_fallback")
def q_domain_scores_fallback(spark, sf):
    docs = B.table(spark, sf, "documents")
    out = C.domain_scores_fallback_long(docs, B.LANG_VOCAB)
    return out.select("doc_id", "domain", r6("score").alias("score"))


@register("main_domain")
def q_main_domain(spark, sf):
    docs = B.table(spark, sf, "documents")
    out = C.domain_scores_fallback(docs, B.LANG_VOCAB)
    return out.select("doc_id", "main_domain", r6("main_score").alias("main_score"))


# ------------------------------------------------------------------ skills / titles


@register("extract_skills")
def q_extract_skills(spark, sf):
    docs = B.table(spark, sf, "documents")
    out = S.extract_skills(docs, B.TEST_SKILLS, "text", limit=10)
    return out.select("doc_id", F.array_join("skills", ",").alias("skills"),
                      F.size("skills").cast("long").alias("n_skills"))


@register("extract_titles")
def q_extract_titles(spark, sf):
    docs = B.table(spark, sf, "documents")
    out = S.extract_titles(docs, B.TEST_TITLES, "text", B.TEST_DEFAULT_TITLES)
    return out.select("doc_id", F.array_join("job_titles", ",").alias("job_titles"), "best_title")


@register("skill_frequency")
def q_skill_frequency(spark, sf):
    docs = S.extract_skills(B.table(spark, sf, "documents"), B.TEST_SKILLS, "text", limit=None)
    return S.skill_frequency(docs).select("skill", F.col("n_docs").cast("long").alias("n_docs"))


# ------------------------------------------------------------------ matching
MATCH_K = 5
MATCH_MIN_SCORE = 0.3


@register("match_rules_topk")
def q_match_rules_topk(spark, sf):
    out = M.match_rules(B.cv_analysis(spark, sf), B.offer_analysis(spark, sf), k=MATCH_K, min_score=MATCH_MIN_SCORE)
    return out.select("cv_id", F.col("rank").cast("long").alias("rank"), "offer_id",
                      r6("score").alias("score"), F.col("matched_skills").cast("long").alias("matched_skills"),
                      "domain_match")


@register("match_bonus_topk")
def q_match_bonus_topk(spark, sf):
    out = M.match_bonus(B.cv_analysis(spark, sf), B.offer_analysis(spark, sf), k=MATCH_K)
    return out.select("cv_id", F.col("rank").cast("long").alias("rank"), "offer_id",
                      r6("raw_score").alias("raw_score"), r6("skills_bonus").alias("skills_bonus"),
                      F.col("matched_skills").cast("long").alias("matched_skills"), r6("score").alias("score"))


@register("match_weighted_topk")
def q_match_weighted_topk(spark, sf):
    out = M.match_weighted(B.cv_analysis(spark, sf), B.offer_analysis(spark, sf), B.LANG_WEIGHTS, k=MATCH_K)
    return out.select("cv_id", F.col("rank").cast("long").alias("rank"), "offer_id", r6("score").alias("score"),
                      F.col("matched_skills").cast("long").alias("matched_skills"), "domain_units")


# CVs of null and unlisted domains, with a skill outside every vocabulary
@register("match_rules_open")
def q_match_rules_open(spark, sf):
    out = M.match_rules(B.open_cvs(spark, sf), B.offer_analysis(spark, sf), k=MATCH_K)
    return out.select("cv_id", F.col("rank").cast("long").alias("rank"), "offer_id", r6("score").alias("score"),
                      "matched_skills", "domain_match")


@register("match_bonus_open")
def q_match_bonus_open(spark, sf):
    out = M.match_bonus(B.open_cvs(spark, sf), B.offer_analysis(spark, sf), k=MATCH_K)
    return out.select("cv_id", F.col("rank").cast("long").alias("rank"), "offer_id",
                      r6("raw_score").alias("raw_score"), r6("skills_bonus").alias("skills_bonus"),
                      "matched_skills", r6("score").alias("score"))


@register("match_weighted_open")
def q_match_weighted_open(spark, sf):
    out = M.match_weighted(B.open_cvs(spark, sf), B.offer_analysis(spark, sf), B.LANG_WEIGHTS, k=MATCH_K)
    return out.select("cv_id", F.col("rank").cast("long").alias("rank"), "offer_id", r6("score").alias("score"),
                      "matched_skills", "domain_units", F.array_join("skill_matches", ",").alias("skill_matches"),
                      F.array_join("domain_matches", ",").alias("domain_matches"))


@register("batch_match")
def q_batch_match(spark, sf):
    out = M.batch_match(B.cv_files(spark, sf), B.offer_analysis(spark, sf), B.analyser(), k=MATCH_K, min_score=MATCH_MIN_SCORE)
    line = lambda r: F.concat_ws(":", r["rank"], r["offer_id"], F.format_number(r["score"], 4))
    return out.select("cv_id", "main_domain", F.array_join("skills", ",").alias("skills"),
                      F.array_join(F.transform("results", line), ",").alias("results"), "error")


# ------------------------------------------------------------------ more classifiers
@register("domain_scores_basic")
def q_domain_scores_basic(spark, sf):
    docs = B.table(spark, sf, "documents")
    out = C.domain_scores_basic(docs, B.BASIC_VOCAB, B.TEST_SKILLS)
    return out.select("doc_id", "domain", r6("score").alias("score"))


@register("domain_scores_extended")
def q_domain_scores_extended(spark, sf):
    docs = B.table(spark, sf, "documents")
    out = C.domain_scores_extended(docs, B.EXT_VOCAB, B.TEST_SKILLS, B.EXT_SKILL_DOMAIN)
    return out.select("doc_id", "domain", r6("score").alias("score"))


@register("guess_domain")
def q_guess_domain(spark, sf):
    o = B.offers(spark, sf)
    return C.guess_domain(o, B.LANG_VOCAB, id_col="offer_id", title_col="title", text_col="description")


@register("classify_confidence")
def q_classify_confidence(spark, sf):
    docs = B.table(spark, sf, "documents")
    out = C.classify_confidence(docs, B.BASIC_VOCAB, default_domain="en")
    return out.select("doc_id", "classification", r6("confidence").alias("confidence"))


@register("competence_coverage")
def q_competence_coverage(spark, sf):
    docs = B.table(spark, sf, "documents")
    out = C.competence_coverage(docs, B.LANG_COMPETENCES)
    return out.select("doc_id", "domain", "competence", "n_found", "n_total", r6("level").alias("level"))


# ------------------------------------------------------------------ embeddings


@register("match_embedding_topk")
def q_match_embedding_topk(spark, sf):
    out = VX.embedding_match(B.embedding_queries(spark, sf), B.embedding_items(spark, sf), k=3,
                             related=B.EMB_RELATED, exclude_self=True)
    return out.select(F.col("qid").alias("cv_id"), F.col("rank").cast("long").alias("rank"),
                      F.col("iid").alias("offer_id"), r6("cos").alias("cosine"), r6("dsim").alias("domain_sim"),
                      r6("score").alias("score"))


@register("vector_search_domain")
def q_vector_search_domain(spark, sf):
    out = VX.vector_search(B.embedding_queries(spark, sf), B.embedding_items(spark, sf), limit=5,
                           exclude_self=True)
    return out.select(F.col("qid").alias("query_id"), F.col("rank").cast("long").alias("rank"),
                      F.col("iid").alias("item_id"), r6("cos").alias("cosine"))


def _label_centroids(spark, sf):
    e = B.table(spark, sf, "embeddings")
    return VX.centroids(e, "label")


@register("similarity_matrix")
def q_similarity_matrix(spark, sf):
    c = _label_centroids(spark, sf)
    items = c.select(F.col("label").cast("long").alias("iid"), F.col("centroid").alias("vec"),
                     F.lit("c").alias("domain"), F.col("label").cast("long").alias("ord"))
    out = VX.similarity_matrix(items)
    return out.select(F.col("qid").alias("label_a"), F.col("iid").alias("label_b"), r6("cos").alias("cosine"))


@register("composite_embedding")
def q_composite_embedding(spark, sf):
    e = B.table(spark, sf, "embeddings")
    dv = _label_centroids(spark, sf).select("label", F.col("centroid").alias("dvec"))
    out = VX.composite_embedding(e, dv, "label")
    return out.select("vec_id", r6(F.element_at("composite", 1)).alias("c0"),
                      r6(F.aggregate("composite", F.lit(0.0), lambda a, x: a + x)).alias("csum"),
                      r6(FV.norm("composite")).alias("cnorm"))


# ------------------------------------------------------------------ ids / dedup / merge


@register("offer_ids")
def q_offer_ids(spark, sf):
    c = B.offer_cards(spark, sf)
    return c.select("offer_id", IDS.offer_id("title", "company", "location", "description").alias("offer_key"))


@register("dedup_examples")
def q_dedup_examples(spark, sf):
    out = DD.dedup_examples(B.examples(spark, sf))
    return out.select(F.col("ord").alias("doc_id"), F.length("input").cast("long").alias("input_len"))


@register("dedup_offers")
def q_dedup_offers(spark, sf):
    d = B.table(spark, sf, "documents")
    x = d.select(F.col("doc_id").alias("ord"), F.md5(F.lower("text")).alias("id"),
                 F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("company"))
    out = DD.greedy_dedup(x, "id", ["title", "company"], "ord")
    return out.select(F.col("ord").alias("doc_id"), "kept")


@register("hybrid_merge")
def q_hybrid_merge(spark, sf):
    vec = QUERIES["match_bonus_topk"](spark, sf)
    scr = QUERIES["match_rules_topk"](spark, sf)
    out = DD.hybrid_merge(vec, scr, MATCH_K)
    return out.select("cv_id", F.col("rank").cast("long").alias("rank"), "offer_id", "score", "source")


# ------------------------------------------------------------------ evaluation


def _pred_truth(spark, sf):
    a = B.cv_analysis(spark, sf).select("cv_id", F.col("domain").alias("pred_domain"),
                                        F.col("skills").alias("pred_skills"))
    return a.join(B.truth(spark, sf), "cv_id")


@register("accuracy")
def q_accuracy(spark, sf):
    out = EV.domain_accuracy(_pred_truth(spark, sf))
    return out.select(r6("accuracy").alias("accuracy"), F.col("samples").cast("long").alias("samples"))


@register("confusion")
def q_confusion(spark, sf):
    return EV.confusion_matrix(_pred_truth(spark, sf), B.LANGS)


@register("skills_prf")
def q_skills_prf(spark, sf):
    out = EV.skills_prf(_pred_truth(spark, sf))
    return out.select(r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"),
                      r6("f1_of_means").alias("f1_of_means"), F.col("samples").cast("long").alias("samples"))


@register("weighted_prf")
def q_weighted_prf(spark, sf):
    out = EV.weighted_prf(_pred_truth(spark, sf))
    return out.select(*[r6(c).alias(c) for c in ["accuracy", "precision", "recall", "f1"]], "samples")


@register("matching_quality")
def q_matching_quality(spark, sf):
    res = QUERIES["match_rules_topk"](spark, sf).select("cv_id", "offer_id")
    off = B.offer_analysis(spark, sf).select("offer_id", F.col("domain").alias("offer_domain"),
                                             F.col("text").alias("offer_text"))
    out = EV.matching_quality(res.join(off, "offer_id"), B.truth(spark, sf))
    return out.select(r6("domain_match_rate").alias("domain_match_rate"),
                      r6("skills_match_rate").alias("skills_match_rate"), F.col("samples").cast("long").alias("samples"))


@register("retrieval_prf")
def q_retrieval_prf(spark, sf):
    matched = QUERIES["match_rules_topk"](spark, sf)
    relevant = QUERIES["match_weighted_topk"](spark, sf)
    out = EV.retrieval_prf(matched, relevant)
    return out.select("cv_id", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


@register("expected_vs_detected")
def q_expected_vs_detected(spark, sf):
    pt = _pred_truth(spark, sf)
    rec = EV.skills_prf(pt)
    return EV.expected_vs_detected(B.truth(spark, sf), rec)


# ------------------------------------------------------------------ feedback


@register("valid_ratings")
def q_valid_ratings(spark, sf):
    ev = B.feedback_events(spark, sf)
    out = FB.valid_ratings(ev, pos_col="event_id")
    return out.select("event_id", "job_id", F.col("user_rating").cast("long").alias("user_rating"))


@register("feedback_stats")
def q_feedback_stats(spark, sf):
    ev = FB.valid_ratings(B.feedback_events(spark, sf), pos_col="event_id")
    sessions = B.feedback_events(spark, sf).groupBy("user_id", "cv_domain").agg(F.first("overall_rating").alias("overall_rating"))
    out = FB.feedback_stats(sessions, ev)
    return out.select("domain", F.col("sessions").cast("long").alias("sessions"), r6("avg_overall").alias("avg_overall"),
                      F.col("n_ratings").cast("long").alias("n_ratings"), r6("agreement_pct").alias("agreement_pct"))


@register("feedback_sessions")
def q_feedback_sessions(spark, sf):
    ev = B.feedback_events(spark, sf)
    s = ev.groupBy("user_id", "cv_domain").agg(F.min("ts").alias("ts"), F.count(F.lit(1)).alias("n_ratings"))
    return s.select("user_id", "cv_domain",
                    IDS.session_id("cv_domain", F.array().cast("array<string>"), F.col("ts").cast("string")).alias("session_id"),
                    F.col("n_ratings").cast("long").alias("n_ratings"))


@register("feedback_upsert")
def q_feedback_upsert(spark, sf):
    ev = B.table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    existing = ev.filter(F.col("event_type") != "purchase")
    updates = ev.filter(F.col("event_type") == "purchase")
    out = FB.upsert_latest(existing, updates, "user_id", "ts")
    return out.select("user_id", "event_id", "event_type")


@register("stored_upserts")
def q_stored_upserts(spark, sf):
    """The users' last events in a stored table: all but those of the last half hour first, these as a
    batch of their own; ``rewritten`` says whether the batch wrote the user's bucket."""
    from talentgrid.session import scratch_path
    from talentgrid.sources import stored as SD
    path = scratch_path(spark, f"stored-users-{uuid.uuid4().hex[:8]}")
    ev = B.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("user_id"), "event_id", "event_type", "ts")
    late = F.lit(ev.agg(F.max("ts")).first()[0]) - F.expr("interval 30 minutes")
    SD.upsert_stored(ev.filter(F.col("ts") < late), path, "user_id", "event_id", B.STORED_BUCKETS)
    touched = SD.upsert_stored(ev.filter(F.col("ts") >= late), path, "user_id", "event_id", B.STORED_BUCKETS)
    return SD.read_stored(spark, path).select(
        "user_id", "event_id", "event_type", SD.bucket_of("user_id", B.STORED_BUCKETS).isin(touched).alias("rewritten"))


# ------------------------------------------------------------------ training data


def _examples(spark, sf):
    rows = B.training_rows(spark, sf)
    return TR.required_fields(TR.build_examples(rows, mapping=B.TEST_CATEGORY_MAP, default_domain="autre"))


@register("training_examples")
def q_training_examples(spark, sf):
    ex = _examples(spark, sf)
    return ex.select(F.col("ord").alias("doc_id"), "instruction", "output", "domain",
                     TR.label_index(F.col("domain"), B.TEST_TRAIN_DOMAINS).cast("long").alias("label"))


@register("expand_examples")
def q_expand_examples(spark, sf):
    out = TR.expand_to_quota(_examples(spark, sf), B.QUOTA, B.TEST_TRAIN_DOMAINS)
    return out.select(F.col("ord").alias("doc_id"), F.col("variant").cast("long").alias("variant"), "domain",
                      "instruction")


@register("expand_examples_prefixed")
def q_expand_examples_prefixed(spark, sf):
    out = TR.expand_to_quota(_examples(spark, sf), B.QUOTA, None, prefix_variant=True)
    return out.select(F.col("ord").alias("doc_id"), F.col("variant").cast("long").alias("variant"), "domain",
                      "instruction")


@register("render_prompts")
def q_render_prompts(spark, sf):
    out = TR.render_prompt(_examples(spark, sf))
    return out.select(F.col("ord").alias("doc_id"), F.md5("formatted_text").alias("prompt_md5"),
                      F.length("formatted_text").cast("long").alias("prompt_len"))


@register("stratified_split")
def q_stratified_split(spark, sf):
    ex = _examples(spark, sf)
    out = TR.stratified_split(ex, "domain", "ord", ratio=0.2, seed=42)
    return out.select(F.col("ord").alias("doc_id"), "domain", "split")


@register("training_sources")
def q_training_sources(spark, sf):
    from talentgrid.sources.readers import read_training_sources
    x = read_training_sources(spark, B.training_files(spark, sf))
    return x.select(F.regexp_extract("source", r"/(resumes|offers|pages)\.", 1).alias("kind"),
                    F.md5("text").alias("text_md5"), "category", "skills")


# ------------------------------------------------------------------ intents / html / scalar text


@register("message_intent")
def q_message_intent(spark, sf):
    conv = B.table(spark, sf, "conversations")
    return IN.message_intent(conv, B.TEST_INTENTS)


@register("message_intent_spaced")
def q_message_intent_spaced(spark, sf):
    return IN.message_intent(B.table(spark, sf, "conversations"), B.TEST_SPACED_INTENTS)


@register("html_to_text")
def q_html_to_text(spark, sf):
    p = B.table(spark, sf, "pages")
    t = T.html_to_text("html")
    return p.select("page_id", F.length(t).cast("long").alias("text_len"), F.md5(t).alias("text_md5"))


@register("html_page_text")
def q_html_page_text(spark, sf):
    p = B.table(spark, sf, "pages")
    return p.select("page_id", F.md5(HC.html_text("html")).alias("text_md5"), HC.html_text("html", "title").alias("title"),
                    HC.html_text("html", "nav > ul li a[href], #none").alias("menu"))


@register("html_cards")
def q_html_cards(spark, sf):
    cards = HC.html_cards(B.table(spark, sf, "pages"))
    return HC.card_offers(cards, "fr", "https://example.org").select(
        "page_id", "card_pos", "title", "location", "salary", "id")


@register("salary")
def q_salary(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", T.extract_salary("text").alias("salary"))


@register("location")
def q_location(spark, sf):
    c = B.table(spark, sf, "customer")
    n = B.table(spark, sf, "nation")
    x = c.join(n, c.c_nationkey == n.n_nationkey)   # nation: 25 rows, AQE broadcasts it
    loc = F.concat(F.lit("  "), F.col("n_name"), F.lit(" \u2013 "), F.col("c_name"), F.lit("\u00a0Paris\u00a0"))
    return x.select("c_custkey",
                    T.normalize_location(loc, "fr").alias("loc_fr"),
                    T.normalize_location(loc, "ma").alias("loc_ma"),
                    T.normalize_location(loc, "us").alias("loc_other"))


@register("search_query")
def q_search_query(spark, sf):
    a = B.cv_analysis(spark, sf)
    qry = T.search_query("domain", "skills", {"en": "engineer OR developer", "fr": "ingénieur OR développeur",
                                               "de": "Ingenieur OR Entwickler"}, "developer OR engineer")
    return a.select("cv_id", qry.alias("query"))


@register("search_url")
def q_search_url(spark, sf):
    a = B.cv_analysis(spark, sf)
    qry = T.search_query("domain", "skills", {"en": "engineer OR developer", "fr": "ingénieur OR développeur",
                                               "de": "Ingenieur OR Entwickler"}, "developer OR engineer")
    return a.select("cv_id", T.search_url("https://jobs.example.org/search", qry, F.lit("Paris / Lyon"),
                                          F.lit("fr")).alias("url"))


@register("truncate")
def q_truncate(spark, sf):
    d = B.table(spark, sf, "documents")
    t200 = T.truncate("text", 200)
    t2000 = T.truncate("text", 2000, 1997)
    return d.select("doc_id", F.md5(t200).alias("t200_md5"), F.length(t2000).cast("long").alias("t2000_len"))


# ------------------------------------------------------------------ filters / limits / counters


@register("offer_filters")
def q_offer_filters(spark, sf):
    # the equality filters reach the Parquet scan (PushedFilters); the operator re-states them
    d = B.table(spark, sf, "documents", where=(F.col("lang") == "fr") & (F.col("source") == "src3"))
    x = OF.offer_filter(d, "fr", None, domain_col="lang")
    x = x.filter(F.col("source") == "src3")
    x = OF.keyword_search(x.withColumn("title", F.substring_index("text", "\n", 1)), "pour", ["title", "text"])
    return x.select("doc_id")


@register("search_backfill")
def q_search_backfill(spark, sf):
    p = B.table(spark, sf, "part")
    return OF.search_with_backfill(p, "green", ["p_name", "p_type"], 100, "p_partkey").select("p_partkey", "hit")


@register("limit_then_sort")
def q_limit_then_sort(spark, sf):
    o = B.table(spark, sf, "orders")
    x = OF.limit_then_sort(o, 500, "o_orderkey", "o_totalprice")
    from pyspark.sql import Window
    # the window runs over the 500 capped rows only
    return x.select("o_orderkey", F.row_number().over(Window.orderBy(F.col("o_totalprice").desc(), "o_orderkey"))
                    .cast("long").alias("pos"))


@register("overfetch")
def q_overfetch(spark, sf):
    o = B.table(spark, sf, "orders")
    return OF.overfetch_top_k(o, 50, 100000.0, "o_orderkey", "o_totalprice").select("o_orderkey", "o_totalprice")


@register("split_by_source")
def q_split_by_source(spark, sf):
    d = B.table(spark, sf, "documents")
    a, b = OF.split_by_source(d, "src0")
    return a.select(F.lit("src0").alias("side"), "doc_id").unionByName(b.select(F.lit("other").alias("side"), "doc_id")) \
        .groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@register("ingest_counters")
def q_ingest_counters(spark, sf):
    p = B.table(spark, sf, "pages")
    out = OF.ingest_counters(p, F.col("html").rlike("(?is)<title>.+?</title>"))
    return out.select("success_count", "failed_count", "total_count", r6("success_rate").alias("success_rate"))


@register("domain_counts")
def q_domain_counts(spark, sf):
    return OF.domain_counts(B.table(spark, sf, "documents"), "lang").select(F.col("lang").alias("domain"), "n")


@register("score_bands")
def q_score_bands(spark, sf):
    m = QUERIES["match_rules_topk"](spark, sf)
    return m.groupBy(T.score_band("score").alias("band")).agg(F.count(F.lit(1)).alias("n"))


def _doc_terms(spark, sf, n):
    d = B.table(spark, sf, "documents")
    return TM.key_terms(d, "doc_id", "text", n, B.KEY_STOP)


@register("key_terms")
def q_key_terms(spark, sf):
    kt = _doc_terms(spark, sf, 5)
    return kt.select("doc_id", "term", F.col("tf").cast("long").alias("tf"), r6("tfidf").alias("tfidf"),
                     F.col("term_rank").cast("long").alias("term_rank"))


@register("keyword_overlap")
def q_keyword_overlap(spark, sf):
    pairs = QUERIES["match_rules_topk"](spark, sf)
    cvt = _doc_terms(spark, sf, 10).withColumnRenamed("doc_id", "cv_id")
    o = B.offers(spark, sf)
    jt = TM.key_terms(o, "offer_id", "description", 10, B.KEY_STOP)
    return TM.keyword_overlap(pairs, cvt, jt)


# ------------------------------------------------------------------ streaming


def _events_stream(spark, sf):
    schema = B.table(spark, sf, "events").schema
    return ST.file_stream(spark, sf, schema, "parquet", glob="events.parquet")


@register("stream_dedup")
def q_stream_dedup(spark, sf):
    s = _events_stream(spark, sf).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = ST.run_to_parquet(ST.dedup_stream(s, ["user_id", "event_type"], "ts", "400 days"), "dedup")
    return spark.read.parquet(out).select("user_id", "event_type")


@register("stream_window_counts")
def q_stream_window_counts(spark, sf):
    s = _events_stream(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = ST.window_counts(s, "ts", ["event_type"], "6 hours", "1 hour")
    out = ST.run_updates(counts, ["window_start", "window_end", "event_type"], "wcounts")
    return out.select(F.col("window_start").cast("string").alias("window_start"), "event_type",
                                          F.col("n").cast("long").alias("n"))


@register("stream_feedback")
def q_stream_feedback(spark, sf):
    s = _events_stream(spark, sf).select("user_id", "event_id", "event_type", "ts")
    return ST.latest_stream(s, "user_id", "ts", "feedback").select("user_id", "event_id", "event_type")


@register("stream_feedback_stats")
def q_stream_feedback_stats(spark, sf):
    table = ST.scratch_path(spark, f"feedback-{uuid.uuid4().hex}")
    landed = B.landed_sessions(spark, sf, table + "/landing")
    ST.running_feedback(ST.file_stream(spark, landed, spark.read.parquet(landed).schema, max_files_per_trigger=4), table)
    out = ST.feedback_after(spark, table)
    return out.select("domain", "sessions", r6("avg_overall").alias("avg_overall"), "n_ratings", r6("agreement_pct").alias("agreement_pct"))


@register("retention")
def q_retention(spark, sf):
    e = B.table(spark, sf, "events")
    cls = ST.retention_classes(e, "ts", "2024-02-01 00:00:00")
    return e.groupBy(cls.alias("action")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ ML dataflow


@register("embed_texts")
def q_embed_texts(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "text")
    out = ML.batch_embedding_map(d, "text", dim=256)
    return out.select("doc_id", F.size("embedding").cast("long").alias("dim"),
                      r6(FV.norm("embedding")).alias("norm"))


@register("train_classifier")
def q_train_classifier(spark, sf):
    ex = _examples(spark, sf).withColumn("label", TR.label_index(F.col("domain"), B.TEST_TRAIN_DOMAINS).cast("double"))
    sp = TR.stratified_split(ex, "domain", "ord", ratio=0.2, seed=42)
    train = sp.filter(F.col("split") == "train")
    ev = sp.filter(F.col("split") == "eval")
    _, pred = ML.train_domain_classifier(train, "input", "label", ev)
    pairs = pred.select(F.col("label").cast("string").alias("true_domain"),
                        F.col("prediction").cast("string").alias("pred_domain"))
    return EV.weighted_prf(pairs)


# ------------------------------------------------------------------ per-CV summaries
@register("best_match_per_cv")
def q_best_match_per_cv(spark, sf):
    m = QUERIES["match_rules_topk"](spark, sf)
    cv = B.cv_analysis(spark, sf)
    off = B.offer_analysis(spark, sf).select("offer_id", "domain")
    out = M.best_match_per_cv(cv, m, off)
    return out.select("cv_id", "cv_domain", "offer_id", "score", "domain_match")


@register("domain_offers_topk")
def q_domain_offers_topk(spark, sf):
    out = M.domain_offers(B.cv_analysis(spark, sf), B.offer_analysis(spark, sf), k=MATCH_K)
    return out.select("cv_id", F.col("rank").cast("long").alias("rank"), "offer_id", r6("score").alias("score"))


@register("domain_map")
def q_domain_map(spark, sf):
    docs = B.table(spark, sf, "documents")
    lng = C.domain_scores_fallback_long(docs, B.LANG_VOCAB).withColumn("score", r6("score"))
    return C.domain_summary(lng).select(
        "doc_id",
        F.array_join(F.transform(F.map_entries("domain_scores"),
                                 lambda e: F.concat(e["key"], F.lit(":"), F.format_number(e["value"], 6))), ",").alias("scores"),
        F.element_at("ranked_domains", 1)["domain"].alias("top_domain"))


@register("offer_format")
def q_offer_format(spark, sf):
    cards = B.offer_cards(spark, sf)
    x = OF.offer_defaults(cards.withColumn("id", F.col("offer_id").cast("string")))
    f = OF.format_offers(x)
    return f.select(F.col("offer_id"), "domain", F.col("metadata.country").alias("country"),
                    F.col("metadata.source").alias("source"), F.md5("content").alias("content_md5"),
                    F.length("description").cast("long").alias("description_len"),
                    OF.relocate(F.col("location"), "fr", "France").alias("relocated"),
                    T.display_name("domain").alias("domain_label"))


@register("hybrid_match")
def q_hybrid_match(spark, sf):
    cv = B.cv_analysis(spark, sf)
    off = B.offer_analysis(spark, sf)
    cvv = ML.embed_texts(B.table(spark, sf, "documents").select(F.col("doc_id").alias("qid"), "text"),
                         "text", "vec", dim=256, idf=False) \
        .join(cv.select(F.col("cv_id").alias("qid"), "domain"), "qid").select("qid", "vec", "domain")
    ofv = ML.embed_texts(off.select(F.col("offer_id").alias("iid"), "text", "domain", "ord"),
                         "text", "vec", dim=256, idf=False).select("iid", "vec", "domain", "ord")
    out = M.hybrid_match(cvv, ofv, cv, off, k=MATCH_K, min_score=MATCH_MIN_SCORE)
    return out.select("cv_id", F.col("rank").cast("long").alias("rank"), "offer_id", r6("score").alias("score"),
                      "source")


@register("category_map")
def q_category_map(spark, sf):
    rows = B.training_rows(spark, sf)
    dom = TR.canonical_domain(TR.category_to_domain(F.col("category"), B.TEST_CATEGORY_MAP, "autre"),
                              {"autre": "other"})
    return rows.select(F.col("ord").alias("doc_id"), "category", dom.alias("domain"),
                       TR.label_index(dom, ["anglais", "francais", "allemand", "other"]).cast("long").alias("label"))
