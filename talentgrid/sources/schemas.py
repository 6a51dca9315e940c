"""Explicit schemas: JSON is never inferred on the hot path."""

from pyspark.sql import types as T

S = T.StringType()
D = T.DoubleType()
L = T.LongType()

OFFER_METADATA = T.StructType([T.StructField(n, S) for n in
                               ["title", "company", "location", "domain", "country", "salary", "source", "url"]]
                              + [T.StructField("score", D), T.StructField("date_posted", S),
                                 T.StructField("scraped_date", S)])

OFFER = T.StructType(
    [T.StructField(n, S) for n in ["id", "title", "company", "location", "country", "description", "url",
                                   "date_posted", "salary"]]
    + [T.StructField("match_score", D), T.StructField("rank", L)]
    + [T.StructField(n, S) for n in ["domain", "domain_match"]]
    + [T.StructField(n, D) for n in ["score", "raw_score", "domain_bonus", "skills_bonus"]]
    + [T.StructField("matched_skills", L)]
    + [T.StructField(n, S) for n in ["source", "scraped_date", "date_collected", "content"]]
    + [T.StructField("metadata", OFFER_METADATA)])

OFFER_FILE = T.StructType(
    [T.StructField("date", S), T.StructField("success_count", L), T.StructField("failed_count", L),
     T.StructField("total_count", L), T.StructField("jobs", T.ArrayType(OFFER))]
    + [f for f in OFFER.fields]
    + [T.StructField("_corrupt_record", S)])

ANNOTATION = T.StructType([
    T.StructField("cv_file", S), T.StructField("main_domain", S), T.StructField("skills", T.ArrayType(S)),
    T.StructField("expected_job_titles", T.ArrayType(S)), T.StructField("notes", S)])

JOB_RATING = T.StructType([
    T.StructField("job_id", S), T.StructField("title", S), T.StructField("system_score", D),
    T.StructField("user_rating", L), T.StructField("comment", S)])

SESSION = T.StructType([
    T.StructField("session_id", S), T.StructField("timestamp", S), T.StructField("cv_domain", S),
    T.StructField("feedback", T.StructType([
        T.StructField("job_ratings", T.ArrayType(JOB_RATING)), T.StructField("overall_rating", L),
        T.StructField("comments", S), T.StructField("domain", S), T.StructField("skills", T.ArrayType(S)),
        T.StructField("feedback_date", S)]))])

FEEDBACK_FILE = T.StructType([T.StructField("sessions", T.ArrayType(SESSION))])
