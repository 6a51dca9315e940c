"""User feedback on matching results: rating validation, upserts and agreement stats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.functions.ids import session_id  # noqa: F401  (re-exported for callers)


def explode_ratings(sessions: DataFrame, ratings_col: str = "feedback.job_ratings") -> DataFrame:
    """Nested sessions → one row per job rating with its 0-based position ``pos``."""
    return sessions.select("*", F.posexplode(F.col(ratings_col)).alias("pos", "r")).select(
        *[c for c in sessions.columns], "pos", "r.*")


def valid_ratings(ratings: DataFrame, pos_col: str = "pos", rating_col: str = "user_rating",
                  job_col: str = "job_id") -> DataFrame:
    """Keep integer ratings 1..5; a missing job id becomes ``job_<pos>``."""
    r = F.col(rating_col)
    return (ratings.filter(r.isNotNull() & (r.cast("long") == r) & r.between(1, 5))
            .withColumn(job_col, F.coalesce(F.nullif(F.col(job_col), F.lit("")),
                                            F.concat(F.lit("job_"), F.col(pos_col).cast("string")))))


def normalized_system_score(s: Column) -> Column:
    """System score 0..1 mapped to the 1..5 rating scale."""
    return F.lit(1.0) + s * F.lit(4.0)


def feedback_stats(sessions: DataFrame, ratings: DataFrame, domain_col: str = "cv_domain") -> DataFrame:
    """Per domain and overall (grouping sets): sessions, mean overall rating (ratings > 0
    only), agreement % = max(0, 1 − mean|1 + 4·system − user| / 4)·100 over ratings > 0.

    sessions: (domain, overall_rating); ratings: (domain, system_score, user_rating).
    Both grains are rolled up separately (map-side partial aggregation) and the two
    tiny results joined on the grouping key.
    """
    s = (sessions.rollup(domain_col)
         .agg(F.count(F.lit(1)).alias("sessions"),
              F.avg(F.when(F.col("overall_rating") > 0, F.col("overall_rating"))).alias("avg_overall"),
              F.grouping_id().alias("_g")))
    diff = F.abs(normalized_system_score(F.col("system_score")) - F.col("user_rating"))
    r = (ratings.filter(F.col("user_rating") > 0).rollup(domain_col)
         .agg(F.avg(diff).alias("_d"), F.count(F.lit(1)).alias("n_ratings"), F.grouping_id().alias("_g")))
    j = s.join(r, [s[domain_col].eqNullSafe(r[domain_col]), s["_g"] == r["_g"]], "left")
    agree = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("_d") / F.lit(4.0)) * F.lit(100.0)
    return j.select(F.when(s["_g"] == 1, F.lit("__all__")).otherwise(s[domain_col]).alias("domain"),
                    "sessions", "avg_overall", F.coalesce("n_ratings", F.lit(0)).alias("n_ratings"),
                    agree.alias("agreement_pct"))


def upsert_latest(existing: DataFrame, updates: DataFrame, key: str, version_col: str) -> DataFrame:
    """Insert-or-replace by ``key``: the row with the highest version wins (updates win
    ties). An aggregation, so a hot key is reduced map-side."""
    u = existing.withColumn("_src", F.lit(0)).unionByName(updates.withColumn("_src", F.lit(1)),
                                                          allowMissingColumns=True)
    cols = [c for c in u.columns if c != "_src"]
    return (u.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(version_col, "_src")).alias("_r"))
            .select("_r.*"))
