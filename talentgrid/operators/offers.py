"""Offer projections, filters, searches, limits and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid import vocab as V
from talentgrid.functions.text import col_, empty_to_null, truncate


def offer_defaults(df: DataFrame) -> DataFrame:
    """Offer metadata with defaults (domain informatique_reseaux, country France, source
    indeed, score 0.0); an existing ``metadata``/``content`` wins. Adds ``content`` =
    "title - company\\n\\ndescription"."""
    def pick(name, default):
        own = F.col(f"metadata.{name}") if "metadata" in df.columns else F.lit(None)
        base = F.col(name) if name in df.columns else F.lit(None)
        return F.coalesce(own, base, F.lit(default) if default is not None else F.lit(None)).alias(name)
    meta = F.struct(pick("title", ""), pick("company", ""), pick("location", ""),
                    pick("domain", "informatique_reseaux"), pick("country", "France"),
                    pick("source", "indeed"), pick("url", ""), pick("score", 0.0).cast("double").alias("score"))
    content = F.concat(F.coalesce(F.col("title"), F.lit("")), F.lit(" - "), F.coalesce(F.col("company"), F.lit("")),
                       F.lit("\n\n"), F.coalesce(F.col("description"), F.lit("")))
    existing = F.col("content") if "content" in df.columns else F.lit(None).cast("string")
    return df.withColumn("metadata", meta).withColumn("content", F.coalesce(empty_to_null(existing), content))


def format_offers(df: DataFrame) -> DataFrame:
    """Flatten metadata with "N/A" display defaults and a 200-char description."""
    return df.select(
        F.coalesce(F.col("id"), F.lit("N/A")).alias("id"),
        F.coalesce(F.col("metadata.title"), F.lit("N/A")).alias("title"),
        F.coalesce(F.col("metadata.company"), F.lit("N/A")).alias("company"),
        F.coalesce(F.col("metadata.location"), F.lit("N/A")).alias("location"),
        F.coalesce(F.col("metadata.domain"), F.lit("unknown")).alias("domain"),
        truncate(F.coalesce(F.col("content"), F.lit("")), 200).alias("description"),
        *[c for c in df.columns if c not in ("id", "title", "company", "location", "domain", "description")])


def min_score(df: DataFrame, threshold: float, col: str = "score") -> DataFrame:
    return df.filter(F.col(col) >= F.lit(threshold))


def offer_filter(df: DataFrame, domain: str | None = None, country_code: str | None = None,
                 domain_col: str = "domain", country_col: str = "country") -> DataFrame:
    """Equality filters (pushed to the Parquet scan); country codes fr/ma → France/Maroc."""
    out = df
    if domain:
        out = out.filter(F.col(domain_col) == domain)
    if country_code:
        out = out.filter(F.col(country_col) == V.COUNTRY_NAMES.get(country_code, country_code))
    return out


def complete_offers(df: DataFrame, title_col: str = "title", desc_col: str = "description") -> DataFrame:
    return df.filter(empty_to_null(title_col).isNotNull() & empty_to_null(desc_col).isNotNull())


def keyword_hit(query: str, cols: list[str]) -> Column:
    q = query.lower()
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q)
    return hit


def keyword_search(df: DataFrame, query: str, cols: list[str]) -> DataFrame:
    return df.filter(keyword_hit(query, cols))


def search_with_backfill(df: DataFrame, query: str, cols: list[str], n: int, order_col: str) -> DataFrame:
    """Up to ``n`` rows: matches first, then non-matches, each in ``order_col`` order.
    One ordered ``limit`` (TakeOrderedAndProject: per-partition top-n, then merge)."""
    return (df.withColumn("hit", keyword_hit(query, cols))
            .orderBy(F.col("hit").desc(), F.col(order_col).asc()).limit(n))


def limit_then_sort(df: DataFrame, n: int, order_col: str, score_col: str) -> DataFrame:
    """Cap to the first ``n`` rows in source order, then sort those by score (desc)."""
    return df.orderBy(F.col(order_col).asc()).limit(n).orderBy(F.col(score_col).desc(), F.col(order_col).asc())


def overfetch_top_k(df: DataFrame, k: int, threshold: float, order_col: str, score_col: str = "score") -> DataFrame:
    """Fetch 2k in source order, keep score ≥ threshold, return the top-k by score."""
    cand = df.orderBy(F.col(order_col).asc()).limit(2 * k)
    return min_score(cand, threshold, score_col).orderBy(F.col(score_col).desc(), F.col(order_col).asc()).limit(k)


def cap(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """First ``n`` rows in order; 0 means no cap."""
    return df if n <= 0 else df.orderBy(order_col).limit(n)


def split_by_source(df: DataFrame, source: str = "Scraper", col: str = "source") -> tuple[DataFrame, DataFrame]:
    is_src = F.coalesce(F.col(col), F.lit("")) == source
    return df.filter(is_src), df.filter(~is_src)


def relocate(location: Column, requested: str, country: str) -> Column:
    """Keep the location when it mentions the requested one, else "requested, country"."""
    return F.when(F.coalesce(location, F.lit("")).contains(requested), location) \
        .otherwise(F.lit(f"{requested}, {country}"))


def annotation_template(files: DataFrame, path_col: str = "path") -> DataFrame:
    """One empty annotation row per CV file, keyed by the file stem."""
    stem = F.regexp_extract(F.col(path_col), r"([^/]+?)(\.[^./]*)?$", 1)
    return files.select(stem.alias("cv_id"), F.col(path_col).alias("cv_file"), F.lit("").alias("main_domain"),
                        F.array().cast("array<string>").alias("skills"),
                        F.array().cast("array<string>").alias("expected_job_titles"), F.lit("").alias("notes"))


def ingest_counters(df: DataFrame, ok: Column) -> DataFrame:
    """success / failed / total and success rate (%) in one aggregation."""
    return df.agg(F.sum(F.when(ok, 1).otherwise(0)).cast("long").alias("success_count"),
                  F.sum(F.when(ok, 0).otherwise(1)).cast("long").alias("failed_count"),
                  F.count(F.lit(1)).alias("total_count")) \
        .withColumn("success_rate", F.coalesce(F.try_divide(F.col("success_count") * 100.0, F.col("total_count")),
                                               F.lit(0.0)))


def domain_counts(df: DataFrame, col: str = "domain") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(col))


def point_lookup(df: DataFrame, id_col: str, value) -> DataFrame:
    return df.filter(F.col(id_col) == F.lit(value))


def inherit_domain(requested: str | None, cv: DataFrame, domain_col: str = "domain") -> Column:
    """The caller's domain, else the CV's own (search by résumé id)."""
    return F.coalesce(F.lit(requested), col_(domain_col))
