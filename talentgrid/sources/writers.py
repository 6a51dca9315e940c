"""Writers. Large outputs are written by the executors (partitioned folders); nested
"envelope" documents are built with ``collect_list`` per key — per CV / per session,
whose size is bounded by the top-k or the session length, never by the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_offers(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Format by suffix: .csv (header), .json (JSON lines), else Parquet (optionally
    partitioned, e.g. by domain so domain filters prune folders)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if path.endswith(".csv"):
        w.option("header", "true").csv(path)
    elif path.endswith(".json"):
        w.json(path)
    else:
        w.parquet(path)


def offer_envelope(df: DataFrame, timestamp: str) -> DataFrame:
    """The batch envelope (timestamp, count) per batch key ``batch`` — a manifest; the
    jobs themselves are written row-wise by ``write_offer_batches`` instead of being
    gathered into one array per batch."""
    return df.groupBy("batch").agg(F.lit(timestamp).alias("timestamp"), F.count(F.lit(1)).alias("count"))


def write_offer_batches(df: DataFrame, path: str, timestamp: str) -> DataFrame:
    """Offers as JSON lines partitioned by ``batch`` plus a manifest of (batch,
    timestamp, count); returns the manifest."""
    df.write.mode("overwrite").partitionBy("batch").json(path + "/jobs")
    manifest = offer_envelope(df, timestamp)
    manifest.write.mode("overwrite").json(path + "/manifest")
    return manifest


def with_offer_id(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Offers without an id get the deterministic one of their texts; other tables stay as they are."""
    from talentgrid.functions.ids import offer_id
    if id_col in df.columns and all(c in df.columns for c in ["title", "company", "location", "description"]):
        return df.withColumn(id_col, F.coalesce(F.nullif(F.col(id_col), F.lit("")),
                                                offer_id("title", "company", "location", "description")))
    return df


def upsert_collection(existing: DataFrame, updates: DataFrame, id_col: str = "id",
                      version_col: str = "version") -> DataFrame:
    """Insert-or-replace by id (the newer version wins); rows without id get the
    deterministic offer id. For a stored table see ``stored.store_collection``."""
    from talentgrid.operators.feedback import upsert_latest
    return upsert_latest(with_offer_id(existing, id_col), with_offer_id(updates, id_col), id_col, version_col)


def ingest_offers(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Offers with defaults and content; (valid, invalid, counters). Valid = title and
    description present."""
    from talentgrid.operators.offers import offer_defaults, ingest_counters
    from talentgrid.functions.text import empty_to_null
    x = offer_defaults(df)
    ok = empty_to_null("title").isNotNull() & empty_to_null("description").isNotNull()
    return x.filter(ok), x.filter(~ok), ingest_counters(x, ok)


def write_training_set(df: DataFrame, path: str) -> DataFrame:
    """CSV with header; returns the domain distribution."""
    df.select("instruction", "input", "output", "domain").write.mode("overwrite") \
        .option("header", "true").option("escape", '"').csv(path)
    return df.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "domain")


def write_embeddings(df: DataFrame, path: str, input_name: str, column: str,
                     emb_col: str = "embedding") -> DataFrame:
    """Vectors + texts + classifications as Parquet, and a one-row metadata table."""
    df.write.mode("overwrite").parquet(path + "/data")
    meta = df.agg(F.lit(input_name).alias("input"), F.lit(column).alias("column"),
                  F.max(F.size(emb_col)).alias("dim"), F.count(F.lit(1)).alias("n"))
    meta.write.mode("overwrite").json(path + "/metadata")
    return meta


def matching_run(analysis: DataFrame, results: DataFrame, params: dict, timestamp: str,
                 group: str = "cv_id") -> DataFrame:
    """One nested record per CV: analysis + results sorted by rank + parameters."""
    res = results.groupBy(group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct(*[c for c in results.columns
                                                                             if c != group]).alias("r")))),
                    lambda e: e["r"]).alias("results"))
    p = F.struct(*[F.lit(v).alias(k) for k, v in params.items()])
    return analysis.join(res, group, "left").select(
        group, F.lit(timestamp).alias("timestamp"),
        F.struct(*[c for c in analysis.columns if c != group]).alias("cv_analysis"),
        F.coalesce(F.col("results"), F.array()).alias("results"), p.alias("parameters"))


def write_matching_run(run: DataFrame, path: str) -> None:
    run.write.mode("overwrite").json(path)


def upsert_feedback(existing: DataFrame, new_sessions: DataFrame) -> DataFrame:
    """Replace the session with the same id, else append (the new one wins)."""
    from talentgrid.operators.feedback import upsert_latest
    return upsert_latest(existing.withColumn("_v", F.lit(0)), new_sessions.withColumn("_v", F.lit(1)),
                         "session_id", "_v").drop("_v")


def write_evaluation_report(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)


def ingest_scraped(df: DataFrame, domain_override: str | None = None, vocab: dict | None = None,
                   skills: list[str] | None = None, skill_domain: dict | None = None,
                   max_jobs: int = 0, order_col: str = "ord") -> DataFrame:
    """Scraped offers ready to store: incomplete ones (no title or description) skipped,
    domain = the override, else the stored domain, else the extended analyser's best
    domain over "title description"; optional cap (0 = none). Batching of uploads was a
    transport detail; the result is written by the caller."""
    from talentgrid.operators.offers import complete_offers
    from talentgrid.operators.classify import domain_scores_extended
    x = complete_offers(df)
    if max_jobs > 0:
        x = x.orderBy(order_col).limit(max_jobs)
    if domain_override:
        return x.withColumn("domain", F.lit(domain_override))
    if vocab is None:
        return x
    # by text, not by id: repeated or missing ids neither add up nor go without a domain
    text = F.concat_ws(" ", "title", "description")
    x = x.withColumn("_id", F.sha2(text, 256))
    txt = x.select("_id", text.alias("_t")).dropDuplicates(["_id"])
    sc = domain_scores_extended(txt, vocab, skills or [], skill_domain or {}, id_col="_id", text_col="_t")
    best = sc.groupBy("_id").agg(F.max_by("domain", F.struct("score", -F.col("domain_ord"))).alias("_d"))
    return x.join(best, "_id", "left").withColumn(
        "domain", F.coalesce(F.nullif(F.col("domain"), F.lit("")), F.col("_d"))).drop("_id", "_d")
