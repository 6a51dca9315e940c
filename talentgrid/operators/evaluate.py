"""Evaluation metrics as aggregations (no driver-side loops).

Empty inputs give 0.0 with ``samples = 0``, never null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _nonempty(c: str):
    return F.col(c).isNotNull() & (F.col(c) != "")


def domain_accuracy(pairs: DataFrame, true_col: str = "true_domain", pred_col: str = "pred_domain") -> DataFrame:
    """(accuracy, samples) over rows where both labels are non-empty."""
    p = pairs.filter(_nonempty(true_col) & _nonempty(pred_col))
    return p.agg(F.coalesce(F.avg((F.col(true_col) == F.col(pred_col)).cast("double")), F.lit(0.0)).alias("accuracy"),
                 F.count(F.lit(1)).alias("samples"))


def confusion_matrix(pairs: DataFrame, labels: list[str], true_col: str = "true_domain",
                     pred_col: str = "pred_domain") -> DataFrame:
    """Fixed ``labels × labels`` grid with zero cells kept; labels outside the list are
    ignored. Counts are aggregated first (≤ L² rows), then laid on the literal grid."""
    spark = pairs.sparkSession
    counts = (pairs.filter(F.col(true_col).isin(labels) & F.col(pred_col).isin(labels))
              .groupBy(F.col(true_col).alias("true_label"), F.col(pred_col).alias("pred_label"))
              .agg(F.count(F.lit(1)).alias("n")))
    grid = spark.createDataFrame([(t, p) for t in labels for p in labels], "true_label string, pred_label string")
    return grid.join(counts, ["true_label", "pred_label"], "left").select(
        "true_label", "pred_label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _lower_set(c: str):
    return F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda s: F.lower(s)))


def skills_prf_rows(df: DataFrame, true_col: str = "true_skills", pred_col: str = "pred_skills") -> DataFrame:
    """Per row precision/recall/F1 of lower-cased skill sets; rows with an empty side
    are skipped."""
    t, p = _lower_set(true_col), _lower_set(pred_col)
    x = df.withColumn("_t", t).withColumn("_p", p).filter((F.size("_t") > 0) & (F.size("_p") > 0))
    inter = F.size(F.array_intersect("_t", "_p"))
    x = x.withColumn("precision", inter / F.size("_p")).withColumn("recall", inter / F.size("_t"))
    return x.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * (F.col("precision") * F.col("recall")) / (F.col("precision") + F.col("recall")))
                        .otherwise(F.lit(0.0))).drop("_t", "_p")


def skills_prf(df: DataFrame, true_col: str = "true_skills", pred_col: str = "pred_skills") -> DataFrame:
    """Macro means: precision, recall, f1 (mean of per-row F1), f1_of_means
    (harmonic mean of the two means), samples."""
    r = skills_prf_rows(df, true_col, pred_col)
    a = r.agg(F.coalesce(F.avg("precision"), F.lit(0.0)).alias("precision"),
              F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"),
              F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1"),
              F.count(F.lit(1)).alias("samples"))
    return a.withColumn("f1_of_means", F.when(F.col("precision") + F.col("recall") > 0,
                                              2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                        .otherwise(F.lit(0.0)))


def weighted_prf(pairs: DataFrame, true_col: str = "true_domain", pred_col: str = "pred_domain") -> DataFrame:
    """Accuracy and support-weighted precision/recall/F1 (zero when undefined), from one
    per-(true, pred) count aggregation."""
    c = pairs.groupBy(F.col(true_col).alias("t"), F.col(pred_col).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    tp = c.filter(F.col("t") == F.col("p")).select(F.col("t").alias("label"), F.col("n").alias("tp"))
    sup = c.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support"))
    pred = c.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("predicted"))
    per = (sup.join(pred, "label", "full").join(tp, "label", "left")
           .select("label", F.coalesce("support", F.lit(0)).alias("support"),
                   F.coalesce("predicted", F.lit(0)).alias("predicted"), F.coalesce("tp", F.lit(0)).alias("tp")))
    per = (per.withColumn("prec", F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0))
           .withColumn("rec", F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0))
           .withColumn("f1", F.when(F.col("prec") + F.col("rec") > 0,
                                    2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec"))).otherwise(0.0)))
    tot = F.sum("support")
    return per.agg((F.sum("tp") / tot).alias("accuracy"),
                   (F.sum(F.col("prec") * F.col("support")) / tot).alias("precision"),
                   (F.sum(F.col("rec") * F.col("support")) / tot).alias("recall"),
                   (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"),
                   tot.cast("long").alias("samples"))


def matching_quality(results: DataFrame, truth: DataFrame, group: str = "cv_id") -> DataFrame:
    """Over all (CV, returned offer) rows whose CV has a true domain and true skills:
    domain-match rate and mean share of expected skills present in the offer text.
    results: (group, offer_domain, offer_text); truth: (group, true_domain, true_skills)."""
    t = truth.filter(_nonempty("true_domain") & (F.size(F.array_distinct("true_skills")) > 0))
    j = results.join(t, group)
    sk = F.array_distinct(F.transform("true_skills", lambda s: F.lower(s)))
    share = F.size(F.filter(sk, lambda s: F.col("offer_text").contains(s))) / F.size(sk)
    return j.agg(F.coalesce(F.avg((F.col("offer_domain") == F.col("true_domain")).cast("double")), F.lit(0.0))
                 .alias("domain_match_rate"),
                 F.coalesce(F.avg(share), F.lit(0.0)).alias("skills_match_rate"),
                 F.count(F.lit(1)).alias("samples"))


def retrieval_prf(matched: DataFrame, relevant: DataFrame, group: str = "cv_id", id_col: str = "offer_id") -> DataFrame:
    """Per query precision/recall/F1 of matched vs relevant ids, by joins and counts
    (no id lists are gathered). Queries with no match or no relevant id get zeros."""
    m = matched.select(group, id_col).distinct()
    r = relevant.select(group, id_col).distinct()
    nm = m.groupBy(group).agg(F.count(F.lit(1)).alias("n_matched"))
    nr = r.groupBy(group).agg(F.count(F.lit(1)).alias("n_relevant"))
    hit = m.join(r, [group, id_col]).groupBy(group).agg(F.count(F.lit(1)).alias("n_hit"))
    x = nm.join(nr, group, "full").join(hit, group, "left").fillna(0, ["n_matched", "n_relevant", "n_hit"])
    p = F.when(F.col("n_matched") > 0, F.col("n_hit") / F.col("n_matched")).otherwise(0.0)
    rc = F.when(F.col("n_relevant") > 0, F.col("n_hit") / F.col("n_relevant")).otherwise(0.0)
    x = x.withColumn("precision", p).withColumn("recall", rc)
    return x.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                        .otherwise(0.0))


def expected_vs_detected(truth: DataFrame, global_recall: DataFrame, group: str = "cv_id") -> DataFrame:
    """Expected skills per CV and detected = int(expected × global recall); the global
    recall enters as a scalar subquery (no join)."""
    rec = global_recall.select("recall").scalar()
    e = truth.select(group, F.size(F.array_distinct("true_skills")).alias("expected"))
    return e.select(group, F.col("expected").cast("long").alias("expected"),
                    F.floor(F.col("expected") * rec).cast("long").alias("detected"))
