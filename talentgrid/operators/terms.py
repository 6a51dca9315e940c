"""Key terms (TF-IDF over the whole corpus) and keyword overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentgrid import vocab as V
from talentgrid.operators.match import top_k_per_group
from talentgrid.session import materialize

#: Terms whose document counts are sent to every task.
SHARED_TERMS = 200_000


def tokens(df: DataFrame, id_col: str, text_col: str, stop_words=None, min_len: int = 3) -> DataFrame:
    """(id, term): lower-cased letter runs of at least ``min_len`` letters, stop words out."""
    stop = V.KEY_TERM_STOP_WORDS if stop_words is None else stop_words
    t = df.select(id_col, F.explode(F.split(F.lower(F.col(text_col)), r"[^\p{L}]+")).alias("term"))
    return t.filter((F.length("term") >= min_len) & ~F.col("term").isin(stop))


def key_terms(df: DataFrame, id_col: str, text_col: str, n: int = 5, stop_words=None) -> DataFrame:
    """Top-``n`` terms per document by tf·ln(N/df), ties by term; whole texts.
    (The source ranked model tokens by activation size on the first 512 characters;
    this is the deterministic corpus statistic.)"""
    # rows of one id meet once, as texts: (id, term) rows are counted and ranked there, and not shuffled
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * df.rdd.getNumPartitions())
    whole = df.select(id_col, text_col).repartition(parts, F.col(id_col))
    tf = tokens(whole, id_col, text_col, stop_words).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    dfreq = materialize(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    ndocs = df.agg(F.count(F.lit(1))).scalar()                    # scalar subquery, no join
    weight = F.col("tf") * F.log(ndocs / F.col("df"))
    best = [F.col("tfidf").desc(), F.col("term").asc()]
    # the frequent terms, nearly all occurrences, are weighed in place and the n best of a document
    # kept; only these and the rarer terms leave it
    near = tf.join(F.broadcast(_frequent(dfreq)), "term", "left").withColumn("tfidf", weight)
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col("tfidf").desc_nulls_last(), F.col("term").asc()))
    near = materialize(near.withColumn("_r", rank).filter(F.col("df").isNull() | (F.col("_r") <= n)).drop("_r"))
    rare = near.filter("df is null").drop("df", "tfidf").join(dfreq, "term").withColumn("tfidf", weight)
    x = near.filter("df is not null").unionByName(rare)
    return top_k_per_group(x, [id_col], best, n, "term_rank").select(id_col, "term", "tf", "df", "tfidf", "term_rank")


def _frequent(dfreq: DataFrame) -> DataFrame:
    """The terms above a power of two of documents, the lowest that leaves at most ``SHARED_TERMS``."""
    power = F.floor(F.log2("df")).cast("int")
    least, terms = 64, 0
    for r in sorted(dfreq.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.p):  # 64 rows at most
        terms += r.n
        if terms > SHARED_TERMS:
            break
        least = r.p
    return dfreq.filter(power >= least)


def keyword_overlap(pairs: DataFrame, cv_terms: DataFrame, job_terms: DataFrame,
                    cv_col: str = "cv_id", job_col: str = "offer_id") -> DataFrame:
    """int(|cv terms ∩ job terms| / |job terms| · 100) per (cv, job) pair; pairs whose job
    has no terms get null. Bounded joins: each side holds the top terms only."""
    p = pairs.select(cv_col, job_col).distinct()
    ct = cv_terms.select(cv_col, "term").distinct()
    jt = job_terms.select(job_col, "term").distinct()
    nj = jt.groupBy(job_col).agg(F.count(F.lit(1)).alias("n_job"))
    inter = (p.join(ct, cv_col).join(jt, [job_col, "term"])
             .groupBy(cv_col, job_col).agg(F.count(F.lit(1)).alias("n_common")))
    x = p.join(nj, job_col, "left").join(inter, [cv_col, job_col], "left").fillna(0, ["n_common"])
    return x.select(cv_col, job_col, F.col("n_common").cast("long").alias("n_common"),
                    F.when(F.col("n_job") > 0, F.floor((F.col("n_common") / F.col("n_job")) * 100).cast("long"))
                    .alias("overlap_pct"))
