"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as
the next one's input.

1. quality: documents that the quality rules reject go.
2. near-duplicates: one document of each class of near-copies stays, the one of smallest id.
3. personal data: base spans are masked, disclosing terms generalised or removed.
4. mixing: every document stays as often as the source mix (op10's weights) plays it, at
   least once: clean documents are kept, so a source whose target is below its size is not
   reduced to it.
5. tokens: byte-level BPE ids of every document.

Every stage takes any number of rows (none included), nulls in any column and further
columns of any name; all but the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from talentgrid.llm import bpe, jaccard, mixing, pii, quality
from talentgrid.llm.common import key_of, stored

#: Near-copies share 80 % of their five-word shingles.
SHINGLE, NUM, DEN = 5, 80, 100


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the weak-supervision posterior keeps, unchanged. One pass counts
    the votes and one decides; the texts are not written in between."""
    voted = quality.votes(quality.measures(docs, F.col("text")))
    weights, prior = quality.estimate(voted)
    judged = quality.scored(voted, weights, prior=prior).select("row", "kept", F.monotonically_increasing_id().alias("at"))
    # the running number keeps the filter above the measures, which it would repeat below
    kept = judged.filter(F.col("kept") & (F.col("at") >= 0))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class one document, with the class's smallest id (of several with that id,
    the one whose text has the smallest hash); documents without words all stay."""
    # by the key of the class: its smallest id can be null, or name another class too
    found = stored(jaccard.join(docs, SHINGLE, NUM, DEN).drop("component"), "near-classes")
    worded = found.filter("n > 0")
    first = worded.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "th")).alias("x"))
    first = first.select(key_of(F.col("x.id")).alias("idk"), F.col("x.th").alias("th")).withColumn("one", F.lit(True))
    bare = found.filter("n = 0").select(key_of(F.col("id")).alias("idk"), "th").distinct().withColumn("one", F.lit(False))
    d = docs.select(F.struct("*").alias("row"), key_of(F.col("doc_id")).alias("idk"),
                    F.xxhash64(F.col("text").cast("string")).alias("th"))
    picked = d.join(first.unionByName(bare), ["idk", "th"])
    # rows with equal id and text are one class; the join has brought them together
    one = picked.filter("one").dropDuplicates(["idk", "th"])
    return one.unionByName(picked.filter("not one")).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with sanitised texts."""
    return pii.sanitise(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix plays it in full, rounded, and at least once. The
    plays of a source are a run of whole epochs and one begun, so its words meet a target above
    its size to within half a document; a source with a smaller target stays whole."""
    mixed = mixing.taken(docs).filter("size > 0")
    # rows with equal id, source and size share their plays
    times = mixed.groupBy(key_of(F.col("id")).alias("idk"), key_of(F.col("source")).alias("src"), "size") \
        .agg(F.count("*").alias("n"), F.sum(F.greatest(F.lit(1), F.round(F.col("taken") / F.col("size")).cast("int"))).alias("plays"))
    d = docs.select(F.struct("*").alias("row"), key_of(F.col("doc_id")).alias("idk"), key_of(F.col("source")).alias("src"),
                    mixing.word_count(F.col("text")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    d = d.join(times, ["idk", "src", "size"], "left")
    # and they are dealt one by one, not as an average that rounds for all of them alike
    place = F.row_number().over(W.partitionBy("idk", "src", "size").orderBy("th"))
    share = F.expr("plays div n") + F.when(place <= F.col("plays") % F.col("n"), 1).otherwise(0)
    d = d.withColumn("times", F.when(F.col("n") > 1, share).otherwise(F.coalesce("plays", F.lit(1))).cast("int"))
    d = d.withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    return d.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids). The tables are small and dropped after every partition: the
    other stages' executors share their memory with the workers that this one leaves behind."""
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, vocabulary, public_tokenizers.PATTERN, tables=0.2, keep=False).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality_rules), ("near-duplicates", near_duplicates), ("personal-data", personal_data),
          ("mix", source_mix), ("tokens", tokens)]

#: The fitted and hashed steps have no SQL twin; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
