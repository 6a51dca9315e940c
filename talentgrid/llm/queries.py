"""The opN queries of this subpackage and their DuckDB twins, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.llm import bpe, chat, jaccard, langid, lexical, license, mixing, periodic, pii, quality, simhash, suffix, topk
from talentgrid.llm.common import WORD, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}



def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@register("op1_bpe_round_trip")
def op1(spark, sf):
    out = bpe.round_trip(table(spark, sf, "documents"), vocabulary(), public_tokenizers.PATTERN)
    return out.withColumnRenamed("id", "doc_id")


@register("op2_inner_product_topk")
def op2(spark, sf):
    out = topk.search(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, 20)
    return out.withColumnRenamed("id", "vec_id")


@register("op3_pii")
def op3(spark, sf):
    got = pii.spans(table(spark, sf, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    plain = lambda s, kind: F.struct(s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end"))
    base = F.transform("base", lambda s: plain(s, s["kind"]))
    terms = F.transform("terms", lambda s: plain(s, F.lit(len(pii.KINDS))))
    return got.select(F.col("id").alias("doc_id"), *[n(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)],
                      F.sha2(pii.labelled(base), 256).alias("base_sha256"),
                      pii.labelled(F.sort_array(F.concat(base, terms))).alias("spans"))


@register("op4_jaccard_join")
def op4(spark, sf):
    out = jaccard.join(table(spark, sf, "documents"), 4, 85, 100)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@register("op5_chat_perspectives")
def op5(spark, sf):
    out = chat.rotate(table(spark, sf, "conversations"))
    return out.select("conv_id", "perspective", "position", "role", "name",
                      F.col("mask").cast("int").alias("mask"), "seg_start", "seg_end", "mask_start",
                      F.md5("segment").alias("segment_md5"))


@register("op6_language_id")
def op6(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    train = docs.filter(F.col("doc_id").isNotNull() & ~held_out).select(F.col("doc_id").alias("id"), "text", "lang")
    out = langid.predict(docs, langid.fit(train))
    return out.withColumnRenamed("id", "doc_id").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@register("op7_suffix_dedup")
def op7(spark, sf):
    out = suffix.remove_repeats(table(spark, sf, "documents"), texts=False)
    return out.withColumnRenamed("id", "doc_id").drop("kept")


@register("op8_quality_rules")
def op8(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    m = quality.measures(docs, F.col("text")).withColumn("doc_id", F.col("row.doc_id")).drop("row")
    v = stored(quality.votes(m), "quality")
    weights, prior = quality.estimate(v)
    return quality.scored(v, weights, prior=prior).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("quality", 6).alias("quality"))


@register("op9_license_scan")
def op9(spark, sf):
    out = license.scan(table(spark, sf, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
                      F.array_join("licenses", ",").alias("licenses"), "n_unknown")


@register("op10_source_mix")
def op10(spark, sf):
    out = mixing.taken(table(spark, sf, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


def made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text): with h = crc32 of the decimal id, every tenth text goes on from word a
    by repeating the p words there; the others are as they are."""
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1))
    some = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h")) \
        .withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"))))
    again = F.expr("""array_join(transform(sequence(0, size(w) - 1), i -> w[int(if(i < a, i, a + (i - a) % p))]), ' ')""")
    some = some.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.size("w") > 0, F.col("g") % F.size("w"))) \
        .withColumn("p", F.lit(1) + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8)))
    return some.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(again).alias("text"))


@register("op13_periodic_runs")
def op13(spark, sf):
    out = periodic.runs(made_periodic(table(spark, sf, "documents").select("doc_id", "text")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return out.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                      F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                      F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@register("op11_simhash_dedup")
def op11(spark, sf):
    out = simhash.join(table(spark, sf, "documents"), 4, 4)
    return out.select(F.col("id").alias("doc_id"), simhash.hexed("fp").alias("fingerprint"), F.col("component").alias("component_id"))


@register("op12_lexical_search")
def op12(spark, sf):
    out = lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 20)
    return out.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
