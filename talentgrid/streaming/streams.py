"""Incremental operators on Structured Streaming.

Sources are file streams (new JSON/Parquet files landing in a folder); every query has
its own checkpoint under the shared ``spark.checkpoint.dir`` so a restarted driver or a
lost executor resumes from the last committed micro-batch. Sinks are Parquet folders
(append) or one folder of changes per micro-batch. ``trigger(availableNow=True)`` processes what is
there and stops, which is how tests and scheduled runs drive them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from talentgrid.session import scratch_path


def file_stream(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet",
                glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if fmt == "json":
        r = r.option("multiLine", "true")
    return r.load(folder)


def dedup_stream(stream: DataFrame, keys: list[str], event_time: str, delay: str = "1 day") -> DataFrame:
    """Drop repeats of ``keys`` arriving within the watermark delay (state is bounded by
    the watermark, unlike a batch keep-first over all history)."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def window_counts(stream: DataFrame, event_time: str, group_cols: list[str], size: str = "6 hours",
                  delay: str = "1 hour") -> DataFrame:
    """Arrivals per tumbling window and group. In append mode a window comes out once the
    watermark has passed its end, in update mode (see :func:`run_updates`) also while it is
    open; rows later than the delay are dropped."""
    return (stream.withWatermark(event_time, delay)
            .groupBy(F.window(F.col(event_time), size).alias("w"), *group_cols)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *group_cols, "n"))


def run_to_parquet(df: DataFrame, name: str, output_mode: str = "append") -> str:
    """Run a streaming DataFrame to completion into a Parquet folder under the shared
    checkpoint folder; returns the folder."""
    spark = df.sparkSession
    run = f"{name}-{uuid.uuid4().hex[:8]}"
    out = scratch_path(spark, f"stream-out/{run}")
    ck = scratch_path(spark, f"stream-ckpt/{run}")
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode(output_mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def run_updates(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run an aggregating stream to completion in update mode and return its latest row per
    key, so windows that the watermark has not closed are there as well. Every micro-batch
    writes its updates to a folder of its own; a repeated batch overwrites only that."""
    spark = df.sparkSession
    run = f"{name}-{uuid.uuid4().hex[:8]}"
    out, ck = scratch_path(spark, f"stream-out/{run}"), scratch_path(spark, f"stream-ckpt/{run}")
    values = [c for c in df.columns if c not in keys]

    def put(batch, batch_id):
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    df.writeStream.foreachBatch(put).option("checkpointLocation", ck).outputMode("update") \
        .trigger(availableNow=True).start().awaitTermination()
    last = F.max_by(F.struct(*values), "_batch")
    return spark.read.parquet(out).groupBy(*keys).agg(last.alias("_v")).select(*keys, "_v.*")


def latest_stream(stream: DataFrame, key: str, version_col: str, name: str) -> DataFrame:
    """Latest-wins upsert: the row of highest version per key, kept in streaming state. Every
    micro-batch writes the keys it changed and nothing else (see :func:`run_updates`)."""
    cols = stream.columns
    last = stream.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(version_col)).alias("_row"))
    return run_updates(last, [key], name).select("_row.*")


SESSION_STATE = "version long, domain string, overall_n long, overall long, n long, diff long"
CHANGES = "domain string, sessions long, overall_n long, overall long, n long, diff long"
#: Sums are kept in whole millionths of a millionth, so that a replaced session leaves no rest.
UNIT = 10 ** 12


def session_parts(sessions: DataFrame) -> DataFrame:
    """(session_id, version, domain, overall_n, overall, n, diff): what a feedback session adds to
    the statistics. ``sessions``: (session_id, version long, domain, overall_rating,
    ratings array<struct<system_score, user_rating>>); ratings above 0 count."""
    from talentgrid.operators.feedback import normalized_system_score
    given = F.filter(F.coalesce("ratings", F.array().cast(sessions.schema["ratings"].dataType)), lambda r: F.coalesce(r["user_rating"] > 0, F.lit(False))
                     & r["system_score"].isNotNull())
    far = lambda r: F.abs(normalized_system_score(r["system_score"]) - r["user_rating"])
    units = lambda c: F.round(c * F.lit(float(UNIT))).cast("long")
    some = F.coalesce(F.col("overall_rating") > 0, F.lit(False))
    return sessions.filter("session_id is not null").select(
        F.col("session_id").cast("string").alias("session_id"), F.coalesce(F.col("version").cast("long"), F.lit(0)).alias("version"), "domain",
        some.cast("long").alias("overall_n"), F.when(some, units(F.col("overall_rating"))).otherwise(0).cast("long").alias("overall"),
        F.size(given).cast("long").alias("n"), F.aggregate(F.transform(given, lambda r: units(far(r))), F.lit(0).cast("long"), lambda a, x: a + x).alias("diff"))


def _session_changes(key, frames, state):
    """The newest row of the session against the one in the state: what leaves and what comes."""
    import pandas as pd
    cols = ["version", "domain", "overall_n", "overall", "n", "diff"]
    rows = [r for f in frames for r in f[cols].itertuples(index=False, name=None)]
    new = max(rows, key=lambda r: r[0])
    new = (int(new[0]), None if pd.isna(new[1]) else new[1], *(int(x) for x in new[2:]))
    old = state.get if state.exists else None
    if old is not None and new[0] < old[0]:
        return
    state.update(new)
    out = [(new[1], 1, *new[2:])] + ([(old[1], -1, *(-x for x in old[2:]))] if old is not None else [])
    yield pd.DataFrame(out, columns=["domain", "sessions", "overall_n", "overall", "n", "diff"])


def running_feedback(sessions: DataFrame, table: str) -> None:
    """Keeps feedback statistics up to date under ``table`` (a shared folder): the state holds
    every session's last part, a new version takes back the old one, and each micro-batch writes
    one row of changes per domain to a folder of its own, which a repeated batch overwrites.
    Started again with the same table, it goes on where it stopped; read with
    :func:`feedback_after`."""
    changes = session_parts(sessions).groupBy("session_id").applyInPandasWithState(
        _session_changes, CHANGES, SESSION_STATE, "update", "NoTimeout")

    def put(batch, batch_id):
        sums = [F.sum(c).alias(c) for c in ("sessions", "overall_n", "overall", "n", "diff")]
        batch.groupBy("domain").agg(*sums).write.mode("overwrite").parquet(f"{table}/changes/part={batch_id}")

    changes.writeStream.foreachBatch(put).option("checkpointLocation", f"{table}/checkpoint").outputMode("update") \
        .trigger(availableNow=True).start().awaitTermination()


def feedback_after(spark: SparkSession, table: str, batch_id: int | None = None) -> DataFrame:
    """(domain, sessions, avg_overall, n_ratings, agreement_pct) per domain and over all
    (``__all__``) as of a micro-batch (the last one by default), as the batch statistics have it."""
    x = spark.read.parquet(f"{table}/changes")
    x = x if batch_id is None else x.filter(F.col("part") <= batch_id)
    x = x.rollup("domain").agg(*[F.sum(c).alias(c) for c in ("sessions", "overall_n", "overall", "n", "diff")], F.grouping_id().alias("g"))
    mean = lambda total, n: F.when(F.col(n) > 0, F.col(total) / F.col(n) / F.lit(float(UNIT)))
    agree = F.greatest(F.lit(0.0), F.lit(1.0) - mean("diff", "n") / F.lit(4.0)) * F.lit(100.0)
    return x.filter((F.col("sessions") > 0) | (F.col("g") == 1)).select(
        F.when(F.col("g") == 1, F.lit("__all__")).otherwise(F.col("domain")).alias("domain"), "sessions",
        mean("overall", "overall_n").alias("avg_overall"), F.col("n").alias("n_ratings"), agree.alias("agreement_pct"))


def retention_classes(df: DataFrame, ts_col: str, now: str, keep_days: int = 7, archive_days: int = 30) -> Column:
    """keep (newer than ``keep_days``), archive (up to ``archive_days``), expire (older).
    ``now`` is an argument, never read inside the query."""
    ts = F.col(ts_col)
    now_c = F.to_timestamp(F.lit(now))
    return (F.when(ts >= now_c - F.expr(f"INTERVAL {keep_days} DAYS"), F.lit("keep"))
            .when(ts >= now_c - F.expr(f"INTERVAL {archive_days} DAYS"), F.lit("archive"))
            .otherwise(F.lit("expire")))


def stream_offers(spark: SparkSession, folder: str, country_code: str = "fr", delay: str = "1 day") -> DataFrame:
    """Incremental offer ingest: new JSON offer files → normalised location and salary,
    deterministic id, collected-at timestamp, repeats of an id within the watermark
    dropped. Returns the streaming DataFrame (start it with ``run_to_parquet``)."""
    from talentgrid.functions.ids import offer_id
    from talentgrid.functions.text import extract_salary, normalize_location, parse_iso_ts
    from talentgrid.sources.schemas import OFFER
    s = file_stream(spark, folder, OFFER, "json")
    s = s.select("title", "company", normalize_location(F.coalesce("location", F.lit("")), country_code).alias("location"),
                 "description", F.coalesce("salary", extract_salary("description")).alias("salary"),
                 "domain", parse_iso_ts("date_collected").cast("timestamp").alias("date_collected"))
    s = s.withColumn("id", offer_id("title", "company", "location", "description"))
    return dedup_stream(s, ["id"], "date_collected", delay)
