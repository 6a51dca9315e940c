"""Tables kept by key: batches of rows are inserted or replace what has their key.

A table is a Parquet folder partitioned by a bucket of the key's digest. A batch reads and
rewrites the buckets that hold its keys, by dynamic partition overwrite; all other files stay
as they are. Keys fall evenly into buckets, so a bucket's size is the table's divided by their
number: choose it so that a bucket suits one task.

Defined cases: rows without a key are not stored; of several rows with a key the highest version
stays, the batch's if equal; a null version is lowest; an empty batch changes nothing. The columns
are those of the first batch: a batch may lack some (null) but not bring others. Lost executors are
repeated by Spark. Buckets are put in place one after the other at the end of the job, so batches of
one table must not run at once, and a driver lost in that moment leaves its staged files to be
moved by hand.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talentgrid.session import materialize

BUCKETS = 256
_PARTS = ["_of", "_bucket"]


def bucket_of(key, buckets: int) -> Column:
    """0 .. buckets - 1 from the key's digest."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("int"), F.lit(buckets))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        # nothing was stored yet; every other failure is the caller's to see
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a stored table."""
    return spark.read.parquet(path).drop(*_PARTS)


def upsert_stored(updates: DataFrame, path: str, key: str, version_col: str, buckets: int = BUCKETS) -> list[int]:
    """Inserts or replaces the rows of ``updates`` by ``key`` in the table at ``path``, made by the
    first batch; returns the buckets written, at most ``buckets``."""
    spark = updates.sparkSession
    taken = set(updates.columns) & {*_PARTS, "_src", "_row"}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are the table's own")
    old = _stored(spark, path)
    if old is not None:
        more = set(updates.columns) - set(old.columns)
        if more:
            raise ValueError(f"columns {sorted(more)} are not in the table")
        has = old.select("_of").first()
        if has is not None and has[0] != buckets:
            raise ValueError(f"the table has {has[0]} buckets, not {buckets}")
        updates = updates.to(old.drop(*_PARTS).schema)
    new = updates.filter(F.col(key).isNotNull()).withColumn("_bucket", bucket_of(key, buckets)).withColumn("_src", F.lit(1))
    new = materialize(new)
    touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())
    if not touched:
        return touched
    both = new
    if old is not None:
        both = new.unionByName(old.filter(F.col("_bucket").isin(touched)).drop("_of").withColumn("_src", F.lit(0)))
    cols = [c for c in both.columns if c not in ("_bucket", "_src")]
    # partial aggregation first: a key repeated in the batch travels once a task
    rows = (both.groupBy("_bucket", key).agg(F.max_by(F.struct(*cols), F.struct(version_col, "_src")).alias("_row"))
            .select("_row.*", F.lit(buckets).alias("_of"), "_bucket"))
    (rows.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*_PARTS).parquet(path))
    return touched


def save_feedback(sessions: DataFrame, path: str, buckets: int = BUCKETS) -> tuple[list[int], list[int]]:
    """Feedback sessions (session_id, timestamp, results struct with ``cv_analysis.main_domain``,
    feedback struct) into the history and, with the whole results, the detail records; a session
    saved again replaces its earlier rows in both. A missing domain reads "unknown"."""
    domain = F.coalesce(F.col("results.cv_analysis.main_domain"), F.lit("unknown"))
    history = sessions.select("session_id", "timestamp", domain.alias("cv_domain"), "feedback")
    details = sessions.select("session_id", "timestamp", "results", "feedback")
    return (upsert_stored(history, f"{path}/history", "session_id", "timestamp", buckets),
            upsert_stored(details, f"{path}/details", "session_id", "timestamp", buckets))


def store_collection(updates: DataFrame, path: str, id_col: str = "id", version_col: str = "version",
                     buckets: int = BUCKETS) -> list[int]:
    """CVs or offers into a stored collection by id; offers without one get the id of their texts."""
    from talentgrid.sources.writers import with_offer_id
    return upsert_stored(with_offer_id(updates, id_col), path, id_col, version_col, buckets)
