"""Stored tables: a batch rewrites the buckets of its keys and nothing else."""

import os

import pytest

from talentgrid.sources import stored as SD


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_only_the_buckets_of_the_batch_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(f"k{i}", i % 5, f"v{i}") for i in range(500)]
    first = spark.createDataFrame(rows, "id string, version int, v string")
    assert SD.upsert_stored(first, path, "id", "version", 32) == list(range(32))
    before = _files(path)
    batch = [("k3", 9, "new"), ("k4", 1, "older"), ("k9", 4, "equal"), ("z", None, "null version"), ("z", 0, "z"),
             ("z", -1, "y"), (None, 99, "no key")]
    touched = SD.upsert_stored(spark.createDataFrame(batch, "id string, version int, v string"), path, "id", "version", 32)
    after = _files(path)
    assert 1 <= len(touched) <= 4 and len(set(before) & set(after)) == 32 - len(touched)
    assert all(after[f] == before[f] for f in set(before) & set(after))
    want = {k: (n, v) for k, n, v in rows}
    want.update({"k3": (9, "new"), "k9": (4, "equal"), "z": (0, "z")})
    got = SD.read_stored(spark, path).collect()
    assert len(got) == len(want) and {r.id: (r.version, r.v) for r in got} == want
    # the same batch again changes no row; an empty one writes nothing
    SD.upsert_stored(spark.createDataFrame(batch, "id string, version int, v string"), path, "id", "version", 32)
    assert {r.id: (r.version, r.v) for r in SD.read_stored(spark, path).collect()} == want
    last = _files(path)
    assert SD.upsert_stored(first.limit(0), path, "id", "version", 32) == [] and _files(path) == last


def test_columns_and_buckets_are_those_of_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1, "x")], "id string, version int, v string")
    assert SD.upsert_stored(df.limit(0), path, "id", "version", 8) == []
    SD.upsert_stored(df, path, "id", "version", 8)
    with pytest.raises(ValueError, match="8 buckets"):
        SD.upsert_stored(df, path, "id", "version", 16)
    with pytest.raises(ValueError, match="not in the table"):
        SD.upsert_stored(df.withColumnRenamed("v", "w"), path, "id", "version", 8)
    with pytest.raises(ValueError, match="own"):
        SD.upsert_stored(df.withColumnRenamed("v", "_bucket"), path, "id", "version", 8)
    SD.upsert_stored(spark.createDataFrame([("b", 1)], "id string, version int"), path, "id", "version", 8)
    assert sorted((r.id, r.v) for r in SD.read_stored(spark, path).collect()) == [("a", "x"), ("b", None)]


def test_feedback_history_and_details(spark, tmp_path):
    schema = ("session_id string, timestamp string, results struct<cv_analysis: struct<main_domain: string>, jobs: array<string>>, "
              "feedback struct<overall_rating: long>")
    path = str(tmp_path)
    SD.save_feedback(spark.createDataFrame([("s1", "2025-01-01", (("finance",), ["j1"]), (3,)),
                                            ("s2", "2025-01-01", None, (4,))], schema), path, 4)
    SD.save_feedback(spark.createDataFrame([("s1", "2025-01-02", (("sante",), ["j2"]), (5,))], schema), path, 4)
    history = {r.session_id: (r.cv_domain, r.feedback.overall_rating) for r in SD.read_stored(spark, path + "/history").collect()}
    assert history == {"s1": ("sante", 5), "s2": ("unknown", 4)}
    details = {r.session_id: r.results and r.results.jobs for r in SD.read_stored(spark, path + "/details").collect()}
    assert details == {"s1": ["j2"], "s2": None}


def test_collection_gives_ids(spark, tmp_path):
    schema = "id string, title string, company string, location string, description string, version int"
    df = spark.createDataFrame([(None, "t", "c", "l", "d", 1), ("", "t", "c", "l", "d", 2), ("own", "t", "c", "l", "d", 1)], schema)
    SD.store_collection(df, str(tmp_path / "c"), buckets=4)
    got = SD.read_stored(spark, str(tmp_path / "c")).collect()
    assert sorted(r.version for r in got) == [1, 2] and all(r.id for r in got)
