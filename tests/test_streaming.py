import json
import os
import time

from pyspark.sql import functions as F

from talentgrid.streaming import streams as ST
from talentgrid.sources import schemas as SC


def test_stream_dedup_across_batches(spark, tmpdir_path):
    land = os.path.join(tmpdir_path, "landing")
    os.makedirs(land)
    rows = [{"id": "a", "title": "Dev", "date_collected": "2025-01-01 10:00:00"},
            {"id": "b", "title": "Ops", "date_collected": "2025-01-01 11:00:00"}]
    with open(os.path.join(land, "f1.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))
    schema = "id string, title string, date_collected timestamp"
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").json(land)
    out = ST.run_to_parquet(ST.dedup_stream(s, ["id"], "date_collected", "1 day"), "t1")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_window_counts_and_retention(spark):
    ev = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 05:50:00", "x"), ("2024-01-01 06:10:00", "y"),
                                ("2024-01-02 00:00:00", "y")], "ts string, t string") \
        .select(F.to_timestamp("ts").alias("ts"), "t")
    cls = {r.ts.day: r.c for r in ev.select("ts", ST.retention_classes(ev, "ts", "2024-01-09 00:00:00").alias("c")).collect()}
    assert cls[1] == "archive" and cls[2] == "keep"


def test_stream_offers_normalises_and_dedups(spark, tmpdir_path):
    land = os.path.join(tmpdir_path, "offers")
    os.makedirs(land)
    o = {"title": "Dev", "company": "A", "location": "Paris - 75001", "description": "Salaire 45K€",
         "date_collected": "2025-04-06T05:00:00.000001"}
    with open(os.path.join(land, "a.json"), "w") as f:
        json.dump(o, f)
    with open(os.path.join(land, "b.json"), "w") as f:
        json.dump(dict(o, date_collected="2025-04-06T06:00:00"), f)
    out = ST.run_to_parquet(ST.stream_offers(spark, land), "offers")
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 1 and rows[0].location == "Paris" and rows[0].salary == "45K"


def _sessions(spark, rows):
    kind = "session_id string, version long, domain string, overall_rating long, ratings array<struct<system_score: double, user_rating: long>>"
    return spark.createDataFrame(rows, kind)


def test_running_feedback_equals_batch_after_every_batch(spark, tmpdir_path):
    """Replaced, late, null and repeated sessions, over a restart."""
    import random

    import pytest

    from talentgrid.operators.feedback import feedback_stats
    rnd = random.Random(4)
    land, table = os.path.join(tmpdir_path, "land"), os.path.join(tmpdir_path, "table")
    batches = [[(f"s{rnd.randrange(12)}", rnd.randrange(100), rnd.choice(["it", "fin", None]), rnd.choice([None, 0, 1, 4, 5]),
                 [(rnd.random(), rnd.choice([None, 0, 1, 3, 5])) for _ in range(rnd.randint(0, 4))] or None) for _ in range(15)] for _ in range(4)]
    # versions within a batch and across batches differ, so that the newest row is one
    seen = set()
    batches = [[r for r in b if (r[0], r[1]) not in seen and not seen.add((r[0], r[1]))] for b in batches]
    batches[2].append((None, 1, "it", 5, [(0.5, 5)]))

    def put(i):
        _sessions(spark, batches[i]).coalesce(1).write.mode("append").parquet(land)

    for i in range(4):
        put(i)
        # every call is a restart of the query
        s = ST.file_stream(spark, land, _sessions(spark, []).schema)
        ST.running_feedback(s, table)
        last = {}
        for r in (r for b in batches[:i + 1] for r in b if r[0] is not None):
            if r[0] not in last or r[1] >= last[r[0]][1]:
                last[r[0]] = r
        now = _sessions(spark, list(last.values()))
        ratings = now.selectExpr("domain as cv_domain", "inline(ratings)")
        want = {r.domain: r for r in feedback_stats(now.withColumnRenamed("domain", "cv_domain"), ratings).collect()}
        got = {r.domain: r for r in ST.feedback_after(spark, table).collect()}
        assert set(got) == set(want)
        for d, w in want.items():
            assert (got[d].sessions, got[d].n_ratings) == (w.sessions, w.n_ratings)
            assert got[d].avg_overall == pytest.approx(w.avg_overall) and got[d].agreement_pct == pytest.approx(w.agreement_pct)
    first = {r.domain: r.sessions for r in ST.feedback_after(spark, table, 0).collect()}
    assert first["__all__"] == len({r[0] for r in batches[0]})


def test_latest_stream_keeps_one_row_per_key(spark, tmpdir_path):
    land = os.path.join(tmpdir_path, "rows")
    for v in ([("a", 1, "x"), ("b", 5, "y")], [("a", 3, "z"), ("b", 2, "w"), (None, 1, "n")]):
        spark.createDataFrame(v, "k string, ver long, val string").coalesce(1).write.mode("append").parquet(land)
    s = ST.file_stream(spark, land, spark.read.parquet(land).schema, max_files_per_trigger=1)
    got = sorted((tuple(r) for r in ST.latest_stream(s, "k", "ver", "latest").collect()), key=str)
    assert got == sorted([("a", 3, "z"), ("b", 5, "y"), (None, 1, "n")], key=str)
