"""Every opN query with a SQL twin equals it; the pipeline equals its stages done plainly."""

import os
import random
import re
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

import __spark_entry__ as E  # noqa: E402
import corpus_pipeline as P  # noqa: E402
from check_oracle import digest  # noqa: E402
from talentgrid.llm import mixing, quality  # noqa: E402
from talentgrid.llm.common import stored  # noqa: E402
from talentgrid.llm.oracle import ORACLE  # noqa: E402
from talentgrid.llm.queries import QUERIES  # noqa: E402
from tests.llm.helpers import awkward_rows, documents, prose  # noqa: E402
from tests.llm.test_jaccard import plain as plain_classes  # noqa: E402

SF = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_all_registered():
    names = E.queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14))
    assert "pipeline" in names and set(ORACLE) <= set(QUERIES)


@there
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    rows, cur = [tuple(r) for r in df.collect()], con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert digest(df.columns, rows)[0] == digest(cols, cur.fetchall())[0]


CONTRACTS = {
    "op1": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op2": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op3": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op4": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op6": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
           "base_failed boolean, kept boolean",
    "op10": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op11": "doc_id bigint, fingerprint string, component_id bigint",
    "op12": "item_id bigint, rank int, doc_id bigint, score bigint",
    "op13": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
            "runs_sha256 string, collapsed_sha256 string"}


@there
@pytest.mark.parametrize("op", sorted(CONTRACTS))
def test_contract_columns(spark, op):
    name = next(n for n in QUERIES if n.startswith(op + "_"))
    df = QUERIES[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes).startswith(CONTRACTS[op])


def test_stages_on_awkward_rows(spark):
    docs = documents(spark, awkward_rows(), clash=True)
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        if name != "tokens":
            assert out.columns == docs.columns
            docs = out
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    for _, stage in P.STAGES:
        assert stage(spark, documents(spark, []), SF).count() == 0


def test_quality_stage_is_the_verdict(spark):
    docs = documents(spark, awkward_rows())
    v = stored(quality.votes(quality.measures(docs, F.col("text"))), "votes")
    want = quality.scored(v, quality.fit(v)).filter("kept").select("row.doc_id").collect()
    got = P.quality_rules(spark, docs, SF).select("doc_id").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and 0 < len(got) < docs.count()


def test_one_document_of_a_class_stays(spark):
    rows = awkward_rows()
    out = [tuple(r) for r in P.near_duplicates(spark, documents(spark, rows), SF).collect()]
    # one survivor a class, counted by row numbers: two classes go by id 8
    named = {i: c for i, n, c in plain_classes([(i, *r[1:]) for i, r in enumerate(rows)], P.SHINGLE, P.NUM, P.DEN) if n}
    class_of = {r[1]: named[i] for i, r in enumerate(rows) if i in named}
    assert sorted(class_of[r[1]] for r in out if (r[1] or "").split()) == sorted(set(named.values()))
    assert sum(1 for r in out if r[0] == 8) == 2
    assert sum(1 for r in out if r[0] in range(100, 210)) == 1
    bare = lambda rs: sorted((r for r in rs if not (r[1] or "").split()), key=str)
    assert bare(out) == bare(rows)


def test_classes_without_a_name_of_their_own_stay(spark):
    """Null and repeated ids name no class: as many survivors as brute-force classes."""
    rng = random.Random(8)
    near = prose(rng, 120, 10 ** 6)
    rows = [(None, prose(rng, 60, 10 ** 6), "en", "a") for _ in range(5)]          # different texts, all without id
    rows += [(5, prose(rng, 60, 10 ** 6), "en", "a") for _ in range(4)]            # and all of one id
    rows += [(None, near, "en", "a"), (None, near + " end", "en", "a"), (None, near + " end", "fr", "a")]
    rows += [(5, near.replace(" ", "  ") + " last", "en", "b"), rows[0], rows[5], (None, "", "en", "a"), (5, " ", "en", "a")]
    # rows renumbered, so that every class has a name that no other has
    named = {i: c for i, n, c in plain_classes([(i, *r[1:]) for i, r in enumerate(rows)], P.SHINGLE, P.NUM, P.DEN)}
    class_of = {(r[1] or ""): named[i] for i, r in enumerate(rows)}
    out = [tuple(r) for r in P.near_duplicates(spark, documents(spark, rows), SF).collect()]
    got = sorted(class_of[r[1]] for r in out if r[1].split())
    assert got == sorted({named[i] for i, r in enumerate(rows) if r[1].split()}) and len(got) == 10
    assert sorted(str(r[0]) for r in out if not r[1].split()) == ["5", "None"]
    assert [r[0] for r in out if class_of[r[1]] == class_of[near]] == [5]


def test_mix_keeps_every_document(spark):
    docs = documents(spark, awkward_rows())
    out = P.source_mix(spark, docs, SF)
    assert docs.distinct().subtract(out).count() == 0 and out.distinct().subtract(docs).count() == 0
    assert docs.count() < out.count() <= 2 * docs.count()


def test_mix_meets_the_targets_of_the_operator(spark):
    """Words of every source: its target where that is above its size, else the source; also
    with null and repeated ids of equal size."""
    rng = random.Random(9)
    rows = [(i if s == "a" else None if s == "b" else 7, prose(rng, 50), "en", s) for s in "abc" for i in range(40)]
    rows += [(1000 + i, prose(rng, rng.randint(1, 900)), "en", s) for s in "de" for i in range(30)]
    docs = documents(spark, rows)
    goal = {r.source: (r.target, r.source_size) for r in mixing.taken(docs).select("source", "target", "source_size").distinct().collect()}
    assert any(t < n for t, n in goal.values()) and any(n < t < 1.9 * n for t, n in goal.values())
    got = {r.source: r.w for r in P.source_mix(spark, docs, SF).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("w")).collect()}
    for s, (target, size) in goal.items():
        # blocks are dealt to within a few, see test_mixing
        slack = 450 + 6 * max(1, min(mixing.BLOCK_WORDS, -(-size // mixing.MIN_BLOCKS)))
        assert abs(got[s] - max(target, size)) <= (slack if s in "de" else 400), (s, got, goal)


@there
def test_run(spark):
    out = P.run(spark, SF)
    n = spark.read.parquet(SF + "/documents.parquet").count()
    assert out.columns == ["doc_id", "n_tokens", "ids"] and 0.5 * n < out.count() < 2 * n
