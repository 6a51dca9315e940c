"""Ranked lexical search against plain scoring of every document."""

import math
import random
import re

import numpy as np
import pytest

from talentgrid.llm import lexical
from tests.llm.helpers import awkward_rows, documents, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(rows, items, k):
    docs = [(r[0], terms(r[1])) for r in rows]
    n_docs, total = sum(1 for _, t in docs if t), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, t in docs:
            if not t:
                continue
            m = 75 + (25 * len(t) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10 ** 9 * t.count(x)) // (1000 * t.count(x) + 12 * m))
                    for x in terms(text) if x in df and x in t)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        found.sort(key=lambda f: f[:3])
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(found[:k])]
    return sorted(out, key=str)


def test_terms():
    text = "Ab-c_D 12é ÀB x\x7fz `q{w}\ttab\x00nul [k] ªº"
    assert [t.decode() for t in lexical.terms_of(text.encode())] == terms(text)


@pytest.mark.parametrize("k,chunk", [(20, lexical.CHUNK_BYTES), (3, 400)])
def test_equals_plain(spark, k, chunk):
    """Nulls, repeats and ties in both tables, also in many chunks of queries."""
    rng = random.Random(k)
    rows = [r for r in awkward_rows() if r[0] != 304]
    rows += [(500 + i, prose(rng, rng.randint(1, 60), 40).upper(), "en", "a") for i in range(150)]
    items = [(i, prose(rng, rng.randint(1, 40), 60)) for i in range(30)]
    items += [(50, None), (51, " , "), (52, "nowhere at all"), (None, "w1 w2, W1"), (3, rows[100][1]), (3, rows[41][1])]
    got = lexical.search(documents(spark, rows, clash=True), spark.createDataFrame(items, "item_id long, text string"), k, chunk_bytes=chunk)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, items, k)


def test_empty(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = documents(spark, [(1, "a b", "en", "a")])
    assert lexical.search(documents(spark, []), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(documents(spark, [(1, None, None, None), (None, "", None, None)]), items).count() == 0
    # a term of every document still weighs floor(1000 ln(4/3))
    assert [tuple(r) for r in lexical.search(docs, items).collect()] == [(1, 1, 1, 2 * 287 * (10 ** 9 // (1000 + 1200)))]


def made(rng, n_docs=900, n_terms=60):
    size = rng.integers(1, 25, n_docs)
    rows = [np.sort(rng.choice(n_terms, s, replace=False, p=np.arange(1, n_terms + 1) / (n_terms * (n_terms + 1) / 2))) for s in size]
    doc, term = np.repeat(np.arange(n_docs), size), np.concatenate(rows)
    return doc, term, rng.integers(1, 10 ** 6, len(doc)) * (n_terms - term)


def test_summaries_bound_and_skip():
    """Every summary is the maximum of its block, and skipped blocks hold nothing better."""
    rng = np.random.default_rng(4)
    doc, term, value = made(rng)
    n_docs, n_terms = 900, 60
    s = lexical.Shard(n_docs, n_terms, doc, term, value)
    dense = np.zeros((n_docs, n_terms), "int64")
    dense[doc, term] = value
    for t in range(n_terms):
        held = []
        for b in range(s.lists[t], s.lists[t + 1]):
            d = s.members[s.first[b]:s.first[b + 1]]
            held += d.tolist()
            assert 0 < len(d) <= lexical.BLOCK
            want = dense[d].max(0)
            want[:t] = 0
            got = np.zeros(n_terms, "int64")
            a, e = s.summary_first[b], s.summary_first[b + 1]
            got[s.summary_term[a:e]] = s.summary_value[a:e]
            assert (got == want).all()
        assert sorted(held) == np.flatnonzero(dense[:, t]).tolist()
    ids = np.arange(n_docs) * 7 % n_docs
    looked = skipped = 0
    for _ in range(40):
        terms_ = np.sort(rng.choice(n_terms, 6, replace=False))
        times = rng.integers(1, 4, 6)
        best = lexical.Best(5)
        got = lexical.visit(s, terms_, times, best, ids, np.arange(n_docs))
        looked, skipped = looked + got[0], skipped + got[1]
        score = dense[:, terms_] @ times
        o = np.lexsort((ids, -score))[:5]
        o = o[score[o] > 0]
        assert best.score.tolist() == score[o].tolist() and best.id.tolist() == ids[o].tolist()
    assert skipped > looked
