"""Periodic runs against a plain search over every period."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from talentgrid.llm import periodic
from talentgrid.llm.queries import QUERIES, made_periodic
from tests.llm.helpers import awkward_rows, documents

SF = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def plain_runs(w):
    """All maximal stretches by period, smallest periods first: (start, length, period)."""
    n, seen, out = len(w), set(), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(24, 3 * q) and (s, e) not in seen:
                seen.add((s, e))
                out.append((s, e - s, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(text):
    w = text.split() if text else []
    runs = plain_runs(w)
    drop = set()
    for s, n, q in runs:
        drop.update(range(s + q, s + n))
    best = None
    for r in runs:
        # exact: length / period as a cross product
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return runs, best, " ".join(x for i, x in enumerate(w) if i not in drop)


def some_words(rng):
    kind = rng.randrange(6)
    letters = "ab" if kind < 3 else "abcdefghij"
    out = []
    for _ in range(rng.randint(1, 5)):
        part = [rng.choice(letters) for _ in range(rng.randint(1, 30))]
        if rng.random() < 0.7:
            part = part * rng.randint(2, 9) + part[:rng.randrange(len(part))]
        if rng.random() < 0.4:
            part = (part + [rng.choice(letters)]) * rng.randint(1, 4)
        out += part
    return out[:400]


@pytest.mark.parametrize("seed", range(12))
def test_slab_equals_plain(seed):
    rng = random.Random(seed)
    texts = [some_words(rng) for _ in range(60)] + [[], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 500, list("abcab") * 60]
    got = periodic._slab([[x.encode() for x in t] for t in texts])
    for t, (runs, kept) in zip(texts, got):
        want, best, text = plain_row(" ".join(t))
        assert list(runs) == want
        assert b" ".join(kept).decode() == text
        assert periodic._best(runs) == best


def test_nested_and_fibonacci_words():
    a, b = ["a"], ["a", "b"]
    while len(b) < 1500:
        a, b = b, b + a
    deep = ((["x"] * 30 + ["y"]) * 5 + ["z"]) * 4
    for t in (b, deep, [str(i // 7 % 5) for i in range(900)], ["p"] * 5000 + ["q"] + ["p"] * 4000):
        (runs, _), = periodic._slab([[x.encode() for x in t]])
        assert list(runs) == plain_runs(t)


def test_wavelet_tree():
    rng = np.random.default_rng(3)
    for m in (1, 2, 7, 64, 1000):
        v = rng.permutation(m)
        tree = periodic.Wavelet(v)
        lo = rng.integers(0, m, 300)
        hi = np.minimum(m, lo + 1 + rng.integers(0, m, 300))
        x = rng.integers(0, m + 2, 300)
        c = tree.below(lo, hi, x)
        assert c.tolist() == [int((v[l:h] < y).sum()) for l, h, y in zip(lo, hi, x)]
        k = rng.integers(0, hi - lo)
        assert tree.nth(lo, hi, k).tolist() == [int(np.sort(v[l:h])[j]) for l, h, j in zip(lo, hi, k)]


def digests(doc_id, text):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    w = text.replace("\x1c", "\x1c").encode().split() if text else []
    w = [x.decode() for x in w]
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs, best, text = plain_row(" ".join(w))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(text))


@there
def test_query_equals_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF).collect())
    assert got == sorted(digests(*r) for r in docs)
    assert sum(1 for r in got if r[1]) > 10


def test_awkward_rows(spark):
    rows = awkward_rows() + [(9000 + i, "la " * i + "end", "en", "a") for i in range(0, 200, 7)] + [(None, "to be " * 40, None, None)]
    rows = [r for r in rows if r[0] != 303] + [(303, "one two three four five " * 9000 + "six", "en", "a")]
    docs = documents(spark, rows, clash=True)
    got = periodic.runs(docs).collect()
    assert len(got) == len(rows)
    show = lambda x: str(x)
    slow = {303, 304}
    have = sorted(((r.id, [tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed) for r in got if r.id not in slow), key=show)
    want = sorted(((r[0], *plain_row(r[1])) for r in rows if r[0] not in slow), key=show)
    assert have == want
    long, = [r for r in got if r.id == 303]
    assert [tuple(x) for x in long.runs] == [(0, 45000, 5)] and long.collapsed == "one two three four five six" and long.n_words == 45001
    assert periodic.runs(documents(spark, [])).count() == 0


def test_made_periodic_keeps_the_words(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 50)), "en", "a") for i in range(200)] + [(None, "a b", "en", "a"), (10, None, "en", "a")]
    got = {(r.doc_id, len((r.text or "").split())) for r in made_periodic(documents(spark, rows)).collect()}
    assert got == {(r[0], len((r[1] or "").split())) for r in rows}
