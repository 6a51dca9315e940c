import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from talentgrid.llm import suffix
from tests.llm.helpers import awkward_rows, documents, prose


def plain(rows, length):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[i:i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                mark[i:i + length] = b"\1" * length
        kept = bytes(b for b, m in zip(t, mark) if not m)
        out.append((d, len(t), sum(mark), sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1])),
                    hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def made(seed, n=60):
    rng = random.Random(seed)
    passage, other = prose(rng, 60), "é🙂" * 40
    rows = []
    for i in range(n):
        parts = [prose(rng, rng.randint(0, 40), 100000)]
        if i % 2:
            parts.append(passage[:rng.randint(100, len(passage))])
        if i % 5 == 0:
            parts.append(other)
        if i % 7 == 0:
            parts.append(passage[50:])
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts), "en", "a"))
    return rows + [(900, "ab" * 400, "en", "a"), (901, "x" * 199, None, None), (902, "x" * 200, None, None), (903, "z" * 201, None, None)]


@pytest.mark.parametrize("length,bucket", [(200, 8192), (64, 50), (33, 8)])
def test_equals_plain_marking(spark, length, bucket):
    rows = made(3) + [r for r in awkward_rows() if r[0] != 303]
    got = suffix.remove_repeats(documents(spark, rows, clash=True), length=length, bucket_suffixes=bucket)
    want = plain(rows, length)
    assert sorted(((*tuple(r)[:5], bytes(r.kept)) for r in got.collect()), key=str) == want


def test_hot_passage_over_many_buckets(spark, monkeypatch):
    """One passage in every document, its suffixes dealt over several buckets."""
    monkeypatch.setattr(suffix, "SLAB", 3000)
    monkeypatch.setattr(suffix, "CHUNK_DOCS", 8)
    monkeypatch.setattr(suffix, "MAX_SPLITTERS", 40)
    rng = random.Random(8)
    passage = prose(rng, 50)
    rows = [(i, prose(rng, 5, 10 ** 6) + " " + passage + " " + prose(rng, 5, 10 ** 6), None, None) for i in range(120)]
    got = suffix.remove_repeats(documents(spark, rows), length=100, bucket_suffixes=4)
    assert sorted(((*tuple(r)[:5], bytes(r.kept)) for r in got.collect()), key=str) == plain(rows, 100)


def test_empty_and_short(spark):
    assert suffix.remove_repeats(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix.remove_repeats(documents(spark, []), length=10)


def test_multikey_sort():
    rng = np.random.default_rng(1)
    for n in (0, 1, 70, 3000):
        words = rng.integers(0, 4, (n, 5)).astype("uint64")
        got = words[suffix.multikey_sort(words)]
        assert got.tolist() == sorted(words.tolist())


def test_anchors_of_equal_windows_agree():
    rng = random.Random(2)
    text = "".join(rng.choice("abc ") for _ in range(3000)).encode()
    a = suffix.Anchors([b"prefix " + text, text + b" suffix"], 100)
    where = [{}, {}]
    for at, first, last, doc in zip(a.at, a.first, a.last, a.doc):
        for i in range(first, last + 1):
            where[doc][int(i - a.starts[doc])] = int(at - i)
    assert all(where[0][i + 7] == where[1][i] for i in range(2900))


def test_anchors_do_not_depend_on_the_slab():
    """A passage has the same anchors alone and behind a megabyte of other text."""
    rng = random.Random(5)
    passage = prose(rng, 300).encode()
    alone = suffix.Anchors([passage], 200)
    far = suffix.Anchors([prose(rng, 250_000).encode(), passage], 200)
    mine = far.doc == 1
    assert mine.any() and len(far.buffer) > 1 << 20
    for a, b in ((alone.at, far.at[mine]), (alone.first, far.first[mine]), (alone.last, far.last[mine])):
        assert np.array_equal(a, b - far.starts[1])
    assert np.array_equal(alone.key, far.key[mine])
