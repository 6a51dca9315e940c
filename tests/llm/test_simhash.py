"""SimHash classes against all pairs of plain fingerprints."""

import os
import random

import numpy as np
import pytest
import xxhash

from talentgrid.llm import simhash
from talentgrid.llm.components import Forest
from talentgrid.llm.queries import QUERIES
from tests.llm.helpers import awkward_rows, documents, prose

SF = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def plain_print(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = low.encode().split()
    shingles = [b" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain(rows, size, radius):
    """(id, fingerprint, component) of every row."""
    fps = [plain_print(r[1], size) for r in rows]
    nodes = sorted(set(fps))
    f = Forest()
    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                f.join(a, b)
    low = {}
    for r, fp in zip(rows, fps):
        if r[0] is not None:
            low[f.root(fp)] = min(r[0], low.get(f.root(fp), r[0]))
    return [(r[0], f"{fp:016x}", low.get(f.root(fp))) for r, fp in zip(rows, fps)]


def test_majority():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 1, 2, 255, 256, 1000, 0, 511, 3])
    h = rng.integers(0, 2 ** 63, sizes.sum(), dtype="uint64") * np.uint64(2) + rng.integers(0, 2, sizes.sum(), dtype="uint64")
    got, at = simhash.majority(h, sizes), 0
    for n, g in zip(sizes.tolist(), got.tolist()):
        part, at = h[at:at + n].tolist(), at + n
        assert g == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in part) > n)


@pytest.mark.parametrize("radius", [0, 1, 4, 9])
def test_links_span_all_links(radius):
    """Classes from two tiles and from one are those of all pairs."""
    rng = np.random.default_rng(radius)
    centre = rng.integers(0, 2 ** 63, 40, dtype="uint64")
    flips = lambda n: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, 3), dtype="uint64"), axis=1)
    fps = np.unique(np.concatenate([np.repeat(centre, 30) ^ flips(1200), rng.integers(0, 2 ** 63, 900, dtype="uint64")]))
    side = rng.integers(0, 2, len(fps)).astype(bool)
    order = lambda x: x[np.lexsort((x, *simhash._counts(x).T[::-1]))]
    a, b = order(fps[side]), order(fps[~side])
    for x, y, same in ((a, b, False), (order(fps), order(fps), True)):
        left, right = simhash.links(x, y, radius, same)
        both = x if same else np.concatenate([x, y])
        assert len(left) < len(both) and all((int(both[i]) ^ int(both[j])).bit_count() <= radius for i, j in zip(left, right))
        f, g = Forest(), Forest()
        for i, j in zip(left, right):
            f.join(int(both[i]), int(both[j]))
        near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
        for i, j in zip(*np.nonzero(near)):
            g.join(int(x[i]), int(y[j]))
        assert [f.root(int(v)) for v in both] == [g.root(int(v)) for v in both]


@pytest.mark.parametrize("tile", [simhash.TILE, 16])
def test_equals_all_pairs(spark, tile):
    """Also with so small tiles that classes and cells span many of them."""
    rng = random.Random(5)
    rows = awkward_rows()[:-1]
    rows = [r for r in rows if r[0] not in (303, 304)] + [(303, prose(rng, 3000), "en", "c")]
    base = prose(rng, 300, 50).split()
    for i in range(120):  # a chain of near copies
        base[rng.randrange(len(base))] = f"Ä{i}"
        rows.append((1000 + i, " ".join(base).upper() if i % 2 else "\t".join(base), "en", "a"))
    docs = documents(spark, rows, clash=True)
    got = simhash.join(docs, 4, 4, tile=tile)
    got = got.select("id", simhash.hexed("fp").alias("fp"), "component")
    key = lambda r: (str(r[0]), r[1])
    want = plain([(i, None if t is None else t, *_) for i, t, *_ in rows], 4, 4)
    # the letters beyond A-Z keep their case
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_ids_and_empty(spark):
    rows = [(None, "", "en", "a"), (5, None, "en", "a"), (3, " \n", "en", "a"), (None, "a lonely text of several words", "en", "a"), (9, "a", None, None)]
    got = {(r.id, r.fp, r.component) for r in simhash.join(documents(spark, rows), 4, 4).collect()}
    assert {(None, 0, 3), (5, 0, 3), (3, 0, 3)} <= got and any(r[0] is None and r[1] and r[2] is None for r in got)
    assert simhash.join(documents(spark, []), 4, 4).count() == 0


@there
def test_query_equals_all_pairs(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in QUERIES["op11_simhash_dedup"](spark, SF).collect()) == sorted(plain(docs, 4, 4))
