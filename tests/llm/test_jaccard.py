import random
import re

import pytest
from pyspark.sql import functions as F

from talentgrid.llm import components, jaccard
from tests.llm.helpers import awkward_rows, documents, prose


def plain(rows, size, num, den):
    """Per row (id, n, class): all pairs compared."""
    sets = []
    for _, text, *_ in rows:
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        k = min(size, len(words))
        sets.append({tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and den * both >= num * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def found(df, size, num, den):
    return sorted((tuple(r) for r in jaccard.join(df, size, num, den).select("id", "n", "component").collect()), key=str)


def chains(seed, families, members):
    """Families of drifting copies, linked only along chains, with shared lines."""
    rng, rows = random.Random(seed), []
    line = prose(rng, 25, 50)
    for f in range(families):
        words = prose(rng, 80, 100000).split()
        for m in range(members):
            words = list(words)
            words[rng.randrange(len(words))] = f"n{f}_{m}"
            text = " ".join(words)
            rows.append((1000 * f + m, text + " " + line if f % 2 else text, "en", "a"))
    return rows


@pytest.mark.parametrize("size,num,den", [(4, 85, 100), (5, 80, 100), (1, 50, 100)])
def test_equals_all_pairs(spark, size, num, den):
    rows = awkward_rows() + chains(2, 4, 12)
    assert found(documents(spark, rows, clash=True), size, num, den) == plain(rows, size, num, den)


def test_families_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    monkeypatch.setattr(jaccard, "CHUNK_DOCS", 16)
    rows = chains(4, 3, 40)
    assert found(documents(spark, rows), 4, 85, 100) == plain(rows, 4, 85, 100)


def test_edges_of_the_threshold(spark):
    words = [f"w{i}" for i in range(43)]                     # 40 shingles
    rows = [(1, " ".join(words)), (2, " ".join(words[:37])),  # 34 of them: 85 %
            (3, " ".join(words[:36])), (4, "A b"), (5, "a  B"), (6, "a b c"), (7, "É b"), (8, "é b")]
    rows = [(i, t, None, None) for i, t in rows]
    got = {i: c for i, _, c in found(documents(spark, rows), 4, 85, 100)}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}


def test_empty(spark):
    assert found(documents(spark, []), 4, 85, 100) == []


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.range(n - 1).select(F.format_string("%05d", "id").alias("a"), F.format_string("%05d", F.col("id") + 1).alias("b"))
    edges = edges.unionByName(spark.createDataFrame([("x", "y"), ("y", "x"), ("z", "z")], "a string, b string"))
    got = components.components(edges.repartition(7)).collect()
    assert {r.node: r.root for r in got} == {**{f"{i:05d}": "00000" for i in range(n)}, "x": "x", "y": "x"}
    assert components.components(edges.limit(0)).count() == 0
