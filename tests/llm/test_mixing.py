import re

import pytest

from talentgrid.llm import mixing
from tests.llm.helpers import awkward_rows, documents, prose


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Share by weight, cap, share the excess of the capped again until nobody is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > cap * sizes[s]]
        if not over:
            return {**capped, **{s: left * weight[s] / w for s in free}}
        capped.update({s: cap * sizes[s] for s in over})


def sizes_of(rows):
    out = {}
    for _, text, _, source in rows:
        out[source] = out.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return out


def skewed():
    import random
    rng = random.Random(6)
    return [(i, prose(rng, rng.randint(0, 300)), None, "hot" if i % 3 else f"s{i % 17:02d}") for i in range(400)]


@pytest.mark.parametrize("rows", [awkward_rows(), skewed()])
def test_targets_and_taken(spark, rows):
    df = documents(spark, rows, clash=False)
    got = mixing.taken(df).collect()
    sizes = sizes_of(rows)
    want = plain_targets(sizes)
    assert sorted((str(r.id), r.size) for r in got) == sorted(
        (str(i), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, *_ in rows)
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        width = max(1, min(mixing.BLOCK_WORDS, -(-sizes[s] // mixing.MIN_BLOCKS)))
        assert abs(n - want[s]) <= 6 * width, s
    again = mixing.taken(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_segments_make_up_the_schedule(spark):
    """Slots are unique, segments stay inside their documents, every stretch of the
    schedule holds each source in proportion."""
    where, segments = mixing.mix(documents(spark, skewed()))
    size = {(r.src, r.start): r.size for r in where.filter("size > 0").collect()}
    seg = segments.collect()
    assert all(0 <= s.from_word and s.n_words > 0 and s.from_word + s.n_words <= size[s.src, s.start] for s in seg)
    slots = sorted({(s.slot, s.src, s.epoch) for s in seg})
    assert len(slots) == len({s[0] for s in slots})
    share = sum(s[1] == "=hot" for s in slots) / len(slots)
    for at in range(0, len(slots) - 50, 50):
        part = sum(s[1] == "=hot" for s in slots[at:at + 50])
        assert abs(part - 50 * share) <= 4


def test_small_buckets_give_the_same(spark, monkeypatch):
    df = documents(spark, skewed())
    first = sorted(map(str, mixing.taken(df).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    monkeypatch.setattr(mixing, "SLOT_CHUNK", 16)
    assert sorted(map(str, mixing.taken(df).collect())) == first


def test_empty_and_wordless(spark):
    assert mixing.taken(documents(spark, [])).count() == 0
    rows = [(1, None, None, "a"), (2, " \n", None, "a"), (3, "", None, None)]
    assert [(r.size, r.taken, r.target) for r in mixing.taken(documents(spark, rows, clash=True)).collect()] == [(0, 0, 0.0)] * 3


def test_only_sql_functions(spark):
    plan = mixing.taken(documents(spark, skewed()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan
