"""Keywords with spaces are found across the borders of turns, in one task or several."""

import random

import pytest

from talentgrid.operators import intent as IN

INTENTS = [("a", ["x y z", "zz  z"]), ("b", ["y  x"]), ("c", ["zx yx z y"]), ("d", ["y x"])]


def _expected(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        if role == "user":
            convs[conv].append((turn, (text or "").lower() + " "))
    joined = {c: "".join(t for _, t in sorted(ts)) for c, ts in convs.items()}
    return {c: next((n for n, kws in INTENTS if any(k in t for k in kws)), "general") for c, t in joined.items()}


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_same_as_in_the_joined_turns(spark, parts):
    rng = random.Random(parts)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 9)):
            text = rng.choice([None, "", "X", "y", "z", " ", "".join(rng.choice("xyz ") for _ in range(rng.randrange(14)))])
            rows.append((conv, turn, rng.choice(["user", "user", "user", "assistant"]), text))
    # one conversation holds most turns
    rows += [(1000, t, "user", rng.choice("xz")) for t in range(400)] + [(1000, 400, "user", "y"), (1000, 401, "user", ""), (1000, 402, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = IN.message_intent(df, INTENTS, parts=parts).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r.conv_id: r.intent for r in got} == _expected(rows)


def test_a_long_conversation_lies_in_several_tasks(spark):
    df = spark.range(5000).selectExpr("1L as conv_id", "id as turn", "concat('t', id, ' ') as t")
    seen = IN.turn_borders(df, 4, "conv_id", "turn", "t", 8).collect()
    assert len(seen) == 4999
    text = "".join(f"t{i} " for i in range(5000))
    assert all(r._text in text for r in seen)
    parts = df.repartitionByRange(8, "conv_id", "turn", "t").selectExpr("spark_partition_id() as p").distinct().count()
    assert parts == 8


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert IN.message_intent(df, INTENTS).count() == 0
