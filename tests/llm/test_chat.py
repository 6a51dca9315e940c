import random

from talentgrid.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, neutral=chat.NEUTRAL):
    out, convs = [], {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "unknown", x or ""))
    for c, turns in convs.items():
        turns.sort()
        for me in sorted({r for _, _, r, _ in turns} - set(neutral)):
            text = ""
            for k, (_, _, who, body) in enumerate(turns):
                role = "assistant" if who == me else who if who in neutral else "user"
                name = who if role == "user" else None
                head = f"<|im_start|>{role}" + (f" name={name}" if name else "") + "\n"
                start = len(text)
                text += head + body + "<|im_end|>\n"
                out.append((c, me, k, role, name, text[start:], who == me, start, len(text), start + len(head) if who == me else None))
    return sorted(out, key=str)


def test_equals_plain_rendering(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 4)
    rng = random.Random(3)
    rows = [(rng.randrange(12), rng.randrange(30), rng.choice(["user", "assistant", "system", "ann", None]),
             rng.choice(["hi", "", None, "é😀 long " * 20])) for _ in range(300)]
    rows += [(99, i, rng.choice(["ann", "bob"]), f"turn {i}") for i in range(500)]     # a long dialogue
    rows += [(None, 1, "user", "x"), (None, None, "ann", "y"), (50, -7, "user", "early"), (50, None, "bob", "earliest"),
             (51, 1, "system", "alone"), rows[0], rows[0], (60, 1, "a" * 5000, "z" * 100000)]
    got = chat.rotate(spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA + ", ck string, who int, n int")
    assert chat.rotate(df).count() == 0
    df = spark.createDataFrame([(1, 1, "user", "a", "x", 2, 3)], SCHEMA + ", ck string, who int, n int")
    assert chat.rotate(df).count() == 1
