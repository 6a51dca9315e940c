"""Fixtures and plain Python versions for the tests of this folder."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def awkward_rows(seed: int = 1):
    """Nulls in every column, empty and long texts, ties, repeated rows and ids."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    rows = [(i, prose(rng, rng.randint(1, 150)), rng.choice(["en", "fr"]), rng.choice(["a", "b", "c", "d"])) for i in range(40)]
    rows += [(100 + i, base, "en", "a") for i in range(8)]                      # copies
    rows += [(200 + i, base.replace("w1 ", f"x{i} ", 1), "en", "b") for i in range(6)]  # near copies
    rows += [(300, None, None, None), (301, "", "en", ""), (302, " \t\n", None, "a"), (None, "no id here at all", "fr", None),
             (None, None, None, None), (303, prose(rng, 30000), "en", "c"), (304, "a" * 50000, "fr", "d")]
    rows += [(7, rows[7][1], "en", "a"), (8, "another text for id eight", "fr", "b"), rows[3], rows[3]]
    return rows


def documents(spark, rows, clash: bool = False):
    """``clash`` adds columns whose names operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F
        for name in ("id", "size", "row", "body", "words", "kept", "th", "idk", "src", "key", "n", "chunk", "sig", "votes",
                     "start", "spans", "terms", "base", "loc", "bucket", "slot", "target", "score"):
            df = df.withColumn(name, F.lit("x"))
    return df


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect()) if cols else [tuple(r) for r in df.collect()]
