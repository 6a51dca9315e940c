"""Quality rules by weak supervision.

Each rule looks at one measure of a text and votes good (1), bad (-1) or abstains (0).
Documents with the same votes are one row of a pattern table (at most 3 ** rules rows),
over which expectation-maximisation estimates the accuracy of every rule and the share of good
documents. A document is kept when its posterior probability of being good is at least
``keep_at``; no single rule has to pass, and where good documents are the rule a lone bad vote
without another to confirm it does not reject. Measures, votes and posterior are SQL functions
inside one scan of the texts; only the pattern counts reach the driver.

Defined results: a null or empty text has no words and fails the base rule; repeated rows
and very long texts are measured like any other (sorting, never pairwise comparing); an
empty table gives an empty result. Columns besides id and text are passed on untouched and
may bear any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.llm.common import WORD

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: (rule, good test, bad test): a rule votes 1, -1 or, where neither holds, abstains. The
#: absence of one fault is no evidence of quality, so most rules only ever vote bad; prose
#: votes good where the whole text reads like sentences. Line ends are judged only where lines are
#: long enough to be sentences: verse and lists end their lines as they like.
RULES = (
    ("prose", "2 * n_line_ends >= n_lines and word_chars between 3 * n_words and 9 * n_words"
              " and 50 * n_symbols <= n_words and 5 * n_upper <= word_chars and n_bangs = 0", "false"),
    ("length", "n_words >= 300 and n_lines >= 5 and 10 * n_symbols <= n_words", "n_words < 50"),
    ("word_length", "false", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    ("symbols", "false", "10 * n_symbols > n_words"),
    ("marked_words", "false", "5 * n_symbols > n_words"),
    ("dup_lines", "false", "10 * n_dup_lines > 3 * n_lines"),
    ("repeat_words", "false", "100 * n_repeat_words > 30 * n_words"),
    ("capitals", "false", "2 * n_upper > word_chars"),
    ("line_ends", "false", "n_lines > 1 and 10 * n_line_ends < n_lines and n_words >= 15 * n_lines"),
    ("bangs", "false", "20 * n_bangs > n_words"),
)

#: A line's end as a sentence's: a stop of any common script, closing quotes and brackets behind it.
LINE_END = "[.!?:;\u2026\u3002\uff01\uff1f\u0964\u0965\u061f\u06d4\u0589\u1362][\"')\\]\u00bb\u201d\u2019\u203a\u300d\u300f]*[\\x20\\x09-\\x0D]*$"


def measures(docs: DataFrame, text: Column) -> DataFrame:
    """One struct column ``row`` with the whole input row, and the measures beside it."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    d = docs.select(F.struct("*").alias("row"), body.alias("body"))
    count = lambda pattern: F.regexp_count("body", F.lit(pattern)).cast("long")
    d = d.withColumn("words", F.regexp_extract_all("body", F.lit(WORD), F.lit(0)))
    d = d.withColumn("lines", F.filter(F.split("body", "\n"), lambda x: x.rlike(WORD)))
    d = d.select("row", F.size("words").cast("long").alias("n_words"),
                 F.length(F.translate("body", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
                 (F.length("body") - F.length(F.translate("body", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
                 F.size("lines").cast("long").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.size(F.filter("lines", lambda x: x.rlike(LINE_END))).cast("long").alias("n_line_ends"),
                 count(r"\p{Lu}").alias("n_upper"), count("!!").alias("n_bangs"),
                 F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    # 3-word windows as hashes; only a text that has a repeated one sorts them
    d = d.withColumn("g", F.when(F.size("h") >= 3, F.transform(
        F.slice("h", 1, F.greatest(F.size("h") - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("s", F.when(F.size(F.array_distinct("g")) < F.size("g"), F.sort_array(
        F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    again = F.filter("s", lambda e, k: F.get("s", k - 1)["h"].eqNullSafe(e["h"])
                     | F.get("s", k + 1)["h"].eqNullSafe(e["h"]))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda e: F.sequence(e["i"], e["i"] + 2))))
    return d.withColumn("n_repeat_words", F.coalesce(F.size(covered), F.lit(0)).cast("long")).drop("h", "g", "s")


def votes(measured: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``votes`` and ``base_failed``. Write the result before filtering on it (see
    ``common.stored``): a filter pushed below the measures would take them again."""
    vote = [F.when(F.expr(good), 1).when(F.expr(bad), -1).otherwise(0) for _, good, bad in rules]
    return measured.withColumn("votes", F.array(*vote)) \
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                    | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def estimate(voted: DataFrame, start: float = 0.85, rounds: int = 40) -> tuple[list[float], float]:
    """The log odds of every rule's accuracy and those of a document's being good beforehand, by
    expectation-maximisation over the counts of the vote patterns: a rule gains where others agree
    with its votes and loses where they don't. Accuracies begin at ``start`` and stay in
    [0.55, 0.98], so that no rule turns into its opposite; the share of good documents begins at a
    half and stays in [0.5, 0.95], so that a text without any vote is never rejected."""
    rows = [(r.votes, r["count"]) for r in voted.groupBy("votes").count().collect()]  # at most 3 ** rules
    k = len(rows[0][0]) if rows else 0
    acc, share = [start] * k, 0.5
    odds = lambda p: math.log(p / (1 - p))
    for _ in range(rounds):
        w = [odds(a) for a in acc]
        right, total = [10 * start] * k, [10.0] * k  # ten made-up votes
        goods, docs = 5.0, 10.0  # ten made-up documents
        for vs, n in rows:
            good = 1 / (1 + math.exp(-odds(share) - sum(v * x for v, x in zip(vs, w))))
            goods, docs = goods + n * good, docs + n
            for j, v in enumerate(vs):
                if v:
                    right[j] += n * (good if v > 0 else 1 - good)
                    total[j] += n
        acc = [min(0.98, max(0.55, r / t)) for r, t in zip(right, total)]
        share = min(0.95, max(0.5, goods / docs))
    return [odds(a) for a in acc], odds(share)


def fit(voted: DataFrame, start: float = 0.85, rounds: int = 40) -> list[float]:
    """The rules' log odds alone, see :func:`estimate`."""
    return estimate(voted, start, rounds)[0]


def scored(voted: DataFrame, weights: list[float], keep_at: float = 0.5, prior: float = 0.0) -> DataFrame:
    """Adds ``quality`` (posterior probability, ``prior`` being the log odds beforehand) and ``kept``."""
    logit = F.lit(float(prior))
    for j, w in enumerate(weights):
        logit = logit + F.get("votes", F.lit(j)) * F.lit(w)
    return voted.withColumn("quality", 1 / (1 + F.exp(-logit))) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_at))
