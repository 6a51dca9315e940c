"""Skill and job-title extraction against ordered vocabularies.

The vocabulary is a literal array, so extraction is a narrow ``filter`` over it per
row: no join, no shuffle, and the result keeps vocabulary order (which decides which
ten skills survive the cut).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid import vocab as V


def _vocab_array(items: list[str]) -> Column:
    return F.array(*[F.struct(F.lit(s).alias("name"), F.lit(s.lower()).alias("kw"), F.lit(i).alias("ord"))
                     for i, s in enumerate(items)])


def matched_terms(text_lower: Column, items: list[str]) -> Column:
    """Vocabulary entries contained in the (lower-cased) text, in vocabulary order.
    One ``when(contains)`` per entry, compacted: plain expressions that whole-stage
    codegen compiles (a lambda over a literal array would be interpreted per row)."""
    return F.array_compact(F.array(*[F.when(text_lower.contains(s.lower()), F.lit(s)) for s in items]))


def matched_ords(text_lower: Column, items: list[str]) -> Column:
    """Ordinals of the contained vocabulary entries (sorted)."""
    return F.array_compact(F.array(*[F.when(text_lower.contains(s.lower()), F.lit(i)) for i, s in enumerate(items)]))


def extract_skills(docs: DataFrame, skills: list[str] | None = None, text_col: str = "text",
                   limit: int | None = 10, default: list[str] | None = None,
                   out_col: str = "skills", lowered: bool = False) -> DataFrame:
    """Add ``skills``: vocabulary skills contained in the text, in vocabulary order,
    first ``limit`` kept (None = all); ``default`` replaces an empty list."""
    skills = V.TECHNICAL_SKILLS if skills is None else skills
    found = matched_terms(F.col(text_col) if lowered else F.lower(F.col(text_col)), skills)
    if limit:
        found = F.slice(found, 1, limit)
    if default:
        found = F.when(F.size(found) == 0, F.array(*[F.lit(s) for s in default])).otherwise(found)
    return docs.withColumn(out_col, found)


def extract_titles(docs: DataFrame, titles: list[str] | None = None, text_col: str = "text",
                   defaults: list[str] | None = None, limit: int = 3) -> DataFrame:
    """Add ``job_titles`` (first ``limit`` found, or the defaults) and ``best_title``."""
    titles = V.COMMON_TITLES if titles is None else titles
    defaults = V.DEFAULT_TITLES if defaults is None else defaults
    found = matched_terms(F.lower(F.col(text_col)), titles)
    found = F.when(F.size(found) == 0, F.array(*[F.lit(s) for s in defaults])).otherwise(found)
    return (docs.withColumn("job_titles", F.slice(found, 1, limit))
            .withColumn("best_title", F.element_at(found, 1)))


def skill_frequency(docs: DataFrame, skills_col: str = "skills") -> DataFrame:
    """(skill, n_docs): documents listing each skill (partial aggregation map-side)."""
    return (docs.select(F.explode(F.array_distinct(F.col(skills_col))).alias("skill"))
            .groupBy("skill").agg(F.count(F.lit(1)).alias("n_docs")))


def distinct_skills(docs: DataFrame, skills: list[str], skills_col: str = "skills") -> DataFrame:
    """Distinct skills over all documents, in vocabulary order (``list(set())`` made
    deterministic)."""
    first = {}
    for i, s in enumerate(skills):
        first.setdefault(s, i)
    order = F.create_map(*[x for s, i in first.items() for x in (F.lit(s), F.lit(i))])
    return (skill_frequency(docs, skills_col)
            .select("skill", F.try_element_at(order, F.col("skill")).alias("skill_ord")))
