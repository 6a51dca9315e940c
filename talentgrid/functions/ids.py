"""Deterministic identifiers (md5 hex, identical in Spark and DuckDB)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentgrid.functions.text import col_, empty_to_null


def offer_id(title, company, location, description) -> Column:
    """md5 of the ``|``-joined non-empty (title, company, location, description[:100])."""
    return F.md5(F.concat_ws("|", empty_to_null(title), empty_to_null(company),
                             empty_to_null(location),
                             empty_to_null(F.substring(col_(description), 1, 100))))


def fallback_offer_id(id_col, title, company, description) -> Column:
    """Keep a present id, else md5(lower(title)|company|lower(description))."""
    h = F.md5(F.concat_ws("|", F.lower(F.coalesce(col_(title), F.lit(""))),
                          F.coalesce(col_(company), F.lit("")),
                          F.lower(F.coalesce(col_(description), F.lit("")))))
    return F.coalesce(empty_to_null(id_col), h)


def session_id(domain, skills, timestamp) -> Column:
    """md5("domain|skill,skill|timestamp")."""
    return F.md5(F.concat(F.coalesce(col_(domain), F.lit("")), F.lit("|"),
                          F.array_join(F.coalesce(col_(skills), F.array().cast("array<string>")), ","),
                          F.lit("|"), col_(timestamp)))
