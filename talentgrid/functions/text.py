"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentgrid import vocab as V


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Python's str.isspace() set, written out so Java and RE2 read the same class.
WS_MEMBERS = (r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
              r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS = "[" + WS_MEMBERS + "]"


def portable_regex(p: str) -> str:
    r"""Rewrite a Python (Unicode ``str``) pattern so Java and RE2 match alike:
    ``\s`` → the explicit whitespace set, ``\d`` → ``\p{Nd}``."""
    out, i, in_cls = [], 0, False
    while i < len(p):
        ch = p[i]
        if ch == "\\" and i + 1 < len(p):
            nxt = p[i + 1]
            if nxt == "s":
                out.append(WS_MEMBERS if in_cls else WS)
            elif nxt == "d":
                out.append(r"\p{Nd}")
            else:
                out.append(p[i:i + 2])
            i += 2
            continue
        if ch == "[" and not in_cls:
            in_cls = True
        elif ch == "]" and in_cls:
            in_cls = False
        out.append(ch)
        i += 1
    return "".join(out)


def trim_ws(c) -> Column:
    """Strip every whitespace character Python's ``str.strip()`` strips (``btrim`` only
    strips spaces)."""
    return F.regexp_replace(col_(c), "^" + WS + "+|" + WS + "+$", "")


def empty_to_null(c) -> Column:
    return F.nullif(col_(c), F.lit(""))


def contains_ci(text, kw: str) -> Column:
    """Case-insensitive substring test (never token-based)."""
    return F.lower(col_(text)).contains(kw.lower())


def occurrences(text_lower, kw_lower) -> Column:
    """Non-overlapping occurrence count of ``kw`` in ``text`` (both already lower)."""
    t, k = col_(text_lower), col_(kw_lower)
    return ((F.length(t) - F.length(F.replace(t, k, F.lit("")))) / F.length(k)).cast("long")


def truncate(c, limit: int, keep: int | None = None, suffix: str = "...") -> Column:
    """``text[:keep] + suffix`` when longer than ``limit`` characters, else unchanged."""
    keep = limit if keep is None else keep
    c = col_(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, keep), F.lit(suffix))).otherwise(c)


_SCRIPT_STYLE = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
_TAG = r"<[^>]*>"
_ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
             ("&nbsp;", " ")]


def html_to_text(c) -> Column:
    """Visible text of an HTML page: drop script/style/comment blocks, tags → space,
    decode the common entities, collapse whitespace."""
    out = F.regexp_replace(col_(c), _SCRIPT_STYLE, " ")
    out = F.regexp_replace(out, _TAG, " ")
    for ent, ch in _ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    out = F.regexp_replace(out, r"\s+", " ")
    return F.trim(out)


def extract_salary(c, patterns=None) -> Column:
    """First salary pattern that matches (case-insensitive, Unicode classes), group 1
    stripped; null when none does."""
    patterns = V.SALARY_PATTERNS if patterns is None else patterns
    c = col_(c)
    outs = []
    for p in patterns:
        rx = "(?iu)" + portable_regex(p)
        outs.append(F.when(c.rlike(rx), trim_ws(F.regexp_extract(c, rx, 1))))
    return F.coalesce(*outs)


def normalize_location(c, country_code: str = "fr", cities=None) -> Column:
    """First known city (list order) contained in the location, else the country
    name; other country codes keep the cleaned text."""
    cities = V.CITIES_BY_COUNTRY if cities is None else cities
    cleaned = F.translate(trim_ws(col_(c)), "\u2013\u00a0", "- ")
    if country_code not in cities:
        return cleaned
    low = F.lower(cleaned)
    picks = [F.when(low.contains(city.lower()), F.lit(city)) for city in cities[country_code]]
    return F.coalesce(*picks, F.lit(V.COUNTRY_NAMES[country_code]))


def search_query(domain, skills, title_query=None, default: str | None = None) -> Column:
    """``"(t1 OR t2) "s1" "s2" "s3""`` from the domain's title query and first 3 skills."""
    title_query = V.JOB_TITLE_QUERY if title_query is None else title_query
    default = V.DEFAULT_SEARCH_QUERY if default is None else default
    m = F.create_map(*[x for k, v in title_query.items() for x in (F.lit(k), F.lit(v))])
    title = F.try_element_at(m, col_(domain))
    title_part = F.when(title.isNotNull() & (title != ""), F.concat(F.lit("("), title, F.lit(")")))
    top = F.slice(F.coalesce(col_(skills), F.array().cast("array<string>")), 1, 3)
    skill_part = F.when(F.size(top) > 0,
                        F.array_join(F.transform(top, lambda s: F.concat(F.lit('"'), s, F.lit('"'))), " "))
    q = F.concat_ws(" ", title_part, skill_part)
    return F.when(q == "", F.lit(default)).otherwise(q)


def url_quote(c) -> Column:
    """Percent-encoding with ``%20`` for spaces and ``/`` left as is."""
    enc = F.url_encode(col_(c))
    return F.replace(F.replace(enc, F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def search_url(base: str, keywords, location, country_code) -> Column:
    return F.concat(F.lit(base), F.lit("?q="), url_quote(keywords), F.lit("&l="), url_quote(location),
                    F.lit("&cc="), col_(country_code))


def domain_label(c) -> Column:
    """``informatique_reseaux`` → ``Informatique Reseaux``."""
    return F.initcap(F.replace(col_(c), F.lit("_"), F.lit(" ")))


def display_name(c, names=None) -> Column:
    names = V.DISPLAY_NAMES if names is None else names
    m = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, col_(c)), domain_label(c))


def percent(c) -> Column:
    """Round-half-up percentage as an integer."""
    return F.floor(col_(c) * 100 + 0.5).cast("long")


def score_band(c, high: float = 0.7, medium: float = 0.5, low: float = 0.3) -> Column:
    c = col_(c)
    return (F.when(c >= high, "high").when(c >= medium, "medium")
            .when(c < low, "low").otherwise("neutral"))


def parse_iso_ts(c) -> Column:
    """ISO-8601 text (with or without microseconds / 'T') → timestamp; null when invalid."""
    return F.coalesce(F.try_to_timestamp(col_(c), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
                      F.try_to_timestamp(col_(c), F.lit("yyyy-MM-dd'T'HH:mm:ss")),
                      F.try_to_timestamp(col_(c)))


def offer_content(title, company, description) -> Column:
    """"title - company\\n\\ndescription"."""
    return F.concat(F.coalesce(col_(title), F.lit("")), F.lit(" - "), F.coalesce(col_(company), F.lit("")),
                    F.lit("\n\n"), F.coalesce(col_(description), F.lit("")))


def json_field(c, path: str) -> Column:
    """One field of a JSON text column (``$.a.b``); null when absent."""
    return F.get_json_object(col_(c), path)


def trimmed_length(c) -> Column:
    """``length(trim_ws(c))`` without rewriting the string: only the leading whitespace
    run and (on the reversed text) the trailing one are scanned."""
    c = col_(c)
    lead = F.length(F.regexp_extract(c, "^" + WS + "*", 0))
    trail = F.length(F.regexp_extract(F.reverse(c), "^" + WS + "*", 0))
    return F.greatest(F.lit(0), F.length(c) - lead - trail)
