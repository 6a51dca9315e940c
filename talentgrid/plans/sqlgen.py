"""Helpers that render literal tables as SQL ``VALUES`` for the DuckDB oracles."""

from __future__ import annotations


def q(s) -> str:
    if s is None:
        return "NULL"
    if isinstance(s, bool):
        return "TRUE" if s else "FALSE"
    if isinstance(s, (int, float)):
        return repr(s)
    return "'" + str(s).replace("'", "''") + "'"


def values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"


def vocab_values(vocab) -> str:
    """(domain, domain_ord, kw, kw_ord, weight) rows; keywords lower-cased."""
    rows = []
    for di, (d, kws) in enumerate(vocab.items()):
        items = kws.items() if isinstance(kws, dict) else ((k, None) for k in kws)
        for ki, (k, w) in enumerate(items):
            rows.append((d, di, k.lower(), ki, None if w is None else float(w)))
    return values(rows, ["domain", "domain_ord", "kw", "kw_ord", "weight"])


def skill_values(skills) -> str:
    return values([(s, i, s.lower()) for i, s in enumerate(skills)], ["skill", "skill_ord", "kw"])


def html_text_sql(col: str) -> str:
    """DuckDB twin of functions.text.html_to_text."""
    x = (f"regexp_replace({col}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g')")
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for ent, ch in [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                    ("&nbsp;", " ")]:
        x = f"replace({x}, {q(ent)}, {q(ch)})"
    x = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    return f"trim({x})"
