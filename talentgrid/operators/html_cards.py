"""Offer cards from raw HTML pages.

Parsing HTML is the one step built-in expressions cannot do, so it runs as
``mapInPandas`` over page batches with the standard-library parser (a small per-row
helper); everything after it — location, salary, domain, ids, de-duplication — is
JVM-side DataFrame work.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CARD_SCHEMA = ("page_id long, card_pos int, title string, company string, location string, "
               "description string, href string")

# selector alternatives, tried in order: (tag, css class or None); the job-site card
# layouts are fixed values kept with the vocabularies
from talentgrid.vocab import JOB_SITE_SELECTORS as INDEED_SELECTORS  # noqa: E402
from talentgrid.vocab import SAMPLE_CARD_SELECTORS as SAMPLE_SELECTORS  # noqa: E402

ARTICLE_SELECTORS = {
    "card": [("article", None)],
    "title": [("h1", None)],
    "company": [("span", "company")],
    "location": [("span", "location")],
    "description": [("p", None)],
    "link": [("a", None)],
}

_VOID = {"br", "img", "meta", "link", "input", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Node:
    __slots__ = ("tag", "cls", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag = tag
        self.attrs = dict(attrs)
        self.cls = set((self.attrs.get("class") or "").split())
        self.children = []
        self.parent = parent


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", [], None)
        self.cur = self.root
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        n = _Node(tag, attrs, self.cur)
        self.cur.children.append(n)
        if tag in ("script", "style"):
            self.skip += 1
        if tag not in _VOID:
            self.cur = n

    def handle_endtag(self, tag):
        x = self.cur
        while x is not self.root and x.tag != tag:
            x = x.parent
        if x is not self.root:
            if tag in ("script", "style"):
                self.skip = max(0, self.skip - 1)
            self.cur = x.parent

    def handle_data(self, data):
        if not self.skip:
            self.cur.children.append(data)


def _iter(node):
    """All elements below ``node`` in document order; no recursion, pages may nest without
    end."""
    todo = [ch for ch in reversed(node.children) if isinstance(ch, _Node)]
    while todo:
        n = todo.pop()
        yield n
        todo += [ch for ch in reversed(n.children) if isinstance(ch, _Node)]


def _select(node, sel):
    tag, cls = sel
    return [n for n in _iter(node) if n.tag == tag and (cls is None or cls in n.cls)]


def _text(node) -> str:
    parts, todo = [], list(reversed(node.children))
    while todo:
        ch = todo.pop()
        if isinstance(ch, _Node):
            if ch.tag not in ("script", "style"):
                todo += reversed(ch.children)
        elif ch.strip():
            parts.append(ch.strip())
    return "".join(parts)


class _TextTree(_Tree):
    """As the tree of the cards; comments and declarations part the strings around them."""

    def _part(self, _data):
        self.cur.children.append(_Node("#other", [], self.cur))

    handle_comment = handle_decl = handle_pi = unknown_decl = _part


def _strings(node) -> list[str]:
    """The text nodes below ``node`` in document order, scripts and styles left out."""
    out, todo, joined = [], list(reversed(node.children)), False
    while todo:
        ch = todo.pop()
        if isinstance(ch, str):
            # a stray "<" reaches the tree as a string of its own
            if joined:
                out[-1] += ch
            else:
                out.append(ch)
            joined = True
            continue
        joined = False
        if ch is not None and ch.tag not in ("script", "style"):
            todo.append(None)
            todo += reversed(ch.children)
    return out


_STEP = re.compile(r"\s*(>?)\s*((?:[\w*-]+)?(?:[.#][\w-]+|\[[^\]]*\])*)")
_PART = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]")


def parse_selector(selector: str) -> list[list[tuple]]:
    """``a, b > c d`` as alternatives of steps (child only, tag, [(attribute, value)]); steps are tag,
    ``.class``, ``#id``, ``[attr]``, ``[attr=value]``; anything else is refused."""
    out = []
    for alternative in selector.split(","):
        steps, at, alternative = [], 0, alternative.strip()
        while at < len(alternative):
            m = _STEP.match(alternative, at)
            if not m or not m.group(2):
                raise ValueError(f"selector not understood: {selector!r}")
            tag = re.match(r"[\w*-]*", m.group(2)).group(0).lower()
            tests = [({".": "class", "#": "id"}[kind] if kind else attr.lower(), name if kind else value)
                     for kind, name, attr, value in (p.groups() for p in _PART.finditer(m.group(2)))]
            steps.append((m.group(1) == ">", "" if tag == "*" else tag, tests))
            at = m.end()
        if not steps:
            raise ValueError(f"selector not understood: {selector!r}")
        out.append(steps)
    return out


def _passes(node, tag, tests) -> bool:
    return (not tag or node.tag == tag) and all(
        (value in node.cls if name == "class" else name in node.attrs and value in (None, node.attrs[name]))
        for name, value in tests)


def _chosen(root, alternatives) -> list:
    """Elements that a selector names, in document order, each once; one pass down, in which every
    element knows the steps that its ancestors have taken (no recursion)."""
    out, start = [], [(a, 0) for a in range(len(alternatives))]
    todo = [(ch, frozenset(start), frozenset()) for ch in reversed(root.children) if isinstance(ch, _Node)]
    while todo:
        node, within, child_of = todo.pop()
        went = set()
        for a, i in within | child_of:
            child_only, tag, tests = alternatives[a][i]
            if (not child_only or i == 0 or (a, i) in child_of) and _passes(node, tag, tests):
                went.add((a, i + 1))
        if any(i == len(alternatives[a]) for a, i in went):
            out.append(node)
        open_ = frozenset((a, i) for a, i in went if i < len(alternatives[a]))
        below = within | {(a, i) for a, i in open_ if not alternatives[a][i][0]}
        todo += [(ch, below, open_) for ch in reversed(node.children) if isinstance(ch, _Node)]
    return out


def page_text(html: str, alternatives: list | None = None) -> str:
    """Visible text of one page, of the chosen elements or all: text nodes parted by a space, every
    character reference decoded, lines and runs of spaces joined by one space."""
    tree = _TextTree()
    try:
        tree.feed(html)
        tree.close()
    except AssertionError:  # the parser's word for markup it gives up on: what was read counts
        pass
    if alternatives is None:
        text = " ".join(_strings(tree.root))
    else:
        text = " ".join(" ".join(t for t in map(str.strip, _strings(n)) if t) for n in _chosen(tree.root, alternatives))
    phrases = (p.strip() for line in text.splitlines() for p in line.split("  "))
    return " ".join(p for p in phrases if p)


def html_text(html, selector: str | None = None) -> Column:
    """Visible text of HTML by the parser of the cards; with ``selector`` (see
    :func:`parse_selector`) only of the elements it names, "" if there is none. Null stays null.
    ``functions.text.html_to_text`` is the plain form within the JVM."""
    alternatives = None if selector is None else parse_selector(selector)

    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        return s.map(lambda h: None if h is None else page_text(h, alternatives))
    return text(F.col(html) if isinstance(html, str) else html)


def parse_cards(html: str, selectors: dict) -> list[dict]:
    """Cards of one page; the first card selector with any match wins; a missing field
    reads "N/A" (link: empty)."""
    t = _Tree()
    try:
        t.feed(html or "")
        t.close()
    except Exception:  # noqa: BLE001 — malformed markup yields what was parsed
        pass
    cards = []
    for sel in selectors["card"]:
        cards = _select(t.root, sel)
        if cards:
            break
    out = []
    for c in cards:
        rec = {}
        for field in ("title", "company", "location", "description"):
            val = None
            for sel in selectors[field]:
                found = _select(c, sel)
                if found:
                    val = _text(found[0])
                    break
            rec[field] = "N/A" if val is None else val
        href = ""
        for sel in selectors["link"]:
            found = _select(c, sel)
            if found and "href" in found[0].attrs:
                href = found[0].attrs["href"] or ""
                break
        rec["href"] = href
        out.append(rec)
    return out


def html_cards(pages: DataFrame, selectors: dict | None = None, id_col: str = "page_id",
               html_col: str = "html") -> DataFrame:
    """One row per card: (page_id, card_pos, title, company, location, description, href)."""
    selectors = ARTICLE_SELECTORS if selectors is None else selectors

    def run(batches):
        for pdf in batches:
            rows = []
            for pid, html in zip(pdf[id_col], pdf[html_col]):
                for i, c in enumerate(parse_cards(html, selectors)):
                    rows.append((int(pid), i, c["title"], c["company"], c["location"], c["description"], c["href"]))
            yield pd.DataFrame(rows, columns=["page_id", "card_pos", "title", "company", "location", "description",
                                              "href"])
    return pages.select(F.col(id_col).cast("long").alias(id_col), html_col).mapInPandas(run, CARD_SCHEMA)


def card_offers(cards: DataFrame, country_code: str = "fr", base_url: str = "", domain_vocab=None) -> DataFrame:
    """Normalise cards into offers: location, salary, country, absolute url, id."""
    from talentgrid import vocab as V
    from talentgrid.functions.ids import offer_id
    from talentgrid.functions.text import extract_salary, normalize_location
    return cards.select(
        "page_id", "card_pos", "title", "company",
        normalize_location("location", country_code).alias("location"),
        "description",
        extract_salary("description").alias("salary"),
        F.lit(V.COUNTRY_NAMES.get(country_code, "Maroc")).alias("country"),
        F.when(F.col("href") != "", F.concat(F.lit(base_url), F.col("href"))).otherwise(F.lit("")).alias("url"),
    ).withColumn("id", offer_id("title", "company", "location", "description"))
