"""Text of pages: every character reference, selectors, odd markup."""

import random
import re

import pytest
from html.entities import html5

from talentgrid.operators import html_cards as HC


def test_every_named_and_numeric_reference(spark):
    """Against a plain replacement of each reference by the table of names."""
    names = [n for n in html5 if n.endswith(";")]
    rows = [(f"<p>a&{n}b</p>", "a" + html5[n] + "b") for n in names]
    rows += [(f"<p>a&#{c};&#x{c:x};b</p>", "a" + 2 * chr(c) + "b") for c in (33, 233, 8364, 128512, 19968)]
    rows += [("<p>a&qqqq;b &amp;lt; R&D &#128;</p>", "a&qqqq;b &lt; R&D €")]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(rows)], "i int, h string")
    got = {r.i: r.t for r in df.select("i", HC.html_text("h").alias("t")).collect()}

    def tidy(t):
        return " ".join(p for p in (p.strip() for ln in t.splitlines() for p in ln.split("  ")) if p)
    assert [got[i] for i in range(len(rows))] == [tidy(t) for _, t in rows]


PAGE = """<!DOCTYPE html><html><head><title>T &eacute;</title><style>.x{}</style><script>var a="<p>no</p>";</script></head>
<body><div id="main" class="job big"><h2>One</h2><p>first <b>bold</b>tail</p><ul><li>a<li>b</ul></div>
<div class="job"><p data-k="v">second<!-- hidden -->part 3 < 4</p></div><p>outside</p></body></html>"""


@pytest.mark.parametrize("selector,want", [
    (None, "T é One first bold tail a b second part 3 < 4 outside"),
    ("div.job", "One first bold tail a b second part 3 < 4"),
    ("#main p, title", "T é first bold tail"),
    (".job.big > p", "first bold tail"),
    ("body > p", "outside"),
    ("html > p", ""),
    ("[data-k]", "second part 3 < 4"),
    ("p[data-k='v']", "second part 3 < 4"),
    ("p[data-k=w]", ""),
    ("div *", "One first bold tail bold a b a b b second part 3 < 4"),
    ("script", ""),
])
def test_selectors(selector, want):
    got = HC.page_text(PAGE, None if selector is None else HC.parse_selector(selector))
    assert got == want


@pytest.mark.parametrize("selector", ["", "a,", "p:first-child", "a + b", "> "])
def test_other_selectors_are_refused(selector):
    with pytest.raises(ValueError):
        HC.parse_selector(selector)


def test_chosen_elements_against_paths():
    """Random trees: an element is chosen when the tags on its path match the selector's pattern."""
    rng = random.Random(5)
    for _ in range(60):
        parts, stack, paths, n = [], [], [], 0
        for _ in range(rng.randrange(1, 60)):
            if stack and rng.random() < 0.45:
                parts.append(f"</{stack.pop()}>")
            else:
                stack.append(rng.choice("abu"))
                paths.append("".join(f"/{t}" for t in stack))
                parts.append(f"<{stack[-1]} n={n}>")
                n += 1
        tree = HC._TextTree()
        tree.feed("".join(parts))
        tree.close()
        for selector, pattern in [("a b", r".*/a(/.)*/b$"), ("a > b u", r".*/a/b(/.)*/u$"), ("u > u > a", r".*/u/u/a$"),
                                  ("a b > u", r".*/a(/.)*/b/u$"), ("b, a a", r".*/b$|.*/a(/.)*/a$")]:
            got = [int(x.attrs["n"]) for x in HC._chosen(tree.root, HC.parse_selector(selector))]
            assert got == [i for i, p in enumerate(paths) if re.match(pattern, p)], (selector, parts)


def test_null_empty_deep_and_broken(spark):
    deep = "<div>" * 20_000 + "x" + "</p>" * 5
    df = spark.createDataFrame([(1, None), (2, ""), (3, deep), (4, "<p>a <b>b"), (5, "<![if x]><p>q")], "i int, h string")
    got = {r.i: (r.t, r.s) for r in df.select("i", HC.html_text("h").alias("t"), HC.html_text("h", "p").alias("s")).collect()}
    assert got[1] == (None, None) and got[2] == ("", "") and got[3] == ("x", "") and got[4] == ("a b", "a b")
    assert got[5][0].endswith("q")
