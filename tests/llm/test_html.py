import itertools
import random

import pytest

from tidemark.llm.html_extract import blocks_of, extract, graph, label, log_odds, main_text, minimum_cut

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class="no-sidebar-comments">
<header><p>Site of many things, welcome.</p></header><nav><ul><li><a href="/">Home</a><li><a href="/b">Blog</a></ul></nav>
<div id="cookie-notice"><p>We use cookies to make this page better for you.</p></div>
<article><header><h1>A title</h1><p>by me</p></header><p><b>First &amp; foremost.<br>Second   line<p>Next &lt;p&gt; with <a href=x>a link</a>, more.
<div class="ad banner"><p>Buy this now, it is very cheap and good for all of you.</p></div><ul><li>one item</li><li>two</li></ul>
<section id="comments"><p>I read this and liked it very much, thanks for the text.</p></section></article>
<aside><p>Related stories that you may like to read now.</p></aside><form><p>Your mail please.</p></form><footer>&copy; us</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE) == "A title\n\nFirst & foremost. Second line\n\nNext <p> with a link, more.\n\none item\n\ntwo"


P = "The river runs through the old town and it has done so for as long as anyone can remember."
Q = [P.replace("river", w) for w in ("boat", "cat", "dog", "car")]
COMMENTS = "".join(f"<div class=comment><p>{q}</p></div>" for q in Q)
#: Pages of several builds, and the text that a reader would call the article.
GOLD = {
    "title in an entry header": (
        f"<body><div class='site-header'><a href=/>Home</a></div><div class='post'><div class='entry-header'><h1>The river</h1><span class=byline>by Ann</span></div>"
        f"<div class='entry-content'><p>{P}</p><p>{P}</p></div></div><div id=footer>(c) us</div>",
        ["The river", P, P],
    ),
    "a class that tells of a sidebar": (f"<div class='post-body with-sidebar'><p>{P}</p><p>{P}</p></div><div class=sidebar><p>Read our other stories about towns today.</p></div>", [P, P]),
    "short paragraphs": ("<nav><a href=/>Home</a></nav><article><h1>Hi</h1><p>Yes.</p><p>No</p></article><footer>x</footer>", ["Hi", "Yes.", "No"]),
    "more comments than article": (f"<article><h1>On rivers</h1><p>{P}</p><div class='comments'>{COMMENTS}</div></article>", ["On rivers", P]),
    "comments outside": (f"<main><h1>On rivers</h1><p>{P}</p></main><section id='comments'>{COMMENTS}</section>", ["On rivers", P]),
    "comments that are articles": (
        f"<main><article class='post comments-open'><h1>On rivers</h1><p>{P}</p></article><div class='comments'>" + "".join(f"<article class='comment' id='comment-{k}'><p>{q}</p></article>" for k, q in enumerate(Q)) + "</div></main>",
        ["On rivers", P],
    ),
    "hardly anything but comments": (f"<h1>On rivers</h1><p>{P}</p><div id='comments'>{COMMENTS * 4}</div>", ["On rivers", P]),
    "a form around the page": (f"<form id=all><div id=main><h2>Title here</h2><p>{P}</p><p>{P}</p></div><div class='nav-menu'><ul><li><a href=a>Aa</a><li><a href=b>Bb</a></ul></div></form>", ["Title here", P, P]),
    "an advert and an aside within": (f"<article><h1>T one</h1><p>{P}</p><div class='ad'>{Q[0]}</div><aside><p>{Q[1]}</p></aside><p>End.</p></article>", ["T one", P, "End."]),
    "a list of links within": ("<article><h1>Links</h1><p>See these.</p><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li><li><a href=c>Three words here</a></li></ul></article>", ["Links", "See these.", "One", "Two", "Three words here"]),
    "nothing but a sidebar": (f"<div class='sidebar'><p>{P}</p><p>{P}</p></div>", [P, P]),
    "names of what is not there": (f"<body class='no-ads'><div class='content ad-free'><p>{P}</p></div>", [P]),
    "only divs": (
        f"<div id=top><ul class=menu><li><a href=/>A</a><li><a href=/b>B</a></ul></div><div id=wrap><div id=content><h2>Head</h2><div>{P}</div><div>Short one.</div><div>{P}</div></div>"
        f"<div id=right><div class=widget><h3>Latest</h3><ul><li><a href=q>{P}</a></li></ul></div></div></div>",
        ["Head", P, "Short one.", P],
    ),
    "a notice, a table": (
        f"<div id=cookie-consent><p>We use cookies to make this site better for you and to show you adverts.</p></div><header><h1>Site</h1></header>"
        f"<main><article><header><h1>True title</h1><p class=meta>May 1</p></header><p>{P}</p><table><tr><td>a</td><td>b 2</td></tr></table></article></main>",
        ["True title", P, "a", "b 2"],
    ),
}


@pytest.mark.parametrize("name", GOLD)
def test_gold_text(name):
    html, text = GOLD[name]
    assert main_text(html) == "\n\n".join(text)


def test_the_cut_decides():
    """Labels are not the signs of the blocks' log-odds, and cost least among all labellings of the graph."""
    changed = 0
    for html, _ in GOLD.values():
        blocks, elements = blocks_of(html)
        keep = label(blocks, elements)
        changed += sum((log_odds(b) > 0) != k for b, k in zip(blocks, keep, strict=True))
        odds, edges = graph(blocks, elements)
        if len(odds) > 16:
            continue

        def cost(x, odds=odds, edges=edges):
            return sum(max(o, 0) if not k else max(-o, 0) for o, k in zip(odds, x, strict=True)) + sum(w for a, b, w in edges if x[a] != x[b])

        best = min((cost(x), x[: len(blocks)]) for x in itertools.product([False, True], repeat=len(odds)))
        own = min(cost([*keep, *x]) for x in itertools.product([False, True], repeat=len(odds) - len(blocks)))
        assert own <= best[0] + 0.01 * len(odds)
    assert changed >= 15


def test_defined_cases(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 1), (2, "v", "", 1), (3, "w", "<p", 1), (4, "x", "<article><p>" + "long words here. " * 20_000, 1)], "page_id long, url string, html string, text int")
    rows = sorted(extract(pages).collect(), key=str)
    assert len(rows) == 6 and all(r["n_chars"] == len(r["text"]) for r in rows)
    by = {r["page_id"]: r["text"] for r in rows}
    assert by[None] == by[2] == by[3] == "" and by[4] == ("long words here. " * 20_000).strip()
    assert extract(pages.limit(0)).count() == 0


def test_many_blocks_need_no_recursion():
    text = main_text("<article>" + "<p>One more paragraph of this text.</p>" * 5000 + "</article>")
    assert text.count("paragraph") == 5000
    assert main_text("<div>" * 5000 + "<p>Deep inside there is a paragraph with some words in it.</p>").startswith("Deep")


def test_minimum_cut_against_all_labellings():
    r = random.Random(1)
    for _ in range(60):
        n = r.randint(1, 7)
        costs = [(r.randint(0, 9), r.randint(0, 9)) for _ in range(n)]
        edges = [(a, b, r.randint(0, 5)) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]

        def value(keep, costs=costs, edges=edges):
            return sum(d if k else c for k, (c, d) in zip(keep, costs, strict=True)) + sum(c for a, b, c in edges if keep[a] != keep[b])

        assert value(minimum_cut(n, costs, edges)) == min(value(k) for k in itertools.product([True, False], repeat=n))
