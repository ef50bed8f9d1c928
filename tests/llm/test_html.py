from __future__ import annotations

import itertools
import re
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from refload.llm import html as op
from tests.llm.conftest import SF


def plain_article(html: str) -> str:
    inner = re.search(r"<article>(.*?)</article>", html, re.DOTALL)[1]
    parts = re.split(r"</?(?:p|h1)>", inner)
    lines = (" ".join(unescape(re.sub(r"</?b>|<br>", lambda m: " " if m[0] == "<br>" else "", p)).split()) for p in parts)
    return "\n".join(x for x in lines if x)


def test_query(spark):
    from refload.llm.queries import QUERIES

    rows = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    got = {r.page_id: r for r in QUERIES["op2_mincut_text"](spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]].text == plain_article(r["html"])
        assert got[r["page_id"]].n_chars == len(got[r["page_id"]].text) and got[r["page_id"]].url == r["url"]


def test_minimum_cut_against_all_labellings():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        scores = rng.normal(scale=2, size=n).tolist()
        edges = [(i, j, float(rng.random() * 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(labels, scores=scores, edges=edges):
            overruled = sum(abs(s) for s, x in zip(scores, labels, strict=True) if (s > 0) != x)
            return overruled + sum(w for i, j, w in edges if labels[i] != labels[j])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(op.content_side(scores, edges)) - best) < 1e-6


PAGE = """<html><body class="has-sidebar"><header><a href=/>Home</a> Site name</header>
<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-banner"><p>We use cookies to make this site work well for you, and for many other reasons. Accept?</p></div>
<main><div class=content><h2>A title &amp; more</h2>
<p>First  paragraph with <a href=x>a link</a> and
a line break, long enough to be told from a menu.
<p>Second &lt;paragraph&gt;&nbsp;here.<br>It goes on, <i>leaning</i>.
<pre>x =  1</pre><script>if (a < b) document.write("<p>no</p>")</script>
<aside>Something on the side that nobody wants to read in the text at all.</aside>
<form action=/s><label>Your mail</label><input name=m><button>Send</button></form></div>
<section id="comments"><p>Great article, thanks a lot for writing this up, I have learned very much from it!</p></section></main>
<div class="sidebarWidget"><p>Other stories that you may like to read when you are done with this one here.</p></div>
<footer>&copy; 2024 Site. All rights reserved.</footer><div style="display: none">hidden words</div></body></html>"""


def test_page_of_another_make():
    text, kept, total = op.main_text(PAGE)
    assert text.split("\n") == [
        "A title & more",
        "First paragraph with a link and a line break, long enough to be told from a menu.",
        "Second <paragraph> here. It goes on, leaning.",
        "x = 1",
    ]
    assert kept == 4 < total


def test_plain_page_without_hints():
    long = "This is a sentence of a story that goes on for quite a while, as stories do, and then ends with a full stop. " * 3
    html = f"<div><a href=1>a</a> <a href=2>b</a></div><div><p>{long}</p><p>{long}</p></div><div><a href=3>c d</a></div>"
    assert op.main_text(html)[0] == "\n".join([long.strip()] * 2)


def test_odd_pages(spark):
    assert op.main_text("plain text, no markup, but words that make a sentence of a fair length, all in all.")[0]
    for odd in ("", None, "<", "<p", "<p title='x", "<!-- never ends", "<script>var a = 1", "</p></div>", "<a <b <c", "&#0;", "<p>" * 3000):
        assert op.main_text(odd)[0] in ("", "�", "<", "�")
    deep = "<div>" * 2000 + "<article><p>" + "word " * 50 + "</p></article>"
    assert op.main_text(deep)[0] == ("word " * 50).strip()
    many = "<article>" + "".join(f"<p>Paragraph {i} has some words to say, and says them.</p>" for i in range(5000)) + "</article>"
    assert op.main_text(many)[0].count("\n") == 4999
    table = pa.table({"page_id": [1, 1, None], "url": [None, "u", "u"], "html": [None, "", PAGE], "text": [1, 2, 3], "n_chars": [0, 0, 0]})
    got = op.extract_pages(spark.createDataFrame(table)).collect()
    assert sorted(r.n_chars for r in got)[:2] == [0, 0] and len(got) == 3 and max(r.n_chars for r in got) > 100
    assert op.extract_pages(spark.createDataFrame(table.slice(0, 0))).collect() == []


def test_wrappers_do_not_speak_for_the_article():
    body = "Paragraph of the article with quite some words to say, and it says them to the end. " * 3
    menu = '<nav><a href=/a>One</a></nav><div class="site-footer"><p>Words at the foot of every page, which are not wanted here.</p></div>'
    article = f"<article><h1>Title</h1><p>{body}</p></article>"
    want = f"Title\n{body.strip()}"
    wraps = ["class='layout has-sidebar'", "class=with-comments", "class=search-result", "class=ad-free", "class=no-footer", 'id="legal-blog"']
    for wrap in wraps:
        assert op.main_text(f"<body>{menu}<div {wrap}>{article}</div></body>")[0] == want
        assert op.main_text(f"<body>{menu}<div {wrap}><p>{body}</p></div></body>")[0] == body.strip()
    assert op.main_text(f"<body>{menu}<div class=sidebar>{article}</div></body>")[0] == want
    bare = f"{menu}<h1>Title</h1><p>{body}</p>"
    assert op.main_text(f"<body><form id=f action=/x>{bare}</form></body>")[0] == op.main_text(f"<body>{bare}</body>")[0] != ""
    assert op.main_text(f"<body><form>{article}</form></body>")[0] == want
    for name in ("sidebar", "post-comments", "footer-links", "cookieBanner", "related-posts"):
        assert op.main_text(f"<body>{article}<div class='{name}'><p>{body}</p></div></body>")[0] == want
    cards = f"<article><p>{body}</p></article>" * 3
    assert op.main_text(f"<body><main><p>{body}</p></main><div class=related>{cards}</div></body>")[0] == body.strip()


def test_stray_quotes_and_embedded_text():
    body = "Paragraph of the article with quite some words to say, and it says them to the end. " * 3
    page = f"<article><p title=it's>{body}</p><p>{body}It's <math><mi>x</mi></math> and <object>this</object> too.</p></article>"
    assert op.main_text(page)[0] == f"{body.strip()}\n{body}It's x and this too."
    assert op.main_text(f"<article><p data-a='1 > 0' data-b=\"a>b\">{body}</p></article>")[0] == body.strip()


def test_pages_that_are_not_empty():
    """A page inside one form of plain divs, and pages of short unmarked paragraphs, have their text; forms stay out."""
    body = "Paragraph of the article with quite some words to say, and it says them to the end. " * 5
    want = f"{body.strip()}\n{body.strip()}"
    hidden = "<input type=hidden name=__STATE value=x>"
    page = f"<body><form action=/page>{hidden}<div class=menu><a href=/a>One</a></div><div><div>{body}</div><div>{body}</div></div></form></body>"
    assert op.main_text(page)[0] == want
    assert op.main_text("<div><p>One.</p><p>Two words here.</p></div>")[0] == "One.\nTwo words here."
    assert op.main_text("<nav><a href=/a>One</a></nav><div><p>One.</p></div><footer>Foot</footer>")[0] == "One."
    assert op.main_text("<nav><a href=/a>One</a> two</nav><div><a href=/b>Three</a></div><footer>Foot</footer>")[0] == ""
    fields = "".join(f"<label>Your field {i} is required here</label><input name=f{i}>" for i in range(20))
    note = "<p>Your address will not be published. Fields that are required are marked, so please fill them in.</p>"
    choices = "<select>" + "<option>Some country</option>" * 200 + "</select>"
    for form in (f"<form>{note}{fields}</form>", f"<form>{choices}<button>Send</button></form>", f"<form>{note}<textarea></textarea></form>"):
        assert op.main_text(f"<body><article><p>{body}</p><p>{body}</p></article>{form}</body>")[0] == want
        assert op.main_text(f"<body>{form}</body>")[0] == ""
