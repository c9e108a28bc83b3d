"""Main text by density: pages without telling names, several articles, and every node against brute force."""

import math
import random
import re

import duckdb
from mosaiq.llm import html_text

LONG = "A paragraph that goes on for long enough, with commas, to be a text of its own, and then some."


def everything(html):
    """The text of the whole body, nothing chosen."""
    _, nodes = html_text.parse(html)
    return " ".join(html_text.blocks(html_text.measure(nodes)))


def bare(html):
    """The same page with plain divs for all that tells its parts apart."""
    return re.sub(r"<(/?)(?:nav|article|footer|aside|section)>", r"<\1div>", html).replace('<div class="ad">', "<div>")


def test_density_decides():
    rows = duckdb.sql("select html from '/root/testdata/sf0.1/pages.parquet'").fetchall()
    right = 0
    for (html,) in rows:
        article = html[html.index("<article>") : html.index("</article>") + 10]
        want = everything(f"<body>{bare(article)}</body>")
        assert html_text.extract(html) == want != everything(html)
        right += html_text.extract(bare(html)) == want
    assert right > 0.94 * len(rows)  # the rest have less text in the article than beside it


def test_pages_without_names():
    menu = '<div><a href="/">Home</a> <a href="/w">World</a> <a href="/s">Sport</a></div>'
    text = f"<div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p><a href=x>{LONG}</a></p><p>Short.</p></div>"
    want = f"Title {LONG} {LONG} {LONG} Short."
    for page in (f"{menu}{text}<div>A line below</div>", f"<div>{menu}{text}<div>A line below</div></div>", f"<div>{menu}</div><div><div>{text}</div></div><div><div>A line below</div></div>"):
        assert html_text.extract(f"<body>{page}</body>") == want
    assert html_text.extract(f"<body>{menu}<div><h1>T</h1><div><p>{LONG}</p><p>{LONG}</p></div><p>{LONG}</p></div><div>below</div></body>") == f"T {LONG} {LONG} {LONG}"


def test_several_articles():
    one, two = f"<article><h2>One</h2><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article>", f"<article><h2>Two</h2><p>{LONG}</p></article>"
    want = f"One {LONG} {LONG} {LONG} Two {LONG}"
    assert html_text.extract(f"<body><nav>n</nav>{one}{two}<footer>f</footer></body>") == want
    assert html_text.extract(f"<body><div>{one}<div class=ad>Buy this, buy.</div>{two}</div><aside><p>{LONG}</p></aside></body>") == want
    plain = f"<div><h2>One</h2><p>{LONG}</p><p>{LONG}</p></div><div><h2>Two</h2><p>{LONG}</p><p>{LONG}</p></div>"
    assert html_text.extract(f"<body>{plain}<div>below</div></body>") == f"One {LONG} {LONG} Two {LONG} {LONG}"


def brute(node, body):
    """A node's density by walking its whole subtree."""

    def walk(n, in_link=False):
        c = t = lc = lt = 0
        for x in n.items:
            if isinstance(x, str):
                k = sum(not ch.isspace() for ch in x)
                c, lc = c + k, lc + k * in_link
            elif not x.dropped:
                a, b, d, e = walk(x, in_link or x.tag == "a")
                c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e + (x.tag == "a")
        return c, t, lc, lt

    c, t, lc, lt = walk(node, node.tag == "a")
    lt += node.tag == "a"
    bc, _, blc, _ = walk(body)
    if not c:
        return 0.0
    base = math.log(c / max(1, c - lc) * lc + blc / bc * c + math.e)
    rare = math.log(c / (lc or 1) * (t or 1) / (lt or 1))
    return c / (t or 1) * max(0.0, rare / math.log(base + 1e-9) if base > 1 else math.log(c / (lc or 1) * (t or 1) / (lt or 1) + 1))


def test_every_nodes_density_and_sum():
    rng = random.Random(8)
    pages = [r[0] for r in duckdb.sql("select html from '/root/testdata/sf0.001/pages.parquet'").fetchall()]
    for _ in range(200):
        tags = ["div", "p", "ul", "li", "a", "b", "section", "h2", "span", "script", "br"]
        pages.append("".join(rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", "some words ", "x", " &amp; "]) for _ in range(60)))
    for html in pages:
        _, nodes = html_text.parse(html)
        body = html_text.measure(nodes)
        for n in nodes:
            if n.dropped or any(x.dropped for x in html_text.ancestor_path(n)):
                continue
            nested = n.tag == "a" and any(x.tag == "a" for x in html_text.ancestor_path(n)) or any(x.tag == "a" for m in nodes for x in html_text.ancestor_path(m) if m.tag == "a")
            if nested:  # links in links are no valid markup
                continue
            assert math.isclose(n.density, brute(n, body), rel_tol=1e-9, abs_tol=1e-9)
            below = sum(x.density for x in n.items if isinstance(x, html_text.Node) and x.tag not in html_text.INLINE)
            assert math.isclose(n.sum, below or n.density, rel_tol=1e-9, abs_tol=1e-9)


def test_the_article_stays_whole():
    six = "".join(f"<p>{LONG} {i}</p>" for i in range(6))
    want = " ".join(f"{LONG} {i}" for i in range(6))
    for name in ("content ad-free", "main comment-open", "comment"):
        assert html_text.extract(f'<body><div class="{name}">{six}</div><div>small thing here.</div></body>') == want
    assert html_text.extract(f"<body><article><h1>T</h1><p>{LONG}</p></article><div class=comments>{six}</div></body>") == f"T {LONG}"
    assert html_text.extract(f"<body><div><h1>T</h1><p>{LONG}</p></div><div class=comments>{six}</div></body>") == f"T {LONG}"
    assert html_text.extract(f"<body><main><p>Lead one short.</p><div>{six}</div><p>Closing.</p></main></body>") == f"Lead one short. {want} Closing."
    assert html_text.extract(f"<body><main><div>{six}</div><div><p>{LONG}</p><p>{LONG}</p><p>Last.</p></div></main></body>") == f"{want} {LONG} {LONG} Last."
    people = "<h2>People</h2><ul><li><a href=1>Ann Lee</a></li><li><a href=2>Bob Day</a></li><li><a href=3>Cy Roe</a></li></ul>"
    assert html_text.extract(f"<body><article>{six}{people}</article></body>") == f"{want} People Ann Lee Bob Day Cy Roe"
    odd = "<p>We have <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <button>this</button> here.</p>"
    assert html_text.extract(f"<body><article>{six}{odd}<button>Send</button><p><button>Share</button></p></article></body>") == f"{want} We have x=1 and this here."


def test_deep_pages():
    """Many nested elements, open or closed, with headings and stray ends; no time is asserted but the least of growth."""
    n = 20000
    for page in ("<div>" * n + f"<p>{LONG}</p>" + "</div>" * n, "<div>" * n + f"<p>{LONG}</p>" + "</b></li><li>" * n, f"<p>{LONG}</p>" + "<div id=related><div>" * n + "<h2>T</h2>"):
        assert LONG in html_text.extract(page)
