"""Main text: parsing, names, and the entropy of a site's branches against a plain computation."""

import math
import random
from collections import Counter, defaultdict

import pytest

from millrace.llm import styletree as st

ARTICLE = (
    '<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">'
    "<header><h2>Site</h2></header><nav><ul><li><a href=/x>Menu</a></ul></nav><!-- <p>no</p> --><div class='cookie-notice'>We use cookies</div>"
    "<article><header><h1>Ti&amp;tle</h1></header><p><b>One\n two.<br>three <p>f&eacute;our&nbsp;five</p><form>Sign <input>up</form>"
    "<div id='ad-7'>Buy</div><script>x()</script><ul><li>six<li>se<i>ve</i>n</ul><section class=\"comments\"><p>First!</section></article>"
    "<aside>More</aside><footer>&copy; us</footer>"
)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        (ARTICLE, "Ti&tle One two. three féour five six seven"),
        ("plain &lt;words&gt; &am", "plain <words> &am"),
        ("<p>a<p>b</p>c<div>d</div>e", "a b c d e"),
        ("<p>1 < 2 <b>x</p><p title='a>b'>y<p", "1 < 2 x y"),
        ("<main><p>in</main><p>out", "in"),
        ("<table><tr><td>a<td>b<tr><th>c</table>", "a b c"),
        ("<article><div class=share>s</div></article><p>fallback", "fallback"),
        ("<p>" + "w " * 100_000, ("w " * 100_000).strip()),
        ("<div>" * 3000 + "deep", "deep"),
        ("<script>never closed <p>x", ""),
    ],
)
def test_parsing(html, text):
    assert st._parsed(html).text() == text


def _site(n, rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    pages = []
    for i in range(n):
        body = "".join(f"<p>{word()} {word()} {word()}</p>" for _ in range(rng.randint(1, 6)))
        pages.append((i, f"http://user@Site.org:80/{i}", f'<div class="top"><p>Welcome to our site</p></div><div class="text">{body}</div><div class="low"><p>All rights kept</p></div>'))
    return pages


def test_branches_alike_on_all_pages_go(spark):
    pages = _site(30, random.Random(1))
    pages += [(100 + i, f"http://small.org/{i}", "<div class=top>Welcome</div><div class=text>body</div>") for i in range(3)]  # too few pages to judge
    pages += [(200, "http://site.org/x", None), (None, None, "<p>no url"), (0, pages[0][1], pages[0][2])]
    df = spark.createDataFrame([(*p, "t", 1) for p in pages], "page_id long, url string, html string, text string, node int")
    got = {r.page_id: r for r in st.main_text(df).collect()}
    assert len(st.main_text(df).collect()) == len(pages)
    for i, url, html in pages[:30]:
        want = " ".join(html.split('<div class="text">')[1].split("</div>")[0].replace("<p>", "").replace("</p>", " ").split())
        assert (got[i].text, got[i].n_chars, got[i].url) == (want, len(want), url)
    assert got[100].text == "Welcome body" and got[200].text == "" and got[None].text == "no url"
    assert st.main_text(df.where("false")).count() == 0


def test_copies_of_one_page_keep_their_text(spark):
    df = spark.createDataFrame([(i, "http://a.org/", f"<div><p>same text</p><i>{i % 2}</i></div>") for i in range(60)], "page_id long, url string, html string")
    assert {r.text for r in st.main_text(df).collect()} == {"same text 0", "same text 1"}


def test_importance_equals_a_plain_computation(spark):
    rng = random.Random(3)
    nodes = []
    for page in range(40):
        for node, chain in ((1, [1]), (2, [1, 2]), (3, [1, 3]), (4, [1, 3, 4])):
            if rng.random() < 0.9:
                nodes.append((page, "h", node, chain, 0, rng.randint(0, 2) * (node > 1), sorted(set(rng.choices(range(node * 3), k=node - 1)))))
    got = {r.node: r for r in st.node_importance(spark.createDataFrame(nodes, st._NODE_SCHEMA)).collect()}
    by = defaultdict(list)
    for r in nodes:
        by[r[2]].append(r)
    content, texts = {}, {}
    for n, rows in by.items():
        c = Counter(t for r in rows for t in r[6])
        texts[n] = sum(c.values())
        content[n] = sum(v * (1 - math.log(v) / math.log(len(rows))) for v in c.values())
    for n, rows in by.items():
        m, c = len(rows), Counter(r[5] for r in rows)
        shape = -sum(v / m * math.log(v / m, m) for v in c.values())
        inside = [k for k, r in by.items() if n in r[0][3]]
        mean = sum(content[k] for k in inside) / max(1, sum(texts[k] for k in inside))
        assert got[n].pages == m and got[n].importance == pytest.approx(0.1 * shape + 0.9 * mean)


def _word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(6))


def test_the_tree_judges_inside_an_article_and_beside_it(spark):
    """A share box with a class that says nothing goes, a teaser article doesn't silence the page, and small hosts keep all."""
    rng = random.Random(6)
    words = lambda n: " ".join(_word(rng) for _ in range(n))
    rows = []
    for i in range(20):
        rows.append((i, f"http://box.org/{i}", body := words(30), f"<article><div class=x1><p>Pass it on</p></div><div class=x2><p>{body}</p></div></article>"))
    for i in range(20, 40):
        rows.append((i, f"http://teaser.org/{i}", f"{(a := words(3))} {(b := words(60))}", f"<article>{a}</article><div class=x3>{b}</div><div class=x4>the same words</div>"))
    rows.append((40, "http://one.org/", "Pass it on body", "<article><div class=x1><p>Pass it on</p></div><div class=x2><p>body</p></div></article>"))
    df = spark.createDataFrame([(i, u, h) for i, u, _, h in rows], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in st.main_text(df).collect()} == {i: want for i, _, want, _ in rows}
    assert st._parsed(rows[0][3]).text().startswith("Pass it on")  # by names alone it stays


def test_depth_is_no_burden():
    deep = "<div>" * 100_000 + "<p>text</p>"
    page = st._parsed(deep)
    assert page.text() == "text"
    assert max(len(n.chain()) for n in page.shapes if n.depth <= st.DEPTH) == st.DEPTH
    assert st._parsed("<p><button>" + "<div>" * 50_000 + "x" + "</i></b>" * 1000).text() == ""


@pytest.mark.parametrize(
    "page, text",
    [
        ('<div class="layout with-sidebar"><article>All of it</article><div class="left-sidebar">menu</div></div>', "All of it"),
        ('<article class="post has-comments"><p>All of it</p><div class="comment-list">first!</div></article>', "All of it"),
        ('<main id="search-main"><p>All of it</p></main>', "All of it"),
        ('<article>All <section id="related-work">of it</section><div class="related posts">others</div></article>', "All of it"),
        ('<article>All <div class="form-of-government">of it</div><div class="ad">buy</div><div class="adBox">buy</div></article>', "All of it"),
        ('<article><div class="article-header">All</div> of it</article><div class="site-header">name</div>', "All of it"),
    ],
)
def test_words_in_names_of_wrappers_and_sections(page, text):
    """A word of chrome within a longer name says nothing; names of chrome alone still do."""
    assert st.Page(f"<html><body>{page}</body></html>", st.Trie()).text() == text
