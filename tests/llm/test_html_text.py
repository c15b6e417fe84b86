"""Main text of planted pages of several layouts, whole and cut short, and the parts of wrapper inference."""

import html
import random

import pytest

from recordrank.llm import html_text
from recordrank.llm.html_text import fold, leaves, locate, main_text, merge, parse, place, read, without_raw, write

WORDS = "river stone über lantern señor quiet harbour & <tag> meadow winter copper naïve voyage".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def esc(text):
    return html.escape(text).replace("ü", "&uuml;")


def links(rng, n=5):
    return "<ul>" + "".join(f'<li><a href="/{i}">{esc(prose(rng, 1))}</a></li>' for i in range(n)) + "</ul>"


def layouts(rng, title, paragraphs):
    """Pages of one article in five layouts."""
    ps = [esc(p) for p in paragraphs]
    head = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p><article>';</script></head>"
    yield f"{head}<body><nav>{links(rng)}</nav><div class=ad>{prose(rng, 4)}</div><article><h1>{esc(title)}</h1><p><b>{'<p>'.join(ps)}</article><footer>&copy; us</footer></body></html>"
    yield (
        f'{head}<body class="has-sidebar"><header><h1>Site</h1>{links(rng)}</header><main><article class="post"><header><h1>{esc(title)}</h1></header>' + "".join(f"<p>{p.replace(' ', '<!-- x --> <em>', 1)}</em></p>" for p in ps) + f'<div class="share-buttons">Share this</div></article>'
        f'<section id="comments"><h2>Comments</h2><article class="comment"><p>{esc(prose(rng, 30))}</p></article><article class="comment"><p>{esc(prose(rng, 3))}</p></article></section></main><aside class="sidebar"><p>{prose(rng, 20)}</p></aside><footer>x</footer></body></html>'
    )
    yield (
        f'{head}<body><div id="cookie-notice">We use cookies. <button>OK</button></div><div class="top-menu">{links(rng)}</div><div id="wrap"><div class="post-content"><h1>{esc(title)}</h1>' + "".join(f"<p>{p}</p>" + ('<div class="advert">Buy</div>' if i % 2 else "") for i, p in enumerate(ps)) + f"<form><label>Mail</label><input><textarea>type here</textarea></form></div>"
        f'<div class="sidebar"><h3>More</h3><p>{prose(rng, 15)}</p></div></div><div class="site-footer">&copy; all rights</div></body></html>'
    )
    yield f"{head}<body><table><tr><td class=menu>{links(rng)}<td class=content><h2>{esc(title)}<div>{'</div><div>'.join(ps)}</div></table></body></html>".replace(f"<h2>{esc(title)}<div>", f"<h2>{esc(title)}</h2><div>")
    yield f"{head}<body><div>{links(rng)}</div><div><h1>{esc(title)}</h1>" + "".join(f"<p>{p}</p>" for p in ps) + "</div><div>Made with care by the same people</div></body></html>"


def squash(text):
    return " ".join(text.split())


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(60):
        title, paragraphs = f"{i} {prose(rng, 4)}", [prose(rng, rng.randint(5, 40)) + "." for _ in range(1 + i % 5)]
        for k, page in enumerate(layouts(rng, title, paragraphs)):
            rows.append((len(rows), f"https://host{k}.example/{i}", page))
            want[len(rows) - 1] = "\n".join(map(squash, [title, *paragraphs]))
    return rows, want


@pytest.mark.parametrize("group", [256, 2])
def test_planted_articles(spark, monkeypatch, planted, group):
    monkeypatch.setattr(html_text, "GROUP", group)
    rows, want = planted
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, slots int").repartition(3)
    got = main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {r.page_id: r for r in got.collect()}
    assert len(found) == len(rows)
    wrong = [i for i in want if found[i].text != want[i]]
    assert not wrong, (len(wrong), found[wrong[0]].text, want[wrong[0]])
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_edges(spark):
    page = "<body><nav>menu</nav><article><p>One &amp; two&nbsp;three<br>four</p><p>cut &am"
    rows = [(1, None, None), (2, "not a url", ""), (3, "http://a.example/x", page), (3, "http://a.example/x", page), (None, "http://a.example/y", "plain words"), (5, "http://b.example", "<script>only()"), (6, "http://b.example", "<p>a < b</p><p>" + "word " * 200000 + "</p>"), (7, "http://B.example/", "<p>x</p><!-- <p>no</p> "), (8, "http://[bad", "<p>y</p><div ")]
    got = sorted(((r.page_id, r.text) for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    long = "a < b\n" + ("word " * 200000).strip()
    assert got == sorted([(1, ""), (2, ""), (3, "One & two three four\ncut &am"), (3, "One & two three four\ncut &am"), (None, "plain words"), (5, ""), (6, long), (7, "x"), (8, "y")], key=str)
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def shape(page):
    items, _ = parse(without_raw(page))
    return read(write(items))


def test_wrapper_takes_in_all_structures():
    a, b, c = (shape(f"<body><div>{x}</div></body>") for x in ("<h1>t</h1><p>a</p>", "<p>a</p><p>b</p><figure>f</figure><p>c</p>", "<h1>t</h1><p>a</p><figure>f</figure><p>b</p><figure>f</figure><table><tr><td>x</table>"))
    whole = merge(merge(shape("<body></body>") + a, b), c)
    whole = read(write(whole))
    names = [labels for _, labels in leaves(whole)]
    for s in (a, b, c):
        found = {}
        locate(s, whole, found)
        for k, (_, labels) in enumerate(leaves(s)):
            assert names[found[k]] == labels
    assert [x.label for x in fold(shape("<dl><dt>a<dd>b<dt>a<dd>b<dt>a<dd>b</dl>")[0].kids)] == ["(dt dd)"]


def test_places():
    assert place(("html", "body", "article", "h1")) == 3
    assert place(("html", "body", "article", "header", "h1")) == 3
    assert place(("html", "body", "article", "header", "p")) == -1
    assert place(("html", "body", "header", "h1")) == -1
    assert place(("html", "body.has-sidebar", "div.content-sidebar-wrap", "main", "p")) == 2
    assert place(("html", "body", "div.entry-content", "p")) == 1
    assert place(("html", "body", "div.comments", "article.comment", "p")) == -1
    assert place(("html", "body", "div", "p")) == 0


def test_odd_markup():
    texts = lambda page: [t for t, _ in parse(without_raw(page))[1]]
    assert texts('<p title="5" tall">one</p><p title=\'a>b\'>two</p><a href="x>three</a>') == ["one", "two", "three"]
    deep = "<div>" * 5000 + "<article><p>in</p></article>" + "</div>" * 5000 + "<p>after</p>"
    items, blocks = parse(deep)
    assert [t for t, _ in blocks] == ["in", "after"] and read(write(items))
    assert merge(read(write(items)), read(write(items)))
    assert texts("<p>a<p>b<ul><li>c<li>d</ul>e<dl><dt>f<dd>g</dl><table><tr><td>h<td>i</table>") == list("abcdefghi")
    assert texts("<style>a{}</style><title>t</title>x<script>'</p>'") == ["x"]
    slow = "<a " + "x='y' " * 20000
    assert texts(slow + "z") == [] and texts("<p a='" * 5000) == []
