"""Main text of pages: known pages, broken markup, and templates found by their style."""

import math
import random
from collections import Counter

import pytest

from lexforge.llm import site_style

ROW = "page_id long, url string, html string"


def page(body, head=""):
    return f'<!DOCTYPE html><html lang="en"><head><title>T</title>{head}<style>p{{}}</style></head><body>{body}</body></html>'


def texts(spark, rows, schema=ROW):
    df = spark.createDataFrame(rows, schema)
    return {r.page_id: r.text for r in site_style.extract(df).collect()}


def test_parts_of_a_page(spark):
    body = (
        '<header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><div class="cookie-notice">Cookies</div>'
        '<article><h1>Head &amp; more</h1><p>One <b>bo</b>ld\n  line<br>next &lt;3 &#233;&nbsp;x</p><script>var a = "</p>";</script><!-- c <p>no</p> --><ul><li>a<li>b</ul>'
        '<form><input value="x">Send</form><aside>Side</aside><table><tr><td>1<td>2</table><div class="comments"><p>Reader</p></div></article>'
        '<section id="comments"><article class="comment">Me too</article></section><footer>&copy; F</footer>'
    )
    want = "Head & more One bold line next <3 é x a b 1 2"
    rows = [(1, "http://h.example/1", page(body)), (2, None, page(body.replace("article", "main"))), (3, "x", None), (4, "http://h.example", ""), (5, "http://h.example/5", "<nav>only</nav>"), (1, "http://h.example/1", page(body))]
    df = spark.createDataFrame(rows, ROW)
    out = site_style.extract(df).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in out) == [(1, want, len(want)), (1, want, len(want)), (2, want, len(want)), (3, "", 0), (4, "", 0), (5, "", 0)]


def test_broken_markup(spark):
    rows = [(1, "u", '<article><p>cut off &am'), (2, "u", "<article><p>a <b>bold<p>b</article><p>out"), (3, "u", "plain < text > here"), (4, "u", '<article><p title="a > b">x</p><p'), (5, "u", "<article><p>" + "long word " * 20_000)]
    got = texts(spark, rows)
    assert got[1] == "cut off &am" and got[2] == "a bold b" and got[3] == "plain < text > here" and got[4] == "x" and len(got[5]) == 199_999


def test_templates_without_names(spark):
    """Nothing says what a branch is for: what is alike on all pages of a host goes."""
    body = '<div class="x1"><div>Our great site</div></div><div class="x2"><p>{0} unique story number {0}</p></div><div class="x3"><p>Always the same end</p></div>'
    rows = [(i, f"https://one.example/{i}", page(body.format(i))) for i in range(20)]
    rows += [(100 + i, f"https://two.example/{i}", page(body.format(i))) for i in range(2)]
    got = texts(spark, rows)
    assert all(got[i] == f"{i} unique story number {i}" for i in range(20))
    assert all("Our great site" in got[100 + i] for i in range(2))  # too few pages to tell


def test_copies_are_not_templates(spark):
    html = page("<article><p>copied words</p></article>")
    rows = [(i, f"https://one.example/{i}", html) for i in range(30)]
    assert set(texts(spark, rows).values()) == {"copied words"}
    share = '<article><p>story {0}</p><div class="z9">Send this on</div></article>'
    rows = [(i, f"https://two.example/{i}", page(share.format(i))) for i in range(12)]
    assert texts(spark, rows) == {i: f"story {i}" for i in range(12)}


def test_edges(spark):
    schema = ROW + ", text string, host string, path long, low array<int>, id int"
    rows = [(1, "http://h.example", page("<article>a</article>"), "t", "h", 1, [1], 2), (None, None, None, None, None, None, None, None)]
    assert texts(spark, rows, schema) == {1: "a", None: ""}
    df = spark.createDataFrame(rows, schema)
    assert site_style.extract(df.limit(0)).count() == 0


def test_names_do_not_override_an_article(spark):
    """A word in a wrapper's id or class, or a form around the page, leaves the article inside alone."""
    side = '<div class="sidebar">Side links</div>'
    wrapped = [
        f'<div class="content-sidebar-wrap"><main><p>Long story of the day</p></main>{side}</div>',
        f'<div class="layout has-sidebar"><article><p>Long story of the day</p></article>{side}</div>',
        f'<div id="search-page"><p>Long story of the day</p></div>{side}',
        f'<form action="/"><nav>Menu</nav><div><p>Long story of the day</p></div>{side}</form>',
        f'<main><div class="layout has-sidebar"><p>Long story of the day</p></div></main>{side}',
        '<article><p>Teaser</p></article><div><p>Long story of the day</p></div>' + side,
        '<article><p>Long story of the day</p></article><section class="comments"><article>Reader one</article></section>',
        '<div class="ad">Buy all of this at once, and then buy some more of it again</div><article><p>Long story of the day</p></article>',
    ]
    got = texts(spark, [(i, f"https://h{i}.example/", page(b)) for i, b in enumerate(wrapped)])
    assert got == {i: ("Teaser " if i == 5 else "") + "Long story of the day" for i in range(len(wrapped))}


def test_names_are_a_prior_on_entropy(spark):
    """On a host of many pages: a named branch with much text of its own stays, one with little or always the same goes."""
    body = '<div class="search-box-left"><p>{0} unique story number {0} of some more words</p></div><div class="x2"><p>{0} another unique story {0}</p></div><div class="ad">Buy {0}</div><div class="banner">Always the same words</div>'
    rows = [(i, f"https://one.example/{i}", page(body.format(i))) for i in range(20)]
    assert texts(spark, rows) == {i: f"{i} unique story number {i} of some more words {i} another unique story {i}" for i in range(20)}


def drawn(n, seed=3):
    """Pages of one host without a name or mark: a menu and a footer drawn from 12 texts, an article of its own, and every one's number of paragraphs."""
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(("alpha", "beta", "gamma", "delta", "omega")) + str(k) for _ in range(4)) for k in range(12)]
    out = []
    for i in range(n):
        story = [f"story {i} part {k} of number {rng.random():.6f}" for k in range(rng.randint(1, 6))]
        menu = "".join(f"<li>{w}</li>" for w in rng.choice(pool).split())
        out.append((i, f"https://h.example/{i}", page(f"<div><ul>{menu}</ul></div><div>{''.join(f'<p>{s}</p>' for s in story)}</div><div>{rng.choice(pool)}</div>"), " ".join(story)))
    return out


@pytest.mark.parametrize("n", [25, 300])
def test_entropy_alone_finds_the_article(spark, n):
    rows = drawn(n)
    got = site_style.extract(spark.createDataFrame([r[:3] for r in rows], ROW)).collect()
    assert {r.page_id: r.text for r in got} == {i: story for i, _, _, story in rows}
    assert all(r.n_low == 5 for r in got)  # four entries of the menu, and the footer
    assert texts(spark, [r[:3] for r in rows[:4]]) == {i: " ".join(" ".join(site_style.Page(html).blocks[k][0] for k in range(len(site_style.Page(html).blocks))).split()) for i, _, html, _ in rows[:4]}


def test_entropies_equal_brute_force(spark):
    rows = drawn(40) + [(100, "https://h.example/x", drawn(40)[0][2], "")]  # one page twice
    rule = site_style.Cut()
    by_path, seen_texts = {}, set()
    for _, _, html, _ in rows:
        p = site_style.Page(html, rule)
        if p.main() not in seen_texts:
            seen_texts.add(p.main())
            for path, content, style, *_ in p.branches():
                by_path.setdefault(path, []).append((content, style))
    pages = spark.createDataFrame([("h", html) for _, _, html, _ in rows], "host string, html string")
    got = {r.path: r for r in site_style.style_tree(site_style._seen(pages, rule), rule).collect()}
    assert got.keys() == by_path.keys()
    for path, values in by_path.items():
        n = len(values)
        content, style = (Counter(v[k] for v in values) for k in (0, 1))
        shown = 1 - sum(c == 1 for c in content.values()) / n
        h = math.log(n) - sum(c * math.log(c) for c in style.values()) / n
        c = None if shown == 0 else -sum(shown * m / n * math.log(shown * m / n) / (1 - (1 - shown * m / n) ** n) for m in content.values())
        own = 1.0 if c is None else min(1.0, c / (2 * math.log(rule.variants)))
        leaf = set(style) == {0}
        want = own if leaf else (1 - rule.gamma ** math.exp(h)) * (1 - math.exp(-h)) + rule.gamma ** math.exp(h) * own
        r = got[path]
        assert r.pages == n and abs(r.style_entropy - h) < 1e-8 and abs(r.importance - want) < 1e-7
        assert (r.content_entropy is None) == (c is None) and (c is None or abs(r.content_entropy - c) < 1e-8)
    assert {round(r.content_entropy, 1) for r in got.values() if r.content_entropy is not None}  # the menu and the footer repeat
