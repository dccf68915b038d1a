import gc
import re
import time
import weakref

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import pytest

from lexforge.operators import cleaning, html_text


def plain(text):
    """The rules as a loop over lines."""
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f﻿​-‍­]", "", text.replace("\r\n", "\n").replace("\r", "\n"))
    kept, counts = [], {}
    for line in map(str.strip, text.split("\n")):
        if not line or re.fullmatch(r"第\s*\d+\s*页|-\s*\d+\s*-|Page\s*\d+|page\s*\d+", line) or not any(c.isalnum() for c in line):
            continue
        if len(line) >= 2:
            if counts.get(line, 0) >= 3:
                continue
            counts[line] = counts.get(line, 0) + 1
        kept.append(line)
    out = [x for i, x in enumerate(kept) if i == 0 or x != kept[i - 1]]
    return "\n\n".join(re.sub(" {2,}", " ", x) for x in out).strip()


def cleaned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, content string")
    return [r.content for r in cleaning.clean_documents(df).orderBy("n").collect()]


def test_known_lines(spark):
    keep = ["数值120/80，应保留本行", "120/80", "1.5", "5", "第3页说明剂量"]
    assert cleaned(spark, keep) == keep
    assert cleaned(spark, ["第 3 页\nPage 2\n---", None, ""]) == ["", None, ""]


def test_against_loop(spark):
    samples = ["a\nb\na\na\na\na\nb", "x\r\ny\rz\x00\x07", "one  two\n\none  two\nq", "..\n--\nab\nab\n..\nab", "z\nz\nz\nz\nzz\nzz", " 　a\n- 3 -\nPage12\nok"]
    assert cleaned(spark, samples) == [plain(t) for t in samples]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab1 .-\n\r\t", max_size=60), min_size=5, max_size=20))
def test_any_text(spark, texts):
    assert cleaned(spark, [t or "x" for t in texts]) == [plain(t or "x") for t in texts]


def test_metadata(spark):
    df = spark.createDataFrame([(1, "# Head \nbody"), (2, "lower\nShort One\nx"), (3, "a bb bb cc 的 cc dd bb"), (4, "")], "n int, content string")
    rows = {r.n: r for r in cleaning.with_metadata(df).collect()}
    assert rows[1].title == "Head" and rows[2].title == "Short One" and rows[3].title is None
    assert rows[3].keywords == ["bb", "cc", "dd"] and rows[4].keywords is None
    assert (rows[3].char_count, rows[3].word_count) == (len("a bb bb cc 的 cc dd bb"), 8)


def test_answers(column):
    head = "标题 作者：张三 已审核 浏览专业版 正文在此。"
    assert column(cleaning.clean_answer, head, "保留所有权利。正文。", "开头。症状 诊断 治疗 正文。", "见（请参阅 别处。）正文。", "", None) == ["标题 正文在此。", "正文。", "开头。 正文。", "见正文。", "", None]
    tail = "正文。美国心脏协会：信息 某基金会：资料 更多更多更多更多更多"
    assert column(cleaning.clean_answer, tail) == ["正文。"]
    assert column(cleaning.clean_answer, "正文一。正文二。CDC：资料。") == ["正文一。正文二。"]


def test_faq_rows(spark):
    df = spark.createDataFrame([(" q  1 ", "a", "s", None), ("", "a", "s", "d"), ("q", "版权所有。", "s", "d")], "question string, answer string, source string, doc_name string")
    out = cleaning.clean_faq(df)
    assert [(r.question, r.answer, r.doc_name) for r in out.collect()] == [("q 1", "a", "")]
    stats = cleaning.cleaning_stats(df, out).first()
    assert (stats.total, stats.kept, stats.dropped, stats.changed) == (3, 1, 2, 0)


def test_filters_take_literals(spark):
    df = spark.createDataFrame([('a" or source != "b\\c',), ("x",)], "source string")
    assert df.where(cleaning.all_of(cleaning.source_is(F.col("source"), 'a" or source != "b\\c'))).count() == 1
    assert df.where(cleaning.all_of(None, cleaning.source_is(F.col("source"), ""))).count() == 2


def test_titled_and_integrity(column):
    assert column(cleaning.titled, ("# T\nbody", "T"), ("body", "T"), ("# T", "T")) == ["# T\n\nbody\n", "# T\n\nbody\n", "# T\n\n\n"]
    got = column(cleaning.missing_parts, ("a 5 mg and 1.5", ["Head-One", "Lost"], "# Head One 5 mg"), types=["string", "array<string>", "string"])
    assert got == [["Lost", "1.5"]]


WORD = st.text("abcdefghijklmnopqrstuvwxyz", min_size=1, max_size=6)


@given(st.lists(st.tuples(st.integers(0, 5), WORD, WORD), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_markdown(parts):
    """Inline markup of generated words: links of each form, pictures, raised and lowered text, what only looks like markup."""
    forms = (
        lambda a, b: (f"[{a} [{b}]](http://{a}.example/p_({b}) 'see {b}')", f"{a} [{b}]"), lambda a, b: (f"![{a}]({b}.jpg)", a), lambda a, b: (f"[{a}][known]", a),
        lambda a, b: (f"{a}<sup>{b}</sup>", f"{a}^{b}"), lambda a, b: (f"{a}<sub>{b}</sub>", f"{a}_{b}"), lambda a, b: (f"[{a}][none {b}] <{a}-9> < {b} `[{a}]({b})`",) * 2,
    )
    made = [forms[i](a, b) for i, a, b in parts]
    source = "\n\n\n\n".join(x for x, _ in made) + "\n\n[known]: http://far.example/x\n"
    assert html_text.normalize_markdown(source) == "\n\n".join(y for _, y in made)


@given(st.integers(1, 4), st.lists(st.lists(st.tuples(WORD, st.integers(1, 3)), min_size=1, max_size=4), min_size=1, max_size=5), st.booleans())
@settings(max_examples=60, deadline=None)
def test_tables(down, rows, head):
    """Generated tables against a plain grid; the first cell of the first body row spans ``down`` rows, others span columns."""
    html, grid, first, left = "", [], True, 0
    if head:
        html += "<tr><th>top</th></tr>"
        grid.append(["top"])
    for row in rows:
        cells, line = "", []
        if left:
            line.append(held)
            left -= 1
        for text, wide in row:
            if first:
                held, left = text, min(down, len(rows)) - 1
                cells += f'<td rowspan="{down}">{text}</td>'
                line.append(text)
            else:
                cells += f'<td colspan="{wide}">{text}</td>'
                line += [text] * wide
            first = False
        html += f"<tr>{cells}</tr>"
        grid.append(line)
    width = max(map(len, grid))
    if not head:
        grid.insert(0, [f"{html_text.COLUMN}{i + 1}" for i in range(width)])
    grid = [line + [""] * (width - len(line)) for line in grid]
    grid.insert(1, ["---"] * width)
    out = html_text.normalize_markdown(f"<table><caption>about</caption>{html}</table>")
    assert [[c.strip() for c in line.split("|")[1:-1]] for line in out.split("\n")[2:]] == grid and out.startswith("about\n\n")
    assert html_text.normalize_markdown(out) == out


def test_spans_are_bounded():
    huge = "9" * 5000
    out = html_text.normalize_markdown(f'<table><tr><th colspan="{huge}" rowspan="{huge}">x|y</th></tr><tr><td colspan="0">z</td></tr></table>')
    assert out.split("\n")[0].count("x\\|y") == html_text.SPANS["colspan"]


def test_articles():
    label = sorted(html_text.LABELS)[0]
    html = f"<nav>menu</nav><main><h1>Rivers</h1><p>The Elbe [note]</p><p>7</p><p>3/4</p><p>{label}</p></main><p>after</p>"
    assert html_text.article_lines(html).split("\n") == ["Rivers", "The Elbe [note]", "7", "3/4"]
    assert html_text.article_markdown(html, "Rivers") == "The Elbe [note]\n\n7\n\n3/4"
    assert html_text.chaptered(html, ("The",), frozenset(["7"])) == "Rivers\n\n## The Elbe [note]\n3/4"
    assert html_text.article_markdown("<p>no article</p>") == "" == html_text.article_lines("<nav>only a menu</nav>")


def test_code_is_literal():
    for same in ("`[e](url)`\n\n``[e](url) with ` inside``\n\n```html\n<a href=\"x\">e</a>\n```", "```text\nfirst\n\n\nsecond  \n```\n\n`line one\n\n\nline two`", "# Example\n\n```python\nvalue = \"literal\"   \n\n\nprint(value)\n```"):
        assert html_text.normalize_markdown(same) == same and html_text.tidy_markdown(same) == same
    assert html_text.tidy_markdown("a  \r\n\r\n\r\n\u200bb\ufeff\r`x \x07`") == "a\n\nb\n`x \x07`"
    assert html_text.normalize_markdown("`a` b `` c") == "`a` b `` c" and html_text.normalize_markdown("~~~\nx") == "~~~\nx"
    with pytest.raises(ValueError):
        html_text.normalize_markdown("x \U00100001")


def test_labels_headings_and_lists():
    n = html_text.normalize_markdown
    source = '<a name="t"></a><h3>Tides</h3><p><b>ebb</b> and <a href="u">flow</a></p><ul><li>spring<ul><li>neap</li></ul></li></ul><ol><li>moon</ol><!--gone--><script>let q = "<i>"</script>'
    assert n(source) == "### Tides\n\nebb and flow\n\n- spring\n  - neap\n\n1. moon"
    assert n("a <https://x.y/z> b </foo> <b>x</b> <i>y") == "a <https://x.y/z> b </foo> x y"
    assert n('[a][b c] [B c] ![i][b c]\n\n[B C]: http://x\n   "title"\nrest \\[no](x) [open (x [l](t') == "a B c i\n\nrest \\[no](x) [open (x [l](t"
    assert n("[" * 5000 + "x") == "[" * 5000 + "x" and n("<div>" * 5000 + "x") == "x"


def test_filtered_article():
    """Elements with a dropped tag, class or part of a class go with all they hold; a table and a button's label stay."""
    gone = [f"<{t}>lost one</{t}>" for t in sorted(html_text.DROP_TAGS)] + [f'<div class="k {c}">lost two</div>' for c in sorted(html_text.DROP_CLASSES)] + [f'<div class="{p}x_7">lost three</div>' for p in html_text.DROP_PARTS]
    html = f"<main><h1>Harbours</h1>{''.join(gone)}<h2>Depth</h2><p>Ask the <button>pilot</button> first.</p><table><tr><th>quay</th></tr><tr><td>12.5</td></tr></table></main>"
    assert html_text.article_markdown(html, "Harbours") == "## Depth\n\nAsk the pilot first.\n\n| quay |\n| --- |\n| 12.5 |"



def test_markup_read_by_expressions_equals_the_parser():
    """Plain tags and rows are told apart without the parser, which a comment in front turns to; both write the same."""
    row = '<tr><td rowspan="2">a | b</td><th COLSPAN="2"> c  d </th></tr><TR><td></td></tr>'
    texts = (
        f"<table><caption>t</caption>{row}<tr><td>x &amp; y</td><td><b>z</b></td></tr></table>", f"{row}<p>a<br/>b<foo x=\"1\">c</foo></p>", "<ul><li>a <sub>1</sub></li><li/></ul>&lt;b> <img alt=\"i\">",
        '<a href="u">[n]</a> ![i](u) [!](u)[b](v) \\[x](y) [p](q(r)s)!\n\n[n]: http://t', "<b>a < b</b> <td>c</td>", "<script>a<b</script>c<style>d", f"<div><table>{row}",
    )
    for text in texts:
        parsed = html_text.Writer(lambda x: x)
        parsed.feed("<!---->" + text)
        parsed.close()
        own = html_text.Writer(lambda x: x)
        own.feed(text)
        own.close()
        assert own.written() == parsed.written()


def test_long_tables_are_read_quickly():
    rows = "".join(f'<tr><td rowspan="2">w{i}</td><td>{i}</td><td>4</td></tr><tr><td colspan="2">-</td></tr>' for i in range(20_000))
    calls = 0

    class Counted(html_text.Writer):
        def handle_starttag(self, tag, attrs):
            nonlocal calls
            calls += 1
            super().handle_starttag(tag, attrs)

    writer = Counted()
    writer.feed(f"<table>{rows}</table>")
    writer.close()
    assert calls == 1 and writer.written().count("\n| ") == 40_002


CELLS = [f"<{k}{a}>{t}</{k}>" for k in ("td", "th") for a in ("", ' rowspan="2"', ' colspan="2"', ' rowspan="3" COLSPAN="2"', ' class="x"  rowspan="0"') for t in ("a", "", " b | c  d\xa0", "-", "e>f")]
BREAKS = ["</tr><tr>", "</tr>\n<tr>", "</tr> <tr>\t", "</tr><tr><td>x</td></tr><tr>"] * 3 + ["<tr>", "</tr>", "</tr>q<tr>", "<td>x</th>", "<td>&amp;</td>", "</tr></table><table><tr>", "<table><tr>", "</table>", "<b>", "<TABLE>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(CELLS), min_size=1, max_size=3), st.sampled_from(BREAKS), st.integers(1, 5)), min_size=1, max_size=6), st.sampled_from(["", "<caption>t | u</caption>", "\n", "x"]))
def test_tables_read_whole_equal_the_parser(rows, lead):
    """Plain tables, of which blocks of rows come again and again, and those with something else in them."""
    body = "".join(("".join(cells) + end) * n for cells, end, n in rows)
    text = f"<p>{lead}<table>{lead}<tr>{body}<td>z</td></tr> </table><table><tr>{body}"
    parsed = html_text.Writer(lambda x: x)
    parsed.feed("<!---->" + text)
    parsed.close()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(html_text, "BLOCK_TIMES", 1)
        own = html_text.Writer(lambda x: x)
        own.feed(text)
        own.close()
    assert own.written() == parsed.written()


def test_long_tables_take_no_step_a_cell(monkeypatch):
    """A table of 40000 rows in blocks of two is laid out by the plan of one block, whatever its texts."""
    rows = "".join(f'<tr><td rowspan="2">w {i}</td><td>{i}</td><td>4|</td></tr><tr><td colspan="2">-</td></tr>' for i in range(20_000))
    calls = []
    for name in ("_written_cell", "_times"):
        monkeypatch.setattr(html_text, name, lambda *a, f=getattr(html_text, name): calls.append(1) or f(*a))
    out = html_text.normalize_markdown(f"<table>{rows}</table>")
    assert len(calls) < 200
    assert out == "\n".join(["| 列1 | 列2 | 列3 |", "| --- | --- | --- |"] + [f"| w {i} | {i} | 4\\| |\n| w {i} | - | - |" for i in range(20_000)])


def test_labels_step_from_mark_to_mark():
    """Long prose between links is one step: a megabyte of it is read in the time of its few marks."""
    text = "".join(f"[x{i}](u{'(' * (i % 3)}{')' * (i % 3)}) {'word ' * 20_000}! ![y](z) \\[k\\]\n\n" for i in range(10))
    began = time.process_time()
    out = html_text._labels(text, set())
    assert time.process_time() - began < 0.1
    assert out == "".join(f"x{i} {'word ' * 20_000}! y \\[k\\]\n\n" for i in range(10))


PIECES = (
    "a b \n \n\n ! [ ] ( ) \\ & <5 [x](y) ![i](u) [x](y(z)w) [w][far] [w][no] [far] [!](q) [a!](q) [](q) [][far] [w][] <b> </b> <b>t</b> <sub>2</sub> <I>x</I> <b>a<i>b</i></b> "
    "<code>q</code> &amp <foo> <p> </p> <script> </script> <table><tr><td> </td></tr></table> [q[r](s)](t) ]:"
).split(" ") + ["\n[far]: u\n", "\n[far]: u\n 't'\n", "[w] [far]", " "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_runs_of_markup_are_as_if_read_one_by_one(pieces):
    text = "".join(pieces)
    got = html_text.normalize_markdown(text)
    with pytest.MonkeyPatch.context() as patch:
        never = re.compile("(?!)")
        patch.setattr(html_text, "INLINE_RUN", never)
        patch.setattr(html_text, "LINK_RUN", never)
        assert html_text.normalize_markdown(text) == got


def test_runs_of_markup_take_no_step_an_element(monkeypatch):
    calls = []
    for home, name in ((html_text.Writer, "handle_starttag"), (html_text, "_past")):
        monkeypatch.setattr(home, name, lambda *a, f=getattr(home, name): calls.append(1) or f(*a))
    text = "# [t](u)\n\n" + "".join(f"- w<sub>{i}</sub>\n- [w](http://h/(a)/{i} \"of it\")\n- <b>w</b> [v][far]\n" for i in range(2000)) + "\n[far]: u\n"
    assert html_text.normalize_markdown(text) == "# t\n\n" + "".join(f"- w_{i}\n- w\n- w v\n" for i in range(2000)).strip()
    assert len(calls) < 10


def test_a_pages_tree_goes_without_the_collector(monkeypatch):
    trees = []
    monkeypatch.setattr(html_text, "tree", lambda html, f=html_text.tree: (trees.append(weakref.ref(root := f(html))), root)[1])
    gc.collect()
    gc.disable()
    try:
        assert html_text.article_lines("<html><nav>menu</nav><article><h1>Tides</h1><p>high<br/>and <b>low</i></b></p></article></html>") == "Tides\nhigh\nand\nlow"
        assert html_text.article_markdown("<article><p>a</b> b</p>") == "a b"
        assert len(trees) == 2 and all(t() is None for t in trees)
    finally:
        gc.enable()
