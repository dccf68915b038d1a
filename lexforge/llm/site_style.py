"""Main text of web pages by site style trees.

Pages of a host are merged by the style of their nodes: a node's path is the tags, ids and
classes from the root down, and the place among its like of a bare container. For each path
of a host two entropies are taken over its pages: of the content (the text of the whole
branch) and of the presentation (the row of child styles). Pages with the same content count
once, so copies don't make an article look like a template.

The content's entropy is adjusted for the part of the variants that the pages have not shown
(Chao and Shen), so a menu drawn from a few dozen variants reads alike on a host of 20 pages
and on one of 20,000, and texts that never come twice have the most. It counts as a part
of twice the log of ``variants``. With ``e^h`` the effective number of presentations, the
importance of a branch is

    (1 - gamma^(e^h)) (1 - e^-h) + gamma^(e^h) content,  of a leaf: content

A block of text is cut if the deepest of its branches that enough pages have is of low
importance; a heading goes with the branch that it heads. That alone removes menus, adverts and footers of hosts that can be judged.

Names and marks are priors. A menu or footer element, a word in an id or class (advert,
sidebar, comments), a form, or a place outside of the marked article, stands against a
branch: its importance, plus the part of the page's text that it holds, less the prior,
must reach the bar; where a host has too few pages, a fixed importance is assumed. A branch
around a main element, or around the only article, stands whatever its name.

Statistics are summed by (host, path, value) before they meet by (host, path), so a large
host is no large task; the cut branches of a host are one row.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, bound_batches

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|object)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<""", re.DOTALL | re.IGNORECASE)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul title".split()
)
#: Elements without an end.
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A start of the first ends an open one of the second.
ENDS = {"li": "li", "dd": "dd dt", "dt": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
#: Elements whose text is no text of the page.
HARD = frozenset("head title dialog button select".split())
#: Elements and roles that are hardly ever the article.
FRAME = frozenset("nav aside footer menu".split())
ROLES = frozenset("navigation banner contentinfo complementary alertdialog dialog menu menubar toolbar".split())
#: Roles that may hold a whole page, as a form may.
SOFT_ROLES = frozenset("search form alert".split())
#: Words of ids and classes that name a purpose other than the article.
PURPOSE = frozenset(
    "ad ads adv advert adverts advertisement adsense banner promo promotion sponsor sponsored menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar sidenav widget widgets footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended comment comments commentlist discussion disqus reply replies respond "
    "form search pagination pager skip copyright disclaimer".split()
)
COMMENT = frozenset("comment comments reply replies".split())
#: Names of what readers write, which may be longer than the article.
READERS = COMMENT | frozenset("commentlist discussion disqus respond".split())


#: Headings, which are judged with the branch that they head.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 caption legend summary".split())
#: Containers that are told apart by their place where they have no name.
PLACED = frozenset("div section article main table ul ol dl form aside center".split())


@dataclass(frozen=True)
class Cut:
    """Bars and priors.

    ``variants``: a branch with so many equally likely texts on a host has an importance of
    one half. ``gamma``: how slowly presentations outweigh content. ``outside``, ``inside``:
    least importance of a branch, and ``outside_pages``, ``inside_pages``: least pages for it
    to be judged, outside and inside of a marked article. Priors: ``frame`` elements and
    roles, ``readers`` (what readers write), other ``name``, ``apart`` (outside of a marked
    article). ``unknown``: the importance of a branch on too few pages. ``trust``: least part
    of the text in articles that are marks. ``priors`` False: entropies alone decide.
    """

    variants: float = 150.0
    gamma: float = 0.9
    inside: float = 0.3
    inside_pages: int = 8
    outside: float = 0.5
    outside_pages: int = 5
    frame: float = 1.35
    readers: float = 1.15
    name: float = 0.75
    apart: float = 0.9
    unknown: float = 0.75
    trust: float = 0.3
    priors: bool = True


def _h(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed) - (1 << 63)


class Page:
    """Blocks of a page: (text, paths of the nodes that hold it from the root down, whether in an article)."""

    def __init__(self, html: str, rule: Cut = Cut()):
        self.rule = rule
        self.blocks: list[tuple[str, tuple[int, ...], bool]] = []
        self.children: dict[int, list[str]] = {}
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, path, in an article, no text of the page
        self.placed: dict[tuple[int, str], int] = {}
        self.held: list[str] = []
        self.prior: dict[int, float] = {}  # of branches; 0 of none
        self.framed: set[int] = set()
        self.inside: set[int] = set()  # branches in a marked article
        self.apart: set[int] = set()  # named branches outside of an article
        self.around: tuple[set[int], set[int]] = (set(), set())  # branches that hold an article, a main element
        for m in TOKEN.finditer(html):
            token = m[0]
            if token[0] != "<" or len(token) == 1:
                self.held.append(token)
            elif m[2]:
                self.end(m[2].lower())
            elif m[3]:
                # at the end of a cut page a tag may be open: it is no text
                self.start(m[3].lower(), m[4] or "")
        self.flush()
        self.weigh()

    # ------------------------------------------------------------- reading

    def flush(self) -> None:
        if self.held:
            text = " ".join(references.unescape("".join(self.held)).split())
            self.held = []
            top = self.stack[-1] if self.stack else ("", 0, False, False)
            if text and not top[3]:
                own = self.stack[:-1] if top[0] in HEADINGS and top[1] not in self.prior else self.stack
                self.blocks.append((text, tuple(x[1] for x in own) or (0,), top[2]))

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.held.append(" ")
            return
        named = {a.lower(): (b or c or d or "") for a, b, c, d in ATTRIBUTE.findall(attributes)} if attributes and not attributes.isspace() else {}
        hard = tag in HARD or "hidden" in named or "display:none" in named.get("style", "").replace(" ", "").lower()
        prior = self.against(tag, named) if self.rule.priors else 0.0
        if tag not in BLOCKS:
            if (hard or prior) and tag not in EMPTY:  # a named inline element is a branch as well
                self.flush()
                self.push(tag, named, hard, prior)
            return
        self.flush()
        for k in range(len(self.stack) - 1, -1, -1):
            open_tag = self.stack[k][0]
            if open_tag == "p" or open_tag in ENDS.get(tag, "").split():
                del self.stack[k:]
                break
            if open_tag not in ("dd", "dt", "li") and tag not in ENDS or open_tag in ("ul", "ol", "dl", "table"):
                break
        if tag not in EMPTY:
            self.push(tag, named, hard, prior)

    def against(self, tag: str, named: dict[str, str]) -> float:
        """The prior against an element by its tag, role and names."""
        role = named.get("role", "").lower()
        if tag in FRAME or role in ROLES or tag == "header" and not (self.stack and self.stack[-1][2]):
            return self.rule.frame
        words = set(re.split(r"[^a-z0-9]+", f"{named.get('class', '')} {named.get('id', '')}".lower())) if "class" in named or "id" in named else set()
        words &= COMMENT if tag in ("article", "main") else frozenset() if tag in ("html", "body") else PURPOSE
        return self.rule.readers if words & READERS else self.rule.name if words or tag == "form" or role in SOFT_ROLES else 0.0

    def push(self, tag: str, named: dict[str, str], hard: bool, prior: float) -> None:
        up = self.stack[-1] if self.stack else ("", 0, False, False)
        style = f"{tag}#{named.get('id', '')}.{named.get('class', '')}" + (f"@{named['role']}" if named.get("role", "").lower() in SOFT_ROLES else "")
        self.children.setdefault(up[1], []).append(style)
        place = ""
        if tag in PLACED and not named.get("id") and not named.get("class"):
            n = self.placed[up[1], style] = self.placed.get((up[1], style), -1) + 1
            place = f":{min(n, 9)}"
        path = _h(f"{up[1]}/{style}{place}")
        main = tag == "main" or named.get("role", "").lower() == "main"
        marked = self.rule.priors and (main or tag == "article") and not prior
        if marked and not any(x[1] in self.framed for x in self.stack):
            self.around[main].update(x[1] for x in self.stack)
        if up[2] or marked:
            self.inside.add(path)
        if prior:
            self.prior[path] = prior
            if prior == self.rule.frame:
                self.framed.add(path)
            if not up[2]:
                self.apart.add(path)
        self.stack.append((tag, path, up[2] or marked, up[3] or hard))

    def end(self, tag: str) -> None:
        if tag in BLOCKS or any(x[0] == tag for x in self.stack):
            self.flush()
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == tag:
                    del self.stack[k:]
                    break

    # ------------------------------------------------------------- weighing

    def weigh(self) -> None:
        """Parts of the page's text in branches with a prior, those that stand by what they hold, and the article's mark."""
        total = sum(len(text) for text, _, _ in self.blocks)
        free = [(len(text), article) for text, paths, article in self.blocks if not any(p in self.prior for p in paths)]
        held = sum(n for n, article in free if article)
        articles, mains = self.around
        self.stands = (mains if held and held >= self.rule.trust * sum(n for n, _ in free) else mains | articles) - self.framed
        if held:
            for p in self.apart - self.stands:
                self.prior[p] += self.rule.apart
        self.part = self.parts(total)
        cut = self.cut()
        free = [(len(text), article) for text, paths, article in self.blocks if cut.isdisjoint(paths)]
        held = sum(n for n, article in free if article)
        self.marked = held > 0 and held >= self.rule.trust * sum(n for n, _ in free)
        if self.marked:
            around = articles | mains
            for _, paths, article in self.blocks:
                if not article:
                    top = next((p for p in paths if p not in around), paths[-1])
                    if top not in self.prior:
                        self.prior[top] = self.rule.apart
            self.part = self.parts(total)

    def parts(self, total: int) -> dict[int, float]:
        chars = dict.fromkeys(self.prior, 0)
        for text, paths, article in self.blocks:
            for p in dict.fromkeys(paths):
                if p in chars:
                    chars[p] += len(text)
        return {p: n / max(total, 1) for p, n in chars.items()}

    def cut(self, good: frozenset[int] = frozenset(), bad: frozenset[int] = frozenset()) -> set[int]:
        """Branches that fail against their prior; those of ``good`` and ``bad`` are judged by their host."""
        return {p for p, prior in self.prior.items() if p not in self.stands and p not in good and (p in bad or self.rule.unknown + self.part[p] - prior < self.rule.outside)}

    def low(self, low: frozenset[int], high: frozenset[int]) -> list[bool]:
        """Of each block, whether its deepest judged branch (of ``low`` or ``high``) is of ``low``."""
        return [bool(low) and next((p for p in reversed(paths) if p in low or p in high), 0) in low for _, paths, _ in self.blocks]

    def main(self, low: frozenset[int] = frozenset(), high: frozenset[int] = frozenset(), good: frozenset[int] = frozenset(), bad: frozenset[int] = frozenset()) -> str:
        """Blocks that neither entropy nor a prior cuts."""
        cut = self.cut(good, bad)
        return " ".join(text for (text, paths, _), is_low in zip(self.blocks, self.low(low, high)) if not is_low and cut.isdisjoint(paths))

    def branches(self) -> Iterator[tuple[int, int, int, bool, float, float]]:
        """(path, content, presentation, in a marked article, part of the text, prior) of each path with text.

        The presentation of a leaf is 0, and so are the last two of a path without a prior.
        Text of a failing branch counts in that branch alone.
        """
        cut = self.cut()
        content: dict[int, int] = {}
        for text, paths, _ in self.blocks:
            h = _h(text)
            top = next((k for k, p in enumerate(paths) if p in cut), 0)
            for p in dict.fromkeys(paths[top:]):
                content[p] = _h(f"{content.get(p, 0)} {h}")
        for p, h in content.items():
            yield p, h, _h("|".join(self.children[p])) if p in self.children else 0, self.marked and p in self.inside, self.part.get(p, 0.0), self.prior.get(p, 0.0)


SEEN = "host string, path long, page long, content long, style long, marked boolean, part double, prior double"


def _seen(pages: DataFrame, rule: Cut) -> DataFrame:
    """The branches of each page of (host, html); pages of one host with equal texts are one."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.float64())
        names = ["host", "path", "page", "content", "style", "marked", "part", "prior"]
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [], [])
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(html, rule)
                whole = _h(page.main())
                for path, *values in page.branches():
                    for k, x in enumerate((name, path, whole, *values)):
                        out[k].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=names)

    seen = pages.select("host", "html").mapInArrow(read, SEEN)
    # equal pages may differ in what is cut: the least value, whatever the order of rows
    rest = [F.min("content").alias("content"), F.min("style").alias("style"), F.max("marked").alias("marked"), F.max("part").alias("part"), F.max("prior").alias("prior")]
    return seen.groupBy("host", "path", "page").agg(*rest)


def style_tree(seen: DataFrame, rule: Cut = Cut()) -> DataFrame:
    """``host, path, pages, marked, part, prior, content_entropy, style_entropy, importance`` of each path.

    The entropies are in nats: the content's adjusted for unseen variants (null where every
    page has its own), the presentation's as it is. Each is summed from how many values
    occur how often, which is at most about the root of twice the pages a path.
    """

    def times(value: str) -> DataFrame:
        n = seen.groupBy("host", "path", value).agg(F.count(F.lit(1)).alias("n"), F.max("marked").alias("marked"), F.sum("part").alias("part"), F.max("prior").alias("prior"))
        return n.groupBy("host", "path", "n", (F.lit(False) if value == "content" else F.col(value) == 0).alias("leaf")).agg(F.count(F.lit(1)).alias("k"), F.max("marked").alias("marked"), F.sum("part").alias("part"), F.max("prior").alias("prior"))

    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    content = times("content").groupBy("host", "path").agg(
        F.sum(F.col("n") * F.col("k")).alias("pages"), F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("k"))), F.lit(0)).alias("single"), F.collect_list(F.struct(n.alias("n"), k.alias("k"))).alias("often"),
        F.max("marked").alias("marked"), F.round(F.sum("part") / F.sum(F.col("n") * F.col("k")), 9).alias("part"), F.max("prior").alias("prior"),
    )
    shown = 1 - F.col("single") / F.col("pages")

    def unseen(x):
        p = shown * x["n"] / F.col("pages")
        return -x["k"] * p * F.log(p) / (1 - F.pow(1 - p, F.col("pages")))

    entropy = F.when(F.col("single") < F.col("pages"), F.round(F.aggregate(F.transform(F.array_sort("often"), unseen), F.lit(0.0), lambda a, x: a + x), 9))
    content = content.select("host", "path", "pages", "marked", "part", "prior", entropy.alias("content_entropy"))
    total = F.sum(F.col("n") * F.col("k"))
    style = times("style").groupBy("host", "path").agg(F.round(F.log(total) - F.sum(k * n * F.log(n)) / total, 9).alias("style_entropy"), F.min("leaf").alias("leaf"))
    own = F.coalesce(F.least(F.lit(1.0), F.col("content_entropy") / (2 * math.log(rule.variants))), F.lit(1.0))
    weight = F.pow(F.lit(rule.gamma), F.exp("style_entropy"))
    importance = F.when(F.col("leaf"), own).otherwise((1 - weight) * (1 - F.exp(-F.col("style_entropy"))) + weight * own)
    return content.join(style, ["host", "path"]).withColumn("importance", importance).drop("leaf")


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rule: Cut = Cut()) -> DataFrame:
    """``id, url, text, n_chars, n_blocks, n_low`` of each page: blocks in page order, joined by one space; how
    many blocks the page has, and how many of them the host's entropies cut, whatever their names.

    Null and empty pages, and pages of nothing but frame, have an empty text. Pages with a
    null url, or one without a host, form a host of their own. Repeated pages are extracted
    each and count once in the statistics. A branch whose importance is just the bar stays (a
    tie); the order of rows changes nothing. An empty table gives an empty one. Other columns
    are dropped, so names cannot clash.
    """
    space = Workspace(df.sparkSession, "site-style")
    bound_batches(df.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1)), F.lit(""))
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    kind = df.schema[id_col].dataType.simpleString()

    seen = space.stow(_seen(pages, rule), "seen")
    tree, value = style_tree(seen, rule), F.col("importance")
    least = F.when(F.col("marked"), F.lit(rule.inside)).otherwise(F.lit(rule.outside))
    enough = F.col("pages") >= F.when(F.col("marked") & (F.col("prior") == 0), F.lit(rule.inside_pages)).otherwise(F.lit(rule.outside_pages))
    low, stands = value < F.when(F.col("prior") > 0, F.lit(rule.outside)).otherwise(least), value + F.col("part") - F.col("prior") >= rule.outside
    lists = [F.collect_list(F.when(x, F.col("path"))).alias(name) for name, x in (("low", low), ("high", ~low), ("good", (F.col("prior") > 0) & stands), ("bad", (F.col("prior") > 0) & ~stands))]
    cut = space.stow(tree.where(enough).groupBy("host").agg(*lists), "cut")  # templates of a host: as many as its styles

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, sets = [Page(x, rule) for x in batch.column(2).to_pylist()], [[frozenset(x or ()) for x in batch.column(k).to_pylist()] for k in range(3, 7)]
            texts = [p.main(*x) for p, *x in zip(pages, *sets)]
            counts = [len(p.blocks) for p in pages], [sum(p.low(low, high)) for p, low, high in zip(pages, *sets[:2])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in counts)], names=["id", "url", "text", "n_blocks", "n_low"])

    out = pages.join(cut, "host", "left").select("id", "url", "html", "low", "high", "good", "bad").mapInArrow(keep, f"id {kind}, url string, text string, n_blocks long, n_low long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_low")
