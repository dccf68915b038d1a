"""URL filters by rules and by the reputation of hosts, in DataFrame functions alone.

Rules decide the URLs they fit, the longest first. Any other URL is judged by its host: the
host's share of bad pages has a beta-binomial posterior whose prior is centred on the
posterior mean of the host's registered domain, the domain's on that of its suffix, and the
suffix's on that of all pages. How strongly each level is pulled to the one above is
estimated from how much the shares below one parent differ (moments of the
beta-binomial). A URL is blocked where even the lower posterior bound of its host's bad share
reaches the limit, which is asked as: is at least ``confidence`` of the posterior above it?
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_by_share

#: Public suffixes of two labels that are common; all others are taken to have one.
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "org.nz", "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp", "co.kr", "or.kr",
    "com.br", "org.br", "gov.br", "com.cn", "net.cn", "org.cn", "edu.cn", "gov.cn", "com.tw", "org.tw", "com.hk", "com.sg", "co.in", "net.in", "org.in", "com.mx", "com.ar", "com.tr", "co.za", "co.il", "com.ua", "com.pl",
)


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    def __post_init__(self):
        if self.verdict not in ("allow", "block") or not self.host:
            raise ValueError(f"no such rule: {self}")

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Reputation:
    """Block where the bad share is ``limit`` or more with a posterior chance of ``confidence`` at least.

    ``least`` and ``most`` bound the strength of a prior, in pages.
    """

    limit: float = 0.5
    confidence: float = 0.95
    least: float = 2.0
    most: float = 1000.0


# ------------------------------------------------------------------ parts of a URL

def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``, and for null."""
    return F.translate(F.regexp_extract(_after(url), r"(?s)\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"(?s)\A[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The public suffix of a host, without user, port and a closing dot; empty for a host of digits and dots, or in brackets."""
    name = _name(host)
    return F.when(_address(name), F.lit("")).otherwise(_tail(name, F.when(F.substring_index(name, ".", -2).isin(*suffixes), 2).otherwise(1)))


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registered domain: the suffix and the label before it; an address is its own."""
    name = _name(host)
    return F.when(_address(name), name).otherwise(_tail(name, F.when(F.substring_index(name, ".", -2).isin(*suffixes), 3).otherwise(2)))


def _name(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)\A.*@", ""), r":[0-9]*\z", ""), r"\.+\z", "")


def _address(name: Column) -> Column:
    return name.rlike(r"\A(?:[0-9]+(?:\.[0-9]+)*|\[.*)\z")


def _tail(name: Column, labels: Column) -> Column:
    return F.when(labels == 1, F.substring_index(name, ".", -1)).when(labels == 2, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -3))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))


def longest(rules: list[Rule], host: Column, path: Column) -> Column:
    """(name, verdict) of the longest rule that fits, else null; of equal lengths the longer host, then block, goes first."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.verdict != "block", r.name))
    struct = "struct<name:string,verdict:string>"
    found = [F.when(fits(r, host, path), F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))) for r in ordered]
    return F.coalesce(*found, F.lit(None).cast(struct))


# ------------------------------------------------------------------ the beta distribution

def _log_gamma(z: Column) -> Column:
    """Stirling's series, eight steps up; within 1e-12 of the true value for positive ``z``."""
    w = z + 8
    below = reduce(lambda a, b: a * b, [z + i for i in range(8)])
    series = 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5) - 1 / (1680 * w**7)
    return (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + series - F.log(below)


def share_above(df: DataFrame, a: str, b: str, x: float, out: str) -> DataFrame:
    """Adds ``out``: the part of a beta distribution (a, b) above ``x``, by its continued fraction.

    The fraction has as many steps as its convergence needs (their number grows with the root of a + b), so it
    holds for counts of any size; the smaller tail is the one computed.
    """
    # beyond the mean the fraction of the other tail converges fast
    turn = F.lit(x) > (F.col(a) + 1) / (F.col(a) + F.col(b) + 2)
    side = F.when(turn, F.struct(F.col(b).alias("p"), F.col(a).alias("q"), F.lit(1 - x).alias("x"))).otherwise(F.struct(F.col(a).alias("p"), F.col(b).alias("q"), F.lit(x).alias("x")))
    rows = df.select("*", side.alias("_s"), turn.alias("_turn"))
    p, q, t = F.col("_s.p"), F.col("_s.q"), F.col("_s.x")
    steps = 2 * (60 + F.ceil(4 * F.sqrt(p + q)).cast("int"))

    def factor(k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1))
        return F.when(k % 2 == 0, even).otherwise(odd)

    safe = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))
    step = lambda s, f: state(safe(1 + f / s["c"]), 1 / safe(1 + f * s["d"]), s["h"] * safe(1 + f / s["c"]) / safe(1 + f * s["d"]))
    factors = F.transform(F.sequence(F.lit(1), steps), factor)
    fraction = F.aggregate(factors, state(F.lit(1e300), F.lit(1.0), F.lit(1.0)), step, lambda s: s["h"])  # c is infinite before the first step
    front = F.exp(p * F.log(t) + q * F.log(1 - t) + _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q)) / p
    tail = F.least(F.greatest(front * fraction, F.lit(0.0)), F.lit(1.0))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col("_turn"), tail).otherwise(1 - tail).alias(out))


# ------------------------------------------------------------------ reputation

def _level(rows: DataFrame, rule: Reputation) -> DataFrame:
    """``rows`` (n, bad, centre, ...) with ``strength`` of their prior, one for the level, and the posterior's ``mean``."""
    spread = F.col("centre") * (1 - F.col("centre"))
    moments = rows.agg(F.sum((F.col("bad") - F.col("n") * F.col("centre")) ** 2 - F.col("n") * spread).alias("over"), F.sum(F.col("n") * (F.col("n") - 1.0) * spread).alias("room"))  # one row
    alike = F.when(F.col("room") > 0, F.greatest(F.least(F.col("over") / F.col("room"), F.lit(1 / (1 + rule.least))), F.lit(1 / (1 + rule.most)))).otherwise(F.lit(1 / (1 + rule.most)))
    rows = rows.join(F.broadcast(moments.select((1 / alike - 1).alias("strength"))))
    return rows.withColumn("mean", (F.col("bad") + F.col("strength") * F.col("centre")) / (F.col("n") + F.col("strength")))


def reputation(hosts: DataFrame, rule: Reputation, suffixes: tuple[str, ...], space: Workspace) -> DataFrame:
    """(host, pages, n, bad, mean, above) of (host, pages, n, bad): one row a host, judged pages and bad ones among them.

    ``above`` is the posterior chance that the host's bad share is the limit or more. A host
    without judged pages has its domain's mean. Each level is summed by partial sums, and a
    domain or suffix of very many hosts gives them its mean by a broadcast of bounded size.
    """
    rows = hosts.select("host", "pages", "n", "bad", domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix"))
    up = lambda t, *keys: t.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("below"))
    domains = space.stow(up(rows, "domain", "suffix"), "domains")
    tops = up(domains, "suffix")
    whole = tops.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("centre"))  # one row
    tops = space.stow(_level(tops.join(F.broadcast(whole)), rule), "suffixes")
    centre = lambda t, key: t.select(key, F.col("mean").alias("centre"), "below")
    domains = space.stow(_level(join_by_share(domains, centre(tops, "suffix"), "suffix", "below"), rule), "domains")
    judged = _level(join_by_share(rows, centre(domains, "domain"), "domain", "below"), rule)
    judged = judged.select("host", "pages", "n", "bad", "mean", (F.col("bad") + F.col("strength") * F.col("centre")).alias("_a"), (F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("centre"))).alias("_b"))
    return share_above(judged, "_a", "_b", rule.limit, "above").drop("_a", "_b")


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", rule: Reputation = Reputation(), suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``id, host, path, rule, verdict, host_judged, host_bad`` of every row of ``pages``.

    ``outcomes``: (host, n, bad), judged pages of a host and bad ones among them; rows of one host add up,
    and nulls count nothing. A null URL, or one without ``://``, has an empty host and path, is
    fitted by no rule and has the reputation of the empty host. Null ids stay, repeated rows
    are judged each. Ties between rules of one length go to the longer host, then to block. Empty
    tables give an empty one. Other columns are dropped, so names cannot clash. A host may have any
    part of the rows: counts are summed before the shuffle, and its verdict is sent to its rows.
    """
    space = Workspace(pages.sparkSession, "url-filter")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    none = F.lit(0).cast("long")
    counted = rows.select("host", F.lit(1).cast("long").alias("pages"), none.alias("n"), none.alias("bad"))
    counted = counted.unionByName(outcomes.select(F.coalesce("host", F.lit("")).alias("host"), none.alias("pages"), F.coalesce(F.col("n").cast("long"), none).alias("n"), F.coalesce(F.col("bad").cast("long"), none).alias("bad")))
    hosts = space.stow(counted.groupBy("host").agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.sum("bad").alias("bad")), "hosts")
    judged = space.stow(reputation(hosts, rule, suffixes, space), "reputation")
    out = join_by_share(rows, judged, "host", "pages").withColumn("found", longest(rules, F.col("host"), F.col("path")))
    verdict = F.coalesce(F.col("found")["verdict"], F.when(F.col("above") >= rule.confidence, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("found")["name"].alias("rule"), verdict.alias("verdict"), F.col("n").alias("host_judged"), F.col("bad").alias("host_bad"))


def page_outcomes(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """(host, n, bad) of pages whose document is labelled: the first part of the path that is a number, alone or before a dot, names it.

    A document is bad if any of its labels says low quality or toxic; labels that are null say nothing.
    Pages are counted by host and document before they meet the labels.
    """
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("doc")).agg(F.max(bad).alias("is_bad")).where("is_bad is not null")
    url = F.col(f"`{url_col}`")
    rows = pages.select(host_of(url).alias("host"), F.regexp_extract(path_of(url), r"/([0-9]+)(?:\.[A-Za-z]+)?(?:/|\z)", 1).alias("doc")).where("doc <> ''")
    rows = rows.groupBy("host", "doc").agg(F.count(F.lit(1)).alias("n")).join(known, "doc")
    return rows.groupBy("host").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("is_bad")).alias("bad"))
