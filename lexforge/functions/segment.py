"""A tokeniser for text without spaces: the most probable path over a lattice of dictionary words.

A run of letters is cut into dictionary words and single characters so that the product of the
words' shares is largest; neighbouring characters that are no words are an unknown run, cut by a model of
characters at the begin, middle and end of words, which is counted from the dictionary too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import bound_batches

#: Words that every task may hold; a longer dictionary is an error.
MOST_WORDS = 1 << 21
#: Runs of Latin letters and digits, numbers with their decimals and per cent, and runs of any other letters.
MIXED = re.compile(r"([a-z0-9]+(?:\.[0-9]+)?%?)|([^\W_a-z0-9]+)")
#: Runs of any letters and digits.
ANY = re.compile(r"(?!)()|([^\W_]+)")
#: What may follow a character at the begin, in the middle, at the end of a word, and one that is a word.
NEXT = {"B": "ME", "M": "ME", "E": "BS", "S": "BS"}


@dataclass(frozen=True)
class Dictionary:
    """Logarithms of words' shares, of prefixes (minus infinity if no words), and the model of unknown runs."""

    share: dict[str, float]
    least: float
    emit: dict[str, dict[str, float]]
    unseen: dict[str, float]
    step: dict[str, float]

    @staticmethod
    def of(counts: dict[str, int]) -> Dictionary:
        """``counts``: how often each word occurs, above 0."""
        total = sum(counts.values())
        share = {word[:i]: -math.inf for word in counts for i in range(1, len(word))}
        share.update({word: math.log(n / total) for word, n in counts.items()})
        seen: dict[str, Counter] = {tag: Counter() for tag in NEXT}
        steps: Counter = Counter()
        for word, n in counts.items():
            tags = "S" if len(word) == 1 else "B" + "M" * (len(word) - 2) + "E"
            for tag, c in zip(tags, word):
                seen[tag][c] += n
            for pair in zip(tags, tags[1:]):
                steps["".join(pair)] += n
        for tag in "ES":  # the next word begins as words do
            steps[tag + "B"], steps[tag + "S"] = seen["B"].total(), seen["S"].total()
        letters = len({c for word in counts for c in word}) + 1
        sure = lambda tag, to: (steps[tag + to] + 1) / (sum(steps[tag + x] for x in NEXT[tag]) + 2)
        return Dictionary(
            share,
            math.log(1 / (total + 1)),
            {tag: {c: math.log((n + 1) / (seen[tag].total() + letters)) for c, n in seen[tag].items()} for tag in NEXT},
            {tag: math.log(1 / (seen[tag].total() + letters)) for tag in NEXT},
            {tag + to: math.log(sure(tag, to)) for tag in NEXT for to in NEXT[tag]},
        )

    def cut(self, run: str) -> list[str]:
        """Words of a run of letters; their concatenation is the run."""
        out: list[str] = []
        unknown = ""
        for piece in self.path(run):
            if piece not in self.share or self.share[piece] == -math.inf:
                unknown += piece
                continue
            out += self.guess(unknown)
            unknown = ""
            out.append(piece)
        return out + self.guess(unknown)

    def path(self, run: str) -> list[str]:
        """The most probable cut into words and single characters; ties go to the longest last word."""
        n = len(run)
        best, came = [-math.inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            for j in range(i + 1, n + 1):
                p = self.share.get(run[i:j])
                if p is None and j > i + 1:
                    break
                if p is None or p == -math.inf:
                    if j > i + 1:
                        continue
                    p = self.least
                if here + p > best[j]:  # an earlier begin stays where it ties
                    best[j], came[j] = here + p, i
                if j == i + 1 and run[i:j] not in self.share:
                    break
        out, i = [], n
        while i:
            out.append(run[came[i]:i])
            i = came[i]
        return out[::-1]

    def guess(self, run: str) -> list[str]:
        """An unknown run cut by the most probable tags; ties go to the first of B, M, E, S at the end, then before."""
        if len(run) < 2:
            return [run] if run else []
        at = lambda tag, c: self.emit[tag].get(c, self.unseen[tag])
        score = {"B": self.step["EB"] + at("B", run[0]), "S": self.step["ES"] + at("S", run[0])}
        back: list[dict[str, str]] = []
        for c in run[1:]:
            now, came = {}, {}
            for tag in "BMES":
                for before in "BMES":
                    if before in score and tag in NEXT[before]:
                        s = score[before] + self.step[before + tag] + at(tag, c)
                        if tag not in now or s > now[tag]:
                            now[tag], came[tag] = s, before
            score = now
            back.append(came)
        tag = max("ES", key=lambda t: score.get(t, -math.inf))  # a run ends where a word does
        tags = [tag]
        for came in reversed(back):
            tags.append(came[tags[-1]])
        out = [""]
        for tag, c in zip(reversed(tags), run):
            if tag in "BS" and out[-1]:
                out.append("")
            out[-1] += c
        return out

    def tokens(self, text: str | None, runs: re.Pattern[str] = MIXED) -> list[str]:
        out: list[str] = []
        for m in runs.finditer((text or "").lower()):
            out += [m[1]] if m[1] else self.cut(m[2])
        return out


def dictionary(words: DataFrame) -> Dictionary:
    """From (word, n): repeated words add up in lower case; null and empty words, words with white space and n not above 0 are left out."""
    word = F.lower("word")
    rows = words.where((F.length("word") > 0) & (F.col("n") > 0) & ~F.col("word").rlike(r"(?U)\s")).groupBy(word.alias("word")).agg(F.sum("n").alias("n"))
    held = rows.limit(MOST_WORDS + 1).toArrow()
    if held.num_rows > MOST_WORDS:
        raise ValueError(f"the dictionary has over {MOST_WORDS} words")
    if not held.num_rows:
        raise ValueError("the dictionary is empty")
    return Dictionary.of(dict(zip(held.column("word").to_pylist(), held.column("n").to_pylist())))


def segmenter(words: DataFrame, runs: re.Pattern[str] = MIXED) -> Callable[[Column], Column]:
    """A tokeniser that BM25 and sparse search take as ``tokens``: lower case, parts without a letter or digit dropped.

    A null or empty text has no tokens. With ``ANY``, runs of Latin letters are cut too, as in
    text that lost its spaces.
    """
    bound_batches(words.sparkSession)
    sent = words.sparkSession.sparkContext.broadcast(dictionary(words))

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        known = sent.value
        return pd.Series([known.tokens(t, runs) for t in texts], dtype=object)

    return lambda text: cut(text)
