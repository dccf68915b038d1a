"""Fill-in-the-middle: a text is cut at two units and its middle moved behind marks.

The units are matches of a pattern. A text is passed over twice by a lazy iterator of
matches: the first pass counts the units, the second goes to the two drawn ranks and
keeps the ends of the two matches there. No list of units is ever made, so beside the text and its
output a worker holds one match, whatever the text's length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices

#: A word with the white space before it, or white space that no word follows.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Middle:
    """``rate`` percent of texts are cut, and ``spm`` percent of those have the suffix first."""

    seed: int = 42
    rate: int = 50
    spm: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = UNIT

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or not all(marks):
            raise ValueError("three different marks are needed")
        for a in marks:  # a mark must not begin inside another, or the text could be cut there when it is rebuilt
            for b in marks:
                if a != b and a in b or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)))):
                    raise ValueError(f"marks overlap: {a} and {b}")


def draws(doc_id, seed: int) -> tuple[int, ...]:
    """Four numbers below 2 ** 32 that hang on the seed and the id alone; a null id counts as the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def count_units(unit: re.Pattern, text: str) -> int:
    n = 0
    for n, _ in enumerate(unit.finditer(text), 1):  # noqa: B007
        pass
    return n


def ends(unit: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Where the ``low``-th and the ``high``-th unit end (low <= high); the zeroth ends at 0."""
    matches, at, place = unit.finditer(text), [0, 0], 0
    for k, rank in enumerate((low, high)):
        at[k] = at[k - 1] if k else 0
        if rank > place:
            at[k] = next(islice(matches, rank - place - 1, None)).end()
            place = rank
    return at[0], at[1]


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Middle = Middle()) -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` of every row: its units, plain or psm or spm, and the new text.

    A null text counts as an empty one. Texts that are empty, hold a mark, or are not drawn stay plain, with
    null lengths. A text of white space alone is one unit. Rows that repeat an id draw alike;
    equal ranks give an empty middle. An empty table gives an empty one. Other columns are
    dropped, so names cannot clash. Texts are read whole; a worker holds a slice of them or the longest one.
    """
    bound_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, marks = re.compile(rule.unit), (rule.prefix, rule.suffix, rule.middle)
        for batch in batches:
            for part in slices(batch, "text"):
                ns, forms, firsts, middles, outs = [], [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    text = text.as_py() or ""
                    h1, h2, h3, h4 = draws(doc_id, rule.seed)
                    n = count_units(unit, text)
                    ns.append(n)
                    if not text or h3 % 100 >= rule.rate or any(m in text for m in marks):
                        forms.append("plain")
                        firsts.append(None)
                        middles.append(None)
                        outs.append(text)
                        continue
                    a, b = ends(unit, text, *sorted((h1 % (n + 1), h2 % (n + 1))))
                    spm = h4 % 100 < rule.spm
                    forms.append("spm" if spm else "psm")
                    firsts.append(a)
                    middles.append(b - a)
                    head, tail = rule.prefix + text[:a], rule.suffix + text[b:]
                    outs.append((tail + head if spm else head + tail) + rule.middle + text[a:b])
                columns = [part.column(0), pa.array(ns, pa.int64()), pa.array(forms, pa.string()), pa.array(firsts, pa.int64()), pa.array(middles, pa.int64()), pa.array(outs, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    out = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, rule: Middle = Middle()) -> Column:
    """The text that ``transform`` was given, from its output and form alone, on the JVM."""

    def between(first: str, second: str) -> Column:
        # the marks are met once each, in the order of the form
        a = F.locate(second, output)
        head, rest = F.substring(output, F.lit(len(first) + 1), a - 1 - len(first)), F.substring(output, a + len(second), F.length(output))
        end = F.substring_index(rest, rule.middle, 1)
        last = F.substring(rest, F.length(end) + len(rule.middle) + 1, F.length(rest))
        return F.concat(head, last, end) if first == rule.prefix else F.concat(end, last, head)

    return F.when(form == "psm", between(rule.prefix, rule.suffix)).when(form == "spm", between(rule.suffix, rule.prefix)).otherwise(output)
