"""Language identification of words, by script and by Viterbi.

The script of a word narrows its languages to those that were seen in that script. Each
word is scored for each of them by its byte trigrams. A Viterbi pass over a text's words,
with a penalty for each switch of language, labels spans, so a text in several languages is
cut where they change; the language with the most letters is the text's own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, sums, text_parts, word_spans

BITS = 15
#: Fixed values: (first code point, last, script) of the blocks that hold letters of the larger scripts.
SCRIPTS = (
    (0x41, 0x5A, 0), (0x61, 0x7A, 0), (0xAA, 0xAA, 0), (0xB5, 0xB5, 0), (0xBA, 0xBA, 0), (0xC0, 0xD6, 0), (0xD8, 0xF6, 0), (0xF8, 0x24F, 0), (0x1E00, 0x1EFF, 0),
    (0x370, 0x373, 1), (0x376, 0x377, 1), (0x37B, 0x37D, 1), (0x386, 0x386, 1), (0x388, 0x3FF, 1), (0x1F00, 0x1FFF, 1),
    (0x400, 0x481, 2), (0x48A, 0x52F, 2), (0x531, 0x556, 3), (0x561, 0x587, 3), (0x5D0, 0x5F2, 4), (0x620, 0x64A, 5), (0x671, 0x6D3, 5), (0x750, 0x77F, 5),
    (0x904, 0x939, 6), (0x985, 0x9B9, 7), (0xA05, 0xA39, 8), (0xA85, 0xAB9, 9), (0xB05, 0xB39, 10), (0xB85, 0xBB9, 11), (0xC05, 0xC39, 12), (0xC85, 0xCB9, 13), (0xD05, 0xD3A, 14), (0xD85, 0xDC6, 15),
    (0xE01, 0xE30, 16), (0xE81, 0xEB0, 17), (0xF40, 0xF6C, 18), (0x1000, 0x102A, 19), (0x10A0, 0x10FF, 20), (0x1100, 0x11FF, 21), (0xAC00, 0xD7A3, 21), (0x1200, 0x135A, 22), (0x1780, 0x17B3, 23),
    (0x3041, 0x3096, 24), (0x30A1, 0x30FA, 24), (0x3400, 0x4DBF, 25), (0x4E00, 0x9FFF, 25), (0x20000, 0x323AF, 25),
)
#: The parts of the blocks that Unicode counts as letters: marks, symbols and places without a character are none.
LETTERS = tuple(
    (run[0], run[-1], kind)
    for first, last, kind in sorted(SCRIPTS)
    for _, group in itertools.groupby(enumerate(c for c in range(first, last + 1) if chr(c).isalpha()), lambda x: x[1] - x[0])
    for run in [[c for _, c in group]]
)
_FROM, _TO, _KIND = (np.array(x) for x in zip(*LETTERS))
N_SCRIPTS = 26

#: Letters as they are, lower-cased; bytes beyond ASCII as they are; all else is an edge (0).
_FOLD = np.zeros(256, np.uint8)
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Rule:
    """``penalty``: log odds that a switch must gain. ``most``: clip of one word's log odds."""

    penalty: float = 8.0
    most: float = 6.0
    smooth: float = 0.5
    cells: int = 8_000_000


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of letters' first bytes, and their scripts."""
    ascii_at = np.flatnonzero((_FOLD[data] > 0) & (data < 128))
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return ascii_at, np.zeros(len(ascii_at), np.int64)
    pad = np.concatenate([data, np.zeros(3, np.uint8)])
    b = [pad[lead + k].astype(np.int64) & (0xFF if k == 0 else 0x3F) for k in range(4)]
    two, three = (b[0] & 0x1F) << 6 | b[1], (b[0] & 0x0F) << 12 | b[1] << 6 | b[2]
    code = np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, (b[0] & 7) << 18 | b[1] << 12 | b[2] << 6 | b[3]))
    k = np.searchsorted(_FROM, code, side="right") - 1
    good = (k >= 0) & (code <= _TO[np.maximum(k, 0)])
    at = np.concatenate([ascii_at, lead[good]])
    kind = np.concatenate([np.zeros(len(ascii_at), np.int64), _KIND[k[good]]])
    order = np.argsort(at, kind="stable")
    return at[order], kind[order]


def trigrams(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams centred on each byte of the words, and each word's first (n + 1).

    A word's neighbours count as edges, and so do its marks and digits.
    """
    size = end - begin
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(first[-1]) + np.repeat(begin - first[:-1], size)
    c = _FOLD[data[at]].astype(np.uint32)
    left, right = np.zeros_like(c), np.zeros_like(c)
    left[1:], right[:-1] = c[:-1], c[1:]
    full = first[:-1][size > 0]
    left[full] = 0
    right[first[1:][size > 0] - 1] = 0
    h = (left << np.uint32(16) | c << np.uint32(8) | right) * np.uint32(0x9E3779B1)
    bucket = (h >> np.uint32(32 - BITS)).astype(np.int32)
    bucket[c == 0] = -1
    return bucket, first


class Languages:
    def __init__(self, names: list[str], counts: np.ndarray, scripts: np.ndarray, rule: Rule):
        """``counts``: languages x buckets; ``scripts``: languages x scripts, in letters."""
        self.names, self.rule = names, rule
        total = counts.sum(1, keepdims=True) + rule.smooth * counts.shape[1]
        table = np.log((counts + rule.smooth) / total).T if names else np.zeros((counts.shape[1], 0))
        self.table = np.concatenate([table - table.mean(1, keepdims=True) if names else table, np.zeros((1, len(names)))]).astype(np.float32)  # the last row is for edges
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        use = (share >= 0.01).T  # scripts x languages
        self.use = np.where(use.any(1, keepdims=True), use, True)

    def word_scores(self, data, begin, end, word_script) -> np.ndarray:
        bucket, first = trigrams(data, begin, end)
        s = sums(self.table[bucket], first)
        out = ~self.use[np.maximum(word_script, 0)] & (word_script >= 0)[:, None]
        s[out] = -np.inf
        s -= s.max(1, keepdims=True) if s.shape[1] else 0
        s = np.maximum(s, -self.rule.most)
        s[out] -= 50  # after the bound: trigrams may be outweighed by the words around, a script may not
        s[word_script < 0] = 0
        return s

    def path(self, s: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best language of each word: one Viterbi pass, all texts side by side."""
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        begin, n = first[:-1][order], n[order]
        active = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), side="left")  # texts longer than t
        v = np.zeros((len(n), s.shape[1]), np.float32)
        back = np.empty(s.shape, np.int8 if s.shape[1] < 128 else np.int32)
        own = np.arange(s.shape[1])
        for t, a in enumerate(active):
            at, now = begin[:a] + t, v[:a]
            best = now.argmax(1)
            jump = now[np.arange(a), best][:, None] - self.rule.penalty
            stay = now >= jump
            back[at] = np.where(stay, own, best[:, None])
            v[:a] = np.where(stay, now, jump) + s[at]
        state = v.argmax(1)
        out = np.empty(len(s), np.int64)
        for t in range(len(active) - 1, -1, -1):
            a = active[t]
            at = begin[:a] + t
            out[at] = state[:a]
            state[:a] = back[at, state[:a]]
        return out


def _scripted(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's script (of its first letter; -1 without one) and its letters."""
    at, kind = letters(data)
    lo, hi = np.searchsorted(at, begin), np.searchsorted(at, end)
    script = np.full(len(begin), -1, np.int64)
    has = hi > lo
    script[has] = kind[lo[has]]
    return script, hi - lo


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", rule: Rule = Rule()) -> Languages:
    """Counts over all rows with a language: trigrams and scripts, summed in Spark.

    What reaches the driver is (languages) x (buckets + scripts) sums at most. Rows with a null
    language and null or empty texts add nothing (a language with nothing else is still one);
    repeated rows count each; an empty table gives no language, and ``label`` then ``und``.
    """
    rows = df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    width = (1 << BITS) + N_SCRIPTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                names = part.column(0).to_pylist()
                data, offs = text_parts(part.column(1))
                begin, end, first = word_spans(data, offs)
                bucket, starts = trigrams(data, begin, end)
                at, kind = letters(data)
                edges = starts[first]
                for k, name in enumerate(names):
                    here = total.setdefault(name, np.zeros(width, np.int64))
                    b = bucket[edges[k] : edges[k + 1]]
                    here[: 1 << BITS] += np.bincount(b[b >= 0], minlength=1 << BITS)
                    lo, hi = np.searchsorted(at, offs[k : k + 2])
                    here[1 << BITS :] += np.bincount(kind[lo:hi], minlength=N_SCRIPTS)
        for name, here in total.items():
            k = np.flatnonzero(here)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k), pa.array(here[k])], names=["lang", "k", "n"])

    got = rows.mapInArrow(run, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((len(names), width))
    if names:
        row = np.searchsorted(np.array(names), np.array(got.column("lang").to_pylist()))
        counts[row, got.column("k").to_numpy()] = got.column("n").to_numpy()
    return Languages(names, counts[:, : 1 << BITS], counts[:, 1 << BITS :], rule)


def label(df: DataFrame, languages: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, lang_spans) of each row.

    ``score`` is the share of letters in the language's words; ``lang_spans`` has
    (first word, end word, language). A text that is null or has no letter is ``und`` with
    score 0, and so is any text if no language was learned; a script that no language
    has leaves all of them open. Ties go to the first name. Repeated rows are labelled each;
    an empty table gives an empty one; other columns are dropped, so names cannot clash. Texts
    are read whole, some side by side: about 6 bytes a word and language of the longest one.
    """
    known = df.sparkSession.sparkContext.broadcast(languages)  # languages x buckets
    kind = df.schema[id_col].dataType.simpleString()
    span = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def spans(path, first, names) -> pa.Array:
        new = np.ones(len(path), bool)
        new[1:] = path[1:] != path[:-1]
        new[first[:-1][np.diff(first) > 0]] = True
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(path))
        base = np.repeat(first[:-1], np.diff(first))
        value = pa.StructArray.from_arrays([pa.array(at - base[at]), pa.array(end - base[at]), pa.array(names, pa.string()).take(pa.array(path[at]))], fields=list(span))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first).astype(np.int32)), value)

    def part_labels(part: pa.RecordBatch, m: Languages) -> pa.RecordBatch:
        n_lang = len(m.names)
        offs_all, scored, weights = [0], [], []
        for piece in slices(part, "text"):
            data, offs = text_parts(piece.column(1))
            begin, end, first = word_spans(data, offs)
            script, n = _scripted(data, begin, end)
            scored.append(m.word_scores(data, begin, end, script))
            weights.append(n)
            offs_all += (first[1:] + offs_all[-1]).tolist()
        first, s, n = np.array(offs_all), np.concatenate(scored), np.concatenate(weights)
        path = m.path(s, first)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        votes = np.bincount(doc * n_lang + path, weights=n, minlength=(len(first) - 1) * n_lang).reshape(-1, n_lang)
        best, total = votes.argmax(1), votes.sum(1)
        names = [m.names[b] for b in best]
        score = votes[np.arange(len(best)), best] / np.maximum(total, 1)
        for k in np.flatnonzero(total == 0):
            text = part.column(1)[int(k)].as_py() or ""
            if not any(ch.isalpha() for ch in text):
                names[k] = "und"
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), spans(path, first, m.names)], names=["id", "lang_pred", "score", "lang_spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            if not m.names:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["und"] * n), pa.array([0.0] * n), pa.array([[]] * n, pa.list_(span))], names=["id", "lang_pred", "score", "lang_spans"])
                continue
            # as many texts side by side as memory allows: about six bytes a word
            for part in slices(batch, "text", m.rule.cells // len(m.names) * 6):
                yield part_labels(part, m)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, lang_spans array<struct<first: bigint, end: bigint, lang: string>>")
    return out.withColumnRenamed("id", id_col)
