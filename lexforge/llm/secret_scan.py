"""Secret scans by token efficiency.

Three fixed patterns give the base spans. The method adds strings that a tiktoken
vocabulary spells badly: text of any language takes few tokens for its length, a random
string takes many, so a low number of characters per token exposes it. Candidates are runs of
letters, digits and the marks of base64, and what is assigned to a secret's name, whatever
its marks. Strings known to be harmless are excluded: digests of usual lengths, UUIDs,
numbers, and identifiers made of words. The shape of a word is not enough: its parts must be
spelt well by the vocabulary, together and each long one by itself.

A run may be a path: of its segments between slashes, the stretch with the largest excess of
tokens is the span, so plain segments around a key are neither masked nor thin out its ratio.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

KINDS = ("assign", "access", "hex", "random")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published splitting pattern of that vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is as long as it can be, so this is [0-9a-f]+ of 16 or more
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]"
#: A run's segments: what lies between slashes or before an assignment; marks that pad a key stay with it.
SEGMENT = re.compile(r"[^/=]+=*")
#: What is assigned to a name of the first pattern, with any marks but quotes.
NAMED = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
VALUE = re.compile(NAMED + r"""\x20*["']?([\x21\x23-\x26\x28-\x7E]+)""", re.ASCII | re.IGNORECASE)
#: What all matches of the first pattern and of VALUE begin with.
NAMED = re.compile(NAMED, re.ASCII | re.IGNORECASE)
#: Hex lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = frozenset({32, 40, 56, 64, 96, 128})
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: A word: one case, or capitals that each begin a part of three letters or more.
WORD = re.compile(r"[a-z]+|[A-Z]+|[A-Z]?[a-z]*(?:[A-Z][a-z]{2,})*")


@dataclass(frozen=True)
class Efficiency:
    """A run is random if it has fewer than ``ratio`` characters a token.

    ``least``: characters of a run that is judged; ``least_letters``: of one whose parts all
    have the shape of words, since texts have words of nearly that length that a vocabulary of
    another language spells badly. ``least_value``: of a value that is assigned to a
    secret's name. ``part``: letters from which a part of an identifier is judged, with the
    other parts (one or two letters are a token or two in any text); ``long_part``: alone.
    """

    vocabulary: str = VOCABULARY
    ratio: float = 2.2
    least: int = 16
    least_letters: int = 20
    least_value: int = 12
    part: int = 3
    long_part: int = 12


def _encoder(rule: Efficiency):
    import tiktoken

    with open(rule.vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def known(run: str) -> bool:
    """Digests and UUIDs, which are no secrets however badly they are spelt."""
    core = run.strip("+/_=-")
    return bool(len(core) in DIGESTS and DIGEST.fullmatch(core) or UUID.fullmatch(core))


def excess(run: str, rule: Efficiency, encoder) -> tuple[float, bool]:
    """Tokens beyond what the ratio allows, in characters: over 0 if the run is random, 0 if there is nothing
    to judge; and whether all its parts have the shape of words."""
    parts = [p for p in re.split(r"[^A-Za-z0-9]+", run) if p and not p.isdigit() and not known(p)]
    if not all(map(WORD.fullmatch, parts)):
        return rule.ratio * len(encoder.encode_ordinary(run)) - len(run), False
    total, alone = 0.0, 0.0
    for p in parts:
        if len(p) >= rule.part:
            n = min(len(encoder.encode_ordinary(x)) for x in {p, p.lower()})  # capitals spell a word badly
            total += rule.ratio * n - len(p)
            if len(p) >= rule.long_part:
                alone = max(alone, rule.ratio * n - len(p))
    return alone or total, True


def stretch(run: str, rule: Efficiency, encoder) -> tuple[int, int] | None:
    """Start and end of the run's segments with the largest excess together; None if they are no random string.

    Known strings split a run; the stretch begins and ends with a random segment, and one of
    its random segments is long, so short names with digits don't add up to a key.
    """
    best, now = (0.0, 0, 0, False, True), None
    for m in SEGMENT.finditer(run):
        if known(m[0]):
            now = None
            continue
        value, shaped = excess(m[0], rule, encoder)
        if now is None or now[0] <= 0:
            now = (0.0, m.start(), False, True)
        now = (now[0] + value, now[1], now[2] or value > 0 and len(m[0]) >= rule.long_part, now[3] and shaped)
        if now[0] > best[0]:
            best = (now[0], now[1], m.end(), now[2], now[3])
    total, start, end, long, shaped = best
    return (start, end) if total > 0 and long and end - start >= (rule.least_letters if shaped else rule.least) else None


def find(text: str, rule: Efficiency, encoder) -> list[tuple[int, int, int]]:
    """All spans of a text as (start, kind's place in KINDS, end), sorted."""
    named = NAMED.search(text)
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if named else []
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted(spans)
    found = {(m.start() + at[0], m.start() + at[1]) for m in re.finditer(f"{RUN}{{{rule.least},}}", text) if (at := stretch(m[0], rule, encoder))}
    for m in VALUE.finditer(text) if named else ():
        value = m[1].rstrip(".,;:!?)]}>")
        if len(value) >= rule.least_value and not re.fullmatch(f"{RUN}+", value) and excess(value, rule, encoder)[0] > 0:
            found = {x for x in found if x[1] <= m.start(1) or x[0] >= m.start(1) + len(value)} | {(m.start(1), m.start(1) + len(value))}
    spans += [(x, 3, y) for x, y in found if not any(a <= x and y <= b for a, _, b in base)]
    return sorted(spans)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Efficiency = Efficiency()) -> DataFrame:
    """One row per input row: the id, counts per kind, the base spans' digest and all spans.

    Null and empty texts have no spans. Repeated rows are scanned each; an empty table gives
    an empty one; stretches of equal excess go to the first (ties). Other columns are dropped,
    so their names cannot clash. Null ids stay null. A text is read whole and alone, so memory
    is bounded by the longest one.
    """
    bound_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(rule)
        for batch in batches:
            found = [find(t or "", rule, encoder) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(k == i for _, k, _ in s) for s in found], pa.int64()) for i in range(4)]
            sha = [hashlib.sha256(written([x for x in s if x[1] < 3]).encode()).hexdigest() for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sha, pa.string()), pa.array(list(map(written, found)), pa.string())], names=[id_col, "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def redact(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]", rule: Efficiency = Efficiency()) -> DataFrame:
    """The same rows and columns, each secret in ``text_col`` replaced by ``mask``.

    Null and empty texts stay as they are, repeated rows are masked alike, spans that overlap
    are one mask, and an empty table gives an empty one. Columns keep their names and values.
    """

    bound_batches(df.sparkSession)

    def clean(text: str | None, encoder) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for a, _, b in find(text, rule, encoder):
            if a >= at:
                out += [text[at:a], mask]
            at = max(at, b)
        return "".join(out) + text[at:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(rule)
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            texts = pa.array([clean(t, encoder) for t in batch.column(k).to_pylist()], batch.schema.field(k).type)
            yield batch.set_column(k, batch.schema.field(k), texts)

    return df.mapInArrow(run, df.schema)
