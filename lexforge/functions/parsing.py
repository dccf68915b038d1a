"""Parsing of what models return."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import valid_or_null
from .text import WS, evidence_paragraphs, ustrip

#: Names of retrieval strategies as models may write them.
STRATEGIES = {
    "直接检索": "direct",
    "假设问题检索": "hyde",
    "hyde检索": "hyde",
    "子查询检索": "subquery",
    "子问题检索": "subquery",
    "回溯问题检索": "backtracking",
    "回溯检索": "backtracking",
}


def strategy(raw: Column) -> Column:
    """One of direct, hyde, subquery, backtracking; direct if none is recognised."""
    letters = F.regexp_replace(F.lower(raw), r"[^a-z\x{4E00}-\x{9FA5}]", "")
    out = F.when(raw.isNull(), F.lit("direct"))
    for name, key in STRATEGIES.items():
        out = out.when(letters == name, F.lit(key))
    for key in sorted(set(STRATEGIES.values())):
        out = out.when(F.contains(letters, F.lit(key)), F.lit(key))
    return out.otherwise(F.lit("direct"))


def sub_questions(raw: Column, question: Column) -> Column:
    """What follows the first full-width colon of lines that begin as sub-questions; else the question."""
    lines = F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), ustrip)
    marked = F.filter(lines, lambda x: F.startswith(x, F.lit("子问题")) & F.contains(x, F.lit("：")))
    parts = F.filter(F.transform(marked, lambda x: ustrip(F.regexp_replace(x, r"\A[^：]*：", ""))), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(question))


def _unfenced(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?s)\A\s*```(?:json)?\s*|\s*```\s*\z", "")


def judge_score(raw: Column) -> Column:
    """The number under ``score`` of a judge's JSON, fenced or not; null for strings, booleans and numbers out of range."""
    return valid_or_null(F.from_json(_unfenced(raw), "score double")["score"])


def judge_scores_lenient(raw: Column, name: str) -> Column:
    """A number under ``name`` in the outermost braces; numeric strings count, booleans don't."""
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    value = F.get_json_object(body, f"$.{name}")
    quoted = body.rlike(rf'"{name}"\s*:\s*(?:true|false)')
    return F.when(~quoted, valid_or_null(value.try_cast("double")))


def qa_pairs(raw: Column) -> Column:
    """Question and answer structs of a JSON list within prose or a fence, trailing commas allowed.

    ``reference_answer`` and ``answer`` name the answer; pairs without either part go.
    """
    body = F.regexp_extract(raw, r"(?s)(\[.*\])", 1)
    body = F.regexp_replace(body, r",\s*([\]}])", "$1")
    rows = F.from_json(body, "array<struct<question: string, answer: string, reference_answer: string>>")
    named = F.transform(rows, lambda r: F.struct(ustrip(r["question"]).alias("question"), ustrip(F.coalesce(r["reference_answer"], r["answer"])).alias("reference_answer")))
    full = F.filter(named, lambda r: (F.coalesce(r["question"], F.lit("")) != "") & (F.coalesce(r["reference_answer"], F.lit("")) != ""))
    return F.coalesce(full, F.from_json(F.lit("[]"), "array<struct<question: string, reference_answer: string>>"))


def _typed(value: Column, path: str, kind: str, shapes: tuple[str, ...]) -> Column:
    """A variant's part as a column of ``kind``, null unless JSON wrote it in one of ``shapes``: a cast alone blurs 1, true and "1"."""
    part = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(part).isin(*shapes), F.try_variant_get(value, path, kind))


def reviewed_answer(raw: Column, context: Column) -> Column:
    """The answer of a review whose checks all hold against the context; else null.

    A review has an answer that isn't blank and one check at least. A check has a claim and
    says whether it is supported; then it cites paragraphs that there are, by number, or, if
    it has no such list, quotes the context, white space apart. What isn't supported needs
    no evidence, but a list of numbers must be one. Numbers, booleans and strings are told
    apart. Null and broken reviews give null.
    """
    review = F.try_parse_json(raw)
    packed = F.regexp_replace(F.coalesce(context, F.lit("")), WS, "")
    last = F.coalesce(F.size(evidence_paragraphs(context)), F.lit(0))
    text = lambda value, path: ustrip(_typed(value, path, "string", ("STRING",)))

    def sound(check: Column) -> Column:
        stands = _typed(check, "$.supported", "boolean", ("BOOLEAN",))
        cited = _typed(check, "$.evidence_ids", "array<bigint>", ("ARRAY<BIGINT>", "ARRAY<VOID>"))
        quote = F.regexp_replace(_typed(check, "$.evidence", "string", ("STRING",)), WS, "")
        by_number = F.forall(cited, lambda k: k.between(1, last)) & (F.size(cited) >= stands.cast("int"))
        by_words = ~stands | (quote != "") & F.contains(packed, quote)
        listed = F.try_variant_get(check, "$.evidence_ids", "variant").isNotNull()
        proof = F.when(listed, by_number).otherwise(quote.isNotNull() & by_words)
        return F.coalesce((text(check, "$.claim") != "") & stands.isNotNull() & proof, F.lit(False))

    checks, answer = F.try_variant_get(review, "$.checks", "array<variant>"), text(review, "$.final_answer")
    return F.when((answer != "") & (F.size(checks) > 0) & F.forall(checks, sound), answer)
