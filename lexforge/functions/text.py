"""Text functions: Unicode white space throughout, lengths in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str methods see it: Java's class, the information separators and the next-line mark.
#: Java looks single characters below 256 up in one table, and most others are told by the one outer range.
WS = r"[\t\n\x0B\f\r \x1C\x1D\x1E\x1F\x85\xA0[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]]"
#: The same characters by themselves.
WS_CHARS = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def ustrip(text: Column) -> Column:
    """``trim`` by itself removes spaces alone; this removes all white space, and looks at the edges only."""
    return F.btrim(text, F.lit(WS_CHARS))


def utokens(text: Column) -> Column:
    """Parts between white space; none for an empty text."""
    return F.array_remove(F.split(text, f"{WS}+"), "")


def normalize_query(text: Column) -> Column:
    """A cache key's form of a question: outer white space goes, all else stays; null is empty."""
    return ustrip(F.coalesce(text, F.lit("")))


def same_question(a: Column, b: Column) -> Column:
    """Both are not blank and equal but for outer white space."""
    return F.coalesce((normalize_query(a) != "") & (normalize_query(a) == normalize_query(b)), F.lit(False))


def clean_text(text: Column) -> Column:
    """Runs of white space become one space, none at the edges; null is empty."""
    return ustrip(F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS}+", " "))


def truncate(text: Column, limit: int, suffix: str = "...") -> Column:
    """At most ``limit`` code points, the suffix included."""
    cut = F.concat(F.substring(text, 1, max(0, limit - len(suffix))), F.lit(suffix))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def is_chinese(text: Column) -> Column:
    return text.rlike(r"[\x{4E00}-\x{9FFF}]")


def is_english(text: Column) -> Column:
    """Letters, and all of them of the Latin alphabet's basic 26."""
    return text.rlike(r"[A-Za-z]") & ~text.rlike(r"[^\x00-\x7F]")


def token_estimate(text: Column) -> Column:
    """Chinese: length over 1.3, rounded down; else three quarters of the words."""
    return F.when(is_chinese(text), F.floor(F.length(text) / 1.3)).otherwise(F.floor(F.size(utokens(text)) * 0.75)).cast("long")


def token_estimate_mixed(text: Column) -> Column:
    """The other estimate: by whether all characters are ASCII."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), (F.length(text) / 1.3).cast("long")).otherwise((F.size(utokens(text)) * 0.75).cast("long"))


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(default)).otherwise(a / b)


def format_number(n: Column) -> Column:
    """Thousands and millions with one decimal."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1_000, F.format_string("%.1fK", n / 1_000)).otherwise(n.cast("string"))


def format_time(seconds: Column) -> Column:
    """Milliseconds below one second, then seconds, then minutes."""
    ms, s, m = F.format_string("%.0fms", seconds * 1000), F.format_string("%.2fs", seconds), F.format_string("%.1fmin", seconds / 60)
    return F.when(seconds < 1, ms).when(seconds < 60, s).otherwise(m)


def md5_key(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.md5(normalize_query(text)))


def source_label(path: Column, root: str) -> Column:
    """A file's source: its first folder below ``root``, else its name up to ``_``, else its stem."""
    rest = F.regexp_replace(path, "^.*?" + "/".join(map(_quoted, root.strip("/").split("/"))) + "/", "")
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    folder = F.when(F.contains(rest, F.lit("/")), F.element_at(F.split(rest, "/"), 1))
    head = F.when(F.contains(stem, F.lit("_")), F.element_at(F.split(stem, "_"), 1))
    return F.coalesce(F.nullif(folder, F.lit("")), F.nullif(head, F.lit("")), stem)


def _quoted(part: str) -> str:
    import re

    return re.escape(part)


def evidence_paragraphs(context: Column) -> Column:
    """Parts between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(context, "\n\n"), ustrip), lambda p: p != "")


def numbered_evidence(context: Column) -> Column:
    marked = F.transform(evidence_paragraphs(context), lambda p, i: F.concat(F.lit("【证据"), (i + 1).cast("string"), F.lit("】\n"), p))
    return F.array_join(marked, "\n\n")


def knowledge_text(title: Column, content: Column) -> Column:
    """A document under its title, unless that is missing or ``unknown``."""
    known = F.coalesce((title != "") & (title != "unknown"), F.lit(False))
    return F.concat(F.when(known, F.concat(F.lit("【文档标题："), title, F.lit("】\n"))).otherwise(""), F.coalesce(content, F.lit("")))


def source_only_answer(sources: Column, contents: Column, limit: int = 500, most: int = 2) -> Column:
    """An answer made of the first documents' openings."""
    cut = lambda c: F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)
    parts = F.zip_with(F.slice(sources, 1, most), F.slice(contents, 1, most), lambda s, c: F.concat(F.lit("【"), s, F.lit("】"), cut(c)))
    return F.array_join(parts, "\n\n")


def clean_entity(name: Column) -> Column:
    """A title without its file ending and without parts in brackets."""
    return ustrip(F.regexp_replace(F.regexp_replace(name, r"\.md$", ""), r"[(（][^)）]*[)）]", ""))
