"""Cleaning of documents, line by line, as expressions over the row (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, ustrip, utokens

#: Whole lines that are page numbers.
PAGE_NUMBERS = (rf"第{WS}*\d+{WS}*页", rf"-{WS}*\d+{WS}*-", rf"Page{WS}*\d+", rf"page{WS}*\d+")
PAGE_NUMBER = rf"(?U)\A(?:{'|'.join(PAGE_NUMBERS)})\z"
REPEATS = 3
#: Control characters, byte order marks, zero-width characters and soft hyphens, within ranges that tell most others at once.
UNSEEN = r"[\x00-\x1F\x7F-\xAD\x{200B}-\x{FEFF}&&[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{FEFF}\x{200B}-\x{200D}\x{AD}]]"
#: Words that are no keywords.
STOP_WORDS = ("的", "了", "和", "是", "在", "我", "有", "就", "不", "人", "都", "一", "个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这")


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def clean_characters(text: Column) -> Column:
    """One kind of line end; no control characters, byte order marks, zero-width characters or soft hyphens."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    return F.regexp_replace(text, UNSEEN, "")


def candidate_lines(text: Column) -> Column:
    """Stripped lines that are neither empty nor page numbers."""
    lines = F.transform(F.split(clean_characters(text), "\n"), ustrip)
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(PAGE_NUMBER))


def has_letter(line: Column) -> Column:
    return line.rlike(r"[\p{L}\p{N}]")


def clean_lines(lines: Column) -> Column:
    """From candidate lines with letters to kept ones: a line that has been kept three times goes,
    then lines equal to the kept one before. Lines of one character repeat freely.

    Symbol lines are never kept, so they may go before the count. Sorted with their places,
    equal lines are neighbours: the fourth and later ones have an equal three places before.
    """
    ordered = F.sort_array(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    few = lambda s: F.filter(s, lambda e, j: (F.length(e["x"]) < 2) | ~e["x"].eqNullSafe(F.get(s, j - REPEATS)["x"]))
    back = lambda s: F.transform(F.sort_array(F.transform(few(s), lambda e: F.struct(e["i"], e["x"]))), lambda e: e["x"])
    return _let(_let(ordered, back), lambda k: F.filter(k, lambda x, i: ~x.eqNullSafe(F.get(k, i - 1))))


def joined(lines: Column) -> Column:
    """Runs of spaces become one; lines stand as paragraphs."""
    return ustrip(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, " {2,}", " ")), "\n\n"))


def clean_documents(df: DataFrame, text_col: str = "content") -> DataFrame:
    """``df`` with the cleaned text in place. Null and empty texts stay as they are."""
    lines = df.withColumn("_lines", candidate_lines(F.col(text_col)))
    lines = lines.withColumn("_lines", F.filter("_lines", has_letter))
    text = F.when(F.col(text_col).isNull() | (F.col(text_col) == ""), F.col(text_col)).otherwise(joined(clean_lines(F.col("_lines"))))
    # a generator of one row: what follows reads the text, the planner cannot put its expression there again
    columns = [F.explode(F.array(text)).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    return lines.select(*columns)


def title(text: Column) -> Column:
    """Of the first ten lines, the first that is a heading or a short line that begins with a capital."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 10), ustrip)
    heading = lambda x: F.startswith(x, F.lit("# ")) & (F.length(x) < 100)
    short = lambda x: (F.length(x) < 50) & x.rlike(r"\A\p{Lu}") & ~F.endswith(x, F.lit(".")) & (F.size(utokens(x)) < 10)
    first = F.get(F.filter(lines, lambda x: heading(x) | short(x)), F.lit(0))
    return F.when(heading(first), F.nullif(ustrip(F.substring(first, 3, 1_000_000)), F.lit(""))).otherwise(first)


def keywords(text: Column, most: int = 5) -> Column:
    """The most frequent tokens of two characters or more, ties by first place.

    Tokens are sorted with their places once; runs give counts, so the cost is n log n.
    """
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    words = F.filter(utokens(text), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    runs = lambda s: F.filter(F.transform(s, lambda x, i: F.struct(x["w"].alias("w"), x["i"].alias("at"), i.alias("k"))), lambda x: (x["k"] == 0) | (x["w"] != F.get(s, x["k"] - 1)["w"]))
    counted = lambda s, r: F.transform(r, lambda x, j: F.struct((x["k"] - F.coalesce(F.get(r, j + 1)["k"], F.size(s))).alias("n"), x["at"].alias("at"), x["w"].alias("w")))
    ranked = _let(placed, lambda s: _let(runs(s), lambda r: F.array_sort(counted(s, r))))
    return F.transform(F.slice(ranked, 1, most), lambda x: x["w"])


def with_metadata(df: DataFrame, text_col: str = "content") -> DataFrame:
    """Adds ``title, keywords, char_count, word_count``; a title or keywords may be missing."""
    text = F.col(text_col)
    words = keywords(text)
    return df.select("*", title(text).alias("title"), F.when(F.size(words) > 0, words).alias("keywords"), F.length(text).alias("char_count"), F.size(utokens(text)).alias("word_count"))


# ------------------------------------------------------------------ answers

#: Words of a page's interface.
INTERFACE = ("浏览专业版", "多媒体", "阅读更多", "关于", "免责声明", "版权所有", "修改的")
#: Names of a page's sections.
SECTIONS = (
    "病因", "筛查", "预防", "症状", "诊断", "治疗", "概述", "概要", "临床表现", "评估", "管理", "治疗监测", "药物治疗", "病因学", "病理生理学", "预后",
    "并发症", "关键点", "疫苗类型", "剂量和建议", "副作用", "筛查和预防",
)
#: Kinds of organisations, and names of some.
BODIES = ("协会", "基金会", "研究所", "中心", "网络", "组织", "机构", "学院", "学会")
NAMES = ("CDC", "AAP", "AAFP", "ECDC", "NIH", "WHO", "FDA", "美国国家", "美国")


#: How an author's block, a notice of rights and a reference to another page are written.
AUTHOR = rf"(?s){WS}*作者[：:].*?浏览专业版{WS}*"
RIGHTS = (rf"Co\.,?{WS}*Inc\.?,?{WS}*Rahway,?{WS}*NJ,?{WS}*USA[^。]*?保留所有权利。?", "(?:保留所有权利|版权所有)。?")
ELSEWHERE = ("（请参阅[^）]*?。）", r"\(请参阅[^)]*?\)")
#: A last sentence lists organisations if it has so many colons and characters, so many of
#: their words and characters, or one of them with a colon near its start; a footer is so near the end.
COLONS, COLON_CHARS, WORDS, WORD_CHARS, NEAR_START, NEAR_END = 2, 20, 2, 60, 60, 150


def clean_answer(text: Column) -> Column:
    """An answer without author blocks, notices, interface words, section rows, lists of organisations and cross references."""
    gone = [(AUTHOR, " "), *((p, "") for p in RIGHTS), *((f"{WS}*{word}{WS}*", " ") for word in INTERFACE)]
    t = _each(text, gone)
    section = "(?:" + "|".join(sorted(SECTIONS, key=len, reverse=True)) + ")"
    t = F.regexp_replace(F.concat(F.lit(" "), t), f"(?<=[。]|{WS}){section}(?:{WS}+{section})+{WS}*", " ")
    t = _let(ustrip(t), _without_tail)
    t = _let(t, _without_footer)
    t = _each(t, [(p, "") for p in ELSEWHERE])
    return F.when(text.isNull() | (text == ""), text).otherwise(ustrip(F.regexp_replace(t, f"{WS}+", " ")))


def _each(text: Column, changes: list[tuple[str, str]]) -> Column:
    for pattern, instead in changes:
        text = F.regexp_replace(text, pattern, instead)
    return text


def _without_tail(t: Column) -> Column:
    """What follows the last full stop goes if it lists organisations."""
    body, tail = F.regexp_extract(t, r"(?s)\A(.*。)", 1), ustrip(F.regexp_extract(t, r"(?s)。([^。]*)\z", 1))
    bodies = F.lit(0)
    for word in BODIES:
        bodies = bodies + F.contains(tail, F.lit(word)).cast("int")
    named = F.substring(tail, 1, NEAR_START).rlike(f"(?:{'|'.join(BODIES)}){WS}*[：:]")
    listed = ((F.regexp_count(tail, F.lit("[：:]")) >= COLONS) & (F.length(tail) > COLON_CHARS)) | ((bodies >= WORDS) & (F.length(tail) > WORD_CHARS)) | named
    return F.when((body != "") & (tail != "") & listed, body).otherwise(t)


def _without_footer(t: Column) -> Column:
    """An organisation and colon near the end: cut at the full stop before the last one."""
    terms = "|".join(sorted((*BODIES, *NAMES), key=len, reverse=True))
    # the last place where a term and a colon begin; a shorter term may begin later than a longer one
    head = F.regexp_extract(t, rf"(?s)\A(.*)(?:{terms}){WS}*[：:]", 1)
    found = t.rlike(f"(?:{terms}){WS}*[：:]") & (F.length(head) > F.length(t) - NEAR_END)
    body = F.regexp_extract(head, r"(?s)\A(.*。)", 1)
    return F.when(~found, t).when(body != "", body).otherwise(F.regexp_replace(head, r"[ 。，]+\z", ""))


def clean_faq(df: DataFrame) -> DataFrame:
    """Question and answer cleaned; rows without either go. The answer's old length and whether it changed come along."""
    rows = df.select(
        ustrip(F.regexp_replace(F.coalesce("question", F.lit("")), f"{WS}+", " ")).alias("question"),
        F.coalesce("answer", F.lit("")).alias("_before"),
        *[ustrip(F.coalesce(c, F.lit(""))).alias(c) for c in ("source", "doc_name")],
    )
    rows = rows.withColumn("answer", clean_answer(F.col("_before"))).where("question <> '' and answer <> ''")
    return rows.select("question", "answer", "source", "doc_name", F.length("_before").alias("length_before"), (F.col("_before") != F.col("answer")).alias("changed"))


def cleaning_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: total, kept, dropped, changed, mean lengths before and after."""
    total = before.agg(F.count(F.lit(1)).alias("total"))
    kept = after.agg(F.count(F.lit(1)).alias("kept"), F.count_if("changed").alias("changed"), F.avg("length_before").alias("mean_before"), F.avg(F.length("answer")).alias("mean_after"))
    return total.join(kept).select("total", "kept", (F.col("total") - F.col("kept")).alias("dropped"), "changed", "mean_before", "mean_after")  # one row each


# ------------------------------------------------------------------ filters

def source_is(column: Column, source: str | None) -> Column | None:
    """Equality with a literal: nothing in the name is ever read as an expression."""
    return None if source is None or source == "" else column == F.lit(source)


def all_of(*conditions: Column | None) -> Column:
    out = F.lit(True)
    for c in conditions:
        if c is not None:
            out = out & c
    return out


def is_child(df: DataFrame) -> Column:
    """A child row: it has a parent, and says so where rows say what they are."""
    has_parent = F.coalesce(F.col("parent_id"), F.lit("")) != ""
    return has_parent & (F.col("chunk_type") == "child") if "chunk_type" in df.columns else has_parent


def at_least(df: DataFrame, score: float = 0.5, column: str = "score") -> DataFrame:
    return df.where(F.col(column) >= score)


def long_enough(df: DataFrame, text_col: str = "content", least: int = 100) -> DataFrame:
    return df.where(F.length(F.coalesce(F.col(text_col), F.lit(""))) >= least)


def sample_fragment(df: DataFrame, id_col: str, text_col: str, size: int = 1600, seed: int = 0) -> DataFrame:
    """A window of each text without headings and short lines; where it starts is a hash (MD5) of id and seed.

    The window starts after its first full stop, if that is among the first 120 characters.
    """
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n"), ustrip), lambda x: ~F.startswith(x, F.lit("#")) & (F.length(x) >= 30))
    body = F.array_join(lines, "\n")
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long") % F.greatest(F.length(body) - size + 1, F.lit(1))
    window = _let(body, lambda b: F.substring(b, (start + 1).cast("int"), F.lit(size)))
    stop = lambda w: F.instr(w, "。")
    cut = _let(window, lambda w: F.when((stop(w) > 0) & (stop(w) <= 120), F.substring(w, stop(w) + 1, F.lit(size))).otherwise(w))
    return df.select("*", cut.alias("fragment"))


# ---------------------------------------------------------------- integrity

def missing_parts(html_text: Column, headings: Column, markdown: Column) -> Column:
    """Headings (letters and digits alone) and numbers of a page that its Markdown lacks."""
    bare = lambda x: F.regexp_replace(x, r"(?U)[\W_]+", "")
    visible = F.regexp_replace(markdown, r"!?\[([^\]]*)\]\([^\n]*?\)", "$1")
    # the page's letters are told once, not for each heading
    lost = _let(F.struct(headings.alias("h"), bare(visible).alias("b")), lambda p: F.filter(p["h"], lambda h: ~F.contains(p["b"], bare(h))))  # an empty heading is in any text
    numbers = F.array_distinct(F.regexp_extract_all(html_text, F.lit(r"((?<![\d.])[+-]?\d+(?:\.\d+)?(?:/\d+)?)"), F.lit(1)))
    gone = _let(F.struct(numbers.alias("n"), visible.alias("v")), lambda p: F.filter(p["n"], lambda n: ~F.contains(p["v"], n)))
    return F.concat(lost, gone)


def titled(markdown: Column, name: Column) -> Column:
    """The text under its title, once."""
    body = ustrip(markdown)
    first = ustrip(F.substring_index(body, "\n", 1))
    rest = F.when(F.contains(body, F.lit("\n")), F.regexp_replace(body, r"\A[^\n]*\n", "")).otherwise("")
    same = first.rlike(r"\A#\s+") & (F.regexp_replace(first, r"\A#\s+", "") == name)
    return F.concat(F.lit("# "), name, F.lit("\n\n"), ustrip(F.when(same, rest).otherwise(body)), F.lit("\n"))

