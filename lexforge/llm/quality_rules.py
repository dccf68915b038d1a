"""Quality rules, line first, in DataFrame functions alone.

Each line is held against punctuation, navigation and boilerplate rules; lines that fail
are removed; a document that loses too much of its text with them is rejected, and so is
one that fails the base rules. Everything is an expression over the row: no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAPS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: A line of a few words needs a sentence's end; longer ones may be lines of wrapped prose.
FEW = 4
SENTENCE_END = r"""[.!?:;\x{2026}\x{3002}\x{FF01}\x{FF1F}]["'\x{201D}\x{2019}\x{00BB})\]]*(?:[\x20\x09-\x0D]|\z)"""
#: Shouting, and rows of symbols that stand for words.
SHOUTING = r"[!?]{2}"
SYMBOL = r"[#*$%&|<>~^=_]+"
#: Separators between the entries of a menu or a path of links.
SEPARATOR = r"(?:\A|[\x20\x09-\x0D])[|\x{00BB}\x{203A}\x{2022}\x{00B7}>/](?:[\x20\x09-\x0D]|\z)"
#: Entries of a page's menu in four languages; a line of nothing but such entries is navigation.
LABELS = (
    r"home|menu|search|log ?in|log ?out|sign ?in|sign ?up|register|next|previous|back|back to top|read more|skip to content|site ?map|contact(?: us)?|about(?: us)?|"
    r"share|print|subscribe|products|services|blog|news|faq|careers|help|privacy|terms|startseite|impressum|kontakt|datenschutz|anmelden|suche|accueil|connexion|rechercher|"
    r"mentions l[\x{E9}\x{C9}]gales|inicio|contacto|buscar|acerca de"
)
MENU = rf"(?i)\A[\x20\x09-\x0D]*(?:{LABELS})(?:[\x20\x09-\x0D.:>|/\x{{B7}}-]+(?:{LABELS}))*[\x20\x09-\x0D.:>|]*\z"
#: Notices that say nothing about their document.
NOTICE = (
    r"(?i)all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|use of cookies|enable javascript|lorem ipsum|copyright \x{A9}|\x{A9} ?[0-9]{4}|"
    r"alle rechte vorbehalten|tous droits r[\x{E9}\x{C9}]serv[\x{E9}\x{C9}]s|todos los derechos reservados"
)
#: In lower case, one of these is in every notice: texts without any are not searched for notices.
NOTICED = ("rights reserved", " policy", "terms of ", "cookies", "enable javascript", "lorem ipsum", "\u00a9", "rechte vorbehalten", "tous droits", "derechos reservados")
#: What a line must have to break the rules on symbols, shouting and separators.
ODD = r"[!?]{2}|[#*$%&|<>~^=_\x{BB}\x{203A}\x{2022}\x{B7}/]"


def words(text: Column) -> Column:
    return F.filter(F.split(text, GAPS), lambda w: w != "")


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def passes(line: Column, n: Column, noticed: Column) -> Column:
    """The three rules on a line of ``n`` words; one without a word passes, there is nothing to judge. ``noticed``: its text may hold a notice."""
    punctuation = (2 * count(line, SYMBOL) <= n) & (count(line, SHOUTING) * 4 <= n + 3)
    odd = F.when(line.rlike(ODD), punctuation & (4 * count(line, SEPARATOR) <= n)).otherwise(True)
    return (n == 0) | (((n >= FEW) | line.rlike(SENTENCE_END)) & odd & ~line.rlike(MENU) & ~(noticed & line.rlike(NOTICE)))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(hashes: Column) -> Column:
    """Words that lie in a window found twice or more, from the windows' hashes in order.

    Equal windows are neighbours once sorted with their places; the places found cover
    three words each, and overlaps count once.
    """

    def places(s: Column) -> Column:
        marked = F.transform(s, lambda x, j: F.when((x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]), x["i"]).otherwise(F.lit(-1)))
        return F.sort_array(F.filter(marked, lambda i: i >= 0))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, i: F.struct((i + 3).alias("end"), (acc["n"] + i + 3 - F.greatest(i, acc["end"])).alias("n"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(_let(placed, places)))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeated: int = 50, max_lost: int = 50) -> DataFrame:
    """Every row of ``df`` with its figures, its verdict and its text after the removal of lines.

    Columns: the id, ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines_removed, n_words_removed`` (long), ``base_failed, kept`` (boolean) and
    ``cleaned_text``. A null text counts as an empty one and fails the base rules; its
    cleaned text is empty. Ties cannot occur; repeated rows are judged each. Other columns
    are dropped, so their names cannot clash. The three limits are words, and percents.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), text.alias("_text"))
    lines = F.transform(F.split("_text", "\n"), lambda x: F.struct(x.alias("l"), count(x, WORD).alias("n")))
    low = F.lower("_text")
    noticed = reduce(Column.__or__, [F.contains(low, F.lit(x)) for x in NOTICED])
    rows = rows.select("_id", "_text", lines.alias("_lines"), noticed.alias("_noticed"), words(F.col("_text")).alias("_words"))
    w = F.col("_words")
    windows = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    rows = rows.select(
        "_id",
        "_text",
        "_lines",
        F.size("_words").cast("long").alias("n_words"),
        F.when(F.size("_words") >= 3, F.slice(windows, 1, F.greatest(F.size("_words") - 2, F.lit(0)))).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
        F.transform("_lines", lambda x: F.struct(x["l"].alias("l"), x["n"].alias("n"), passes(x["l"], x["n"], F.col("_noticed")).alias("good"))).alias("_judged"),
    )
    full = F.transform(F.filter("_lines", lambda x: x["n"] > 0), lambda x: x["l"])
    lost = F.aggregate("_judged", F.lit(0), lambda a, x: a + F.when(x["good"], 0).otherwise(x["n"]))
    rows = rows.select(
        "_id",
        "n_words",
        F.length(F.translate("_text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_windows")).alias("n_repeat_words"),
        F.size(F.filter("_judged", lambda x: ~x["good"])).cast("long").alias("n_lines_removed"),
        lost.cast("long").alias("n_words_removed"),
        F.array_join(F.transform(F.filter("_judged", lambda x: x["good"]), lambda x: x["l"]), "\n").alias("cleaned_text"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (100 * F.col("n_words_removed") <= max_lost * F.col("n_words"))
    return rows.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "n_lines_removed", "n_words_removed", "base_failed", kept.alias("kept"), "cleaned_text",
    )


def clean(df: DataFrame, text_col: str = "text", **limits: int) -> DataFrame:
    """The rows that are kept, all columns as they were but for the cleaned text.

    Null and empty texts go (they fail the base rules); repeated rows stay or go alike; an
    empty table gives an empty one; no name of a column can clash.
    """
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_body"))
    judged = judge(packed, "_row", "_body", **limits)
    # behind the generator the filter cannot be pushed into the figures and compute them again
    judged = judged.select(F.explode(F.array(F.struct("kept", "cleaned_text", "_row"))).alias("j")).where("j.kept")
    return judged.select(*[F.col("j.cleaned_text").alias(c) if c == text_col else F.col("j._row")[c].alias(c) for c in df.columns])
