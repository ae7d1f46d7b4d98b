"""Column builders for text: normal form, folding, cleaning steps and their counts, measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: tokens that stand for a missing cell, the length under which a text is low in content, list marks
NULL_TOKENS = ("", "null", "n/a", "na")
LOW_CONTENT = 20
MARKS = "\u2022\u00b7\u25aa\u25e6\u2013\u2014-"

CONTROL = r"[\x00-\x08\x0B-\x1F\x7F-\x9F]"
LINE_TAIL = r"[ \t]+(?![^\n])"
BLANK_RUN = r"\n{3,}"
ANY_SPACE = r"(?U)\s"


def _icu(kind: str, method: str, text: Column, flag: bool) -> Column:
    """A static function of the Unicode library that Spark ships, so that text stays in the JVM."""
    return F.reflect(F.lit(f"com.ibm.icu.{kind}"), F.lit(method), F.coalesce(text, F.lit("")), F.lit(flag))


def nfc(text: Column) -> Column:
    """Unicode normal form C. Below U+0300 every text is in it."""
    return F.when(text.rlike(r"[^\x00-\u02FF]"), _icu("text.Normalizer", "compose", text, False)).otherwise(text)


def folded(text: Column) -> Column:
    """Normal form C with full case folding, for comparisons."""
    composed = nfc(text)
    return F.when(text.rlike(r"[^\x00-\x7F]"), _icu("lang.UCharacter", "foldCase", composed, True)).otherwise(F.lower(text))


def unfolded(composed: Column, place: Column) -> Column:
    """Zero-based place in a composed text of a place in its folded form, where one letter may have become several."""
    step = lambda s, c: F.struct((s["at"] + F.length(folded(c))).alias("at"), (s["n"] + F.when(s["at"] + F.length(folded(c)) <= place, 1).otherwise(0)).alias("n"))
    letters = F.regexp_extract_all(composed, F.lit("(?s)."), F.lit(0))
    counted = F.aggregate(letters, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")), step, lambda s: s["n"])
    return F.when(F.length(folded(composed)) == F.length(composed), place).otherwise(counted).cast("bigint")


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def clean_steps(text: Column) -> list[Column]:
    """The text after each cleaning step: normal form, line ends, line tails, blank runs, control characters."""
    composed = nfc(text)
    lines = unix_lines(composed)
    tails = F.regexp_replace(lines, LINE_TAIL, "")
    runs = F.regexp_replace(tails, BLANK_RUN, "\n\n")
    return [composed, lines, tails, runs, F.regexp_replace(runs, CONTROL, "")]


def cleaned(text: Column) -> Column:
    return clean_steps(text)[-1]


def clean_counts(text: Column) -> dict[str, Column]:
    """How often each logged cleaning action applies: texts composed, lines trimmed, newlines and controls removed."""
    composed, lines, tails, runs, done = clean_steps(text)
    less = lambda x, y: (F.length(x) - F.length(y)).cast("bigint")
    return {
        "unicode_nfc": (composed != text).cast("bigint"),
        "trim_trailing_whitespace": F.regexp_count(lines, F.lit(LINE_TAIL)).cast("bigint"),
        "compress_excessive_blank_lines": less(tails, runs),
        "remove_control_characters": less(runs, done),
    }


def actions(counts: dict[str, Column]) -> Column:
    """The actions that apply, as an array of (type, count)."""
    found = [F.when(n > 0, F.struct(F.lit(k).alias("type"), n.alias("count"))) for k, n in counts.items()]
    return F.array_compact(F.array(*found))


def extracted(text: Column) -> Column:
    """The narrower normal form of extraction: Unix lines, composed, without C0 controls but newline and tab."""
    return F.regexp_replace(nfc(unix_lines(text)), r"[\x00-\x08\x0B-\x1F]", "")


def presentation(text: Column) -> Column:
    """Lines without trailing space; a line that is only a list mark or number is joined with the next filled line."""
    mark = rf"(?:[{MARKS}]|(?U:\d){{1,3}}[.)\u3001])"
    lines = F.regexp_replace(unix_lines(text), r"(?U)[^\S\n]+(?![^\n])", "")
    joined = F.regexp_replace(lines, rf"(?<![^\n])(?U:[^\S\n]*)({mark})\n(?U:\s*)(?=(?U:\S))", "$1 ")
    return strip(joined)


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^(?U)\s+", ""), r"(?U)\s+\z", "")


def cell(text: Column) -> Column:
    """A normalised table cell: composed, Unix lines, stripped, null for a token of absence."""
    value = strip(unix_lines(nfc(text)))
    return F.when(F.lower(value).isin(*NULL_TOKENS), F.lit(None)).otherwise(value)


def effective_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, ANY_SPACE, "")).cast("bigint")


def char_count(text: Column) -> Column:
    return F.length(text).cast("bigint")


def line_count(text: Column) -> Column:
    newlines = F.length(text) - F.length(F.translate(text, "\n", ""))
    return F.when(F.length(text) == 0, 0).otherwise(newlines + 1).cast("bigint")


def text_status(text: Column) -> Column:
    """unusable, needs_review or ready."""
    return F.when(F.length(strip(text)) == 0, "unusable").when(F.length(strip(text)) < LOW_CONTENT, "needs_review").otherwise("ready")


def occurrences(text: Column, needle: str) -> Column:
    """Number of occurrences that don't overlap, case-sensitive."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("bigint")
