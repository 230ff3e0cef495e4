"""Text functions as columns: tokens, folding, snippets, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower_tr(c: Column | str) -> Column:
    """Lower case in which dotted and dotless i keep apart."""
    return F.lower(F.translate(_c(c), "İI", "iı"))


def tokens(c: Column | str) -> Column:
    """Words in order, lowered; null text has none.

    The one letter whose lower case would split a word (dotted I) is replaced before, so the whole
    text is lowered at once instead of each word.
    """
    return F.regexp_extract_all(lower_tr(F.coalesce(_c(c), F.lit(""))), F.lit(WORD), F.lit(0))


def ascii_fold(c: Column | str) -> Column:
    """Turkish letters as plain ones, upper case, other signs as one space: the form in which names compare."""
    plain = F.translate(_c(c), "çğıöşüÇĞİÖŞÜâîûÂÎÛ", "cgiosuCGIOSUaiuAIU")
    return F.trim(F.regexp_replace(F.upper(plain), "[^A-Z0-9]+", " "))


def number_key(c: Column | str) -> Column:
    """Case numbers without blanks, lower case; empty counts as null."""
    k = F.regexp_replace(F.lower(_c(c)), r"\s+", "")
    return F.when(k != "", k)


def year_of(c: Column | str) -> Column:
    """Year of an ISO date, a day-first date or a bare year; null for anything else and outside 1900 to 2100."""
    s = F.trim(_c(c))
    y = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(s, 1, 4)).when(s.rlike(r"^\d{2}\.\d{2}\.\d{4}\z"), F.substring(s, 7, 4)).when(s.rlike(r"^\d{4}\z"), s)
    n = y.cast("int")
    return F.when(n.between(1900, 2100), n)


def snippet(text: Column | str, term: str, width: int = 160) -> Column:
    """A window around the first match, a third before it, with dots where text is cut off."""
    t = F.coalesce(_c(text), F.lit(""))
    at = F.locate(term, lower_tr(t))
    start = F.greatest(F.lit(1), at - width // 3)
    body = F.substring(t, start, F.lit(width))
    cut_off = F.length(t) >= start + width
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(cut_off, "…").otherwise("")))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays taken as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def plain_markdown(c: Column | str) -> Column:
    """Plain text of simple markdown: marks of headings, lists, quotes, emphasis, code and links go, words stay; null stays null."""
    t = F.regexp_replace(_c(c), r"(?m)^```.*$", "")
    t = F.regexp_replace(t, r"(?m)^[ \t]{0,3}(?:#{1,6}|>|[-*+]|[0-9]+\.)[ \t]+", "")
    t = F.regexp_replace(t, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    for mark in (r"\*\*", "__", r"\*", "`"):
        t = F.regexp_replace(t, f"{mark}([^\n]+?){mark}", "$1")
    return t
