"""Splitting oversized texts at natural boundaries by recursive bisection.

A text above the limit is cut at the strongest boundary near its middle (paragraph, then line,
sentence, word, any character that is not inside a combining sequence), and its halves again while they exceed the limit less
the overlap. Afterwards every piece but the first is extended to the left by the overlap, or, where that
would begin inside a word, from the next word on. Pieces cover the text without gaps, and without overlap
they concatenate to it. A full stop behind a number, an initial or an abbreviation, or before a small
letter, ends no sentence.

Defined results: null, blank and short texts are one piece (or none with ``only_long``); the
lengths count code points of the text without surrounding white space; a text without any
boundary is cut by length alone; ties go to the boundary nearer the middle, then the earlier one.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from derlem.functions.keys import BLANKS

_GAP = re.compile(r"\s+")
_ENDS = ".!?…:;"
_CLOSERS = "\"')]»”’*_"
#: Abbreviations of more than two letters that a full stop follows, in small letters.
_SHORT = {"prof", "doç", "yrd", "uzm", "öğr", "alm", "bkz", "sok", "cad", "mah", "bul", "bulv", "apt", "tel", "müh", "mim", "şti", "ltd", "san", "tic", "esas", "karş", "hzl", "çev", "ing", "fak", "üni", "dan", "yarg", "yön", "kan"}
_WORD_BEFORE = re.compile(r"(\w+)$")


def _full_stop(text: str, p: int, after: int) -> bool:
    """Whether the full stop at ``p`` ends a sentence that the next one follows at ``after``."""
    word = _WORD_BEFORE.search(text, max(0, p - 24), p)
    if word and (len(word[1]) < 3 or word[1].isdigit() or word[1].lower() in _SHORT or set(word[1]) <= set("IVXLCDM")):
        return False
    return not (after < len(text) and text[after].islower())


def _begin(text: str, low: int, high: int) -> int:
    """Where an overlap that may reach from ``low`` to ``high`` begins: with a word, and never inside a combined character."""
    if low == 0 or text[low - 1].isspace():
        return low
    gap = _GAP.search(text, low, high)
    if gap and gap.end() < high:
        return gap.end()
    while low < high and (unicodedata.combining(text[low]) or text[low] in "\u200d\ufe0f\n"):
        low += 1
    return low


def boundaries(text: str) -> list[list[int]]:
    """Positions after which a piece may begin, by strength: paragraph, line, sentence, word."""
    found: list[list[int]] = [[], [], [], []]
    for m in _GAP.finditer(text):
        a, b = m.span()
        gap = m.group()
        if "\n" in gap or "\r" in gap:
            rank = 0 if gap.replace("\r\n", "\n").replace("\r", "\n").count("\n") > 1 else 1
        else:
            p = a - 1
            while p > 0 and text[p] in _CLOSERS:
                p -= 1
            rank = 2 if p >= 0 and text[p] in _ENDS[:4] and (text[p] != "." or _full_stop(text, p, b)) else 3
        found[rank].append(b)
    return found


def _nearest(ps: list[int], low: int, high: int, mid: float) -> int | None:
    i, j = bisect_left(ps, low), bisect_right(ps, high)
    if i >= j:
        return None
    k = bisect_left(ps, mid, i, j)
    return min((ps[x] for x in (k - 1, k) if i <= x < j), key=lambda p: (abs(p - mid), p))


def bisect(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans (start, end) of the pieces, overlaps included."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and below the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    marks = boundaries(text)
    body = limit - overlap
    cuts: list[int] = []
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        # the first piece has no overlap to its left
        if b - a <= (limit if a == 0 else body):
            continue
        mid = (a + b) / 2
        quarter = max(1, (b - a) // 4)
        at = None
        for ps in marks:
            at = _nearest(ps, max(a + 1, int(mid) - quarter), min(b - 1, int(mid) + quarter), mid)
            if at is not None:
                break
        if at is None:
            at = _nearest(sorted({p for ps in marks for p in ps[bisect_left(ps, a + 1) : bisect_right(ps, b - 1)]}), a + 1, b - 1, mid)
        if at is None:
            at = int(mid)
            while at > a + 1 and (unicodedata.combining(text[at]) or text[at] in "\u200d\ufe0f"):
                at -= 1
        cuts.append(at)
        todo += [(a, at), (at, b)]
    starts = [0, *sorted(cuts)]
    ends = [*starts[1:], n]
    return [(_begin(text, max(0, s - overlap), s) if i and overlap else s, e) for i, (s, e) in enumerate(zip(starts, ends))]


def split_long(df: DataFrame, keys: list[str], text: str, limit: str, overlap: str, *, with_text: bool = True, only_long: bool = True) -> DataFrame:
    """``keys``, chunk_index, start, end, n_chunks and, if asked for, the pieces' ``chunk``.

    ``limit`` and ``overlap`` are columns of ``df``. Offsets count from the first character that is
    no white space.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in zip(*(b[c].tolist() for c in [*keys, text, limit, overlap])):
                t = (row[-3] or "").strip(BLANKS)
                if only_long and len(t) <= row[-2]:
                    continue
                spans = bisect(t, int(row[-2]), int(row[-1]))
                out += [(*row[:-3], i, s, e, len(spans), *([t[s:e]] if with_text else [])) for i, (s, e) in enumerate(spans)]
            yield pd.DataFrame(out, columns=[*keys, "chunk_index", "start", "end", "n_chunks", *["chunk"] * with_text])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, chunk_index int, start long, end long, n_chunks int" + ", chunk string" * with_text
    return df.select(*keys, text, limit, overlap).mapInPandas(run, schema)
