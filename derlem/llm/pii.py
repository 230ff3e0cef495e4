"""Personal information inside free text: find it and put typed placeholders in its place.

A character-level BiLSTM with a CRF (``pii_model``), trained on windows of whole texts, reads every character:
long texts are covered by overlapping windows and each character takes the label of the window in whose middle
it lies, so that an item is decoded once for the whole text. Exact checks follow: check digits of identity
numbers, the number of a telephone's digits, a domain behind an e-mail's sign; items begin and end with whole
words. Odd blanks, hyphens and full-width forms are read as plain ones.

Defined results: null and empty texts have no items and stay as they are; the same occurrence of a
record delivered again counts once; items do not overlap; everything outside items is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from derlem.llm.pii_model import LABELS, code, trained

WINDOW = 512
OVERLAP = 48
_UP = "A-ZÇĞİÖŞÜÂÎÛ"
#: Signs that are read as a plain one of the same width, so that positions stay: blanks, hyphens, full-width forms.
_PLAIN = {ord("\r"): " ", 0xA0: " ", 0x1680: " ", **{c: " " for c in range(0x2000, 0x200B)}, 0x202F: " ", 0x205F: " ", 0x3000: " ", **{c: "-" for c in range(0x2010, 0x2016)}, **{c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}}
_AS = {chr(c): x for c, x in _PLAIN.items()}
_SIGNS = re.compile("[" + re.escape("".join(_AS)) + "]")
_AT = r"(?: ?@ ?| ?[\[(] ?at ?[\])] ?)"
_DOT = r"(?:\.| ?[\[(] ?(?:nokta|dot) ?[\])] ?)"
_EMAIL = re.compile(rf"[\w.+\-]+{_AT}[\w\-]+(?:{_DOT}[\w\-]+)+|[\w.+\-]+ at [\w\-]+(?: (?:nokta|dot) [\w\-]+)+")
_WORDS = re.compile(r"[^\W_]")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in LABELS[1:]}


def plain(text: str) -> str:
    """The text with odd blanks, hyphens and full-width forms as plain ones, character by character."""
    return _SIGNS.sub(lambda m: _AS[m.group()], text)


def cover(n: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Overlapping windows over a text of length n, as few as there can be and of one size."""
    if n <= window:
        return [(0, n)]
    k = -(-(n - OVERLAP) // (window - OVERLAP))
    size = -(-(n + OVERLAP * (k - 1)) // k)
    return [(s, s + size) for s in (i * (n - size) // (k - 1) for i in range(k))]


def stitch(n: int, parts: list[tuple[int, int]], labels: list[np.ndarray]) -> np.ndarray:
    """One label per character: that of the window in which it lies farthest from an edge, so each overlap is cut in its middle."""
    if len(parts) == 1:
        return labels[0]
    cuts = [0, *((a + b + 1) // 2 for (_, b), (a, _) in zip(parts, parts[1:])), n]
    return np.concatenate([lab[x - a : y - a] for lab, (a, _), x, y in zip(labels, parts, cuts, cuts[1:])])


def label_texts(texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, end, label) of each text, every character of which is read. Equal windows of one call are decoded once."""
    seqs: dict[bytes, int] = {}
    cut, todo = [], []
    for t in texts:
        c = code(t)
        parts = cover(len(t)) if t else []
        own = []
        for x, y in parts:
            w = c[x:y]
            at = seqs.setdefault(w.tobytes(), len(cut))
            if at == len(cut):
                cut.append(w)
            own.append(at)
        todo.append((parts, own))
    got = trained().decode(cut) if cut else []
    some = [x.any() for x in got]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, (parts, own) in enumerate(todo):
        if any(some[k] for k in own):
            n = len(texts[i])
            lab = stitch(n, parts, [got[k] for k in own])
            bounds = [0, *(np.flatnonzero(np.diff(lab)) + 1).tolist(), n]
            out[i] = [(x, y, int(lab[x])) for x, y in zip(bounds, bounds[1:]) if lab[x]]
    return out


def valid_id(digits: str) -> bool:
    """Check digits of an eleven-digit identity number."""
    d = [int(c) for c in digits]
    if len(d) != 11 or d[0] == 0:
        return False
    odd, even = sum(d[0:9:2]), sum(d[1:8:2])
    return (odd * 7 - even) % 10 == d[9] and sum(d[:10]) % 10 == d[10]


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


_NUM = re.compile(r"\d(?:[ .\-/()–\t]{0,3}\d)*")


_ROAD = re.compile(r"\b(?:mah|mh|sok|sk|cad|cd|bul|blv)", re.IGNORECASE)


def label_is_tail(text: str, a: int) -> bool:
    """Whether a run can only be the rest of an address that a line end cut in two."""
    return bool(_ROAD.search(text, max(0, a - 60), a)) and bool(re.search(r"[\n,/]\s?$", text[max(0, a - 3) : a]))


def check(text: str, a: int, b: int, label: int) -> list[tuple[int, int, int]]:
    """Exact form of a decoded run: whole words, right digits; nothing if it cannot be an item."""
    kind = LABELS[label]
    if kind in ("phone", "id_no"):
        # the whole number first, then what lies in the run alone (two numbers may stand side by side)
        for low, high in ((max(0, a - 24), b + 24), (max(0, a - 2), b + 3)):
            out = []
            for m in _NUM.finditer(text, low, min(len(text), high)):
                s, e = m.span()
                while s > 0 and text[s - 1].isdigit():
                    s -= 1
                while e < len(text) and text[e].isdigit():
                    e += 1
                d = _digits(text[s:e])
                if s >= b or e <= a:
                    continue
                if len(d) == 11 and valid_id(d):
                    out.append((s, e, 3))
                elif kind == "phone" and (len(d) == 10 and d[0] in "2345" and e - s > 10 or len(d) == 11 and d[0] == "0" or len(d) == 12 and d[:2] == "90" or len(d) == 14 and d[:4] == "0090"):
                    out.append((s, e, 2))
            if out:
                return out
        return []
    if kind == "email":
        return [(m.start(), m.end(), 1) for m in _EMAIL.finditer(text, max(0, a - 40), min(len(text), b + 40)) if m.start() < b and m.end() > a]
    while a > 0 and _WORDS.match(text[a]) and _WORDS.match(text[a - 1]):
        a -= 1
    while b < len(text) and _WORDS.match(text[b - 1]) and _WORDS.match(text[b]):
        b += 1
    while a < b and not _WORDS.match(text[a]):
        a += 1
    while b > a and not _WORDS.match(text[b - 1]):
        b -= 1
    if kind == "person":
        return [(a, b, label)] if b - a >= 2 else []
    return [(a, b, label)] if _ROAD.search(text, a, b) or label_is_tail(text, a) else []


def _joined(text: str | None, items: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Addresses that only white space or a comma parts (a line end inside) are one."""
    out: list[tuple[int, int, int]] = []
    for i in sorted(set(items)):
        if out and i[2] == out[-1][2] == 4 and i[0] - out[-1][1] <= 3 and not _WORDS.search(text[out[-1][1] : i[0]]):
            out[-1] = (out[-1][0], max(i[1], out[-1][1]), 4)
        else:
            out.append(i)
    return out


def find_items(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the items of one text."""
    return find_all([text])[0]


def find_all(texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    texts = [plain(t) if t else "" for t in texts]
    out = []
    for t, found in zip(texts, label_texts(texts)):
        items = []
        for a, b, k in found:
            items += check(t, a, b, k)
        items = [i for i in _joined(t, items) if i[2] != 4 or _ROAD.search(t, i[0], i[1])]
        # numbers and addresses come before names that lie within them
        items = sorted(set(items), key=lambda i: (i[2] == 5, i[0], -i[1]))
        kept: list[tuple[int, int, int]] = []
        taken: list[tuple[int, int]] = []
        for i in items:
            if not any(i[0] < e and b < i[1] for b, e in taken):
                kept.append(i)
                taken.append((i[0], i[1]))
        out.append([(a, b, LABELS[k]) for a, b, k in sorted(kept)])
    return out


def redact(text: str, items: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder in place of each item."""
    out, at = [], 0
    for a, b, k in items:
        out += [text[at:a], PLACEHOLDER[k]]
        at = b
    return "".join([*out, text[at:]])


def find(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, pii_type, start_pos, end_pos) per occurrence in each delivered row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f in fields:
                for k, items in zip(b[key].tolist(), find_all(b[f].tolist())):
                    rows += [(k, f, kind, a, e) for a, e, kind in items]
            yield pd.DataFrame(rows, columns=[key, "field_name", "pii_type", "start_pos", "end_pos"])

    return df.select(key, *fields).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, field_name string, pii_type string, start_pos long, end_pos long")


def redacted(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fields) with placeholders."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {key: b[key]}
            for f in fields:
                texts = b[f].tolist()
                out[f] = [redact(t, i) if t else t for t, i in zip(texts, find_all(texts))]
            yield pd.DataFrame(out)

    kinds = ", ".join(f"`{f}` string" for f in fields)
    return df.select(key, *fields).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {kinds}")
