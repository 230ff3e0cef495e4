"""Structure of documents: HTML, paragraphs, pages, articles, amendment notes, differences.

These walk a text from its start, each step depending on the one before, which no column
expression can say; they run in Arrow batches. Null and empty texts have no parts.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden = 0
        self.lines: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data: str) -> None:
        if not self.hidden and (line := data.strip()):
            self.lines.append(line)


def html_to_text(html: str | None) -> str:
    """One text node a line, without scripts and styles."""
    p = _Text()
    p.feed(html or "")
    p.close()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(p.lines))


def paragraph_spans(text: str) -> list[tuple[int, int]]:
    """Offsets of the paragraphs: what blank lines part, or, in a text without any, what line ends part; white space around them is none of them."""
    gap = re.compile(r"\n\s*\n" if re.search(r"\S\s*\n\s*\n\s*\S", text) else r"\n")
    edges = [(m.start(), m.end()) for m in gap.finditer(text)]
    raw = zip([0, *(e for _, e in edges)], [*(s for s, _ in edges), len(text)])
    tight = ((a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())) for a, b in raw)
    return [(a, b) for a, b in tight if a < b]


def chunk_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Offsets of the chunks of a text, each at most ``size`` long.

    The places where a chunk may begin are fixed first: the beginnings of paragraphs and, in a paragraph above the size, every
    ``size - overlap`` characters. A chunk reaches from one of them to the last end that fits; then it takes in what the chunk
    before ends with, up to ``overlap`` characters and the size, from a word on unless it goes on inside a paragraph.
    """
    step = size - overlap
    ends = {}  # where a unit may begin -> (its end, whether it opens a paragraph)
    for a, b in paragraph_spans(text):
        ends |= {p: (min(p + step, b), p == a) for p in range(a, b, step)} if b - a > size else {a: (b, True)}
    begins = sorted(ends)
    cuts, i = [], 0
    while i < len(begins):
        reach = bisect_right(begins, begins[i] + size)
        j = max((k for k in range(i, reach) if ends[begins[k]][0] <= begins[i] + size), default=i)
        cuts.append((begins[i], ends[begins[j]][0]))
        i = j + 1
    out = cuts[:1]
    for a, b in cuts[1:]:
        low = max(a - overlap, b - size, 0)
        word = re.compile(r"(?<=\s)\S").search(text, low, a) if ends[a][1] and low and not text[low - 1].isspace() else None
        out.append((word.start() if word else low, b))
    return out


def chunk(text: str | None, size: int = 1600, overlap: int = 200) -> list[str]:
    """The chunks of a text without the white space around it, as they stand in it; a blank text has none."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and the overlap at least 0 and below it")
    text = (text or "").strip()
    if len(text) <= size:
        return [text] if text else []
    return [text[a:b] for a, b in chunk_spans(text, size, overlap)]


def pages(text: str | None, limit: int = 40_000) -> list[str]:
    """Pages of at most ``limit`` characters that end with a paragraph, else a sentence, else a word."""
    rest, out = text or "", []
    while len(rest) > limit:
        window = rest[:limit]
        at = 0
        for mark in ("\n\n", "\n", ". ", " "):
            k = window.rfind(mark)
            if k > limit // 2:
                at = k + len(mark)
                break
        at = at or limit
        out.append(rest[:at])
        rest = rest[at:]
    return [*out, rest] if rest else out


_HEAD = re.compile(r"^[ \t]*(?:(ek geçici|geçici|ek|mükerrer)\s+)?madde\s+(\d+(?:\s*/\s*[a-zçğıöşü])?)\s*[-–—]\s*", re.MULTILINE)


def articles(text: str | None) -> list[tuple[str, int, str]]:
    """(number, order, body) of the articles of a law, up to its rationale."""
    text = text or ""
    low = text.replace("İ", "i").replace("I", "ı").lower()
    if len(low) != len(text):  # a letter that grows in lower case would shift the positions
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text.replace("İ", "i").replace("I", "ı"))
    stop = re.search(r"^[ \t]*(?:genel |madde )?gerekçe(?:si|ler|leri)?[ \t]*:?[ \t]*$", low, re.MULTILINE)
    end = stop.start() if stop else len(text)
    heads = [m for m in _HEAD.finditer(low) if m.start() < end]
    out = []
    for i, m in enumerate(heads):
        upto = heads[i + 1].start() if i + 1 < len(heads) else end
        number = re.sub(r"\s+", "", text[m.start(2) : m.end(2)])
        kind = (m.group(1) or "").title().replace("Geçi̇ci", "Geçici")
        out.append((f"{kind} {number}".strip(), i, text[m.end() : upto].strip()))
    return out


#: Kinds of amendment by the beginning of their label.
_KINDS = {"değişik": "degisik", "degisik": "degisik", "ek": "ek", "mülga": "mulga", "mulga": "mulga", "iptal": "iptal"}
_NOTE = re.compile(r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)")
_PART = re.compile(r"(?P<kind>değişik|degisik|ek|mülga|mulga|iptal)(?:\s+(?P<scope>fıkra|bent|cümle|ibare|başlık))?\s*:", re.IGNORECASE)
_FROM = re.compile(r"(?:(\d{1,2})/(\d{1,2})/(\d{4})\s*[-–]\s*)?((?:KHK[-/ ]?)?\d+)\s*/\s*(\d+)\s*md", re.IGNORECASE)
_GAZETTE = re.compile(r"\bRG\s*[-–:]?\s*(\d{1,2})[/.](\d{1,2})[/.](\d{4})\s*[-–]\s*(\d+)")
_CASE = re.compile(r"\bE\.?\s*:?\s*(\d{4}/\d+)")
_DECISION = re.compile(r"\bK\.?\s*:?\s*(\d{4}/\d+)")
_FOOTNOTE = re.compile(r"\s*(?:\((\d{1,3})\)|\[(\d{1,3})\])")
#: The fields of an amendment as a schema.
AMENDMENT = "scope string, kind string, date string, by_no string, by_article string, gazette_date string, gazette_no string, court_case string, court_decision string, footnote int, raw string"


def _iso(d: str, m: str, y: str) -> str:
    return f"{y}-{int(m):02d}-{int(d):02d}"


def amendments(text: str | None) -> list[tuple]:
    """The notes in brackets as rows of ``AMENDMENT``, each once; what a note does not say is None.

    A bracket may hold several notes and one level of inner brackets; a number in brackets right behind it is its footnote.
    """
    text = text or ""
    out: dict = {}
    for m in _NOTE.finditer(text):
        note = re.sub(r"\s+", " ", m.group(1)).strip()
        marks = list(_PART.finditer(note))
        foot = _FOOTNOTE.match(text, m.end())
        for i, p in enumerate(marks):
            item = note[p.end() : marks[i + 1].start() if i + 1 < len(marks) else len(note)]
            f, g, case, decision = _FROM.search(item), _GAZETTE.search(item), _CASE.search(item), _DECISION.search(item)
            row = (
                (p["scope"] or "madde").lower(), _KINDS[p["kind"].lower().replace("i̇", "i")], _iso(*f.groups()[:3]) if f and f[3] else None, f[4] if f else None, f[5] if f else None,
                _iso(*g.groups()[:3]) if g else None, g[4] if g else None, case[1] if case else None, decision[1] if decision else None, int(foot[1] or foot[2]) if foot else None, f"({note})",
            )
            out[row] = None
    return list(out)


def line_changes(old: str | None, new: str | None) -> list[tuple[str, str]]:
    """(+ or -, line) between two texts."""
    d = difflib.ndiff((old or "").splitlines(), (new or "").splitlines())
    return [(x[0], x[2:]) for x in d if x[0] in "+-"]


def over_fetch(limit: int) -> int:
    """How many results to fetch where some of them will be folded into others."""
    return min(max(3 * limit, limit + 40), 300)


def _places(text: str, words: list[str]) -> list[tuple[int, int]]:
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text.translate(str.maketrans("İI", "iı")))
    return sorted({m.span() for w in words for m in re.finditer(rf"(?<![^\W\d_]){re.escape(w)}", low)})


def regions(text: str | None, words: list[str], around: int = 60, gap: int = 10, most: int = 3) -> str:
    """The first ``most`` places of the words with what stands around them, neighbours joined, hits in bold, cuts as dots."""
    text = text or ""
    spans: list[list[int]] = []
    hits = _places(text, words)
    for a, b in hits:
        a, b = max(0, a - around), min(len(text), b + around)
        if spans and a <= spans[-1][1] + gap:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    out = []
    for a, b in spans[:most]:
        piece, at = "", a
        for x, y in hits:
            if a <= x and y <= b and x >= at:
                piece += text[at:x] + f"**{text[x:y]}**"
                at = y
        out.append(("…" if a else "") + piece + text[at:b] + ("…" if b < len(text) else ""))
    return " ".join(out) or text[:300]


def word_window(text: str | None, words: list[str], size: int = 24) -> str:
    """The ``size`` words of a text that hold most of the hits (words that begin with one searched for), hits between « and »."""
    text = text or ""
    toks = [m.span() for m in re.finditer(r"\w+", text)]
    starts = {a for a, _ in _places(text, words)}
    hit = [a in starts for a, _ in toks]
    n = len(toks)
    if n == 0:
        return ""
    run = sum(hit[:size])
    best, first = run, 0
    for i in range(1, max(1, n - size + 1)):
        run += hit[i + size - 1] - hit[i - 1]
        if run > best:
            best, first = run, i
    last = min(n, first + size) - 1
    out, at = "…" if first else "", toks[first][0]
    for (a, b), h in zip(toks[first : last + 1], hit[first : last + 1]):
        out += text[at:a] + (f"«{text[a:b]}»" if h else text[a:b])
        at = b
    return out + ("…" if last < n - 1 else "")


def chunk_text(text: str | None, number: int, most: int = 600) -> str:
    """What a search shows of a text's chunk: its white space as single blanks, cut after a word."""
    own = chunk(text)
    t = " ".join(own[number].split()) if 0 <= number < len(own) else ""
    return t if len(t) <= most else t[: t.rfind(" ", 0, most + 1) if " " in t[: most + 1] else most]


def parts(df: DataFrame, keys: list[str], text: str, cut_up: Callable[[str | None], list], fields: str) -> DataFrame:
    """Rows (keys, position, fields) from a function that cuts one text; ``fields`` is a schema string."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*keys, "position", *[f.split()[0] for f in fields.split(",")]]
        for b in batches:
            rows = []
            for r in b[[*keys, text]].itertuples(index=False):
                for i, p in enumerate(cut_up(r[-1])):
                    rows.append((*r[:-1], i, *(p if isinstance(p, tuple) else (p,))))
            yield pd.DataFrame(rows, columns=names)

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, text).mapInPandas(run, f"{kinds}, position int, {fields}")
