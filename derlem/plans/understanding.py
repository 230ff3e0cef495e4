"""What a query says beside its words: stems, synonyms, laws by their short names, courts and chambers. Driver-side, on one string."""

from __future__ import annotations

import re
from collections.abc import Iterator

from derlem.plans.queries import low

#: Endings of Turkish words by class: plural, genitive, locative, ablative, possessive, dative, accusative, instrumental, copula, infinitive, negation.
ENDINGS = (
    ("lar", "ler"), ("nın", "nin", "nun", "nün"), ("da", "de", "ta", "te"), ("dan", "den", "tan", "ten"), ("ın", "in", "un", "ün"), ("a", "e"),
    ("ı", "i", "u", "ü"), ("la", "le"), ("dir", "dır", "dur", "dür", "tir", "tır", "tur", "tür"), ("mek", "mak"), ("me", "ma"),
)
#: Words with what a search for them should also find.
SYNONYMS = {
    "tazminat": ["tazminat", "zarar", "maddi tazminat", "manevi tazminat"],
    "kira": ["kira", "kiralayan", "kiracı", "kira bedeli", "tahliye"],
    "işçi": ["işçi", "işveren", "iş akdi", "kıdem tazminatı", "ihbar tazminatı"],
    "sözleşme": ["sözleşme", "akit", "mukavele", "sözleşme ihlali"],
    "boşanma": ["boşanma", "evlilik birliği", "nafaka", "velayet"],
    "icra": ["icra", "icra takibi", "haciz", "iflas"],
    "mülkiyet": ["mülkiyet", "mülkiyet hakkı", "taşınmaz", "gayrimenkul"],
    "miras": ["miras", "mirasçılık", "vasiyetname", "tereke"],
    "ceza": ["ceza", "suç", "mahkumiyet", "hapis"],
    "idari": ["idari", "idare", "idari işlem", "iptal davası"],
}
#: Short names of laws with number and name.
LAWS = {
    "iyuk": ("2577", "İdari Yargılama Usulü Kanunu"), "hmk": ("6100", "Hukuk Muhakemeleri Kanunu"), "tck": ("5237", "Türk Ceza Kanunu"), "cmk": ("5271", "Ceza Muhakemesi Kanunu"),
    "tbk": ("6098", "Türk Borçlar Kanunu"), "tmk": ("4721", "Türk Medeni Kanunu"), "iik": ("2004", "İcra ve İflas Kanunu"), "kvkk": ("6698", "Kişisel Verilerin Korunması Kanunu"),
    "fsek": ("5846", "Fikir ve Sanat Eserleri Kanunu"), "ttk": ("6102", "Türk Ticaret Kanunu"), "sgk": ("5510", "Sosyal Sigortalar ve Genel Sağlık Sigortası Kanunu"),
    "iskanunu": ("4857", "İş Kanunu"), "imarkhk": ("556", "Markaların Korunması Hakkında KHK"),
}
#: Courts as queries name them, with the name under which they are filtered.
COURTS = ((r"yargıtay", "Yargitay"), (r"danıştay", "Danistay"), (r"anayasa\s+mahkemesi", "Anayasa Mahkemesi"), (r"aym", "Anayasa Mahkemesi"), (r"uyuşmazlık\s+mahkemesi", "Uyusmazlik"), (r"sayıştay", "Sayistay"))
_CHAMBER = re.compile(r"\d+\.?\s*(?:hukuk|ceza)\s+dairesi")
_LAW = re.compile(r"\b(" + "|".join(LAWS) + r")\b(?:\s*(?:madde|md\.?|m\.)?\s*(\d+(?:[/-]\d+)?)\b)?")


def _shorter(word: str) -> Iterator[str]:
    for ends in ENDINGS:
        for e in ends:
            if word.endswith(e) and len(word) - len(e) >= 2:
                yield word[: -len(e)]


def stems(word: str) -> list[str]:
    """What is left of a word after taking off one ending or two, in the order of the classes, each once; words below three letters stay."""
    if len(word) < 3:
        return [word]
    return list(dict.fromkeys(x for s in _shorter(word) for x in (s, *_shorter(s))))


def expand(terms: list[str]) -> list[str]:
    """The terms, then their stems, each once."""
    return list(dict.fromkeys([*terms, *(s for t in terms for s in stems(t))]))


def synonyms(query: str) -> list[str]:
    """Words and phrases to add to a query, sorted; those it has already are left out."""
    words = re.findall(r"\w+", low(query))
    return sorted({s for w in words for s in SYNONYMS.get(w, [])} - set(words))


def law_references(query: str) -> tuple[str, list[tuple[str, str]]]:
    """The query with short names of laws as number, name and article, and the (original, new) pairs.

    Short names without an article are replaced only where none has one.
    """
    found = list(_LAW.finditer(low(query)))
    with_article = [m for m in found if m[2]]
    pairs, out, at = [], [], 0
    for m in with_article or found:
        number, name = LAWS[m[1]]
        new = f"{number} ({name})" + (f" m.{m[2]}" if m[2] else "")
        pairs.append((query[m.start() : m.end()], new))
        out += [query[at : m.start()], new]
        at = m.end()
    return "".join([*out, query[at:]]).strip(), pairs


def court_filters(query: str) -> tuple[dict[str, str], str]:
    """(court and chamber named in a query, confidence by how many of them were found)."""
    q = low(query)
    got = {}
    for pattern, name in COURTS:
        if re.search(rf"\b{pattern}\b", q):
            got["court"] = name
            break
    if m := _CHAMBER.search(q):
        got["chamber"] = query[m.start() : m.end()].strip()
    return got, ("low", "medium", "high")[len(got)]


def sanitise(query: str) -> str:
    """A query in the signs that a Solr-like service accepts: quoted phrases stay, numbers with a slash become phrases, other signs blanks."""
    parts = []
    for quoted, bare in re.findall(r'"([^"]*)"|([^\s"]+)', query):
        clean = re.sub(r"[^\w\s+\-*]", " ", quoted or bare, flags=re.UNICODE)
        clean = re.sub(r"\s+", " ", clean).strip()
        if clean:
            parts.append(f'"{clean}"' if quoted or re.search(r"\w/\w", bare) else clean)
    return " ".join(parts)


def require_all(query: str) -> str:
    """A bare query of several terms with every term required; one that has operators already stays."""
    parts = re.findall(r'[+\-]?"[^"]*"|\S+', query)
    if len(parts) < 2 or any(p in ("AND", "OR", "NOT") or p[0] in "+-" for p in parts):
        return query
    return " ".join(f"+{p}" for p in parts)


def lucene(query: str, *, country: str | None = "TUR", article: str | None = None, languages: list[str] | None = None, first: str | None = None, last: str | None = None) -> str:
    """A Lucene query for a court's register: country (None for all), article, any of the languages, a range of days, then the words."""
    clean = lambda v: v.replace('"', "")
    parts = ["contentsitename:ECHR"]
    parts += [f'({f}:"{clean(v)}")' for f, v in (("respondent", country), ("article", article)) if v]
    if languages:
        one = " OR ".join(f'languageisocode:"{clean(x).upper()}"' for x in languages)
        parts.append(f"({one})")
    parts += [f'(kpdate{op}"{day[:10]}T{clock}.0Z")' for op, day, clock in ((">=", first, "00:00:00"), ("<=", last, "23:59:59")) if day]
    return " AND ".join([*parts, *([f"({query.strip()})"] if query.strip() else [])])


def total_pages(total: int | None, size: int) -> int | None:
    """Pages of at most a hundred results; none for none, unknown for an unknown total."""
    return None if total is None else -(-total // min(max(size, 1), 100))


def sort_order(query: str, asked: str | None) -> str:
    """relevance where there are words, else date; what was asked for holds if it is known."""
    known = ("relevance", "date", "registered", "gazette_date")
    return asked.lower() if asked and asked.lower() in known else "relevance" if query.strip() else "date"
