"""Legislation: kinds, citations, structure of articles, what a title amends, names matched to laws."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from derlem.functions.text import ascii_fold, tokens
from derlem.operators.documents import articles

#: Codes of the register by kind.
CODES = {"KANUN": 1, "TUZUK": 2, "KHK": 4, "YONETMELIK": 7, "KKY": 7, "UY": 8, "TEBLIGLER": 9, "CBK": 19}
#: Endings of a title's last word before "Değişiklik" or "Yürürlükten", with the name's own form; longer ones first. None: several laws, so no single target.
ENDINGS = (
    ("Kanun Hükmünde Kararnamesinde", "Kanun Hükmünde Kararnamesi"), ("Kanun Hükmünde Kararnamelerde", None), ("Kanun Hükmünde Kararnamede", "Kanun Hükmünde Kararname"),
    ("Kararnamesinde", "Kararnamesi"), ("Kararnamelerinde", None), ("Kararnamede", "Kararname"), ("Kanununda", "Kanunu"), ("Kanunlarda", None), ("Kanunda", "Kanun"),
    ("Yönetmeliğinde", "Yönetmeliği"), ("Yönetmeliklerinde", None), ("Yönetmeliklerde", None), ("Tebliğinde", "Tebliği"), ("Tebliğlerinde", None), ("Tebliğde", "Tebliğ"),
    ("Tüzüğünde", "Tüzüğü"), ("Kararında", "Kararı"), ("Kararlarında", None), ("Kararda", "Karar"), ("Esaslarında", "Esasları"), ("Yönergesinde", "Yönergesi"),
    ("Genelgesinde", "Genelgesi"), ("Tarifesinde", "Tarifesi"), ("Talimatında", "Talimatı"), ("Statüsünde", "Statüsü"), ("Protokolünde", "Protokolü"), ("Listesinde", "Listesi"),
    ("Planında", "Planı"), ("Programında", "Programı"), ("Şartlarında", "Şartları"), ("Esaslarda", "Esaslar"), ("Şartlarda", "Şartlar"), ("Cetvelinde", "Cetveli"),
    ("Sözleşmesinde", "Sözleşmesi"), ("Yönetmelikte", "Yönetmelik"), ("Tüzükte", "Tüzük"), ("Yönergede", "Yönerge"), ("Kanununun", "Kanunu"), ("Kanunun", "Kanun"),
    ("Yönetmeliğinin", "Yönetmeliği"), ("Yönetmeliğin", "Yönetmelik"), ("Tebliğinin", "Tebliği"), ("Tebliğin", "Tebliğ"), ("Kararnamesinin", "Kararnamesi"), ("Kararının", "Kararı"),
    ("Tüzüğünün", "Tüzüğü"), ("Esaslarının", "Esasları"),
)
_VERB = re.compile(r"\s+(?:(De[ğg]i[şs]iklik\s+Yap[ıi]lmas)|(Y[üu]r[üu]rl[üu]kten\s+Kald[ıi]r[ıi]lmas))[ıi]")
_NUMBER = re.compile(r"\b(\d{3,6})\s+[Ss]ay[ıi]l[ıi]\b\s*")
_TAIL = re.compile(r"\s*\((?:Karar Say[ıi]s[ıi]|S[ıi]ra No|No)\s*:[^)]*\)\s*$")
_SEVERAL = re.compile(r"\s+(?:ile|ve)\s+Baz[ıi]\s+")
_PART = re.compile(r"^\s*(?:(?:BİRİNCİ|İKİNCİ|ÜÇÜNCÜ|DÖRDÜNCÜ|BEŞİNCİ|ALTINCI|YEDİNCİ|SEKİZİNCİ|DOKUZUNCU|ONUNCU|\d+\.)\s+(?:KİTAP|KISIM|BÖLÜM|AYIRIM)|(?:KİTAP|KISIM|BÖLÜM))\b.*$", re.MULTILINE)
_RATIONALE = re.compile(r"^[ \t]*(?:genel |madde )?gerekçe(?:si|ler|leri)?[ \t]*:?[ \t]*$", re.MULTILINE | re.IGNORECASE)


def type_code(kind: Column) -> tuple[Column, Column]:
    """(code, known): the register's code of a kind, that of a law for an unknown one."""
    code = F.try_element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), F.upper(F.trim(kind)))
    return F.coalesce(code, F.lit(CODES["KANUN"])), F.when(kind.isNotNull(), code.isNotNull())


def citation(number: str, name: str, article: str) -> Column:
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return F.concat_ws(" ", F.concat(filled(number), F.lit(" sayılı")), F.trim(F.col(name)), F.concat(F.lit("m."), filled(article)))


def prefix_hits(text: str, stems: list[str]) -> Column:
    """How many words of a text begin with one of the stems, counted for each stem."""
    toks = tokens(text)
    counts = [F.size(F.filter(toks, (lambda s: lambda x: x.startswith(s))(s))) for s in stems]
    return sum(counts[1:], counts[0])


def target(title: str | None) -> tuple[str, str | None, str | None]:
    """(kind, name, number) of what a gazette title changes: kind is amendment, repeal or new.

    The name is in its own form, without the ending it has in the title; None where the title names several laws or none.
    """
    t = _TAIL.sub("", re.sub(r"\s+", " ", title or "").strip())
    number = _NUMBER.search(t)
    verb = _VERB.search(t)
    if not verb:
        return "new", None, number[1] if number else None
    kind = "amendment" if verb[1] else "repeal"
    head = t[: verb.start()].strip()
    both = _SEVERAL.search(head)
    name: str | None = head[: both.start()] if both else None
    if not both:
        for end, own in ENDINGS:
            if head.endswith(end):
                name = None if own is None else head[: -len(end)] + own
                break
        else:
            # a tail in brackets carries its ending behind an apostrophe
            cut = re.sub(r"[’']\s*\w{1,4}$", "", head).strip()
            name = cut if cut != head else None
    name = _NUMBER.sub("", name, count=1).strip() if name else None
    return kind, name or None, number[1] if number else None


def match_names(items: DataFrame, laws: DataFrame, key: str, name: str, number: str) -> DataFrame:
    """``items`` with ``mevzuat_id`` and ``matched_by``: the law of the same folded name, else one that begins with it (15 letters at least), else the number's.

    Of several laws the smallest id counts. The beginnings meet on their first fifteen letters.
    """
    by = lambda c, k: laws.filter(F.col(c).isNotNull()).groupBy(k.alias("_k")).agg(F.min(F.trim("mevzuat_id")).alias("_id"))
    names, numbers = by("ad", ascii_fold("ad")), by("mevzuat_no", F.trim("mevzuat_no"))
    x = items.withColumn("_n", ascii_fold(name))
    x = x.join(names.withColumnsRenamed({"_k": "_n", "_id": "_exact"}), "_n", "left")
    near = x.filter(F.length("_n") >= 15).select(key, "_n", F.substring("_n", 1, 15).alias("_p")).join(names.withColumn("_p", F.substring("_k", 1, 15)), "_p").filter(F.col("_k").startswith(F.col("_n"))).groupBy(key).agg(F.min("_id").alias("_near"))
    x = x.join(near, key, "left").join(numbers.select(F.col("_k").alias(number), F.col("_id").alias("_number")), number, "left")
    how = F.when(F.col("_exact").isNotNull(), "name").when(F.col("_near").isNotNull(), "beginning").when(F.col("_number").isNotNull(), "number")
    return x.withColumns({"mevzuat_id": F.coalesce("_exact", "_near", "_number"), "matched_by": how}).drop("_n", "_exact", "_near", "_number")


def structure(text: str | None) -> list[tuple[str, str, str, str, bool]]:
    """(path, heading, number, body, is_rationale) of a law's articles, and of its rationale's sections.

    The path names the parts above an article, outermost first. The heading is the run of short lines right above it that end no
    sentence; it is taken off the body of the article before.
    """
    text = text or ""
    stop = _RATIONALE.search(text)
    law, reasons = (text[: stop.start()], text[stop.end() :]) if stop else (text, "")
    out = []
    found = articles(law)
    at = 0
    path: list[str] = []
    for number, order, body in found:
        here = law.find(body, at) if body else at
        above = law[at:here]
        for m in _PART.finditer(above):
            line = m.group().strip()
            rank = next((i for i, w in enumerate(("KİTAP", "KISIM", "BÖLÜM", "AYIRIM")) if w in line), 3)
            path = [p for p in path if next((i for i, w in enumerate(("KİTAP", "KISIM", "BÖLÜM", "AYIRIM")) if w in p), 3) < rank] + [line]
        lines = [x.strip() for x in above.splitlines()]
        while lines and (not lines[-1] or re.match(r"(?i)(?:ek |geçici |mükerrer )?madde\s", lines[-1])):
            lines.pop()
        heading: list[str] = []
        while lines and lines[-1] and len(lines[-1]) <= 120 and not lines[-1].rstrip(")]}»”’\"' ").endswith((".", "!", "?", ";")) and not _PART.match(lines[-1]):
            heading.insert(0, lines.pop())
        out.append([" > ".join(path), " > ".join(heading), number, body, False])
        # a heading of the next article stands at the end of this one's body
        rest = body.splitlines()
        tail = 0
        while order + 1 < len(found) and tail < len(rest) - 1 and rest[-1 - tail].strip() and len(rest[-1 - tail]) <= 120 and not rest[-1 - tail].rstrip(")]}»”’\"' ").endswith((".", "!", "?", ";", ",")):
            tail += 1
        if tail:
            out[-1][3] = "\n".join(rest[:-tail]).strip()
        at = here + len(out[-1][3])
    sections = [s.strip() for s in re.split(r"\n\s*\n", reasons) if s.strip()]
    return [tuple(x) for x in out] + [("", "", "", s, True) for s in sections]


def tree(rows: DataFrame, key: str, part: str, section: str, number: str, text: DataFrame) -> DataFrame:
    """(key, part, section, number, body): an outline's articles with their bodies, matched by number; bodies without a place come in a part of their own (null)."""
    o = rows.select(key, part, section, number).distinct()
    return o.join(text.select(key, number, "body"), [key, number], "full_outer").select(key, part, section, number, "body")


def latest_of(rows: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """Of rows with one key in several batches that of the latest batch."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc_nulls_last(), F.col(tie).desc())
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
