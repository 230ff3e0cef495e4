"""One form for texts that look the same.

Every text is folded first: characters that cannot be seen go, blanks of one width become a space,
line ends become line feeds, full-width forms and ligatures become their usual letters, and
accents are composed. Then look-alike letters are repaired by script. The dominant script of a token
is the one to which most of its letters belong that exist in no other; a token of look-alikes alone
shows none and is read as Latin. In a mixed token the letters of other scripts are replaced by their
look-alikes of the dominant one, Latin, Greek or Cyrillic alike, if the whole token can be written in
it. A second rule concerns disguised tokens: all their letters belong to one other script, and all
are look-alikes of Latin ones. Either is replaced only where the corpus itself contains the resulting
word: in one script, or behind another spelling that is repaired to it. The vocabulary is that of all
texts; it stays distributed and is joined with the candidates only.

Defined results: null texts stay null and are in no pair; a text of which nothing visible is left
folds to the empty string; copies that are equal character by character are no pair; a repaired
word that occurs nowhere else stays as it is.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from derlem.session import cut

#: Letters of other scripts with the same shape as Latin ones.
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϹϲϳ", "ABEZHIKMNOPTYXoCcj"))
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХԚԜаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTXQWaesijopcyxhdqw"))
#: Latin letters that pass for Greek ones within a Greek word, though not the other way round.
WITHIN_GREEK = {"a": "α", "v": "ν", "p": "ρ"}
LOOKALIKES = GREEK | CYRILLIC
#: Characters that leave no mark, beside all format characters (category Cf).
INVISIBLE = "\u034f\u180b\u180c\u180d\u180e\u115f\u1160"
SELECTORS = "".join(map(chr, range(0xFE00, 0xFE10)))
WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 32}
LIGATURES = {0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl", 0xFB05: "st", 0xFB06: "st"}
HYPHENS = {0x2010: "-", 0x2011: "-"}
SALTS = 16
_TOKEN = re.compile("[\\w\u0300-\u036f]+")
_FOREIGN = re.compile("[\u0370-\u03ff\u0400-\u052f]")
_OF_LATIN = {"GREEK": {v: k for k, v in GREEK.items()} | WITHIN_GREEK, "CYRILLIC": {v: k for k, v in CYRILLIC.items()}}
#: Per script, what its words put in place of a look-alike.
_TO = {
    "LATIN": str.maketrans(LOOKALIKES),
    "GREEK": str.maketrans(_OF_LATIN["GREEK"] | {c: _OF_LATIN["GREEK"][x] for c, x in CYRILLIC.items() if x in _OF_LATIN["GREEK"]}),
    "CYRILLIC": str.maketrans(_OF_LATIN["CYRILLIC"] | {g: _OF_LATIN["CYRILLIC"][x] for g, x in GREEK.items() if x in _OF_LATIN["CYRILLIC"]}),
}
_SHARED = {*LOOKALIKES, *LOOKALIKES.values()}
_ODD = re.compile(r"[^\x00-\x7fçğıöşüÇĞİÖŞÜâîûÂÎÛéèêëàäßñ’]|\r")


class _Table(dict):
    """A translation table that decides each character once."""

    def __missing__(self, code: int):
        c = chr(code)
        if code in WIDE:
            to = WIDE[code]
        elif code in LIGATURES:
            to = LIGATURES[code]
        elif code in HYPHENS:
            to = HYPHENS[code]
        elif unicodedata.category(c) == "Cf" or c in INVISIBLE or c in SELECTORS:
            to = None
        elif unicodedata.category(c) == "Zs":
            to = " "
        else:
            to = code
        self[code] = to
        return to


_FOLD = _Table()


def fold(text: str) -> str:
    """The text without differences that no reader sees, look-alike letters aside."""
    if not _ODD.search(text):
        return text
    text = text.replace("\r\n", "\n").replace("\r", "\n").translate(_FOLD)
    return unicodedata.normalize("NFC", text)


@lru_cache(maxsize=100_000)
def script(c: str) -> str:
    """The script of a letter by its Unicode name, '' for anything else."""
    return unicodedata.name(c, " ").split(" ")[0] if c.isalpha() else ""


def dominant(token: str) -> str:
    """The script of most letters that exist in one script only: Latin on a tie or without such letters, '' without any letter.

    Letters count without their accents, as a look-alike may carry one.
    """
    n: dict[str, int] = {}
    letters = [c for c in unicodedata.normalize("NFD", token) if c.isalpha()]
    for c in letters:
        if c not in _SHARED:
            n[script(c)] = n.get(script(c), 0) + 1
    return max(n, key=lambda s: (n[s], s == "LATIN")) if n else "LATIN" if letters else ""


def repair(token: str) -> str | None:
    """The token in its dominant script, if all its letters can be written in it; None if not, or if it is so already."""
    to = dominant(token)
    if to not in _TO:
        return None
    bare = unicodedata.normalize("NFD", token)
    new = unicodedata.normalize("NFC", bare.translate({ord(c): _TO[to][ord(c)] for c in set(bare) if ord(c) in _TO[to] and script(c) != to}))
    return new if new != token and all(script(c) in ("", to) for c in new) else None


def candidates(text: str) -> dict[str, str]:
    """Suspicious tokens of a folded text with their repaired forms."""
    if not _FOREIGN.search(text):
        return {}
    out = {}
    for t in set(_TOKEN.findall(text)):
        if _FOREIGN.search(t) and (new := repair(t)):
            out[t] = new
    return out


def apply_repairs(text: str, accepted: dict[str, str]) -> str:
    return _TOKEN.sub(lambda m: accepted.get(m.group(), m.group()), text) if accepted else text


def _hash(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _fold_rows(key: str, text: str, keep_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, words = [], set()
            for k, t in zip(b[key].tolist(), b[text].tolist()):
                if t is None:
                    rows.append((k, None, None, None, None, None, None))
                    continue
                f = fold(t)
                found = candidates(f)
                if not found:
                    words.update(_TOKEN.findall(f))
                else:
                    words.update(w for w in _TOKEN.findall(f) if w not in found)
                rows.append((k, _hash(t), None if found else _hash(f), f if found or keep_text else None, list(found), list(found.values()), None))
            rows.append((None, None, None, None, None, None, [w for w in words if not w.isascii() or w.isalpha() or w.isalnum()]))
            yield pd.DataFrame(rows, columns=[key, "raw", "canon", "folded", "tokens", "repaired", "words"])

    return run


def _repair_rows(key: str, keep_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, raw, f, pairs in zip(b[key].tolist(), b["raw"].tolist(), b["folded"].tolist(), b["pairs"].tolist()):
                fixed = apply_repairs(f, {p["t"]: p["r"] for p in pairs} if pairs is not None else {})
                out.append((k, raw, _hash(fixed), fixed if keep_text else None))
            yield pd.DataFrame(out, columns=[key, "raw", "canon", "folded"])

    return run


def canonical(df: DataFrame, key: str, text: str, *, keep_text: bool = True) -> DataFrame:
    """(key, raw, canon, folded): hashes of the text and of its consistent form, and that form.

    ``key`` must be unique and not null. Without ``keep_text`` the form itself is left out and only
    texts with suspicious tokens are moved.
    """
    kind = df.schema[key].dataType.simpleString()
    base = df.select(key, text).mapInPandas(
        _fold_rows(key, text, keep_text), f"`{key}` {kind}, raw binary, canon binary, folded string, tokens array<string>, repaired array<string>, words array<string>"
    )
    base = cut(base)
    plain = base.filter(F.col(key).isNotNull() & (F.col("raw").isNull() | F.col("canon").isNotNull())).select(key, "raw", "canon", "folded")
    odd = base.filter("raw is not null and canon is null")
    pair = odd.select(key, F.explode(F.arrays_zip("tokens", "repaired")).alias("p")).select(key, F.col("p.tokens").alias("t"), F.col("p.repaired").alias("r"))
    words = base.filter("words is not null").select(F.explode("words").alias("r")).distinct()
    # a word may have to be repaired in a third of all texts: its texts are salted, and the accepted words, one row each, repeated per salt
    spelled = pair.select("t", "r").distinct()
    known = words.unionByName(spelled.groupBy("r").agg(F.count("*").alias("k")).filter("k > 1").select("r")).distinct()
    accepted = spelled.join(known, "r", "left_semi")
    salted = accepted.withColumn("s", F.explode(F.array(*map(F.lit, range(SALTS)))))
    fixes = pair.select(key, "t", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("s")).join(salted, ["t", "s"]).groupBy(key).agg(F.collect_list(F.struct("t", "r")).alias("pairs"))
    schema = f"`{key}` {kind}, raw binary, canon binary, folded string"
    repaired = odd.select(key, "raw", "folded").join(fixes, key, "left").mapInPandas(_repair_rows(key, keep_text), schema)
    return plain.unionByName(repaired)


def same_looking(canon: DataFrame, key: str, *, expand: int = 256) -> DataFrame:
    """Pairs (doc_a, doc_b) whose texts differ but look the same.

    Groups of up to ``expand`` members come out with every such pair. Larger ones come out as a star:
    to look the same is the same for all members, so one pair with the group's first text for each
    member (a copy of that text meets the smallest holder of another) holds the whole group together.
    """
    # read several times: ids and hashes only
    rows = cut(canon.filter("raw is not null").select(F.col(key).alias("id"), "raw", "canon"))
    texts = rows.groupBy("canon", "raw").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    groups = texts.groupBy("canon").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.min_by(F.struct("first", "raw"), "first").alias("one")).filter("k > 1")
    empty = _hash("")
    groups = groups.filter(F.col("canon") != F.lit(empty))
    # few groups have several texts; only their members go on
    members = cut(rows.join(groups, "canon"))
    small = members.filter(F.col("n") <= expand).select("canon", "id", "raw")
    both = small.alias("a").join(small.alias("b"), (F.col("a.canon") == F.col("b.canon")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.raw") != F.col("b.raw")))
    out = both.select(F.col("a.id").alias("doc_a"), F.col("b.id").alias("doc_b"))
    large = members.filter(F.col("n") > expand).select("canon", "id", "raw", "one")
    other = large.filter(F.col("raw") != F.col("one.raw")).groupBy("canon").agg(F.min("id").alias("other"))
    star = large.join(other, "canon").filter(F.col("id") != F.col("one.first")).withColumn("to", F.when(F.col("raw") == F.col("one.raw"), F.col("other")).otherwise(F.col("one.first")))
    return out.unionByName(star.select(F.least("id", "to").alias("doc_a"), F.greatest("id", "to").alias("doc_b"))).distinct()
