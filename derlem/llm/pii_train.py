"""Training of the model in ``pii_model.npz``: ``python -m derlem.llm.pii_train TABLES [SECONDS]``.

Labelled spans come from a bounded sample of stretches (``MAX_STRETCHES``) of documents_v2. A
teacher marks what is certain: numbers with right check digits, telephones, written-out e-mail
addresses, addresses with a quarter or street (from its name on, without a usual word before it), and
names made of parts of the name list. In half of
the stretches the names are exchanged for others that are put together from the list's parts or
from random syllables, so that the model learns where and how names stand and not which they are.
In others an e-mail address, a telephone or an identity number is put between any two words, so that
these are known apart from the sentences they came in. Some stretches are learned in capitals as well.
"""

from __future__ import annotations

import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np

from derlem.llm.pii import _EMAIL, _NUM, _UP, _digits, cover, plain, valid_id
from derlem.llm.pii_model import LABELS, MODEL, Model, code

MAX_STRETCHES = 40_000
#: Characters of a window that is learned from.
LEARNED = 256
#: Windows without items per other window.
PLAIN = 0.5
_CAP = rf"[{_UP}][\w]+"
_NAMES = re.compile(rf"{_CAP}(?:(?:-|,? +\*{{0,2}}|,? ?\n){_CAP}){{0,4}}")
_ROAD = r"(?:[Mm]ahalle(?:si)?|[Mm]ah\.|MAHALLESİ|MAH\.|Mh\.|[Ss]okak|[Ss]okağı|[Ss]ok\.|SOKAK|SOKAĞI|SOK\.|Sk\.|SK\.|[Cc]addesi|[Cc]ad\.|CADDESİ|CAD\.|Cd\.|CD\.|[Bb]ulvarı|BULVARI|Bulv\.|BULV\.|Blv\.|BLV\.)"
_ADDRESS = re.compile(rf"(?:{_CAP}[ \n]){{1,2}}?{_ROAD}(?:[ \n,]+(?:(?:{_CAP}[ \n])|\d+\.[ \n])?{_ROAD})?[^;)]{{0,60}}?{_CAP}/[\n ]?{_CAP}|(?:{_CAP}[ \n]){{1,2}}?{_ROAD}(?:[ \n,]+(?:(?:{_CAP}[ \n])|\d+\.[ \n])?{_ROAD})?[^;)]{{0,40}}?\d+(?:/\d+)?")
ORDINARY = {"deniz", "yıldız", "barış", "toprak", "güneş"}


def low(s: str) -> str:
    return s.replace("İ", "i").replace("I", "ı").lower()


def upper(s: str) -> str:
    return s.replace("i", "İ").replace("ı", "I").upper()


class Names:
    """What a name looks like, from the name list: beginnings and ends that recur in it."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.full = {t: {low(a) for a, k in rows if k == t} for t in ("ad", "soyad")}
        self.parts = {}
        for t, full in self.full.items():
            heads, tails = Counter(), Counter()
            for w in full:
                for i in range(2, len(w) - 2):
                    heads[w[:i]] += 1
                    tails[w[i:]] += 1
            self.parts[t] = ({h for h, n in heads.items() if n >= 2}, {x for x, n in tails.items() if n >= 2 and len(x) >= 3})
        self.splits = {t: [(w[:i], w[i:]) for w in full for i in range(2, len(w) - 2) if w[:i] in self.parts[t][0] and w[i:] in self.parts[t][1]] for t, full in self.full.items()}

    def kind(self, word: str) -> str:
        w = low(word)
        if w in ORDINARY:
            return "word"
        for t in ("soyad", "ad"):
            if w in self.full[t]:
                return t
        for t in ("soyad", "ad"):
            heads, tails = self.parts[t]
            if any(w[:i] in heads and w[i:] in tails for i in range(2, len(w) - 2)):
                return t
        return ""

    def draw(self, r: random.Random, kind: str) -> str:
        if kind == "word":
            return r.choice(sorted(ORDINARY)).capitalize()
        (h, _), (_, x) = r.choice(self.splits[kind]), r.choice(self.splits[kind])
        if r.random() < 0.25:
            h = r.choice("bcçdfghklmnprsştvyz") + r.choice("aeıioöuü") + r.choice("lmnrkşyz")
        w = h + x
        return w[0].replace("i", "İ").replace("ı", "I").upper() + w[1:]


def teach(text: str, names: Names, usual: frozenset[str] = frozenset()) -> np.ndarray:
    """A label per character. ``usual``: words that the texts write in small letters too, so that at the beginning of a
    sentence they are no part of an address's name."""
    lab = np.zeros(len(text), np.uint8)

    def put(a: int, b: int, kind: str) -> None:
        if not lab[a:b].any():
            lab[a:b] = LABELS.index(kind)

    for m in _EMAIL.finditer(text):
        put(*m.span(), "email")
    for m in _NUM.finditer(text):
        d = _digits(m.group())
        if len(d) == 11 and valid_id(d):
            put(*m.span(), "id_no")
        elif (len(d) == 11 and d[0] == "0") or (len(d) == 12 and d[:2] == "90") or (len(d) == 14 and d[:4] == "0090"):
            put(*m.span(), "phone")
        elif len(d) == 10 and d[0] in "2345" and re.search(r"[ .\-/()]", m.group()):
            put(*m.span(), "phone")
    for m in _ADDRESS.finditer(text):
        a, b = m.span()
        first = re.match(rf"{_CAP}[ \n](?={_CAP}[ \n]{_ROAD})", text[a:])
        if first and (names.kind(first.group().strip()) or low(first.group().strip()) in usual):
            a += first.end()
        put(a, b, "address")
    for m in _NAMES.finditer(text):
        words = [(w.start() + m.start(), w.end() + m.start(), w.group()) for w in re.finditer(r"\w+", m.group())]
        run: list[tuple[int, int, str]] = []
        for w in [*words, (0, 0, "")]:
            k = names.kind(w[2]) if w[2] else ""
            if k:
                run.append((w[0], w[1], k))
                continue
            if any(x[2] != "word" for x in run):
                put(run[0][0], run[-1][1], "person")
            run = []
    return lab


def exchange(text: str, lab: np.ndarray, names: Names, r: random.Random) -> tuple[str, np.ndarray]:
    """The stretch with other names in the places of its names."""
    out, labs, at = [], [], 0
    person = LABELS.index("person")
    for m in re.finditer(r"\w+", text):
        if lab[m.start()] == person and (k := names.kind(m.group())):
            new = names.draw(r, k)
            if m.group().isupper():
                new = new.replace("i", "İ").replace("ı", "I").upper()
            out += [text[at : m.start()], new]
            labs += [lab[at : m.start()], np.full(len(new), person, np.uint8)]
            at = m.end()
    return "".join([*out, text[at:]]), np.concatenate([*labs, lab[at:]])


def telephone(r: random.Random) -> str:
    """A telephone number in one of many writings."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    area, sep = r.choice("2345") + d(2), r.choice([" ", "-", ".", "", "/"])
    head = r.choice(["0", "0 ", "+90 ", "+90", "0090", "90", "0.", "0-", ""])
    area = r.choice([area, f"({area})"])
    rest = r.choice([[3, 2, 2], [3, 4], [7], [3, 2, 2]])
    if head == "" and not sep:
        sep = " "
    return head + area + r.choice([sep, " ", sep]) + sep.join(d(n) for n in rest)


def address_of_mail(r: random.Random) -> str:
    """An e-mail address in one of many writings, hidden ones too."""
    word = lambda a, b: "".join(r.choice("abcçdefgğhıijklmnoöprsştuüvyz"[:: r.choice([1, 1, 2])]) for _ in range(r.randint(a, b)))
    local = r.choice([word(3, 10), f"{word(2, 8)}.{word(2, 9)}", f"{word(1, 8)}_{r.randint(0, 99)}", f"{word(3, 8)}{r.randint(0, 999)}", f"{word(3, 8)}+{word(2, 5)}{r.randint(0, 9)}", f"av.{word(4, 9)}"])
    end = r.choice(["com", "com.tr", "net", "org", "org.tr", "gov.tr", "edu.tr", "example", "test", "invalid"])
    at = r.choice(["@"] * 6 + [" @ ", "[at]", "(at)", " [at] ", " (at) "])
    dot = r.choice([".", "[nokta]", "(nokta)", " [dot] "]) if at not in ("@", " @ ") and r.random() < 0.5 else "."
    if r.random() < 0.05:
        at, dot = " at ", " nokta "
    mail = local + at + r.choice([word(3, 9), f"{word(3, 6)}-{word(3, 6)}", f"{word(3, 7)}.{word(3, 6)}"]).replace(".", dot) + dot + end.replace(".", dot)
    return mail.upper() if r.random() < 0.08 else mail


def identity(r: random.Random) -> str:
    """An identity number with right check digits, in one of several writings."""
    d = [r.randint(1, 9), *(r.randint(0, 9) for _ in range(8))]
    d.append((sum(d[0:9:2]) * 7 - sum(d[1:8:2])) % 10)
    d.append(sum(d) % 10)
    n = "".join(map(str, d))
    return r.choice([n, n, f"{n[:3]} {n[3:6]} {n[6:9]} {n[9:]}", f"{n[:3]}-{n[3:6]}-{n[6:9]}-{n[9:]}", f"{n[:5]} {n[5:]}"])


def transplant(text: str, lab: np.ndarray, r: random.Random) -> tuple[str, np.ndarray]:
    """The window with an item put between two of its words, so that the item is learned apart from the sentences it came in."""
    gaps = [m.start() for m in re.finditer(r" ", text) if not lab[m.start() : m.start() + 2].any()]
    if not gaps:
        return text, lab
    at = r.choice(gaps) + 1
    kind, new = r.choice([("email", address_of_mail(r)), ("email", address_of_mail(r)), ("phone", telephone(r)), ("id_no", identity(r))])
    before, after = r.choice([("", " "), ("", " "), ("(", ") "), ("<", "> "), ("", ", "), ("", ". "), (": ", " "), ("**", "** ")])
    first = len(new) - len(new.lstrip("+("))
    own = np.zeros(len(before) + len(new) + len(after), np.uint8)
    own[len(before) + first : len(before) + len(new)] = LABELS.index(kind)
    return text[:at] + before + new + after + text[at:], np.concatenate([lab[:at], own, lab[at:]])


def renumber(text: str, lab: np.ndarray, r: random.Random) -> tuple[str, np.ndarray]:
    """The stretch with other telephone numbers in the places of its own."""
    k = LABELS.index("phone")
    edge = np.flatnonzero(np.diff(np.concatenate([[0], lab == k, [0]])))
    out, labs, at = [], [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if a and text[a - 1] in "+(":
            continue
        new = telephone(r)
        first = len(new) - len(new.lstrip("+("))
        out += [text[at:a], new]
        labs += [lab[at:a], np.zeros(first, np.uint8), np.full(len(new) - first, k, np.uint8)]
        at = b
    return "".join([*out, text[at:]]), np.concatenate([*labs, lab[at:]])


def usual_words(texts: list[str], least: int = 3) -> frozenset[str]:
    """Words that stand in small letters at least ``least`` times."""
    n = Counter(w for t in texts for w in re.findall(r"\b[a-zçğıöşüâîû]{3,}\b", t))
    return frozenset(w for w, k in n.items() if k >= least)


def examples(texts: list[str], names: Names, seed: int = 3) -> tuple[list[str], list[np.ndarray]]:
    r = random.Random(seed)
    texts = list(map(plain, texts))
    usual = usual_words(texts)
    seen, xs, ys = set(), [], []
    empty = 0
    for t in texts:
        whole = teach(t, names, usual)
        # windows that begin at any place, so that the model learns to read on from the middle of a word
        shift = r.randrange(64)
        for a, b in cover(len(t), LEARNED):
            a, b = (a, b) if a == 0 else (a - shift, b - shift)
            s, lab = t[a:b], whole[a:b]
            shape = re.sub(r"\d", "0", s)
            if shape in seen:
                continue
            seen.add(shape)
            if not lab.any():
                # windows without items are many and alike
                if empty > PLAIN * len(xs) + 50:
                    continue
                empty += 1
            xs.append(s)
            ys.append(lab)
            if (lab == LABELS.index("person")).any() and r.random() < 0.5:
                s2, l2 = exchange(s, lab, names, r)
                xs.append(s2)
                ys.append(l2)
            if (lab == LABELS.index("phone")).any() and r.random() < 0.5:
                s2, l2 = renumber(s, lab, r)
                xs.append(s2)
                ys.append(l2)
            if r.random() < 0.35:
                s2, l2 = transplant(s, lab, r)
                xs.append(s2)
                ys.append(l2)
            up = upper(s)
            if r.random() < (0.08 if lab.any() else 0.1) and len(up) == len(s):
                xs.append(up)
                ys.append(lab)
            if len(xs) >= MAX_STRETCHES:
                return xs, ys
    return xs, ys


def score(model: Model, xs: list[str], ys: list[np.ndarray]) -> dict[str, tuple[float, float]]:
    """Precision and recall per type on whole runs."""
    hit, got, want = Counter(), Counter(), Counter()
    runs = lambda l: {(int(a), int(l[a])) for a in np.flatnonzero(np.diff(np.concatenate([[0], l]))) if l[a]}
    for l, y in zip(model.decode([code(x) for x in xs]), ys):
        p, q = runs(l.astype(int)), runs(y.astype(int))
        for c, s in ((hit, p & q), (got, p), (want, q)):
            c.update(k for _, k in s)
    return {LABELS[k]: (round(hit[k] / max(1, got[k]), 4), round(hit[k] / max(1, want[k]), 4)) for k in want}


def main(folder: str, seconds: float = 240) -> None:
    import pyarrow.parquet as pq

    names = Names([(r["ad"], r["tur"]) for r in pq.read_table(Path(folder, "kisi_ad_listesi.parquet")).to_pylist()])
    rows = pq.read_table(Path(folder, "documents_v2.parquet"), columns=["full_text", "markdown"])
    texts = [t for c in rows.columns for t in c.to_pylist() if t]
    random.Random(1).shuffle(texts)
    xs, ys = examples(texts, names)
    print(len(xs), "stretches", sum(map(len, xs)), "characters", Counter(LABELS[k] for y in ys for k in set(y.tolist())), flush=True)
    hold = len(xs) // 10
    model = Model()
    model.fit([code(x) for x in xs[hold:]], [y.astype(np.int64) for y in ys[hold:]], epochs=12, seconds=seconds, rate=0.015, log=lambda s: print(s, flush=True))
    print(score(model, xs[:hold], ys[:hold]))
    model.save(MODEL)


if __name__ == "__main__":
    main(sys.argv[1], *map(float, sys.argv[2:3]))
