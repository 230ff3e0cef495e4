"""Query languages, parsed on the driver into plans of columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from derlem.functions.text import lower_tr, tokens

_TR = str.maketrans("İI", "iı")


def low(s: str) -> str:
    return s.translate(_TR).lower()


def starts(prefix: str):
    """A one-argument test; a default argument would be taken for the element's index."""
    return lambda x: x.startswith(prefix)


@dataclass
class Match:
    """Terms and phrases that must all occur."""

    terms: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)
    prefix: bool = False

    def column(self, toks: Column) -> Column | None:
        """A predicate on a token array; None without any term, as no search is meant then."""
        parts = []
        for t in self.terms:
            parts.append(F.exists(toks, starts(t)) if self.prefix else F.array_contains(toks, t))
        parts += [has_phrase(toks, p) for p in self.phrases]
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out


def has_phrase(toks: Column, words: list[str]) -> Column:
    """Whether the words stand side by side in the token array."""
    joined = F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))
    return joined.contains(" " + " ".join(words) + " ")


def parse_match(query: str, *, prefix: bool = False, reserved: tuple[str, ...] = ()) -> Match:
    """Quoted spans are phrases, other words terms; operators have no meaning here."""
    m = Match(prefix=prefix)
    for quoted, bare in re.findall(r'"([^"]*)"|(\S+)', query):
        words = [low(w) for w in re.findall(r"\w+", quoted or bare)]
        if quoted and len(words) > 1:
            m.phrases.append(words)
        else:
            m.terms += [w for w in words if w.upper() not in reserved]
    return m


class BooleanQuery:
    """AND, OR, NOT, parentheses, phrases; words match by their beginning, side by side means AND."""

    def __init__(self, query: str) -> None:
        self.items = re.findall(r'\(|\)|"[^"]*"|[^\s()"]+', query)
        self.at = 0

    def _peek(self) -> str | None:
        return self.items[self.at] if self.at < len(self.items) else None

    def _or(self, text: Column, toks: Column) -> Column:
        left = self._and(text, toks)
        while self._peek() == "OR":
            self.at += 1
            left = left | self._and(text, toks)
        return left

    def _and(self, text: Column, toks: Column) -> Column:
        left = self._not(text, toks)
        while (p := self._peek()) is not None and p not in (")", "OR"):
            if p == "AND":
                self.at += 1
            left = left & self._not(text, toks)
        return left

    def _not(self, text: Column, toks: Column) -> Column:
        p = self._peek()
        if p is None or p == ")":
            raise ValueError("the query ends where a term should stand")
        self.at += 1
        if p == "NOT":
            return ~self._not(text, toks)
        if p == "(":
            inner = self._or(text, toks)
            if self._peek() != ")":
                raise ValueError("a parenthesis is not closed")
            self.at += 1
            return inner
        if p.startswith('"'):
            return text.contains(low(p.strip('"')))
        return F.exists(toks, starts(low(p)))

    def column(self, text: str) -> Column:
        if not self.items:
            raise ValueError("an empty query would select everything")
        whole = lower_tr(F.coalesce(F.col(text), F.lit("")))
        out = self._or(whole, tokens(text))
        if self._peek() is not None:
            raise ValueError("a parenthesis has no beginning")
        return out
