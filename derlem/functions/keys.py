"""Canonical keys, blanks and effective texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of Unicode's White_Space property plus the byte order mark.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def strip(c: Column | str) -> Column:
    """``c`` without surrounding white space of any kind; null stays null."""
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def fold_key(c: Column | str) -> Column:
    """The form in which ids compare: no surrounding blanks, lower case."""
    return F.lower(strip(c))


def pair_key(a: Column | str, b: Column | str) -> Column:
    """One comparable string for a composite key; a null part counts as empty."""
    return F.concat_ws("\x1f", F.coalesce(fold_key(a), F.lit("")), F.coalesce(fold_key(b), F.lit("")))


def is_blank(c: Column | str) -> Column:
    """True for null, empty and white-space-only strings."""
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def effective_text(full: str = "full_text", other: str = "markdown") -> Column:
    """``full`` or, where that is null or blank, ``other``."""
    return F.when(~is_blank(full), F.col(full)).otherwise(F.col(other))
