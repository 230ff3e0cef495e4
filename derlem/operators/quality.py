"""Derived states, safety reasons and counts of personal data by pattern."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from derlem.functions.keys import effective_text, strip

READABLE = ("full_text", "html_markdown")
SHORTEST = 50


def status_rank(c: str) -> Column:
    """0 for the best content status, 5 for an unknown or missing one."""
    states = [*READABLE, "pdf_link_only", "metadata_only", "unavailable"]
    return reduce(lambda w, i: w.when(F.col(c) == states[i], i), range(1, len(states)), F.when(F.col(c) == states[0], 0)).otherwise(5)


def usability(df: DataFrame) -> DataFrame:
    """``n`` (length of the stripped text), ``usable`` and ``status`` with short texts downgraded."""
    n = F.coalesce(F.length(strip(effective_text())), F.lit(0))
    readable = F.col("content_status").isin(*READABLE)
    return df.withColumns({"n": n, "usable": F.coalesce(readable & (n > 0), F.lit(False)), "status": F.when(readable & (n < SHORTEST), "metadata_only").otherwise(F.col("content_status"))})


def citation_reasons(df: DataFrame) -> DataFrame:
    """Why a record must not be cited, joined by commas; empty if it may."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    bad = [
        F.when(F.coalesce(~F.col("content_status").isin(*READABLE), F.lit(True)), "status"),
        F.when(empty("full_text") & empty("markdown"), "text"),
        F.when(empty("source_url") & empty("esas_no") & empty("karar_no"), "provenance"),
    ]
    return df.withColumn("reasons", F.concat_ws(",", *bad))


def pii_counts(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumns({k: F.regexp_count(t, F.lit(p)) for k, p in patterns.items()})
    n = reduce(lambda a, b: a + b, [F.col(k) for k in patterns])
    return out.withColumn("risk", F.when(n > 3, "high").when(n >= 1, "medium").otherwise("low"))


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(col, n, fill) in one pass."""
    full = lambda c: F.avg(F.when(F.coalesce(F.col(c), F.lit("")) != "", 1.0).otherwise(0.0))
    one = df.agg(F.count("*").alias("n"), *[F.round(full(c), 6).alias(c) for c in columns])
    return one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("fill")) for c in columns])).alias("x")).select("x.col", "n", "x.fill")


def out_of_order(rows: DataFrame, by: str, number: str) -> DataFrame:
    """(by, number, kind) of the rows whose number is below that of the row before (in the order of ``by``) or above that of the row after.

    ``rows`` has one row per day; their order is one task's work.
    """
    w = Window.orderBy(by)
    x = rows.select(by, number, F.lag(number).over(w).alias("_p"), F.lead(number).over(w).alias("_q"))
    return x.filter((F.col(number) < F.col("_p")) | (F.col(number) > F.col("_q"))).select(by, number, F.when(F.col(number) < F.col("_p"), "below_previous").otherwise("above_next").alias("kind"))


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def status_fields(df: DataFrame) -> DataFrame:
    """``label``, ``text_available``, ``content_available``, ``confidence`` and ``next_step`` of each record, derived from what it holds."""
    s = F.col("content_status")
    n = F.coalesce(F.length(strip(effective_text())), F.lit(0))
    text = F.coalesce(s.isin(*READABLE) & (n > 0), F.lit(False))
    named = _filled("title") & _filled("source")
    return df.withColumns(
        {
            "label": F.when(s == "full_text", "full text").when(s == "html_markdown", "markdown").when(s == "pdf_link_only", "link").when(s == "metadata_only", "metadata").otherwise("none"),
            "text_available": text,
            "content_available": text | F.coalesce(s == "pdf_link_only", F.lit(False)),
            "confidence": F.when(named & (_filled("decision_date") | _filled("esas_no") | _filled("karar_no")), "high").when(named, "medium").otherwise("low"),
            "next_step": F.when(s == "pdf_link_only", "verify the file").when(s == "metadata_only", "fetch the text").when(s == "unavailable", "nothing to read"),
        }
    )


def finalise(df: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """``long_enough``, ``status``, ``hash`` (null for short texts) and ``odd_date`` (a year outside the range; the date stays as it is)."""
    n = F.coalesce(F.length(strip(effective_text())), F.lit(0))
    s = F.trim("decision_date")
    year = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(s, 1, 4)).when(s.rlike(r"^\d{2}\.\d{2}\.\d{4}\z"), F.substring(s, 7, 4)).cast("int")
    return df.withColumns(
        {
            "long_enough": n >= SHORTEST,
            "status": F.when(F.col("content_status").isin(*READABLE) & (n < SHORTEST), "metadata_only").otherwise(F.col("content_status")),
            "hash": F.when(n >= SHORTEST, F.sha2(F.encode(effective_text(), "utf-8"), 256)),
            "odd_date": F.coalesce(~year.between(first_year, last_year), F.lit(False)),
        }
    )


def authority() -> Column:
    """What a record may be used for: ready, citation_only, lead_only or excluded."""
    s, t = F.col("content_status"), effective_text()
    n = F.coalesce(F.length(strip(t)), F.lit(0))
    fits = F.col("content_hash").isNull() | F.coalesce((F.length(t) > 0) & (F.sha2(F.encode(t, "utf-8"), 256) == F.col("content_hash")), F.lit(False))
    citable = F.coalesce(s.isin(*READABLE), F.lit(False)) & (n > 0) & (_filled("source_url") | _filled("esas_no") | _filled("karar_no"))
    known = reduce(lambda a, b: a | b, [_filled(c) for c in ("title", "court", "decision_date", "esas_no", "karar_no", "source_url")])
    return F.when((s == "unavailable") | ~fits, "excluded").when(citable & (n >= SHORTEST), "ready").when(citable | (known & F.coalesce(s == "pdf_link_only", F.lit(False))), "citation_only").when(known, "lead_only").otherwise("excluded")


def consistency(df: DataFrame, before: int) -> DataFrame:
    """(finding, court, n): decisions before a year, and courts with several decisions."""
    court = F.coalesce("court", F.lit("")).alias("court")
    day = strip("decision_date")
    old = df.filter(day.rlike(r"^\d{4}-\d{2}-\d{2}\z") & (F.substring(day, 1, 4).cast("int") < before)).groupBy(court).agg(F.count("*").alias("n"))
    same = df.groupBy(court).agg(F.count("*").alias("n")).filter("n >= 2")
    return old.select(F.lit("old_decision").alias("finding"), "court", "n").unionByName(same.select(F.lit("same_court").alias("finding"), "court", "n"))


def findings(df: DataFrame, key: str, text: str, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, kind, value, confidence, n, first_pos) of what patterns (kind: (pattern, confidence)) find; positions count from 0."""

    def found(kind: str, pattern: str, sure: str) -> Column:
        one = lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(sure).alias("confidence"), F.instr(F.col(text), v).alias("at"))
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one)

    each = [found(k, p, c) for k, (p, c) in patterns.items()]
    x = df.filter(F.col(text).isNotNull()).select(key, F.explode(F.concat(*each)).alias("x")).select(key, "x.*")
    return x.groupBy(key, "kind", "value", "confidence").agg(F.count("*").alias("n"), (F.min("at") - 1).cast("long").alias("first_pos"))
