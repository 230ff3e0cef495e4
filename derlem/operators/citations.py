"""Citations between decisions: candidates in the text, matches in the corpus, classified edges.

All of it is column work: lines are exploded, fields cut out by patterns, and candidates meet
records on numbers in two equi-joins instead of one join over alternatives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from derlem.operators.judging import citation_match

COURT = r"(Yargıtay|Danıştay|Anayasa Mahkemesi|Bölge Adliye Mahkemesi|Bölge İdare Mahkemesi|Sayıştay|Uyuşmazlık Mahkemesi)"
CHAMBER = r"(\d{1,2}\.\s*(?:Hukuk|Ceza|İdari Dava)?\s*Daire(?:si)?)"
#: A number named before is surer than one whose kind follows it.
ESAS = (r"(?i)esas(?:\s*no)?\s*[:.]?\s*(\d{4}/\d+)", r"(\d{4}/\d+)\s*(?:E\.|[Ee]sas)")
KARAR = (r"(?i)karar(?:\s*no)?\s*[:.]?\s*(\d{4}/\d+)", r"(\d{4}/\d+)\s*(?:K\.|sayılı (?:ilam|karar))")
DATE = r"(\d{2})\.(\d{2})\.(\d{4})"


def plain_number(c: Column) -> Column:
    """The year/number in a string, without blanks and without zeros in front of the number; null where there is none."""
    n = F.regexp_extract(F.regexp_replace(c, r"\s+", ""), r"([0-9]{4}/[0-9]+)", 1)
    return F.nullif(F.regexp_replace(n, "/0+", "/"), F.lit(""))


def candidates(df: DataFrame, key: str, text: str, limit: int = 10) -> DataFrame:
    """(key, court, chamber, esas, karar, cited_date, confidence): at most ``limit`` per document, the best first.

    A line counts if it names a court or a number; confidence comes from the fields it has
    (court 3, the others 2 each: high from 7, medium from 4).
    """
    lines = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\n|(?<=\D[.!?])\s+(?=[A-ZÇĞİÖŞÜ])")).alias("pos", "line")).filter(F.length("line") >= 10)
    one = lambda *ps: F.coalesce(*[F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for p in ps])
    date = F.when(F.col("line").rlike(DATE), F.concat_ws("-", F.regexp_extract("line", DATE, 3), F.regexp_extract("line", DATE, 2), F.regexp_extract("line", DATE, 1)))
    c = lines.select(key, "pos", one(COURT).alias("court"), one(CHAMBER).alias("chamber"), one(*ESAS).alias("esas"), one(*KARAR).alias("karar"), date.alias("cited_date"))
    c = c.filter("court is not null or esas is not null or karar is not null")
    fields = ["chamber", "cited_date", "esas", "karar"]
    score = F.when(F.col("court").isNotNull(), 3).otherwise(0)
    for f in fields:
        score = score + F.when(F.col(f).isNotNull(), 2).otherwise(0)
    c = c.groupBy(key, "court", "esas", "karar").agg(F.min(F.struct("pos", *["chamber", "cited_date"])).alias("x")).select(key, "court", "esas", "karar", "x.*")
    c = c.withColumn("score", score).withColumn("confidence", F.when(F.col("score") >= 7, "high").when(F.col("score") >= 4, "medium").otherwise("low"))
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "pos", F.col("esas").asc_nulls_last(), F.col("karar").asc_nulls_last())
    # the limit is the operator's own: the best candidates of a document
    return c.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r", "pos", "score")


def build_edges(cands: DataFrame, records: DataFrame, key: str, year: str | None = None) -> DataFrame:
    """(key, cited, confidence, match_type), the strongest edge of each pair.

    Both numbers and a compatible court are high; the decision number within the same chamber is
    medium, and so is a compatible court with a decision within a year of the cited date, where
    ``records`` have the decision's ``year``. A court's name alone is no evidence.

    The third rule has no number to join on: a candidate with a court and a date meets every record
    of that court and those three years, so its edges grow with the size of these groups.
    """
    ry = F.col(year) if year else F.lit(None).cast("int")
    r = records.select(ry.alias("ry"), F.col(key).alias("cited"), F.lower("court").alias("rc"), F.regexp_replace(F.lower("chamber"), r"\s+", " ").alias("rch"), plain_number(F.col("esas_no")).alias("re"), plain_number(F.col("karar_no")).alias("rk"))
    c = cands.select(key, F.substring("cited_date", 1, 4).cast("int").alias("cy"), F.lower("court").alias("cc"), F.regexp_replace(F.lower("chamber"), r"\s+", " ").alias("cch"), plain_number(F.col("esas")).alias("ce"), plain_number(F.col("karar")).alias("ck"))
    fits = F.col("cc").isNull() | F.col("rc").isNull() | F.col("rc").contains(F.col("cc")) | F.col("cc").contains(F.col("rc"))
    high = c.join(r, (c.ce == r.re) & (c.ck == r.rk)).filter(fits).select(key, "cited", F.lit(1).alias("o"), F.lit("high").alias("confidence"), F.lit("exact_numbers").alias("match_type"))
    med = c.join(r, (c.ck == r.rk) & (c.cch == r.rch)).select(key, "cited", F.lit(2).alias("o"), F.lit("medium").alias("confidence"), F.lit("number_chamber").alias("match_type"))
    courts = r.filter("rc != ''").select("rc").distinct().join(F.broadcast(c.filter("cc is not null").select("cc").distinct()), F.col("rc").contains(F.col("cc")) | F.col("cc").contains(F.col("rc")))
    years = c.filter("cc is not null and cy is not null").select(key, "cc", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)).alias("ry")).distinct()
    near = years.join(courts, "cc").join(r.select("rc", "ry", "cited"), ["rc", "ry"]).select(key, "cited", F.lit(3).alias("o"), F.lit("medium").alias("confidence"), F.lit("court_date").alias("match_type"))
    best = high.unionByName(med).unionByName(near).filter(F.col(key) != F.col("cited")).groupBy(key, "cited").agg(F.min(F.struct("o", "confidence", "match_type")).alias("x"))
    return best.select(key, "cited", "x.confidence", "x.match_type")


def verify(cands: DataFrame, records: DataFrame, key: str, least: float = 0.0) -> DataFrame:
    """(key, esas, karar, cited, score): for each candidate the record that shares a number with it and fits it best.

    Ties go to the smaller id; a record is no citation of itself; candidates that no record shares a number with have no row.
    """
    c = cands.select(F.col(key).alias("citing"), "court", "chamber", "esas", "karar", F.col("cited_date").alias("dt"))
    r = records.select(F.col(key).alias("cited"), F.col("court").alias("r_court"), F.col("chamber").alias("r_chamber"), plain_number(F.col("esas_no")).alias("r_esas"), plain_number(F.col("karar_no")).alias("r_karar"), F.trim("decision_date").alias("r_dt"))
    numbers = lambda df, a, b: df.withColumn("no", F.explode(F.array_distinct(F.array_compact(F.array(plain_number(F.col(a)), plain_number(F.col(b)))))))
    j = numbers(c, "esas", "karar").join(numbers(r, "r_esas", "r_karar"), "no").filter("citing <> cited")
    fields = ("court", "chamber", "esas", "karar", "dt")
    one = {f: plain_number(F.col(f)) if f in ("esas", "karar") else F.col(f) for f in fields}
    s = j.select("citing", "esas", "karar", "cited", citation_match(one, {f: F.col(f"r_{f}") for f in fields}).alias("score")).filter(F.col("score") >= least)
    best = s.groupBy("citing", "esas", "karar").agg(F.min(F.struct((-F.col("score")).alias("s"), "cited")).alias("b"))
    return best.select(F.col("citing").alias(key), "esas", "karar", "b.cited", F.round(-F.col("b.s"), 4).alias("score"))
