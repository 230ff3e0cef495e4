"""Queries over the structure of documents, citations and streams. Most are checked by tests, not SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from derlem.functions.keys import effective_text
from derlem.functions.text import plain_markdown
from derlem.operators import citations, documents, maintenance
from derlem.operators.timestamps import normalise_timestamps
from derlem.session import cut, shared_folder, table
from derlem.sources.store import Store
from derlem.streaming import jobs

QUERIES, SQL = {}, {}
#: Files of the staged stream.
BATCHES = 4


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _records(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.keep_latest(table(spark, d, "documents_v2"), ["document_id", "source"], "retrieved_at", "row_id").withColumn("t", effective_text())


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return documents.parts(_records(spark, d), ["document_id", "source"], "t", documents.chunk, "chunk string")


@query()
def article_split(spark: SparkSession, d: str) -> DataFrame:
    return documents.parts(table(spark, d, "mevzuat_madde"), ["mevzuat_id", "sira"], "metin", documents.articles, "number string, ord int, body string")


@query(
    "SELECT row_id, 0 AS position, 'madde' scope, CASE regexp_extract(ham, '^[(]([^: ]+)', 1) WHEN 'Değişik' THEN 'degisik' WHEN 'Ek' THEN 'ek' WHEN 'Mülga' THEN 'mulga' WHEN 'İptal' THEN 'iptal' END kind, NULL::VARCHAR AS date, regexp_extract(ham, ': ?([0-9]+)/', 1) by_no, regexp_extract(ham, '/([0-9]+) md', 1) by_article, NULL::VARCHAR gazette_date, NULL::VARCHAR gazette_no, NULL::VARCHAR court_case, NULL::VARCHAR court_decision, NULL::INT footnote, trim(ham) raw FROM mevzuat_degisiklik WHERE regexp_matches(ham, '^[(](Değişik|Ek|Mülga|İptal): ?[0-9]+/[0-9]+ md[.][)]$')"
)
def amendment_notes(spark: SparkSession, d: str) -> DataFrame:
    return documents.parts(table(spark, d, "mevzuat_degisiklik"), ["row_id"], "ham", documents.amendments, documents.AMENDMENT)


@query()
def text_pages(spark: SparkSession, d: str) -> DataFrame:
    return documents.parts(_records(spark, d), ["document_id", "source"], "t", documents.pages, "page string")


_MD = "markdown"
for _p, _r in ((r"(?m)^```.*$", ""), (r"(?m)^[ \t]{0,3}(?:#{1,6}|>|[-*+]|[0-9]+\.)[ \t]+", ""), (r"!?\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\*\*([^\n]+?)\*\*", r"\1"), (r"__([^\n]+?)__", r"\1"), (r"\*([^\n]+?)\*", r"\1"), (r"`([^\n]+?)`", r"\1")):
    _MD = f"regexp_replace({_MD}, '{_p}', '{_r}', 'g')"


@query(f"SELECT row_id, {_MD} plain FROM documents_v2 WHERE markdown IS NOT NULL")
def markdown_plain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents_v2").filter("markdown is not null").select("row_id", plain_markdown("markdown").alias("plain"))


@query()
def citation_candidates(spark: SparkSession, d: str) -> DataFrame:
    return citations.candidates(_records(spark, d), "document_id", "t")


@query()
def citation_graph_build(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    # the year in Istanbul that decision_date names, in any writing
    year = F.year(F.from_utc_timestamp(F.timestamp_micros("utc_micros"), "Europe/Istanbul"))
    dated = normalise_timestamps(r.select("document_id", "source", "court", "chamber", "esas_no", "karar_no", "decision_date"), "decision_date", "source").select("document_id", "court", "chamber", "esas_no", "karar_no", year.alias("year"))
    # both are narrow and used by every rule
    return citations.build_edges(cut(citations.candidates(r, "document_id", "t")), cut(dated), "document_id", "year")


@query("SELECT event_type, date_trunc('day', ts)::VARCHAR AS dy, count(*) n FROM events GROUP BY 1, 2")
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts kept by a stream that takes the events a stretch of time at a batch, forgets windows two days behind, and updates what a batch changes."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    e = table(spark, d, "events")
    # as they would arrive: one file after the other, in the order of time
    span = e.agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    share = (F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.col("a").cast("timestamp"))) * BATCHES / (F.unix_timestamp(F.col("z").cast("timestamp")) - F.unix_timestamp(F.col("a").cast("timestamp")) + 1)
    staged = cut(e.join(F.broadcast(span)).withColumn("_i", F.floor(share)).drop("a", "z"))
    for i in range(BATCHES):
        staged.filter(F.coalesce(F.col("_i"), F.lit(0)) == i).drop("_i").coalesce(1).write.mode("append").parquet(f"{base}/in")
    counts = jobs.windowed_counts(jobs.stream_table(spark, f"{base}/in", e), "ts", "event_type", late="2 days")
    jobs.run_available(counts, f"{base}/checkpoint", each=jobs.keep_latest_rows(f"{base}/out"), mode="update")
    got = cut(jobs.latest_rows(spark, f"{base}/out", ["start", "event_type"]).select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("dy"), "n"))
    Store(spark, base).delete()
    return got
