"""The citation graph: edges both ways, lists, statistics, guards, export, verification of citations; with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from derlem.functions.keys import effective_text, fold_key
from derlem.operators import citations, graph
from derlem.queries_corpus import EDGES, _dv2, _edges, _records
from derlem.session import cut, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TITLES = "t AS (SELECT lower(trim(document_id)) id, min(title) title FROM documents_v2 WHERE document_id IS NOT NULL GROUP BY 1)"
_CENTRE = "s AS (SELECT b node FROM e GROUP BY b ORDER BY count(*) DESC, b LIMIT 1 OFFSET 20)"


def _centre(e: DataFrame) -> DataFrame:
    """The twenty-first most cited decision, one row."""
    return e.groupBy("b").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "b").offset(20).limit(1).select(F.col("b").alias("node"))


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return _dv2(spark, d).filter("document_id is not null").groupBy(fold_key("document_id").alias("id")).agg(F.min("title").alias("title"))


@query(f"WITH {EDGES}, {_CENTRE}, {_TITLES}, n AS (SELECT 'cites' direction, e.b id FROM e JOIN s ON e.a = s.node UNION ALL SELECT 'cited_by', e.a FROM e JOIN s ON e.b = s.node) SELECT direction, n.id, title FROM n LEFT JOIN t ON t.id = n.id")
def graph_both_directions(spark: SparkSession, d: str) -> DataFrame:
    """What one decision cites and what cites it, with titles where there are any."""
    e = _edges(spark, d)
    return graph.neighbourhood(e, _centre(e)).withColumnRenamed("node", "id").join(_titles(spark, d), "id", "left").select("direction", "id", "title")


@query("SELECT a, b, confidence, place FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, a) place FROM (SELECT lower(trim(citing_doc_id)) a, lower(trim(cited_doc_id)) b, CASE min(CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END) WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' END confidence FROM citation_edges WHERE citing_doc_id IS NOT NULL AND cited_doc_id IS NOT NULL GROUP BY 1, 2)) WHERE place <= 5")
def citing_lists(spark: SparkSession, d: str) -> DataFrame:
    """The five surest citations of every decision; confidence has its own order, not that of its letters."""
    e = table(spark, d, "citation_edges").filter("citing_doc_id is not null and cited_doc_id is not null").groupBy(fold_key("citing_doc_id").alias("a"), fold_key("cited_doc_id").alias("b")).agg(F.min(graph.certainty("confidence")).alias("_c"))
    return graph.first_per(e, "b", ["_c", "a"], 5).select("a", "b", graph.certainty_name("_c").alias("confidence"), F.col("place").cast("long").alias("place"))


@query(f"WITH {EDGES}, {_CENTRE}, out AS (SELECT b FROM e JOIN s ON e.a = s.node), inn AS (SELECT a FROM e JOIN s ON e.b = s.node) SELECT DISTINCT id FROM (SELECT b id FROM out UNION SELECT a FROM inn UNION SELECT x.b FROM e x JOIN inn ON x.a = inn.a WHERE x.b <> (SELECT node FROM s)) LIMIT 1000000")
def cross_references(spark: SparkSession, d: str) -> DataFrame:
    """Decisions to read with one: those it cites, those that cite it, and what these cite beside it."""
    e = _edges(spark, d)
    return graph.cross_references(e, _centre(e))


@query(f"WITH {EDGES}, c AS (SELECT count(*) n_edges, count(DISTINCT a) n_citing FROM e), r AS (SELECT count(DISTINCT lower(trim(document_id))) n_docs FROM documents_v2 WHERE document_id IS NOT NULL), k AS (SELECT count(DISTINCT e.a) n_covered FROM e WHERE a IN (SELECT lower(trim(document_id)) FROM documents_v2 WHERE document_id IS NOT NULL)) SELECT n_edges, n_citing, round(n_edges / n_citing, 6) per_citing, round(n_covered / n_docs, 6) coverage, CASE WHEN n_edges = 0 THEN 'never_built' WHEN n_covered / n_docs < 0.01 THEN 'sparse' ELSE 'ok' END state FROM c, r, k")
def graph_guard(spark: SparkSession, d: str) -> DataFrame:
    """Whether the graph says enough for 'no citation found' to mean anything."""
    docs = _dv2(spark, d).filter("document_id is not null").select(fold_key("document_id").alias("a")).distinct()
    return graph.guard(_edges(spark, d), docs)


@query(f"WITH {EDGES}, {_TITLES} SELECT b id, count(*) n_citing, any_value(title) title FROM e LEFT JOIN t ON t.id = e.b GROUP BY 1 ORDER BY n_citing DESC, id LIMIT 10")
def most_cited(spark: SparkSession, d: str) -> DataFrame:
    top = _edges(spark, d).groupBy(F.col("b").alias("id")).agg(F.count("*").alias("n_citing")).orderBy(F.col("n_citing").desc(), "id").limit(10)
    return top.join(_titles(spark, d), "id", "left").select("id", "n_citing", "title")


@query(f"WITH {EDGES} SELECT '  \"' || a || '\" -> \"' || b || '\";' line FROM e")
def graph_dot(spark: SparkSession, d: str) -> DataFrame:
    """The graph's edges as lines of a drawing; what stands around them is added where they are written."""
    return graph.dot_lines(_edges(spark, d))


@query(f"WITH {EDGES}, i AS (SELECT node, row_number() OVER (ORDER BY node) - 1 k FROM (SELECT b node FROM e WHERE b IN (SELECT b FROM e GROUP BY 1 HAVING count(*) >= 40) UNION SELECT a FROM e WHERE b IN (SELECT b FROM e GROUP BY 1 HAVING count(*) >= 40)))"
       " SELECT '    N' || x.k || ' --> N' || y.k line FROM e JOIN i x ON x.node = e.a JOIN i y ON y.node = e.b WHERE e.b IN (SELECT b FROM e GROUP BY 1 HAVING count(*) >= 40)")  # fmt: skip
def graph_mermaid(spark: SparkSession, d: str) -> DataFrame:
    """The edges to decisions with forty citations and more, nodes by short names."""
    e = _edges(spark, d)
    much = e.groupBy("b").agg(F.count("*").alias("n")).filter("n >= 40").select("b")
    return graph.mermaid_lines(e.join(much, "b", "left_semi").select("a", "b"))


_NO = "regexp_extract(replace(coalesce({c}, ''), ' ', ''), '([0-9]{{4}}/[0-9]+)', 1)"
_EDGE_NO = _NO.format(c="extracted_from")
#: A case number without the zeros in front of its sequence.
_PLAIN = "regexp_replace({x}, '/0+', '/')"


@query(
    f"WITH c AS (SELECT row_id cid, {_PLAIN.format(x=_EDGE_NO)} no, lower(trim(citing_doc_id)) citing FROM citation_edges WHERE {_EDGE_NO} <> ''), r AS (SELECT DISTINCT lower(trim(document_id)) id, x no FROM (SELECT document_id, unnest([{_PLAIN.format(x=_NO.format(c='esas_no'))}, {_PLAIN.format(x=_NO.format(c='karar_no'))}]) x FROM documents_v2 WHERE document_id IS NOT NULL) WHERE x <> '') "
    "SELECT cid, id, r FROM (SELECT c.cid, r.id, row_number() OVER (PARTITION BY c.cid ORDER BY r.id) r FROM c JOIN r USING (no) WHERE r.id IS DISTINCT FROM c.citing) WHERE r <= 20"
)
def citation_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The records a citation's number could mean, whatever blanks and zeros the numbers are written with; twenty at most each."""
    no = lambda c: citations.plain_number(F.col(c))
    c = table(spark, d, "citation_edges").select(F.col("row_id").alias("cid"), no("extracted_from").alias("no"), fold_key("citing_doc_id").alias("citing")).filter("no is not null")
    r = _dv2(spark, d).filter("document_id is not null").select(fold_key("document_id").alias("id"), F.explode(F.array_compact(F.array(no("esas_no"), no("karar_no")))).alias("no")).distinct()
    j = c.join(r, "no").filter(~F.col("id").eqNullSafe(F.col("citing"))).select("cid", "id")
    return graph.first_per(j, "cid", ["id"], 20).select("cid", "id", F.col("place").cast("long").alias("r"))


@query()
def citation_verification(spark: SparkSession, d: str) -> DataFrame:
    """The candidates found in the texts held against the records that share a number with them: the best record of each, with its score."""
    r = _records(spark, d).withColumn("t", effective_text())
    return citations.verify(cut(citations.candidates(r, "document_id", "t")), r, "document_id")


@query("WITH x AS (SELECT chamber, regexp_extract(replace(coalesce(esas_no, ''), ' ', ''), '([0-9]{4})/', 1) y, source FROM documents_v2) SELECT source, y, count(*) n, count(DISTINCT chamber) n_chambers FROM x WHERE y <> '' GROUP BY 1, 2")
def cases_by_year(spark: SparkSession, d: str) -> DataFrame:
    """Cases per source and year of their number."""
    y = F.regexp_extract(F.regexp_replace(F.coalesce("esas_no", F.lit("")), " ", ""), r"([0-9]{4})/", 1)
    return _dv2(spark, d).select("source", y.alias("y"), "chamber").filter("y <> ''").groupBy("source", "y").agg(F.count("*").alias("n"), F.count_distinct("chamber").alias("n_chambers"))
