"""Upkeep of tables: inserts, deletions, merges, changes of texts, pending work, gates; with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from derlem.functions.keys import fold_key, is_blank, pair_key, strip
from derlem.functions.text import ascii_fold
from derlem.operators import maintenance, versions
from derlem.queries_corpus import CLEAN, FOLDED, NAME, QUERIES as CORPUS, REC, SQL as CORPUS_SQL, _LAWS, _SHORT, _dv2, _laws, _records
from derlem.queries_search import QUERIES as SEARCH, SQL as SEARCH_SQL, TOK
from derlem.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("WITH old AS (SELECT DISTINCT mevzuat_id FROM mevzuat_dokuman WHERE snapshot_no < 4), new AS (SELECT DISTINCT mevzuat_id FROM mevzuat_dokuman WHERE snapshot_no = 4) SELECT mevzuat_id FROM old UNION ALL SELECT mevzuat_id FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.mevzuat_id = n.mevzuat_id)")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """The ids of the earlier deliveries with those of the last one they lack."""
    docs = table(spark, d, "mevzuat_dokuman")
    ids = lambda p: docs.filter(p).select("mevzuat_id").distinct()
    return maintenance.insert_absent(ids("snapshot_no < 4"), ids("snapshot_no = 4"), ["mevzuat_id"])


_GONE = f"gone AS (SELECT DISTINCT {FOLDED('kayit_id')} k FROM silinen_kayit WHERE {FOLDED('tablo')} = 'dedup_clusters' AND kayit_id IS NOT NULL)"


@query(f"WITH {_GONE} SELECT 'dedup_clusters' tbl, count(*) n_before, count(*) FILTER ({FOLDED('cluster_id')} NOT IN (SELECT k FROM gone) OR cluster_id IS NULL) n_after FROM dedup_clusters UNION ALL SELECT 'dedup_members', count(*), count(*) FILTER ({FOLDED('cluster_id')} NOT IN (SELECT k FROM gone) OR cluster_id IS NULL) FROM dedup_members")
def cascading_delete(spark: SparkSession, d: str) -> DataFrame:
    """What the log of deletions takes from the groups and from their members."""
    gone = table(spark, d, "silinen_kayit").filter((fold_key("tablo") == "dedup_clusters") & F.col("kayit_id").isNotNull()).select(fold_key("kayit_id").alias("k"))
    tables = {t: table(spark, d, t).select(fold_key("cluster_id").alias("k")) for t in ("dedup_clusters", "dedup_members")}
    left = maintenance.delete_keys(list(tables.values()), gone, ["k"])
    n = [before.agg(F.lit(t).alias("tbl"), F.count("*").alias("n_before")).join(after.agg(F.count("*").alias("n_after"))) for (t, before), after in zip(tables.items(), left)]
    return n[0].unionByName(n[1])


@query("WITH m AS (SELECT DISTINCT cluster_id, document_id, source FROM dedup_members WHERE cluster_id IS NOT NULL) SELECT source, count(*) n_members, count(DISTINCT cluster_id) n_clusters FROM m GROUP BY 1 ORDER BY n_members DESC, source NULLS FIRST LIMIT 10")
def dedup_sources(spark: SparkSession, d: str) -> DataFrame:
    """The ten sources with most members of groups."""
    m = table(spark, d, "dedup_members").filter("cluster_id is not null").select("cluster_id", "document_id", "source").distinct()
    return m.groupBy("source").agg(F.count("*").alias("n_members"), F.count_distinct("cluster_id").alias("n_clusters")).orderBy(F.col("n_members").desc(), F.col("source").asc_nulls_first()).limit(10)


@query("WITH l AS (SELECT source, concat_ws(' | ', court, chamber, esas_no, karar_no, decision_date) label FROM documents_v2) SELECT source, count(*) n_labels, sum(k)::BIGINT n_records, count(*) FILTER (k > 1) n_repeated FROM (SELECT source, label, count(*) k FROM l GROUP BY 1, 2) GROUP BY 1")
def repeated_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels that several records of a source share."""
    label = F.concat_ws(" | ", "court", "chamber", "esas_no", "karar_no", "decision_date")
    g = _dv2(spark, d).groupBy("source", label.alias("label")).agg(F.count("*").alias("k"))
    return g.groupBy("source").agg(F.count("*").alias("n_labels"), F.sum("k").alias("n_records"), F.count_if(F.col("k") > 1).alias("n_repeated"))


_LAWTEXT = f"r AS (SELECT snapshot_no n, {FOLDED('mevzuat_id')} k, {CLEAN('mevzuat_id')} mevzuat_id, metin FROM mevzuat_dokuman WHERE {CLEAN('mevzuat_id')} <> '' AND snapshot_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY snapshot_no, {FOLDED('mevzuat_id')} ORDER BY cekim_zamani DESC NULLS LAST, row_id DESC) = 1)"


@query(
    f"WITH {_LAWTEXT}, s AS (SELECT *, list_distinct(string_split(regexp_replace(metin, '\\. ', chr(10), 'g'), chr(10))) ls FROM r WHERE metin IS NOT NULL), j AS (SELECT b.n snapshot_no, b.mevzuat_id, a.ls x, b.ls y FROM s a JOIN s b ON a.k = b.k AND b.n = a.n + 1 WHERE a.metin <> b.metin) "
    "SELECT snapshot_no, mevzuat_id, len(list_filter(y, lambda v: NOT list_contains(x, v))) n_added, len(list_filter(x, lambda v: NOT list_contains(y, v))) n_removed FROM j"
)
def law_text_changes(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that a law's text gained and lost from one delivery to the next."""
    docs = table(spark, d, "mevzuat_dokuman").filter(~is_blank("mevzuat_id") & F.col("snapshot_no").isNotNull())
    row = F.struct(strip("mevzuat_id").alias("mevzuat_id"), "metin")
    r = docs.groupBy("snapshot_no", fold_key("mevzuat_id").alias("k")).agg(F.max_by(row, F.struct("cekim_zamani", "row_id")).alias("r")).select("snapshot_no", "k", "r.*").filter("metin is not null")
    s = r.withColumn("ls", F.array_distinct(F.split(F.regexp_replace("metin", r"\. ", "\n"), "\n")))
    old = s.select((F.col("snapshot_no") + 1).alias("snapshot_no"), "k", F.col("metin").alias("was"), F.col("ls").alias("x"))
    j = s.join(old, ["snapshot_no", "k"]).filter("metin <> was")
    return j.select("snapshot_no", "mevzuat_id", F.size(F.array_except("ls", "x")).cast("long").alias("n_added"), F.size(F.array_except("x", "ls")).cast("long").alias("n_removed"))


@query("WITH d AS (" + CORPUS_SQL["change_decision"] + ") SELECT snapshot_no, CASE WHEN decision = 'same' THEN 'skip' WHEN decision = 'gone' THEN 'archive' WHEN decision = 'metadata' THEN 'update fields' ELSE 'replace articles' END AS action, count(*) n FROM d GROUP BY 1, 2")
def upsert_plan(spark: SparkSession, d: str) -> DataFrame:
    """What taking over each delivery means for the laws: nothing, fields, or the articles with all that hangs on them."""
    x = F.col("decision")
    action = F.when(x == "same", "skip").when(x == "gone", "archive").when(x == "metadata", "update fields").otherwise("replace articles")
    return CORPUS["change_decision"](spark, d).groupBy("snapshot_no", action.alias("action")).agg(F.count("*").alias("n"))


@query("WITH p AS (" + CORPUS_SQL["pending_days"] + ") SELECT substr(dy, 1, 7) AS mon, count(*) n_pending FROM p GROUP BY 1")
def backfill_plan(spark: SparkSession, d: str) -> DataFrame:
    """Pending days by month: the parts in which a back-fill runs, side by side."""
    return CORPUS["pending_days"](spark, d).groupBy(F.substring("dy", 1, 7).alias("mon")).agg(F.count("*").alias("n_pending"))


@query("WITH s AS (" + SEARCH_SQL["index_status"] + "), g AS (" + SEARCH_SQL["evaluation_gate"] + ") SELECT coverage >= 0.99 covered, passes found_again, coverage >= 0.99 AND passes AS may_switch FROM s, g")
def switch_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether the index may take another's place: it holds 99 of 100 documents, and golden queries find what they should."""
    j = SEARCH["index_status"](spark, d).join(SEARCH["evaluation_gate"](spark, d))
    return j.select((F.col("coverage") >= 0.99).alias("covered"), F.col("passes").alias("found_again"), ((F.col("coverage") >= 0.99) & F.col("passes")).alias("may_switch"))


@query(f"WITH l AS (SELECT {CLEAN('mevzuat_id')} mevzuat_id, tur, ad, trim(mevzuat_no) no, {NAME('ad')} nm FROM mevzuat_dokuman WHERE snapshot_no = 4 AND mevzuat_id IS NOT NULL), t AS (SELECT no, count(DISTINCT tur) k FROM l WHERE no IS NOT NULL GROUP BY 1) SELECT DISTINCT mevzuat_id, tur, l.no, t.k > 1 ambiguous FROM l LEFT JOIN t ON t.no = l.no WHERE contains(nm, 'DENETIMI') AND contains(nm, 'YAPI')")
def legislation_search(spark: SparkSession, d: str) -> DataFrame:
    """Laws with every word in their folded name, and whether their number means several kinds of legislation."""
    laws = table(spark, d, "mevzuat_dokuman").filter("snapshot_no = 4 and mevzuat_id is not null").select(strip("mevzuat_id").alias("mevzuat_id"), "tur", F.trim("mevzuat_no").alias("no"), ascii_fold("ad").alias("nm"))
    kinds = laws.filter("no is not null").groupBy("no").agg((F.count_distinct("tur") > 1).alias("ambiguous"))
    hit = laws.filter(F.col("nm").contains("DENETIMI") & F.col("nm").contains("YAPI"))
    return hit.join(kinds, "no", "left").select("mevzuat_id", "tur", "no", "ambiguous").distinct()


@query(f"WITH {_LAWS}, u AS (SELECT DISTINCT tur, regexp_replace(nm, '^[^ ]+ | [0-9]+$', '', 'g') nm, dy FROM laws WHERE dy IS NOT NULL), l AS (SELECT *, dy - lag(dy) OVER (PARTITION BY tur, nm ORDER BY dy) gap FROM u) SELECT tur, nm, count(*) n, round(median(gap), 3) median_gap, max(dy)::VARCHAR newest FROM l GROUP BY 1, 2")
def series_of_names(spark: SparkSession, d: str) -> DataFrame:
    """The rule of series for every name apart from its number: what counts as versions of one another, with the gaps that decide."""
    laws = _laws(spark, d).withColumn("nm", F.regexp_replace("nm", _SHORT, ""))
    return versions.gaps(laws, ["tur", "nm"], "d")


@query(f"SELECT count(*) n_records, count(*) FILTER (content_hash IS NOT NULL AND full_text IS NOT NULL AND sha256(full_text) <> content_hash) n_stale, count(*) FILTER (document_id IS NULL OR source IS NULL) n_keyless, count(*) - count(DISTINCT ({FOLDED('document_id')}, {FOLDED('source')})) n_repeats FROM documents_v2 WHERE document_id IS NOT NULL AND source IS NOT NULL")
def integrity(spark: SparkSession, d: str) -> DataFrame:
    """Counts of what is wrong with the records: stale hashes, missing keys, repeated deliveries."""
    r = _dv2(spark, d).filter("document_id is not null and source is not null")
    stale = F.coalesce(F.sha2(F.encode("full_text", "utf-8"), 256) != F.col("content_hash"), F.lit(False))
    return r.agg(F.count("*").alias("n_records"), F.count_if(stale).alias("n_stale"), F.count_if(F.col("document_id").isNull() | F.col("source").isNull()).alias("n_keyless"), (F.count("*") - F.count_distinct(pair_key("document_id", "source"))).alias("n_repeats"))


@query(f"WITH {REC} SELECT r.document_id, r.source, CASE WHEN e.document_id IS NULL THEN 'missing' WHEN bool_or(e.content_hash IS NOT DISTINCT FROM r.content_hash) THEN 'fresh' ELSE 'stale' END state FROM rec r LEFT JOIN embedding_vectors e ON e.document_id = r.document_id AND e.source = r.source GROUP BY r.document_id, r.source, e.document_id IS NULL, e.document_id")
def dense_plan(spark: SparkSession, d: str) -> DataFrame:
    """Which records need vectors: those without any, and those whose vectors are of another text."""
    r = _records(spark, d).select("document_id", "source", F.col("content_hash").alias("h"))
    e = table(spark, d, "embedding_vectors").select("document_id", "source", F.col("content_hash").alias("eh"), F.lit(1).alias("has"))
    g = r.join(e, ["document_id", "source"], "left").groupBy("document_id", "source").agg(F.max("has").alias("has"), F.max(F.when(F.col("has").isNotNull(), F.col("h").eqNullSafe(F.col("eh")))).alias("fresh"))
    return g.select("document_id", "source", F.when(F.col("has").isNull(), "missing").when(F.col("fresh"), "fresh").otherwise("stale").alias("state"))


@query(f"WITH w AS (SELECT source, doc_id, len({TOK}) n FROM documents) SELECT source, count(*) n_docs, sum(n)::BIGINT n_words, round(avg(n), 4) mean_words, max(n)::BIGINT longest FROM w GROUP BY 1")
def words_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Documents and words of each source, from the lengths the index keeps: no text is read."""
    from derlem.queries_search import index

    n = index(spark, d).documents().select(F.col("key").alias("doc_id"), F.col("dl").alias("n"))
    j = table(spark, d, "documents").select("doc_id", "source").join(n, "doc_id")
    return j.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").cast("long").alias("n_words"), F.round(F.avg("n"), 4).alias("mean_words"), F.max("n").cast("long").alias("longest"))
