"""Queries of the general data problems (1 to 3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from derlem.functions.dates_sql import moments
from derlem.functions.keys import fold_key, is_blank, pair_key, strip
from derlem.operators.orphans import find_orphans, orphan_report
from derlem.operators.snapshots import latest_hashes, snapshot_changes
from derlem.operators.timestamps import normalise_timestamps
from derlem.session import table

DATE_FIELDS = {"documents_v2": "decision_date", "mevzuat_dokuman": "rg_tarihi", "mevzuat_degisiklik": "tarih", "rg_ogeler": "tarih"}


def _dates(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.lit(t).alias("src_table"), "row_id", F.col(f).alias("raw")) for t, f in DATE_FIELDS.items()]
    return normalise_timestamps(reduce(DataFrame.unionByName, parts), "raw", "src_table")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _dates(spark, d).filter("utc is not null").select("src_table", "row_id", F.col("utc").alias("utc_ts"))


def p1_formats(spark: SparkSession, d: str) -> DataFrame:
    """Use of each format per table, with what stayed ambiguous or unread."""
    return _dates(spark, d).groupBy("src_table", F.coalesce("reading", F.lit("none")).alias("format")).agg(
        F.count("*").alias("n_rows"), F.count_if(F.coalesce("ambiguous", F.lit(False))).alias("n_ambiguous"), F.min("utc").alias("first_utc"), F.max("utc").alias("last_utc")
    )


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(
        table(spark, d, "mevzuat_dokuman"), key="mevzuat_id", snapshot="snapshot_no", attributes=["ad", "tur", "mevzuat_no", "rg_sayisi"],
        content="metin", content_hash="metin_hash", time="cekim_zamani", tie="row_id",
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).select("snapshot_no", "mevzuat_id", "change_kind")


def p2_archive(spark: SparkSession, d: str) -> DataFrame:
    """Changes and removals per snapshot, and how many of them have the text they replace in mevzuat_dokuman_gecmis.

    A change counts whose earlier delivery had a text; it is archived if the archive holds that very text (surrounding blanks
    apart) under the law's id, whatever the archive's own hash says.
    """
    ch = _changes(spark, d).filter("change_kind <> 'added'").select("snapshot_no", fold_key("mevzuat_id").alias("k"), "change_kind")
    docs = table(spark, d, "mevzuat_dokuman")
    rows = latest_hashes(docs, key="mevzuat_id", snapshot="snapshot_no", attributes=["ad"], content="metin", content_hash="metin_hash", time="cekim_zamani", tie="row_id")
    # one number per delivery
    steps = docs.filter("snapshot_no is not null").select("snapshot_no").distinct().withColumn("next", F.lead("snapshot_no").over(Window.orderBy("snapshot_no"))).filter("next is not null")
    before = rows.join(F.broadcast(steps), F.col("snap") == F.col("snapshot_no")).select(F.col("next").alias("snapshot_no"), "k", F.col("r.trimmed").alias("h"))
    kept = table(spark, d, "mevzuat_dokuman_gecmis").filter(~is_blank("mevzuat_id") & ~is_blank("metin")).select(fold_key("mevzuat_id").alias("k"), F.sha2(F.encode(strip("metin"), "utf-8"), 256).alias("h")).distinct().withColumn("kept", F.lit(1))
    j = ch.join(before, ["snapshot_no", "k"], "left").join(kept, ["k", "h"], "left")
    return j.groupBy("snapshot_no", "change_kind").agg(F.count("*").alias("n_changes"), F.count("h").alias("n_with_text"), F.count("kept").alias("n_archived"))


def p2_log_check(spark: SparkSession, d: str) -> DataFrame:
    """Derived changes and additions per snapshot beside the crawler's own counts (repeated log rows once)."""
    got = _changes(spark, d).groupBy("snapshot_no").agg(F.count_if(F.col("change_kind") == "changed").alias("n_changed"), F.count_if(F.col("change_kind") == "added").alias("n_added"))
    log = table(spark, d, "mevzuat_guncelleme_log").dropDuplicates(["snapshot_no", "parti_no", "tur", "listelenen", "degisen", "yeni"])
    log = log.groupBy("snapshot_no").agg(F.sum("degisen").alias("log_changed"), F.sum("yeni").alias("log_added"))
    return got.join(log, "snapshot_no", "full_outer")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    cit, mem = table(spark, d, "citation_edges"), table(spark, d, "dedup_members")
    # documents and groups share one key space, told apart by a prefix, so that one filter and one join serve all fields
    doc = lambda i, s: F.concat(F.lit("d"), pair_key(i, s))
    group = lambda i: F.concat(F.lit("g"), fold_key(i))
    month = F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit(""))
    ref = lambda df, t, f, k: df.filter(F.col(f).isNotNull()).select(F.lit(t).alias("src_table"), F.lit(f).alias("ref_field"), "row_id", k.alias("key"), "created_at", month.alias("period_ym"))
    refs = (
        ref(cit, "citation_edges", "citing_doc_id", doc("citing_doc_id", "citing_source"))
        .unionByName(ref(cit, "citation_edges", "cited_doc_id", doc("cited_doc_id", "cited_source")))
        .unionByName(ref(mem, "dedup_members", "cluster_id", group("cluster_id")))
    )
    docs, groups, gone = table(spark, d, "documents_v2"), table(spark, d, "dedup_clusters"), table(spark, d, "silinen_kayit")
    parents = docs.filter("document_id is not null").select(doc("document_id", "source").alias("key"), "created_at").unionByName(groups.filter("cluster_id is not null").select(group("cluster_id").alias("key"), "created_at"))
    deleted = gone.filter(fold_key("tablo").isin("documents_v2", "dedup_clusters") & F.col("kayit_id").isNotNull()).select(
        F.when(fold_key("tablo") == "documents_v2", doc("kayit_id", "kaynak")).otherwise(group("kayit_id")).alias("key")
    )
    return find_orphans(refs, parents, deleted)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "ref_field", "row_id", "orphan_kind", "period_ym")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}|{_WS}$', '', 'g')"


def _key_sql(c: str) -> str:
    return f"lower({strip_sql(c)})"


_SAME = "CASE WHEN a.tr IS NOT NULL AND b.tr IS NOT NULL THEN a.tr = b.tr WHEN a.tr IS NOT NULL THEN coalesce(b.st IN (a.tr, a.ex), false) WHEN b.tr IS NOT NULL THEN coalesce(a.st IN (b.tr, b.ex), false) ELSE a.st IS NOT DISTINCT FROM b.st END"
_P2 = (
    f"WITH s AS (SELECT snapshot_no n, {_key_sql('mevzuat_id')} k, {strip_sql('mevzuat_id')} id, [" + ", ".join(f"coalesce({strip_sql(c)}, '')" for c in ("ad", "tur", "mevzuat_no", "rg_sayisi")) + "] attrs, "
    f"CASE WHEN {strip_sql('metin')} <> '' THEN sha256({strip_sql('metin')}) END tr, CASE WHEN {strip_sql('metin')} <> '' THEN sha256(metin) END ex, CASE WHEN coalesce({strip_sql('metin')}, '') = '' THEN nullif({_key_sql('metin_hash')}, '') END st "
    f"FROM mevzuat_dokuman WHERE {strip_sql('mevzuat_id')} <> '' QUALIFY row_number() OVER (PARTITION BY snapshot_no, {_key_sql('mevzuat_id')} ORDER BY cekim_zamani DESC NULLS LAST, row_id DESC) = 1), "
    "a AS (SELECT *, n + 1 m FROM s WHERE n < (SELECT max(n) FROM s)), b AS (SELECT *, n m FROM s WHERE n > (SELECT min(n) FROM s)), "
    f"j AS (SELECT coalesce(a.m, b.m) m, coalesce(b.id, a.id) id, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.attrs <> b.attrs OR NOT ({_SAME}) THEN 'changed' END kind FROM a FULL JOIN b ON a.m = b.m AND a.k = b.k) "
)
_DOC = lambda i, s: f"concat('d', coalesce({_key_sql(i)}, ''), '|', coalesce({_key_sql(s)}, ''))"
_P3 = (
    "WITH r AS ("
    + " UNION ALL ".join(
        f"SELECT '{t}' src_table, '{f}' ref_field, row_id, {k} k, created_at c FROM {t} WHERE {f} IS NOT NULL"
        for t, f, k in (("citation_edges", "citing_doc_id", _DOC("citing_doc_id", "citing_source")), ("citation_edges", "cited_doc_id", _DOC("cited_doc_id", "cited_source")), ("dedup_members", "cluster_id", f"concat('g', {_key_sql('cluster_id')})"))
    )
    + f"), p AS (SELECT k, min(c) c FROM (SELECT {_DOC('document_id', 'source')} k, created_at c FROM documents_v2 WHERE document_id IS NOT NULL UNION ALL SELECT concat('g', {_key_sql('cluster_id')}), created_at FROM dedup_clusters WHERE cluster_id IS NOT NULL) GROUP BY 1), "
    f"x AS (SELECT DISTINCT CASE {_key_sql('tablo')} WHEN 'documents_v2' THEN {_DOC('kayit_id', 'kaynak')} WHEN 'dedup_clusters' THEN concat('g', {_key_sql('kayit_id')}) END k FROM silinen_kayit WHERE kayit_id IS NOT NULL), "
    "o AS (SELECT src_table, ref_field, row_id, r.k, CASE WHEN p.k IS NULL AND x.k IS NOT NULL THEN 'deleted' WHEN p.k IS NULL THEN 'missing' WHEN p.c > r.c THEN 'late' END orphan_kind, coalesce(strftime(r.c, '%Y-%m'), '') period_ym FROM r LEFT JOIN p ON p.k = r.k LEFT JOIN x ON x.k = r.k) "
)
_DATES = " UNION ALL ".join(f"SELECT '{t}' src_table, row_id, {f} raw FROM {t}" for t, f in DATE_FIELDS.items())
_ARCHIVE = (
    f", g AS (SELECT DISTINCT {_key_sql('mevzuat_id')} k, sha256({strip_sql('metin')}) h FROM mevzuat_dokuman_gecmis WHERE {strip_sql('metin')} <> ''), c AS (SELECT m, coalesce(b.k, a.k) k, a.tr h, CASE WHEN b.k IS NULL THEN 'removed' WHEN a.attrs <> b.attrs OR NOT ({_SAME}) THEN 'changed' END kind FROM a LEFT JOIN b USING (m, k)) "
)
SQL = {
    "p1_found": f"WITH raw AS ({_DATES}), {moments('t', 'raw', 'raw', 'src_table, row_id')} SELECT src_table, row_id, strftime(utc, '%Y-%m-%dT%H:%M:%S.%fZ') utc_ts FROM t WHERE utc IS NOT NULL",
    # day first, no numeric date has two readings
    "p1_formats": f"WITH raw AS ({_DATES}), {moments('t', 'raw', 'raw', 'src_table, row_id')}, x AS (SELECT src_table, CASE WHEN utc IS NULL THEN 'none' ELSE fmt END AS format, strftime(utc, '%Y-%m-%dT%H:%M:%S.%fZ') u FROM t) SELECT src_table, format, count(*) n_rows, 0::BIGINT n_ambiguous, min(u) first_utc, max(u) last_utc FROM x GROUP BY 1, 2",
    "p2_archive": _P2.rstrip() + _ARCHIVE + "SELECT m snapshot_no, kind change_kind, count(*) n_changes, count(c.h) n_with_text, count(g.h) n_archived FROM c LEFT JOIN g ON g.k = c.k AND g.h = c.h WHERE kind IS NOT NULL GROUP BY 1, 2",
    "p2_log_check": _P2 + ", got AS (SELECT m n, count(*) FILTER (kind = 'changed') n_changed, count(*) FILTER (kind = 'added') n_added FROM j WHERE kind IS NOT NULL GROUP BY 1), log AS (SELECT snapshot_no n, sum(degisen) log_changed, sum(yeni) log_added FROM (SELECT DISTINCT snapshot_no, parti_no, tur, listelenen, degisen, yeni FROM mevzuat_guncelleme_log) GROUP BY 1) SELECT coalesce(got.n, log.n) snapshot_no, n_changed, n_added, log_changed, log_added FROM got FULL JOIN log ON got.n = log.n",
    "p2_found": _P2 + "SELECT m snapshot_no, id mevzuat_id, kind change_kind FROM j WHERE kind IS NOT NULL",
    "p3_found": _P3 + "SELECT src_table, ref_field, row_id, orphan_kind, period_ym FROM o WHERE orphan_kind IS NOT NULL",
    "p3_report": _P3 + "SELECT src_table, ref_field, orphan_kind, period_ym, count(*) n_refs, count(DISTINCT k) n_keys FROM o WHERE orphan_kind IS NOT NULL GROUP BY 1, 2, 3, 4",
}
QUERIES = {f.__name__: f for f in (p1_found, p1_formats, p2_found, p2_archive, p2_log_check, p3_found, p3_report)}
