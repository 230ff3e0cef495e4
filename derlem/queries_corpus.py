"""Profiling, duplicates, graph, versions, maintenance and quality queries, with the SQL that checks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from derlem.functions.dates_sql import day, moments
from derlem.functions.keys import effective_text, fold_key, is_blank, strip
from derlem.functions.text import ascii_fold, number_key, year_of
from derlem.operators import graph, maintenance, quality, versions
from derlem.operators.timestamps import normalise_timestamps
from derlem.session import table

QUERIES, SQL = {}, {}
AS_OF = "2025-06-30"
#: Kinds of legislation that are published again and again under one name.
SERIES_KINDS = ["TEBLIGLER", "TEBLIG", "YONETMELIK"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _dv2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents_v2")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """One row per record: the latest delivery holds."""
    return maintenance.keep_latest(_dv2(spark, d), ["document_id", "source"], "retrieved_at", "row_id")


REC = "rec AS (SELECT * FROM documents_v2 QUALIFY row_number() OVER (PARTITION BY document_id, source ORDER BY retrieved_at DESC NULLS LAST, row_id DESC) = 1)"
WS = r"'^[\s\x{a0}\x{feff}]+|[\s\x{a0}\x{feff}]+$'"
EFF = f"(CASE WHEN length(regexp_replace(coalesce(full_text,''), {WS}, '', 'g')) > 0 THEN full_text ELSE markdown END)"
STRIPPED = f"regexp_replace(coalesce({EFF},''), {WS}, '', 'g')"
_BLANK = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
CLEAN = lambda c: f"regexp_replace({c}, '^{_BLANK}|{_BLANK}$', '', 'g')"
FOLDED = lambda c: f"lower({CLEAN(c)})"
NAME = lambda c: f"trim(regexp_replace(upper(translate({c}, 'çğıöşüÇĞİÖŞÜâîûÂÎÛ', 'cgiosuCGIOSUaiuAIU')), '[^A-Z0-9]+', ' ', 'g'))"
_YEAR = r"(CASE WHEN regexp_matches(trim(decision_date), '^\d{4}-\d{2}-\d{2}') THEN substr(trim(decision_date),1,4) WHEN regexp_matches(trim(decision_date), '^\d{2}\.\d{2}\.\d{4}\z') THEN substr(trim(decision_date),7,4) WHEN regexp_matches(trim(decision_date), '^\d{4}\z') THEN trim(decision_date) END)::INT"
YEAR = f"(CASE WHEN {_YEAR} BETWEEN 1900 AND 2100 THEN {_YEAR} END)"


# -- scans and sinks ---------------------------------------------------------------------


@query(f"WITH {REC} SELECT document_id, source, row_id, retrieved_at FROM rec")
def upsert_keep_latest(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("document_id", "source", "row_id", "retrieved_at")


@query("SELECT row_id, document_id, sha256(full_text) = content_hash ok FROM documents_v2 WHERE full_text IS NOT NULL AND content_hash IS NOT NULL")
def hash_verified_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every row with its stored hash verified against the text."""
    ok = F.sha2(F.encode("full_text", "utf-8"), 256) == F.col("content_hash")
    return _dv2(spark, d).filter("full_text is not null and content_hash is not null").select("row_id", "document_id", ok.alias("ok"))


@query("SELECT DISTINCT cited_doc_id document_id, cited_source source FROM citation_edges WHERE cited_doc_id IS NOT NULL AND EXISTS (SELECT 1 FROM documents_v2 v WHERE v.document_id = cited_doc_id AND v.source = cited_source)")
def existence_semi(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "citation_edges").select(F.col("cited_doc_id").alias("document_id"), F.col("cited_source").alias("source")).distinct()
    return refs.join(_dv2(spark, d), ["document_id", "source"], "left_semi")


_HOLDERS = {"embedding_vectors": ("document_id", "source"), "dedup_members": ("document_id", "source"), "citation_edges": ("citing_doc_id", "citing_source")}


@query("WITH r AS (" + " UNION ALL ".join(f"SELECT '{t}' tbl, {a} document_id, {b} source FROM {t}" for t, (a, b) in _HOLDERS.items()) + ") SELECT tbl, document_id, source, count(*) n FROM r WHERE NOT EXISTS (SELECT 1 FROM documents_v2 v WHERE v.document_id = r.document_id AND v.source = r.source) GROUP BY 1, 2, 3")
def orphan_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the derived tables whose record, spelled exactly so, is not there: what a clean-up would remove."""
    parts = [table(spark, d, t).select(F.lit(t).alias("tbl"), F.col(a).alias("document_id"), F.col(b).alias("source")) for t, (a, b) in _HOLDERS.items()]
    refs = reduce(DataFrame.unionByName, parts).groupBy("tbl", "document_id", "source").agg(F.count("*").alias("n"))
    return refs.join(_dv2(spark, d).select("document_id", "source").distinct(), ["document_id", "source"], "left_anti").select("tbl", "document_id", "source", "n")


@query(f"WITH {REC} SELECT document_id, source FROM rec WHERE length({STRIPPED}) >= 50 AND length({STRIPPED}) <= 2000000 AND NOT EXISTS (SELECT 1 FROM embedding_vectors e WHERE e.document_id = rec.document_id AND e.source = rec.source)")
def anti_missing_vectors(spark: SparkSession, d: str) -> DataFrame:
    n = F.length(strip(effective_text()))
    return _records(spark, d).filter(n.between(50, 2_000_000)).join(table(spark, d, "embedding_vectors"), ["document_id", "source"], "left_anti").select("document_id", "source")


@query(
    "WITH x AS (SELECT document_id, source, retrieved_at, content_hash, row_id, row_number() OVER (PARTITION BY document_id, source ORDER BY row_id) r FROM documents_v2), a AS (SELECT * FROM x WHERE r = 1), b AS (SELECT * FROM x WHERE r > 1 QUALIFY row_number() OVER (PARTITION BY document_id, source ORDER BY retrieved_at DESC NULLS LAST, row_id DESC) = 1) "
    "SELECT coalesce(a.document_id, b.document_id) document_id, coalesce(a.source, b.source) source, CASE WHEN a.row_id IS NULL THEN 'insert' WHEN b.row_id IS NULL THEN 'only_here' WHEN b.retrieved_at > a.retrieved_at OR (a.retrieved_at IS NULL AND b.retrieved_at IS NOT NULL) THEN 'newer_there' ELSE 'keep' END action, coalesce(a.content_hash <> b.content_hash, false) conflict FROM a FULL JOIN b ON a.document_id = b.document_id AND a.source = b.source"
)
def sync_newest_wins(spark: SparkSession, d: str) -> DataFrame:
    """Two stores that share records, the first delivery of each and all later ones: what a synchronisation does with each key, and whether their hashes differ."""
    keys = ["document_id", "source"]
    x = _dv2(spark, d).select(*keys, "retrieved_at", "content_hash", "row_id", F.row_number().over(Window.partitionBy(*keys).orderBy("row_id")).alias("r"))
    a = x.filter("r = 1").select(*keys, "retrieved_at", "content_hash")
    b = maintenance.keep_latest(x.filter("r > 1"), keys, "retrieved_at", "row_id").select(*keys, "retrieved_at", "content_hash")
    return maintenance.sync_actions(a, b, keys, "retrieved_at", "content_hash")


#: Beginnings of ids that are made up for tests.
SYNTHETIC = ("yg-", "ds-", "test-", "fake-", "sample-")
#: A source's beginning that stands in for them, as these tables hold no made-up rows.
_STAND_IN = "kv-"


@query("SELECT row_id, document_id, source, length(coalesce(full_text, '')) text_length FROM documents_v2 WHERE (" + " OR ".join(f"document_id ILIKE '{p}%'" for p in (*SYNTHETIC, _STAND_IN)) + ") AND coalesce(source_url, '') = ''")
def synthetic_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows with an id of a made-up kind and no address they could have come from."""
    made_up = reduce(lambda a, b: a | b, [F.col("document_id").ilike(f"{p}%") for p in (*SYNTHETIC, _STAND_IN)])
    return _dv2(spark, d).filter(made_up & (F.coalesce("source_url", F.lit("")) == "")).select("row_id", "document_id", "source", F.length(F.coalesce("full_text", F.lit(""))).cast("long").alias("text_length"))


# -- profiling ---------------------------------------------------------------------------


@query("SELECT source, count(*) n, count(full_text) n_text, round(avg(length(full_text)), 3) avg_len FROM documents_v2 GROUP BY 1")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    return _dv2(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count("full_text").alias("n_text"), F.round(F.avg(F.length("full_text")), 3).alias("avg_len"))


@query(f"SELECT court, chamber, count(*) n, count(*) FILTER (content_status IN ('full_text','html_markdown')) n_available, min({YEAR}) first_year, max({YEAR}) last_year, count(*) FILTER ({YEAR} >= 2024) n_recent FROM documents_v2 GROUP BY 1, 2")
def overview_court_chamber(spark: SparkSession, d: str) -> DataFrame:
    y = year_of("decision_date")
    return _dv2(spark, d).groupBy("court", "chamber").agg(
        F.count("*").alias("n"), F.count_if(F.col("content_status").isin("full_text", "html_markdown")).alias("n_available"),
        F.min(y).alias("first_year"), F.max(y).alias("last_year"), F.count_if(y >= 2024).alias("n_recent"),
    )


@query("SELECT chamber, content_status, count(*) n, sum(quote_usable) n_quote, sum(draft_usable) n_draft, round(count(*) / sum(count(*)) OVER (PARTITION BY chamber), 6) share FROM documents_v2 WHERE chamber IS NOT NULL GROUP BY 1, 2")
def chamber_profile(spark: SparkSession, d: str) -> DataFrame:
    g = _dv2(spark, d).filter("chamber is not null").groupBy("chamber", "content_status").agg(F.count("*").alias("n"), F.sum("quote_usable").alias("n_quote"), F.sum("draft_usable").alias("n_draft"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("chamber")), 6))


@query("SELECT chamber, document_id, row_id, r FROM (SELECT chamber, document_id, row_id, row_number() OVER (PARTITION BY chamber ORDER BY retrieved_at DESC NULLS LAST, row_id) r FROM documents_v2 WHERE chamber IS NOT NULL) WHERE r <= 5")
def recent_five_per_chamber(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("chamber").orderBy(F.col("retrieved_at").desc_nulls_last(), "row_id")
    return _dv2(spark, d).filter("chamber is not null").select("chamber", "document_id", "row_id", F.row_number().over(w).cast("long").alias("r")).filter("r <= 5")


@query(f"WITH y AS (SELECT {YEAR} y, count(*) n FROM documents_v2 GROUP BY 1), g AS (SELECT unnest(range(min(y), max(y) + 1)) AS yr FROM y WHERE y IS NOT NULL) SELECT g.yr::INT yr, coalesce(n, 0) n, (SELECT n FROM y WHERE y IS NULL) n_unparsed FROM g LEFT JOIN y ON y.y = g.yr")
def timeline_by_year(spark: SparkSession, d: str) -> DataFrame:
    """Years without decisions count 0; strings in other writings are counted as unparsed."""
    n = _dv2(spark, d).groupBy(year_of("decision_date").alias("yr")).agg(F.count("*").alias("n"))
    span = n.agg(F.explode(F.sequence(F.min("yr"), F.max("yr"))).alias("yr"))
    none = n.filter("yr is null").select(F.col("n").alias("n_unparsed"))
    return span.join(n, "yr", "left").select("yr", F.coalesce("n", F.lit(0)).alias("n")).join(F.broadcast(none), how="left")


@query("SELECT tur, snapshot_no, count(DISTINCT mevzuat_id) n_docs, sum(madde_sayisi) n_articles FROM mevzuat_dokuman GROUP BY 1, 2")
def legislation_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mevzuat_dokuman").groupBy("tur", "snapshot_no").agg(F.count_distinct("mevzuat_id").alias("n_docs"), F.sum("madde_sayisi").alias("n_articles"))


@query("SELECT tur, grouping_id(tur, kapsam) g, kapsam, count(*) n FROM mevzuat_degisiklik GROUP BY ROLLUP (tur, kapsam)")
def amendment_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mevzuat_degisiklik").rollup("tur", "kapsam").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))


@query("SELECT 'ust_baslik' col, count(*) n, round(avg(CASE WHEN coalesce(ust_baslik,'') <> '' THEN 1.0 ELSE 0.0 END), 6) fill FROM mevzuat_madde UNION ALL SELECT 'degisiklik_notu', count(*), round(avg(CASE WHEN coalesce(degisiklik_notu,'') <> '' THEN 1.0 ELSE 0.0 END), 6) FROM mevzuat_madde")
def fill_rates(spark: SparkSession, d: str) -> DataFrame:
    return quality.fill_rates(table(spark, d, "mevzuat_madde"), ["ust_baslik", "degisiklik_notu"])


@query("SELECT bolum, count(*) n, min(substr(cekilme_zamani,1,10)) first_fetch, max(substr(cekilme_zamani,1,10)) last_fetch, count(*) FILTER (mukerrer > 0) n_repeat FROM rg_ogeler GROUP BY 1")
def gazette_status(spark: SparkSession, d: str) -> DataFrame:
    day = F.substring("cekilme_zamani", 1, 10)
    return table(spark, d, "rg_ogeler").groupBy("bolum").agg(F.count("*").alias("n"), F.min(day).alias("first_fetch"), F.max(day).alias("last_fetch"), F.count_if(F.col("mukerrer") > 0).alias("n_repeat"))


# -- duplicates --------------------------------------------------------------------------

_KEYED = "k AS (SELECT *, coalesce(court,'') c, nullif(regexp_replace(lower(esas_no), '\\s+', '', 'g'), '') e, nullif(regexp_replace(lower(karar_no), '\\s+', '', 'g'), '') n FROM rec)"


def _case_groups(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).withColumns({"c": F.coalesce("court", F.lit("")), "e": number_key("esas_no"), "n": number_key("karar_no")}).filter("e is not null and n is not null")


@query(f"WITH {REC}, {_KEYED} SELECT sha256(c || '|' || e || '|' || n) cluster, count(*) size, min(row_id) first_row FROM k WHERE e IS NOT NULL AND n IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
def exact_dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    g = _case_groups(spark, d).groupBy(F.sha2(F.concat_ws("|", "c", "e", "n"), 256).alias("cluster"))
    return g.agg(F.count("*").alias("size"), F.min("row_id").alias("first_row")).filter("size >= 2")


_RANK = "CASE content_status WHEN 'full_text' THEN 0 WHEN 'html_markdown' THEN 1 WHEN 'pdf_link_only' THEN 2 WHEN 'metadata_only' THEN 3 WHEN 'unavailable' THEN 4 ELSE 5 END"


@query(f"WITH {REC}, {_KEYED}, r AS (SELECT c || '|' || e || '|' || n g, document_id, row_id, row_number() OVER (PARTITION BY c, e, n ORDER BY {_RANK}, length(coalesce(full_text,'')) DESC, retrieved_at NULLS LAST, row_id) rn, count(*) OVER (PARTITION BY c, e, n) size FROM k WHERE e IS NOT NULL AND n IS NOT NULL) SELECT g, document_id, row_id FROM r WHERE rn = 1 AND size >= 2")
def canonical_member(spark: SparkSession, d: str) -> DataFrame:
    order = [quality.status_rank("content_status"), F.length(F.coalesce("full_text", F.lit(""))).desc(), F.col("retrieved_at").asc_nulls_last(), F.col("row_id").asc()]
    w = Window.partitionBy("c", "e", "n")
    r = _case_groups(spark, d).select(F.concat_ws("|", "c", "e", "n").alias("g"), "document_id", "row_id", F.row_number().over(w.orderBy(*order)).alias("rn"), F.count("*").over(w).alias("size"))
    return r.filter("rn = 1 and size >= 2").select("g", "document_id", "row_id")


@query("SELECT (SELECT count(DISTINCT cluster_id) FROM dedup_members) n_clusters, count(*) n_members, (SELECT round((count(*) - count(DISTINCT cluster_id)) * (SELECT avg(length(full_text)) FROM documents_v2), 2) FROM (SELECT DISTINCT cluster_id, document_id FROM dedup_members WHERE cluster_id IS NOT NULL)) saved FROM dedup_members")
def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "dedup_members")
    pairs = m.filter("cluster_id is not null").select("cluster_id", "document_id").distinct().agg((F.count("*") - F.count_distinct("cluster_id")).alias("spare"))
    mean = _dv2(spark, d).agg(F.avg(F.length("full_text")).alias("mean"))
    return m.agg(F.count_distinct("cluster_id").alias("n_clusters"), F.count("*").alias("n_members")).join(pairs).join(mean).select("n_clusters", "n_members", F.round(F.col("spare") * F.col("mean"), 2).alias("saved"))


# -- graph -------------------------------------------------------------------------------

EDGES = "e AS (SELECT DISTINCT lower(trim(citing_doc_id)) a, lower(trim(cited_doc_id)) b FROM citation_edges WHERE citing_doc_id IS NOT NULL AND cited_doc_id IS NOT NULL)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "citation_edges").filter("citing_doc_id is not null and cited_doc_id is not null")
    return c.select(fold_key("citing_doc_id").alias("a"), fold_key("cited_doc_id").alias("b")).distinct()


@query(f"WITH {EDGES}, o AS (SELECT a node, count(*) n_out FROM e GROUP BY 1), i AS (SELECT b node, count(*) n_in FROM e GROUP BY 1) SELECT coalesce(o.node, i.node) node, coalesce(n_out, 0) n_out, coalesce(n_in, 0) n_in FROM o FULL JOIN i ON o.node = i.node")
def graph_degree_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_edges(spark, d))


@query(f"WITH {EDGES}, s AS (SELECT b FROM e GROUP BY b ORDER BY count(*) DESC, b LIMIT 1 OFFSET 20), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), d1 AS (SELECT DISTINCT u.b node FROM u JOIN s ON u.a = s.b WHERE u.b <> s.b), d2 AS (SELECT DISTINCT u.b node FROM u JOIN d1 ON u.a = d1.node WHERE u.b NOT IN (SELECT node FROM d1) AND u.b NOT IN (SELECT b FROM s)) SELECT b node, 0 depth FROM s UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2")
def graph_bfs_depth2(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within two undirected steps of the twenty-first most cited decision."""
    e = _edges(spark, d)
    start = e.groupBy("b").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "b").offset(20).limit(1).select(F.col("b").alias("node"))
    return graph.bfs(e, start, 2)


@query(f"WITH {EDGES} SELECT node FROM (SELECT a node FROM e UNION SELECT b FROM e)")
def union_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return graph.endpoints(_edges(spark, d))


@query("SELECT confidence, match_type, count(*) n, count(DISTINCT (citing_doc_id, citing_source)) n_citing, CASE confidence WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END rank FROM citation_edges GROUP BY 1, 2")
def citation_confidence(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("confidence") == "high", 1).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "low", 3).otherwise(4)
    return table(spark, d, "citation_edges").groupBy("confidence", "match_type").agg(F.count("*").alias("n"), F.count_distinct(F.struct("citing_doc_id", "citing_source")).alias("n_citing")).withColumn("rank", rank)


@query("SELECT e.row_id, e.cited_doc_id, d.title FROM citation_edges e LEFT JOIN (SELECT document_id, source, min(title) title FROM documents_v2 GROUP BY 1, 2) d ON d.document_id = e.cited_doc_id AND d.source = e.cited_source WHERE e.confidence = 'high'")
def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "citation_edges").filter("confidence = 'high'").select("row_id", F.col("cited_doc_id").alias("document_id"), F.col("cited_source").alias("source"))
    titles = _dv2(spark, d).groupBy("document_id", "source").agg(F.min("title").alias("title"))
    return e.join(titles, ["document_id", "source"], "left").select("row_id", F.col("document_id").alias("cited_doc_id"), "title")


# -- versions and maintenance ------------------------------------------------------------


def _laws(spark: SparkSession, d: str) -> DataFrame:
    """The deliveries of the laws with ``nm``, the folded name, and ``d``, the day in Istanbul that rg_tarihi names in any writing."""
    read = normalise_timestamps(table(spark, d, "mevzuat_dokuman").drop("metin"), "rg_tarihi", "kaynak")
    day = F.from_utc_timestamp(F.timestamp_micros("utc_micros"), "Europe/Istanbul").cast("date")
    return read.withColumns({"nm": ascii_fold("ad"), "d": day})


_LAWS = f"{moments('t', 'mevzuat_dokuman', 'rg_tarihi', 'row_id, tur, ad')}, laws AS (SELECT row_id, tur, {NAME('ad')} nm, {day('utc')} dy FROM t)"


@query(f"WITH {_LAWS}, u AS (SELECT DISTINCT tur, nm, dy FROM laws WHERE dy IS NOT NULL), l AS (SELECT *, dy - lag(dy) OVER (PARTITION BY tur, nm ORDER BY dy) gap FROM u) SELECT tur, nm, count(*) n, round(median(gap), 3) median_gap, max(dy)::VARCHAR newest FROM l GROUP BY 1, 2")
def median_gap(spark: SparkSession, d: str) -> DataFrame:
    """Per series (kind and folded name) of all rows: its distinct days of publication, and the days between them."""
    return versions.gaps(_laws(spark, d), ["tur", "nm"], "d")


#: A name without the place it begins with and the number it ends with: in these tables every law has a number of its own.
_SHORT = r"^\S+ | \d+\z"


def _current_sql(name: str = "nm") -> str:
    return (
        f"WITH {_LAWS}, docs AS (SELECT l.tur, nullif({name}, '') nm, {CLEAN('mevzuat_id')} mevzuat_id, snapshot_no, row_id, dy FROM mevzuat_dokuman m JOIN laws l USING (row_id) WHERE {CLEAN('mevzuat_id')} <> '' QUALIFY row_number() OVER (PARTITION BY {FOLDED('mevzuat_id')} ORDER BY snapshot_no DESC, cekim_zamani DESC NULLS LAST, row_id DESC) = 1), "
        "gap AS (SELECT tur, nm, dy - lag(dy) OVER (PARTITION BY tur, nm ORDER BY dy) g FROM docs WHERE dy IS NOT NULL), "
        f"series AS (SELECT a.tur, a.nm FROM (SELECT tur, nm, count(*) k, count(dy) kd FROM docs GROUP BY 1, 2) a JOIN (SELECT tur, nm, median(g) m FROM gap GROUP BY 1, 2) b USING (tur, nm) WHERE k = kd AND round(m, 3) >= 150 AND a.tur IN {tuple(SERIES_KINDS)}), "
        "ranked AS (SELECT d.*, s.tur IS NOT NULL in_series, row_number() OVER (PARTITION BY d.tur, d.nm ORDER BY dy DESC NULLS LAST, mevzuat_id DESC) r FROM docs d LEFT JOIN series s ON s.tur = d.tur AND s.nm = d.nm) "
    )


@query(_current_sql() + "SELECT tur, nm, mevzuat_id, snapshot_no, row_id FROM ranked WHERE NOT in_series OR r = 1")
def version_series_current(spark: SparkSession, d: str) -> DataFrame:
    """The current document of each series, and every document that is in none; of a document the last delivery holds."""
    return versions.current(_last_deliveries(spark, d), ["tur", "nm"], "mevzuat_id", "d", SERIES_KINDS).drop("d")


def _last_deliveries(spark: SparkSession, d: str, cut_off: str = "") -> DataFrame:
    w = Window.partitionBy(fold_key("mevzuat_id")).orderBy(F.col("snapshot_no").desc(), F.col("cekim_zamani").desc_nulls_last(), F.col("row_id").desc())
    docs = _laws(spark, d).filter(~is_blank("mevzuat_id")).withColumn("r", F.row_number().over(w)).filter("r = 1")
    return docs.select("tur", F.nullif(F.regexp_replace("nm", cut_off, "") if cut_off else F.col("nm"), F.lit("")).alias("nm"), strip("mevzuat_id").alias("mevzuat_id"), "snapshot_no", "row_id", "d")


@query(_current_sql("regexp_replace(nm, '^[^ ]+ | [0-9]+$', '', 'g')") + ", cur AS (SELECT tur, nm, mevzuat_id current_id FROM ranked WHERE in_series AND r = 1), a AS (SELECT DISTINCT lower(trim(mevzuat_id)) k, mevzuat_id, sira, madde_no FROM mevzuat_madde), old AS (SELECT a.mevzuat_id, a.sira, a.madde_no, c.current_id, lower(regexp_replace(a.madde_no, '\\s+', '', 'g')) no FROM a JOIN ranked r ON lower(trim(r.mevzuat_id)) = a.k JOIN cur c ON c.tur = r.tur AND c.nm = r.nm WHERE c.current_id <> r.mevzuat_id), now AS (SELECT lower(trim(mevzuat_id)) k, lower(regexp_replace(madde_no, '\\s+', '', 'g')) no, min(sira) current_sira FROM mevzuat_madde GROUP BY 1, 2) SELECT old.mevzuat_id, old.sira, old.madde_no, old.current_id, current_sira FROM old LEFT JOIN now ON now.k = lower(old.current_id) AND now.no = old.no")
def version_folding(spark: SparkSession, d: str) -> DataFrame:
    """Articles of older members of a series with the current member's article of the same number; null where that has none.

    Names count without their first word and number here (``_SHORT``).
    """
    key = lambda c: F.lower(F.trim(F.col(c)))
    number = F.lower(F.regexp_replace("madde_no", r"\s+", ""))
    arts = table(spark, d, "mevzuat_madde").select("mevzuat_id", "sira", "madde_no").distinct()
    docs = _last_deliveries(spark, d, _SHORT)
    folded = versions.older(docs, ["tur", "nm"], "mevzuat_id", "d", SERIES_KINDS).select(key("mevzuat_id").alias("k"), "current_id")
    old = arts.withColumn("k", key("mevzuat_id")).join(folded, "k").select("mevzuat_id", "sira", "madde_no", "current_id", number.alias("no"))
    now = arts.groupBy(key("mevzuat_id").alias("k"), number.alias("no")).agg(F.min("sira").alias("current_sira"))
    return old.withColumn("k", F.lower("current_id")).join(now, ["k", "no"], "left").select("mevzuat_id", "sira", "madde_no", "current_id", "current_sira")


@query(
    f"WITH r AS (SELECT snapshot_no n, {FOLDED('mevzuat_id')} k, {CLEAN('mevzuat_id')} id, {FOLDED('metin_hash')} h, guncelleme_tarihi g FROM mevzuat_dokuman WHERE {CLEAN('mevzuat_id')} <> '' AND snapshot_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY snapshot_no, {FOLDED('mevzuat_id')} ORDER BY cekim_zamani DESC NULLS LAST, row_id DESC) = 1), "
    "st AS (SELECT n, lead(n) OVER (ORDER BY n) m FROM (SELECT DISTINCT n FROM r)), a AS (SELECT m, k, h, g FROM r JOIN st USING (n) WHERE m IS NOT NULL), b AS (SELECT n m, k, h, g FROM r WHERE n > (SELECT min(n) FROM r)), ids AS (SELECT k, arg_max(id, n) id FROM r GROUP BY 1) "
    "SELECT coalesce(a.m, b.m) snapshot_no, ids.id mevzuat_id, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'gone' WHEN a.h IS DISTINCT FROM b.h THEN 'changed' WHEN a.g IS DISTINCT FROM b.g THEN 'metadata' ELSE 'same' END decision FROM a FULL JOIN b ON a.m = b.m AND a.k = b.k JOIN ids ON ids.k = coalesce(a.k, b.k)"
)
def change_decision(spark: SparkSession, d: str) -> DataFrame:
    """Every snapshot against the one before it, by the latest delivery of each record."""
    docs = table(spark, d, "mevzuat_dokuman").filter(~is_blank("mevzuat_id") & F.col("snapshot_no").isNotNull())
    order = F.struct(F.coalesce(F.unix_micros(F.col("cekim_zamani").cast("timestamp")), F.lit(-(2**62))), F.col("row_id"))
    row = F.struct(strip("mevzuat_id").alias("id"), fold_key("metin_hash").alias("h"), F.col("guncelleme_tarihi").alias("g"))
    rows = docs.groupBy("snapshot_no", fold_key("mevzuat_id").alias("k")).agg(F.max_by(row, order).alias("r")).select("snapshot_no", "k", "r.*")
    # one row per snapshot
    steps = docs.select("snapshot_no").distinct().withColumn("next", F.lead("snapshot_no").over(Window.orderBy("snapshot_no"))).filter("next is not null")
    old = rows.join(F.broadcast(steps), "snapshot_no").drop("snapshot_no").withColumnRenamed("next", "snapshot_no")
    new = rows.join(F.broadcast(steps.select(F.col("next").alias("snapshot_no"))), "snapshot_no")
    ids = rows.groupBy("k").agg(F.max_by("id", "snapshot_no").alias("mevzuat_id"))
    return maintenance.change_decision(old, new, ["snapshot_no", "k"], "h", "g").join(ids, "k").select("snapshot_no", "mevzuat_id", "decision")


@query("SELECT DISTINCT n.mevzuat_id FROM mevzuat_dokuman n WHERE n.snapshot_no = 4 AND n.mevzuat_id NOT IN (SELECT mevzuat_id FROM mevzuat_dokuman WHERE snapshot_no < 4 AND mevzuat_id IS NOT NULL)")
def new_since_last_seen(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "mevzuat_dokuman")
    return docs.filter("snapshot_no = 4").select("mevzuat_id").distinct().join(docs.filter("snapshot_no < 4").select("mevzuat_id"), "mevzuat_id", "left_anti")


_DAYS = "done AS (SELECT DISTINCT try_strptime(substr(sayfa, 1, 8), '%Y%m%d')::DATE d FROM rg_ogeler WHERE try_strptime(substr(sayfa, 1, 8), '%Y%m%d') IS NOT NULL), cal AS (SELECT unnest(range(DATE '2023-01-01', DATE '2025-01-01', INTERVAL 1 DAY))::DATE d)"


@query(f"WITH {_DAYS} SELECT d::VARCHAR AS dy FROM cal WHERE d NOT IN (SELECT d FROM done) OR d >= DATE '2024-12-25'")
def pending_days(spark: SparkSession, d: str) -> DataFrame:
    """Days of two years without a fetched page, and the last week again."""
    page = table(spark, d, "rg_ogeler").filter(F.col("sayfa").rlike("^20[0-2][0-9](0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])"))
    # days that do not exist, as 20230230, are null and match none
    return maintenance.pending_days(page.select(F.expr("try_to_date(substring(sayfa, 1, 8), 'yyyyMMdd')").alias("d")), "2023-01-01", "2024-12-31", refresh=7).select(F.col("d").cast("string").alias("dy"))


_ISSUES = "i AS (SELECT sayfa, max(try_cast(sayi_no AS BIGINT)) no, count(*) n_items FROM rg_ogeler WHERE regexp_matches(sayfa, '^[0-9]{8}$') GROUP BY 1)"


@query(f"WITH {_ISSUES} SELECT sayfa, no, CASE WHEN no < p THEN 'below_previous' ELSE 'above_next' END kind FROM (SELECT sayfa, no, lag(no) OVER (ORDER BY sayfa) p, lead(no) OVER (ORDER BY sayfa) q FROM i WHERE no IS NOT NULL) WHERE no < p OR no > q")
def monotonicity_audit(spark: SparkSession, d: str) -> DataFrame:
    """Days whose issue number lies below that of the day before or above that of the day after."""
    return quality.out_of_order(_issues(spark, d).filter("no is not null"), "sayfa", "no")


def _issues(spark: SparkSession, d: str) -> DataFrame:
    """One row per day with a page of its own: at most a calendar's days."""
    no = F.expr("try_cast(sayi_no as bigint)")
    return table(spark, d, "rg_ogeler").filter(F.col("sayfa").rlike(r"^[0-9]{8}\z")).groupBy("sayfa").agg(F.max(no).alias("no"), F.count("*").alias("n_items"))


@query(
    f"WITH {_ISSUES}, m AS (SELECT sayfa, no, lag(no) OVER (ORDER BY sayfa) p, lead(no) OVER (ORDER BY sayfa) q FROM i WHERE no IS NOT NULL) SELECT 'no_issue_number' finding, count(*) n FROM i WHERE no IS NULL UNION ALL SELECT 'out_of_order', count(*) FROM m WHERE no < p OR no > q UNION ALL SELECT 'short_title', count(*) FROM rg_ogeler WHERE length(baslik) < 60 UNION ALL SELECT 'empty_day', count(*) FROM (SELECT DISTINCT sayfa FROM rg_ogeler WHERE regexp_matches(sayfa, '^[0-9]{{8}}$') GROUP BY sayfa HAVING count(baslik) = 0)"
)
def gazette_audit(spark: SparkSession, d: str) -> DataFrame:
    """Counts of what looks wrong in the gazette's index: days without a number, out of order or without any title, and short titles (below 60 letters here)."""
    i, items = _issues(spark, d), table(spark, d, "rg_ogeler")
    empty = items.filter(F.col("sayfa").rlike(r"^[0-9]{8}\z")).groupBy("sayfa").agg(F.count("baslik").alias("k")).filter("k = 0")
    found = {"no_issue_number": i.filter("no is null"), "out_of_order": quality.out_of_order(i.filter("no is not null"), "sayfa", "no"), "short_title": items.filter(F.length("baslik") < 60), "empty_day": empty}
    return reduce(DataFrame.unionByName, [df.agg(F.lit(k).alias("finding"), F.count("*").alias("n")) for k, df in found.items()])


@query("SELECT kosu_zamani, sum(listelenen) listed, sum(degisen) changed, sum(yeni) added, sum(hata) errors, round(sum(sure_s), 2) total_s FROM (SELECT DISTINCT * FROM mevzuat_guncelleme_log) GROUP BY 1 ORDER BY 1 DESC LIMIT 3")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "mevzuat_guncelleme_log").distinct().groupBy("kosu_zamani").agg(F.sum("listelenen").alias("listed"), F.sum("degisen").alias("changed"), F.sum("yeni").alias("added"), F.sum("hata").alias("errors"), F.round(F.sum("sure_s"), 2).alias("total_s"))
    return g.orderBy(F.col("kosu_zamani").desc()).limit(3)


# -- quality, safety, labels -------------------------------------------------------------


@query(f"SELECT row_id, length({STRIPPED}) n, (content_status IN ('full_text','html_markdown') AND length({STRIPPED}) > 0) IS TRUE usable, CASE WHEN content_status IN ('full_text','html_markdown') AND length({STRIPPED}) < 50 THEN 'metadata_only' ELSE content_status END status FROM documents_v2")
def usability(spark: SparkSession, d: str) -> DataFrame:
    """Derived, never taken from the stored flags."""
    return quality.usability(_dv2(spark, d)).select("row_id", "n", "usable", "status")


@query("SELECT row_id, array_to_string(list_filter([CASE WHEN content_status NOT IN ('full_text','html_markdown') OR content_status IS NULL THEN 'status' END, CASE WHEN coalesce(full_text,'') = '' AND coalesce(markdown,'') = '' THEN 'text' END, CASE WHEN coalesce(source_url,'') = '' AND coalesce(esas_no,'') = '' AND coalesce(karar_no,'') = '' THEN 'provenance' END], lambda x: x IS NOT NULL), ',') reasons FROM documents_v2")
def citation_safety(spark: SparkSession, d: str) -> DataFrame:
    return quality.citation_reasons(_dv2(spark, d)).select("row_id", "reasons")


@query("SELECT row_id, concat_ws(' | ', court, chamber, esas_no, karar_no, decision_date) label FROM documents_v2")
def citation_label(spark: SparkSession, d: str) -> DataFrame:
    return _dv2(spark, d).select("row_id", F.concat_ws(" | ", "court", "chamber", "esas_no", "karar_no", "decision_date").alias("label"))


@query(r"SELECT row_id, try_cast(regexp_extract(karar_no, '^\s*(\d{4})/(\d+)\s*$', 1) AS INT) yr, try_cast(regexp_extract(karar_no, '^\s*(\d{4})/(\d+)\s*$', 2) AS BIGINT) seq FROM documents_v2 WHERE regexp_matches(karar_no, '^\s*\d{4}/\d+\s*$')")
def parse_case_numbers(spark: SparkSession, d: str) -> DataFrame:
    p = r"^\s*(\d{4})/(\d+)\s*$"
    return _dv2(spark, d).filter(F.col("karar_no").rlike(p)).select("row_id", F.regexp_extract("karar_no", p, 1).cast("int").alias("yr"), F.regexp_extract("karar_no", p, 2).cast("long").alias("seq"))


_IDN, _TEL, _MAIL = r"\b[1-9]\d{10}\b", r"(?:\+90|0)[ ]?\(?5\d{2}\)?[ ]?\d{3}[ ]?\d{2}[ ]?\d{2}", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(f"SELECT row_id, a ids, b phones, c mails, CASE WHEN a + b + c > 3 THEN 'high' WHEN a + b + c >= 1 THEN 'medium' ELSE 'low' END risk FROM (SELECT row_id, len(regexp_extract_all(coalesce(full_text,''), '{_IDN}')) a, len(regexp_extract_all(coalesce(full_text,''), '{_TEL}')) b, len(regexp_extract_all(coalesce(full_text,''), '{_MAIL}')) c FROM documents_v2)")
def pii_scan(spark: SparkSession, d: str) -> DataFrame:
    return quality.pii_counts(_dv2(spark, d), "full_text", {"ids": _IDN, "phones": _TEL, "mails": _MAIL}).select("row_id", "ids", "phones", "mails", "risk")


@query(f"SELECT row_id, md5(regexp_replace(regexp_replace(regexp_replace(full_text, '{_IDN}', '[ID]', 'g'), '{_TEL}', '[PHONE]', 'g'), '{_MAIL}', '[EMAIL]', 'g')) digest FROM documents_v2 WHERE full_text IS NOT NULL")
def pii_redact(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("full_text")
    for p, x in ((_IDN, "[ID]"), (_TEL, "[PHONE]"), (_MAIL, "[EMAIL]")):
        t = F.regexp_replace(t, p, x)
    return _dv2(spark, d).filter("full_text is not null").select("row_id", F.md5(F.encode(t, "utf-8")).alias("digest"))


@query("SELECT source, round(avg(CASE WHEN content_status = 'full_text' THEN 1.0 ELSE 0.0 END), 6) full_ratio, round(avg(CASE WHEN quote_usable = 1 THEN 1.0 ELSE 0.0 END), 6) safe_ratio, round(avg(CASE WHEN court IS NULL OR decision_date IS NULL THEN 1.0 ELSE 0.0 END), 6) missing, round(0.5 * avg(CASE WHEN content_status = 'full_text' THEN 1.0 ELSE 0.0 END) + 0.3 * avg(CASE WHEN quote_usable = 1 THEN 1.0 ELSE 0.0 END) + 0.2 * (1 - avg(CASE WHEN court IS NULL OR decision_date IS NULL THEN 1.0 ELSE 0.0 END)), 4) readiness FROM documents_v2 GROUP BY 1")
def bundle_quality(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    full, safe, miss = share(F.col("content_status") == "full_text"), share(F.col("quote_usable") == 1), share(F.col("court").isNull() | F.col("decision_date").isNull())
    return _dv2(spark, d).groupBy("source").agg(F.round(full, 6).alias("full_ratio"), F.round(safe, 6).alias("safe_ratio"), F.round(miss, 6).alias("missing"), F.round(0.5 * full + 0.3 * safe + 0.2 * (1 - miss), 4).alias("readiness"))


@query("SELECT row_id, chamber_no, kind FROM (SELECT row_id, try_cast(regexp_extract(chamber, '^\\s*(\\d+)\\.', 1) AS INT) chamber_no, CASE WHEN chamber ILIKE '%hukuk%' THEN 'civil' WHEN chamber ILIKE '%ceza%' THEN 'criminal' WHEN chamber ILIKE '%daire%' THEN 'administrative' ELSE 'other' END kind FROM documents_v2)")
def classify_chamber(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("chamber")
    kind = F.when(c.ilike("%hukuk%"), "civil").when(c.ilike("%ceza%"), "criminal").when(c.ilike("%daire%"), "administrative").otherwise("other")
    return _dv2(spark, d).select("row_id", F.expr(r"try_cast(regexp_extract(chamber, '^\\s*(\\d+)\\.', 1) as int)").alias("chamber_no"), kind.alias("kind"))


@query("SELECT mevzuat_id, sira, m.madde_no, count(d.row_id) n_amend, count(d.row_id) FILTER (d.tur = 'mulga') n_repealed FROM (SELECT DISTINCT mevzuat_id, sira, madde_no FROM mevzuat_madde) m LEFT JOIN mevzuat_degisiklik d USING (mevzuat_id, sira) GROUP BY 1, 2, 3")
def article_amendments(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "mevzuat_madde").select("mevzuat_id", "sira", "madde_no").distinct()
    a = table(spark, d, "mevzuat_degisiklik").select("mevzuat_id", "sira", "row_id", "tur")
    return m.join(a, ["mevzuat_id", "sira"], "left").groupBy("mevzuat_id", "sira", "madde_no").agg(F.count("row_id").alias("n_amend"), F.count_if(F.col("tur") == "mulga").alias("n_repealed"))


@query("SELECT m.mevzuat_id, m.sira, d.ad, d.tur FROM (SELECT DISTINCT mevzuat_id, sira FROM mevzuat_madde WHERE metin ILIKE '%tebligat%') m JOIN (SELECT mevzuat_id, min(ad) ad, min(tur) tur FROM mevzuat_dokuman WHERE snapshot_no = 4 GROUP BY 1) d ON d.mevzuat_id = m.mevzuat_id")
def article_search_join(spark: SparkSession, d: str) -> DataFrame:
    """Articles found first, their laws' names joined to the hits only."""
    hits = table(spark, d, "mevzuat_madde").filter(F.col("metin").ilike("%tebligat%")).select("mevzuat_id", "sira").distinct()
    laws = table(spark, d, "mevzuat_dokuman").filter("snapshot_no = 4").groupBy("mevzuat_id").agg(F.min("ad").alias("ad"), F.min("tur").alias("tur"))
    return hits.join(laws, "mevzuat_id").select("mevzuat_id", "sira", "ad", "tur")


# -- events: breaker, limiter, counters --------------------------------------------------

_RUNS = "x AS (SELECT *, (event_type = 'error')::INT bad, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) island FROM events)"


@query(f"WITH {_RUNS} SELECT user_id, island::BIGINT island, count(*) FILTER (bad = 1) n_errors, min(event_id) FILTER (bad = 1) first_error FROM x GROUP BY 1, 2 HAVING count(*) FILTER (bad = 1) >= 2")
def error_runs_breaker(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive failures per key: a breaker of threshold two opens in each."""
    return maintenance.failure_runs(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 2, "event_id")


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) n_window FROM events")
def sliding_rate(spark: SparkSession, d: str) -> DataFrame:
    """Events of the same key within the day up to each event."""
    w = Window.partitionBy("user_id").orderBy("_t").rangeBetween(-86_400_000_000, 0)
    return table(spark, d, "events").withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", "user_id", F.count("*").over(w).alias("n_window"))


@query("SELECT event_type, date_trunc('day', ts)::VARCHAR AS dy, count(*) n, round(sum(value), 4) total, round(max(value), 4) highest FROM events GROUP BY 1, 2")
def incremental_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counters brought up to date in two steps: rows above the high-water mark of the first step are added to what it left."""
    e = table(spark, d, "events").select("event_id", "event_type", F.concat(F.to_date("ts").cast("string"), F.lit(" 00:00:00")).alias("dy"), "value")
    half = e.agg((F.max("event_id") / 2).alias("half"))
    first = maintenance.advance(None, e.join(F.broadcast(half), F.col("event_id") <= F.col("half")).drop("half"), "event_id", ["event_type", "dy"], {"total": "value"}, {"highest": "value"})
    both = maintenance.advance(first, e, "event_id", ["event_type", "dy"], {"total": "value"}, {"highest": "value"})
    return both.select("event_type", "dy", "n", F.round("total", 4).alias("total"), F.round("highest", 4).alias("highest"))


@query("SELECT json_extract_string(props, '$.page') page, count(*) n FROM events GROUP BY 1")
def json_property_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.page").alias("page")).agg(F.count("*").alias("n"))


@query("SELECT n_name, count(*) n_orders, round(sum(o_totalprice), 2) revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2024-12-31' GROUP BY 1")
def orders_by_nation(spark: SparkSession, d: str) -> DataFrame:
    """A plain star join; the small sides are left to the planner's size check."""
    t = lambda n: table(spark, d, n)
    o = t("orders").filter(F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp"), F.lit("2024-12-31").cast("timestamp")))
    j = o.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query("SELECT l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 2) qty, round(sum(l_extendedprice * (1 - l_discount)), 2) disc_price, round(avg(l_discount), 6) avg_disc FROM lineitem GROUP BY 1, 2")
def lineitem_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"))
