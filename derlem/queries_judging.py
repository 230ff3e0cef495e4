"""Scores, labels, lookups and series, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from derlem.functions.keys import fold_key, is_blank, pair_key, strip
from derlem.functions.text import tokens
from derlem.operators import judging, legislation, search, vectors
from derlem.queries_corpus import AS_OF, CLEAN, FOLDED, NAME, REC, _dv2, _records
from derlem.plans.understanding import court_filters, expand, law_references, synonyms
from derlem.queries_search import TOK, _bm25_sql, _tfidf_sql, index
from derlem.session import spread, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT row_id, round_even(access_count / 10.0 + round_even((CASE WHEN quote_usable = 1 THEN 0.05 ELSE 0.0 END) + coalesce(0.02 / (1 + greatest(DATE '{AS_OF}' - retrieved_at::DATE, 0) / 1825), 0), 4), 6) score FROM documents_v2 WHERE access_count IS NOT NULL")
def heuristic_rerank(spark: SparkSession, d: str) -> DataFrame:
    df = _dv2(spark, d).filter("access_count is not null")
    age = F.date_diff(F.lit(AS_OF).cast("date"), F.to_date("retrieved_at"))
    return df.select("row_id", judging.rerank(F.col("access_count") / 10.0, F.coalesce(F.col("quote_usable") == 1, F.lit(False)), age).alias("score"))


@query(
    "SELECT e.row_id, round((CASE WHEN lower(trim(d.court)) = 'yargıtay' THEN 3.0 ELSE 0.0 END + CASE WHEN lower(trim(d.karar_no)) = lower(trim(regexp_extract(e.extracted_from, '(\\d{4}/\\d+)', 1))) THEN 2.0 ELSE 0.0 END) / 5.0, 6) score FROM citation_edges e JOIN (SELECT document_id, source, min(court) court, min(karar_no) karar_no FROM documents_v2 GROUP BY 1, 2) d ON d.document_id = e.cited_doc_id AND d.source = e.cited_source WHERE e.extracted_from IS NOT NULL"
)
def metadata_match_score(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "citation_edges").filter("extracted_from is not null").select("row_id", F.col("cited_doc_id").alias("document_id"), F.col("cited_source").alias("source"), F.regexp_extract("extracted_from", r"(\d{4}/\d+)", 1).alias("karar"))
    r = _dv2(spark, d).groupBy("document_id", "source").agg(F.min("court").alias("court"), F.min("karar_no").alias("karar_no"))
    j = e.join(r, ["document_id", "source"])
    s = judging.metadata_match({"court": F.lit("yargıtay"), "karar": F.col("karar")}, {"court": F.col("court"), "karar": F.col("karar_no")}, {"court": 3.0, "karar": 2.0})
    return j.select("row_id", F.round(s, 6).alias("score"))


_TYPE_SQL = "CASE " + " ".join(f"WHEN contains(lower(translate(coalesce(ad,''),'İI','iı')), '{w}') THEN '{k}'" for w, k in judging.TYPES) + " ELSE 'DIGER' END"


@query(f"SELECT row_id, {_TYPE_SQL} kind FROM mevzuat_dokuman")
def classify_legislation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mevzuat_dokuman").select("row_id", judging.classify_type(F.col("ad")).alias("kind"))


@query("SELECT row_id, CASE content_status WHEN 'full_text' THEN 'available' WHEN 'html_markdown' THEN 'available' WHEN 'pdf_link_only' THEN 'link' WHEN 'metadata_only' THEN 'metadata' ELSE 'none' END availability, CASE content_status WHEN 'full_text' THEN 'high' WHEN 'html_markdown' THEN 'medium' WHEN 'pdf_link_only' THEN 'low' WHEN 'metadata_only' THEN 'low' ELSE 'none' END text_confidence FROM documents_v2")
def status_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return judging.enrich_status(_dv2(spark, d)).select("row_id", "availability", "text_confidence")


@query(
    f"WITH {REC}, old AS (SELECT document_id, source, max(nullif(court,'')) court, max(nullif(esas_no,'')) esas_no FROM documents_v2 GROUP BY 1, 2) SELECT rec.row_id, coalesce(nullif(rec.court,''), old.court) court, coalesce(nullif(rec.esas_no,''), old.esas_no) esas_no FROM rec LEFT JOIN old ON old.document_id = rec.document_id AND old.source = rec.source"
)
def metadata_carry_over(spark: SparkSession, d: str) -> DataFrame:
    """Empty fields of the latest delivery filled from any other delivery of the record."""
    full = lambda f: F.max(F.nullif(F.col(f), F.lit(""))).alias(f)
    old = _dv2(spark, d).groupBy("document_id", "source").agg(full("court"), full("esas_no"))
    return judging.carry_over(_records(spark, d).select("row_id", "document_id", "source", "court", "esas_no"), old, ["document_id", "source"], ["court", "esas_no"]).select("row_id", "court", "esas_no")


@query(
    "WITH k AS (SELECT number_e, row_id FROM (SELECT row_id, nullif(regexp_replace(lower(esas_no),'\\s+','','g'),'') number_e FROM documents_v2)), n AS (SELECT row_id, nullif(regexp_replace(lower(karar_no),'\\s+','','g'),'') number_k FROM documents_v2), c AS (SELECT row_id cid, nullif(regexp_replace(lower(regexp_extract(extracted_from,'(\\d{4}/\\d+)',1)),'\\s+','','g'),'') x FROM citation_edges WHERE extracted_from IS NOT NULL), b AS (SELECT cid, k.row_id FROM c JOIN k ON x = number_e UNION SELECT cid, n.row_id FROM c JOIN n ON x = number_k) SELECT cid, row_id, r FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY row_id) r FROM b) WHERE r <= 20"
)
def citation_candidate_lookup(spark: SparkSession, d: str) -> DataFrame:
    no = F.regexp_extract("extracted_from", r"(\d{4}/\d+)", 1)
    c = table(spark, d, "citation_edges").filter("extracted_from is not null").select(F.col("row_id").alias("cid"), no.alias("esas"), no.alias("karar"))
    return judging.first_candidates(c, _dv2(spark, d)).select("cid", "row_id", F.col("r").cast("long").alias("r"))


_WANTED = ["full_text", "html_markdown"]
_PREFERRED, _EXCLUDED = ["yargitay", "aym"], ["kvkk"]


@query("WITH c AS (SELECT source, list(DISTINCT content_status) FILTER (content_status IS NOT NULL) caps FROM documents_v2 WHERE source IS NOT NULL GROUP BY 1) SELECT source, row_number() OVER (ORDER BY coalesce(list_position(['yargitay', 'aym'], source), 1000), source) rank FROM c WHERE list_has_all(caps, ['full_text', 'html_markdown']) AND source <> 'kvkk'")
def capability_routing(spark: SparkSession, d: str) -> DataFrame:
    """Sources that deliver everything wanted, the preferred ones first in their order, the excluded ones out."""
    caps = _dv2(spark, d).filter("source is not null").groupBy("source").agg(F.collect_set("content_status").alias("caps"))
    return judging.route(caps, "source", "caps", _WANTED, _PREFERRED, _EXCLUDED)


@query("SELECT cap, source, rank FROM (SELECT content_status cap, source, row_number() OVER (PARTITION BY content_status ORDER BY coalesce(list_position(['yargitay', 'aym'], source), 1000), source) rank FROM (SELECT DISTINCT content_status, source FROM documents_v2 WHERE content_status IS NOT NULL AND source IS NOT NULL)) WHERE rank = 1")
def best_source_per_capability(spark: SparkSession, d: str) -> DataFrame:
    caps = _dv2(spark, d).filter("source is not null and content_status is not null").select(F.col("content_status").alias("cap"), "source").distinct()
    w = Window.partitionBy("cap").orderBy(judging.preference("source", _PREFERRED), "source")
    return caps.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank = 1").select("cap", "source", "rank")


@query("SELECT row_id, position('hükme esas' IN full_text) pos, substr(full_text, greatest(1, position('hükme esas' IN full_text) - 180), least(180, position('hükme esas' IN full_text) - 1) + 190) quote FROM documents_v2 WHERE contains(full_text, 'hükme esas')")
def exact_quote(spark: SparkSession, d: str) -> DataFrame:
    at = F.locate("hükme esas", F.col("full_text"))
    return _dv2(spark, d).filter(F.col("full_text").contains("hükme esas")).select("row_id", at.cast("long").alias("pos"), F.substring("full_text", F.greatest(F.lit(1), at - 180), F.least(F.lit(180), at - 1) + 190).alias("quote"))


@query("SELECT row_id, CASE WHEN content_hash IS NULL THEN 'ok' WHEN coalesce(full_text,'') = '' THEN 'empty' WHEN sha256(full_text) = content_hash THEN 'ok' ELSE 'stale' END verdict FROM documents_v2")
def hash_verdict(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("content_hash").isNull(), "ok").when(F.coalesce("full_text", F.lit("")) == "", "empty").when(F.sha2(F.encode("full_text", "utf-8"), 256) == F.col("content_hash"), "ok").otherwise("stale")
    return _dv2(spark, d).select("row_id", v.alias("verdict"))


@query("SELECT mevzuat_id, sira, madde_no, substr(sha256(concat_ws(' > ', ust_baslik, baslik) || chr(10) || chr(10) || metin), 1, 32) digest FROM (SELECT DISTINCT mevzuat_id, sira, madde_no, ust_baslik, baslik, metin FROM mevzuat_madde) WHERE length(metin) >= 20")
def embedding_text_hash(spark: SparkSession, d: str) -> DataFrame:
    """The hash of an article's text with its headings before it: what an embedding was made of."""
    m = table(spark, d, "mevzuat_madde").select("mevzuat_id", "sira", "madde_no", "ust_baslik", "baslik", "metin").distinct().filter(F.length("metin") >= 20)
    t = F.concat(F.concat_ws(" > ", "ust_baslik", "baslik"), F.lit("\n\n"), F.col("metin"))
    return m.select("mevzuat_id", "sira", "madde_no", F.substring(F.sha2(F.encode(t, "utf-8"), 256), 1, 32).alias("digest"))


@query("SELECT provider_id, count(*) n, count(DISTINCT document_id) n_docs, max(dim) dim FROM embedding_vectors GROUP BY 1 ORDER BY n DESC, provider_id LIMIT 1")
def best_provider(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "embedding_vectors").groupBy("provider_id").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("n_docs"), F.max("dim").alias("dim"))
    return g.orderBy(F.col("n").desc(), "provider_id").limit(1)


@query("SELECT e.document_id, e.source, e.chunk_index FROM embedding_vectors e JOIN (SELECT document_id, source, max(content_hash) h FROM documents_v2 GROUP BY 1, 2) d ON d.document_id = e.document_id AND d.source = e.source WHERE d.h IS DISTINCT FROM e.content_hash")
def stale_vectors(spark: SparkSession, d: str) -> DataFrame:
    cur = _dv2(spark, d).groupBy("document_id", "source").agg(F.max("content_hash").alias("h"))
    return table(spark, d, "embedding_vectors").join(cur, ["document_id", "source"]).filter(~F.col("h").eqNullSafe(F.col("content_hash"))).select("document_id", "source", "chunk_index")


@query("SELECT document_id, source, provider_id, count(*) n, max(chunk_index) + 1 - count(DISTINCT chunk_index) n_gaps, count(*) - count(DISTINCT chunk_index) n_repeats FROM embedding_vectors GROUP BY 1, 2, 3")
def chunk_gaps(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "embedding_vectors").groupBy("document_id", "source", "provider_id")
    return g.agg(F.count("*").alias("n"), (F.max("chunk_index") + 1 - F.count_distinct("chunk_index")).alias("n_gaps"), (F.count("*") - F.count_distinct("chunk_index")).alias("n_repeats"))


@query(
    "WITH a AS (SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings WHERE vec_id % 50 = 0), b AS (SELECT vec_id, label, embedding::DOUBLE[] e FROM embeddings) SELECT a.vec_id a, b.vec_id b, round(list_cosine_similarity(a.e, b.e), 6) score, CASE WHEN list_cosine_similarity(a.e, b.e) > 0.95 THEN 'high' WHEN list_cosine_similarity(a.e, b.e) > 0.9 THEN 'medium' ELSE 'low' END confidence FROM a JOIN b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.3"
)
def fuzzy_pairs_same_label(spark: SparkSession, d: str) -> DataFrame:
    """A search, not the pair operator (that is fuzzy_duplicates): vectors whose id is divisible by 50 against all of the same label, at a cosine of 0.3 or more."""
    e = table(spark, d, "embeddings")
    a = e.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("a"), "label", F.col("embedding").alias("x"))
    b = e.select(F.col("vec_id").alias("b"), "label", F.col("embedding").alias("y"))
    j = a.join(b, "label").filter("a <> b").withColumn("s", vectors.cosine(F.col("x"), F.col("y"))).filter("s >= 0.3")
    return j.select("a", "b", F.round("s", 6).alias("score"), F.when(F.col("s") > 0.95, "high").when(F.col("s") > 0.9, "medium").otherwise("low").alias("confidence"))


_KEY = f"coalesce({FOLDED('document_id')}, '') || chr(31) || coalesce({FOLDED('source')}, '')"


@query(
    f"WITH {REC}, r AS (SELECT {_KEY} k, document_id, source, coalesce(nullif({CLEAN('court')}, ''), 'unknown') court, CASE WHEN regexp_matches(decision_date, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') THEN try_strptime(decision_date, '%Y-%m-%d')::DATE END iso, CASE WHEN regexp_matches(decision_date, '^[0-9]{{1,2}}[.][0-9]{{1,2}}[.][0-9]{{4}}$') THEN try_strptime(decision_date, '%d.%m.%Y')::DATE END dotted FROM rec), "
    f"g AS (SELECT {_KEY} k, list(DISTINCT {FOLDED('cluster_id')}) cs FROM dedup_members WHERE {CLEAN('cluster_id')} <> '' GROUP BY 1), j AS (SELECT r.*, v.provider_id, v.vector::DOUBLE[] u, coalesce(g.cs, []) cs FROM (SELECT *, {_KEY} k FROM embedding_vectors) v JOIN r USING (k) LEFT JOIN g USING (k)), "
    "p AS (SELECT a.k ka, b.k kb, a.document_id doc_a, a.source source_a, b.document_id doc_b, b.source source_b, list_cosine_similarity(a.u, b.u) s, coalesce(abs(a.iso - b.iso), abs(a.dotted - b.dotted)) gap FROM j a JOIN j b ON a.court = b.court AND a.provider_id = b.provider_id AND len(a.u) = len(b.u) AND a.k < b.k WHERE NOT list_has_any(a.cs, b.cs)) "
    "SELECT any_value(doc_a) doc_a, any_value(source_a) source_a, any_value(doc_b) doc_b, any_value(source_b) source_b, round(max(s), 6) score, count(*) n_links, any_value(gap) date_gap, CASE WHEN max(s) > 0.95 THEN 'high' WHEN max(s) > 0.9 THEN 'medium' ELSE 'low' END confidence FROM p WHERE s >= 0.85 AND coalesce(gap <= 365, true) GROUP BY ka, kb"
)
def fuzzy_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records of one court (none is one bucket), not yet clustered together, at a cosine of 0.85 or more and at most 365 days apart."""
    key = pair_key("document_id", "source").alias("k")
    date = lambda pattern, form: F.when(F.col("decision_date").rlike(pattern), F.try_to_timestamp("decision_date", F.lit(form)).cast("date"))
    court = F.when(is_blank("court"), "unknown").otherwise(strip("court"))
    recs = _records(spark, d).select(key, "document_id", "source", court.alias("court"), date(r"^\d{4}-\d{1,2}-\d{1,2}\z", "yyyy-M-d").alias("iso"), date(r"^\d{1,2}\.\d{1,2}\.\d{4}\z", "d.M.yyyy").alias("dotted"))
    groups = table(spark, d, "dedup_members").filter(~is_blank("cluster_id")).groupBy(key).agg(F.collect_set(fold_key("cluster_id")).alias("clusters"))
    v = table(spark, d, "embedding_vectors").select(key, "provider_id", "vector").join(recs, "k").join(groups, "k", "left")
    return vectors.fuzzy_pairs(v.withColumn("clusters", F.coalesce("clusters", F.array().cast("array<string>"))))


@query(
    "WITH p AS (SELECT * FROM (@FUZZY@)), e AS (SELECT doc_a document_id, source_a source, score, confidence FROM p UNION ALL SELECT doc_b, source_b, score, confidence FROM p) SELECT document_id, source, count(*) n_partners, max(score) best, count(*) FILTER (confidence = 'high') n_high FROM e GROUP BY 1, 2"
)
def fuzzy_links(spark: SparkSession, d: str) -> DataFrame:
    """One row per suspected record with the number of its partners and the best score: the form for tables of any size."""
    p = fuzzy_duplicates(spark, d)
    side = lambda x: p.select(F.col(f"doc_{x}").alias("document_id"), F.col(f"source_{x}").alias("source"), "score", "confidence")
    g = side("a").unionByName(side("b")).groupBy("document_id", "source")
    return g.agg(F.count("*").alias("n_partners"), F.max("score").alias("best"), F.count_if(F.col("confidence") == "high").alias("n_high"))


SQL["fuzzy_links"] = SQL["fuzzy_links"].replace("@FUZZY@", SQL["fuzzy_duplicates"])



_ARG = "regexp_matches(full_text, '(?i)(hükme esas|gerekçe|sonuç olarak)')"


@query(f"SELECT source, count(*) n, least(count(*) / 5.0, 1.0) * 0.4 + round(avg(CASE WHEN content_status = 'full_text' THEN 1.0 ELSE 0.0 END), 6) * 0.3 + round(avg(CASE WHEN quote_usable = 1 THEN 1.0 ELSE 0.0 END), 6) * 0.3 score FROM documents_v2 WHERE {_ARG} GROUP BY 1")
def argument_score(spark: SparkSession, d: str) -> DataFrame:
    """Strength of what each source offers in support: number, text and safety of passages with a marker."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    g = _dv2(spark, d).filter(F.col("full_text").rlike("(?i)(hükme esas|gerekçe|sonuç olarak)")).groupBy("source")
    return g.agg(F.count("*").alias("n"), (F.least(F.count("*") / 5.0, F.lit(1.0)) * 0.4 + share(F.col("content_status") == "full_text") * 0.3 + share(F.col("quote_usable") == 1) * 0.3).alias("score"))


@query(
    f"WITH w AS (SELECT DISTINCT source, unnest({TOK}) w FROM documents WHERE source IS NOT NULL), n AS (SELECT s.source, count(w.w) n FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) s LEFT JOIN w USING (source) GROUP BY 1), c AS (SELECT a.source a, b.source b, count(*) k FROM w a JOIN w b ON a.w = b.w AND a.source < b.source GROUP BY 1, 2), "
    "j AS (SELECT x.source a, y.source b, coalesce(k, 0) / greatest(1, x.n + y.n - coalesce(k, 0)) s FROM n x JOIN n y ON x.source < y.source LEFT JOIN c ON c.a = x.source AND c.b = y.source) SELECT a, b, CASE WHEN s >= 0.3 THEN 'strong' WHEN s >= 0.1 THEN 'weak' ELSE 'none' END bucket FROM j"
)
def keyword_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Shared words of the vocabularies of every two sources, over all documents."""
    docs = spread(table(spark, d, "documents").select("source", "text"))
    return judging.vocabulary_overlap(docs.filter("source is not null"), "source", tokens("text"))


_LAST4 = f"l AS (SELECT {NAME('ad')} nm, trim(mevzuat_no) no, trim(mevzuat_id) id FROM mevzuat_dokuman WHERE snapshot_no = 4 AND mevzuat_id IS NOT NULL)"


@query(
    f"WITH {_LAST4}, i AS (SELECT row_id, {NAME("regexp_replace(ad, ' [^ ]+$', '')")} nm, trim(mevzuat_no) no FROM mevzuat_dokuman WHERE snapshot_no = 1), e AS (SELECT nm, min(id) id FROM l WHERE nm IS NOT NULL GROUP BY 1), p AS (SELECT i.row_id, min(e.id) id FROM i JOIN e ON length(i.nm) >= 15 AND starts_with(e.nm, i.nm) GROUP BY 1), n AS (SELECT no, min(id) id FROM l WHERE no IS NOT NULL GROUP BY 1) "
    "SELECT i.row_id, coalesce(e.id, p.id, n.id) mevzuat_id, CASE WHEN e.id IS NOT NULL THEN 'name' WHEN p.id IS NOT NULL THEN 'beginning' WHEN n.id IS NOT NULL THEN 'number' END matched_by FROM i LEFT JOIN e ON e.nm = i.nm LEFT JOIN p ON p.row_id = i.row_id LEFT JOIN n ON n.no = i.no"
)
def name_record_match(spark: SparkSession, d: str) -> DataFrame:
    """The first delivery's laws, by their names without the last word, found again in the last delivery: by name, by its beginning, else by number."""
    docs = table(spark, d, "mevzuat_dokuman")
    items = docs.filter("snapshot_no = 1").select("row_id", F.regexp_replace("ad", " [^ ]+$", "").alias("target"), F.trim("mevzuat_no").alias("no"))
    laws = docs.filter("snapshot_no = 4 and mevzuat_id is not null")
    return legislation.match_names(items, laws, "row_id", "target", "no").select("row_id", "mevzuat_id", "matched_by")



@query("WITH l AS (SELECT user_id, max(ts) m FROM events GROUP BY 1) SELECT user_id, count(*) FILTER (ts > m - INTERVAL 1 HOUR) last_hour, round(count(*) FILTER (ts > m - INTERVAL 24 HOUR) / 24.0, 6) per_hour FROM events JOIN l USING (user_id) GROUP BY 1")
def throughput(spark: SparkSession, d: str) -> DataFrame:
    """Per key the events of the hour and the rate of the day up to its last one."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    last = e.groupBy("user_id").agg(F.max("ts").alias("m"))
    g = e.join(last, "user_id").groupBy("user_id")
    return g.agg(F.count_if(F.col("ts") > F.col("m") - F.expr("interval 1 hour")).alias("last_hour"), F.round(F.count_if(F.col("ts") > F.col("m") - F.expr("interval 24 hours")) / 24.0, 6).alias("per_hour"))


@query("SELECT event_type, count(*) n, round(sum(value), 4) total_ms, round(max(value), 4) max_ms, round(avg(value), 4) avg_ms FROM events GROUP BY 1")
def query_profile(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 4)
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum("value")).alias("total_ms"), r(F.max("value")).alias("max_ms"), r(F.avg("value")).alias("avg_ms"))


@query("SELECT coalesce(a.mevzuat_id, b.mevzuat_id) mevzuat_id, CASE WHEN a.h IS NULL THEN 'new' ELSE 'changed' END kind FROM (SELECT mevzuat_id, max(coalesce(metin_hash,'')) h FROM mevzuat_dokuman WHERE snapshot_no = 3 AND mevzuat_id IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT mevzuat_id, max(coalesce(metin_hash,'')) h FROM mevzuat_dokuman WHERE snapshot_no = 4 AND mevzuat_id IS NOT NULL GROUP BY 1) b ON a.mevzuat_id = b.mevzuat_id WHERE b.h IS NOT NULL AND a.h IS DISTINCT FROM b.h")
def bundle_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Keys that a newer manifest adds or whose hash it changes."""
    docs = table(spark, d, "mevzuat_dokuman").filter("mevzuat_id is not null")
    one = lambda n, c: docs.filter(F.col("snapshot_no") == n).groupBy("mevzuat_id").agg(F.max(F.coalesce("metin_hash", F.lit(""))).alias(c))
    j = one(3, "a").join(one(4, "b"), "mevzuat_id", "full_outer").filter("b is not null and not a <=> b")
    return j.select("mevzuat_id", F.when(F.col("a").isNull(), "new").otherwise("changed").alias("kind"))


@query("WITH r AS (SELECT DISTINCT source, document_id, content_status IN ('full_text','html_markdown') IS TRUE ok, quote_usable = 1 IS TRUE usable FROM documents_v2 WHERE document_id IS NOT NULL), x AS (SELECT source, CASE WHEN NOT ok THEN 'status' WHEN NOT coalesce(usable, false) THEN 'not usable' ELSE 'safe' END reason, document_id FROM r) SELECT source, reason, count(*) n, sum(('0x' || substr(sha256(document_id), 1, 12))::BIGINT)::BIGINT digest FROM (SELECT DISTINCT * FROM x) GROUP BY 1, 2")
def input_pack_hash(spark: SparkSession, d: str) -> DataFrame:
    """Each source's records split into safe ones and excluded ones with the reason, and a digest of each part's ids that no order changes and no list is collected for.

    The digest is the SQL's sum of 48-bit numbers, kept modulo 2^64 as a signed long. Above some 65,000 records in a part the sum itself
    can leave a long, and the SQL's last cast fails; below, the two are equal.
    """
    reason = F.when(~F.coalesce(F.col("content_status").isin("full_text", "html_markdown"), F.lit(False)), "status").when(~F.coalesce(F.col("quote_usable") == 1, F.lit(False)), "not usable").otherwise("safe")
    ids = _dv2(spark, d).filter("document_id is not null").select("source", reason.alias("reason"), "document_id").distinct()
    part = F.conv(F.substring(F.sha2(F.encode("document_id", "utf-8"), 256), 1, 12), 16, 10).cast("long")
    # the halves' sums stay below 2^63 up to 2^39 records; a shift drops what is above 64 bits
    g = ids.withColumn("part", part).groupBy("source", "reason").agg(F.count("*").alias("n"), F.sum(F.shiftright("part", 24)).alias("hi"), F.sum(F.col("part").bitwiseAND(0xFFFFFF)).alias("lo"))
    digest = F.shiftleft(F.col("hi") + F.shiftright("lo", 24), 24).bitwiseOR(F.col("lo").bitwiseAND(0xFFFFFF))
    return g.select("source", "reason", "n", digest.alias("digest"))


@query(
    f"WITH w AS (SELECT doc_id, unnest({TOK}) w FROM documents), p AS (SELECT doc_id, w, 1.5 x FROM w UNION ALL SELECT doc_id, substr(w, i, 3), 0.35 FROM (SELECT doc_id, w, unnest(range(1, length(w) - 1)) i FROM w WHERE length(w) >= 5)), "
    "h AS (SELECT doc_id, sha256(w) h, x FROM p), a AS (SELECT doc_id, (('0x' || substr(h, 1, 7))::BIGINT % 128)::INT axis, sum(CASE WHEN ('0x' || substr(h, 8, 1))::INT % 2 = 0 THEN x ELSE -x END) x FROM h GROUP BY 1, 2), n AS (SELECT doc_id, sqrt(sum(x * x)) n FROM a GROUP BY 1) SELECT doc_id, axis, round(x / greatest(n, 1e-12), 6) x FROM a JOIN n USING (doc_id)"
)
def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Hash embeddings of whole texts, without any model, a row per axis."""
    v = judging.hash_embedding(table(spark, d, "documents"), "doc_id", tokens("text"))
    return v.select("doc_id", "axis", F.round("x", 6).alias("x"))


_HV = "(WITH w AS (SELECT doc_id, unnest({tok}) w FROM {src}), p AS (SELECT doc_id, w, 1.5 x FROM w UNION ALL SELECT doc_id, substr(w, i, 3), 0.35 FROM (SELECT doc_id, w, unnest(range(1, length(w) - 1)) i FROM w WHERE length(w) >= 5)), h AS (SELECT doc_id, sha256(w) h, x FROM p), a AS (SELECT doc_id, (('0x' || substr(h, 1, 7))::BIGINT % 128)::INT axis, sum(CASE WHEN ('0x' || substr(h, 8, 1))::INT % 2 = 0 THEN x ELSE -x END) x FROM h GROUP BY 1, 2) SELECT a.doc_id, axis, x / greatest(n, 1e-12) x FROM a JOIN (SELECT doc_id, sqrt(sum(x * x)) n FROM a GROUP BY 1) n USING (doc_id))"
_ASK = ["tapu", "kira", "tahliye"]


@query(
    f"WITH {_bm25_sql(_ASK, 'OR')}, {_tfidf_sql(_ASK)}, dv AS {_HV.format(tok=TOK, src='documents')}, qv AS {_HV.format(tok=TOK, src=f"(SELECT 0 doc_id, {chr(39)}{' '.join(_ASK)}{chr(39)} AS {chr(34)}text{chr(34)})")}, de AS (SELECT dv.doc_id, sum(dv.x * qv.x) score FROM dv JOIN qv USING (axis) GROUP BY 1 HAVING sum(dv.x * qv.x) > 0), "
    "hy AS (SELECT doc_id, 0.6 * coalesce(abs(b.score) / (1 + abs(b.score)), 0) + 0.4 * coalesce(t.score, 0) score FROM bm b FULL JOIN ti t USING (doc_id)) SELECT doc_id, round(s, 6) score FROM (SELECT doc_id, (coalesce(hy.score, 0) + 0.5 * coalesce(de.score, 0)) / 1.5 s FROM hy FULL JOIN de USING (doc_id)) ORDER BY s DESC, doc_id LIMIT 20"
)
def hybrid_dense_top20(spark: SparkSession, d: str) -> DataFrame:
    """Three rankers in one score: BM25, TF-IDF and hash embeddings, of which only the axes the query has are read."""
    ix = index(spark, d)
    docs = judging.hash_embedding(table(spark, d, "documents"), "doc_id", tokens("text"))
    ask = judging.hash_embedding(spark.createDataFrame([(0, " ".join(_ASK))], "doc_id long, text string"), "doc_id", tokens("text")).select("axis", F.col("x").alias("q"))
    dense = docs.join(F.broadcast(ask), "axis").groupBy("doc_id").agg(F.sum(F.col("x") * F.col("q")).alias("score")).filter("score > 0")
    key = lambda df: df.withColumnRenamed("key", "doc_id")
    h = search.hybrid(key(ix.bm25(_ASK, mode="or")), key(ix.cosine(_ASK)), "doc_id", norm="monotone", dense=dense, dense_weight=0.5)
    return search.top(h, "doc_id", 20).select("doc_id", F.round("score", 6).alias("score"))


_STEMMED = expand(["bedelini", "taşınmazın"])


@query(f"WITH {_bm25_sql(_STEMMED, 'OR')} SELECT doc_id, round(score, 6) score FROM bm")
def suffix_expanded_search(spark: SparkSession, d: str) -> DataFrame:
    """OR over the query's words and their stems."""
    return index(spark, d).bm25(_STEMMED, mode="or").select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


_RARE = ["kamulaştırma", "tescilini", "ecrimisil", "ruhsat"]


def _fallback_sql(least: int) -> str:
    return f"WITH {_bm25_sql(_RARE, 'AND', 'a')}, {_bm25_sql(_RARE, 'OR', 'o')}, u AS (SELECT (SELECT count(*) FROM a) >= {least} OR (SELECT count(*) FROM o) <= (SELECT count(*) FROM a) AS every) SELECT doc_id, round(score, 6) score FROM a, u WHERE every UNION ALL SELECT doc_id, round(score, 6) FROM o, u WHERE NOT every"


@query(_fallback_sql(3))
def and_or_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Every term first; where fewer than three match and some-term search finds more, that."""
    ix = index(spark, d)
    return search.fallback(ix.bm25(_RARE), ix.bm25(_RARE, mode="or"), 3).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(_fallback_sql(10_000_000))
def live_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The same where a whole page of rows is wanted, so that the search for some terms takes over."""
    ix = index(spark, d)
    return search.fallback(ix.bm25(_RARE), ix.bm25(_RARE, mode="or"), 10_000_000).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query()
def approximate_profile(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of a corpus in one pass: distinct texts, quantiles of length, frequent sources."""
    return table(spark, d, "documents").groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n_texts"), F.approx_percentile(F.length("text"), F.array(F.lit(0.5), F.lit(0.95))).alias("lengths"))


@query("SELECT row_id, regexp_matches(trim(chamber), '^(([1-9]|1[0-9]|2[0-3])\\. (Hukuk|Ceza) Dairesi|([1-9]|1[0-7])\\. Daire)$') known FROM documents_v2 WHERE chamber IS NOT NULL")
def known_chambers(spark: SparkSession, d: str) -> DataFrame:
    """Chambers held against the closed list of those there are: 23 civil and 23 criminal ones, and 17 of the administrative court."""
    return _dv2(spark, d).filter("chamber is not null").select("row_id", F.trim("chamber").isin(judging.CHAMBERS).alias("known"))


#: What queries say beside their words, as each function must read them.
_SAID = [("Yargıtay 3. Hukuk Dairesi kira", "Yargitay", "3. Hukuk Dairesi", "high", "kira bedeli, kiracı, kiralayan, tahliye", "Yargıtay 3. Hukuk Dairesi kira"), ("TBK 344 sözleşme", None, None, "low", "akit, mukavele, sözleşme ihlali", "6098 (Türk Borçlar Kanunu) m.344 sözleşme"), ("Danıştay iptal", "Danistay", None, "medium", "", "Danıştay iptal")]


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in _SAID) + ") t(query, court, chamber, confidence, added, normalised)")
def understood_queries(spark: SparkSession, d: str) -> DataFrame:
    """Courts, chambers, synonyms and law references of some queries."""
    rows = []
    for q, *_ in _SAID:
        got, sure = court_filters(q)
        rows.append((q, got.get("court"), got.get("chamber"), sure, ", ".join(synonyms(q)), law_references(q)[0]))
    return spark.createDataFrame(rows, "query string, court string, chamber string, confidence string, added string, normalised string")
