"""Records: status, finalising, authority, duplicates, personal data, coverage, exchange, with the SQL that checks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from derlem.functions.keys import effective_text, fold_key, is_blank, strip
from derlem.functions.text import lower_tr
from derlem.operators import judging, legislation, maintenance, quality, vectors
from derlem.queries_corpus import AS_OF, CLEAN, EFF, FOLDED, REC, STRIPPED, _dv2, _records
from derlem.queries_search import _COS, TOK, _query_vector, index
from derlem.session import spread, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_YES = lambda c: f"coalesce({c}, '') <> ''"

# -- status and authority ----------------------------------------------------------------


@query(
    f"SELECT row_id, CASE content_status WHEN 'full_text' THEN 'full text' WHEN 'html_markdown' THEN 'markdown' WHEN 'pdf_link_only' THEN 'link' WHEN 'metadata_only' THEN 'metadata' ELSE 'none' END label, (content_status IN ('full_text','html_markdown') AND length({STRIPPED}) > 0) IS TRUE text_available, ((content_status IN ('full_text','html_markdown') AND length({STRIPPED}) > 0) IS TRUE OR content_status = 'pdf_link_only') IS TRUE content_available, "
    f"CASE WHEN {_YES('title')} AND {_YES('source')} AND ({_YES('decision_date')} OR {_YES('esas_no')} OR {_YES('karar_no')}) THEN 'high' WHEN {_YES('title')} AND {_YES('source')} THEN 'medium' ELSE 'low' END confidence, CASE WHEN content_status = 'pdf_link_only' THEN 'verify the file' WHEN content_status = 'metadata_only' THEN 'fetch the text' WHEN content_status = 'unavailable' THEN 'nothing to read' END next_step FROM documents_v2"
)
def status_fields(spark: SparkSession, d: str) -> DataFrame:
    """What a record's status means for a reader; never taken from the stored flags."""
    return quality.status_fields(_dv2(spark, d)).select("row_id", "label", "text_available", "content_available", "confidence", "next_step")


_BODY = f"CASE WHEN length({STRIPPED}) >= 50 THEN {EFF} END"


@query(
    f"SELECT row_id, length({STRIPPED}) >= 50 long_enough, CASE WHEN content_status IN ('full_text','html_markdown') AND length({STRIPPED}) < 50 THEN 'metadata_only' ELSE content_status END status, sha256({_BODY}) hash, CASE WHEN regexp_matches(trim(decision_date), '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN substr(trim(decision_date), 1, 4)::INT NOT BETWEEN 1920 AND 2026 WHEN regexp_matches(trim(decision_date), '^\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}$') THEN substr(trim(decision_date), 7, 4)::INT NOT BETWEEN 1920 AND 2026 ELSE false END odd_date FROM documents_v2"
)
def finalised(spark: SparkSession, d: str) -> DataFrame:
    """Records as they are stored: short texts dropped with their hash, dates outside of 1920 to next year marked but left."""
    return quality.finalise(_dv2(spark, d), 1920, 2026).select("row_id", "long_enough", "status", "hash", "odd_date")


_REASONS = f"(content_status IN ('full_text','html_markdown') AND length({STRIPPED}) > 0 AND ({_YES('source_url')} OR {_YES('esas_no')} OR {_YES('karar_no')})) IS TRUE"
_HASH_OK = f"(content_hash IS NULL OR (coalesce({EFF}, '') <> '' AND sha256({EFF}) = content_hash)) IS TRUE"
_AUTHORITY = f"CASE WHEN content_status = 'unavailable' OR NOT {_HASH_OK} THEN 'excluded' WHEN {_REASONS} AND length({STRIPPED}) >= 50 THEN 'ready' WHEN {_REASONS} THEN 'citation_only' WHEN ({_YES('title')} OR {_YES('court')} OR {_YES('decision_date')} OR {_YES('esas_no')} OR {_YES('karar_no')} OR {_YES('source_url')}) THEN CASE WHEN content_status = 'pdf_link_only' THEN 'citation_only' ELSE 'lead_only' END ELSE 'excluded' END"


@query(f"SELECT row_id, {_AUTHORITY} authority FROM documents_v2")
def authority_class(spark: SparkSession, d: str) -> DataFrame:
    """What a record may be used for: quoting, citing, as a lead, or nothing."""
    return _dv2(spark, d).select("row_id", quality.authority().alias("authority"))


@query(f"SELECT coalesce(court, '') court, {_AUTHORITY} authority, count(*) n, round(count(*) / sum(count(*)) OVER (PARTITION BY coalesce(court, '')), 6) share FROM documents_v2 GROUP BY 1, 2")
def argument_chain(spark: SparkSession, d: str) -> DataFrame:
    """How strong each court's records are as a chain of authorities: the distribution of their classes."""
    g = _dv2(spark, d).groupBy(F.coalesce("court", F.lit("")).alias("court"), quality.authority().alias("authority")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("court")), 6))


@query(f"SELECT 'old_decision' finding, coalesce(court, '') court, count(*) n FROM documents_v2 WHERE regexp_matches({CLEAN('decision_date')}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND substr({CLEAN('decision_date')}, 1, 4)::INT < 2010 GROUP BY 2 UNION ALL SELECT 'same_court', coalesce(court, ''), count(*) FROM documents_v2 GROUP BY 2 HAVING count(*) >= 2")
def consistency(spark: SparkSession, d: str) -> DataFrame:
    """What to look at before citing several decisions together: old ones (before 2010 here) and several of one court."""
    return quality.consistency(_dv2(spark, d), 2010)


_SAYS = {"holding": "(sonuç olarak|neticeten|karar sonucu|hüküm|karar vermek gerekmiştir|yukarıda açıklanan nedenlerle|açıklanan sebeplerle|hükme esas)", "ratio": "(dava konusu uyuşmazlık|uyuşmazlık konusu|ihtilaf konusu|mahkemece|yerel mahkemece)", "dispute": "(taraflar arasındaki uyuşmazlık|taraflar arasındaki|davanın konusu|davacı taraf|davalı taraf)"}
_PARAS = f"p AS (SELECT row_id, i, lower(translate(paras[i], 'İI', 'iı')) t FROM (SELECT row_id, paras, unnest(range(1, len(paras) + 1)) i FROM (SELECT row_id, list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(10) || chr(13) || chr(9))), lambda x: x <> '') paras FROM (SELECT row_id, coalesce({EFF}, '') t FROM documents_v2) WHERE length(t) >= 100)))"


@query(f"WITH {_PARAS} SELECT row_id, least(count(*) FILTER (regexp_matches(t, '{_SAYS['holding']}')), 3) n_holdings, count(*) FILTER (regexp_matches(t, '{_SAYS['ratio']}')) > 0 has_ratio, count(*) FILTER (i <= 10 AND regexp_matches(t, '{_SAYS['dispute']}')) > 0 has_dispute FROM p GROUP BY 1")
def argument_mining(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs that state a holding (three at most count), a ground, or, among the first ten, what is in dispute."""
    return judging.mine(_dv2(spark, d), "row_id", effective_text(), _SAYS)


# -- duplicates and metadata -------------------------------------------------------------

_MEM = f"m AS (SELECT DISTINCT {FOLDED('cluster_id')} c, document_id, source FROM dedup_members WHERE cluster_id IS NOT NULL AND document_id IS NOT NULL)"


def _members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dedup_members").filter("cluster_id is not null and document_id is not null").select(fold_key("cluster_id").alias("c"), "document_id", "source").distinct()


@query(f"WITH {_MEM} SELECT m.document_id, m.source, m.c cluster, n.size, k.canonical_doc_id canonical, m.document_id IS NOT DISTINCT FROM k.canonical_doc_id is_canonical FROM m JOIN (SELECT c, count(*) size FROM m GROUP BY 1) n USING (c) LEFT JOIN (SELECT {FOLDED('cluster_id')} c, min(canonical_doc_id) canonical_doc_id FROM dedup_clusters WHERE cluster_id IS NOT NULL GROUP BY 1) k USING (c)")
def cluster_of_document(spark: SparkSession, d: str) -> DataFrame:
    """Every member with its group, the group's size and stored choice: membership in place of all pairs of a group."""
    m = _members(spark, d)
    size = m.groupBy("c").agg(F.count("*").alias("size"))
    chosen = table(spark, d, "dedup_clusters").filter("cluster_id is not null").groupBy(fold_key("cluster_id").alias("c")).agg(F.min("canonical_doc_id").alias("canonical"))
    j = m.join(size, "c").join(chosen, "c", "left")
    return j.select("document_id", "source", F.col("c").alias("cluster"), "size", "canonical", F.col("document_id").eqNullSafe(F.col("canonical")).alias("is_canonical"))


@query(f"WITH {_MEM} SELECT DISTINCT m.c cluster, d.source_url url FROM m JOIN documents_v2 d USING (document_id, source) WHERE coalesce(d.source_url, '') <> ''")
def cluster_addresses(spark: SparkSession, d: str) -> DataFrame:
    """The addresses under which a group's members are found, one row each: what a merge gives the chosen member."""
    urls = _dv2(spark, d).select("document_id", "source", F.col("source_url").alias("url")).filter("coalesce(url, '') <> ''")
    return _members(spark, d).join(urls, ["document_id", "source"]).select(F.col("c").alias("cluster"), "url").distinct()


_PAIR = lambda f: f"CASE WHEN a.{f} IS NOT NULL AND b.{f} IS NOT NULL"
_MATCH = (
    f"WITH {_MEM}, r AS (SELECT document_id, source, nullif(min(trim(court)), '') court, nullif(min(trim(chamber)), '') chamber, nullif(min(trim(esas_no)), '') esas, nullif(min(trim(karar_no)), '') karar, nullif(min(trim(decision_date)), '') dt FROM documents_v2 GROUP BY 1, 2), j AS (SELECT m.c, m.document_id, m.source, r.* EXCLUDE (document_id, source) FROM m JOIN r USING (document_id, source)), "
    "a AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY c ORDER BY document_id, source) = 1), s AS (SELECT b.c cluster, b.document_id, b.source, "
    f"{_PAIR('court')} THEN 3.0 ELSE 0 END + {_PAIR('chamber')} THEN 2.0 ELSE 0 END + {_PAIR('esas')} THEN 3.0 ELSE 0 END + {_PAIR('karar')} THEN 3.0 ELSE 0 END + {_PAIR('dt')} THEN 2.0 ELSE 0 END total, "
    f"{_PAIR('court')} THEN CASE WHEN contains(lower(b.court), lower(a.court)) OR contains(lower(a.court), lower(b.court)) THEN 3.0 ELSE 0.5 END ELSE 0 END + {_PAIR('chamber')} AND contains(lower(b.chamber), lower(a.chamber)) THEN 2.0 ELSE 0 END + "
    + " + ".join(f"{_PAIR(f)} THEN CASE WHEN a.{f} = b.{f} THEN 3.0 WHEN contains(b.{f}, a.{f}) OR contains(a.{f}, b.{f}) THEN 2.0 ELSE 0 END ELSE 0 END" for f in ("esas", "karar"))
    + " + CASE WHEN a.dt = b.dt THEN 2.0 ELSE 0 END got FROM a JOIN j b USING (c) WHERE (a.document_id, a.source) <> (b.document_id, b.source)) SELECT cluster, document_id, source, CASE WHEN total > 0 THEN round(got / total, 4) ELSE 0 END score FROM s"
)


@query(_MATCH)
def metadata_match(spark: SparkSession, d: str) -> DataFrame:
    """How well the members of a group agree with its first one on court, chamber, both numbers and date."""
    low = lambda f: F.nullif(F.min(F.trim(F.col(f))), F.lit(""))
    names = {"court": "court", "chamber": "chamber", "esas": "esas_no", "karar": "karar_no", "dt": "decision_date"}
    r = _dv2(spark, d).groupBy("document_id", "source").agg(*[low(f).alias(n) for n, f in names.items()])
    j = _members(spark, d).join(r, ["document_id", "source"])
    first = j.groupBy("c").agg(F.min(F.struct("document_id", "source", *names)).alias("a"))
    b = j.join(first, "c").filter(~(F.struct("document_id", "source") == F.struct("a.document_id", "a.source")))
    return b.select(F.col("c").alias("cluster"), "document_id", "source", F.round(judging.citation_match({n: F.col(f"a.{n}") for n in names}, {n: F.col(n) for n in names}), 4).alias("score"))


@query("SELECT row_id, coalesce(nullif(trim(title), ''), nullif(concat_ws(' ', nullif(trim(court), ''), nullif(trim(chamber), ''), nullif(trim(karar_no), '')), '')) title, CASE WHEN chamber ILIKE '%hukuk%' THEN 'civil' WHEN chamber ILIKE '%ceza%' THEN 'criminal' ELSE 'other' END branch, coalesce(nullif(source_url, ''), 'https://' || lower(source) || '.example/' || lower(document_id)) url FROM documents_v2 WHERE length(coalesce(full_text, '')) >= 50")
def import_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an import under the corpus's own fields: a title made of what there is, a branch, an address; short texts stay out."""
    full = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    made = F.nullif(F.concat_ws(" ", full("court"), full("chamber"), full("karar_no")), F.lit(""))
    branch = F.when(F.col("chamber").ilike("%hukuk%"), "civil").when(F.col("chamber").ilike("%ceza%"), "criminal").otherwise("other")
    url = F.coalesce(F.nullif("source_url", F.lit("")), F.concat(F.lit("https://"), F.lower("source"), F.lit(".example/"), F.lower("document_id")))
    return _dv2(spark, d).filter(F.length(F.coalesce("full_text", F.lit(""))) >= 50).select("row_id", F.coalesce(full("title"), made).alias("title"), branch.alias("branch"), url.alias("url"))


@query(f"WITH {REC} SELECT document_id, source, row_id FROM rec WHERE retrieved_at >= TIMESTAMP '2024-01-01' AND NOT EXISTS (SELECT 1 FROM dedup_members m WHERE m.document_id = rec.document_id AND m.source = rec.source)")
def delta_export(spark: SparkSession, d: str) -> DataFrame:
    """The records fetched since a day that another store does not hold: what is handed over for a merge."""
    new = _records(spark, d).filter(F.col("retrieved_at") >= F.lit("2024-01-01").cast("timestamp"))
    return new.join(table(spark, d, "dedup_members"), ["document_id", "source"], "left_anti").select("document_id", "source", "row_id")


@query(f"SELECT row_id FROM documents_v2 WHERE last_accessed_at IS NULL OR last_accessed_at >= DATE '{AS_OF}' - INTERVAL 365 DAY")
def pruned(spark: SparkSession, d: str) -> DataFrame:
    """What a clean-up of entries that nobody asked for within a year leaves; entries without a time stay."""
    return maintenance.prune(_dv2(spark, d), "last_accessed_at", AS_OF, 365).select("row_id")


@query(f"SELECT source, count(*) FILTER (retrieved_at >= DATE '{AS_OF}' - INTERVAL 2 YEAR) n_recent, count(*) FILTER (retrieved_at >= DATE '{AS_OF}' - INTERVAL 90 DAY) n_quarter FROM documents_v2 GROUP BY 1")
def recent_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records of the last two years and ninety days before a stated day."""
    day = F.lit(AS_OF).cast("date")
    t = F.col("retrieved_at").cast("timestamp")
    return _dv2(spark, d).groupBy("source").agg(F.count_if(t >= F.add_months(day, -24).cast("timestamp")).alias("n_recent"), F.count_if(t >= F.date_sub(day, 90).cast("timestamp")).alias("n_quarter"))


@query("SELECT source, content_status, count(*) n, count(*) FILTER (source_url ILIKE '%.pdf') n_pdf_address FROM documents_v2 WHERE content_status = 'pdf_link_only' OR source_url ILIKE '%.pdf' GROUP BY 1, 2")
def pdf_status(spark: SparkSession, d: str) -> DataFrame:
    pdf = F.col("source_url").ilike("%.pdf")
    return _dv2(spark, d).filter((F.col("content_status") == "pdf_link_only") | pdf).groupBy("source", "content_status").agg(F.count("*").alias("n"), F.count_if(pdf).alias("n_pdf_address"))


@query("SELECT chamber, count(*) n, min(retrieved_at)::VARCHAR AS first, max(retrieved_at)::VARCHAR AS last, round(date_diff('day', min(retrieved_at)::DATE, max(retrieved_at)::DATE) / 365.25, 1) span_years FROM documents_v2 WHERE chamber IS NOT NULL GROUP BY 1")
def chamber_span(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("retrieved_at").cast("timestamp")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return _dv2(spark, d).filter("chamber is not null").groupBy("chamber").agg(F.count("*").alias("n"), text(F.min(t)).alias("first"), text(F.max(t)).alias("last"), F.round(F.date_diff(F.max(t), F.min(t)) / 365.25, 1).alias("span_years"))


_WORDS3 = "SELECT chamber, unnest(regexp_extract_all(lower(translate(coalesce(full_text, ''), 'İI', 'iı')), '[a-zçğıöşüâîû]{3,}')) w FROM documents_v2 WHERE chamber IS NOT NULL"


@query(f"SELECT chamber, w, n, rank FROM (SELECT chamber, w, count(*) n, row_number() OVER (PARTITION BY chamber ORDER BY count(*) DESC, w) rank FROM ({_WORDS3}) WHERE w NOT IN ('olarak', 'için', 'ile', 'ise', 'olan', 'gibi', 'daha') GROUP BY 1, 2) WHERE rank <= 20")
def chamber_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The twenty most frequent words of letters of each chamber's texts, of three letters at least, without stop words."""
    words = _dv2(spark, d).filter("chamber is not null").select("chamber", F.explode(F.regexp_extract_all(lower_tr(F.coalesce("full_text", F.lit(""))), F.lit("[a-zçğıöşüâîû]{3,}"), F.lit(0))).alias("w"))
    n = words.filter(~F.col("w").isin("olarak", "için", "ile", "ise", "olan", "gibi", "daha")).groupBy("chamber", "w").agg(F.count("*").alias("n"))
    w = Window.partitionBy("chamber").orderBy(F.col("n").desc(), "w")
    return n.withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 20").select("chamber", "w", "n", "rank")


# -- personal data by pattern ------------------------------------------------------------

_FIND = {"id": (r"\b[1-9]\d{10}\b", "high"), "phone": (r"\b0[5-7]\d{2}[-\s]?\d{3}[-\s]?\d{2}[-\s]?\d{2}\b", "medium"), "email": (r"\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+\b", "high")}


@query("SELECT row_id, kind, value, confidence, count(*) n, position(value IN any_value(full_text)) - 1 first_pos FROM (" + " UNION ALL ".join(f"SELECT row_id, full_text, '{k}' kind, '{c}' confidence, unnest(regexp_extract_all(full_text, '{p}')) AS value FROM documents_v2" for k, (p, c) in _FIND.items()) + ") GROUP BY 1, 2, 3, 4")
def pii_findings(spark: SparkSession, d: str) -> DataFrame:
    """Every value found by pattern with how sure it is, how often it stands in the text and where first."""
    return quality.findings(_dv2(spark, d), "row_id", "full_text", _FIND)


@query(f"SELECT source, count(*) n_texts, sum(n)::BIGINT n_findings, count(*) FILTER (n > 3) n_high, count(*) FILTER (n BETWEEN 1 AND 3) n_medium FROM (SELECT source, " + " + ".join(f"len(regexp_extract_all(coalesce(full_text, ''), '{p}'))" for p, _ in _FIND.values()) + " n FROM documents_v2) GROUP BY 1")
def pii_audit(spark: SparkSession, d: str) -> DataFrame:
    """The findings of a whole corpus by source and risk."""
    x = quality.pii_counts(_dv2(spark, d), "full_text", {k: p for k, (p, _) in _FIND.items()})
    n = sum((F.col(k) for k in list(_FIND)[1:]), F.col(next(iter(_FIND))))
    return x.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum(n).cast("long").alias("n_findings"), F.count_if(F.col("risk") == "high").alias("n_high"), F.count_if(F.col("risk") == "medium").alias("n_medium"))


# -- vectors, coverage, freshness --------------------------------------------------------


@query("SELECT document_id, source, provider_id, chunk_index, dim, indexed_at::VARCHAR AS indexed FROM embedding_vectors QUALIFY row_number() OVER (PARTITION BY document_id, source, provider_id, chunk_index ORDER BY indexed_at DESC NULLS LAST, content_hash DESC) = 1")
def latest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Of a chunk that was stored several times the latest vector."""
    x = legislation.latest_of(table(spark, d, "embedding_vectors").drop("vector"), ["document_id", "source", "provider_id", "chunk_index"], "indexed_at", "content_hash")
    return x.select("document_id", "source", "provider_id", "chunk_index", "dim", F.date_format(F.col("indexed_at").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("indexed"))


@query(
    f"WITH {REC}, e AS (SELECT DISTINCT document_id, source, content_hash h FROM embedding_vectors), r AS (SELECT document_id, source, content_hash FROM rec WHERE length({STRIPPED}) BETWEEN 50 AND 2000000) SELECT count(*) n_eligible, count(*) FILTER (has) n_covered, count(*) FILTER (has AND NOT fresh) n_stale, round(count(*) FILTER (has) / greatest(1, count(*)), 6) coverage FROM (SELECT EXISTS (SELECT 1 FROM e WHERE e.document_id = r.document_id AND e.source = r.source) has, EXISTS (SELECT 1 FROM e WHERE e.document_id = r.document_id AND e.source = r.source AND e.h IS NOT DISTINCT FROM r.content_hash) fresh FROM r)"
)
def vector_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Of the records that should have vectors how many have, and how many of these were made of another text."""
    r = _records(spark, d).filter(F.length(strip(effective_text())).between(50, 2_000_000)).select("document_id", "source", "content_hash")
    e = table(spark, d, "embedding_vectors").groupBy("document_id", "source").agg(F.collect_set(F.coalesce("content_hash", F.lit(""))).alias("hs"))
    j = r.join(e, ["document_id", "source"], "left")
    has, fresh = F.col("hs").isNotNull(), F.array_contains("hs", F.coalesce("content_hash", F.lit("")))
    return j.agg(F.count("*").alias("n_eligible"), F.count_if(has).alias("n_covered"), F.count_if(has & ~fresh).alias("n_stale"), F.round(F.count_if(has) / F.greatest(F.lit(1), F.count("*")), 6).alias("coverage"))


@query(f"SELECT vec_id, round({_COS}, 6) score FROM embeddings WHERE {_COS} > 0 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def dense_two_phase(spark: SparkSession, d: str) -> DataFrame:
    """A shortlist by vectors of eight bits a number, then the exact cosine of those on it."""
    return vectors.two_phase(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 10).select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT count(*) n_table, max(doc_id) last_key, true fresh FROM documents")
def index_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Whether the index holds what the table holds: count and last key of both."""
    t = table(spark, d, "documents").agg(F.count("*").alias("n_table"), F.max("doc_id").alias("last_key"))
    i = index(spark, d).documents().agg(F.count("*").alias("n"), F.max("key").alias("k"))
    return t.join(F.broadcast(i)).select("n_table", "last_key", ((F.col("n_table") == F.col("n")) & F.col("last_key").eqNullSafe(F.col("k"))).alias("fresh"))


@query(f"WITH post AS (SELECT DISTINCT doc_id, unnest({TOK}) term FROM documents) SELECT term, round(ln((SELECT count(DISTINCT doc_id) FROM post) / count(*)), 6) idf FROM post GROUP BY 1")
def idf_from_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The frequencies read back from stored weights, as weight over share of the document: for an index whose table of them is lost."""
    ix = index(spark, d)
    return ix.weights().groupBy("term").agg(F.round(F.max(F.col("w") * F.col("dl") / F.col("tf")), 6).alias("idf"))


# -- sources and candidates --------------------------------------------------------------


@query("WITH x AS (SELECT user_id, event_type = 'error' bad, event_id, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) island FROM events), r AS (SELECT user_id, island, count(*) FILTER (bad) run FROM x GROUP BY 1, 2) SELECT user_id, count(*) n, count(*) FILTER (bad) n_failed, round(count(*) FILTER (bad) / count(*), 6) failure_rate, (SELECT max(run) FROM r WHERE r.user_id = x.user_id) longest_run FROM x GROUP BY 1")
def source_health(spark: SparkSession, d: str) -> DataFrame:
    """Per key the calls, the failures and the longest run of them."""
    return maintenance.health(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")


COURTS = ["Yargıtay", "Danıştay", "Anayasa Mahkemesi", "Bölge Adliye Mahkemesi", "Bölge İdare Mahkemesi", "Sayıştay", "Uyuşmazlık Mahkemesi"]


@query("SELECT row_id, bucket FROM documents_v2 d JOIN (SELECT unnest([" + ", ".join(f"'{c}'" for c in COURTS) + "]) bucket) b ON contains(lower(translate(coalesce(court, ''), 'İI', 'iı')), lower(translate(bucket, 'İI', 'iı'))) OR contains(lower(translate(coalesce(title, ''), 'İI', 'iı')), lower(translate(bucket, 'İI', 'iı')))")
def court_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Records under every court whose name their court or title contains; the names are a handful, so a row is spread over them without a join."""
    name = lambda c: lower_tr(F.coalesce(F.col(c), F.lit("")))
    hit = F.array_compact(F.array(*[F.when(name("court").contains(low) | name("title").contains(low), F.lit(c)) for c in COURTS for low in [c.replace("İ", "i").replace("I", "ı").lower()]]))
    return _dv2(spark, d).select("row_id", F.explode(hit).alias("bucket"))


@query("SELECT row_id, document_id FROM documents_v2 WHERE esas_no ILIKE '%2012/%' OR karar_no ILIKE '%2012/%' OR court ILIKE '%2012/%' ORDER BY row_id LIMIT 20")
def candidates_by_text(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty records with a piece of text in a number or the court: the slow look-up that the joins replace."""
    hit = reduce(lambda a, b: a | b, [F.col(c).ilike("%2012/%") for c in ("esas_no", "karar_no", "court")])
    return _dv2(spark, d).filter(hit).orderBy("row_id").limit(20).select("row_id", "document_id")


@query("WITH r AS (SELECT source, document_id, row_id, content_status, row_number() OVER (PARTITION BY source ORDER BY retrieved_at DESC NULLS LAST, row_id) k FROM documents_v2 WHERE title ILIKE '%hukuk%') SELECT source, document_id, row_id, content_status FROM r WHERE k <= 3")
def research_topic(spark: SparkSession, d: str) -> DataFrame:
    """A search in every source at once, the first three results of each."""
    w = Window.partitionBy("source").orderBy(F.col("retrieved_at").desc_nulls_last(), "row_id")
    r = _dv2(spark, d).filter(F.col("title").ilike("%hukuk%")).select("source", "document_id", "row_id", "content_status", F.row_number().over(w).alias("k"))
    return r.filter("k <= 3").drop("k")


@query(f"WITH {REC} SELECT document_id, source FROM rec WHERE content_status = 'pdf_link_only' AND lower(coalesce(source_url, '')) LIKE '%.pdf%' UNION ALL SELECT document_id, source FROM rec WHERE content_status = 'pdf_link_only' AND coalesce(source_url, '') <> '' AND lower(source_url) NOT LIKE '%.pdf%'")
def pdf_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The records whose text could be had from the file they link to."""
    return _records(spark, d).filter((F.col("content_status") == "pdf_link_only") & ~is_blank("source_url")).select("document_id", "source")


@query("SELECT document_id, source, max(created_at)::VARCHAR AS registered FROM documents_v2 WHERE created_at >= TIMESTAMP '2025-01-01' GROUP BY 1, 2 HAVING count(*) >= 1")
def recently_registered(spark: SparkSession, d: str) -> DataFrame:
    """Records registered again since a day."""
    x = _dv2(spark, d).filter(F.col("created_at") >= F.lit("2025-01-01").cast("timestamp"))
    return x.groupBy("document_id", "source").agg(F.date_format(F.max(F.col("created_at").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("registered"))


@query("SELECT document_id, source, max(coalesce(access_count, 0)) + (SELECT count(*) FROM citation_edges e WHERE e.cited_doc_id = d.document_id AND e.cited_source = d.source) n_access FROM documents_v2 d GROUP BY 1, 2")
def access_counts(spark: SparkSession, d: str) -> DataFrame:
    """Look-ups counted apart and added up: every citation of a record stands for one."""
    seen = table(spark, d, "citation_edges").groupBy(F.col("cited_doc_id").alias("document_id"), F.col("cited_source").alias("source")).agg(F.count("*").alias("k"))
    own = _dv2(spark, d).groupBy("document_id", "source").agg(F.max(F.coalesce("access_count", F.lit(0))).alias("n"))
    return own.join(seen, ["document_id", "source"], "left").select("document_id", "source", (F.col("n") + F.coalesce("k", F.lit(0))).alias("n_access"))
