"""Search, ranking, vector and evaluation queries, with the SQL that checks them."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from derlem.functions.text import jaccard, lower_tr, snippet, tokens
from derlem.operators import search, vectors
from derlem.operators.index import Index, index_of
from derlem.plans.queries import BooleanQuery, parse_match
from derlem.plans.understanding import expand
from derlem.session import cut, shared_folder, spread, table
from derlem.sources.store import Store

TERMS = ["kira", "bedeli", "sözleşme"]
ANY = ["tapu", "kira", "tahliye"]
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


TOK = r"list_transform(regexp_extract_all(coalesce(text,''), '[\p{L}\p{N}_]+'), lambda x: lower(translate(x,'İI','iı')))"
POST = f"post AS (SELECT doc_id, term, count(*) tf FROM (SELECT doc_id, unnest({TOK}) term FROM documents) GROUP BY 1, 2)"


def _bm25_sql(terms: list[str], mode: str, name: str = "bm") -> str:
    fs = ", ".join(f"len(list_filter(t, lambda x: x = '{t}')) f{i}" for i, t in enumerate(terms))
    st = ", ".join(f"count(*) FILTER (f{i} > 0) n{i}" for i in range(len(terms)))
    score = " + ".join(f"(CASE WHEN ln((N - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((N - n{i} + 0.5) / (n{i} + 0.5)) END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    hit = f" {mode} ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"{name}_t AS (SELECT doc_id, len(t) dl, {fs} FROM (SELECT doc_id, {TOK} t FROM documents)), {name}_s AS (SELECT count(*) N, avg(dl) avgdl, {st} FROM {name}_t), {name} AS (SELECT doc_id, -({score}) score FROM {name}_t, {name}_s WHERE {hit})"


def _tfidf_sql(terms: list[str], name: str = "ti") -> str:
    qs = " UNION ALL ".join(f"SELECT '{t}' term, {terms.count(t) / len(terms)!r}::DOUBLE qtf" for t in dict.fromkeys(terms))
    return (
        f"{POST}, idf AS (SELECT term, count(*) df, ln((SELECT count(DISTINCT doc_id) FROM post) / count(*)) idf FROM post GROUP BY 1), "
        "tot AS (SELECT doc_id, sum(tf) total FROM post GROUP BY 1), w AS (SELECT p.doc_id, p.term, tf / total * idf w FROM post p JOIN tot USING (doc_id) JOIN idf USING (term)), "
        "nrm AS (SELECT doc_id, sqrt(sum(w * w)) norm, count(*) n_terms FROM w GROUP BY 1), "
        f"q AS (SELECT a.term, qtf * coalesce(idf, 1.0) q FROM ({qs}) a LEFT JOIN idf USING (term)), "
        f"{name} AS (SELECT * FROM (SELECT doc_id, sum(w * q) / any_value(norm) / (SELECT sqrt(sum(q * q)) FROM q) score FROM w JOIN q USING (term) JOIN nrm USING (doc_id) GROUP BY doc_id) WHERE score > 0)"
    )


def _top_sql(name: str, k: int, order: str = "DESC") -> str:
    return f"SELECT doc_id, round(score, 6) score, row_number() OVER (ORDER BY score {order}, doc_id) rank FROM {name} ORDER BY score {order}, doc_id LIMIT {k}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def index(spark: SparkSession, d: str) -> Index:
    """The stored index over documents.text."""
    return index_of(spark, f"{d}/documents.parquet", "doc_id", "text", _docs(spark, d))


def _bm25(spark: SparkSession, d: str, terms: list[str] = TERMS, mode: str = "and") -> DataFrame:
    return index(spark, d).bm25(terms, mode=mode).withColumnRenamed("key", "doc_id")


def _cosine(spark: SparkSession, d: str, terms: list[str]) -> DataFrame:
    return index(spark, d).cosine(terms).withColumnRenamed("key", "doc_id")


@query(f"WITH {_bm25_sql(TERMS, 'OR')}, best AS ({_top_sql('bm', 10, 'ASC')}) SELECT b.doc_id, b.score, b.rank, d.lang, d.source FROM best b JOIN documents d USING (doc_id)")
def bm25_top10(spark: SparkSession, d: str) -> DataFrame:
    """Ranked on narrow columns; the winners' metadata is joined last."""
    best = _rounded(search.top(_bm25(spark, d, mode="or"), "doc_id", 10, ascending=True))
    return table(spark, d, "documents").select("doc_id", "lang", "source").join(F.broadcast(best), "doc_id")


@query(f"WITH {_bm25_sql(ANY[:2], 'AND')} SELECT doc_id, round(score, 6) score FROM bm")
def bm25_and(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, ANY[:2]).select("doc_id", F.round("score", 6).alias("score"))


def _two_stage_sql(limit: int) -> str:
    return f"WITH {_bm25_sql(TERMS, 'AND', 'a')}, {_bm25_sql(expand(TERMS), 'OR', 'o')} SELECT doc_id, round(score, 6) score, true all_terms FROM a UNION ALL SELECT doc_id, round(score, 6), false FROM o WHERE (SELECT count(*) FROM a) < {limit} AND doc_id NOT IN (SELECT doc_id FROM a)"


@query(_two_stage_sql(200))
def two_stage_recall(spark: SparkSession, d: str) -> DataFrame:
    """Documents with every term; where they are fewer than 200, also those with some of the terms or their stems."""
    t = search.two_stage(_bm25(spark, d), _bm25(spark, d, expand(TERMS), "or"), "doc_id", 200)
    return t.select("doc_id", F.round("score", 6).alias("score"), "all_terms")


@query(_two_stage_sql(3))
def two_stage_enough(spark: SparkSession, d: str) -> DataFrame:
    """The same where three are enough: the second stage adds nothing."""
    t = search.two_stage(_bm25(spark, d), _bm25(spark, d, expand(TERMS), "or"), "doc_id", 3)
    return t.select("doc_id", F.round("score", 6).alias("score"), "all_terms")


@query(f"WITH {_tfidf_sql(ANY)} {_top_sql('ti', 10)}")
def tfidf_cosine_top10(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.top(_cosine(spark, d, ANY), "doc_id", 10))


_HYBRID = "hy AS (SELECT doc_id, 0.6 * coalesce({n}, 0) + 0.4 * coalesce(t.score, 0) score FROM bm b FULL JOIN ti t USING (doc_id))"


@query(f"WITH {_bm25_sql(ANY, 'OR')}, {_tfidf_sql(ANY)}, {_HYBRID.format(n='1 / (1 + abs(b.score))')} SELECT doc_id, round(score, 6) score FROM hy")
def hybrid_scores(spark: SparkSession, d: str) -> DataFrame:
    """Linear fusion with the norm that falls as matches get stronger."""
    h = search.hybrid(_bm25(spark, d, ANY, "or"), _cosine(spark, d, ANY), "doc_id")
    return h.select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql(ANY, 'OR')}, {_tfidf_sql(ANY)}, {_HYBRID.format(n='abs(b.score) / (1 + abs(b.score))')} {_top_sql('hy', 10)}")
def hybrid_monotone_top10(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.top(search.hybrid(_bm25(spark, d, ANY, "or"), _cosine(spark, d, ANY), "doc_id", norm="monotone"), "doc_id", 10))


@query(
    f"WITH {_bm25_sql(ANY, 'OR')}, {_tfidf_sql(ANY)}, r AS (SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) rank FROM bm QUALIFY rank <= 20 UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) rank FROM ti QUALIFY rank <= 20), "
    f"f AS (SELECT doc_id, sum(1.0 / (60 + rank)) score FROM r GROUP BY 1) {_top_sql('f', 10)}"
)
def rrf_top10(spark: SparkSession, d: str) -> DataFrame:
    lex = search.top(_bm25(spark, d, ANY, "or"), "doc_id", 20, ascending=True)
    sem = search.top(_cosine(spark, d, ANY), "doc_id", 20)
    return _rounded(search.top(search.rrf([lex, sem], "doc_id"), "doc_id", 10))


@query(f"WITH {POST} SELECT term, count(*) df, round(ln((SELECT count(DISTINCT doc_id) FROM post) / count(*)), 6) idf FROM post GROUP BY 1")
def idf_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The frozen frequencies of the index."""
    return index(spark, d).idf().select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_tfidf_sql(ANY)} SELECT doc_id, round(norm, 6) norm, n_terms FROM nrm")
def tf_vector_norms(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).documents().filter("norm is not null").select(F.col("key").alias("doc_id"), F.round("norm", 6).alias("norm"), "n_terms")


_SIZES = f"{POST}, l AS (SELECT doc_id, len({TOK}) dl FROM documents) SELECT (SELECT count(*) FROM l)::BIGINT n_docs, (SELECT sum(dl) FROM l)::BIGINT tokens, (SELECT count(*) FROM post)::BIGINT n_postings, (SELECT count(DISTINCT term) FROM post)::BIGINT n_terms"


def _sizes(ix: Index) -> DataFrame:
    d = ix.documents().agg(F.count("*").alias("n_docs"), F.sum("dl").cast("long").alias("tokens"))
    t = ix.vocabulary("").agg(F.sum("df").cast("long").alias("n_postings"), F.count("*").alias("n_terms"))
    return d.join(F.broadcast(t))


@query(f"WITH {_SIZES}")
def index_build(spark: SparkSession, d: str) -> DataFrame:
    """A whole index built beside the one that queries use, and what it holds."""
    ix = Index(spark, f"{shared_folder(spark)}/index-build-{uuid.uuid4().hex}").build(_docs(spark, d), "doc_id", "text")
    got = cut(_sizes(ix))
    ix.store.delete()
    return got


@query(f"WITH {_SIZES}")
def index_update(spark: SparkSession, d: str) -> DataFrame:
    """An index built on the documents fetched before 2025 and brought up to date with all: only the missing ones are read again, under frozen frequencies."""
    docs = _docs(spark, d)
    ix = Index(spark, f"{shared_folder(spark)}/index-update-{uuid.uuid4().hex}").build(docs.filter(F.col("fetched_at") < F.lit("2025-01-01").cast("timestamp")), "doc_id", "text")
    got = cut(_sizes(ix.append(docs, "doc_id", "text")))
    ix.store.delete()
    return got


@query("SELECT count(*) n_table, count(*) n_index, 0::BIGINT n_missing, 0::BIGINT n_orphans, 1.0::DOUBLE coverage FROM documents")
def index_status(spark: SparkSession, d: str) -> DataFrame:
    """The index beside the table it was made of."""
    return index(spark, d).status(table(spark, d, "documents"), "doc_id")


@query(f"WITH {POST} SELECT term, count(*) df FROM post WHERE starts_with(term, 'kamu') GROUP BY 1")
def index_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).vocabulary("kamu")


def _fts(spark: SparkSession, d: str, q: str, **how) -> DataFrame:
    m = parse_match(q, **how)
    keys = index(spark, d).match(m.terms, m.phrases, prefix=m.prefix).withColumnRenamed("key", "doc_id")
    return table(spark, d, "documents").select("doc_id", "lang", "source").join(keys, "doc_id", "left_semi")


@query(f"SELECT doc_id, lang, source FROM documents WHERE list_contains({TOK}, 'tapu') AND list_contains({TOK}, 'kira')")
def fts_and_match(spark: SparkSession, d: str) -> DataFrame:
    return _fts(spark, d, "Tapu OR kira", reserved=("OR", "AND", "NOT"))


@query(f"SELECT doc_id, lang, source FROM documents WHERE list_contains({TOK}, 'tazmin') AND contains(' ' || array_to_string({TOK}, ' ') || ' ', ' hükme esas ')")
def fts_phrase_match(spark: SparkSession, d: str) -> DataFrame:
    return _fts(spark, d, '"hükme esas" tazmin')


@query(f"SELECT doc_id, lang, source FROM documents WHERE len(list_filter({TOK}, lambda x: starts_with(x, 'kamulaş'))) > 0 AND len(list_filter({TOK}, lambda x: starts_with(x, 'bede'))) > 0")
def fts_prefix_match(spark: SparkSession, d: str) -> DataFrame:
    return _fts(spark, d, "kamulaş bede", prefix=True)


_LOW = "lower(translate(coalesce(text,''),'İI','iı'))"


@query(f"SELECT doc_id FROM documents WHERE (len(list_filter({TOK}, lambda x: starts_with(x, 'tapu'))) > 0 OR contains({_LOW}, 'kira bedeli')) AND NOT len(list_filter({TOK}, lambda x: starts_with(x, 'temyiz'))) > 0")
def boolean_query_match(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter(BooleanQuery('(tapu OR "kira bedeli") NOT temyiz').column("text")).select("doc_id")


@query("SELECT document_id, source, court, chamber FROM documents_v2 WHERE source = 'yargitay' AND court ILIKE '%yargıtay%' AND chamber ILIKE '%hukuk%' AND content_status = 'full_text' AND quote_usable = 1")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents_v2")
    where = {"source": "yargitay", "court": "yargıtay", "chamber": "hukuk", "content_status": "full_text", "quote_usable": 1}
    return docs.filter(search.predicate(where, exact=("source", "document_id", "content_status"))).select("document_id", "source", "court", "chamber")


@query("SELECT row_id, document_id FROM documents_v2 WHERE title ILIKE '%ceza dairesi%' OR full_text ILIKE '%kira bedelini%' OR markdown ILIKE '%kira bedelini%'")
def like_fallback(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents_v2")
    return docs.filter(F.col("title").ilike("%ceza dairesi%") | F.col("full_text").ilike("%kira bedelini%") | F.col("markdown").ilike("%kira bedelini%")).select("row_id", "document_id")


@query("SELECT row_id, item_id, baslik FROM rg_ogeler WHERE contains(lower(concat_ws(' ', baslik_fold, numara, kategori, bolum)), 'belediyesi') AND contains(lower(concat_ws(' ', baslik_fold, numara, kategori, bolum)), 'teblig')")
def gazette_all_terms(spark: SparkSession, d: str) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "baslik_fold", "numara", "kategori", "bolum"))
    return table(spark, d, "rg_ogeler").filter(hay.contains("belediyesi") & hay.contains("teblig")).select("row_id", "item_id", "baslik")


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY fetched_at DESC NULLS LAST, doc_id LIMIT 25 OFFSET 50")
def paged_listing(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).orderBy(F.col("fetched_at").desc_nulls_last(), "doc_id").offset(50).limit(25).select("doc_id", "source", "n_chars")


_SNIP = "instr(lower(translate(coalesce(text,''),'İI','iı')), 'kira bedel')"


@query(
    f"SELECT doc_id, CASE WHEN greatest(1, a - 53) > 1 THEN '…' ELSE '' END || substr(text, greatest(1, a - 53), 160) || CASE WHEN length(text) >= greatest(1, a - 53) + 160 THEN '…' ELSE '' END snip FROM (SELECT doc_id, text, {_SNIP} a FROM documents) WHERE a > 0"
)
def snippets(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", snippet("text", "kira bedel").alias("snip")).filter("snip is not null")


def _query_vector(spark: SparkSession, d: str, key: int = 7) -> DataFrame:
    """The vector with the smallest id from ``key`` on."""
    return table(spark, d, "embeddings").filter(F.col("vec_id") >= key).orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))


_QV = "(SELECT embedding FROM embeddings WHERE vec_id >= 7 ORDER BY vec_id LIMIT 1)"
_COS = f"list_cosine_similarity(embedding::DOUBLE[], {_QV}::DOUBLE[])"


@query(f"SELECT vec_id, label, round({_COS}, 6) score FROM embeddings WHERE {_COS} > 0 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def dense_cosine_top10(spark: SparkSession, d: str) -> DataFrame:
    s = vectors.exact(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d))
    return s.orderBy(F.col("score").desc(), "vec_id").limit(10).select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"SELECT label, vec_id, round(score, 6) score FROM (SELECT label, vec_id, {_COS} score, row_number() OVER (PARTITION BY label ORDER BY {_COS} DESC, vec_id) r FROM embeddings WHERE {_COS} > 0) WHERE r = 1")
def dense_best_per_label(spark: SparkSession, d: str) -> DataFrame:
    s = vectors.exact(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d))
    return vectors.best_per(s, "label", "vec_id").select("label", "vec_id", F.round("score", 6).alias("score"))


@query(
    "SELECT document_id, source, chunk_index, round(score, 6) score FROM (SELECT *, row_number() OVER (PARTITION BY document_id, source ORDER BY score DESC, chunk_index) r FROM (SELECT document_id, source, chunk_index, list_cosine_similarity(vector::DOUBLE[], [1,0,0,0,1,0,0,0]::DOUBLE[]) score FROM embedding_vectors WHERE len(vector) = 8)) WHERE r = 1"
)
def best_chunk_per_document(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0)])
    s = table(spark, d, "embedding_vectors").filter(F.size("vector") == 8).select("document_id", "source", "chunk_index", vectors.cosine(F.col("vector"), q).alias("score"))
    w = Window.partitionBy("document_id", "source").orderBy(F.col("score").desc(), "chunk_index")
    return s.withColumn("r", F.row_number().over(w)).filter("r = 1").select("document_id", "source", "chunk_index", F.round("score", 6).alias("score"))


def _ann(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(found, true) neighbours of every vector whose id is divisible by 50, among all vectors."""
    emb = table(spark, d, "embeddings")
    qs = emb.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    path = f"{d}/embeddings.parquet"
    root = f"{shared_folder(spark)}/ann-{hashlib.sha256(repr((path, Store(spark, path).mark())).encode()).hexdigest()[:24]}"
    ix = vectors.InvertedFile(spark, root)
    n = emb.count()
    if not hasattr(ix, "books"):
        ix = vectors.InvertedFile.build(emb, "vec_id", "embedding", root, cells=max(4, int(n**0.5) // 2))
    # the vectors of this table have no clusters to speak of: all cells are probed, by their codes, and one vector in twenty is read
    near = ix.search(qs, emb, "vec_id", "embedding", 10, probe=len(ix.centres), refine=max(100, n // 20))
    return near, vectors.exact_top(qs, emb, "vec_id", "embedding", 10)


@query()
def ann_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean recall at 10 over all queries, the share of queries at 0.5 and more, and whether the mean passes 0.9."""
    near, true = _ann(spark, d)
    hit = near.select("qid", "key").withColumn("hit", F.lit(1))
    per = true.join(hit, ["qid", "key"], "left").groupBy("qid").agg((F.count("hit") / F.count("*")).alias("r"))
    return per.agg(F.count("*").alias("n_queries"), F.round(F.avg("r"), 4).alias("mean_recall"), F.round(F.min("r"), 4).alias("least"), F.round(F.avg(F.when(F.col("r") >= 0.5, 1.0).otherwise(0.0)), 4).alias("pass_rate")).withColumn("passes", F.col("mean_recall") >= 0.9)


@query()
def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the inverted file at 10 for every vector whose id is divisible by 50, against all vectors."""
    near, true = _ann(spark, d)
    hit = near.select("qid", "key").withColumn("hit", F.lit(1))
    return true.join(hit, ["qid", "key"], "left").groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall_at_10"))


@query("WITH q AS (SELECT vec_id qid, embedding::DOUBLE[] q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT qid, vec_id \"key\", list_cosine_similarity(embedding::DOUBLE[], q) score FROM q, embeddings) SELECT qid, \"key\", round(score, 6) score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, \"key\") rank FROM s QUALIFY rank <= 10")
def dense_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50, exactly, in blocks."""
    emb = table(spark, d, "embeddings")
    qs = emb.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return vectors.exact_top(qs, emb, "vec_id", "embedding", 10).select("qid", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH a AS (SELECT vec_id, {_COS} score FROM embeddings WHERE label < 5), b AS (SELECT vec_id, 0.5 * {_COS} score FROM embeddings WHERE label >= 3) SELECT vec_id, round(max(score), 6) score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE score > 0 GROUP BY 1")
def bulk_and_delta(spark: SparkSession, d: str) -> DataFrame:
    """Two scored sets that share keys, the large one and what was added since: each key with its best score."""
    s = vectors.exact(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d))
    return vectors.merge_best([s.filter("label < 5"), s.filter("label >= 3").withColumn("score", F.col("score") * 0.5)], "vec_id").select("vec_id", F.round("score", 6).alias("score"))


_REL = f"list_contains({TOK}, 'kamulaştırma')"


@query(
    f"WITH {_bm25_sql(['kamulaştırma', 'bedelini'], 'OR')}, r AS ({_top_sql('bm', 20, 'ASC')}), j AS (SELECT r.rank, {_REL} AND len(list_filter({TOK}, lambda x: x = 'kamulaştırma')) >= 2 rel FROM r JOIN documents USING (doc_id)), t AS (SELECT count(*) n FROM documents WHERE len(list_filter({TOK}, lambda x: x = 'kamulaştırma')) >= 2) "
    "SELECT count(*) FILTER (rel) hits, round(count(*) FILTER (rel) / greatest(1, (SELECT n FROM t)), 6) recall, round(coalesce(sum(1 / log2(rank + 1)) FILTER (rel), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 1 + greatest(1, least(20, (SELECT n FROM t)))) x(i)), 6) ndcg FROM j"
)
def recall_ndcg(spark: SparkSession, d: str) -> DataFrame:
    """Recall and nDCG at 20 of a ranking; relevant is a document that names the first term twice."""
    docs = _docs(spark, d)
    gold = docs.select("doc_id", (F.size(F.filter(tokens("text"), lambda x: x == "kamulaştırma")) >= 2).alias("rel"))
    ranked = search.top(_bm25(spark, d, ["kamulaştırma", "bedelini"], "or"), "doc_id", 20, ascending=True)
    n = gold.agg(F.greatest(F.lit(1), F.count_if("rel")).alias("n"))
    got = gold.join(F.broadcast(ranked), "doc_id").agg(F.count_if("rel").alias("hits"), F.coalesce(F.sum(F.when(F.col("rel"), 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(20), F.col("n").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return got.join(n).select("hits", F.round(F.col("hits") / F.col("n"), 6).alias("recall"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"))


GOLDEN = {"q1": ["kamulaştırma", "bedelini"], "q2": ["kira", "tahliye"], "q3": ["ihbar", "süresini"], "q4": ["tapu", "devrini"]}
_EVAL = (
    "WITH " + ", ".join(_bm25_sql(ts, "OR", q) for q, ts in GOLDEN.items()) + ", "
    + "rk AS (" + " UNION ALL ".join(f"(SELECT '{q}' qid, doc_id, row_number() OVER (ORDER BY score, doc_id) rank FROM {q} QUALIFY rank <= 50)" for q in GOLDEN) + "), "
    + "gd AS (" + " UNION ALL ".join(f"SELECT '{q}' qid, doc_id FROM documents WHERE len(list_filter({TOK}, lambda x: x = '{ts[0]}')) >= 2" for q, ts in GOLDEN.items()) + "), "
    + "n AS (SELECT qid, count(*) n_relevant FROM gd GROUP BY 1), g AS (SELECT qid, count(*) hits, sum(1 / log2(rank + 1)) dcg FROM rk WHERE (qid, doc_id) IN (SELECT (qid, doc_id) FROM gd) GROUP BY 1), "
    + "ev AS (SELECT qid, n_relevant, coalesce(hits, 0) / n_relevant recall, coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 1 + least(50, n_relevant)) x(i)) ndcg FROM n LEFT JOIN g USING (qid)) "
)


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    """Rankings of the golden queries; relevant is a document that names a query's first word twice."""
    ix = index(spark, d)
    ranked = [search.top(ix.bm25(ts, mode="or"), "key", 50, ascending=True).select(F.lit(q).alias("qid"), "key", "rank") for q, ts in GOLDEN.items()]
    gold = [ix.postings([ts[0]]).filter("tf >= 2").select(F.lit(q).alias("qid"), "key") for q, ts in GOLDEN.items()]
    return search.evaluate(reduce(DataFrame.unionByName, ranked), reduce(DataFrame.unionByName, gold), "key", 50)


@query(_EVAL + "SELECT qid, n_relevant, round(recall, 6) recall, round(ndcg, 6) ndcg, recall >= 0.5 passed FROM ev")
def evaluation(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).select("qid", "n_relevant", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"), "passed")


@query(_EVAL + "SELECT count(*) n_queries, round(avg(recall), 6) mean_recall, round(avg(ndcg), 6) mean_ndcg, round(avg((recall >= 0.5)::INT), 6) pass_rate, avg(recall) >= 0.3 passes FROM ev")
def evaluation_gate(spark: SparkSession, d: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return search.gate(_evaluated(spark, d)).select("n_queries", r("mean_recall"), r("mean_ndcg"), r("pass_rate"), "passes")


STOP = ["ve", "ile", "bir", "bu", "için", "de", "da", "ise", "olarak", "olan", "the", "of", "la", "le", "et", "der", "die", "und"]
_STOP = ", ".join(f"'{w}'" for w in STOP)
_KW = f"SELECT lang, term, count(*) n FROM (SELECT lang, unnest({TOK}) term FROM documents) WHERE length(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY 1, 2"


def _keywords(spark: SparkSession, d: str) -> DataFrame:
    words = _docs(spark, d).select("lang", F.explode(tokens("text")).alias("term")).filter((F.length("term") >= 2) & ~F.col("term").isin(STOP))
    n = words.groupBy("lang", "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.col("n").desc(), "term")
    return n.withColumn("rank", F.row_number().over(w)).filter("rank <= 20")


@query(f"SELECT lang, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) rank FROM ({_KW})) WHERE rank <= 20")
def keyword_top20(spark: SparkSession, d: str) -> DataFrame:
    return _keywords(spark, d).select("lang", "term", "n", F.col("rank").cast("long").alias("rank"))


@query(
    f"WITH k AS (SELECT lang, list(term) ts FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) rank FROM ({_KW})) WHERE rank <= 20 GROUP BY 1) "
    "SELECT a.lang lang_a, b.lang lang_b, round(len(list_intersect(a.ts, b.ts)) / len(list_distinct(list_concat(a.ts, b.ts))), 4) similarity FROM k a JOIN k b ON a.lang < b.lang WHERE len(list_intersect(a.ts, b.ts)) > 0"
)
def profile_similarity_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Keyword profiles are one row per language: as many as there are languages."""
    k = _keywords(spark, d).groupBy("lang").agg(F.collect_set("term").alias("ts"))
    j = k.select(F.col("lang").alias("lang_a"), F.col("ts").alias("a")).join(k.select(F.col("lang").alias("lang_b"), F.col("ts").alias("b")), F.col("lang_a") < F.col("lang_b"))
    return j.select("lang_a", "lang_b", F.round(jaccard(F.col("a"), F.col("b")), 4).alias("similarity")).filter("similarity > 0")


def _facade_sql(scored: str, order: str, page: str, score: str = "round(score, 6)") -> str:
    return f"WITH {scored}, j AS (SELECT s.doc_id, s.score, d.lang, d.source, d.fetched_at FROM s JOIN documents d USING (doc_id) WHERE d.lang = 'tr' AND d.source ILIKE '%yargitay%') SELECT doc_id, {score} score, lang, source, (SELECT count(*) FROM j) total FROM j ORDER BY {order} {page}"


WHERE = {"lang": "tr", "source": "%yargitay%"}
_S = "s AS (SELECT doc_id, score FROM {})"


def search_documents(spark: SparkSession, d: str, text: str, mode: str = "lexical", *, where: dict | None = None, sort: str = "relevance", limit: int = 10, offset: int = 0) -> DataFrame:
    """(doc_id, score, lang, source, total): one page of a search over the corpus.

    ``mode``: lexical, semantic, hybrid or rrf; another one is an error. ``where`` is applied before the page is cut. An unknown
    ``sort`` sorts by relevance. ``total`` counts what fits on any page.
    """
    m = parse_match(text)
    terms = [*m.terms, *(w for p in m.phrases for w in p)]
    if not terms:
        raise ValueError("a search needs at least one term")
    ix = index(spark, d)
    key = lambda df: df.withColumnRenamed("key", "doc_id")
    if mode == "lexical":
        scored = key(ix.bm25(terms))
        if m.phrases:
            scored = scored.join(key(ix.match(m.terms, m.phrases)), "doc_id", "left_semi")
    elif mode == "semantic":
        scored = key(ix.cosine(terms))
    elif mode == "hybrid":
        scored = search.hybrid(key(ix.bm25(terms, mode="or")), key(ix.cosine(terms)), "doc_id", norm="monotone")
    elif mode == "rrf":
        fetch = 2 * (limit + offset)
        scored = search.rrf([search.top(key(ix.bm25(terms, mode="or")), "doc_id", fetch, ascending=True), search.top(key(ix.cosine(terms)), "doc_id", fetch)], "doc_id")
    else:
        raise ValueError(f"no such mode: {mode}")
    meta = table(spark, d, "documents").select("doc_id", "lang", "source", "fetched_at")
    found = scored.join(meta.filter(search.predicate(where or {}, exact=("lang", "doc_kind"))), "doc_id")
    return search.page(found, "doc_id", sort=sort, time="fetched_at", ascending=mode == "lexical", limit=limit, offset=offset).select("doc_id", F.round("score", 6).alias("score"), "lang", "source", "total")


@query(_facade_sql(f"{_bm25_sql(ANY[:2], 'AND')}, {_S.format('bm')}", "score, doc_id", "LIMIT 10"))
def search_lexical(spark: SparkSession, d: str) -> DataFrame:
    return search_documents(spark, d, "tapu kira", where=WHERE)


@query(_facade_sql(f"{_bm25_sql(ANY[:2], 'AND')}, {_S.format('bm')}", "fetched_at DESC NULLS LAST, doc_id", "LIMIT 5 OFFSET 5"))
def search_lexical_newest(spark: SparkSession, d: str) -> DataFrame:
    """The second page of five, latest fetched first."""
    return search_documents(spark, d, "tapu kira", where=WHERE, sort="fetched_at_desc", limit=5, offset=5)


@query(_facade_sql(f"{_tfidf_sql(ANY)}, {_S.format('ti')}", "score DESC, doc_id", "LIMIT 10"))
def search_semantic(spark: SparkSession, d: str) -> DataFrame:
    return search_documents(spark, d, " ".join(ANY), "semantic", where=WHERE)


@query(_facade_sql(f"{_bm25_sql(ANY, 'OR')}, {_tfidf_sql(ANY)}, {_HYBRID.format(n='abs(b.score) / (1 + abs(b.score))')}, {_S.format('hy')}", "score DESC, doc_id", "LIMIT 10"))
def search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return search_documents(spark, d, " ".join(ANY), "hybrid", where=WHERE)


@query(
    _facade_sql(
        f"{_bm25_sql(ANY, 'OR')}, {_tfidf_sql(ANY)}, r AS (SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) rank FROM bm QUALIFY rank <= 40 UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) rank FROM ti QUALIFY rank <= 40), f AS (SELECT doc_id, sum(1.0 / (60 + rank)) score FROM r GROUP BY 1), {_S.format('f')}",
        "score DESC, doc_id", "LIMIT 20",
    )
)
def search_rrf(spark: SparkSession, d: str) -> DataFrame:
    return search_documents(spark, d, " ".join(ANY), "rrf", where=WHERE, limit=20)
