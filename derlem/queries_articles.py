"""Articles and legislation: search, lookup, amendments, structure, gazette and upkeep, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from derlem.functions.keys import fold_key, is_blank, strip
from derlem.functions.text import lower_tr
from derlem.operators import documents, legislation, maintenance, search
from derlem.operators.index import Index, index_of
from derlem.plans.queries import BooleanQuery
from derlem.queries_corpus import CLEAN, FOLDED
from derlem.queries_search import TOK, _bm25_sql, _tfidf_sql
from derlem.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- search ------------------------------------------------------------------------------

_TERMS = ["ihbar", "süresini", "kira"]
#: Each article once, its longest delivery; the number, heading and body are searched together.
_ARTS = "documents AS (SELECT mevzuat_id || '|' || sira doc_id, max_by(text, length(text)) \"text\" FROM (SELECT mevzuat_id, sira, concat_ws(' ', madde_no, baslik, metin) AS \"text\" FROM mevzuat_madde) GROUP BY 1)"
_LAW = "law AS (SELECT lower(trim(mevzuat_id)) k, max(tur) tur, max(ad) ad FROM mevzuat_dokuman WHERE snapshot_no = 4 GROUP BY 1)"


def _articles(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat_ws(" ", "madde_no", "baslik", "metin")
    m = table(spark, d, "mevzuat_madde").select(F.concat_ws("|", F.when(F.col("mevzuat_id").isNotNull() & F.col("sira").isNotNull(), F.col("mevzuat_id")), "sira").alias("doc_id"), t.alias("text"))
    return m.groupBy("doc_id").agg(F.max_by("text", F.length("text")).alias("text"))


def index(spark: SparkSession, d: str) -> Index:
    """The stored index over the articles."""
    return index_of(spark, f"{d}/mevzuat_madde.parquet", "doc_id", "text", _articles(spark, d))


def _split(df: DataFrame) -> DataFrame:
    """mevzuat_id and sira of the articles' keys."""
    at = F.length("key") - F.length(F.substring_index("key", "|", -1)) - 1
    return df.select(F.substring("key", F.lit(1), at).alias("mevzuat_id"), F.substring_index("key", "|", -1).cast("long").alias("sira"), *[c for c in df.columns if c != "key"])


_ID = "substr(doc_id, 1, length(doc_id) - position('|' IN reverse(doc_id))) mevzuat_id, split_part(doc_id, '|', -1)::BIGINT sira"


@query(f"WITH {_ARTS}, {_bm25_sql(_TERMS[:2], 'AND')} SELECT {_ID}, round(score, 6) score FROM bm")
def article_search(spark: SparkSession, d: str) -> DataFrame:
    """Articles with every term, scored."""
    return _split(index(spark, d).bm25(_TERMS[:2]).select("key", F.round("score", 6).alias("score")))


@query(f"WITH {_ARTS}, {_bm25_sql(_TERMS, 'AND', 'a')}, {_bm25_sql(_TERMS, 'OR', 'o')}, u AS (SELECT (SELECT count(*) FROM a) >= 3 OR (SELECT count(*) FROM o) <= (SELECT count(*) FROM a) AS every) SELECT {_ID}, round(score, 6) score FROM (SELECT doc_id, score FROM a, u WHERE every UNION ALL SELECT doc_id, score FROM o, u WHERE NOT every)")
def article_search_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Every term; where fewer than three articles match and some terms find more, those."""
    ix = index(spark, d)
    return _split(search.fallback(ix.bm25(_TERMS), ix.bm25(_TERMS, mode="or"), 3).select("key", F.round("score", 6).alias("score")))


@query(
    f"WITH {_ARTS}, {_bm25_sql(_TERMS, 'OR')}, {_tfidf_sql(_TERMS)}, l AS (SELECT doc_id, row_number() OVER (ORDER BY score, doc_id) r FROM bm QUALIFY r <= 40), s AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) r FROM ti QUALIFY r <= 40), "
    f"f AS (SELECT coalesce(l.doc_id, s.doc_id) doc_id, l.r lexical_rank, s.r semantic_rank, coalesce(1.0 / (60 + l.r), 0) + coalesce(1.0 / (60 + s.r), 0) score FROM l FULL JOIN s ON l.doc_id = s.doc_id) SELECT {_ID}, lexical_rank, semantic_rank, round(score, 6) score FROM f ORDER BY f.score DESC, doc_id LIMIT 20"
)
def article_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Two rankings of articles fused by rank, with the place each gave."""
    ix = index(spark, d)
    lists = {"lexical": search.top(ix.bm25(_TERMS, mode="or"), "key", 40, ascending=True), "semantic": search.top(ix.cosine(_TERMS), "key", 40)}
    f = search.rrf_with_ranks(lists, "key").orderBy(F.col("score").desc(), "key").limit(20)
    return _split(f.select("key", F.col("lexical").cast("long").alias("lexical_rank"), F.col("semantic").cast("long").alias("semantic_rank"), F.round("score", 6).alias("score")))


@query(f"WITH {_ARTS}, {_tfidf_sql(_TERMS)}, {_LAW} SELECT {_ID}, round(score, 6) score FROM ti JOIN law ON law.k = lower(trim(substr(doc_id, 1, length(doc_id) - position('|' IN reverse(doc_id))))) WHERE tur = 'YONETMELIK'")
def article_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Vector search among the articles of one kind of legislation: the filter comes before any ranking, so nothing of the subset is missed."""
    s = _split(index(spark, d).cosine(_TERMS).select("key", F.round("score", 6).alias("score")))
    laws = table(spark, d, "mevzuat_dokuman").filter("snapshot_no = 4").groupBy(F.lower(F.trim("mevzuat_id")).alias("k")).agg(F.max("tur").alias("tur")).filter("tur = 'YONETMELIK'")
    return s.join(laws, F.lower(F.trim("mevzuat_id")) == F.col("k"), "left_semi")


def search_articles(spark: SparkSession, d: str, text: str, mode: str = "lexical", limit: int = 10) -> DataFrame:
    """The facade over articles: lexical, semantic or hybrid; where no word of the corpus carries a weight the ranking is lexical alone."""
    from derlem.plans.queries import parse_match

    terms = parse_match(text).terms
    if not terms:
        raise ValueError("a search needs at least one term")
    ix = index(spark, d)
    if mode == "lexical":
        return _split(search.top(search.fallback(ix.bm25(terms), ix.bm25(terms, mode="or"), 3), "key", limit, ascending=True))
    if mode == "semantic":
        return _split(search.top(ix.cosine(terms), "key", limit))
    if mode == "hybrid":
        keep = documents.over_fetch(limit)
        lists = {"lexical": search.top(ix.bm25(terms, mode="or"), "key", keep, ascending=True), "semantic": search.top(ix.cosine(terms), "key", keep)}
        return _split(search.top(search.rrf_with_ranks(lists, "key").select("key", "score"), "key", limit))
    raise ValueError(f"no such mode: {mode}")


@query(f"WITH {_ARTS}, {_bm25_sql(_TERMS, 'OR')}, b AS (SELECT doc_id, score FROM bm ORDER BY score, doc_id LIMIT 50) SELECT mevzuat_id, count(*) n_articles, round(min(score), 6) best, string_agg(sira::VARCHAR, ',' ORDER BY score, sira) articles FROM (SELECT {_ID}, score FROM b) GROUP BY 1")
def article_results_grouped(spark: SparkSession, d: str) -> DataFrame:
    """The fifty best articles law by law, each law with its articles from the best on."""
    best = _split(search.top(index(spark, d).bm25(_TERMS, mode="or"), "key", 50, ascending=True))
    own = F.array_sort(F.collect_list(F.struct("score", "sira")))
    return best.groupBy("mevzuat_id").agg(F.count("*").alias("n_articles"), F.round(F.min("score"), 6).alias("best"), F.array_join(F.transform(own, lambda x: x["sira"].cast("string")), ",").alias("articles"))


_LOW = "lower(translate(coalesce(metin, ''), 'İI', 'iı'))"


@query(
    f"WITH m AS (SELECT DISTINCT mevzuat_id, sira, madde_no, metin FROM mevzuat_madde), x AS (SELECT *, len(list_filter({TOK.replace('text', 'metin')}, lambda x: starts_with(x, 'ihbar'))) + len(list_filter({TOK.replace('text', 'metin')}, lambda x: starts_with(x, 'kira'))) n_hits FROM m WHERE len(list_filter({TOK.replace('text', 'metin')}, lambda x: starts_with(x, 'ihbar') OR starts_with(x, 'kira'))) > 0 AND NOT contains({_LOW}, 'tanık ifadesi')) "
    "SELECT mevzuat_id, sira, madde_no, n_hits, row_number() OVER (PARTITION BY mevzuat_id ORDER BY n_hits DESC, sira, madde_no) rank FROM x"
)
def article_boolean_search(spark: SparkSession, d: str) -> DataFrame:
    """A boolean query over the articles of every law, those with most hits first within their law."""
    m = table(spark, d, "mevzuat_madde").select("mevzuat_id", "sira", "madde_no", "metin").distinct()
    hit = m.filter(BooleanQuery('(ihbar OR kira) NOT "tanık ifadesi"').column("metin"))
    x = hit.withColumn("n_hits", legislation.prefix_hits("metin", ["ihbar", "kira"]))
    w = Window.partitionBy("mevzuat_id").orderBy(F.col("n_hits").desc(), "sira", "madde_no")
    return x.select("mevzuat_id", "sira", "madde_no", F.col("n_hits").cast("long").alias("n_hits"), F.row_number().over(w).cast("long").alias("rank"))


# -- lookup and structure ----------------------------------------------------------------


@query("WITH m AS (SELECT DISTINCT mevzuat_id, sira, madde_no, lower(regexp_replace(translate(coalesce(madde_no,''),'İI','iı'), '\\s+', '', 'g')) no FROM mevzuat_madde), l AS (SELECT mevzuat_id, min(trim(mevzuat_no)) mevzuat_no FROM mevzuat_dokuman GROUP BY 1), t AS (SELECT trim(mevzuat_no) mevzuat_no, count(DISTINCT tur) n_types FROM mevzuat_dokuman WHERE mevzuat_no IS NOT NULL GROUP BY 1) SELECT m.mevzuat_id, m.sira, m.no, l.mevzuat_no, n_types > 1 ambiguous FROM m JOIN l ON l.mevzuat_id = m.mevzuat_id JOIN t ON t.mevzuat_no = l.mevzuat_no")
def article_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Every article under its law's number and its own, both normalised; a number that several kinds of legislation use is ambiguous."""
    no = F.lower(F.regexp_replace(F.translate(F.coalesce("madde_no", F.lit("")), "İI", "iı"), r"\s+", ""))
    m = table(spark, d, "mevzuat_madde").select("mevzuat_id", "sira", "madde_no", no.alias("no")).distinct()
    docs = table(spark, d, "mevzuat_dokuman")
    laws = docs.groupBy("mevzuat_id").agg(F.min(F.trim("mevzuat_no")).alias("mevzuat_no"))
    kinds = docs.filter("mevzuat_no is not null").groupBy(F.trim("mevzuat_no").alias("mevzuat_no")).agg(F.count_distinct("tur").alias("n_types"))
    return m.join(laws, "mevzuat_id").join(kinds, "mevzuat_no").select("mevzuat_id", "sira", "no", "mevzuat_no", (F.col("n_types") > 1).alias("ambiguous"))


@query("SELECT m.mevzuat_id, m.sira, a.row_id, row_number() OVER (PARTITION BY m.mevzuat_id, m.sira ORDER BY coalesce(a.tarih, '') = '', a.tarih, a.row_id) place FROM (SELECT DISTINCT mevzuat_id, sira FROM mevzuat_madde) m JOIN mevzuat_degisiklik a ON a.mevzuat_id = m.mevzuat_id AND a.sira = m.sira")
def article_with_amendments(spark: SparkSession, d: str) -> DataFrame:
    """The amendments of every article in the order of their date strings, those without a date last."""
    m = table(spark, d, "mevzuat_madde").select("mevzuat_id", "sira").distinct()
    w = Window.partitionBy("mevzuat_id", "sira").orderBy(F.coalesce("tarih", F.lit("")) == "", F.col("tarih").asc_nulls_last(), "row_id")
    return table(spark, d, "mevzuat_degisiklik").select("mevzuat_id", "sira", "row_id", "tarih").join(m, ["mevzuat_id", "sira"]).select("mevzuat_id", "sira", "row_id", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT DISTINCT m.mevzuat_id, m.sira, concat_ws(' ', nullif(trim(l.mevzuat_no), '') || ' sayılı', trim(l.ad), 'm.' || nullif(trim(m.madde_no), '')) label FROM mevzuat_madde m JOIN (SELECT mevzuat_id, min(mevzuat_no) mevzuat_no, min(ad) ad FROM mevzuat_dokuman WHERE snapshot_no = 4 GROUP BY 1) l ON l.mevzuat_id = m.mevzuat_id")
def article_citation(spark: SparkSession, d: str) -> DataFrame:
    """How an article is cited: number and name of the law, number of the article."""
    laws = table(spark, d, "mevzuat_dokuman").filter("snapshot_no = 4").groupBy("mevzuat_id").agg(F.min("mevzuat_no").alias("mevzuat_no"), F.min("ad").alias("ad"))
    m = table(spark, d, "mevzuat_madde").select("mevzuat_id", "sira", "madde_no").distinct()
    return m.join(laws, "mevzuat_id").select("mevzuat_id", "sira", legislation.citation("mevzuat_no", "ad", "madde_no").alias("label")).distinct()


@query("SELECT row_id, CASE upper(trim(tur)) WHEN 'KANUN' THEN 1 WHEN 'TUZUK' THEN 2 WHEN 'KHK' THEN 4 WHEN 'YONETMELIK' THEN 7 WHEN 'KKY' THEN 7 WHEN 'UY' THEN 8 WHEN 'TEBLIGLER' THEN 9 WHEN 'CBK' THEN 19 ELSE 1 END code, upper(trim(tur)) IN ('KANUN','TUZUK','KHK','YONETMELIK','KKY','UY','TEBLIGLER','CBK') known FROM mevzuat_dokuman")
def legislation_type_codes(spark: SparkSession, d: str) -> DataFrame:
    """The register's code of each kind; an unknown one counts as a law and is marked."""
    code, known = legislation.type_code(F.col("tur"))
    return table(spark, d, "mevzuat_dokuman").select("row_id", code.alias("code"), known.alias("known"))


@query()
def article_structure(spark: SparkSession, d: str) -> DataFrame:
    """Articles cut out of the texts with the headings above them, part by part."""
    m = table(spark, d, "mevzuat_madde").groupBy("mevzuat_id", "sira").agg(F.max_by("metin", F.length("metin")).alias("metin"))
    return documents.parts(m, ["mevzuat_id", "sira"], "metin", legislation.structure, "path string, heading string, number string, body string, is_rationale boolean")


@query()
def article_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Where the words stand in each article: up to three places around them, and the window of words a search page shows."""
    m = table(spark, d, "mevzuat_madde").filter(lower_tr("metin").contains("ihbar")).select("mevzuat_id", "sira", "metin").distinct()
    return documents.parts(m, ["mevzuat_id", "sira"], "metin", lambda t: [(documents.regions(t, ["ihbar", "kira"]), documents.word_window(t, ["ihbar", "kira"]))], "places string, shown string")


# -- gazette and upkeep ------------------------------------------------------------------

_KINDS = "(KANUN|YÖNETMELİK|TEBLİĞ|KARARNAME|CUMHURBAŞKANI KARAR|TÜZÜK)"


@query(f"SELECT row_id, regexp_matches(upper(translate(coalesce(kategori, '') || ' ' || coalesce(bolum, ''), 'iı', 'İI')), '{_KINDS}') is_legislation FROM rg_ogeler")
def gazette_is_legislation(spark: SparkSession, d: str) -> DataFrame:
    """Whether a gazette item is legislation by its category and section."""
    t = F.upper(F.translate(F.concat_ws(" ", F.coalesce("kategori", F.lit("")), F.coalesce("bolum", F.lit(""))), "iı", "İI"))
    return table(spark, d, "rg_ogeler").select("row_id", t.rlike(_KINDS).alias("is_legislation"))


@query()
def amendment_targets(spark: SparkSession, d: str) -> DataFrame:
    """What each gazette title amends or repeals, if it names one law, by name and number."""
    t = table(spark, d, "rg_ogeler").select("row_id", "baslik")
    return documents.parts(t, ["row_id"], "baslik", lambda x: [legislation.target(x)], "kind string, target string, target_no string")


def gazette_delta(spark: SparkSession, d: str, last_days: int = 3650, as_of: str = "2025-06-30") -> DataFrame:
    """(row_id, kind, target, mevzuat_id): the amendments of the last days matched to laws, by name, by the beginning of the name, then by number."""
    items = table(spark, d, "rg_ogeler").withColumn("day", F.expr("try_to_date(substring(sayfa, 1, 8), 'yyyyMMdd')")).filter(F.col("day") > F.date_sub(F.lit(as_of).cast("date"), last_days))
    hit = documents.parts(items, ["row_id"], "baslik", lambda x: [legislation.target(x)], "kind string, target string, target_no string").filter("kind <> 'new'")
    laws = table(spark, d, "mevzuat_dokuman").filter(~is_blank("mevzuat_id"))
    return legislation.match_names(hit, laws, "row_id", "target", "target_no")


def amendment_report(spark: SparkSession, d: str) -> DataFrame:
    """Per kind the items, those matched, and the time of the last run of the update job."""
    last = table(spark, d, "mevzuat_guncelleme_log").agg(F.max("kosu_zamani").alias("last_run"))
    return gazette_delta(spark, d).groupBy("kind").agg(F.count("*").alias("n_items"), F.count("mevzuat_id").alias("n_matched")).join(F.broadcast(last))


@query("SELECT row_id, item_id, sayfa FROM rg_ogeler QUALIFY sayfa IS NULL OR cekilme_zamani IS NOT DISTINCT FROM max(cekilme_zamani) OVER (PARTITION BY sayfa)")
def gazette_page_replace(spark: SparkSession, d: str) -> DataFrame:
    """A page fetched again takes the place of all rows it had before."""
    items = table(spark, d, "rg_ogeler").select("row_id", "item_id", "sayfa", "cekilme_zamani")
    latest = items.filter("sayfa is not null").groupBy("sayfa").agg(F.max("cekilme_zamani").alias("cekilme_zamani"))
    on = (items["sayfa"] == latest["sayfa"]) & items["cekilme_zamani"].eqNullSafe(latest["cekilme_zamani"])
    return maintenance.replace_by_key(items, items.join(latest, on, "left_semi"), ["sayfa"]).select("row_id", "item_id", "sayfa")


@query(
    f"WITH r AS (SELECT snapshot_no n, {FOLDED('mevzuat_id')} k, {CLEAN('mevzuat_id')} mevzuat_id, CASE WHEN {CLEAN('metin')} <> '' THEN sha256({CLEAN('metin')}) ELSE nullif({FOLDED('metin_hash')}, '') END h FROM mevzuat_dokuman WHERE {CLEAN('mevzuat_id')} <> '' AND snapshot_no IS NOT NULL QUALIFY row_number() OVER (PARTITION BY snapshot_no, {FOLDED('mevzuat_id')} ORDER BY cekim_zamani DESC NULLS LAST, row_id DESC) = 1), "
    "c AS (SELECT *, h IS DISTINCT FROM lag(h) OVER w OR row_number() OVER w = 1 fresh FROM r WINDOW w AS (PARTITION BY k ORDER BY n)), v AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY k ORDER BY n) version FROM c), g AS (SELECT k, version, min(n) valid_from, max(n) last_seen, any_value(h) h FROM v GROUP BY 1, 2), ids AS (SELECT k, arg_max(mevzuat_id, n) mevzuat_id FROM r GROUP BY 1) "
    "SELECT mevzuat_id, version::BIGINT version, valid_from, lead(valid_from) OVER (PARTITION BY k ORDER BY version) valid_to, last_seen, h FROM g JOIN ids USING (k)"
)
def legislation_history(spark: SparkSession, d: str) -> DataFrame:
    """Every text a law ever had, with the deliveries from and to which it held: what archiving before overwriting leaves."""
    docs = table(spark, d, "mevzuat_dokuman").filter(~is_blank("mevzuat_id") & F.col("snapshot_no").isNotNull())
    h = F.when(~is_blank("metin"), F.sha2(F.encode(strip("metin"), "utf-8"), 256)).otherwise(F.nullif(fold_key("metin_hash"), F.lit("")))
    rows = docs.select("snapshot_no", fold_key("mevzuat_id").alias("k"), strip("mevzuat_id").alias("mevzuat_id"), h.alias("h"), F.struct("cekim_zamani", "row_id").alias("o"))
    one = rows.groupBy("snapshot_no", "k").agg(F.max_by(F.struct("mevzuat_id", "h"), "o").alias("r")).select("snapshot_no", "k", "r.*")
    ids = one.groupBy("k").agg(F.max_by("mevzuat_id", "snapshot_no").alias("mevzuat_id"))
    return maintenance.history(one.drop("mevzuat_id"), "k", "snapshot_no", "h").join(ids, "k").select("mevzuat_id", "version", "valid_from", "valid_to", "last_seen", "h")


@query("WITH l AS (SELECT max(kosu_zamani) t, max(kosu_zamani) FILTER (hata = 0) ok FROM mevzuat_guncelleme_log) SELECT t last_run, ok last_success, date_diff('day', substr(t, 1, 10)::DATE, DATE '2026-06-30') age_days, date_diff('day', substr(t, 1, 10)::DATE, DATE '2026-06-30') > 7 stalled FROM l")
def run_age(spark: SparkSession, d: str) -> DataFrame:
    """The last run and the last without errors, and whether the job stands still."""
    log = table(spark, d, "mevzuat_guncelleme_log").agg(F.max("kosu_zamani").alias("last_run"), F.max(F.when(F.col("hata") == 0, F.col("kosu_zamani"))).alias("last_success"))
    age = F.date_diff(F.lit("2026-06-30").cast("date"), F.substring("last_run", 1, 10).cast("date"))
    return log.select("last_run", "last_success", age.cast("long").alias("age_days"), (age > 7).alias("stalled"))


@query("WITH k AS (SELECT DISTINCT tur, mevzuat_id FROM mevzuat_dokuman WHERE snapshot_no < 4), c AS (SELECT m.tur, m.mevzuat_id, m.row_id, k.mevzuat_id IS NOT NULL known FROM mevzuat_dokuman m LEFT JOIN k ON k.tur = m.tur AND k.mevzuat_id = m.mevzuat_id WHERE snapshot_no = 4), i AS (SELECT *, sum((NOT known)::INT) OVER (PARTITION BY tur ORDER BY row_id) island FROM c), r AS (SELECT *, sum(known::INT) OVER (PARTITION BY tur, island ORDER BY row_id) run FROM i), s AS (SELECT tur, min(row_id) stop_at FROM r WHERE run >= 5 GROUP BY 1) SELECT c.tur, count(*) n_seen, count(*) FILTER (NOT known) n_new FROM c LEFT JOIN s USING (tur) WHERE stop_at IS NULL OR c.row_id <= stop_at GROUP BY 1")
def crawl_until_known(spark: SparkSession, d: str) -> DataFrame:
    """A crawl of the last delivery, kind by kind, that stops after five known ids in a row: what it reads and what is new in it."""
    docs = table(spark, d, "mevzuat_dokuman").select("snapshot_no", "tur", "mevzuat_id", "row_id")
    known = docs.filter("snapshot_no < 4").select("tur", "mevzuat_id").distinct().withColumn("known", F.lit(True))
    c = docs.filter("snapshot_no = 4").join(known, ["tur", "mevzuat_id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return maintenance.until_known(c, "tur", "row_id", "known", 5).groupBy("tur").agg(F.count("*").alias("n_seen"), F.count_if(~F.col("known")).alias("n_new"))
