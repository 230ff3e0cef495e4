"""Queries of the problems that prepare text for language models (4 to 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from derlem.functions.dates_sql import moments
from derlem.functions.keys import effective_text, fold_key, strip
from derlem.llm import lookalikes, neardup, packing, pii, splitting, survivors, tokens
from derlem.session import spread, table

TOKENIZER = "byte_bpe_50k"


def _groups(spark: SparkSession, d: str, values: bool = False) -> DataFrame:
    return survivors.group_records(table(spark, d, "dedup_clusters"), table(spark, d, "dedup_members"), table(spark, d, "documents_v2"), values=values)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(_groups(spark, d))


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value of every field with its posterior under the two-sided source model."""
    return survivors.judged_values(survivors.claims(_groups(spark, d, values=True)))


def p4_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Per field, how often the model's most probable value is the survivor of the stated order."""
    return survivors.agreement(survivors.claims(_groups(spark, d, values=True)))


def _long(spark: SparkSession, d: str) -> DataFrame:
    """(src_table, item_key, t, max_len, overlap_len) of the delivered rows whose text is above its table's limit."""
    limits = table(spark, d, "parca_sinir")
    at = lambda t: F.broadcast(limits.filter(fold_key("tablo") == t).select("max_len", "overlap_len").limit(1))  # noqa: E731  one row per table
    docs = table(spark, d, "documents_v2").select(F.lit("documents_v2").alias("src_table"), strip("document_id").alias("item_key"), effective_text().alias("t")).crossJoin(at("documents_v2"))
    arts = table(spark, d, "mevzuat_madde").select(F.lit("mevzuat_madde").alias("src_table"), F.concat(strip("mevzuat_id"), F.lit("|"), F.col("sira")).alias("item_key"), F.col("metin").alias("t")).crossJoin(at("mevzuat_madde"))
    return docs.unionByName(arts).filter(F.col("item_key").isNotNull() & (F.length(strip("t")) > F.col("max_len")))


def _pieces(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    """Of each item one text is split: the others are left out before, by a join that carries lengths and hashes."""
    long = _long(spark, d).withColumns({"_k": F.lower("item_key"), "_v": F.struct(F.length(strip("t")).alias("n"), F.xxhash64("t").alias("h"), F.col("item_key").alias("i"))})
    if not with_text:
        # for the list of items any delivery will do
        return splitting.split_long(long, ["src_table", "item_key"], "t", "max_len", "overlap_len", with_text=False)
    best = long.groupBy("src_table", "_k").agg(F.max("_v").alias("_v"), F.min("item_key").alias("item_key"))
    won = long.drop("item_key").join(best, ["src_table", "_k", "_v"])
    # deliveries with one and the same text: one of them
    own = won.dropDuplicates(["src_table", "_k"])
    return splitting.split_long(own, ["src_table", "item_key"], "t", "max_len", "overlap_len")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, False).filter("chunk_index = 0").groupBy("src_table", F.lower("item_key")).agg(F.min("item_key").alias("item_key")).select("src_table", "item_key")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces themselves; of a record delivered again the longest text counts, of equally long ones that with the largest hash."""
    p = _pieces(spark, d, True)
    return p.select("src_table", "item_key", "chunk_index", "n_chunks", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "chunk")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence once, however often its record was delivered."""
    docs = spread(table(spark, d, "documents_v2").filter("document_id is not null").select(strip("document_id").alias("document_id"), "full_text", "markdown"))
    found = pii.find(docs, "document_id", ["full_text", "markdown"])
    return found.select("document_id", "field_name", "pii_type", "start_pos").distinct()


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The delivered rows' texts with typed placeholders."""
    return pii.redacted(spread(table(spark, d, "documents_v2").select("row_id", "full_text", "markdown")), "row_id", ["full_text", "markdown"])


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, d, "documents_v2").filter("document_id is not null").select(strip("document_id").alias("id"), effective_text().alias("t")))
    return neardup.near_duplicates(docs, "id", "t", size=3, threshold=0.6, min_words=30)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.document_pairs(*_near(spark, d))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per decision with its group and its number of linked classes."""
    return neardup.components(*_near(spark, d))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(_texts(spark, d), "doc_id", "text", TOKENIZER)


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.lengths(_texts(spark, d), "doc_id", "text", TOKENIZER).select(F.col("doc_id").alias("item"), F.col("n_tokens").alias("size"))
    kinds = table(spark, d, "kap_boyut").filter(fold_key("tokenizer") == TOKENIZER).select("kap", F.col("kapasite").alias("capacity"))
    return packing.pack(sizes, kinds)


def p9_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select("kap", F.col("item").alias("doc_id"), "piece_no", F.col("size").alias("n_tokens"), "bin_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(_packed(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_looking(lookalikes.canonical(_texts(spark, d), "doc_id", "text", keep_text=False), "doc_id")


def p10_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every text."""
    return lookalikes.canonical(_texts(spark, d), "doc_id", "text").select("doc_id", F.col("folded").alias("text"))


_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
_STRIP = lambda c: f"regexp_replace({c}, '^{_WS}|{_WS}$', '', 'g')"
_TEXT = f"CASE WHEN coalesce({_STRIP('full_text')}, '') <> '' THEN full_text ELSE markdown END"
_LIMIT = "(SELECT max_len FROM parca_sinir WHERE lower(trim(tablo)) = '{}' LIMIT 1)"
_KEY = lambda c: f"lower({_STRIP(c)})"
_STATE = f"CASE WHEN {_KEY('st')} IN ('full_text', 'html_markdown') AND n2 < 50 THEN 4 ELSE coalesce(list_position(['full_text', 'html_markdown', 'pdf_link_only', 'metadata_only', 'unavailable'], {_KEY('st')}), 6) END"
_FIELD = " UNION ALL ".join(f"SELECT cluster_id, '{f}' field_name, id, src, state, n, retrieved_at FROM o WHERE regexp_matches({f}, '[\\p{{L}}\\p{{N}}]')" + (" AND utc IS NOT NULL" if f == "decision_date" else "") for f in survivors.FIELDS)
_P4 = (
    f"WITH c AS (SELECT {_KEY('cluster_id')} ck, min({_STRIP('cluster_id')}) cluster_id FROM dedup_clusters WHERE cluster_id IS NOT NULL GROUP BY 1), m AS (SELECT DISTINCT {_KEY('cluster_id')} ck, {_KEY('document_id')} d, coalesce({_KEY('source')}, '') s FROM dedup_members WHERE cluster_id IS NOT NULL AND document_id IS NOT NULL), "
    f"{moments('dt', 'documents_v2', 'decision_date', 'row_id')}, r AS (SELECT {_KEY('document_id')} d, coalesce({_KEY('source')}, '') s, {_STRIP('document_id')} id, {_STRIP('source')} src, {', '.join(survivors.FIELDS)}, retrieved_at, content_status st, length(coalesce({_STRIP(f'regexp_replace({_TEXT}, {chr(39)}{_WS}{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}, '')) n, length(coalesce({_STRIP(_TEXT)}, '')) n2, utc FROM documents_v2 JOIN dt USING (row_id) WHERE document_id IS NOT NULL), "
    f"j AS (SELECT c.cluster_id, r.*, {_STATE} state FROM m JOIN c USING (ck) JOIN r USING (d, s)), o AS (SELECT * FROM j WHERE cluster_id IN (SELECT cluster_id FROM j GROUP BY 1 HAVING count(DISTINCT (d, s)) > 1)), f AS ({_FIELD}) "
    "SELECT cluster_id, field_name, id document_id, src source FROM f QUALIFY row_number() OVER (PARTITION BY cluster_id, field_name ORDER BY state, n DESC, retrieved_at DESC NULLS LAST, id, src) = 1"
)
# brute force over all runs of three words
_P7 = (
    f"WITH t AS (SELECT DISTINCT {_STRIP('document_id')} id, regexp_extract_all(lower(replace({_TEXT}, 'İ', 'i' || chr(775))), '[\\p{{L}}\\p{{N}}]+') w FROM documents_v2 WHERE document_id IS NOT NULL), r AS (SELECT DISTINCT id, hash(w[i], w[i + 1], w[i + 2]) h FROM (SELECT id, w, unnest(range(1, len(w) - 1)) i FROM t WHERE len(w) >= 30)), n AS (SELECT id, count(*) n FROM r GROUP BY 1), "
    "c AS (SELECT a.id x, b.id y, count(*) k FROM r a JOIN r b ON a.h = b.h AND a.id < b.id GROUP BY 1, 2) SELECT x doc_a, y doc_b FROM c JOIN n a ON a.id = x JOIN n b ON b.id = y WHERE k >= 0.6 * (a.n + b.n - k)"
)
SQL = {
    "p4_found": _P4,
    "p7_found": _P7,
    "p5_found": f"SELECT 'documents_v2' src_table, min({_STRIP('document_id')}) item_key FROM documents_v2 WHERE document_id IS NOT NULL AND length({_STRIP(_TEXT)}) > {_LIMIT.format('documents_v2')} GROUP BY lower({_STRIP('document_id')}) "
    f"UNION ALL SELECT 'mevzuat_madde', min({_STRIP('mevzuat_id')} || '|' || sira) FROM mevzuat_madde WHERE length({_STRIP('metin')}) > {_LIMIT.format('mevzuat_madde')} GROUP BY lower({_STRIP('mevzuat_id')} || '|' || sira)"
}
QUERIES = {
    f.__name__: f
    for f in (p4_found, p4_values, p4_agreement, p5_found, p5_pieces, p6_found, p6_redacted, p7_found, p7_groups, p8_ids, p9_assignment, p9_report, p10_found, p10_canonical)
}
