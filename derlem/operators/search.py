"""Ranking over text: scores in one pass over texts without an index, fusion, pages.

Queries over a corpus score from the stored index (``index``). The functions here that take texts serve
small sets and columns that have none, and say what the index must give.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from derlem.functions.text import tokens


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) for every distinct word of every document."""
    return df.select(key, F.explode(tokens(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def lengths(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.size(tokens(text)).alias("dl"))


def idf(post: DataFrame, key: str) -> DataFrame:
    """(term, df, idf) with idf = ln(N / df), N the documents with at least one word."""
    n = post.agg(F.count_distinct(key).alias("n"))
    return post.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("term", "df", F.log(F.col("n") / F.col("df")).alias("idf"))


def tfidf(post: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(key, term, w): tf / words of the document, times idf."""
    total = post.groupBy(key).agg(F.sum("tf").alias("total"))
    return post.join(total, key).join(terms.select("term", "idf"), "term").select(key, "term", (F.col("tf") / F.col("total") * F.col("idf")).alias("w"))


def norms(weights: DataFrame, key: str) -> DataFrame:
    return weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.count("*").alias("n_terms"))


def counts(df: DataFrame, key: str, text: str, terms: list[str], extra: list[str] | None = None) -> DataFrame:
    """(key, dl, f0, f1, ...): occurrences of each query term, in one narrow pass."""
    # behind a generator the words are cut once a row, however often later predicates name the counts
    d = df.select(key, *(extra or []), F.explode(F.array(tokens(text))).alias("_t"))
    n = F.size("_t")
    return d.select(key, *(extra or []), n.alias("dl"), *[(n - F.size(F.array_remove("_t", t))).alias(f"f{i}") for i, t in enumerate(terms)])


def bm25(df: DataFrame, key: str, text: str, terms: list[str], *, mode: str = "and", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score): the stronger the match, the smaller (more negative) the score.

    idf that is not positive becomes 1e-6. ``mode``: ``and`` wants every term, ``or`` any.
    """
    c = counts(df, key, text, terms)
    n = len(terms)
    stats = c.agg(F.count("*").alias("N"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(n)])
    j = c.join(F.broadcast(stats))
    total = F.lit(0.0)
    for i in range(n):
        raw = F.log((F.col("N") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        w = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
        f = F.col(f"f{i}")
        total = total + w * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    hit = [F.col(f"f{i}") > 0 for i in range(n)]
    keep = hit[0]
    for h in hit[1:]:
        keep = keep & h if mode == "and" else keep | h
    return j.filter(keep).select(key, (-total).alias("score"))


def tfidf_cosine(df: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, score): cosine of the query's and the documents' vectors, positive ones only.

    A query term that the corpus lacks weighs 1 in the query and nothing in documents.
    """
    post = postings(df, key, text)
    vocabulary = idf(post, key)
    w = tfidf(post, vocabulary, key)
    spark = df.sparkSession
    tf = {t: terms.count(t) / len(terms) for t in terms}
    q = spark.createDataFrame([(t, x) for t, x in tf.items()], "term string, qtf double")
    q = q.join(vocabulary.join(F.broadcast(q.select("term")), "term", "left_semi"), "term", "left").select("term", (F.col("qtf") * F.coalesce("idf", F.lit(1.0))).alias("q"))
    qn = q.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
    dot = w.join(F.broadcast(q), "term").groupBy(key).agg(F.sum(F.col("w") * F.col("q")).alias("dot"))
    return dot.join(norms(w, key), key).join(F.broadcast(qn)).select(key, (F.col("dot") / (F.col("norm") * F.col("qn"))).alias("score")).filter("score > 0")


def top(scored: DataFrame, key: str, k: int, *, ascending: bool = False) -> DataFrame:
    """The k best with their rank; ties go to the smaller key."""
    order = [F.col("score").asc() if ascending else F.col("score").desc(), F.col(key).asc()]
    best = scored.orderBy(*order).limit(k)
    # k rows remain, so one task may number them
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rrf(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, rank from 1)."""
    u = lists[0].select(key, "rank")
    for x in lists[1:]:
        u = u.unionByName(x.select(key, "rank"))
    return u.groupBy(key).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))


def rrf_with_ranks(lists: dict[str, DataFrame], key: str, k: int = 60) -> DataFrame:
    """(key, score, a column of ranks per list): the same with the place each ranking gave, null where it has none."""
    u = reduce(DataFrame.unionByName, [x.select(key, "rank", F.lit(n).alias("_list")) for n, x in lists.items()])
    return u.groupBy(key).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"), *[F.max(F.when(F.col("_list") == n, F.col("rank"))).alias(n) for n in lists])


def hybrid(lexical: DataFrame, vector: DataFrame, key: str, weight: float = 0.6, norm: str = "inverse", dense: DataFrame | None = None, dense_weight: float = 0.0) -> DataFrame:
    """weight * bm25n + (1 - weight) * cosine over the union of both, and dense_weight * dense beside them; then all by 1 + dense_weight.

    ``norm``: ``inverse`` maps a BM25 score s to 1 / (1 + |s|), which falls as matches get
    stronger; ``monotone`` maps it to |s| / (1 + |s|).
    """
    a = F.abs("bm25")
    n = 1 / (1 + a) if norm == "inverse" else a / (1 + a)
    j = lexical.select(key, F.col("score").alias("bm25")).join(vector.select(key, F.col("score").alias("cos")), key, "full_outer")
    zero = F.lit(0.0)
    score = F.lit(weight) * F.coalesce(n, zero) + F.lit(1 - weight) * F.coalesce("cos", zero)
    if dense is None or not dense_weight:
        return j.select(key, score.alias("score"))
    j = j.join(dense.select(key, F.col("score").alias("dense")), key, "full_outer")
    return j.select(key, ((score + F.lit(dense_weight) * F.coalesce("dense", zero)) / (1 + dense_weight)).alias("score"))


def two_stage(every: DataFrame, some: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, score, all_terms): documents with every term, and where these are fewer than ``limit`` those with some as well.

    The choice is part of the plan: one row that says whether the second stage counts.
    """
    few = every.limit(limit).agg((F.count("*") < limit).alias("_few"))
    more = some.join(every.select(key), key, "left_anti").join(F.broadcast(few), F.col("_few")).drop("_few")
    return every.select(key, "score", F.lit(True).alias("all_terms")).unionByName(more.select(key, "score", F.lit(False).alias("all_terms")))


def fallback(every: DataFrame, some: DataFrame, least: int) -> DataFrame:
    """``every``, or ``some`` in its place where it has fewer than ``least`` rows and ``some`` has more than it."""
    n = every.limit(least).agg(F.count("*").alias("_n")).join(some.limit(least + 1).agg(F.count("*").alias("_m")))
    use = F.broadcast(n.select(((F.col("_n") >= least) | (F.col("_m") <= F.col("_n"))).alias("_every")))
    return every.join(use, F.col("_every")).drop("_every").unionByName(some.join(use, ~F.col("_every")).drop("_every"))


def predicate(where: dict, exact: tuple[str, ...] = ()) -> Column:
    """A filter from fields and values: equality for ``exact`` fields, flags and numbers, else containment without regard to case.

    None as a value wants a null; a list wants any of its values; a pair (from, to) wants a range with both ends.
    """
    parts = [F.lit(True)]
    for f, v in where.items():
        c = F.col(f)
        if v is None:
            parts.append(c.isNull())
        elif isinstance(v, list):
            parts.append(c.isin(v))
        elif isinstance(v, tuple):
            parts.append(c.between(*v))
        elif f in exact or not isinstance(v, str):
            parts.append(c == v)
        else:
            parts.append(c.ilike(v if "%" in v else f"%{v}%"))
    return reduce(lambda a, b: a & b, parts)


def page(found: DataFrame, key: str, *, sort: str = "relevance", date: str | None = None, time: str | None = None, ascending: bool = False, limit: int = 10, offset: int = 0) -> DataFrame:
    """``limit`` rows after ``offset`` in the order named by ``sort``, with ``total``, the number of all.

    Orders: relevance, decision_date_desc and _asc (by ``date``), fetched_at_desc and _asc (by ``time``). Missing dates come last
    in a falling order and first in a rising one; an unknown name is relevance; ties go to the smaller key.
    """
    by = {"decision_date": date, "fetched_at": time}.get(sort.rsplit("_", 1)[0])
    if by:
        first = F.col(by).desc_nulls_last() if sort.endswith("_desc") else F.col(by).asc_nulls_first()
    else:
        first = F.col("score").asc() if ascending else F.col("score").desc()
    return found.orderBy(first, F.col(key).asc()).offset(offset).limit(limit).join(F.broadcast(found.agg(F.count("*").alias("total"))))


def evaluate(ranked: DataFrame, gold: DataFrame, key: str, k: int = 10, enough: float = 0.5) -> DataFrame:
    """(qid, n_relevant, recall, ndcg, passed) of rankings (qid, key, rank) against what should be found (qid, key), for every query with something to find.

    A relevant result at rank r gains 1 / log2(r + 1); ``passed`` is a recall of ``enough`` and more.
    """
    n = gold.groupBy("qid").agg(F.count("*").alias("n_relevant"))
    hit = ranked.filter(F.col("rank") <= k).join(gold.select("qid", key), ["qid", key], "left_semi")
    got = hit.groupBy("qid").agg(F.count("*").alias("_hits"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("_dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_relevant").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    j = n.join(got, "qid", "left")
    recall = F.coalesce("_hits", F.lit(0)) / F.col("n_relevant")
    return j.select("qid", "n_relevant", recall.alias("recall"), (F.coalesce("_dcg", F.lit(0.0)) / ideal).alias("ndcg"), (recall >= enough).alias("passed"))


def gate(evaluated: DataFrame, least: float = 0.3) -> DataFrame:
    """(n_queries, mean_recall, mean_ndcg, pass_rate, passes) over all queries; an index takes another's place if it passes."""
    m = evaluated.agg(F.count("*").alias("n_queries"), F.avg("recall").alias("mean_recall"), F.avg("ndcg").alias("mean_ndcg"), F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)).alias("pass_rate"))
    return m.withColumn("passes", F.col("mean_recall") >= least)
