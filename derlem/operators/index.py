"""A stored inverted index that is kept incrementally and that queries score from.

A generation is a batch of documents: postings (term, key, tf, dl, pos), in folders by the hash of the
term and sorted by it; documents (key, dl, n_terms, norm); terms (term, df). The inverse document
frequencies are frozen in an epoch, so that documents added later get weights under the same ones until
a rebuild. ``META.json`` names the generations that count: a generation is written first and named
afterwards, in one step, so a broken build leaves nothing behind that a query could see, and starting it
again goes on after the last named one. Deleted keys are kept apart until the index is compacted.

A query reads the folders of its own terms; files are sorted, so within them only the row groups of
these terms. No text is read. Frequent terms are spread over ``salts`` files of their folder.

Defined results: null and empty texts are documents of length 0; a null key is left out; of a key that is
delivered twice the row with the longer text is indexed; a term that the corpus lacks matches nothing.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from derlem.functions.text import tokens
from derlem.session import shared_folder
from derlem.sources.store import Store

META = "META.json"
EMPTY = {"generations": [], "deleted": [], "epoch": None, "buckets": 16, "salts": 2}


class Index:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Store(spark, root)
        self.root = self.store.root
        self.meta = self.store.read(META) or dict(EMPTY)

    # -- writing ------------------------------------------------------------------------

    def build(self, docs: DataFrame, key: str, text: str, *, buckets: int = 16, salts: int = 2, batches: int = 1) -> Index:
        """Index ``docs``, in ``batches`` by the hash of the key; what an earlier, broken call finished is kept."""
        self._settle({"buckets": buckets, "salts": salts})
        for i in range(batches):
            part = docs if batches == 1 else docs.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == i)
            if i not in self._numbers():
                self._write(i, part, key, text)
        if self.meta["epoch"] is None:
            self.freeze()
        for i in range(batches):
            if not self._generation(i).get("weighed"):
                self._weigh(i)
        return self

    def append(self, docs: DataFrame, key: str, text: str, number: int | None = None) -> Index:
        """Add the documents the index lacks, under the frozen frequencies. A batch of the same ``number`` replaces itself."""
        number = max([-1, *self._numbers()]) + 1 if number is None else number
        known = self.documents(without=number)
        self._write(number, docs.join(known.select(F.col("key").alias(key)), key, "left_anti") if known is not None else docs, key, text)
        if self.meta["epoch"] is None:
            self.freeze()
        self._weigh(number)
        return self

    def delete(self, keys: DataFrame) -> Index:
        """Leave the keys (one column) out of every answer; they go from the files when the index is compacted."""
        n = max([-1, *self.meta["deleted"]]) + 1
        keys.toDF("key").distinct().write.mode("overwrite").parquet(f"{self.root}/deleted/gen={n}")
        self._settle({"deleted": [*self.meta["deleted"], n]})
        return self

    def freeze(self) -> Index:
        """A new epoch of idf = ln(N / df) over the documents there are, N those with a word."""
        epoch = (self.meta["epoch"] or 0) + 1
        n = sum(g["n_words_in"] for g in self.meta["generations"])
        terms = self._read("terms").groupBy("term").agg(F.sum("df").alias("df")).withColumn("idf", F.log(F.lit(float(n)) / F.col("df")))
        terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.root}/idf/epoch={epoch}")
        self._settle({"epoch": epoch})
        return self

    def rebuild(self, docs: DataFrame, key: str, text: str, **how: int) -> Index:
        """Forget everything and index ``docs`` under frequencies of their own."""
        self.store.delete()
        self.meta = dict(EMPTY)
        return self.build(docs, key, text, **how)

    def compact(self) -> Index:
        """One generation without deleted keys in place of all; the frozen frequencies stay. Old files go once the new ones count."""
        old = self._numbers()
        new = max(old) + 1
        docs, post = self.documents(), self._alive(self._read("postings"))
        docs.write.mode("overwrite").parquet(f"{self.root}/gen={new}/docs")
        self._put_postings(new, post.select("b", "term", "key", "tf", "dl", "pos"))
        g = self._count(new)
        self.meta["generations"], self.meta["deleted"] = [g | {"weighed": True}], []
        self._settle({})
        for i in old:
            self.store.delete(f"gen={i}")
        self.store.delete("deleted")
        return self

    def _settle(self, change: dict) -> None:
        self.meta |= change
        self.store.write(META, self.meta)

    def _numbers(self) -> list[int]:
        return [g["number"] for g in self.meta["generations"]]

    def _generation(self, number: int) -> dict:
        return next((g for g in self.meta["generations"] if g["number"] == number), {})

    def _write(self, number: int, docs: DataFrame, key: str, text: str) -> None:
        at = f"{self.root}/gen={number}"
        # the words of a text are cut once; every occurrence moves once, to the folder and file of its term
        t = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(F.array(tokens(text))).alias("t"))
        t.select("key", F.size("t").alias("dl")).groupBy("key").agg(F.max("dl").alias("dl")).write.mode("overwrite").parquet(f"{at}/lengths")
        occ = t.select("key", F.size("t").alias("dl"), F.posexplode("t").alias("pos", "term")).withColumns({"b": self._bucket(F.col("term")), "s": F.pmod(F.xxhash64("key"), F.lit(self.meta.get("salts", 2)))})
        # a key delivered twice: its longest text
        post = occ.repartition("b", "s").groupBy("b", "s", "term", "key").agg(F.max(F.struct("dl", F.lit(0))).alias("m"), F.collect_list(F.struct("dl", "pos")).alias("ps"))
        post = post.select("b", "term", "key", F.col("m.dl").alias("dl"), F.array_distinct(F.sort_array(F.transform(F.filter("ps", lambda p: p["dl"] == F.col("m.dl")), lambda p: p["pos"]))).alias("pos"))
        self._put_postings(number, post.select("b", "term", "key", F.size("pos").alias("tf"), "dl", "pos"))
        g = self._count(number, lengths=True)
        self.meta["generations"] = [x for x in self.meta["generations"] if x["number"] != number] + [g]
        self._settle({})

    def _put_postings(self, number: int, post: DataFrame) -> None:
        post.sortWithinPartitions("b", "term", "key").write.mode("overwrite").partitionBy("b").parquet(f"{self.root}/gen={number}/postings")
        read = self.spark.read.parquet(f"{self.root}/gen={number}/postings")
        read.groupBy("term").agg(F.count("*").alias("df")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.root}/gen={number}/terms")

    def _count(self, number: int, lengths: bool = False) -> dict:
        got = self.spark.read.parquet(f"{self.root}/gen={number}/{'lengths' if lengths else 'docs'}").agg(F.count("*").alias("n"), F.count_if(F.col("dl") > 0).alias("w"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
        return {"number": number, "n_docs": got["n"], "n_words_in": got["w"], "tokens": got["t"]}

    def _weigh(self, number: int) -> None:
        """Lengths and norms of a generation's documents under the frozen frequencies; a term that these lack weighs nothing."""
        at = f"{self.root}/gen={number}"
        w = self.spark.read.parquet(f"{at}/postings").select("term", "key", (F.col("tf") / F.col("dl")).alias("w")).join(self.idf().select("term", "idf"), "term", "left")
        x = F.col("w") * F.coalesce("idf", F.lit(0.0))
        norms = w.groupBy("key").agg(F.sqrt(F.sum(x * x)).alias("norm"), F.count("*").alias("n_terms"))
        self.spark.read.parquet(f"{at}/lengths").join(norms, "key", "left").write.mode("overwrite").parquet(f"{at}/docs")
        self._generation(number)["weighed"] = True
        self._settle({})

    # -- reading ------------------------------------------------------------------------

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.crc32(F.encode(term, "utf-8")), F.lit(self.meta["buckets"])).cast("int")

    def _read(self, what: str, terms: list[str] | None = None) -> DataFrame:
        """A table over all generations; of the postings only the folders of ``terms``, where given."""
        at = [f"gen={i}/{what}" for i in self._numbers()]
        if what == "postings" and terms is not None:
            own = sorted({zlib.crc32(t.encode()) % self.meta["buckets"] for t in terms})
            at = [p for a in at for b in own if self.store.exists(p := f"{a}/b={b}")]
        if not at:
            return self.spark.createDataFrame([], "term string, key long, tf int, dl int, pos array<int>, b int")
        parts = [self.spark.read.option("basePath", f"{self.root}/{a.split('/b=')[0]}").parquet(f"{self.root}/{a}") for a in at]
        return reduce(DataFrame.unionByName, parts)

    def _alive(self, df: DataFrame) -> DataFrame:
        if not self.meta["deleted"]:
            return df
        return df.join(self.spark.read.parquet(*[f"{self.root}/deleted/gen={n}" for n in self.meta["deleted"]]).select("key").distinct(), "key", "left_anti")

    def postings(self, terms: list[str]) -> DataFrame:
        """(term, key, tf, dl, pos) of the terms."""
        return self._alive(self._read("postings", terms).filter(F.col("term").isin(terms)).select("term", "key", "tf", "dl", "pos"))

    def documents(self, without: int | None = None) -> DataFrame | None:
        """(key, dl, norm, n_terms) of all documents; norm is null for those without a word."""
        at = [f"{self.root}/gen={i}/docs" for i in self._numbers() if i != without]
        return self._alive(self.spark.read.parquet(*at)) if at else None

    def idf(self) -> DataFrame:
        """(term, df, idf) as frozen."""
        return self.spark.read.parquet(f"{self.root}/idf/epoch={self.meta['epoch']}")

    def weights(self) -> DataFrame:
        """(key, term, tf, dl, w): the stored vectors."""
        return self._alive(self._read("postings").select("key", "term", "tf", "dl")).join(self.idf().select("term", "idf"), "term").select("key", "term", "tf", "dl", (F.col("tf") / F.col("dl") * F.col("idf")).alias("w"))

    def bm25(self, terms: list[str], *, mode: str = "and", k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(key, score): the stronger the match, the smaller (more negative) the score; idf that is not positive becomes 1e-6."""
        terms = list(dict.fromkeys(terms))
        hits = self.postings(terms).drop("pos")
        if self.meta["deleted"]:
            d = self.documents().agg(F.count("*").cast("double").alias("N"), F.avg("dl").alias("avgdl"))
            df = hits.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(d))
        else:
            gs = self.meta["generations"]
            n = sum(g["n_docs"] for g in gs)
            # as many rows as the query has terms
            df = self._read("terms").filter(F.col("term").isin(terms)).groupBy("term").agg(F.sum("df").alias("df")).withColumns({"N": F.lit(float(n)), "avgdl": F.lit(sum(g["tokens"] for g in gs) / max(1, n))})
        raw = F.log((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        w = df.select("term", F.when(raw <= 0, F.lit(1e-6)).otherwise(raw).alias("w"), "avgdl")
        one = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        got = hits.join(F.broadcast(w), "term").groupBy("key").agg((-F.sum(one)).alias("score"), F.count("*").alias("_k"))
        return (got.filter(F.col("_k") == len(terms)) if mode == "and" else got).drop("_k")

    def cosine(self, terms: list[str]) -> DataFrame:
        """(key, score): cosine of the query's and the documents' TF-IDF vectors, positive ones only.

        A query term that the corpus lacks weighs 1 in the query and nothing in documents.
        """
        tf = {t: terms.count(t) / len(terms) for t in terms}
        q = self.spark.createDataFrame(list(tf.items()), "term string, qtf double")
        q = q.join(self.idf().filter(F.col("term").isin(list(tf))), "term", "left").select("term", F.coalesce("idf", F.lit(0.0)).alias("idf"), (F.col("qtf") * F.coalesce("idf", F.lit(1.0))).alias("q"))
        qn = q.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
        dot = self.postings(list(tf)).drop("pos").join(F.broadcast(q), "term").groupBy("key").agg(F.sum(F.col("tf") / F.col("dl") * F.col("idf") * F.col("q")).alias("dot"))
        return dot.join(self.documents().select("key", "norm"), "key").join(F.broadcast(qn)).select("key", (F.col("dot") / (F.col("norm") * F.col("qn"))).alias("score")).filter("score > 0")

    def match(self, terms: list[str], phrases: list[list[str]] = (), *, prefix: bool = False) -> DataFrame:
        """Keys of the documents that have every term (or a word that begins with it) and every phrase, word by word."""
        if not terms and not phrases:
            raise ValueError("a search needs at least one term")
        found = []
        if terms and prefix:
            # files are sorted by term: the beginning is pushed down to their row groups
            for t in dict.fromkeys(terms):
                found.append(self._alive(self._read("postings").filter(F.col("term").startswith(t)).select("key")).distinct())
        elif terms:
            own = list(dict.fromkeys(terms))
            found.append(self.postings(own).groupBy("key").agg(F.count("*").alias("_k")).filter(F.col("_k") == len(own)).select("key"))
        for words in phrases:
            p = self.postings(list(dict.fromkeys(words))).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "pos"))).alias("m"))
            at = F.try_element_at("m", F.lit(words[0]))
            for w in words[1:]:
                at = F.array_intersect(F.transform(at, lambda x: x + 1), F.try_element_at("m", F.lit(w)))
            found.append(p.filter(F.coalesce(F.size(at), F.lit(0)) > 0).select("key"))
        return reduce(lambda a, b: a.join(b, "key", "left_semi"), found)

    def vocabulary(self, prefix: str) -> DataFrame:
        """(term, df) of the words with a beginning."""
        return self._read("terms").filter(F.col("term").startswith(prefix)).groupBy("term").agg(F.sum("df").alias("df"))

    def status(self, docs: DataFrame, key: str) -> DataFrame:
        """(n_table, n_index, n_missing, n_orphans, coverage): the index beside the table it was made of."""
        own, have = docs.select(F.col(key).alias("key")).filter("key is not null").distinct(), self.documents().select("key")
        j = own.withColumn("a", F.lit(1)).join(have.withColumn("b", F.lit(1)), "key", "full_outer")
        return j.agg(F.count("a").alias("n_table"), F.count("b").alias("n_index"), F.count_if(F.col("b").isNull()).alias("n_missing"), F.count_if(F.col("a").isNull()).alias("n_orphans"), F.round(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.greatest(F.lit(1), F.count("a")), 6).alias("coverage"))


def index_of(spark: SparkSession, path: str, key: str, text: str | Column, docs: DataFrame | None = None) -> Index:
    """The index over a table, kept in the shared folder under the table's state; built where there is none yet.

    Of a table's earlier states the latest one's index stays, for queries that still read it; older ones go.
    """
    name = lambda x: hashlib.sha256(repr(x).encode()).hexdigest()[:16]
    own, state = name((path, key, str(text))), name(Store(spark, path).mark())
    folder = Store(spark, shared_folder(spark))
    ix = Index(spark, f"{folder.root}/index-{own}-{state}")
    if not ix.meta["generations"] or not all(g.get("weighed") for g in ix.meta["generations"]):
        docs = spark.read.parquet(path) if docs is None else docs
        bytes_in, _ = Store(spark, path).mark()
        # a folder holds the postings of about 256 MB of text
        ix.build(docs, key, text, buckets=int(min(4096, max(16, bytes_in // 2**28))), salts=int(min(64, max(1, bytes_in // 2**32))))
        others = [n for n in folder.names() if n.startswith(f"index-{own}-") and not n.endswith(state)]
        for n in sorted(others, key=lambda n: folder.mark(n)[1])[:-1]:
            folder.delete(n)
    return ix
