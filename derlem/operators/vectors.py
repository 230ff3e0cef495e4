"""Dense vectors: exact scan, best per group, and an inverted file over k-means cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from derlem.sources.store import Store

#: Axes that bound a cosine before it is computed.
HEAD = 6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null, of length 0 or of another dimension."""
    z = norm(a) * norm(b)
    return F.when((z > 0) & (F.size(a) == F.size(b)), dot(a, b) / z)


def exact(vectors: DataFrame, key: str, vector: str, query: DataFrame) -> DataFrame:
    """(key, score) of all vectors against a single query vector (one row ``q``), positive scores only."""
    return vectors.join(F.broadcast(query)).select(*[c for c in vectors.columns if c != vector], cosine(F.col(vector), F.col("q")).alias("score")).filter("score > 0")


def two_phase(vectors: DataFrame, key: str, vector: str, query: DataFrame, k: int, factor: int = 20, least: int = 200) -> DataFrame:
    """(key, score) of the k nearest: all vectors scored with eight bits a number, the best max(factor * k, least) of them exactly."""
    v = whole(vectors, key, vector)
    size = F.array_max(F.transform("v", F.abs))
    small = v.select("key", F.transform("v", lambda x: F.round(x / size * 127).cast("byte")).alias("c"))
    rough = small.join(F.broadcast(query)).select("key", cosine(F.col("c"), F.col("q")).alias("score")).orderBy(F.col("score").desc(), "key").limit(max(factor * k, least))
    s = v.join(F.broadcast(rough.select("key")), "key").join(F.broadcast(query)).select(F.col("key").alias(key), cosine(F.col("v"), F.col("q")).alias("score"))
    return s.filter("score > 0").orderBy(F.col("score").desc(), key).limit(k)


def best_per(scored: DataFrame, group: str, key: str) -> DataFrame:
    """The best row of each group; ties go to the smaller key."""
    return scored.groupBy(group).agg(F.max(F.struct("score", (-F.col(key)).alias("k"))).alias("b")).select(group, (-F.col("b.k")).alias(key), F.col("b.score").alias("score"))


def fuzzy_pairs(vectors: DataFrame, least: float = 0.85, most_days: int = 365, salts: int = 8) -> DataFrame:
    """(doc_a, source_a, doc_b, source_b, score, n_links, date_gap, confidence) of suspected duplicates; nothing is merged.

    ``vectors``: one row per chunk with k, document_id, source, provider_id, vector, court, clusters (array), iso and dotted
    (the date as read in either writing). Every chunk meets every other one of its court and provider, and the best pair of
    chunks counts. Records of one cluster are known already; a date gap counts where both dates have the same writing. A bound
    of the cosine from the first ``HEAD`` axes and the length of the rest drops most pairs, and never one that is alike, before
    the exact cosine. The work grows with the square of the largest court, which is salted.
    """
    n = norm(F.col("vector"))
    u = vectors.filter(n > 0).select("*", F.transform("vector", lambda x: x.cast("double") / n).alias("u"), F.size("vector").alias("dim")).drop("vector")
    axes = [f"h{i}" for i in range(HEAD)]
    u = u.withColumns({h: F.coalesce(F.get("u", F.lit(i)), F.lit(0.0)) for i, h in enumerate(axes)}).withColumn("rest", norm(F.slice("u", HEAD + 1, F.greatest(F.col("dim") - HEAD, F.lit(0)))))
    own = ["k", "document_id", "source", "clusters", "iso", "dotted", "u", *axes, "rest"]
    on = ["court", "provider_id", "dim", "salt"]
    a = u.withColumn("salt", F.pmod(F.xxhash64("k", "u"), F.lit(salts)).cast("int")).select(*on, *[F.col(c).alias(f"{c}_a") for c in own])
    b = u.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(*on, *[F.col(c).alias(f"{c}_b") for c in own])
    gap = F.coalesce(*[F.abs(F.date_diff(f"{c}_a", f"{c}_b")) for c in ("iso", "dotted")])
    bound = sum((F.col(f"{h}_a") * F.col(f"{h}_b") for h in axes), F.col("rest_a") * F.col("rest_b"))
    j = a.join(b, on).filter((bound >= least - 1e-9) & (F.col("k_a") < F.col("k_b")) & ~F.arrays_overlap("clusters_a", "clusters_b") & F.coalesce(gap <= most_days, F.lit(True)))
    # behind a generator, so that the exact cosine is not pulled into the join's condition
    j = j.select("*", gap.alias("gap"), F.inline(F.array(F.struct(dot(F.col("u_a"), F.col("u_b")).alias("s"))))).filter(F.col("s") >= least)
    g = j.groupBy("k_a", "k_b").agg(*[F.first(f"{c}_{x}").alias(f"{o}_{x}") for x in "ab" for c, o in (("document_id", "doc"), ("source", "source"))], F.max("s").alias("s"), F.count("*").alias("n_links"), F.first("gap").alias("date_gap"))
    confidence = F.when(F.col("s") > 0.95, "high").when(F.col("s") > 0.9, "medium").otherwise("low")
    return g.select("doc_a", "source_a", "doc_b", "source_b", F.round("s", 6).alias("score"), "n_links", "date_gap", confidence.alias("confidence"))


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_list()).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _best(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best of each row; ties go to the smaller key."""
    order = np.lexsort((np.broadcast_to(keys, scores.shape), -scores), axis=1)[:, :k]
    return np.repeat(np.arange(len(scores)), order.shape[1]), order.ravel()


def whole(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v) of the vectors that have a direction: not null, not of length 0."""
    return vectors.filter(F.col(key).isNotNull() & (norm(F.col(vector)) > 0)).select(F.col(key).alias("key"), F.col(vector).alias("v"))


def exact_top(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int = 10, *, block: int = 1_000, part: int = 20_000) -> DataFrame:
    """(qid, key, score, rank): the k nearest by cosine of every query (qid, q) among all vectors of its dimension.

    Blocks of ``block`` queries meet parts of ``part`` vectors, each pair in one matrix product; of every pair only the k best go on.
    """
    v = whole(vectors, key, vector)
    q = whole(queries, "qid", "q")
    n_q, n_v = (max(1, -(-df.count() // size)) for df, size in ((q, block), (v, part)))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.select("key", "v", F.size("v").alias("dim"), number("key", n_v).alias("part"), every(n_q).alias("block"))
    q = q.select(F.col("key").alias("qid"), F.col("v").alias("q"), F.size("v").alias("dim"), number("key", n_q).alias("block"), every(n_v).alias("part"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"qid": [], "key": [], "score": []})
        s = _unit(a["q"]) @ _unit(b["v"]).T
        keys = b["key"].to_numpy()
        i, j = _best(s, keys, k)
        return pd.DataFrame({"qid": a["qid"].to_numpy()[i], "key": keys[j], "score": s[i, j]})

    kinds = {f: df.schema[f].dataType.simpleString() for f, df in (("qid", q), ("key", v))}
    got = q.groupBy("dim", "block", "part").cogroup(v.groupBy("dim", "block", "part")).applyInPandas(meet, f"qid {kinds['qid']}, key {kinds['key']}, score double")
    return ranked(got, k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "key")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def merge_best(parts: list[DataFrame], key: str) -> DataFrame:
    """The union of scored sets (key, score), each key once with its best score: a large index and what was added since."""
    u = parts[0].select(key, "score")
    for p in parts[1:]:
        u = u.unionByName(p.select(key, "score"))
    return u.groupBy(key).agg(F.max("score").alias("score"))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centres of at most ``k`` cells; a cell that runs empty takes a row far from its centre."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = (c * c).sum(1)[None, :] - 2 * x @ c.T
        near = d.argmin(1)
        n = np.bincount(near, minlength=len(c))
        new = np.zeros_like(c)
        np.add.at(new, near, x)
        c = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], c)
        for empty in np.flatnonzero(n == 0):
            c[empty] = x[(d[np.arange(len(x)), near] + r.random(len(x)) * 1e-9).argmax()]
    return c


def read_sidecars(spark: SparkSession, folder: str, dims: int | None = None) -> DataFrame:
    """The vectors of ``folder``/vectors with the keys of ``folder``/keys, matched by ``row``; refused where they do not fit.

    Both must have the same number of rows, all vectors one dimension, and all keys one version of chunking.
    """
    v, k = spark.read.parquet(f"{folder}/vectors"), spark.read.parquet(f"{folder}/keys")
    a = v.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    b = k.agg(F.count("*").alias("n"), F.count_distinct("chunk_version").alias("versions")).first()
    if a["n"] != b["n"]:
        raise ValueError(f"{a['n']} vectors for {b['n']} keys")
    if a["n"] and (a["low"] != a["high"] or (dims and a["low"] != dims) or b["versions"] > 1):
        raise ValueError(f"dimensions {a['low']} to {a['high']}, {b['versions']} versions of chunking")
    return k.join(v, "row")


class InvertedFile:
    """Cells of a k-means over unit vectors, with product-quantised codes; a query scans the codes of its nearest cells, and the
    best of them are scored again by their exact vectors.

    The quantisers are fitted on at most ``fit_rows`` vectors drawn by hash (their only bound); every vector is indexed. The index
    is a table (cell, key, code) in folders by cell, and the quantisers, a few thousand numbers, are kept beside it. Vectors of
    another dimension are refused.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.store = spark, root, Store(spark, root)
        meta = self.store.read("QUANTISER.json")
        if meta:
            self.centres, self.books = np.array(meta["centres"]), [np.array(b) for b in meta["books"]]
            self.batches = meta["batches"]

    @classmethod
    def build(cls, vectors: DataFrame, key: str, vector: str, root: str, *, cells: int, parts: int = 16, codes: int = 256, fit_rows: int = 100_000, seed: int = 1) -> InvertedFile:
        ix = cls(vectors.sparkSession, root)
        v = whole(vectors, key, vector)
        share = max(1, -(-v.count() // fit_rows))
        sample = v.filter(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).limit(fit_rows).select("v").toPandas()
        if sample.empty:
            raise ValueError("an index needs at least one vector to be fitted on")
        x = _unit(sample["v"])
        ix.centres = kmeans(x, cells, seed=seed)
        ix.books = [kmeans(p, codes, seed=seed) for p in np.array_split(x, min(parts, x.shape[1]), axis=1)]
        ix.batches = []
        ix.store.delete()
        ix._add(v, 0)
        return ix

    def append(self, vectors: DataFrame, key: str, vector: str) -> InvertedFile:
        """Index more vectors under the quantisers there are; keys that are in the index are left out."""
        v = whole(vectors, key, vector)
        other = v.filter(F.size("v") != self.centres.shape[1]).limit(1).count()
        if other:
            raise ValueError(f"the index holds vectors of dimension {self.centres.shape[1]}")
        self._add(v.join(self.codes().select("key"), "key", "left_anti"), max(self.batches) + 1)
        return self

    def _add(self, v: DataFrame, number: int) -> None:
        centres, books = self.centres, self.books

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if b.empty:
                    continue
                x = _unit(b["v"])
                cell = (x @ centres.T - (centres * centres).sum(1) / 2).argmax(1)
                own = [(p @ m.T - (m * m).sum(1) / 2).argmax(1).astype(np.uint8) for p, m in zip(np.array_split(x, len(books), axis=1), books)]
                yield pd.DataFrame({"key": b["key"], "cell": cell.astype(np.int32), "code": [c.tobytes() for c in np.stack(own, 1)]})

        kind = v.schema["key"].dataType.simpleString()
        coded = v.filter(F.size("v") == self.centres.shape[1]).mapInPandas(run, f"key {kind}, cell int, code binary")
        coded.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.root}/codes/batch={number}")
        self.batches = [*self.batches, number]
        self.store.write("QUANTISER.json", {"centres": self.centres.tolist(), "books": [b.tolist() for b in self.books], "batches": self.batches})

    def codes(self) -> DataFrame:
        """(key, cell, code) of all batches that count."""
        return self.spark.read.option("basePath", f"{self.root}/codes").parquet(*[f"{self.root}/codes/batch={n}" for n in self.batches]).select("key", "cell", "code")

    def search(self, queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int = 10, *, probe: int = 8, refine: int = 200, salts: int = 4) -> DataFrame:
        """(qid, key, score, rank) for ``queries`` (qid, q): codes of the ``probe`` nearest cells, then exact cosine of the best ``refine``.

        Within a cell, split by ``salts``, all codes are scored for all queries that probe it and only the best go on.
        """
        centres, books = self.centres, self.books

        def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    near = np.argsort(-(_unit(b["v"]) @ centres.T - (centres * centres).sum(1) / 2), axis=1, kind="stable")[:, :probe]
                    yield pd.DataFrame({"qid": np.repeat(b["key"].to_numpy(), near.shape[1]), "q": [v for v in b["v"] for _ in range(near.shape[1])], "cell": near.ravel().astype(np.int32)})

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if a.empty or b.empty:
                return pd.DataFrame({"qid": [], "key": [], "score": []})
            own = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), len(books))
            x = np.array_split(_unit(a["q"]), len(books), axis=1)
            s = sum((x[m] @ books[m].T)[:, own[:, m]] for m in range(len(books)))
            keys = b["key"].to_numpy()
            i, j = _best(s, keys, refine)
            return pd.DataFrame({"qid": a["qid"].to_numpy()[i], "key": keys[j], "score": s[i, j]})

        q = whole(queries, "qid", "q").filter(F.size("v") == self.centres.shape[1])
        code = self.codes()
        kinds = {"qid": q.schema["key"].dataType.simpleString(), "key": code.schema["key"].dataType.simpleString()}
        asked = q.mapInPandas(probes, f"qid {kinds['qid']}, q array<double>, cell int").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        held = code.withColumn("s", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int"))
        rough = asked.groupBy("cell", "s").cogroup(held.groupBy("cell", "s")).applyInPandas(meet, f"qid {kinds['qid']}, key {kinds['key']}, score double")
        few = ranked(rough, refine).select("qid", "key")
        exact_ = few.join(whole(vectors, key, vector), "key").join(q.select(F.col("key").alias("qid"), F.col("v").alias("q")), "qid").select("qid", "key", cosine(F.col("v"), F.col("q")).alias("score"))
        return ranked(exact_, k)
