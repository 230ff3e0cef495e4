"""Near-duplicate texts with small edits, across a collection too large for pairwise comparison.

Texts with the same words are one class. Each class gets MinHash values of its distinct word runs;
``BANDS`` groups of ``ROWS`` values are the shards a class belongs to, so shards overlap and a pair
on the edge of one lies within another. One bit of each value makes a 64-bit fingerprint, whose
Hamming distance falls with similarity. Within a shard a vantage-point tree over the fingerprints
is searched with a radius that keeps a pair at similarity 0.6 with probability 0.9998 in each shard
they share; branches are pruned by the triangle inequality. What remains is verified on the full
sets of runs. Shards too small for a tree (``LEAF``) are compared as its leaves are.

A shard above ``SHARD`` classes is split into blocks that meet pairwise in different tasks: every
pair meets once, no task receives the whole shard. Which shards are that large is estimated from a
sixteenth of the postings; the estimate decides on the split only, never on what is compared.

The shards alone lose a pair at similarity s with probability (1 - s^ROWS)^BANDS: 0.0004 at 0.6,
under 1e-8 at 0.8.

Defined results: null and short texts (below ``min_words``) are in no pair; repeated deliveries of
an id count once; classes of up to ``expand`` copies come out with all pairs, larger ones as a star
around their smallest id; pairs between classes hold for their members likewise.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from derlem.operators.orphans import split_by_filter
from derlem.session import cut

BANDS, ROWS = 32, 3
BITS = 64
RADIUS = 24
SHARD = 4_096
LEAF = 4
PLAN = 16
_WORD = re.compile(r"[^\W_]+")
_RNG = np.random.default_rng(20_240_501)
_A = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_P = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


class _Hashes(dict):
    """64-bit hashes of words, the same in every process; each word is hashed once a worker."""

    def __missing__(self, word: str) -> int:
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


_known = _Hashes()


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _word_hashes(words: list[str]) -> np.ndarray:
    # the look-up holds what recurs; it starts anew before it grows without bound
    if len(_known) > 1_000_000:
        _known.clear()
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def runs(words: list[str], size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` consecutive words."""
    h = _word_hashes(words)
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = (out ^ (out >> np.uint64(31))) * _P[0] + h[i : i + n] * _P[i + 1]
        out ^= out >> np.uint64(33)
        out *= _P[40]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def minhash(sh: np.ndarray) -> np.ndarray:
    """Minima of the hash family over a set of runs, in blocks that stay in the cache."""
    best = np.full(len(_A), 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(sh), 128):
            np.minimum(best, (sh[i : i + 128, None] * _A).min(axis=0), out=best)
    return best


def sketch(sh: np.ndarray) -> tuple[list[int], int]:
    """Shard keys (one per band) and the fingerprint."""
    m = minhash(sh)
    with np.errstate(over="ignore"):
        g = m.reshape(BANDS, ROWS)
        k = np.arange(1, BANDS + 1, dtype=np.uint64) * _P[50]
        for r in range(ROWS):
            k = (k ^ (k >> np.uint64(30))) * _P[51] + g[:, r] * _P[52 + r]
        k ^= k >> np.uint64(32)
        bits = ((m[:BITS] * _P[60]) >> np.uint64(63)).astype(np.uint64)
    fp = int((bits << np.arange(BITS, dtype=np.uint64)).sum())
    return k.view(np.int64).tolist(), int(np.array([fp], np.uint64).view(np.int64)[0])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) + len(b) else 0.0


class VantageTree:
    """A vantage-point tree over 64-bit fingerprints under Hamming distance, built without recursion."""

    def __init__(self, fps: np.ndarray, leaf: int = LEAF) -> None:
        self.fps = fps
        self.nodes: list[tuple] = []  # (vantage, radius, inner, outer) or (None, members)
        todo = [(np.arange(len(fps)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            at = len(self.nodes)
            if parent >= 0:
                node = list(self.nodes[parent])
                node[side] = at
                self.nodes[parent] = tuple(node)
            if len(rows) <= leaf:
                self.nodes.append((None, rows))
                continue
            v, rest = rows[0], rows[1:]
            dist = np.bitwise_count(fps[rest] ^ fps[v]).astype(np.int64)
            mu = int(np.median(dist))
            inner, outer = rest[dist <= mu], rest[dist > mu]
            if not len(outer):  # equal distances do not split: all of them are one leaf
                self.nodes.append((None, rows))
                continue
            self.nodes.append((v, mu, -1, -1))
            todo += [(inner, at, 2), (outer, at, 3)]

    def near(self, fp: np.uint64, radius: int) -> np.ndarray:
        """Members within ``radius`` of ``fp``."""
        found, todo = [], [0] if self.nodes else []
        while todo:
            node = self.nodes[todo.pop()]
            if node[0] is None:
                rows = node[1]
                found.append(rows[np.bitwise_count(self.fps[rows] ^ fp) <= radius])
                continue
            v, mu, inner, outer = node
            d = int(np.bitwise_count(self.fps[v] ^ fp))
            if d <= radius:
                found.append(np.array([v]))
            if d - radius <= mu:
                todo.append(inner)
            if d + radius > mu:
                todo.append(outer)
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def shard_pairs(ids: np.ndarray, fps: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pairs within the radius, smaller id first.

    ``side``: 0 for members of the first block, 1 of the second; without it all meet all.
    """
    put = np.arange(len(ids)) if side is None else np.flatnonzero(side == 0)
    ask = put if side is None else np.flatnonzero(side == 1)
    tree = VantageTree(fps[put])
    a, b = [], []
    for q in ask:
        got = ids[put[tree.near(fps[q], RADIUS)]]
        got = got[got > ids[q]] if side is None else got[got != ids[q]]
        a.append(np.minimum(got, ids[q]))
        b.append(np.maximum(got, ids[q]))
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def small_pairs(ids: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for many shards of one small size at once: rows are shards."""
    i, j = np.triu_indices(ids.shape[1], 1)
    near = np.bitwise_count(fps[:, i] ^ fps[:, j]) <= RADIUS
    x, y = ids[:, i][near], ids[:, j][near]
    return np.minimum(x, y), np.maximum(x, y)


def _class(words: list[str]) -> bytes:
    """What texts with the same words have in common."""
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _sketches(key: str, text: str, size: int, min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t in zip(b[key].tolist(), b[text].tolist()):
                words = words_of(t) if t else []
                if len(words) < min_words:
                    continue
                sh = runs(words, size)
                bands, fp = sketch(sh)
                out.append((k, _class(words), len(sh), fp, bands))
            yield pd.DataFrame(out, columns=["id", "cls", "n", "fp", "bands"])

    return run


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        sizes = b["ids"].map(len).to_numpy()
        for m in np.unique(sizes):
            part = b[sizes == m]
            if "sides" not in b and m <= LEAF:
                out.append(small_pairs(np.stack(part["ids"].tolist()), np.stack(part["fps"].tolist()).view(np.uint64)))
                continue
            for r in part.itertuples():
                out.append(shard_pairs(r.ids, r.fps.view(np.uint64), r.sides if "sides" in b and (r.sides != 2).any() else None))
        x = np.concatenate([p[0] for p in out]) if out else np.zeros(0, np.int64)
        y = np.concatenate([p[1] for p in out]) if out else np.zeros(0, np.int64)
        yield pd.DataFrame({"a": x, "b": y}).drop_duplicates()


def _sets(text: str, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [words_of(t) if t else [] for t in b[text]]
            yield pd.DataFrame({"c": b["c"], "cls": [_class(w) for w in words], "sh": [runs(w, size).view(np.int64) for w in words]})

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = [jaccard(x, y) for x, y in zip(b["sha"], b["shb"])]
            keep = np.array(s) >= threshold if len(s) else np.zeros(0, bool)
            yield pd.DataFrame({"a": b["a"][keep], "b": b["b"][keep], "similarity": np.array(s)[keep]})

    return run


def near_duplicates(docs: DataFrame, key: str, text: str, *, size: int = 5, threshold: float = 0.8, min_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, c) with the class of every text long enough, and (a, b, similarity) between classes.

    ``key`` may repeat where a record was delivered again. A class is named by a 64-bit number made of its words' hash.
    """
    kind = docs.schema[key].dataType.simpleString()
    sk = docs.select(key, text).mapInPandas(_sketches(key, text, size, min_words), f"id {kind}, cls binary, n int, fp long, bands array<long>")
    sk = cut(sk.withColumn("c", F.xxhash64("cls")))
    members = cut(sk.groupBy("id").agg(F.min("c").alias("c")))
    reps = sk.groupBy("c").agg(F.first(F.struct("fp", "bands")).alias("s"))
    posts = reps.select("c", F.col("s.fp").alias("fp"), F.explode("s.bands").alias("band"))
    sample = sk.filter(F.pmod(F.xxhash64("c", F.lit(3)), F.lit(PLAN)) == 0).select("c", "bands").dropDuplicates(["c"]).select(F.explode("bands").alias("band"))
    # at most one shard in SHARD postings is large; they are few, but their number is not assumed
    large = cut(sample.groupBy("band").count().filter(F.col("count") * PLAN > SHARD).withColumn("blocks", F.ceil(F.col("count") * PLAN / (SHARD // 2)).cast("int")).select("band", "blocks"))
    lists = [F.collect_list("c").alias("ids"), F.collect_list("fp").alias("fps")]
    if large.isEmpty():
        pairs = posts.groupBy("band").agg(*lists).filter(F.size("ids") > 1).select("ids", "fps").mapInPandas(_search, "a long, b long")
    else:
        few = posts.join(large, "band", "left_anti").groupBy("band").agg(*lists)
        big = posts.join(large, "band").withColumn("i", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
        big = big.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = big.withColumns({"lo": F.least("i", "j"), "hi": F.greatest("i", "j"), "side": F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1)})
        many = cells.groupBy("band", "lo", "hi").agg(*lists, F.collect_list("side").alias("sides"))
        pairs = few.filter(F.size("ids") > 1).select("ids", "fps").mapInPandas(_search, "a long, b long")
        pairs = pairs.unionByName(many.filter(F.size("ids") > 1).select("ids", "fps", "sides").mapInPandas(_search, "a long, b long"))
    pairs = cut(pairs.distinct())
    # only texts of classes in a candidate pair are read again; a filter of bounded size keeps the others from moving
    wanted = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    who = cut(sk.select("id", "c").join(wanted, "c", "left_semi").groupBy("c").agg(F.min("id").alias("rep")).withColumn("key", F.col("rep").cast("string")))
    texts = split_by_filter(docs.select(F.col(key).alias("rep"), text, F.col(key).cast("string").alias("key")), who, "key").filter("maybe").drop("maybe", "key")
    sets = texts.join(who.drop("key"), "rep").select("c", text).mapInPandas(_sets(text, size), "c long, cls binary, sh array<long>")
    # an id may have been delivered with another text as well
    sets = sets.filter(F.col("c") == F.xxhash64("cls")).drop("cls")
    # both sides of the join read one exchange of the sets
    full = pairs.join(sets.withColumnsRenamed({"c": "a", "sh": "sha"}), "a").join(sets.withColumnsRenamed({"c": "b", "sh": "shb"}), "b")
    return members, cut(full.mapInPandas(_verify(threshold), "a long, b long, similarity double").distinct())


def document_pairs(members: DataFrame, links: DataFrame, *, expand: int = 64) -> DataFrame:
    """(doc_a, doc_b) in code-point order, from classes and the links between them."""
    by = members.groupBy("c").agg(F.count("*").alias("k"), F.min("id").alias("rep"))
    # narrow rows that each of the three kinds of pairs reads
    placed = cut(members.join(by, "c"))
    few, many = placed.filter((F.col("k") > 1) & (F.col("k") <= expand)), placed.filter(F.col("k") > expand)
    inside = few.alias("x").join(few.alias("y"), (F.col("x.c") == F.col("y.c")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("doc_a"), F.col("y.id").alias("doc_b"))
    star = many.filter("id <> rep").select(F.col("rep").alias("doc_a"), F.col("id").alias("doc_b"))
    # members of large classes are held by their representative in links to other classes
    holders = placed.filter((F.col("k") <= expand) | (F.col("id") == F.col("rep"))).select("c", "id")
    across = links.select("a", "b").join(holders.withColumnsRenamed({"c": "a", "id": "x"}), "a").join(holders.withColumnsRenamed({"c": "b", "id": "y"}), "b")
    across = across.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).filter("doc_a <> doc_b")
    return inside.unionByName(star).unionByName(across)


def components(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, group, n_links): every member with the smallest class name reachable from its own.

    Classes hand on the smallest name they know along links until nothing changes; names jump over
    their own name's name each round, so the number of rounds grows with the logarithm of a
    group's diameter.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    names = cut(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("g"), F.count("*").alias("n_links")))
    changed = True
    while changed:
        heard = both.join(names.select(F.col("a").alias("b"), F.col("g").alias("h")), "b").groupBy("a").agg(F.min("h").alias("h"))
        new = names.join(heard, "a").select("a", F.least("g", "h").alias("g2"), "g", "n_links")
        jump = names.select(F.col("a").alias("g2"), F.col("g").alias("far"))
        new = cut(new.join(jump, "g2", "left").select("a", F.least("g2", F.coalesce("far", "g2")).alias("g"), F.col("g").alias("old"), "n_links"))
        changed = not new.filter("g <> old").isEmpty()
        names = new.drop("old")
    return members.join(names.withColumnRenamed("a", "c"), "c", "left").select("id", F.coalesce("g", "c").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
