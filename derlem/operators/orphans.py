"""References to records that do not exist.

A blocked Bloom filter of the parent keys is built by the executors as bitmaps of 32,768 bits and
broadcast; its size is capped by ``MAX_BLOCKS`` (4 KB each) whatever the number of parents. A
reference whose bits are not all set is a proven orphan. Only the others are verified by an exact
join. Keys that hold more than ``HOT_SHARE`` of the references (at most 1/HOT_SHARE of them) are
joined by broadcast, so that no task receives a popular parent's references.

Defined results: a null reference is none; an empty string refers to the empty key; repeated rows
are judged each; with no parents at all every reference is an orphan; a null time is never late
and its period is the empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from derlem.session import cut

BLOCK_BITS = 32_768
MAX_BLOCKS = 4_096  # 16 MB at most
HASHES = 6
BITS_PER_KEY = 12
HOT_SHARE = 1e-3
HOT_LEAST = 10_000


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _positions(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(7))
    a, b = F.pmod(h, F.lit(BLOCK_BITS)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(BLOCK_BITS // 2)) * 2 + 1
    return [F.pmod(a + b * i, F.lit(BLOCK_BITS)) for i in range(HASHES)]


def bloom_blocks(keys: DataFrame, key: str) -> tuple[DataFrame, int, bool]:
    """(block, bits) rows of the filter, the number of blocks, and whether it has four bits a key. ``keys`` need not be distinct."""
    n = keys.count()
    blocks = max(1, min(MAX_BLOCKS, -(-n * BITS_PER_KEY // BLOCK_BITS)))
    put = keys.select(_block(F.col(key), blocks).alias("block"), F.explode(F.array(*_positions(F.col(key)))).alias("p"))
    return put.groupBy("block").agg(F.bitmap_construct_agg("p").alias("bits")), blocks, n * 4 <= MAX_BLOCKS * BLOCK_BITS


def _words(bits: Column) -> Column:
    """A block's bitmap as 64-bit numbers, made once a block, so that a row tests a bit without cutting bytes."""
    return F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda i: F.conv(F.hex(F.substring(bits, i * 8 + 1, F.lit(8))), 16, -10).cast("long"))


def _bit(words: Column, p: Column) -> Column:
    # bytes of a word stand from its highest to its lowest
    at = (7 - F.shiftright(p.bitwiseAND(F.lit(63)), 3)) * 8 + p.bitwiseAND(F.lit(7))
    return F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), at.cast("int")) == 1


def split_by_filter(refs: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """``refs`` with ``maybe``: false where the filter proves that no parent has the key.

    Beyond the number of parents at which ``MAX_BLOCKS`` give a key four bits the filter would prove next to nothing: then
    none is built and every reference is left to the exact join.
    """
    bits, blocks, useful = bloom_blocks(parents, key)
    if not useful:
        return refs.withColumn("maybe", F.lit(True))
    r = refs.withColumn("_block", _block(F.col(key), blocks)).join(F.broadcast(bits.select(F.col("block").alias("_block"), _words(F.col("bits")).alias("_words"))), "_block", "left")
    hit = None
    for p in _positions(F.col(key)):
        one = _bit(F.col("_words"), p)
        hit = one if hit is None else hit & one
    return r.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("_block", "_words")


def find_orphans(refs: DataFrame, parents: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows of ``refs`` with ``orphan_kind`` (missing, deleted, late).

    ``refs``: key, created_at and any other columns. ``parents``: key, created_at (may repeat; the
    earliest time counts). ``deleted``: key (may repeat).
    """
    # the parent's earliest time, one row per key; what the log of deletions says matters only where no parent is left
    own = parents.groupBy("key").agg(F.min("created_at").alias("_since"), F.lit(True).alias("_there"))
    log = deleted.select("key").distinct().withColumn("_gone", F.lit(True))
    # narrow rows that several branches read: judged once
    judged = cut(split_by_filter(refs, own.select("key"), "key"))
    hot = judged.groupBy("key").count()
    hot = hot.join(F.broadcast(judged.agg(F.count("*").alias("_n"))), F.col("count") >= F.greatest(F.lit(HOT_LEAST), F.col("_n") * HOT_SHARE)).select("key", F.lit(True).alias("_hot"))
    facts = own.join(log, "key", "full_outer")
    flagged = judged.join(F.broadcast(hot), "key", "left")
    few = facts.join(F.broadcast(hot.select("key")), "key", "left_semi")
    popular = flagged.filter("_hot").join(F.broadcast(few), "key", "left")
    sure = flagged.filter("_hot is null and not maybe").join(log, "key", "left").withColumns({"_since": F.lit(None).cast("timestamp"), "_there": F.lit(False)})
    rest = flagged.filter("_hot is null and maybe").join(facts, "key", "left")
    out = popular.unionByName(rest).unionByName(sure)
    there = F.coalesce(F.col("_there"), F.lit(False))
    kind = F.when(~there & F.col("_gone").isNotNull(), "deleted").when(~there, "missing").when(F.col("_since") > F.col("created_at"), "late")
    return out.withColumn("orphan_kind", kind).filter("orphan_kind is not null").drop("_since", "_gone", "_there", "_hot", "maybe")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, field, kind and period, with the number of distinct keys."""
    return orphans.groupBy("src_table", "ref_field", "orphan_kind", "period_ym").agg(F.count("*").alias("n_refs"), F.countDistinct("key").alias("n_keys"))
