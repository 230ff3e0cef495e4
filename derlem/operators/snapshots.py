"""What changed between full snapshots of a table.

Within a snapshot the latest delivery of a key holds. Consecutive snapshots meet in one full
outer join on the primary key, which carries only fixed-size canonical hashes: a side that is
missing is an addition or a removal, unequal hashes are a change. The wide columns are hashed
before the first shuffle and never travel.

Defined results: a null key is no record; null and blank attributes are equal; letter case
counts; repeated deliveries and repeated rows count once (latest time, then largest tie column;
a null time is earliest); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from derlem.functions.keys import fold_key, is_blank, strip


def attributes_hash(*cols: str) -> Column:
    """Hash of trimmed attributes; null equals empty, and no value can pass for two."""
    return F.xxhash64(*[F.coalesce(strip(F.col(c).cast("string")), F.lit("")) for c in cols], *[F.crc32(F.encode(F.coalesce(strip(F.col(c).cast("string")), F.lit("")), "utf-8")) for c in cols])


def latest_hashes(df: DataFrame, *, key: str, snapshot: str, attributes: list[str], content: str, content_hash: str, time: str, tie: str) -> DataFrame:
    """One narrow row per snapshot and key: identity, attribute hash and content hashes.

    ``content`` blank: ``stored`` holds the delivered hash instead. Otherwise ``exact`` is the
    SHA-256 of the content as delivered and ``trimmed`` that of the content without blanks around.
    """
    no_content = is_blank(content)
    row = F.struct(
        strip(key).alias("key"),
        attributes_hash(*attributes).alias("attrs"),
        F.when(~no_content, F.sha2(F.encode(F.col(content), "utf-8"), 256)).alias("exact"),
        F.when(~no_content, F.sha2(F.encode(strip(content), "utf-8"), 256)).alias("trimmed"),
        F.when(no_content & ~is_blank(content_hash), fold_key(content_hash)).alias("stored"),
    )
    order = F.struct(F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(-(2**62))), F.col(tie))
    return df.filter(~is_blank(key) & F.col(snapshot).isNotNull()).groupBy(F.col(snapshot).alias("snap"), fold_key(key).alias("k")).agg(F.max_by(row, order).alias("r"))


def same_content(a: Column, b: Column) -> Column:
    """Whether two records' contents agree; a stored hash stands for a missing content."""
    both = a["trimmed"] == b["trimmed"]
    one = F.when(a["stored"].isNotNull(), (a["stored"] == b["exact"]) | (a["stored"] == b["trimmed"])).when(b["stored"].isNotNull(), (b["stored"] == a["exact"]) | (b["stored"] == a["trimmed"]))
    has = lambda x: x["trimmed"].isNotNull()
    return F.when(has(a) & has(b), both).when(has(a) | has(b), F.coalesce(one, F.lit(False))).otherwise(a["stored"].eqNullSafe(b["stored"]))


def snapshot_changes(df: DataFrame, *, key: str, snapshot: str, attributes: list[str], content: str, content_hash: str, time: str, tie: str) -> DataFrame:
    """(snapshot, key, change_kind, attributes_changed, content_changed) per difference to the snapshot before.

    Deliveries are compared in the order of their numbers; a gap in the numbers is no delivery.
    """
    rows = latest_hashes(df, key=key, snapshot=snapshot, attributes=attributes, content=content, content_hash=content_hash, time=time, tie=tie)
    # one number per delivery of the whole table: a handful, whatever the number of rows
    numbers = sorted(r[0] for r in df.select(snapshot).filter(F.col(snapshot).isNotNull()).distinct().collect())
    following = dict(zip(numbers, numbers[1:]))
    if not following:
        return rows.select(F.col("snap").alias(snapshot), F.col("k").alias(key), F.lit("").alias("change_kind"), F.lit(False).alias("attributes_changed"), F.lit(False).alias("content_changed")).limit(0)
    nxt = F.create_map(*[F.lit(x) for kv in following.items() for x in kv])
    old = rows.select(F.try_element_at(nxt, F.col("snap")).alias("snap"), "k", F.col("r").alias("a")).filter(F.col("snap").isNotNull())
    new = rows.filter(F.col("snap") != numbers[0]).withColumnRenamed("r", "b")
    a, b = F.col("a"), F.col("b")
    both = old.join(new, ["snap", "k"], "full_outer")
    attrs, cont = a["attrs"] != b["attrs"], ~same_content(a, b)
    kind = F.when(a.isNull(), "added").when(b.isNull(), "removed").when(attrs | cont, "changed")
    return both.withColumn("change_kind", kind).filter("change_kind is not null").select(
        F.col("snap").alias(snapshot), F.coalesce(b["key"], a["key"]).alias(key), "change_kind",
        F.coalesce(attrs, F.lit(False)).alias("attributes_changed"), F.coalesce(cont, F.lit(False)).alias("content_changed"),
    )
