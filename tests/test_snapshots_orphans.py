import hashlib
import random
from datetime import datetime

from pyspark.sql import functions as F

from derlem.operators.orphans import find_orphans, orphan_report, split_by_filter
from derlem.operators.snapshots import snapshot_changes

SCHEMA = "row_id long, snapshot_no int, mevzuat_id string, ad string, metin string, metin_hash string, t timestamp, k string"
KW = dict(key="mevzuat_id", snapshot="snapshot_no", attributes=["ad"], content="metin", content_hash="metin_hash", time="t", tie="row_id")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def changes(spark, rows):
    rows = [(i, *r, datetime(2025, 1, 1, 0, i % 60), "x") for i, r in enumerate(rows)]
    return {(r["snapshot_no"], r["mevzuat_id"], r["change_kind"]) for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA), **KW).collect()}


def test_kinds_of_change(spark):
    got = changes(spark, [
        (1, "a", "A", "text", None), (2, " A ", "A ", " text\n", "wrong"),  # only blanks and case of the id differ
        (1, "b", "B", "t", None), (2, "b", "b", "t", None),  # letter case of an attribute
        (1, "c", None, "t", None), (2, "c", "", "u", None),
        (1, "d", "D", "t", None), (2, "d", "D", None, sha("t").upper()),  # the hash stands for the text
        (1, "e", "E", "t", None), (2, "e", "E", " ", sha("other")),
        (1, "f", "F", "t", None), (2, "g", "G", "t", None),
        (1, "h", "H", None, None), (2, "h", "H", "", None),
        (1, "i", "I", "old", None), (2, "i", "I", "mid", None), (2, "i", "I", "old", None),  # the later delivery holds
        (1, None, "x", "t", None), (2, "", "x", "t", None),
    ])
    assert got == {(2, "b", "changed"), (2, "c", "changed"), (2, "e", "changed"), (2, "f", "removed"), (2, "g", "added")}


def test_gap_and_empty(spark):
    assert changes(spark, [(1, "a", "A", "t", None), (4, "a", "A", "u", None)]) == {(4, "a", "changed")}
    assert changes(spark, [(1, "a", "A", "t", None)]) == set()
    assert snapshot_changes(spark.createDataFrame([], SCHEMA), **KW).count() == 0


def test_orphans_against_brute_force(spark):
    r = random.Random(5)
    when = lambda: None if r.random() < 0.1 else datetime(2024, r.randint(1, 12), 3)
    parents = [(f"d{r.randint(0, 300)}", when()) for _ in range(200)]
    gone = [(f"d{r.randint(0, 600)}",) for _ in range(120)]
    refs = [("t", "f", i, "d1" if r.random() < 0.3 else f"d{r.randint(0, 600)}", when()) for i in range(1500)]
    df = spark.createDataFrame(refs, "src_table string, ref_field string, row_id long, key string, created_at timestamp").withColumn("period_ym", F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit("")))
    got = find_orphans(df, spark.createDataFrame(parents, "key string, created_at timestamp"), spark.createDataFrame(gone, "key string"))
    first = {}
    for k, t in parents:
        first[k] = min((x for x in (first.get(k), t) if x is not None), default=None)
    log = {k for (k,) in gone}
    want = set()
    for _, _, i, k, t in refs:
        if k not in first:
            want.add((i, "deleted" if k in log else "missing"))
        elif t is not None and first[k] is not None and first[k] > t:
            want.add((i, "late"))
    have = {(x["row_id"], x["orphan_kind"]) for x in got.collect()}
    # a parent without any time is there and never late
    assert have == want
    assert orphan_report(got.withColumn("key", F.col("key"))).agg(F.sum("n_refs")).first()[0] == len(want)


def test_filter_has_no_false_negatives(spark):
    parents = spark.range(3000).select(F.concat(F.lit("p"), "id").alias("key"))
    refs = spark.range(6000).select(F.concat(F.lit("p"), "id").alias("key"), "id")
    judged = split_by_filter(refs, parents, "key")
    assert judged.filter("id < 3000 and not maybe").count() == 0
    assert judged.filter("id >= 3000 and maybe").count() < 150


def test_no_parents(spark):
    refs = spark.createDataFrame([("t", "f", 1, "a", None, "")], "src_table string, ref_field string, row_id long, key string, created_at timestamp, period_ym string")
    none = spark.createDataFrame([], "key string, created_at timestamp")
    assert [r["orphan_kind"] for r in find_orphans(refs, none, none.select("key")).collect()] == ["missing"]
    assert find_orphans(refs.limit(0), none, none.select("key")).count() == 0
