"""Queries that once did less than the whole job, on tables made here."""

import __spark_entry__ as entry


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def run(spark, folder, name):
    return entry.queries()[name](spark, str(folder))


def test_fuzzy_duplicates(spark, tmp_path):
    docs = [("A", "Yargıtay", "2020-01-01"), ("B", "Yargıtay", "2020-06-01"), ("C", "Yargıtay", "2023-01-01"), ("D", "Yargıtay", "01.01.2023"), ("E", "Danıştay", "2020-01-01"), ("F", None, None), ("G", " ", None), ("H", "Yargıtay", None)]
    put(spark, tmp_path, "documents_v2", [(i, k, "s", c, t, None) for i, (k, c, t) in enumerate(docs)], "row_id long, document_id string, source string, court string, decision_date string, retrieved_at timestamp")
    vecs = [(k, 0, [1.0, 0.0]) for k in "ABCDEFG"] + [("A", 1, [0.9, 0.1]), ("H", 0, [0.0, 1.0])]
    put(spark, tmp_path, "embedding_vectors", [(k, "s", "p", i, v) for k, i, v in vecs], "document_id string, source string, provider_id string, chunk_index long, vector array<float>")
    put(spark, tmp_path, "dedup_members", [("x", " b", "s"), ("X ", "D", "s"), (None, "A", "s"), (None, "B", "s")], "cluster_id string, document_id string, source string")
    got = {(r.doc_a + r.doc_b, r.score, r.n_links, r.date_gap, r.confidence) for r in run(spark, tmp_path, "fuzzy_duplicates").collect()}
    # C is too late for A and B; D has another writing of its date, and is in a cluster with B; H is unlike
    assert got == {("AB", 1.0, 2, 152, "high"), ("AD", 1.0, 2, None, "high"), ("CD", 1.0, 1, None, "high"), ("FG", 1.0, 1, None, "high")}


LAWS = "row_id long, snapshot_no int, mevzuat_id string, kaynak string, tur string, ad string, rg_tarihi string, cekim_zamani timestamp, metin string"


def laws(spark, folder, rows):
    """rows: snapshot_no, mevzuat_id, tur, ad, rg_tarihi."""
    put(spark, folder, "mevzuat_dokuman", [(i, n, k, "m", tur, ad, day, None, None) for i, (n, k, tur, ad, day) in enumerate(rows)], LAWS)


def test_median_gap(spark, tmp_path):
    laws(spark, tmp_path, [(1, "1", "T", "Çay", "03/09/2017"), (1, "2", "T", "ÇAY", "2018-09-03"), (2, "2", "T", "ÇAY", "3 Eyl 2018"), (1, "3", "T", "Su", "15.02.2021"), (1, "4", "U", "Su", None)])
    got = {tuple(r) for r in run(spark, tmp_path, "median_gap").select("tur", "nm", "n", "median_gap", "newest").collect()}
    assert got == {("T", "CAY", 2, 365.0, "2018-09-03"), ("T", "SU", 1, None, "2021-02-15")}


def test_version_series_current(spark, tmp_path):
    yearly = [(1, "a", "TEBLIG", "Ücret", "02.01.2019"), (1, "b", "TEBLIG", "ÜCRET", "2 Ocak 2020"), (1, "c", "TEBLIG", "ucret", "2020-12-24"), (2, "b ", "TEBLIG", "ÜCRET", "2020/01/02")]
    law = [(1, "d", "KANUN", "İş", "2001-01-01"), (1, "e", "KANUN", "İş", "2011-01-01")]
    monthly = [(1, "f", "TEBLIG", "Meslek", "2020-01-01"), (1, "g", "TEBLIG", "Meslek", "2020-02-01")]
    undated = [(1, "h", "TEBLIG", "Vergi", "2010-01-01"), (1, "i", "TEBLIG", "Vergi", "2012-01-01"), (1, "j", "TEBLIG", "Vergi", "?")]
    same_day = [(1, k, "YONETMELIK", "Su", t) for k, t in (("k", "2015-01-01"), ("l", "2015-01-01"), ("m", "2015-01-01"), ("n", "2017-01-01"))]
    nameless = [(1, "o", "TEBLIG", None, "2010-01-01"), (1, "p", "TEBLIG", None, "2012-01-01")]
    laws(spark, tmp_path, yearly + law + monthly + undated + same_day + nameless)
    assert sorted(r.mevzuat_id for r in run(spark, tmp_path, "version_series_current").collect()) == list("cdefghijklmnop")


def test_pending_days(spark, tmp_path):
    pages = ["20230129", "20230130m1", "20230331", "20240229-2", "20230230", "20240101", "20230132", "x20230105", None]
    put(spark, tmp_path, "rg_ogeler", [(p,) for p in pages], "sayfa string")
    got = {r.dy for r in run(spark, tmp_path, "pending_days").collect()}
    assert len(got) == 731 - 5 and not got & {"2023-01-29", "2023-01-30", "2023-03-31", "2024-02-29", "2024-01-01"} and "2023-01-05" in got


def test_keyword_overlap(spark, tmp_path):
    texts = [("a", "tr", "bir iki üç dört"), ("a", "tr", "İki beş"), ("b", None, "bir iki altı"), ("c", "en", "one iki two three four five six"), ("d", "de", None), ("e", "fr", "altı bir")]
    put(spark, tmp_path, "documents", texts, "source string, lang string, text string")
    got = {r.a + r.b: r.bucket for r in run(spark, tmp_path, "keyword_overlap").collect()}
    assert got == {"ab": "strong", "ac": "none", "ad": "none", "ae": "weak", "bc": "weak", "bd": "none", "be": "strong", "cd": "none", "ce": "none", "de": "none"}


def test_citation_graph_build(spark, tmp_path):
    text = "Yargıtay 4. Hukuk Dairesi 12.05.2015 tarihli, Esas No: 2011/5 Karar No: 2012/6 kararında böyle der."
    docs = [("A", "Danıştay", None, None, None, "2020-01-01", text), ("B", "Yargıtay", "4. Hukuk Dairesi", "2011/5", "2012/6", "12.05.2015", None), ("C", "YARGITAY", None, "1/1", "1/1", "3 Haz 2016", None),
            ("D", "Yargıtay", None, None, None, "2014/02/01", None), ("E", "Yargıtay", None, None, None, "2017-01-01", None), ("F", "Danıştay", None, None, None, "2015-05-12", None), ("G", "", None, None, None, "2015-05-12", None)]
    put(spark, tmp_path, "documents_v2", [(i, k, "s", c, ch, e, n, t, x, None, None) for i, (k, c, ch, e, n, t, x) in enumerate(docs)], "row_id long, document_id string, source string, court string, chamber string, esas_no string, karar_no string, decision_date string, full_text string, markdown string, retrieved_at timestamp")
    got = {tuple(r) for r in run(spark, tmp_path, "citation_graph_build").collect()}
    assert got == {("A", "B", "high", "exact_numbers"), ("A", "D", "medium", "court_date")}


def test_change_decision(spark, tmp_path):
    import datetime

    at = lambda n: datetime.datetime(2025, 1, n)
    rows = [(1, "A", "z", "x", at(1)), (1, "a ", "b", "x", at(2)), (2, "A", "B", "x", at(3)), (2, "B", "c", "x", None), (3, "A", "B", "y", at(5)), (3, "B", "c", "x", at(5)), (5, "B", "d", "x", at(6)), (5, "B", "c", "x", at(7))]
    put(spark, tmp_path, "mevzuat_dokuman", [(i, *r) for i, r in enumerate(rows)], "row_id long, snapshot_no int, mevzuat_id string, metin_hash string, guncelleme_tarihi string, cekim_zamani timestamp")
    got = {tuple(r) for r in run(spark, tmp_path, "change_decision").collect()}
    assert got == {(2, "A", "same"), (2, "B", "new"), (3, "A", "metadata"), (3, "B", "same"), (5, "A", "gone"), (5, "B", "same")}


def test_sync_newest_wins(spark, tmp_path):
    import datetime

    at = lambda n: datetime.datetime(2025, 1, n)
    rows = [(1, "A", at(1)), (7, "A", at(2)), (11, "A", None), (5, "B", at(3)), (13, "B", at(1)), (17, "C", None), (19, "D", None), (23, "D", at(1))]
    put(spark, tmp_path, "documents_v2", [(i, k, "s", t, "h" if i < 7 else str(i)) for i, k, t in rows], "row_id long, document_id string, source string, retrieved_at timestamp, content_hash string")
    assert {r.document_id: r.conflict for r in run(spark, tmp_path, "sync_newest_wins").collect()} == {"A": True, "B": True, "C": False, "D": True}
    got = {r.document_id: r.action for r in run(spark, tmp_path, "sync_newest_wins").collect()}
    assert got == {"A": "newer_there", "B": "keep", "C": "only_here", "D": "newer_there"}


def test_monotonicity_audit(spark, tmp_path):
    rows = [("20240101", "10"), ("20240102", "12"), ("20240103", "11"), ("20240104", "13"), ("20240105", None), ("2024010", "1"), (None, "2"), ("20240106", "9")]
    put(spark, tmp_path, "rg_ogeler", rows, "sayfa string, sayi_no string")
    got = {(r.sayfa, r.no, r.kind) for r in run(spark, tmp_path, "monotonicity_audit").collect()}
    assert got == {("20240102", 12, "above_next"), ("20240103", 11, "below_previous"), ("20240104", 13, "above_next"), ("20240106", 9, "below_previous")}


def test_archive_is_looked_up_by_text(spark, tmp_path):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    law = lambda n, k, t, h=None: (n, k, "ad", "T", "1", "2", t, h, None)
    rows = [law(1, "a", "eski"), law(2, "a", "yeni"), law(1, "b", "bir"), law(2, "b", "iki"), law(1, "c", "son"), law(1, "d", None, sha("x")), law(2, "d", "y")]
    cols = "row_id long, snapshot_no int, mevzuat_id string, ad string, tur string, mevzuat_no string, rg_sayisi string, metin string, metin_hash string, cekim_zamani timestamp"
    put(spark, tmp_path, "mevzuat_dokuman", [(i, *r) for i, r in enumerate(rows)], cols)
    # the text itself must be there, under its law: another text of the law, or the text under another law, is none
    put(spark, tmp_path, "mevzuat_dokuman_gecmis", [(" A", " eski\n"), ("b", "eski"), ("c", "son"), ("c", "son"), ("d", None)], "mevzuat_id string, metin string")
    got = {(r.change_kind): (r.n_changes, r.n_with_text, r.n_archived) for r in run(spark, tmp_path, "p2_archive").collect()}
    assert got == {"changed": (3, 2, 1), "removed": (1, 1, 1)}


def test_input_pack_hash_of_large_parts(spark, tmp_path):
    import hashlib

    n, small = 140_000, ["A", "Ş", "ş"]
    ids = spark.range(n).selectExpr("'large' source", "cast(id as string) document_id").unionByName(spark.createDataFrame([("small", k) for k in small + ["A"]], "source string, document_id string"))
    ids.selectExpr("*", "'full_text' content_status", "1L quote_usable").write.parquet(f"{tmp_path}/documents_v2.parquet")
    sums = {s: sum(int(hashlib.sha256(k.encode()).hexdigest()[:12], 16) for k in ks) for s, ks in (("large", map(str, range(n))), ("small", small))}
    assert sums["large"] >= 2**63 > sums["small"]
    got = {tuple(r) for r in run(spark, tmp_path, "input_pack_hash").collect()}
    assert got == {("large", "safe", n, (sums["large"] + 2**63) % 2**64 - 2**63), ("small", "safe", 3, sums["small"])}
