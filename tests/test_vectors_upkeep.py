"""Vectors, exchange, faults, watches, legislation and query understanding on small fixtures."""

import datetime
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from derlem.operators import citations, documents, embedding, graph, legislation, maintenance, vectors
from derlem.plans import understanding as U
from derlem.sources import errors, files
from derlem.sources.store import Store
from derlem.streaming import jobs


def near(x, qs, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[qs] @ u.T
    return {q: set(np.lexsort((np.arange(len(x)), -s[i]))[:k].tolist()) for i, q in enumerate(qs)}


def test_inverted_file(spark, tmp_path):
    r = np.random.default_rng(1)
    centres = r.standard_normal((20, 24))
    x = np.concatenate([c + 0.4 * r.standard_normal((40, 24)) for c in centres])
    rows = [(i, v.astype(float).tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 24), (9003, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    qs = list(range(0, 800, 50))
    asked = df.filter(F.col("k").isin(qs)).select(F.col("k").alias("qid"), F.col("v").alias("q"))
    got = {}
    for row in vectors.exact_top(asked, df, "k", "v", 10, block=7, part=100).collect():
        got.setdefault(row["qid"], set()).add(row["key"])
    want = near(x, qs, 10)
    assert got == want
    own = df.filter("size(v) = 24")
    ix = vectors.InvertedFile.build(own.filter("k < 700 or k > 9000"), "k", "v", str(tmp_path / "ix"), cells=20, parts=8, codes=32)
    ix.append(own, "k", "v")
    assert ix.codes().count() == 800 and ix.codes().select("key").distinct().count() == 800
    found = {}
    # two of twenty cells: a tenth of the codes, and 60 of 800 vectors
    for row in vectors.InvertedFile(spark, str(tmp_path / "ix")).search(asked, own, "k", "v", 10, probe=2, refine=60).collect():
        found.setdefault(row["qid"], set()).add(row["key"])
    assert np.mean([len(found[q] & want[q]) / 10 for q in qs]) >= 0.9
    with pytest.raises(ValueError):
        ix.append(df.filter("k = 9003"), "k", "v")
    query = spark.createDataFrame([(x[3].tolist(),)], "q array<double>")
    assert {r["k"] for r in vectors.two_phase(own, "k", "v", query, 10).collect()} == near(x, [3], 10)[3]
    both = vectors.merge_best([spark.createDataFrame([(1, 0.2), (2, 0.5)], "k long, score double"), spark.createDataFrame([(1, 0.4)], "k long, score double")], "k")
    assert {tuple(r) for r in both.collect()} == {(1, 0.4), (2, 0.5)}


def test_sidecars(spark, tmp_path):
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / "s" / name))
    put("vectors", [(0, [1.0, 0.0]), (1, [0.0, 1.0])], "row long, vector array<double>")
    put("keys", [(0, "a", 2), (1, "b", 2)], "row long, document_id string, chunk_version int")
    assert vectors.read_sidecars(spark, str(tmp_path / "s"), 2).count() == 2
    with pytest.raises(ValueError):
        vectors.read_sidecars(spark, str(tmp_path / "s"), 3)
    put("keys", [(0, "a", 1), (1, "b", 2)], "row long, document_id string, chunk_version int")
    with pytest.raises(ValueError):
        vectors.read_sidecars(spark, str(tmp_path / "s"))


def test_graph_is_built_by_batches(spark, tmp_path):
    cols = "document_id string, court string, chamber string, esas_no string, karar_no string, t string"
    text = "Yargıtay kararı, Esas No: 2011/5 Karar No: 2012/6 olan ilamda böyle der."
    recs = spark.createDataFrame([("A", None, None, None, None, text), ("B", "Yargıtay", None, "2011/5", "2012/6", None), ("C", None, None, None, None, text)], cols)
    for part in ("A", "C"):
        recs.filter(F.col("document_id") == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: jobs.run_available(jobs.stream_table(spark, str(tmp_path / "in"), recs), str(tmp_path / "c"), each=jobs.keep_edges(str(tmp_path / "out"), recs, "document_id", "t"))
    go()
    go()
    assert sorted((r["document_id"], r["cited"], r["confidence"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("A", "B", "high"), ("C", "B", "high")]


def test_providers(spark):
    df = spark.createDataFrame([(1, "kira bedeli"), (2, " "), (3, None), (4, "tapu")], "k long, t string")
    p = embedding.HashProvider(16)
    e = embedding.embed(df, ["k"], "t", p)
    assert {r["k"] for r in e.collect()} == {1, 4} and all(abs(r["norm"] - 1) < 1e-9 for r in e.collect())
    changed = df.withColumn("t", F.when(F.col("k") == 4, "tapu iptali").otherwise(F.col("t")))
    assert [r["k"] for r in embedding.embed_changed(changed, ["k"], "t", e, p).collect()] == [4]
    s = df.withColumn("score", F.lit(0.5))
    assert {r["rerank_score"] for r in embedding.rerank(s, "q", "t", None).collect()} == {0.5}
    assert {r["k"]: r["rerank_score"] for r in embedding.rerank(s, "q", "t", lambda q, ts: [float(len(t or "")) for t in ts]).collect()} == {1: 11.0, 2: 1.0, 3: 0.0, 4: 4.0}


def test_store_and_generations(spark, tmp_path):
    root = str(tmp_path / "g")
    for n in (1, 2, 3):
        files.publish(spark.range(n), root, n, keep=2)
    assert files.current(spark, root, ["id"]).count() == 3 and [n for n in Store(spark, root).names() if n.startswith("gen")] == ["gen=2", "gen=3"]
    assert files.current(spark, root, ["other"]) is None and files.current(spark, str(tmp_path / "none")) is None
    spark.range(100).repartition(7).write.parquet(str(tmp_path / "many"))
    assert files.compact(spark, str(tmp_path / "many")) == 1 and spark.read.parquet(str(tmp_path / "many")).count() == 100
    wide = files.with_columns(spark.range(2), spark.createDataFrame([], "id int, name string").schema)
    assert wide.dtypes == [("id", "int"), ("name", "string")]


def test_exchange(spark, tmp_path):
    df = spark.createDataFrame([("a", "metin"), ("a", "metin"), ("b", None)], "k string, t string")
    one = files.export_json(df, str(tmp_path / "j"), "t")
    two = files.export_json(df.limit(1).unionByName(df.filter("k = 'b'")), str(tmp_path / "j2"), "t")
    assert one["rows"] == 3 and one["digest"] != two["digest"]
    good, bad = files.import_json(spark, str(tmp_path / "j"), "k string, t string", "t")
    c = files.import_counts(good, bad, spark.createDataFrame([("a",)], "k string"), ["k"]).first()
    assert tuple(c) == (1, 2, 0)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.json").write_text('{"documents": [{"k": "a", "t": "x", "row_sha256": "wrong"},\n {"k": "b", "t": "", "row_sha256": "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}]}')
    good, bad = files.import_json(spark, str(tmp_path / "w"), "k string, t string", "t", wrapped="documents")
    assert [r["k"] for r in good.collect()] == ["b"] and [r["reason"] for r in bad.collect()] == ["hash"]


def test_archives_pdfs_logs(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("content.xml", "<d><p>Birinci <b>satır</b></p><p>İkinci</p></d>")
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a.udf").write_bytes(z.getvalue())
    (tmp_path / "u" / "b.udf").write_bytes(b"no archive")
    got = {r["path"][-5:]: (r["text"], r["problem"]) for r in files.read_archives(spark, str(tmp_path / "u")).collect()}
    assert got == {"a.udf": ("Birinci satır\nİkinci", None), "b.udf": (None, "BadZipFile")}
    assert all(r["text"] is None and r["problem"] for r in files.read_pdfs(spark, str(tmp_path / "u")).collect())
    recs = spark.createDataFrame([("a", "pdf_link_only", None, None, "high"), ("b", "pdf_link_only", None, None, "high"), ("c", "full_text", "x", "h", "high")], "k string, content_status string, full_text string, content_hash string, metadata_confidence string")
    up = {r["k"]: (r["content_status"], r["metadata_confidence"]) for r in files.upgrade_from_files(recs, spark.createDataFrame([("a", "y" * 60), ("b", "y"), ("c", "y" * 60)], "k string, text string"), ["k"]).collect()}
    assert up == {"a": ("full_text", "low"), "b": ("pdf_link_only", "high"), "c": ("full_text", "high")}
    (tmp_path / "l").mkdir()
    for name, t in (("ok", "begin\nall done rc=0\n"), ("bad", "x\nrc=2"), ("half", "begin\n")):
        (tmp_path / "l" / f"{name}.log").write_text(t)
    state = {r["path"].split("/")[-1]: r["state"] for r in files.job_status(spark, str(tmp_path / "l"), str(datetime.datetime.now())).collect()}
    assert state == {"ok.log": "ok", "bad.log": "failed", "half.log": "partial"}
    page = "<h2>YÜRÜTME</h2><h3>YÖNETMELİKLER</h3><p><a href='20240101-1.htm'>–– A Yönetmeliği</a></p><div class='html-subtitle'>TEBLİĞLER</div><a href='20240101-2.htm'> B\n Tebliği</a>"
    assert files.parse_index(page) == [("YÜRÜTME", "YÖNETMELİKLER", "A Yönetmeliği", "20240101-1.htm"), ("YÜRÜTME", "TEBLİĞLER", "B Tebliği", "20240101-2.htm")] and files.parse_index(None) == []
    assert files.check_shape(["a", "b"], ["a"])[0] == "a" and files.check_shape(["b"], ["a"], ["b"])[1] and files.check_shape([], ["a"])[0] is None


def test_faults_are_raised_and_tried_again():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise errors.SourceError("RUNTIME")
        return 7

    assert errors.retried(call, sleep=waits.append) == 7 and waits == [0.5, 1.0]
    with pytest.raises(errors.SourceError) as e:
        errors.retried(lambda: errors.checked({"error": "VALIDATION_X", "message": "m"}), sleep=waits.append)
    assert e.value.kind == "request" and len(waits) == 2
    assert errors.SourceError("X", "JSON parse error").kind == "parameter" and errors.checked({"a": 1}) == {"a": 1}


def test_watches_and_limits(spark, tmp_path):
    w = jobs.Watches(spark, str(tmp_path / "w"))
    w.add("kira", "kira bedeli")
    with pytest.raises(ValueError):
        w.add("kira", "x")
    found = {"kira bedeli": [1, 2]}
    fn = lambda q: spark.createDataFrame([(i,) for i in found[q]], "k long")
    ids = lambda: sorted(r["k"] for r in w.run("kira", fn, ["k"]).collect())
    assert ids() == [1, 2] and ids() == []
    found["kira bedeli"] = [2, 3]
    assert ids() == [3]
    found["kira bedeli"] = [1]
    # what was found last time takes the place of everything before
    assert ids() == [1] and w.remove("kira") and not w.remove("kira") and w.names() == {}
    assert jobs.record_search(spark, str(tmp_path / "log"), "q", "lexical", 3, 1.5) and spark.read.parquet(str(tmp_path / "log")).count() == 1
    (tmp_path / "file").write_text("x")
    assert not jobs.record_search(spark, str(tmp_path / "file" / "log"), "q", "lexical", 3, 1.5)
    ev = spark.createDataFrame([("s", f"2024-01-01 00:00:{t:02d}") for t in (0, 1, 2, 3, 30, 31)], "k string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = jobs.rate_limit(jobs.stream_table(spark, str(tmp_path / "in"), ev), "k", "ts", most=2, window_s=10, cooldown_s=5)
    jobs.run_available(out, str(tmp_path / "c"), to=str(tmp_path / "o"))
    assert [r["allowed"] for r in spark.read.parquet(str(tmp_path / "o")).orderBy("ts").collect()] == [True, True, False, False, True, True]


def test_legislation(spark):
    assert legislation.target("Ceza Muhakemesi Kanununda Değişiklik Yapılmasına Dair Kanun") == ("amendment", "Ceza Muhakemesi Kanunu", None)
    assert legislation.target("5271 Sayılı Ceza Muhakemesi Kanununda Değişiklik Yapılması Hakkında Kanun (Karar Sayısı: 12)") == ("amendment", "Ceza Muhakemesi Kanunu", "5271")
    assert legislation.target("Bazı Kanunlarda Değişiklik Yapılmasına Dair Kanun")[:2] == ("amendment", None)
    assert legislation.target("Vergi Usul Kanunu ile Bazı Kanunlarda Değişiklik Yapılması")[1] == "Vergi Usul Kanunu"
    assert legislation.target("Su Yönetmeliğinin Yürürlükten Kaldırılmasına Dair Yönetmelik") == ("repeal", "Su Yönetmeliği", None)
    assert legislation.target("Yeni Yönetmelik") == ("new", None, None) and legislation.target(None) == ("new", None, None)
    items = spark.createDataFrame([(1, "Su Denetimi Kanunu", None), (2, "Yapı Denetimi Hakkında", None), (3, "Yok", "42"), (4, None, None)], "row_id long, target string, target_no string")
    laws = spark.createDataFrame([("b", "SU DENETİMİ KANUNU", "1"), ("a", "Su denetimi kanunu", "2"), ("c", "Yapı Denetimi Hakkında Kanun", "3"), ("d", "Başka", "42")], "mevzuat_id string, ad string, mevzuat_no string")
    got = {r["row_id"]: (r["mevzuat_id"], r["matched_by"]) for r in legislation.match_names(items, laws, "row_id", "target", "target_no").collect()}
    assert got == {1: ("a", "name"), 2: ("c", "beginning"), 3: ("d", "number"), 4: (None, None)}
    text = "BİRİNCİ KISIM\nGenel\n\nBİRİNCİ BÖLÜM\nAmaç\nMADDE 1 – Bu Kanun düzenler.\nKapsam\nMADDE 2 – Kapsam budur.\nGEREKÇE\nBirinci gerekçe.\n\nİkinci gerekçe."
    s = legislation.structure(text)
    assert [(x[1], x[2], x[3]) for x in s if not x[4]] == [("Amaç", "1", "Bu Kanun düzenler."), ("Kapsam", "2", "Kapsam budur.")]
    assert s[0][0] == "BİRİNCİ KISIM > BİRİNCİ BÖLÜM" and [x[3] for x in s if x[4]] == ["Birinci gerekçe.", "İkinci gerekçe."] and legislation.structure(None) == []
    outline = spark.createDataFrame([("k", "A", "a", "1"), ("k", "B", "b", "3")], "key string, part string, section string, number string")
    bodies = spark.createDataFrame([("k", "1", "x"), ("k", "2", "y")], "key string, number string, body string")
    assert {tuple(r) for r in legislation.tree(outline, "key", "part", "section", "number", bodies).collect()} == {("k", "A", "a", "1", "x"), ("k", "B", "b", "3", None), ("k", None, None, "2", "y")}


def test_history_and_upkeep(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 5, "x"), ("b", 2, None), ("b", 3, None)], "k string, n int, h string")
    got = {(r["k"], r["version"]): (r["valid_from"], r["valid_to"], r["last_seen"], r["h"]) for r in maintenance.history(rows, "k", "n", "h").collect()}
    assert got == {("a", 1): (1, 3, 2, "x"), ("a", 2): (3, 5, 3, "y"), ("a", 3): (5, None, 5, "x"), ("b", 1): (2, None, 3, None)}
    seen = spark.createDataFrame([("g", i, k) for i, k in enumerate([True, False, True, True, True, False])], "g string, i int, known boolean")
    assert sorted(r["i"] for r in maintenance.until_known(seen, "g", "i", "known", 3).collect()) == [0, 1, 2, 3, 4]
    old, new = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string"), spark.createDataFrame([(1, "z")], "k int, v string")
    assert {r["v"] for r in maintenance.replace_by_key(old, new, ["k"]).collect()} == {"z", "c"}
    late = spark.createDataFrame([("k", None, 1), ("k", 5, 2), ("k", 5, 3), (None, 1, 4)], "k string, t int, row_id long")
    assert {r["row_id"] for r in maintenance.keep_latest(late, ["k"], "t", "row_id").collect()} == {3, 4}
    e = spark.createDataFrame([(1, "a", 1.0), (2, "a", 5.0), (3, "b", 2.0)], "i long, k string, v double")
    first = maintenance.advance(None, e.filter("i < 3"), "i", ["k"], {"s": "v"}, {"m": "v"})
    assert {tuple(r) for r in maintenance.advance(first, e, "i", ["k"], {"s": "v"}, {"m": "v"}).select("k", "n", "s", "m").collect()} == {("a", 2, 6.0, 5.0), ("b", 1, 2.0, 2.0)}


def test_graph(spark, tmp_path):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("b", "e")], "a string, b string")
    centre = spark.createDataFrame([("b",)], "node string")
    assert {tuple(r) for r in graph.neighbourhood(e, centre).collect()} == {("cites", "e"), ("cited_by", "a"), ("cited_by", "c")}
    assert {r["id"] for r in graph.cross_references(e, centre).collect()} == {"a", "c", "d", "e"}
    docs = spark.createDataFrame([("a",), ("x",)], "a string")
    assert tuple(graph.guard(e, docs).first()) == (4, 3, 1.333333, 0.5, "ok") and graph.guard(e.limit(0), docs).first()["state"] == "never_built"
    assert {r["node"]: r["number"] for r in graph.numbered(graph.endpoints(e), "node").collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4}
    for form in ("json", "dot", "mermaid"):
        graph.export(e, str(tmp_path / form), form)
        assert spark.read.text(str(tmp_path / form)).count() == 4
    with pytest.raises(ValueError):
        graph.export(e, str(tmp_path / "x"), "svg")
    q = spark.createDataFrame([('x"y', "z")], "a string, b string")
    assert graph.dot_lines(q).first()[0] == '  "x\\"y" -> "z";'


def test_citations_are_verified(spark):
    text = "Yargıtay 4. Hukuk Dairesi 12.05.2015 tarihli, Esas No: 2011/5 Karar No: 2012/006 kararında böyle der."
    cols = "document_id string, court string, chamber string, esas_no string, karar_no string, decision_date string, t string"
    recs = spark.createDataFrame([("A", None, None, None, None, None, text), ("B", "Yargıtay", "4. Hukuk Dairesi", "2011 / 05", "2012/6", "2015-05-12", None), ("C", "Danıştay", "1. Daire", "2011/5", "2000/1", None, None)], cols)
    cand = citations.candidates(recs, "document_id", "t")
    got = [tuple(r) for r in citations.verify(cand, recs, "document_id").collect()]
    assert len(got) == 1 and got[0][0] == "A" and got[0][3] == "B" and got[0][4] > 0.9
    edges = {tuple(r) for r in citations.build_edges(cand, recs, "document_id").collect()}
    assert edges == {("A", "B", "high", "exact_numbers")}


def test_understanding():
    assert U.expand(["sözleşmelerin", "ev"])[:2] == ["sözleşmelerin", "ev"] and "sözleşmeler" in U.expand(["sözleşmelerin"]) and "sözleşme" in U.expand(["sözleşmelerin"]) and U.stems("ev") == ["ev"]
    assert U.synonyms("Kira davası") == ["kira bedeli", "kiracı", "kiralayan", "tahliye"] and U.synonyms("yok") == []
    assert U.law_references("İYUK 11 uyarınca ve HMK md. 190") == ("2577 (İdari Yargılama Usulü Kanunu) m.11 uyarınca ve 6100 (Hukuk Muhakemeleri Kanunu) m.190", [("İYUK 11", "2577 (İdari Yargılama Usulü Kanunu) m.11"), ("HMK md. 190", "6100 (Hukuk Muhakemeleri Kanunu) m.190")])
    assert U.law_references("tbk kira")[0] == "6098 (Türk Borçlar Kanunu) kira" and U.law_references("kira") == ("kira", [])
    assert U.court_filters("Yargıtay 3. Hukuk Dairesi sözleşme ihlali") == ({"court": "Yargitay", "chamber": "3. Hukuk Dairesi"}, "high") and U.court_filters("kira") == ({}, "low")
    assert U.sanitise('imar 83/a {x} "kira bedeli"') == 'imar "83 a" x "kira bedeli"' and U.require_all("kira bedeli") == "+kira +bedeli" and U.require_all("kira") == "kira" and U.require_all("kira OR bedel") == "kira OR bedel"
    assert U.lucene("fair trial", article="6", languages=["eng", "fre"], first="2020-01-01") == 'contentsitename:ECHR AND (respondent:"TUR") AND (article:"6") AND (languageisocode:"ENG" OR languageisocode:"FRE") AND (kpdate>="2020-01-01T00:00:00.0Z") AND (fair trial)'
    assert U.total_pages(None, 10) is None and U.total_pages(0, 10) == 0 and U.total_pages(101, 500) == 2 and U.sort_order("", None) == "date" and U.sort_order("x", "nope") == "relevance" and U.sort_order("x", "date") == "date"


def test_snippets():
    t = "Giriş cümlesi. " * 10 + "Burada kira bedeli yazılıdır. " + "Son cümle. " * 30 + "Yine KİRA geçer."
    r = documents.regions(t, ["kira"])
    assert r.count("**") == 4 and "**kira**" in r and "**KİRA**" in r and r.startswith("…")
    w = documents.word_window(t, ["kira", "bedel"], 8)
    assert "«kira» «bedeli»" in w and len(w.split()) <= 8
    assert documents.regions(None, ["x"]) == "" and documents.word_window("", ["x"]) == "" and documents.over_fetch(10) == 50 and documents.over_fetch(200) == 300
    long = "kelime " * 600
    assert documents.chunk_text(long, 0) == ("kelime " * 85).strip() and documents.chunk_text(long, 99) == ""
