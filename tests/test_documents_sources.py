import json
import random

import pytest
from pyspark.sql import functions as F

from derlem.operators import citations, documents as D, graph, maintenance
from derlem.operators.search import bm25
from derlem.functions.text import plain_markdown
from derlem.operators.index import Index
from derlem.plans.queries import BooleanQuery, parse_match
from derlem.sources import files
from derlem.streaming import jobs


def test_html():
    assert D.html_to_text("<p>a <b>b</b></p><script>x()</script><style>p{}</style>t&amp;c<br/>son") == "a\nb\nt&c\nson"
    assert D.html_to_text(None) == "" and D.html_to_text("  ") == ""


def test_chunks():
    r = random.Random(1)
    for _ in range(200):
        t = "".join(r.choice(["söz ", "uzun kelime ", "\n\n", "\n", "x" * 30]) for _ in range(r.randint(0, 60)))
        size = r.randint(5, 80)
        over = r.randint(0, size - 1)
        got = D.chunk(t, size, over)
        assert all(len(c) <= size for c in got) and got == D.chunk(t, size, over)
        assert {w for w in t.split() if len(w) <= 8} <= set(" ".join(got).replace("\n", " ").split()) or size < 12 or any(b - a > size for a, b in D.paragraph_spans(t.strip()))
        t = t.strip()
        if len(t) > size:
            spans = D.chunk_spans(t, size, over)
            seen = set()
            for a, b in spans:
                seen |= set(range(a, b))
            # nothing but white space lies outside, and no two chunks share more than the overlap
            assert all(t[i].isspace() for i in set(range(len(t))) - seen)
            assert all(0 <= e - s <= over or e <= s for (s, _), (_, e) in zip(spans[1:], spans))
    para = "\n\n".join(f"{i}. paragraf burada " + "söz " * 20 for i in range(9))
    assert all(a == 0 or para[a - 1].isspace() for a, _ in D.chunk_spans(para, 300, 40))
    assert all(para[b:].lstrip(" ").startswith("\n\n") or not para[b:].strip() for _, b in D.chunk_spans(para, 300, 40))
    assert D.chunk(None) == [] and D.chunk(" ") == [] and D.chunk("kısa") == ["kısa"]
    assert D.chunk("a" * 10, 4, 1) == ["aaa", "aaa", "aaa", "a"] or "".join(D.chunk("abcdefghij", 4, 0)) == "abcdefghij"
    with pytest.raises(ValueError):
        D.chunk("x", 5, 5)


def test_pages_cover_the_text():
    t = "Bir cümle. " * 500 + "\n\n" + "x" * 3000
    p = D.pages(t, 700)
    assert "".join(p) == t and max(map(len, p)) <= 700 and D.pages(None) == []


def test_articles_and_notes():
    law = "BİRİNCİ KISIM\nMADDE 1 – Amaç budur.\nikinci satır\nEk Madde 2/A - Ek hüküm.\nGEÇİCİ MADDE 1 – Son.\nGEREKÇE\nMADDE 1 – gerekçesi"
    got = D.articles(law)
    assert [g[0] for g in got] == ["1", "Ek 2/A", "Geçici 1"] and got[0][2] == "Amaç budur.\nikinci satır" and got[2][2] == "Son."
    n = D.amendments("metin (Ek: 17/7/2003-4949/50 md.; Mülga fıkra: 28/2/2018-7101/65 md.) ve (dahil) (Değişik: 6418/3 md.)")
    assert [(x[0], x[1], x[2], x[3], x[4]) for x in n] == [("madde", "ek", "2003-07-17", "4949", "50"), ("fıkra", "mulga", "2018-02-28", "7101", "65"), ("madde", "degisik", None, "6418", "3")]
    c = D.amendments("(İptal: Anayasa Mahkemesinin 12/3/2015 tarihli ve E.: 2014/1, K.: 2015/27 sayılı Kararı ile.; RG-2/4/2015-29314) (3)")
    assert [x[5:10] for x in c] == [("2015-04-02", "29314", "2014/1", "2015/27", 3)] and c[0][1] == "iptal"
    assert D.amendments(None) == [] and D.articles("") == []


def test_markdown_and_changes(spark):
    md = spark.createDataFrame([("## Baş\n- **kalın** [ad](http://x)\n`kod`",), (None,), ("",)], "t string").select(plain_markdown("t").alias("p")).collect()
    assert [r["p"] for r in md] == ["Baş\nkalın ad\nkod", None, ""]
    assert D.line_changes("a\nb", "a\nc") == [("-", "b"), ("+", "c")]


def test_parsers(spark):
    df = spark.createDataFrame([(1, "Tapu iptali ve tescil"), (2, "kira bedeli tahsili"), (3, "kira bedeli temyiz"), (4, None)], "doc_id long, text string")
    ids = lambda q: {r[0] for r in df.filter(BooleanQuery(q).column("text")).select("doc_id").collect()}
    assert ids('tapu OR "kira bedeli"') == {1, 2, 3} and ids("kira NOT temyiz") == {2} and ids("(tapu OR kira) AND bedel") == {2, 3}
    for bad in ("", "(", "kira AND", "a )"):
        with pytest.raises(ValueError):
            BooleanQuery(bad).column("text")
    m = parse_match('AND "iki söz" tek', reserved=("AND",))
    assert m.terms == ["tek"] and m.phrases == [["iki", "söz"]] and parse_match(" ").column(F.col("x")) is None
    assert bm25(df, "doc_id", "text", ["kira", "tapu"]).count() == 0 and bm25(df, "doc_id", "text", ["kira"]).count() == 2


def test_citations(spark):
    recs = spark.createDataFrame([("A", "Yargıtay", "3. Hukuk Dairesi", "2015/10", "2016/20", "Yargıtay 4. Hukuk Dairesi, Esas No: 2011/5 Karar No: 2012/6 kararı."), ("B", "Yargıtay", "4. Hukuk Dairesi", "2011/5", "2012/6", "kendi Esas 2011/5 Karar 2012/6"), ("C", None, None, None, None, None)], "document_id string, court string, chamber string, esas_no string, karar_no string, t string")
    c = citations.candidates(recs, "document_id", "t")
    got = {tuple(r) for r in citations.build_edges(c, recs, "document_id").collect()}
    assert got == {("A", "B", "high", "exact_numbers")}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("x", "y")], "a string, b string")
    got = {(r[0], r[1]) for r in graph.bfs(e, spark.createDataFrame([("a",)], "node string"), 3).collect()}
    assert got == {("a", 0), ("b", 1), ("d", 1), ("c", 2)}
    assert {tuple(r) for r in graph.degrees(e).filter("node = 'a'").collect()} == {("a", 1, 1)}


def test_maintenance(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in maintenance.insert_absent(t, spark.createDataFrame([(2, "z"), (3, "c"), (3, "c")], t.schema), ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert [r[0] for r in maintenance.delete_keys([t], t.filter("k = 1"), ["k"])[0].collect()] == [2]


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "metin"), (2, None)], "id long, t string")
    info = files.export_json(df, str(tmp_path / "j"), "t")
    assert info["rows"] == 2
    good, bad = files.import_json(spark, str(tmp_path / "j"), df.schema, "t")
    assert sorted((r["id"], r["t"]) for r in good.collect()) == [(1, "metin"), (2, None)] and bad.count() == 0
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "x.json").write_text('{"id": 1, "t": "metin", "row_sha256": "0"}\n{broken\n')
    good, bad = files.import_json(spark, str(tmp_path / "k"), df.schema, "t")
    assert good.count() == 0 and sorted(r["reason"] for r in bad.collect()) == ["hash", "unreadable"]


def test_generations(spark, tmp_path):
    assert files.current(spark, str(tmp_path)) is None
    files.publish(spark.range(3), str(tmp_path), 1)
    files.publish(spark.range(5), str(tmp_path), 2)
    assert files.current(spark, str(tmp_path), ["id"]).count() == 5 and files.current(spark, str(tmp_path), ["other"]) is None


def test_pages_and_replay(spark, tmp_path):
    (tmp_path / "a.htm").write_bytes("<p>Türkçe ığşç".encode("windows-1254"))
    (tmp_path / "b.htm").write_bytes('<meta charset="utf-8">ığş'.encode())
    assert {r["text"] for r in files.decode_pages(spark, str(tmp_path)).collect()} == {"<p>Türkçe ığşç", '<meta charset="utf-8">ığş'}
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "1.jsonl").write_text(json.dumps({"document_id": "x", "text": "y"}) + "\n")
    spark.dataSource.register(files.ReplaySource)
    assert [tuple(r) for r in spark.read.format("replay").option("folder", str(tmp_path / "feed")).load().collect()] == [("x", "y")]


def test_streams(spark, tmp_path):
    ev = spark.createDataFrame([("s", f"2024-01-01 00:0{i}:00", i in (1, 2, 3, 6)) for i in range(8)] + [("t", "2024-01-01 00:00:00", True)], "source string, ts string, failed boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    ev.coalesce(1).write.parquet(src)
    s = jobs.stream_table(spark, src, ev)
    out = jobs.breaker(s, "source", "ts", "failed", threshold=3, recovery_s=120)
    jobs.run_available(out, str(tmp_path / "c1"), to=str(tmp_path / "o1"))
    got = [(r["before"], r["after"]) for r in spark.read.parquet(str(tmp_path / "o1")).orderBy("ts", "before").collect()]
    assert got[0] == ("closed", "open") and ("open", "half_open") in got and ("half_open", "closed") in got
    jobs.run_available(jobs.unseen(jobs.stream_table(spark, src, ev), ["source"], "ts"), str(tmp_path / "c2"), to=str(tmp_path / "o2"))
    assert spark.read.parquet(str(tmp_path / "o2")).count() == 2
    docs = spark.createDataFrame([(1, "bir iki bir"), (2, "iki")], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    jobs.run_available(jobs.stream_table(spark, str(tmp_path / "docs"), docs), str(tmp_path / "c3"), each=jobs.keep_index(Index(spark, str(tmp_path / "ix")), "doc_id", "text"))
    # another reader finds what the stream has put into the index
    post = Index(spark, str(tmp_path / "ix")).postings(["bir", "iki", "üç"])
    assert {(r["key"], r["term"], r["tf"]) for r in post.collect()} == {(1, "bir", 2), (1, "iki", 1), (2, "iki", 1)}
    assert jobs.watch(docs, docs.filter("doc_id = 1"), ["doc_id"]).count() == 1
