import itertools
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from derlem.llm import lookalikes, neardup, packing, pii, splitting, survivors, tokens


def test_encode_nulls_empty_repeats(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "kısa metin"), (3, "kısa metin"), (4, "uzun " * 9000)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = tokens.encode(df, "doc_id", "text").collect()
    c = tokens.codec(tokens.DEFAULT_FOLDER, "byte_bpe_50k")
    assert sorted((r["doc_id"], list(r["ids"])) for r in got) == sorted((i, c.enc.encode_ordinary(t or "")) for i, t in [(1, ""), (2, ""), (3, "kısa metin"), (3, "kısa metin"), (4, "uzun " * 9000)])
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.lengths(df, "doc_id", "text").collect()} == {r["doc_id"]: len(r["ids"]) for r in got}


@pytest.mark.parametrize("per", [60, 1000])
def test_packing_keeps_everything(spark, per):
    r = random.Random(1)
    sizes = [None, 0, 0, 100, 250, 99] + [r.randint(0, 130) for _ in range(200)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, size long")
    kinds = spark.createDataFrame([("k", 100), ("g", 1000)], "kap string, capacity int")
    rows = packing.pack(items, kinds, per_partition=per).collect()
    for kap, cap in (("k", 100), ("g", 1000)):
        own = [x for x in rows if x["kap"] == kap]
        total = {}
        for x in own:
            total[x["item"]] = total.get(x["item"], 0) + x["size"]
        assert total == {i: s or 0 for i, s in enumerate(sizes)}
        load = {}
        for x in own:
            load[x["bin_id"]] = load.get(x["bin_id"], 0) + x["size"]
        assert max(load.values()) <= cap
        pieces = {i: sum(1 for x in own if x["item"] == i) for i in total}
        assert all(pieces[i] == max(1, -(-(s or 0) // cap)) for i, s in enumerate(sizes))
        assert len(load) <= sum(s or 0 for s in sizes) / cap * 1.25 + 2
    assert packing.pack(items.limit(0), kinds).count() == 0


def test_split_rows(spark):
    df = spark.createDataFrame([("a", "  " + "kelime " * 50 + " "), ("b", "kısa"), ("c", None), ("d", " \n")], "k string, t string").withColumns({"m": F.lit(40), "o": F.lit(10)})
    got = splitting.split_long(df, ["k"], "t", "m", "o").orderBy("chunk_index").collect()
    assert {r["k"] for r in got} == {"a"}
    t = ("kelime " * 50).strip()
    assert all(r["chunk"] == t[r["start"] : r["end"]] and len(r["chunk"]) <= 40 for r in got)
    assert [r["chunk_index"] for r in got] == list(range(got[0]["n_chunks"]))


def test_lookalike_pairs(spark):
    base = "TL tutarında kira bedeli ödenmiştir"
    rows = [(1, base), (2, base.replace("T", "Τ", 1)), (3, base), (4, base.replace("e", "е")), (5, base.replace("ö", "o")), (6, "ｋira"), (7, "kira"), (8, None), (9, ""), (10, "​"), (11, "Решение суда"), (14, "Рeшение суда"), (12, base + " "), (13, base + " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("canon", F.lit(1))
    canon = lookalikes.canonical(df, "doc_id", "text")
    by = {r["doc_id"]: r["folded"] for r in canon.collect()}
    assert by[2] == base and by[4] == base and by[8] is None and by[9] == "" and by[11] == by[14] == "Решение суда"
    got = {(r[0], r[1]) for r in lookalikes.same_looking(canon, "doc_id").collect()}
    assert got == {(1, 2), (1, 4), (2, 3), (3, 4), (2, 4), (6, 7), (11, 14), (12, 13)}
    star = {(r[0], r[1]) for r in lookalikes.same_looking(canon, "doc_id", expand=2).collect()}
    parent = {}
    root = lambda x: x if parent.get(x, x) == x else root(parent[x])
    for a, b in star:
        parent[root(a)] = root(b)
    assert len({root(x) for x in (1, 2, 3, 4)}) == 1 and len(star) < len(got) + 1


def near_truth(rows, size, threshold, least):
    sets = {}
    for k, t in rows:
        w = neardup.words_of(t or "")
        if k is not None and len(w) >= least:
            sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    return {tuple(sorted(p)) for p in itertools.combinations(sets, 2) if len(sets[p[0]] | sets[p[1]]) and len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) >= threshold}


@pytest.mark.parametrize("shard", [4096, 8])
def test_near_duplicates_against_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(neardup, "SHARD", shard)
    monkeypatch.setattr(neardup, "PLAN", 1)
    r = random.Random(4)
    word = lambda: f"k{r.randint(0, 400)}"
    rows = []
    for g in range(25):
        t = [word() for _ in range(r.randint(32, 90))]
        for v in range(r.choice([1, 2, 3, 6])):
            u = list(t)
            for _ in range(r.randint(0, 4)):
                u[r.randrange(len(u))] = word()
            rows.append((f"d{g:02d}-{v}", " ".join(u)))
    rows += [(rows[0][0], rows[0][1]), ("copy", rows[3][1].upper()), ("null", None), ("empty", ""), ("short", "az söz")]
    df = spark.createDataFrame(rows, "id string, t string").withColumns({"c": F.lit(1), "fp": F.lit("x")})
    members, links = neardup.near_duplicates(df, "id", "t", size=3, threshold=0.6, min_words=30)
    pairs = [(x[0], x[1]) for x in neardup.document_pairs(members, links).collect()]
    want = near_truth(dict(rows).items(), 3, 0.6, 30)
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    groups = {x["id"]: x["group"] for x in neardup.components(members, links).collect()}
    for a, b in want:
        assert groups[a] == groups[b]
    assert len(groups) == len({k for k, t in rows if t and len(neardup.words_of(t)) >= 30})
    none = neardup.near_duplicates(df.limit(0), "id", "t")
    assert neardup.document_pairs(*none).count() == 0


def test_survivors_and_model(spark):
    cl = spark.createDataFrame([("C1",), (" c1 ",), ("C2",), (None,)], "cluster_id string")
    mem = spark.createDataFrame([("c1", "A", "s"), ("C1", "a ", "S"), ("c1", "B", "t"), ("c1", "gone", "t"), ("c2", "A", "s"), (None, "B", "t")], "cluster_id string, document_id string, source string")
    cols = "document_id string, source string, title string, court string, chamber string, decision_date string, esas_no string, karar_no string, source_url string, full_text string, markdown string, content_status string, retrieved_at timestamp"
    t = datetime(2024, 1, 1)
    docs = spark.createDataFrame([
        ("A", "s", "T1", "--", None, "31.02.2014", "1", None, "u", "x" * 60, None, "full_text", t),
        ("A", "s", "T1", "--", None, "31.02.2014", "1", None, "u", "x" * 60, None, "full_text", t),
        ("B", "t", "T2", "C", " ", "01.02.2014", "2", None, None, "kısa", None, "full_text", None),
    ], cols)
    rec = survivors.group_records(cl, mem, docs)
    got = {(r["cluster_id"], r["field_name"]): r["document_id"] for r in survivors.survivors(rec).collect()}
    assert got == {("C1", "title"): "A", ("C1", "court"): "B", ("C1", "decision_date"): "B", ("C1", "esas_no"): "A", ("C1", "source_url"): "A", ("C1", "full_text"): "A"}
    claims = survivors.claims(survivors.group_records(cl, mem, docs, values=True))
    judged = {(r["field_name"], r["value"], r["document_id"], r["n_yes"], r["n_no"]) for r in survivors.judged_values(claims).collect()}
    # a member without a value is silent
    assert judged >= {("title", "T1", "A", 1, 1), ("title", "T2", "B", 1, 1), ("court", "C", "B", 1, 0), ("esas_no", "2", "B", 1, 1)}
    agree = {r["field_name"]: r for r in survivors.agreement(claims).collect()}
    assert agree["court"]["n_groups"] == agree["court"]["n_same"] == 1 and agree["title"]["n_contested"] == 1
    assert survivors.survivors(survivors.group_records(cl.limit(0), mem, docs)).count() == 0


CLAIM = "cluster_id string, field_name string, value long, shown string, holder struct<document_id:string,source:string>, votes array<struct<src:string,yes:int,no:int>>"


def ballot(yes, who):
    return [(s, int(s in yes), int(s not in yes)) for s in sorted(who)]


def test_latent_quality_finds_the_bad_source(spark):
    r = random.Random(1)
    rows = []
    for g in range(300):
        yes_true = [s for s, p in (("good", 0.95), ("fair", 0.85), ("bad", 0.3)) if r.random() < p]
        wrong = [s for s, p in (("good", 0.02), ("fair", 0.1), ("bad", 0.7)) if r.random() < p]
        for v, yes in ((1, yes_true), (2, wrong)):
            if yes:
                rows.append((str(g), "f", v, str(v), (str(g), "s"), ballot(yes, {"bad", "fair", "good"})))
    claim = spark.createDataFrame(rows, CLAIM)
    q, _ = survivors.latent_quality(claim)
    assert q["good", "f"][0] > q["fair", "f"][0] > q["bad", "f"][0] and q["good", "f"][1] > q["bad", "f"][1]
    judged = survivors.judged_values(claim)
    right = judged.filter("retained and value = '1'").count()
    assert right / judged.filter("retained").count() > 0.85 and right / judged.filter("value = '1'").count() > 0.85


def test_several_true_values_are_kept(spark):
    r = random.Random(2)
    rows = []
    for g in range(300):
        # two true values; every source knows each of them or not, and seldom says a false one
        said = {v: sorted(s for s in "abcd" if r.random() < (0.75 if v != "x" else 0.06)) for v in ("p", "q", "x")}
        who = {s for yes in said.values() for s in yes}
        rows += [(str(g), "f", i, v, (str(g), "s"), ballot(yes, who)) for i, (v, yes) in enumerate(said.items()) if yes]
    claim = spark.createDataFrame(rows, CLAIM)
    judged = survivors.judged_values(claim)
    right = judged.filter("retained and value <> 'x'").count()
    assert right / judged.filter("retained").count() > 0.9 and right / judged.filter("value <> 'x'").count() > 0.9


def test_pii_frame(spark):
    t = "Davacı Nurmiray Alagaltaş, Lale Mah. Okul Sok. No: 5 D: 3 Kuzköprülü/Taşpınarca adresinde oturduğunu beyan etmiştir."
    df = spark.createDataFrame([("a", t, None), ("a", t, None), ("b", None, ""), ("c", "düz", t)], "document_id string, full_text string, markdown string")
    got = pii.find(df, "document_id", ["full_text", "markdown"]).select("document_id", "field_name", "pii_type", "start_pos").distinct().collect()
    assert {tuple(r) for r in got} == {("a", "full_text", "person", 7), ("a", "full_text", "address", 27), ("c", "markdown", "person", 7), ("c", "markdown", "address", 27)}
    red = {r["document_id"]: r for r in pii.redacted(df, "document_id", ["full_text", "markdown"]).collect()}
    assert red["a"]["full_text"].startswith("Davacı [PERSON], [ADDRESS]") and red["b"]["full_text"] is None and red["c"]["full_text"] == "düz"
