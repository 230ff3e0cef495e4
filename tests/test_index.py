"""The stored index against scores counted in one pass over the texts, and what keeps it up to date."""

import math
import random

import pytest
from pyspark.sql import functions as F

from derlem.operators import search
from derlem.operators.index import Index, index_of


@pytest.fixture
def docs(spark):
    r = random.Random(1)
    words = ["kira", "tapu", "bedel", "Ihlal", "istem", "karar", "dava"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 30)))) for i in range(60)]
    return spark.createDataFrame([*rows, (60, None), (61, ""), (62, "kira bedel artışı; kira"), (None, "kira")], "k long, t string")


def scores(df, key="key"):
    return {r[key]: round(r["score"], 9) for r in df.collect()}


def test_scores_equal_a_pass_over_the_texts(spark, docs, tmp_path):
    ix = Index(spark, str(tmp_path / "ix")).build(docs, "k", "t", buckets=4)
    own = docs.filter("k is not null")
    for terms, mode in ((["kira", "bedel"], "and"), (["kira", "tapu", "yok"], "or"), (["yok", "kira"], "and")):
        assert scores(ix.bm25(terms, mode=mode)) == scores(search.bm25(own, "k", "t", terms, mode=mode), "k")
    want, got = scores(search.tfidf_cosine(own, "k", "t", ["kira", "tapu", "yok"]), "k"), scores(ix.cosine(["kira", "tapu", "yok"]))
    assert want.keys() == got.keys() and all(math.isclose(want[k], got[k], rel_tol=1e-6) for k in want)
    keys = lambda df: {r[0] for r in df.collect()}
    low = {r["k"]: (r["t"] or "").replace("I", "ı").lower().replace(";", "").split() for r in own.collect()}
    pairs = lambda w: set(zip(w, w[1:]))
    assert keys(ix.match([], [["kira", "bedel"]])) == {k for k, w in low.items() if ("kira", "bedel") in pairs(w)}
    assert keys(ix.match(["dava"], [["kira", "kira"]])) == {k for k, w in low.items() if ("kira", "kira") in pairs(w) and "dava" in w}
    assert keys(ix.match(["ihl", "be"], prefix=True)) == {k for k, w in low.items() if any(x.startswith("be") for x in w) and any(x.startswith("ihl") for x in w)}
    with pytest.raises(ValueError):
        ix.match([])
    s = ix.status(docs, "k").first()
    assert (s["n_table"], s["n_index"], s["n_missing"], s["coverage"]) == (63, 63, 0, 1.0)


def test_no_text_is_read_and_only_the_terms_folders(spark, docs, tmp_path):
    ix = Index(spark, str(tmp_path / "ix")).build(docs, "k", "t", buckets=16)
    files = ix.bm25(["kira"]).inputFiles()
    assert files and all("/postings/b=" in f or "/terms/" in f for f in files) and len({f.split("/b=")[1].split("/")[0] for f in files if "/b=" in f}) == 1
    assert "text" not in ix._read("postings").columns


def test_append_delete_compact_rebuild(spark, docs, tmp_path):
    first, rest = docs.filter("k < 30"), docs.filter("k >= 30")
    ix = Index(spark, str(tmp_path / "a")).build(first, "k", "t", buckets=4)
    frozen = {r["term"]: r["idf"] for r in ix.idf().collect()}
    ix.append(docs, "k", "t")
    assert {r["term"]: r["idf"] for r in ix.idf().collect()} == frozen and ix.documents().count() == 63
    # live counts of all documents, as if they had come at once
    whole = Index(spark, str(tmp_path / "b")).build(docs, "k", "t", buckets=4)
    assert scores(ix.bm25(["kira", "dava"])) == scores(whole.bm25(["kira", "dava"]))
    gone = rest.filter("k % 3 = 0").select("k")
    ix.delete(gone)
    left = docs.filter("k is not null").join(gone, "k", "left_anti")
    want = scores(search.bm25(left, "k", "t", ["kira", "dava"]), "k")
    assert scores(ix.bm25(["kira", "dava"])) == want
    ix.compact()
    assert scores(Index(spark, str(tmp_path / "a")).bm25(["kira", "dava"])) == want and len(ix.meta["generations"]) == 1
    assert {r["term"]: r["idf"] for r in ix.idf().collect()} == frozen
    ix.rebuild(left, "k", "t", buckets=4)
    assert {r["term"] for r in ix.idf().collect()} >= {"artışı"} and scores(ix.bm25(["kira", "dava"])) == want


def test_a_broken_build_goes_on(spark, docs, tmp_path, monkeypatch):
    root = str(tmp_path / "ix")
    write = Index._write

    def fails(self, number, *rest):
        if number == 2:
            raise RuntimeError("lost")
        write(self, number, *rest)

    monkeypatch.setattr(Index, "_write", fails)
    with pytest.raises(RuntimeError):
        Index(spark, root).build(docs, "k", "t", buckets=4, batches=3)
    written = []
    monkeypatch.setattr(Index, "_write", lambda self, number, *rest: (written.append(number), write(self, number, *rest)))
    ix = Index(spark, root).build(docs, "k", "t", buckets=4, batches=3)
    assert written == [2] and ix.documents().count() == 63
    assert scores(ix.bm25(["kira"])) == scores(search.bm25(docs.filter("k is not null"), "k", "t", ["kira"]), "k")


def test_a_changed_table_gets_a_new_index(spark, docs, tmp_path):
    path = str(tmp_path / "t.parquet")
    docs.write.parquet(path)
    a = index_of(spark, path, "k", "t")
    assert index_of(spark, path, "k", "t").root == a.root
    docs.filter("k < 5").write.mode("append").parquet(path)
    assert index_of(spark, path, "k", "t").root != a.root


def test_pages_and_predicates(spark):
    df = spark.createDataFrame([(1, 0.5, "tr", None), (2, 0.9, "en", "2024-01-01"), (3, 0.9, "tr", "2023-01-01")], "k long, score double, lang string, at string")
    ids = lambda **how: [r["k"] for r in search.page(df, "k", time="at", **how).collect()]
    assert ids() == [2, 3, 1] and ids(sort="fetched_at_desc") == [2, 3, 1] and ids(sort="fetched_at_asc") == [1, 3, 2] and ids(sort="date") == [2, 3, 1]
    assert ids(limit=1, offset=1) == [3] and search.page(df, "k", limit=1).first()["total"] == 3
    keep = lambda where, **how: {r["k"] for r in df.filter(search.predicate(where, **how)).collect()}
    assert keep({"lang": "T"}) == {1, 3} and keep({"lang": "tr"}, exact=("lang",)) == {1, 3} and keep({"at": None}) == {1} and keep({"k": [1, 2]}) == {1, 2} and keep({"score": (0.6, 1.0), "lang": "en"}) == {2} and keep({}) == {1, 2, 3}
    none = df.limit(0)
    assert [r["k"] for r in search.fallback(df.filter("k = 1"), df, 2).collect()] == [1, 2, 3] and search.fallback(df, df, 2).count() == 3 and search.fallback(none, none, 2).count() == 0
    two = {(r["k"], r["all_terms"]) for r in search.two_stage(df.filter("k = 1").select("k", "score"), df.select("k", "score"), "k", 2).collect()}
    assert two == {(1, True), (2, False), (3, False)}
    assert search.two_stage(df.filter("k < 3").select("k", "score"), df.select("k", "score"), "k", 2).count() == 2
    r = {x["k"]: (x["a"], x["b"]) for x in search.rrf_with_ranks({"a": search.top(df, "k", 2), "b": search.top(df, "k", 1, ascending=True)}, "k").collect()}
    assert r == {2: (1, None), 3: (2, None), 1: (None, 1)}
    assert df.select(F.lit(1)).count() == 3
