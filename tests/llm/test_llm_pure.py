import random

import numpy as np
import pytest

from derlem.llm import lookalikes as L
from derlem.llm.neardup import LEAF, RADIUS, VantageTree, jaccard, runs, shard_pairs, sketch, small_pairs, words_of
from derlem.llm.packing import best_fit_decreasing, lower_bound
from derlem.llm.pii import OVERLAP, WINDOW, check, cover, find_all, redact, stitch, valid_id
from derlem.llm.pii_model import Model, code
from derlem.llm.splitting import bisect, boundaries
from derlem.llm.tokens import codec, first_sure, last_sure


@pytest.fixture(scope="module")
def bpe():
    return codec("/opt/tokenizers", "byte_bpe_50k")


TEXTS = ["a", " ", "\n\n  \n", "x" * 500, "Merhaba dünya! <|endoftext|> it's 12  34\t\n\n son", "é" * 90 + "  " * 40, "no_space_" * 60, "👍🏽 ⚖️ " * 50, "a  b   c    " * 40, "日本語のテキスト。" * 30]


@pytest.mark.parametrize("leaf", [1, 3, 17, 64])
def test_tree_equals_whole(bpe, leaf):
    for t in TEXTS:
        ids = bpe.encode(t, leaf)
        assert ids == bpe.enc.encode_ordinary(t)
        assert bpe.enc.decode(ids) == t


def test_random_texts_and_cuts(bpe):
    r = random.Random(2)
    for _ in range(300):
        t = "".join(r.choice("ab'sç \n\t1.0️İ’") for _ in range(r.randint(1, 80)))
        assert bpe.encode(t, r.randint(1, 9)) == bpe.enc.encode_ordinary(t)


def test_sure_boundaries():
    assert last_sure("ab cd  ", 2) == 5 and last_sure("abcd", 1) == 0 and first_sure("  ab cd", 1) == 4 and first_sure("abcd", 2) == 4


def test_packing_bounds_hold_and_items_fit():
    r = np.random.default_rng(1)
    for cap in (1, 7, 100, 512):
        for _ in range(30):
            s = r.integers(0, cap + 1, r.integers(1, 60))
            into, rooms = best_fit_decreasing(s, np.argsort(-s, kind="stable"), cap)
            load = np.bincount(into, weights=s, minlength=len(rooms))
            assert (load <= cap).all() and all(cap - x == y for x, y in zip(load, rooms))
            assert lower_bound(s, cap) <= sum(x > 0 for x in load)
    # three items above half need three containers although their volume fits two
    assert lower_bound(np.array([51, 51, 51]), 100) == 3
    # items above a third go two to a container at most
    assert lower_bound(np.array([34] * 6), 100) == 3
    assert lower_bound(np.array([0, 0]), 5) == 0


def test_bisect():
    r = random.Random(3)
    for _ in range(300):
        t = "".join(r.choice(["söz", "kelime", ". ", " ", "\n", "\n\n", "x" * 9, "é"]) for _ in range(r.randint(0, 90)))
        limit = r.randint(2, 60)
        over = r.randint(0, limit - 1)
        spans = bisect(t, limit, over)
        assert spans[0][0] == 0 and spans[-1][1] == len(t) and all(e - s <= limit for s, e in spans)
        ends = [e for _, e in spans]
        assert ends == sorted(ends) and "".join(t[a:b] for a, b in zip([0, *ends], ends)) == t
        # an overlap has at most the length specified and begins with a word where there is one to begin with
        for (s, _), (_, e) in zip(spans[1:], spans):
            assert max(0, e - over) <= s <= e
            assert s == max(0, e - over) or not any(t[i - 1].isspace() and not t[i].isspace() for i in range(max(1, e - over + 1), s))
    para = "Bir cümle burada.\n\n" + "İkinci bölüm burada biter."
    assert para[: bisect(para, 40, 0)[0][1]] == "Bir cümle burada.\n\n"
    with pytest.raises(ValueError):
        bisect("abc", 2, 2)
    # ordinals, initials and abbreviations end no sentence
    for t in ("Yargıtay 3. Hukuk Dairesi kararı", "vekili Av. Ali geldi", "uyarınca m. 12 gereği", "Prof. Dr. Kaya"):
        assert boundaries(t)[2] == []
    assert boundaries("Karar verildi. Dosya kapandı. 12 gün")[2] == [15, 30]
    t = "uzun kelimeler burada " * 9
    assert all(a == 0 or t[a - 1] == " " for a, _ in bisect(t.strip(), 60, 15))


def test_vantage_tree_is_exact():
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 20, dtype=np.uint64)
    fps = np.array([b ^ np.uint64(sum(1 << int(x) for x in r.choice(63, r.integers(0, 30), replace=False))) for b in base for _ in range(40)])
    tree = VantageTree(fps, leaf=4)
    for q in fps[::37]:
        assert sorted(tree.near(q, RADIUS)) == np.flatnonzero(np.bitwise_count(fps ^ q) <= RADIUS).tolist()
    same = np.full(100, 5, np.uint64)
    assert len(VantageTree(same).near(np.uint64(5), 0)) == 100
    ids = np.arange(len(fps))
    want = {(i, j) for i in ids for j in ids if i < j and np.bitwise_count(fps[i] ^ fps[j]) <= RADIUS}
    assert set(zip(*map(np.ndarray.tolist, shard_pairs(ids, fps)))) == want
    side = ids % 2
    assert set(zip(*map(np.ndarray.tolist, shard_pairs(ids, fps, side)))) == {(i, j) for i, j in want if side[i] != side[j]}
    a, b = small_pairs(ids[: LEAF // 2 * 2].reshape(2, -1), fps[: LEAF // 2 * 2].reshape(2, -1))
    assert set(zip(a.tolist(), b.tolist())) <= want


def test_runs_and_sketches():
    a, b = words_of("İlk söz, ikinci SÖZ! üçüncü_söz 4."), words_of("ilk söz")
    assert "söz" in a and "4" in a and runs(b, 3).size == 0
    x = runs(("a b c d e f " * 3).split(), 3)
    assert len(x) == 6 and jaccard(x, x) == 1 and sketch(x) == sketch(x[::-1])
    assert jaccard(runs(list("abcdefgh"), 3), runs(list("abcdefgx"), 3)) == pytest.approx(5 / 7)


def test_fold_and_repair():
    assert L.fold("ｅv​ ﬁrma\r\nso­n é") == "ev firma\nson é"
    assert L.fold("²") == "²" and L.fold("a  b") == "a  b" and L.fold("") == ""
    assert L.repair("ΤL") == "TL" and L.repair("іѕе") == "ise" and L.repair("суда") is None and L.repair("ise") is None
    assert L.dominant("ΤLa") == "LATIN" and L.dominant("12") == "" and L.dominant("іѕе") == "LATIN"
    # a Latin letter in a Cyrillic or a Greek word goes, not the word's own
    for bad, good, script in (("Мoсква", "Москва", "CYRILLIC"), ("президeнт", "президент", "CYRILLIC"), ("Κaλημέρα", "Καλημέρα", "GREEK"), ("kіra", "kira", "LATIN")):
        assert L.dominant(bad) == script and L.repair(bad) == good and L.repair(good) is None
    # a look-alike with an accent of its own
    assert L.repair("ӧdеmе") == "ödeme" and L.repair("elhӧуükс\u0327е") == "elhöyükçe" and L.repair("ёлка") is None
    # letters of two scripts that look like no others: nothing can be said
    assert L.repair("жaλ") is None and L.repair("μm") is None
    assert L.candidates("Решение ΤL ve іѕе") == {"ΤL": "TL", "іѕе": "ise"}
    assert L.apply_repairs("ΤL ΤLx", {"ΤL": "TL"}) == "TL ΤLx"


def test_gradients():
    m = Model(hidden=4)
    r = np.random.default_rng(0)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    seqs, tags = [r.integers(0, 60, n) for n in (7, 5)], [r.integers(0, 6, n) for n in (7, 5)]
    _, g = m.loss(seqs, tags)
    for k in m.p:
        i = tuple(r.integers(0, d) for d in m.p[k].shape)
        if k in ("tf", "tb"):
            i = (seqs[0][2], i[1])
        old, e = m.p[k][i], 1e-4
        m.p[k][i] = old + e
        up, _ = m.loss(seqs, tags)
        m.p[k][i] = old - e
        down, _ = m.loss(seqs, tags)
        m.p[k][i] = old
        assert (up - down) / 2 / e == pytest.approx(float(g[k][i]), abs=2e-3)


def test_decode_matches_search():
    import itertools

    m, r = Model(hidden=3, seed=5), np.random.default_rng(1)
    m.p["a"] = r.standard_normal((6, 6)).astype(np.float32)
    x = r.integers(0, 50, 4)
    e = m.emissions(x[None], np.array([4]))[0]
    best = max(itertools.product(range(6), repeat=4), key=lambda y: sum(e[t, y[t]] for t in range(4)) + sum(m.p["a"][y[t - 1], y[t]] for t in range(1, 4)))
    assert m.decode([x, x[:2]])[0].tolist() == list(best)


def test_pii_pieces():
    assert valid_id("10000000146") and not valid_id("10000000147") and not valid_id("01234567890")
    parts = cover(500)
    assert parts[0][0] == 0 and parts[-1][1] == 500
    whole = np.arange(500) % 6
    assert (stitch(500, parts, [whole[a:b].astype(np.uint8) for a, b in parts]) == whole).all()
    t = "No: 100-000-001-46 olan"
    assert check(t, 4, 18, 3) == [(4, 18, 3)] and check("No: 100-000-001-47 olan", 4, 18, 3) == []
    assert find_all([None, "", "düz metin"]) == [[], [], []]
    # odd blanks and hyphens keep their places
    t = "İletişim için GSM 0590\xa0214\xa007\xa050 bildirilmiştir."
    assert find_all([t]) == [[(18, 32, "phone")]] and find_all([t.replace("\xa0", "‑")]) == [[(18, 32, "phone")]]
    # an address begins with the name, not with the word of the sentence before it
    t = "Tebligat Doğanşan mah. 443. sokak no 150 Derepınarca/Ortakentli adresine çıkarılmış, bila dönmüştür."
    assert [(a, k) for a, _, k in find_all([t])[0]] == [(9, "address")]
    # a text far longer than a window, with an item in every part of it
    t = "Dosya incelendi. Davacı Nurmiray Alagaltaş vekili duruşmada hazır bulunmuştur. " * 40
    assert [k for *_, k in find_all([t])[0]] == ["person"] * 40
    assert redact("a b c", [(2, 3, "person")]) == "a [PERSON] c"


def test_pii_model_on_unseen_text():
    t = "Davalı Nurmiray Alagaltaş vekili duruşmada hazır bulunmuştur. İletişim için telefon numarası 0594 204 02 05 bildirilmiştir. Adres: Lale Mah. Okul Sok. No: 5 D: 3 Kuzköprülü/Taşpınarca. Yazışma nalagaltas@posta.example hesabından."
    kinds = [k for _, _, k in find_all([t])[0]]
    assert {"person", "phone", "email", "address"} <= set(kinds)


def test_pii_reads_every_character(monkeypatch):
    # names where neither two capitals in a row nor one inside a sentence announce them
    texts = ["Alagaltaş vekili duruşmada hazır bulunmuştur.", "Dosya incelendi. Nurmiray duruşmada dinlendi.", "davacı/Çamuşayoğlu vekili"]
    assert find_all(texts) == [[(0, 9, "person")], [(17, 25, "person")], [(7, 18, "person")]]
    # small letters alone, no item in them: all of them go to the network all the same
    plain = ["".join("abcçdefgğ hıijkl"[(i * i + k) % 16] for i in range(k)) for k in (1, 47, 511, 512, 513, 976, 977, 5000)]
    seen, decode = [], Model.decode
    monkeypatch.setattr(Model, "decode", lambda self, seqs: seen.extend(seqs) or decode(self, seqs))
    find_all(plain)
    given = {x.tobytes() for x in seen}
    for t in plain:
        parts = cover(len(t))
        assert parts[0][0] == 0 and parts[-1][1] == len(t) and max(b - a for a, b in parts) <= WINDOW
        assert all(a + OVERLAP - 1 <= e < b for (_, e), (a, b) in zip(parts, parts[1:]))
        assert all(code(t)[a:b].tobytes() in given for a, b in parts)


def test_decode_of_many_rows_equals_each_row_alone():
    r = np.random.default_rng(4)
    seqs = [r.integers(0, 60, k) for k in r.integers(1, 40, 120)]
    kinds = set()
    for seed in range(4):
        m = Model(hidden=5, seed=seed)
        m.p["a"] = r.standard_normal((6, 6)).astype(np.float32)
        # from mostly labelled to mostly outside
        m.p["b"][0] = seed * 1.5
        for x, got in zip(seqs, m.decode(seqs, inner=50)):
            e = m.emissions(x[None], np.array([len(x)]))[0]
            best, back = e[0], []
            for t in range(1, len(x)):
                cand = best[:, None] + m.p["a"]
                back.append(cand.argmax(0))
                best = cand.max(0) + e[t]
            path = [int(best.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            assert got.tolist() == path[::-1]
            kinds.add(any(path))
    assert kinds == {True, False}


def test_stitch_cuts_overlaps_in_their_middle():
    for n in (513, 976, 977, 5000):
        parts = cover(n)
        got = stitch(n, parts, [np.full(b - a, k, np.uint8) for k, (a, b) in enumerate(parts)])
        # farther from an edge than in any other window; the ends of the text are no edges
        room = [[min(i - a if a else n, b - 1 - i if b < n else n) if a <= i < b else -1 for i in range(n)] for a, b in parts]
        assert got.tolist() == np.argmax(room, 0).tolist()
