import random

import pytest

from kernmill.llm import encoding as E

SCHEMA = "row_id long, name string, `desc` string, aka array<string>, chain string, field int"


@pytest.fixture(scope="module")
def words():
    rng = random.Random(8)
    mk = lambda cons, vow, n: "".join(rng.choice(cons) + rng.choice(vow) for _ in range(n))
    out = []
    for _ in range(700):
        out.append((mk("bdgklmnprstvz", "aeiouéèêáãöüïôøåñç", 3) + "grad").capitalize() + " – x’s")
        out.append(mk("бвгджзклмнпрстфхчш", "аеиоуыяю", 3).capitalize())
        out.append(mk("βγδκλμνπρστφχ", "αειουάέή", 3).capitalize())
        out.append("".join(rng.choice("アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ") for _ in range(4)))
        out.append("".join(rng.choice("山川田水木林森石星海月雪安清明文南北東西") for _ in range(3)))
        out.append("Ñ" + mk("bdgklmn", "aeiou", 2) + " " + rng.choice(["½", "§ 3", "© 1634", "90 °C", "SÃO", "€5"]))
    return out


@pytest.fixture(scope="module")
def model(words):
    return E.fit(words[: len(words) * 3 // 4])


@pytest.mark.parametrize("chain", ["utf8-as-cp1252", "utf8-as-latin1", "utf8-as-macroman", "utf8-as-cp437", "utf8-as-koi8r", "utf8-as-cp1251",
                                   "utf8-as-gbk", "utf8-as-cp1252-twice", "sjis-as-cp1252", "cp1251-as-latin1", "gbk-as-latin1"])
def test_held_out_damage_is_found_and_undone(words, model, chain):
    hit = total = right = 0
    for w in words[len(words) * 3 // 4 :]:
        g = E.garble(w, chain)
        if g is None or (chain.startswith("cp1251") and not w[0] > "Ѐ") or (chain == "sjis-as-cp1252" and not "ァ" <= w[0] <= "ヺ"):
            continue
        if chain == "gbk-as-latin1" and not ("ァ" <= w[0] <= "ヺ" or "一" <= w[0]):
            continue
        if not any(ord(c) > 127 for c in g):
            continue
        total += 1
        c, fixed = E.judge(g, model)
        hit += c != E.CLEAN
        right += fixed == w
    assert total > 30 and hit / total > 0.95 and right / total > 0.9, (total, hit, right)


def test_held_out_clean_values_stay(words, model):
    held = words[len(words) * 3 // 4 :]
    assert sum(E.judge(w, model)[0] != E.CLEAN for w in held) / len(held) < 0.01


def test_every_chain_inverts_what_it_garbles(words):
    for chain in E.CHAINS:
        for w in words[:300]:
            g = E.garble(w, chain)
            if g is not None and E.restore(g, chain) is not None:
                assert E.restore(g, chain) == w


@pytest.mark.parametrize("good, chain", [
    ("tower of Loum ’s quarter", "cp1252-as-latin1"), ("capital – seat of the court", "cp1252-as-latin1"), ("Хиналя", "koi8r-as-cp1251"),
])
def test_signs_and_swapped_letters(model, good, chain):
    assert E.judge(E.garble(good, chain), model) == (chain, good)


def test_lossy_and_edges(model):
    assert E.judge("P�s", model) == ("lossy", None)
    for v in (None, "", "plain", "SÃO Paulo", "© X 1634", "90 °C", "–"):
        assert E.judge(v, model)[0] == E.CLEAN, v


def test_fields(spark, model):
    bad = "KÃ©tol Ã¤b"
    rows = [(1, bad, bad, ["ok", None, bad], "x", 1), (1, bad, None, None, "x", 1), (2, "ok", "", [], "x", 1), (None, bad, None, None, None, None), (3, "a" * 100_000 + bad, None, [None], "", 0)]
    got = E.find_garbled(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert sorted((str(r["row_id"]), r["field"]) for r in got) == sorted(
        [("1", "name"), ("1", "desc"), ("1", "aka"), ("1", "name"), ("None", "name"), ("3", "name")])
    assert next(r for r in got if r["field"] == "aka")["restored"] == ["ok", None, "Kétol äb"]
    empty = spark.createDataFrame([], SCHEMA)
    assert E.find_garbled(empty, E.train(empty)).count() == 0


@pytest.mark.parametrize("bad, good", [
    ("THÃ„FLIDÃSHOLM", None), ("tributary of the FlÃ\xadseÄor , 58.6 km long", None), ("cafÃ© à Paris", "café à Paris"),
    ("capital of Poupeiford â€“ seat of the Vêflîkäholm court", "capital of Poupeiford – seat of the Vêflîkäholm court"),
    ("площадь в городе " + E.garble("Северогорск", "utf8-as-cp1251") + " и река на юге страны", "площадь в городе Северогорск и река на юге страны"),
    ("village near " + E.garble("Северогорск", "cp1251-as-latin1"), "village near Северогорск"),
])
def test_single_damaged_sequences_and_words(model, bad, good):
    chain, fixed = E.judge(bad, model)
    assert chain != E.CLEAN and fixed == good, (chain, fixed)


def test_genuine_letters_side_by_side_stay(model):
    for v in ("Lãço Prathopoux", "FÍBÃŽØR-VRAEKOURKBY", "FÊVÃŽUOV", "TÅRÅŠÏSIĆ JOURNAL", "Doavrae Çïçå", "Våteváltby Fïkrávêmford", "le «CAFÉ» à SKÅ", "SÃO João é à Âncora", "Ærø und Øst", "река Рёва"):
        assert E.judge(v, model)[0] == E.CLEAN, v


@pytest.mark.parametrize("chain", [c for c in E.CHAINS if E.CHAINS[c][0][0] in ("cp932", "gbk", "big5", "euc-jp")])
def test_kanji_names_are_judged_under_every_chain(words, model, chain):
    held = [w for w in words[len(words) * 3 // 4 :] if all("一" <= ch for ch in w)]
    held = [w for w in sorted(set(held)) if (g := E.garble(w, chain)) is not None and not g.isascii() and E.restore(g, chain)]
    assert len(held) > 30
    assert sum(E.judge(E.garble(w, chain), model)[0] != E.CLEAN for w in held) == len(held)


@pytest.mark.parametrize("good, chain", [
    ("Москва NATO", "cp1251-as-latin1"), ("футболист клуба CSKA", "koi8r-as-latin1"), ("南東 Beijing", "gbk-as-latin1"), ("Tokyo 東西南", "sjis-as-cp1252"),
])
def test_legacy_damage_beside_latin_words(model, good, chain):
    assert E.judge(E.garble(good, chain), model)[1] == good


def test_damage_with_losses_is_learned(words, model):
    held = [w for w in words[len(words) * 3 // 4 :] if "a" <= w[-7:-6] <= "z" or w[0] > "Ͱ"]
    cut = [t for w in held if (g := E.garble(w, "utf8-as-cp1252")) and (t := E.truncate(g)) and t != w]
    assert len(cut) > 100 and sum(E.judge(t, model)[0] != E.CLEAN for t in cut) / len(cut) > 0.9
