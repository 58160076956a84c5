import pytest

from kernmill.llm import sentences as S

TRAIN = [
    "The mill was sold in 1630. The tower is old.\nIt lies near Loum. Dr. Fox moved to Zorb in 1686.\nMr. and Mrs. Prakon kept it.\nIt was moved by K. C. Vrae.",
    "It is named after St. Grip of Riap.\nSee p. 154, vol. 2.\nIt costs approx. 18 coins, e.g. the local kinds.\nThe firm sold it to Fleto & Co.\nHe left at 4 p.m.\nIt was built by Capt. Roux Jr. in May.",
    "Die Kirche stammt aus dem 13. Jahrhundert und ist alt.\nAm 5. Mai 1854 wurde sie verkauft.\nDort wachsen z. B. Moose.\nProf. Wadek schrieb darüber.",
    "قال د. قوبا إن السوق قديم.\nبُني الجسر عام 1329 وطوله 50 كم.\nقال د. زيما إن السوق قديم.\nبُني الجسر عام 1433 وطوله 64 كم.",
] * 12


@pytest.fixture(scope="module")
def model():
    return S.fit(TRAIN)


def _cut(text, model):
    return [text[a:b] for a, b in S.split_text(text, model)]


@pytest.mark.parametrize("parts", [
    ["Title line", "First one. ", "Second one!"],
    ["The mill was sold in 1630. ", "Dr. Fox moved it. ", "It was named after St. Grip of Riap."],
    ["“It is late. We must go,” said Fox. ", "The end."],
    ["He wrote: “The mill is lost. Nobody went back.” ", "The firm closed."],
    ["(The harbour itself was sold.) ", "The next one."],
    ["“Who drained it?” asked the judge. ", "Nobody."],
    ["It was sold to Fleto & Co. ", "There is a tower."],
    ["Die Kirche stammt aus dem 13. Jahrhundert und ist 4.5 m hoch. ", "Welch ein Turm!"],
    ["—Es tarde. Vámonos —dijo Ana. ", "¡Qué torre! ", "¿Quién fue?"],
    ["« Il est tard. Partons », dit Jean. ", "Le canal fut fermé en 1493 ! ", "Qui ?"],
    ["「もう遅い。帰ろう。」とモリは言った。", "橋は1368年に完成した。", "誰か？"],
    ["“天晚了。我们走吧。”明月说道。", "人口约97人；另有渔业。"],
    ["“देर हो गई। चलो,” नस ने कहा। ", "कितनी ऊँची मीनार है!"],
    ["قال د. قوبا إن السوق قديم. ", "بُني الجسر عام 1329 وطوله 50 كم. ", "من بنى برجا؟"],
    ["Ποιος έχτισε τον πύργο; ", "Ήταν μικρό· είχε 64 κατοίκους."],
    ["สะพานสร้างในปี 1477 และยาว 21.20 กิโลเมตร ", "มีประชากรประมาณ 96 คน ", "ใครสร้างหอคอย"],
    ["The opera, Fox said … was never finished. ", "It ended."],
])
def test_cuts(model, parts):
    text = parts[0] + "\n" + "".join(parts[1:]) if parts[0] == "Title line" else "".join(parts)
    assert _cut(text, model) == [p.strip() for p in parts]


def test_offsets_cover_the_text(model):
    for text in ["a\r\nb\rc d\x85e", "  \n x. Y z.  \n\n　q　", "𝔙 one. Two 🚀. Three", "no end", '"open. Quote', "((a. B)", "... ! ? .", "." * 50]:
        cuts = S.split_text(text, model)
        assert all(a < b and text[a:b] == text[a:b].strip() for a, b in cuts)
        assert all(x[1] <= y[0] for x, y in zip(cuts, cuts[1:]))
        left = "".join(ch for i, ch in enumerate(text) if not any(a <= i < b for a, b in cuts))
        assert not left.strip()


def test_edges(spark, model):
    assert [S.split_text(t, model) for t in (None, "", " \n ")] == [[], [], []]
    d = spark.createDataFrame([(1, "A b. C d.", 0), (1, "A b. C d.", 0), (2, None, 0), (None, "x", 0), (3, "word " * 100_000 + ". End.", 0)], "doc_id long, text string, char_start int")
    got = S.split_documents(d, model).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got if r[0] in (1, None)) == [("1", 0, 4), ("1", 0, 4), ("1", 5, 9), ("1", 5, 9), ("None", 0, 1)]
    empty = d.limit(0)
    assert S.split_documents(empty, S.train(empty)).count() == 0


def test_small_letters_do_not_forbid_a_boundary(model):
    assert _cut("iPhone sales rose. iPads fell. eBay grew.", model) == ["iPhone sales rose.", "iPads fell.", "eBay grew."]
    assert _cut("The mill was sold. it was old, e.g. the tower", model) == ["The mill was sold. it was old, e.g. the tower"]


def test_abbreviations_come_from_the_texts():
    """Held-out lines: made-up abbreviations, learned from where they stand, cut nothing; the same words spelt out do."""
    rng = __import__("random").Random(3)
    word = lambda n: "".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(n))
    short = [word(1) + "x" for _ in range(8)]
    names = [word(3).capitalize() for _ in range(300)]
    nouns = [word(2) for _ in range(200)]
    line = lambda: f"The {rng.choice(nouns)} met {rng.choice(short)}. {rng.choice(names)} at the {rng.choice(nouns)}. {rng.choice(names)} saw the {rng.choice(nouns)}."
    m = S.fit(["\n".join(line() for _ in range(6)) for _ in range(150)])
    held = [line() for _ in range(300)]
    right = sum([h[a:b] for a, b in S.split_text(h, m)] == [h[: h.index(". ", h.index(" at ")) + 1], h[h.index(". ", h.index(" at ")) + 2 :]] for h in held)
    assert right / len(held) > 0.95


def test_sentences_of_repeated_ids_are_not_multiplied(spark, model):
    d = spark.createDataFrame([(1, "The mill is old. The tower too."), (1, "The mill is old."), (None, None)], "doc_id long, text string")
    got = S.split_documents(d, model, with_text=True).collect()
    assert sorted(r["sentence"] for r in got) == ["The mill is old.", "The mill is old.", "The tower too."]


def test_a_token_is_read_whole(model):
    long = "x" * 5000
    assert [c.stop.before for c in S.candidates(f"a {long}. The end. ") if c.stop] == [long]


def test_tokens_begin_anew_after_a_stop_without_a_blank(model):
    assert _cut("It lies near Loumburg.Dr. Fox moved to Zorb.", model) == ["It lies near Loumburg.", "Dr. Fox moved to Zorb."]
    assert [c.stop.before for c in S.candidates("It lies near Loumburg.Dr. Fox moved. X")] == ["Loumburg", "Dr", "moved"]


def test_the_token_after_keeps_its_case():
    assert S._next("On") != S._next("on") and S._next("12") == S._next("34") and S._next("A") == "<I>"


def test_training_covers_all_documents(spark):
    """An abbreviation is learned where it stands only in documents beyond the first thousands, and in one very long text."""
    line = lambda k, short: f"The mill met {short}. Fox{k} at the tower. Vrae{k} saw it."
    plain = [f"The mill {k} is old.\nVrae{k % 50} lies near the tower." for k in range(7000)]
    long = "\n".join(line(k % 50, "xq") for k in range(600))
    assert len(long) > 20_000
    late = "\n".join(line(k % 50, "zv") for k in range(300))
    rows = [*enumerate(plain), (7000, long), (7001, late)]
    model = S.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert model.base == S.fit([t for _, t in rows]).base
    for short in ("xq", "zv"):
        assert _cut(line(7, short), model) == [f"The mill met {short}. Fox7 at the tower.", "Vrae7 saw it."]
    count = lambda token: list(model.seen.get(S._key(token)))
    assert (count("xq"), count("zv"), count("old")) == ([600, 0], [300, 0], [7000, 7000])


def test_training_does_not_depend_on_layout_or_place(spark, monkeypatch):
    texts = [*TRAIN, None, "", "—\n“Ah. Oh!”\n5. Mai. x", "12. . 3? Ja"]
    want = S.fit(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for parts, driver_cases, chars in ((1, 10**6, 10**6), (5, 10**6, 100), (3, 0, 300)):
        monkeypatch.setattr(S, "STEPS", 120 if driver_cases else 6)
        monkeypatch.setattr(S, "DRIVER_CASES", driver_cases)
        monkeypatch.setattr(S, "CHUNK_CHARS", chars)
        monkeypatch.setattr(S, "BLOCK_CASES", chars)
        got = S.train(d.repartition(parts))
        want = want if driver_cases else S.fit(texts)
        assert got.base == want.base
        assert (got.seen.keys == want.seen.keys).all() and (got.seen.counts == want.seen.counts).all()
        assert (got.starts.keys == want.starts.keys).all() and (got.starts.counts == want.starts.counts).all()
        assert (got.weights == want.weights).all()


def test_habits_look_up_any_key():
    h = S.Habits.of([5, -3, 9], [1, 2, 3], [4, 5, 6])
    assert [h.get(k) for k in (-3, 5, 9, 4, 10, -9)] == [[2, 5], [1, 4], [3, 6], [0, 0], [0, 0], [0, 0]]
    assert S.Habits.of([], [], []).get(1) == [0, 0]


def test_staged_places_give_the_sentences_of_the_texts(spark, monkeypatch):
    odd = [None, "", " \n ", "  . Foo. Bar", "“Oh.” x\n(Ah.) 5 (Oh.) 6", "He. ( a. ) ( b! ) “c.” « Il. » 7 “", "a\r\nb\rc. D", "ไป มา. ไป", "x. “\n) y", "「誰。」と", "Z. 5. ! ."]
    rows = [(k % 40, t) for k, t in enumerate([*odd, *TRAIN])] + [(None, "A b. C d.")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, S.split_documents(d, S.train(d)).collect()))
    for chars in (10**6, 50):
        monkeypatch.setattr(S, "CHUNK_CHARS", chars)
        assert sorted(map(str, S.find_sentences(d.repartition(2)).collect())) == want
    assert S.find_sentences(d.limit(0)).count() == 0
