import random
import re
from collections import Counter

from kernmill.llm import overlap

SCHEMA = "ex_id long, `desc` string, contexts array<struct<sentence:string,span:struct<begin:int,end:int>>>, cls string, bag int"


def _text(desc, ctx):
    return "\n".join([x for x in [desc, *[c[0] for c in ctx or [] if c]] if x is not None])


def _sim(a, b):
    a, b = (Counter(re.findall(r"[^\W_]+", x.lower())) for x in (a, b))
    n = max(sum(a.values()), sum(b.values()))
    return n and sum((a & b).values()) / n


def _run(spark, ev, tr, t=0.8):
    mk = lambda rows: spark.createDataFrame([(i, d, c, "x", 1) for i, d, c in rows], SCHEMA)
    split = overlap.split_overlaps(mk(ev), mk(tr), threshold=t)
    found = overlap.expand_pairs(split).collect()
    got = Counter((r["e_id"], r["t_id"]) for r in found)
    apart = overlap.expand_pairs(overlap.split_overlaps(mk(ev), mk(tr), threshold=t, broadcast_words=-1)).collect()
    assert sorted(map(str, apart)) == sorted(map(str, found))
    per = {r["id"]: r["n_training"] for r in overlap.overlap_counts(split).collect()}
    assert per == {e: sum(n for (a, _), n in got.items() if a == e) for e in {a for a, _ in got}}
    want = Counter((e[0], x[0]) for e in ev for x in tr if _sim(_text(*e[1:]), _text(*x[1:])) >= t - 1e-12 and _sim(_text(*e[1:]), _text(*x[1:])) > 0)
    assert got == want
    return got


def _record(rng, i, words):
    return (i, " ".join(words[:3]), [(" ".join(words[3:]), None), None, (None, None)])


def test_against_brute_force_with_edits_copies_and_order(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(40)] + ["the"] * 20
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 25))] for _ in range(40)]
    tr = [_record(rng, i, w) for i, w in enumerate(base)] + [_record(rng, 500 + i, base[0]) for i in range(5)]
    ev = []
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(w) // 4))):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if i % 3 == 0:
            rng.shuffle(w)
        ev.append(_record(rng, 1000 + i, w))
    assert _run(spark, ev, tr)
    _run(spark, ev, tr, 0.6)
    _run(spark, ev, tr, 1.0)


def test_edges(spark):
    tr = [(1, None, None), (2, "", []), (3, "a b c d e", None), (3, "a b c d e", None), (4, "ß Straße É 1", None), (None, "q", None)]
    ev = [(10, None, None), (11, "", [(None, None)]), (12, "A, b! c d", None), (13, "É 1 ß straße", None), (14, "x y", None)]
    got = _run(spark, ev, tr)
    assert got[(12, 3)] == 2 and got[(13, 4)] == 1
    _run(spark, [], tr)
    _run(spark, ev, [])
    long = " ".join(f"w{i}" for i in range(20_000))
    _run(spark, [(20, long, None)], [(5, long + " z", None)])


def test_hot_words_are_salted(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT_ROWS", 5)
    tr = [(i, "same old words here " + "abc"[i % 3], None) for i in range(40)]
    _run(spark, [(100, "same old words here a", None), (101, "here words old same q", None)], tr)


def test_scan_in_small_pieces(spark, monkeypatch):
    tr = [(i, "same old words here " + "abc"[i % 3], None) for i in range(40)]
    ev = [(100 + i, "same old words here " + "abcdefg"[i], None) for i in range(7)]
    b = overlap.bags(spark.createDataFrame([(i, d) for i, d, _ in ev], "id long, t string"), "id", "t")
    p = overlap.make_probes(overlap._classes(b).toArrow(), 0.8)
    whole = overlap.scan_texts([d for _, d, _ in tr], p, 0.8)
    monkeypatch.setattr(overlap, "HITS_AT_ONCE", 3)
    assert sorted(overlap.scan_texts([d for _, d, _ in tr], p, 0.8)) == sorted(whole) and len(whole) == 280
