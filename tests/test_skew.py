import random

from pyspark.sql import functions as F

from kernmill.operators import hotkeys, skew

MERGED = (
    "rec_id long, qid string, link map<string,struct<para:int,sent:int,span:struct<begin:int,end:int>>>, "
    "contexts array<struct<sentence:string,span:struct<begin:int,end:int>>>, field string, _seg int"
)


def test_numbers_are_exact_for_a_hot_and_a_null_key(spark):
    random.seed(1)
    rows = [(random.choice(["a", "a", "a", "b", None]), i) for i in range(500)]
    random.shuffle(rows)
    got = skew.number_rows(spark.createDataFrame(rows, "k string, i int"), ["k"], ["i"], 7).collect()
    for k in ("a", "b", None):
        own = sorted((r["i"], r["_rank"]) for r in got if r["k"] == k)
        assert [x for _, x in own] == list(range(len(own)))


def test_running_total_over_one_sequence(spark):
    d = spark.range(100).select((F.col("id") * 3 % 101).alias("o"), F.lit(2).alias("v"))
    got = {r["o"]: r["t"] for r in skew.running_total(d, [], ["o"], "v", "t", 5).collect()}
    assert [got[o] for o in sorted(got)] == [2 * i for i in range(100)]


def test_salted_lookup_gives_the_plain_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else "k%d" % (i % 5)) for i in range(90)] + [(99, None)], "id int, k string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    hot = skew.hot_keys(left, "k", floor=10)
    assert [(r["k"], r["_n"]) for r in hot.collect()] == [("hot", 6)]
    got = skew.salted_lookup(left, right, "k", F.col("id"), hot).select("id", "k", "v").collect()
    want = left.join(right, "k").select("id", "k", "v").collect()
    assert sorted(got) == sorted(want)


def test_every_hot_key_gets_salts(spark):
    # more hot keys than any list on the driver used to hold
    d = spark.range(400 * 12).select((F.col("id") % 400).cast("string").alias("k"))
    assert skew.hot_keys(d, "k", floor=10).count() == 400
    assert skew.hot_keys(d, "k", floor=10, rows=10) is None


def test_top_k_breaks_ties_the_same_way(spark):
    d = spark.createDataFrame([("a", 1, i) for i in range(40)] + [("b", 2, 0)], "k string, o int, i int")
    got = skew.top_k_per_key(d, ["k"], ["o", "i"], 3).collect()
    assert sorted((r["k"], r["i"]) for r in got) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]


def _profile(spark, rows, chunk=3):
    d = spark.createDataFrame(rows, MERGED)
    return {(r["field"], r["qid"]): r for r in hotkeys.entity_profile(d, chunk, 3).collect()}


def test_profile_against_brute_force(spark):
    random.seed(4)
    rows = []
    for i in range(60):
        link = {f"Q{random.choice([1, 1, 1, 2, 3])}": None for _ in range(3)} if i % 7 else None
        ctx = [None if j == 1 else ("s", (0, 0)) for j in range(random.randint(0, 4))] if i % 5 else None
        rows.append((i * 2, random.choice(["Q1", "Q1", "Q2", None]), link, ctx, "clash", 5))
    got = _profile(spark, rows)
    want = {}
    for rid, q, link, ctx, *_ in rows:
        for k in link or {}:
            want.setdefault(("link", k), []).append(rid)
        for _ in ctx or []:
            want.setdefault(("contexts", q), []).append(rid)
    assert set(got) == set(want)
    for k, recs in want.items():
        r = got[k]
        gaps = [b - a for a, b in zip(recs, recs[1:])]
        assert (r["n_entries"], r["n_records"], r["first_rec"], r["last_rec"], r["max_gap"]) == (
            len(recs), len(set(recs)), recs[0], recs[-1], max(gaps) if gaps else None)
    heavy = {(r["field"], r["qid"]) for r in hotkeys.heavy_entities(hotkeys.entity_profile(spark.createDataFrame(rows, MERGED), 3, 3), 30).collect()}
    for (f, q), recs in want.items():
        total = sum(len(v) for (g, _), v in want.items() if g == f)
        assert ((f, q) in heavy) == (q is not None and len(recs) * 100 >= 30 * total)


def test_profile_of_nothing(spark):
    assert _profile(spark, []) == {}
    assert _profile(spark, [(None, None, None, None, None, None)]) == {}


def test_staged_tables_can_be_released(spark):
    import os

    from kernmill.session import release_staged, stage, unstage

    release_staged(spark)
    a, b = stage(spark.range(3).toDF("x")), stage(spark.range(4).toDF("x"))
    where = b._kernmill_path.removeprefix("file:")
    assert a.count() == 3 and os.path.isdir(where)
    unstage(a)
    assert release_staged(spark) == 1 and not os.path.isdir(where)
