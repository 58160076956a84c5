from pyspark.sql import functions as F

from kernmill.functions import text as X
from kernmill.functions import tokens as K
from kernmill.operators import datasets as D
from kernmill.operators import entities as E


def _one(spark, col, *values):
    d = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in d.select(col(F.col("v"))).collect()]


def test_ids_and_literals(spark):
    assert _one(spark, X.entity_id, "<http://a/Q12>", "<http://a/prop/P3>", '"x/Q9"', "<http://a/x>", None) == ["Q12", "P3", "Q9", "", None]
    assert _one(spark, lambda c: X.entity_id(c, True), '"x/Q9"', "<http://a/Q9>") == ["", "Q9"]
    assert _one(spark, X.language_value, '"a b"@en', '"c"@en-gb', '"d"@fr', '"e"f"@en') == ["a b", "c", "", 'e"f']
    assert _one(spark, lambda c: X.language_value(c, strict=True), '"c"@en-gb', '"a"@en') == ["", "a"]
    assert _one(spark, X.decode_escapes, r"café", r"\U0001F600!", "é", r"a\"b", 'x"y', r"bad\q") == ["café", "😀!", "é", 'a"b', 'x"y', r"bad\q"]
    assert _one(spark, X.short_description, "a (b) [c] {d} e: f", "x; y", "n:") == ["a    e", "x", "n:"]
    assert _one(spark, X.title_key, "aB c", "", None) == ["AB_c", "", None]
    assert _one(spark, X.usable_description, "x", "", None, "Wikimedia list") == [True, False, False, False]


def test_triple_frequency(spark):
    d = spark.createDataFrame([(1, "Q1", "P1", "Q1"), (2, "P2", "P1", "Q3"), (3, "Q1", None, "Q2")], "pos long, subj string, rel string, obj string")
    assert {r["qid"]: r["freq"] for r in E.triple_frequency(d).collect()} == {"Q1": 2, "P1": 2, "P2": 0, "Q3": 1}
    assert E.triple_frequency(d.limit(0)).count() == 0


def test_tokens():
    assert [" ".join(s) for s in K.tokenize("Dr. Fox (a cat) didn't pay 3.5%. He left! “Why?” Yes.")] == [
        "Dr. Fox -LRB- a cat -RRB- did n't pay 3.5 % .".replace("Dr.", "Dr ."), "He left !", "“ Why ? ”", "Yes ."]
    assert K.tokenize(None) == [] and K.tokenize("  ") == []


def test_links_in_paragraphs():
    assert K.repair_links("[[a|b]]c d[[e|f]] [[g|]]") == "[[a|bc]] d [[e|f]] "
    assert K.strip_parentheses("a (b (c) d) e [[f (g)|h]]") == "a  e [[f (g)|h]]"
    got = K.link_paragraph("The [[big city|Big City]] lies by [[river]] x [[sea|the sea]]. It is (very) old.")
    assert got[0]["sentence"] == "The Big City lies by [ [ river ] ] x the sea ."
    assert got[0]["links"] == [{"target": "Big_city", "begin": 1, "end": 2}, {"target": "Sea", "begin": 11, "end": 12}]
    assert got[1] == {"sentence": "It is old .", "links": []}
    assert K.link_paragraph(None) == []


def test_head_nouns():
    for d, w in {"river in X": "river", "species of moss": "moss", "1984 novel by A B": "novel", "kind of old bridges in Y": "bridge",
                 "X 's capital": "capital", "": "-", None: "-", "churches": "churches"}.items():
        assert K.head_noun(d) == w, d


def test_splits(spark):
    d = spark.range(200).select(F.col("id"), (F.col("id") % 3).cast("string").alias("c"))
    got = D.exact_split(d, ["id"], 20, 30).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"dev": 20, "test": 30, "train": 150}
    one = D.exact_split(d, ["id"], 20, 30).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, D.exact_split(d.repartition(3), ["id"], 20, 30).collect()))
    u = D.category_uniform_split(d, ["id"], "c", 10, 10, 50).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in u} == {"dev": 10, "test": 10, "train": 50}
    assert D.exact_split(d.limit(0), ["id"], 2, 2).count() == 0
