import json

from kernmill.operators import nested as N


def _rows(spark, lines, table):
    d = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(lines)], "line_no long, line string, dewey string")
    return N.shred(d, table).collect()


def test_labels_lead_to_parents():
    nodes = N.label_nodes({"a": [1, {"b": None}], "link": {"Q1": [0, 1]}})
    by = {n.dewey: n for n in nodes}
    assert all(n.dewey[:-1] in by for n in nodes if n.dewey)
    assert [".".join(n.schema) for n in nodes] == ["", "a", "a.[]", "a.[]", "a.[].b", "link", "link.*", "link.*.[]", "link.*.[]"]
    assert by[(0, 1, 0)].kind == "null"


SHAPES = [
    [0, 0, [0, 1]], [0, 0, 0, 1], {"para": 0, "sent": 0, "span": [0, 1]}, {"para": "0", "sent": "0", "span": {"begin": "0", "end": "1"}},
    {"at": {"para": 0, "sent": 0}, "span": [0, 1]}, ["0", " 0", ["0", "1"]],
]
BAD = [[0, 0, None], [0, 0], [0, 1, [0, 1]], [0, 0, [1, 0]], [0, 0, [0, 3]], [0, 0, [-1, 0]], [True, 0, [0, 1]], [0.0, 0, [0, 1]], None, "x", {}, [3, 0, [0, 0]]]


def test_all_link_shapes(spark):
    text = [["a b c"], None]
    lines = [json.dumps({"qid": "Q1", "text": text, "link": {f"Q{i}": s for i, s in enumerate(SHAPES + BAD)}})]
    got = _rows(spark, lines, "links")
    assert [r["usable"] for r in got] == [True] * len(SHAPES) + [False] * len(BAD)
    lines = [json.dumps({"qid": "Q1", "text": ["a b"], "link": [{"target": "Q5", "para": 0, "sent": 0, "span": [1, 1]}, {"para": 0}]})]
    got = _rows(spark, lines, "links")
    assert [(r["target"], r["usable"]) for r in got] == [("Q5", True), (None, False)]
    assert got[0]["dewey"].rpartition(".")[0] == got[0]["parent"]


def test_context_shapes(spark):
    ctx = [["a b", [0, 1]], ["a b", 1, 1], {"sentence": "a b", "span": {"begin": 0, "end": 0}, "meta": {"from": "Q"}}, [None, [0, 0]],
           ["a b", None], ["a b"], {"sentence": "a b"}, None, ["a b", [1, 2]], ["", [0, 0]]]
    got = _rows(spark, [json.dumps({"record": {"qid": "Q", "contexts": ctx}})], "contexts")
    assert [r["usable"] for r in got] == [True] * 3 + [False] * 7
    assert [r["ctx_no"] for r in got] == list(range(10))


def test_paragraph_shapes(spark):
    text = [["a", {"s": "b c"}, None], None, {"sents": ["d"], "heading": "h"}, "e f", {"sents": []}, [], {"sents": [{"s": None}]}]
    got = _rows(spark, [json.dumps({"data": {"entity": {"qid": "Q", "text": text}}, "v": 2})], "sentences")
    assert [(r["para_no"], r["sent_no"], r["sentence"], r["n_tokens"]) for r in got] == [
        (0, 0, "a", 1), (0, 1, "b c", 2), (0, 2, None, None), (2, 0, "d", 1), (3, 0, "e f", 2), (6, 0, None, None)]


def test_unreadable_and_odd_lines(spark):
    deep = '{"qid":"Q","text":' + "[" * 5000 + "]" * 5000 + "}"
    lines = [None, "", "  ", "[]", "null", '{"qid": "Q1"', "3", deep, '{"qid":"Q\\ud800","desc":null}', "{}", "{}"]
    got = _rows(spark, lines, "entities")
    assert {r["line_no"] for r in got} >= {8, 9, 10} and not {r["line_no"] for r in got} & {0, 1, 2, 3, 4, 5, 6}
    assert _rows(spark, [], "nodes") == []
    long = json.dumps({"qid": "Q", "text": [["w " * 50_000]], "link": {"Q2": [0, 0, [0, 49_999]]}})
    assert [r["usable"] for r in _rows(spark, [long, long], "links")] == [True, True]


def test_one_pass_for_several_tables(spark):
    lines = [json.dumps({"qid": "Q1", "aka": ["a", None], "text": [["x y"]], "link": {"Q2": [0, 0, [0, 1]]}, "contexts": [["a b", [0, 1]]],
                         "triples": [["Q1", "P1", "Q2"], {"subj": "Q3", "rel": "P2", "obj": None}]})] * 2
    d = spark.createDataFrame(list(enumerate(lines)), "line_no long, line string")
    union = N.shred_union(d, ("links", "contexts", "aliases", "triples"))
    for t in ("links", "contexts", "aliases", "triples"):
        assert sorted(N.one_table(union, t).collect()) == sorted(N.shred(d, t).collect())
    assert [(r["dewey"], r["parent"], r["alias"]) for r in N.one_table(union, "aliases").where("line_no = 0").collect()] == [("1.0", "1", "a"), ("1.1", "1", None)]
    got = N.one_table(union, "triples").where("line_no = 1").collect()
    assert [(r["triple_no"], r["subj"], r["rel"], r["obj"]) for r in got] == [(0, "Q1", "P1", "Q2"), (1, "Q3", "P2", None)]
