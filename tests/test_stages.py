import json
import os
import random

import pytest
from pyspark.sql import functions as F

from kernmill import config, schemas
from kernmill.operators import corpus as C
from kernmill.plans import pipeline
from kernmill.sources import readers, writers
from kernmill.wikitext import extract
from kernmill.wikitext import markup as M
from kernmill.wikitext.templates import Expander, Namespaces


def test_file_order_does_not_follow_the_size_of_files(spark, tmp_path):
    for name, n in (("a.txt", 2), ("b.txt", 2000), ("c.txt", 5)):
        (tmp_path / name).write_text("".join(f"{name[0]}{i}\n" for i in range(n)))
    lines = readers.read_lines(spark, str(tmp_path))
    assert [r["value"] for r in readers.capped(lines, 3).orderBy("pos").collect()] == ["a0", "a1", "b0"]
    assert readers.capped(lines, 2004).where("value like 'c%'").count() == 2
    keyed = lines.select("pos", F.lit("k").alias("qid"), "value")
    assert readers.last_by_id(keyed).collect()[0]["value"] == "c4"


DUMP = """<mediawiki><siteinfo><base>http://w.example/wiki/Main</base><namespaces><namespace key="0" /><namespace key="10">Vorlage</namespace>
<namespace key="2">Benutzer</namespace></namespaces></siteinfo>
<page><title>Ort</title><ns>0</ns><id>1</id><revision><id>7</id><text>'''Ort''' ist {{t|x}} und {{Template:T|y}}{{Kreis}}{{Benutzer:Ich}}.</text></revision></page>
<page><title>Ort</title><ns>0</ns><id>1</id><revision><id>8</id><text>zweimal</text></revision></page>
<page><title>Fluss</title><ns>0</ns><id>2</id><revision><id>9</id><text>{{NAMESPACE}}{{NAMESPACENUMBER}} {{PAGENAME}}</text></revision></page>
<page><title>Vorlage:T</title><ns>10</ns><id>3</id><revision><id>6</id><text>({{{1}}})</text></revision></page>
<page><title>Vorlage:Kreis</title><ns>10</ns><id>4</id><revision><id>6</id><text>#REDIRECT [[Vorlage:Kreis2]]</text></revision></page>
<page><title>Vorlage:Kreis2</title><ns>10</ns><id>5</id><revision><id>6</id><text>#REDIRECT [[Vorlage:Kreis]]</text></revision></page></mediawiki>"""


def test_names_of_the_wiki_are_used(spark, tmp_path):
    (tmp_path / "d.xml").write_text(DUMP)
    got = {r["id"]: r["text"] for r in pipeline.extract_wiki(spark, str(tmp_path / "d.xml")).collect()}
    assert got == {"1": "Ort\n\n[[Ort|Ort]] ist (x) und (y).", "2": "Fluss\n\n0 Fluss"}
    pages = readers.read_pages(spark, str(tmp_path / "d.xml"))
    one = extract.single_article(pages, "Fluss", extract.Options(with_revision=True)).collect()
    assert [(r["id"], r["revid"]) for r in one] == [("2", "9")]
    doc = extract.as_document(extract.single_article(pages, 2, extract.Options(with_revision=True)), as_json=False).collect()[0]["value"]
    assert doc.startswith('<doc id="2" revid="9" url="?curid=2" title="Fluss">\nFluss\n')
    with pytest.raises(Exception, match="no template shards"):
        extract.extract_pages(pages, None, "", str(tmp_path / "none")).collect()


def test_namespace_names():
    n = Namespaces({"": 0, "Vorlage": 10, "benutzer": 2})
    assert [n.full(x) for x in ("a b", "template:a", "vorlage:a", ":a", "User:x", "Nope:x")] == [
        "Vorlage:A b", "Vorlage:A", "Vorlage:A", "A", "Benutzer:X", "Vorlage:Nope:x"]
    chain = {f"Template:R{i}": f"#REDIRECT [[Template:R{i + 1}]]" for i in range(12)} | {"Template:R12": "end"}
    assert Expander(chain.get).expand("{{R0}}") == "end"


@pytest.mark.parametrize("text,want", [
    ("'''T''' ''i'' '''''both'''''", '[[P|T]] "i" both'), ("'''''x''' y''", '"[[P|x]] y"'), ("''\"q\"''", '"q"'), ("''open", '"open'), ("'''open", "open"),
    ("''''four'''", "'[[P|four]]"), ("a ''b\nc'' d", 'a "b\nc" d'), ("it's", "it's"),
])
def test_emphasis(text, want):
    assert M.emphasis(text, "P", M.Options()) == want


def test_emphasis_html_and_noise():
    html = M.Options(to_html=True, keep_links=False)
    assert M.emphasis("'''b''' ''i'' '''''x'''''", "P", html) == "<b>b</b> <i>i</i> <b><i>x</i></b>"
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice(["'", "''", "'''", "a", " ", "\n"]) for _ in range(rng.randint(0, 30)))
        out = M.emphasis(text, "P", M.Options(keep_links=False))
        assert "''" not in out.replace('"', "") or "'''''" in text or "''''" in text
        assert [c for c in out if c == "a"] == [c for c in text if c == "a"]


def test_sections_and_lists_in_html():
    opt = M.Options(to_html=True, keep_lists=True, keep_sections=True)
    text = "== A ==\n* one\n** two\n# three\ntext\n=== Empty ===\n== B? ==\n; t\nend"
    assert M.compact(text, opt) == [
        "<h2>A</h2>", "<ul>", "<li>one</li>", "<ul>", "<li>two</li>", "</ul>", "</ul>", "<ol>", "<li>three</li>", "</ol>", "text",
        "<h2>B?</h2>", "<dl>", "<dt>t</dt>", "</dl>", "end"]


def test_tags():
    o = M.Options()
    assert M.clean("a<ref>x<ref name='q'>y</ref></ref>b <ref>open", o) == "ab <ref>open"
    assert M.clean("<div><table><tr><td>x</td></tr></table></div>k<code>c</code>, <CODE>c</CODE> <syntaxhighlight lang=x>s<b>t</b></syntaxhighlight>", o) == "kcodice_1, codice_2 st"
    assert M.clean("a\n...\nb\n\nc\n\n\n\nd", o) == "a\nb\n\nc\nd"
    assert M.clean("<a href='x'>y</a>", M.Options(to_html=True)) == "&lt;a href='x'&gt;y&lt;/a&gt;"
    assert M.clean("x\n" + "<div>" * 3000 + "y", o).endswith("y")


def test_headings_wait_for_text():
    o = M.Options(keep_sections=True)
    assert M.compact("== A ==\n=== B ===\n=== C ===\n lead\n next\nplain\n== D ==\n(x)\n", o) == ["A.", "C.", " lead", "plain", ""]


def test_settings():
    assert [config.folder_and_file(p) for p in ("a/b.txt", "b", "a/", "a/..", "/x")] == [("a", "b.txt"), (".", "b"), ("a", ""), ("a/..", ""), ("/", "x")]
    assert config.as_list(" a, ,b,") == ["a", "b"] and config.as_list(None) == []
    assert [config.as_bool(x) for x in ("True", "no", True, "1")] == [True, False, True, True]
    assert [config.size_in_bytes(x) for x in ("1M", "500k", "0", "300000")] == [1 << 20, 512000, 0, 300000]
    for f, bad in ((config.as_bool, "maybe"), (config.as_bool, None), (config.size_in_bytes, "1k")):
        with pytest.raises(ValueError):
            f(bad)


def test_rotation_and_conversion(spark, tmp_path):
    d = spark.createDataFrame([(i, "x" * (i % 90)) for i in range(500)], "n long, name string")
    writers.write_rotated(d, str(tmp_path / "r"), ["n"], 5000)
    sizes = [sum(p.stat().st_size for p in f.glob("part-*")) for f in sorted(tmp_path.glob("r/file=*"), key=lambda f: int(f.name[5:]))]
    assert len(sizes) > 3 and all(4800 < s < 5200 for s in sizes[:-1]) and sum(sizes) == sum(len(json.dumps({"n": i, "name": "x" * (i % 90)}, separators=(",", ":"))) + 1 for i in range(500))
    keyed = spark.createDataFrame([("Q2", "b"), ("Q1", "a")], "qid string, name string")
    writers.write_keyed_json(keyed, str(tmp_path / "k.json"))
    part = next(p for p in os.listdir(tmp_path / "k.json") if p.startswith("part"))
    assert json.loads((tmp_path / "k.json" / part).read_text()) == {"Q1": {"qid": "Q1", "name": "a"}, "Q2": {"qid": "Q2", "name": "b"}}
    writers.json_to_jsonlines(spark, str(tmp_path / "k.json"), str(tmp_path / "l"), schemas.T.StructType.fromDDL("qid string, name string"))
    assert sorted(r["name"] for r in spark.read.json(str(tmp_path / "l")).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        writers.json_to_jsonlines(spark, "x.txt", "y", schemas.ENTITY)
    writers.write_keyed_json(keyed.limit(0), str(tmp_path / "e.json"))
    assert readers.read_json(spark, str(tmp_path / "e.json"), schemas.ENTITY).count() == 0


def test_extracted_folders(spark, tmp_path):
    for d, f in (("AA", "wiki_00"), ("AA", "wiki_01"), ("AB", "wiki_00")):
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / f).write_text(json.dumps({"id": d + f, "url": "u", "title": "t", "text": "x"}) + "\n")
    assert readers.read_extracted(spark, str(tmp_path)).count() == 3
    assert sorted(r["id"] for r in readers.read_extracted(spark, [str(tmp_path)], 2).collect()) == ["AAwiki_00", "AAwiki_01"]
    assert readers.read_extracted(spark, str(tmp_path / "none"), 2).count() == 0


LINK = "map<string,struct<para:int,sent:int,span:struct<begin:int,end:int>>>"


def _articles(spark, n):
    rows = [(i, f"Q{i}", f"T{i}", str(i), [[f"see hub {i}"]], {"Q0": (0, 0, (1, 1)), f"Q{i}": (0, 0, (0, 0))}) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, "x", "x", None, None)], f"rec_id long, qid string, title string, pid string, text array<array<string>>, link {LINK}")


def test_long_lists_go_on_in_rows_of_their_own(spark):
    items = spark.createDataFrame([("Q0", "hub", "a river", ["h"]), ("Q1", "one", "mill", None)], "qid string, name string, `desc` string, aka array<string>")
    triples = spark.createDataFrame([(i, f"Q{i}", "P1", "Q0") for i in range(1, 25)] + [(99, "Q1", None, "Q0")], "pos long, subj string, rel string, obj string")
    m = pipeline.merge(_articles(spark, 25), items, triples, part_size=10)
    rows = m.orderBy("qid", "part").collect()
    hub = [r for r in rows if r["qid"] == "Q0"]
    assert [(r["part"], len(r["contexts"]), len(r["triples"]), r["text"] is None, r["name"]) for r in hub] == [
        (0, 10, 0, False, "hub"), (1, 10, 0, True, "hub"), (2, 4, 0, True, "hub")]
    assert {r["n_contexts"] for r in hub} == {24} and sum(len(r["triples"]) for r in rows) == 24
    assert sorted(c["sentence"] for r in hub for c in r["contexts"]) == sorted(f"see hub {i}" for i in range(1, 25))
    stats = C.merge_statistics(m).first()
    assert (stats["entities"], stats["sentences"], stats["contexts"]) == (25, 25, 24)
    d = pipeline.make_desc_dataset(m).collect()
    assert len(d) == 3 and len({r["split"] for r in d}) == 1
    c = pipeline.make_category_dataset(m, 0, 0, max_contexts=7, uniform=False).collect()
    assert [(r["rec_id"], r["category"], len(r["contexts"])) for r in c] == [(0, "river", 7)]
    again = pipeline.make_category_dataset(pipeline.merge(_articles(spark, 25), items, triples, part_size=10).repartition(5), 0, 0, max_contexts=7, uniform=False).collect()
    assert again[0]["contexts"] == c[0]["contexts"]


def test_merge_of_nothing(spark):
    items = spark.createDataFrame([], "qid string, name string, `desc` string, aka array<string>")
    assert pipeline.merge(_articles(spark, 0), items).count() == 0
    bare = pipeline.merge(_articles(spark, 2), items, merge_contexts=False, merge_desc=False, merge_aka=False)
    assert bare.columns == ["rec_id", "qid", "part", "title", "pid", "name", "text", "link"] and bare.count() == 2


def test_labels_keep_their_words_apart():
    from kernmill.functions.tokens import link_paragraph

    assert link_paragraph("[[A|anti[[atlas]]]] x")[0]["sentence"] == "anti atlas x"
    assert link_paragraph("[[A|the[[B|c]]d]] x")[0]["sentence"] == "the c d x"
