from kernmill import schemas
from kernmill.operators import entities as E
from kernmill.sources import readers, writers
from kernmill.wikitext import extract

DUMP = """<mediawiki><siteinfo><base>http://w.example/wiki/Main</base><namespaces><namespace key="0" /><namespace key="10">Template</namespace></namespaces></siteinfo>
<page><title>A &amp; B</title><ns>0</ns><id>1</id><revision><id>7</id><contributor><id>9</id></contributor><text>'''A''' is {{T|x}}.
See [[C]]s.</text></revision></page>
<page><title>Old</title><ns>0</ns><id>2</id><redirect title="A" /><revision><id>8</id><text>#REDIRECT [[A]]</text></revision></page>
<page><title>Many</title><ns>0</ns><id>4</id><revision><id>5</id><text>{{disambig}}
x</text></revision></page>
<page><title>Template:T</title><ns>10</ns><id>3</id><revision><id>6</id><text>&lt;noinclude&gt;d&lt;/noinclude&gt;({{{1}}})</text></revision></page></mediawiki>"""


def test_dump_to_articles(spark, tmp_path):
    (tmp_path / "d.xml").write_text(DUMP)
    path = str(tmp_path / "d.xml")
    pages = readers.read_pages(spark, path)
    assert sorted((r["id"], r["revid"], r["title"]) for r in pages.collect()) == [(1, 7, "A & B"), (3, 6, "Template:T"), (4, 5, "Many")]
    info = readers.read_siteinfo(spark, path)
    assert info["base"] == "http://w.example/wiki" and info["namespaces"]["Template"] == 10
    store = extract.store_templates(pages)
    opt = extract.Options(skip_disambiguation=True)
    got = extract.extract_pages(pages, opt, info["base"], store).collect()
    assert [(r["id"], r["url"], r["text"]) for r in got] == [("1", "http://w.example/wiki?curid=1", "A & B\n\n[[A & B|A]] is (x).\nSee [[C|Cs]].")]
    assert extract.extract_pages(pages.limit(0), opt).count() == 0


NT = """<http://k/Q1> <http://k/P2> <http://k/Q3> .
<http://k/Q1> <http://schema.org/name> "one"@en .
<http://k/Q1> <http://schema.org/name> "won"@en-gb .
<http://k/Q1> <http://www.w3.org/2004/02/skos/core#altLabel> "uno  \\u00e9"@en .
<http://k/Q1> <http://schema.org/name> "un"@fr .
bad line
<http://k/Q1> <http://k/P2> "lit/Q9" ."""


def test_ntriples(spark, tmp_path):
    (tmp_path / "x.nt").write_text(NT)
    p = E.parse_ntriples(readers.read_ntriples(spark, str(tmp_path / "x.nt")))
    edges = E.edges(p)
    assert [(r["subj"], r["rel"], r["obj"]) for r in edges.collect()] == [("Q1", "P2", "Q3"), ("Q1", "P2", "Q9")]
    strict = E.edges(E.parse_ntriples(readers.read_ntriples(spark, str(tmp_path / "x.nt")), require_iri=True))
    assert strict.count() == 1
    ent = {r["qid"]: r for r in E.assemble(E.literals(p), E.triple_frequency(edges)).collect()}
    assert (ent["Q1"]["name"], ent["Q1"]["aka"], ent["Q1"]["freq"], ent["Q3"]["name"]) == ("won", ["uno é"], 2, "")
    assert readers.read_ntriples(spark, str(tmp_path / "x.nt"), 2).count() == 2


def test_json_and_tsv(spark, tmp_path):
    d = spark.createDataFrame([("Q1", "a\tb", None, ["x"], (1,)), ("Q2", 'q"', "", [], None)], "qid string, name string, `desc` string, aka array<string>, freq struct<triple:long>")
    writers.write_jsonlines(d, str(tmp_path / "j"), "gzip")
    assert sorted(map(tuple, readers.read_jsonlines(spark, str(tmp_path / "j"), schemas.ENTITY).select(*d.columns).collect())) == sorted(map(tuple, d.collect()))
    writers.write_keyed_json(d, str(tmp_path / "k"))
    back = readers.read_json(spark, str(tmp_path / "k"), schemas.ENTITY)
    assert {r["key"]: r["name"] for r in back.collect()} == {"Q1": "a\tb", "Q2": 'q"'}
    writers.write_tsv(d, str(tmp_path / "t"), ["qid", "name"])
    assert sorted(map(tuple, readers.read_title_map(spark, str(tmp_path / "t")).collect())) == [("Q1", "a b"), ("Q2", 'q"')]
    assert writers.write_once(d, str(tmp_path / "p")) and not writers.write_once(d, str(tmp_path / "p"))


def test_articles_from_pages(spark):
    from kernmill.operators.articles import build_articles

    pages = spark.createDataFrame(
        [(1, "big city", "big city\n\nThe [[big city|Big City]] lies by [[sea|the sea]]. It saw [[sea|a sea]].\n\n[[none|Nothing]] else."),
         (2, "unknown", "unknown\n\nx"), (3, "sea", "sea\n"), (4, None, "a\n\nb"), (5, "big city", None)], "id long, title string, text string")
    titles = spark.createDataFrame([("Big_city", "Q1"), ("Sea", "Q2"), (None, "Q3"), ("Big_city", "Q1")], "title string, qid string")
    rows = build_articles(pages, titles).collect()
    assert [(r["qid"], r["pid"], r["text"]) for r in rows] == [("Q1", 1, [["The Big City lies by the sea .", "It saw a sea ."], ["Nothing else ."]])]
    assert {k: (v["para"], v["sent"], v["span"]["begin"], v["span"]["end"]) for k, v in rows[0]["link"].items()} == {"Q1": (0, 0, 1, 2), "Q2": (0, 1, 2, 3)}
    assert build_articles(pages.limit(0), titles).count() == 0


def test_stages_end_to_end(spark, tmp_path):
    from kernmill.plans import pipeline

    (tmp_path / "x.nt").write_text(NT)
    items, props, triples = pipeline.extract_entities(spark, str(tmp_path / "x.nt"))
    assert [(r["qid"], r["name"]) for r in items.collect()] == [("Q1", "won")] and props.count() == 0 and triples.count() == 2
    (tmp_path / "d.xml").write_text(DUMP)
    pages = pipeline.extract_wiki(spark, str(tmp_path / "d.xml"))
    titles = spark.createDataFrame([("A_&_B", "Q1")], "title string, qid string")
    art = pipeline.build_articles(pages.select("id", "title", "text"), titles)
    assert art.collect()[0]["text"] == [["A is ."], ["See Cs ."]]


def test_database_tables(spark, tmp_path):
    """A table of a database through JDBC, columns and filters pushed down; skipped where no driver comes with Spark."""
    import glob
    import os

    import pyspark

    if not glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "derby-*.jar")):
        import pytest

        pytest.skip("no JDBC driver here")
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    page = spark.createDataFrame([(1, "A", 0, 0), (2, "B", 0, 1), (3, None, 4, 0)], "page_id long, page_title string, page_namespace int, page_is_redirect int")
    page.write.jdbc(url, "page", mode="overwrite")
    got = readers.read_table(spark, url, "page", ["page_id", "page_title"])
    assert sorted(map(tuple, got.where("page_id < 3").collect())) == [(1, "A"), (2, "B")]
    assert "PushedFilters" in got.where("page_id < 3")._jdf.queryExecution().toString()


def test_samples_by_hash_are_bounded(spark):
    from kernmill.session import hashed_sample

    d = spark.range(1000).selectExpr("id % 400 as k", "id as v")
    a, b = (sorted(map(tuple, hashed_sample(x, "k", 50).select("k").collect())) for x in (d, d.repartition(7)))
    assert a == b and len(a) == 50
    same = spark.range(1000).selectExpr("1 as k", "id as v")
    assert hashed_sample(same, "k", 50).count() == 50 and hashed_sample(d.limit(0), "k", 5).count() == 0
