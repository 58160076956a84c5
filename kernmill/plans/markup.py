"""Markup, token, file and stream queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernmill import schemas
from kernmill.functions import tokens as K
from kernmill.functions import text as X
from kernmill.operators import corpus as C
from kernmill.operators.articles import build_articles
from kernmill.operators.entities import last_values
from kernmill.plans import pipeline
from kernmill.plans.corpus import _wiki_tables
from kernmill.session import new_path, read_spread
from kernmill.sources import readers, writers
from kernmill.streaming import triples as stream
from kernmill.wikitext import extract, markup

#: Sources of the template pages the markup queries use.
TEMPLATES = {
    "Template:Short description": "<noinclude>Doc</noinclude>",
    "Template:Place": "{{#if:{{{name|}}}|{{ucfirst:{{{name}}}}} in {{{land|somewhere}}}|nowhere}}<!-- note -->",
    "Template:Case": "{{#switch:{{lc:{{{1}}}}}|a|b=first|c=second|#default=other}}",
    "Template:Sum": "{{#expr:{{{1}}}*2+1}}{{#ifeq:{{{1}}}|2| two}}",
    "Template:Num": "{{#invoke:Roman|main|{{{1}}}}}, {{#invoke:String|len|abc}}, {{#invoke:If empty|main||x}}",
    "Template:Loop": "x{{Loop}}",
    "Template:Moved": "#REDIRECT [[Template:Place]]",
}


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return read_spread(spark, f"{sf}/{table}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    return new_path(spark, name)


def _templates(spark: SparkSession) -> str:
    rows = [(k, 10, v) for k, v in TEMPLATES.items()]
    return extract.store_templates(spark.createDataFrame(rows, "title string, ns int, text string"))


def _sources(spark, sf) -> DataFrame:
    """A wiki page for each document: templates, bold title, links, sections, lists, tags and a table."""
    t = F.coalesce("title", F.lit("Untitled"))
    body = F.concat(
        F.lit("{{Short description|x}}{{Place|name=village|land=north}}: '''"), t, F.lit("''' lies by [[river|the river]]s.<ref>a</ref>\n"),
        F.lit("== Empty ==\n== Notes ==\n* one\n* two\n{|\n| cell\n|}\nIt has {{Sum|2}} &amp; [http://a.example/x ''more''] <b>rows</b>. [[File:a.png|thumb|x]]\n"),
        F.lit("{{Case|B}}/{{Case|C}}/{{Case|z}}; {{Num|14}}; {{Moved}}; {{Missing}}.\n:indent\n__NOTOC__\n"),
    )
    return _read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "revid", t.alias("title"), F.lit(0).alias("ns"), body.alias("text"))


def wikitext_pages(spark, sf):
    return extract.extract_pages(_sources(spark, sf), markup.Options(), "http://wiki.example.org/w", _templates(spark)).drop("url")


def wikitext_documents(spark, sf):
    """All document texts through the markup engine."""
    d = _read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "revid", F.coalesce("title", F.lit("Untitled")).alias("title"), F.lit(0).alias("ns"), "text")
    return extract.extract_pages(d, markup.Options(keep_links=False, keep_sections=True, keep_lists=True), "", _templates(spark))


def doc_lines(spark, sf):
    return extract.as_document(wikitext_pages(spark, sf).withColumn("url", F.lit("")), as_json=False)


def doc_json(spark, sf):
    pages = extract.as_document(wikitext_pages(spark, sf))
    return pages.select(*[F.get_json_object("value", f"$.{c}").alias(c) for c in ("id", "title", "text")])


def tokenize_sentences(spark, sf):
    d = _read(spark, sf, "documents").select("doc_id", F.posexplode(K.tokenized_sentences(F.col("text"))).alias("i", "sentence"))
    return d


def tokenize_desc(spark, sf):
    return _read(spark, sf, "items").select("row_id", K.tokenized_description(F.col("desc")).alias("desc"))


def link_paragraphs(spark, sf):
    """Sentences with links of all extracted wiki pages."""
    p = C.body_paragraphs(F.col("text"))
    lines = wikitext_pages(spark, sf).select("id", F.posexplode(p).alias("para", "line"))
    return lines.select("id", "para", F.posexplode(K.linked_sentences(F.col("line"))).alias("sent", "s")).select(
        "id", "para", "sent", "s.sentence", F.to_json("s.links").alias("links")
    )


def built_articles(spark, sf):
    """Articles with sentences and links from the extracted wiki pages."""
    titles = C.title_map(*_wiki_tables(spark, sf)[:2])
    a = build_articles(wikitext_pages(spark, sf).withColumn("id", F.col("id").cast("long")), titles)
    return a.select("qid", "pid", "title", F.array_join(F.flatten("text"), "|").alias("text"), F.to_json("link").alias("link"))


def desc_dataset(spark, sf):
    d = pipeline.make_desc_dataset(_read(spark, sf, "merged"))
    return d.select("rec_id", "split", F.size("contexts").alias("n_contexts"))


def category_dataset(spark, sf):
    d = pipeline.make_category_dataset(_read(spark, sf, "merged").select("rec_id", "qid", "desc", "contexts"), 50, 50)
    return d.select("rec_id", "category", "split", F.size("contexts").alias("n_contexts"))


def head_noun(spark, sf):
    return _read(spark, sf, "merged").select("rec_id", K.head_nouns(F.col("desc")).alias("category"))


def json_roundtrip(spark, sf):
    path = _folder(spark, "items-json")
    items = last_values(_read(spark, sf, "items"), "qid", "row_id", ["name", "desc", "aka", "freq"])
    writers.write_jsonlines(items, path)
    back = readers.last_by_id(readers.read_jsonlines(spark, path, schemas.ENTITY))
    return back.select("qid", "name", "desc", F.array_join("aka", "|", "").alias("aka"), F.col("freq.triple").alias("triple"))


def keyed_json_roundtrip(spark, sf):
    path = _folder(spark, "props-json")
    props = last_values(_read(spark, sf, "properties"), "qid", "row_id", ["name", "desc"])
    writers.write_keyed_json(props, path)
    return readers.read_json(spark, path, schemas.T.StructType.fromDDL("qid string, name string, `desc` string")).select("qid", "name", "desc")


def tsv_roundtrip(spark, sf):
    path = _folder(spark, "triples-tsv")
    t = _read(spark, sf, "triples").where("subj is not null and rel is not null and obj is not null")
    writers.write_tsv(t, path, ["subj", "rel", "obj"])
    return readers.read_triples(spark, path).groupBy("subj", "rel", "obj").agg(F.count(F.lit(1)).alias("n"))


def title_map_roundtrip(spark, sf):
    path = _folder(spark, "title2qid")
    m = C.titles_by_id(_read(spark, sf, "merged").select("title", "qid", "rec_id"), "rec_id").select(X.title_key(F.col("title")).alias("title"), "qid")
    writers.write_tsv(m, path, ["title", "qid"])
    return readers.read_title_map(spark, path)


def xml_pages(spark, sf):
    """Titles and descriptions written as a dump of pages and read back; records without description are redirects."""
    path = _folder(spark, "dump")
    m = _read(spark, sf, "merged").select("rec_id", "title", "desc")
    none = F.coalesce("desc", F.lit("")) == ""
    page = m.select(
        "title", F.lit(0).alias("ns"), F.col("rec_id").alias("id"), F.when(none, F.struct(F.lit("x").alias("_title"))).alias("redirect"),
        F.struct(F.lit(7).alias("id"), F.struct(F.lit(9).alias("id")).alias("contributor"), F.col("desc").alias("text")).alias("revision"),
    )
    page.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").option("compression", "gzip").save(path)
    return readers.read_pages(spark, path).select("id", "revid", "title", "text")


def stream_triple_freq(spark, sf):
    """Triple counts per day, computed by the stream over a feed of files (an extension).

    Update mode: a window's last count replaces earlier ones.  The lateness allowed is
    longer than the feed, so that no row of it is dropped and the result can be compared.
    """
    feed, path, state = (new_path(spark, n) for n in ("feed", "stream", "stream-state"))
    _read(spark, sf, "triples").select("pos", "subj", "rel", "obj", "seen_at").write.parquet(feed)
    q = (
        stream.windowed_frequency(stream.read_feed(spark, feed), late="36500 days")
        .writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", state)
        .foreachBatch(lambda d, n: d.withColumn("batch", F.lit(n)).write.mode("append").parquet(path)).start()
    )
    q.awaitTermination()
    counts = spark.read.schema("start timestamp, qid string, freq bigint, batch bigint").parquet(path)
    return counts.groupBy("start", "qid").agg(F.max_by("freq", "batch").alias("freq"))


QUERIES = {f.__name__: f for f in (
    wikitext_pages, wikitext_documents, doc_lines, doc_json, tokenize_sentences, tokenize_desc, link_paragraphs,
    built_articles, desc_dataset, category_dataset, head_noun, json_roundtrip, keyed_json_roundtrip, tsv_roundtrip, title_map_roundtrip, xml_pages, stream_triple_freq,
)}

_PAGES = """SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(title, 'Untitled') AS title,
  coalesce(title, 'Untitled') || chr(10) || chr(10) || 'Village in north: [[' || coalesce(title, 'Untitled') || '|' || coalesce(title, 'Untitled') ||
  ']] lies by [[river|the rivers]].' || chr(10) || chr(10) || 'It has 5two & "more" rows. ' || chr(10) || 'first/second/other; XIV, 3, x; nowhere; .' || chr(10) AS text FROM documents"""

ORACLE = {
    "wikitext_pages": _PAGES,
    "doc_json": _PAGES,
    "doc_lines": f"""SELECT '<doc id="' || id || '" url="" title="' || title || '">' || chr(10) || text || chr(10) || '</doc>' || chr(10) AS value FROM ({_PAGES})""",
    "desc_dataset": """WITH e AS (SELECT rec_id, len(list_filter(contexts, lambda x: x.sentence <> '' AND x.span."end" >= x.span."begin")) AS n_contexts FROM merged
  WHERE "desc" <> '' AND NOT contains(lower("desc"), 'wikipedia') AND NOT contains(lower("desc"), 'wikimedia')),
r AS (SELECT *, row_number() OVER (ORDER BY md5('42' || rec_id), rec_id) AS r, floor(count(*) OVER () * 10 / 2 * 0.01) AS k FROM e WHERE n_contexts > 0)
SELECT rec_id, CASE WHEN r <= k THEN 'dev' WHEN r <= 2 * k THEN 'test' ELSE 'train' END AS split, n_contexts::INT AS n_contexts FROM r""",
    "json_roundtrip": """SELECT qid, name, "desc", CASE WHEN aka IS NOT NULL THEN array_to_string(list_transform(aka, lambda x: coalesce(x, '')), '|') END AS aka,
  freq.triple AS triple FROM items WHERE qid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY row_id DESC) = 1""",
    "keyed_json_roundtrip": 'SELECT qid, name, "desc" FROM properties WHERE qid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY row_id DESC) = 1',
    "tsv_roundtrip": "SELECT subj, rel, obj, count(*) AS n FROM triples WHERE subj IS NOT NULL AND rel IS NOT NULL AND obj IS NOT NULL GROUP BY ALL",
    "title_map_roundtrip": "SELECT upper(substr(t, 1, 1)) || substr(t, 2) AS title, qid FROM (SELECT replace(arg_max(title, rec_id), ' ', '_') AS t, qid FROM merged WHERE qid IS NOT NULL GROUP BY qid)",
    "xml_pages": """SELECT rec_id AS id, 7::BIGINT AS revid, title, "desc" AS text FROM merged WHERE "desc" <> ''""",
    "stream_triple_freq": """SELECT date_trunc('day', seen_at) AS "start", qid, CAST(sum(n) AS BIGINT) AS freq FROM (
  SELECT seen_at, subj AS qid, CASE WHEN starts_with(subj, 'Q') THEN 1 ELSE 0 END AS n, subj, rel, obj FROM triples
  UNION ALL SELECT seen_at, obj, CASE WHEN starts_with(obj, 'Q') THEN 1 ELSE 0 END, subj, rel, obj FROM triples
  UNION ALL SELECT seen_at, rel, 1, subj, rel, obj FROM triples
) WHERE subj IS NOT NULL AND rel IS NOT NULL AND obj IS NOT NULL AND seen_at IS NOT NULL GROUP BY ALL""",
}
