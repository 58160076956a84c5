"""The stages in one go: dumps written from the tables, read, extracted, merged and made into datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernmill.functions import text as X
from kernmill.plans import pipeline
from kernmill.session import new_path, stage

KINDS = ("river", "old mill", "tower")


def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    """``k, t``: every item's number and that of the page it links to."""
    d = spark.read.parquet(f"{sf}/items.parquet").select(F.col("row_id").alias("k"))
    return d.withColumn("t", F.col("k") - F.col("k") % 5)


def _page_dump(numbers: DataFrame) -> str:
    """A page for each number that links to another, and a template, under the namespace names of a wiki of its own."""
    path = new_path(numbers.sparkSession, "pages")
    text = F.format_string("'''It''' lies by {{Kind|x}} here .\n[[Page %d]] lies to the north .\n\n== Empty ==\n", "t")
    rev = lambda c: F.struct(F.lit(1).alias("id"), c.alias("text"))
    pages = numbers.select(F.format_string("Page %d", "k").alias("title"), F.lit(0).alias("ns"), F.col("k").alias("id"), rev(text).alias("revision"))
    kind = numbers.sparkSession.range(1).select(
        F.lit("Vorlage:Kind").alias("title"), F.lit(10).alias("ns"), F.lit(-1).cast("long").alias("id"), rev(F.lit("the {{{1}}}")).alias("revision")
    )
    pages.unionByName(kind).write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    info = numbers.sparkSession.range(1).select(
        F.lit("http://w.example/wiki/Main").alias("base"),
        F.struct(F.array(F.struct(F.lit(10).alias("_key"), F.lit("Vorlage").alias("_VALUE"))).alias("namespace")).alias("namespaces"),
    )
    info.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "siteinfo").mode("append").save(path)
    return path


def _triple_dump(numbers: DataFrame) -> str:
    """Names, for three of four numbers a description, and for every other an edge to its link target."""
    path = new_path(numbers.sparkSession, "triples")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("k") % 4).cast("int"))
    subject = F.format_string("<http://k/Q%d> ", "k")
    line = lambda rel, value: F.concat(subject, F.lit(f'{rel} "'), value, F.lit('"@en .'))
    lines = F.array(
        line(X.NAME_REL, F.format_string("Entity %d", "k")),
        F.when(F.col("k") % 4 != 0, line(X.DESC_REL, kind)),
        F.when(F.col("k") % 2 == 0, F.concat(subject, F.format_string("<http://k/P1> <http://k/Q%d> .", "t"))),
    )
    numbers.select(F.explode(lines).alias("value")).where("value is not null").write.text(path)
    return path


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    n = _numbers(spark, sf)
    pages = pipeline.extract_wiki(spark, _page_dump(n))
    titles = n.select(F.format_string("Page_%d", "k").alias("title"), F.format_string("Q%d", "k").alias("qid"))
    articles = pipeline.build_articles(pages.withColumn("id", F.col("id").cast("long")), titles)
    items, _, triples = pipeline.extract_entities(spark, _triple_dump(n))
    return stage(pipeline.merge(articles, items, triples), "merged")


def pipeline_merged(spark, sf):
    return _merged(spark, sf).select(
        "rec_id", "qid", "part", "title", "name", "desc", F.array_join(F.flatten("text"), "|").alias("text"), "n_contexts", "n_triples"
    )


def pipeline_desc(spark, sf):
    d = pipeline.make_desc_dataset(_merged(spark, sf))
    return d.select("rec_id", "qid", "title", "name", "desc", F.array_join("contexts.sentence", "|").alias("contexts"), "split")


def pipeline_category(spark, sf):
    d = pipeline.make_category_dataset(_merged(spark, sf), 20, 20, max_contexts=3, uniform=False)
    return d.select("rec_id", "category", F.size("contexts").alias("n_contexts"), "split")


QUERIES = {f.__name__: f for f in (pipeline_merged, pipeline_desc, pipeline_category)}

_ME = """
WITH p AS (SELECT row_id AS k, row_id - row_id % 5 AS t FROM items),
ln AS (SELECT a.k, a.t FROM p a JOIN p b ON a.t = b.k),
cx AS (SELECT t, count(*) AS n, string_agg('Page ' || t || ' lies to the north .', '|') AS contexts FROM ln WHERE k <> t GROUP BY t),
me AS (
  SELECT p.k AS rec_id, 'Q' || p.k AS qid, 'Page ' || p.k AS title, 'Entity ' || p.k AS name,
    CASE p.k % 4 WHEN 1 THEN 'river' WHEN 2 THEN 'old mill' WHEN 3 THEN 'tower' ELSE '' END AS "desc",
    'It lies by the x here .|Page ' || p.t || ' lies to the north .' AS text, coalesce(cx.n, 0) AS n_contexts, cx.contexts,
    CASE WHEN p.k % 2 = 0 AND ln.k IS NOT NULL THEN CASE WHEN p.k = p.t THEN 2 ELSE 1 END ELSE 0 END::BIGINT AS n_triples
  FROM p LEFT JOIN cx ON cx.t = p.k LEFT JOIN ln ON ln.k = p.k
), ex AS (SELECT *, row_number() OVER (ORDER BY md5('42' || rec_id), rec_id) AS r, floor(count(*) OVER () * 10 / 2 * 0.01) AS share
  FROM me WHERE "desc" <> '' AND n_contexts > 0)
"""

ORACLE = {
    "pipeline_merged": _ME + """SELECT rec_id, qid, 0 AS part, title, name, "desc", text, n_contexts, n_triples FROM me""",
    "pipeline_desc": _ME
    + """SELECT rec_id, qid, title, name, "desc", contexts, CASE WHEN r <= share THEN 'dev' WHEN r <= 2 * share THEN 'test' ELSE 'train' END AS split FROM ex""",
    "pipeline_category": _ME
    + """SELECT rec_id, CASE "desc" WHEN 'old mill' THEN 'mill' ELSE "desc" END AS category, least(n_contexts, 3)::INT AS n_contexts,
  CASE WHEN r <= 20 THEN 'dev' WHEN r <= 40 THEN 'test' ELSE 'train' END AS split FROM ex""",
}
