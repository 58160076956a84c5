"""Sentences, links, descriptions and files by case, each with the result written by hand as SQL.

The cases are dealt out to all documents, as in ``markup_cases``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kernmill.functions import tokens as K
from kernmill.operators import entities as E
from kernmill.session import new_path
from kernmill.sources import readers, writers
from kernmill.wikitext import extract, markup

TOKENS = [
    ("Dr. Fox (b. 1900) sold it. He can't go, 50% lost!", "Dr . Fox -LRB- b . 1900 -RRB- sold it .|He ca n't go , 50 % lost !"),
    ('It cost 3.50 euros. Nobody paid. "Who?" asked Ann.', 'It cost 3.50 euros .|Nobody paid .|" Who ? " asked Ann .'),
    ("The U.S. army [sic] left. They're gone.", "The U.S. army -LSB- sic -RSB- left .|They 're gone ."),
    ("今日は。明日", "今日は 。|明日"),
    ('"It ended." He left {x}', '" It ended . "|He left -LCB- x -RCB-'),
    (" ", ""),
]
#: A paragraph, its sentences, its links as target@sentence:begin-end.
LINKS = [
    ("The [[big city|Big City]] lies by [[sea|the sea]]s. It saw (very (old)) [[sea|a sea]].", "The Big City lies by the seas .|It saw a sea .", "Big_city@0:1-2|Sea@0:5-6|Sea@1:2-3"),
    ("[[Atlas (myth)|[[atlas]]]] and [[x|]] anti-[[war|war]]s.", "atlas and anti - wars .", "Atlas_(myth)@0:0-0|War@0:4-4"),
    ("[[A|the [[B|c]]d]] (in [[Q|q]]) end. Second [[B|b]] here.", "the c d end .|Second b here .", "A@0:0-2|B@1:1-1"),
    ("no links here", "no links here", ""),
    ("[[a b|c]]d e", "cd e", "A_b@0:0-0"),
]
DESCRIPTIONS = [
    ("river in X (old): long", "river in X", "river"), ("species of moss; rare", "species of moss", "moss"), ("French painter, 1900", "French painter , 1900", "painter"),
    ("", "", "-"), ("1984 novel by A B", "1984 novel by A B", "novel"), ("Ann's capital city of the north", "Ann 's capital city of the north", "city"),
    ("kind of  old bridges in Y", "kind of old bridges in Y", "bridge"),
]
#: A literal's text as it stands in a dump, and what it means.
ESCAPES = [(r"café", "café"), (r'a \"q\" b', 'a "q" b'), (r"\U0001F600!", "😀!"), (r"x\\y", r"x\y"), ("plain", "plain"), (r"東京", "東京")]


def _dealt(spark: SparkSession, sf: str, texts: list[str]) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    return d.withColumn("x", F.element_at(F.array(*map(F.lit, texts)), (F.pmod("doc_id", F.lit(len(texts))) + 1).cast("int")))


def _joined(c: Column, sep: str = "|") -> Column:
    return F.array_join(c, sep)


def token_cases(spark, sf):
    return _dealt(spark, sf, [t for t, _ in TOKENS]).select("doc_id", _joined(K.tokenized_sentences(F.col("x"))).alias("sentences"))


def _placed(sents: Column) -> Column:
    one = lambda s, i: F.transform(s["links"], lambda k: F.concat(k["target"], F.lit("@"), i.cast("string"), F.lit(":"), k["begin"].cast("string"), F.lit("-"), k["end"].cast("string")))
    return _joined(F.flatten(F.transform(sents, one)))


def link_cases(spark, sf):
    d = _dealt(spark, sf, [t for t, _, _ in LINKS]).withColumn("s", K.linked_sentences(F.col("x")))
    return d.select("doc_id", _joined(F.col("s.sentence")).alias("sentences"), _placed(F.col("s")).alias("links"))


def first_sentences(spark, sf):
    """The first sentence of each paragraph, with its links only."""
    d = _dealt(spark, sf, [t for t, _, _ in LINKS]).withColumn("s", K.linked_sentences(F.col("x"), 1))
    return d.select("doc_id", _joined(F.col("s.sentence")).alias("sentences"), _placed(F.col("s")).alias("links"))


def description_cases(spark, sf):
    d = _dealt(spark, sf, [t for t, _, _ in DESCRIPTIONS])
    return d.select("doc_id", K.tokenized_description(F.col("x")).alias("tokens"), K.head_nouns(F.col("x")).alias("head"))


def escape_cases(spark, sf):
    """Literals with escapes, through N-Triples lines."""
    d = _dealt(spark, sf, [t for t, _ in ESCAPES])
    line = F.concat(F.format_string("<http://k/Q%d> <http://schema.org/name> ", "doc_id"), F.lit('"'), F.col("x"), F.lit('"@en .'))
    return E.literals(E.parse_ntriples(d.select(F.col("doc_id").alias("pos"), line.alias("value")))).select("qid", "value")


def json_converted(spark, sf):
    """A document keyed by id, converted to JSON lines and read back."""
    whole, lines = f"{new_path(spark, 'keyed')}/props.json", new_path(spark, "lines")
    props = E.last_values(spark.read.parquet(f"{sf}/properties.parquet"), "qid", "row_id", ["name", "desc"])
    schema = readers.schemas.T.StructType.fromDDL("qid string, name string, `desc` string")
    writers.write_keyed_json(props, whole)
    writers.json_to_jsonlines(spark, whole, lines, schema)
    return readers.read_jsonlines(spark, lines, schema).drop("pos")


def rotated_pages(spark, sf):
    """Documents written to files of about 1 MB in order, read back: each with the file its first byte falls into."""
    path = new_path(spark, "rotated")
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.lit("x" * 100).alias("pad"))
    writers.write_rotated(d, path, ["doc_id"], 1 << 20)
    return spark.read.schema("doc_id bigint, pad string, file int").json(path).select("doc_id", "file")


def extracted_folders(spark, sf):
    """The first four files of extracted pages in folders."""
    path = new_path(spark, "extracted")
    d = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("u").alias("url"), "title", "text", (F.col("doc_id") % 3).alias("a"), (F.col("doc_id") % 2).alias("wiki_"))
    d.repartition("a", "wiki_").write.partitionBy("a", "wiki_").json(path)
    return readers.read_extracted(spark, path, 4).select("id", "title", "text")


def one_article(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    first = d.agg(F.min("doc_id")).first()[0]
    pages = d.select(F.col("doc_id").alias("id"), "revid", F.lit("One").alias("title"), F.lit(0).alias("ns"), F.lit("'''One''' page.").alias("text"))
    return extract.single_article(pages, first, markup.Options()).select("id", "text")


def written_once(spark, sf):
    """A table that is there already is not written again."""
    path = new_path(spark, "once")
    d = spark.read.parquet(f"{sf}/properties.parquet").select("row_id", "qid")
    writers.write_once(d, path)
    writers.write_once(d.limit(0), path)
    return spark.read.parquet(path)


QUERIES = {f.__name__: f for f in (
    token_cases, link_cases, first_sentences, description_cases, escape_cases, json_converted, rotated_pages, extracted_folders, one_article, written_once,
)}


def _sql(rows: list[tuple], names: list[str], key: str = "doc_id") -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join([str(i), *map(quote, r)]) + ")" for i, r in enumerate(rows))
    n = len(rows)
    return f"WITH c(k, {', '.join(names)}) AS (VALUES {values}) SELECT {key}, {', '.join(names)} FROM documents JOIN c ON ((doc_id % {n}) + {n}) % {n} = k"


def _first(text: str) -> str:
    return text.split("|")[0]


ORACLE = {
    "token_cases": _sql([(want,) for _, want in TOKENS], ["sentences"]),
    "link_cases": _sql([r[1:] for r in LINKS], ["sentences", "links"]),
    "first_sentences": _sql([(_first(s), "|".join(x for x in k.split("|") if "@0:" in x)) for _, s, k in LINKS], ["sentences", "links"]),
    "description_cases": _sql([r[1:] for r in DESCRIPTIONS], ["tokens", "head"]),
    "escape_cases": _sql([(want,) for _, want in ESCAPES], ["value"], "'Q' || doc_id AS qid"),
    "json_converted": 'SELECT qid, name, "desc" FROM properties WHERE qid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY row_id DESC) = 1',
    "rotated_pages": """WITH l AS (SELECT doc_id, length(CAST(doc_id AS VARCHAR)) + 121 AS n FROM documents)
SELECT doc_id, ((sum(n) OVER (ORDER BY doc_id) - n) // 1048576)::INT AS file FROM l""",
    "extracted_folders": "SELECT CAST(doc_id AS VARCHAR) AS id, title, text FROM documents WHERE doc_id % 3 < 2",
    "one_article": "SELECT CAST(min(doc_id) AS VARCHAR) AS id, 'One' || chr(10) || chr(10) || '[[One|One]] page.' AS text FROM documents",
    "written_once": "SELECT row_id, qid FROM properties",
}
