"""Articles with sentences and links from extracted pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kernmill.functions import text as X
from kernmill.functions.tokens import link_paragraph
from kernmill.operators.corpus import body_paragraphs
from kernmill.operators.skew import hot_keys, salted_lookup

_PLACED = T.StructType(
    [T.StructField("target", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("para", "sent", "begin", "end")]]
)
_PARSED = T.StructType([T.StructField("text", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("links", T.ArrayType(_PLACED))])


def _parsed(paragraphs: Column, first_sentences: int) -> Column:
    @F.pandas_udf(_PARSED)
    def run(ps: pd.Series) -> pd.DataFrame:
        texts, links = [], []
        for lines in ps:
            text, found = [], []
            for para, line in enumerate(() if lines is None else lines):
                sents = link_paragraph(line, first_sentences)
                text.append([s["sentence"] for s in sents])
                found += [{"target": k["target"], "para": para, "sent": n, "begin": k["begin"], "end": k["end"]} for n, s in enumerate(sents) for k in s["links"]]
            texts.append(text)
            links.append(found)
        return pd.DataFrame({"text": texts, "links": links})

    return run(paragraphs)


def build_articles(pages: DataFrame, titles: DataFrame, first_paragraphs: int = 0, first_sentences: int = 0) -> DataFrame:
    """``rec_id, qid, pid, title, text, link`` of pages (``id, title, text``) whose title has a qid in ``titles`` (``title, qid``).

    Pages of a title only are left out.  Link targets without a qid keep their words
    but give no link; of several links to the same target the last one stays, and of
    several pages with the same qid the one with the largest id, which is its ``rec_id``.
    A title with several qids has the smallest.  Sentences and links
    come from one narrow pass; popular targets are salted in the title lookup.
    """
    body = body_paragraphs(F.col("text"), first_paragraphs)
    known = titles.where("title is not null and qid is not null").groupBy("title").agg(F.min("qid").alias("qid"))
    art = (
        pages.select(F.col("id").alias("pid"), "title", X.title_key(F.col("title")).alias("_key"), body.alias("_body"))
        .where("_body is not null")
        .join(known.select(F.col("title").alias("_key"), "qid"), "_key")
        .select("qid", "pid", "title", _parsed(F.col("_body"), first_sentences).alias("p"))
    )
    last = art.groupBy("qid").agg(F.max_by(F.struct("pid", "title", "p"), "pid").alias("a")).select("qid", "a.*")
    links = last.select("qid", F.posexplode("p.links").alias("i", "l")).select("qid", "i", F.col("l.target").alias("_key"), "l")
    found = salted_lookup(links, known.select(F.col("title").alias("_key"), F.col("qid").alias("target")), "_key", F.xxhash64("qid", "i"), hot_keys(links, "_key"))
    place = F.struct(F.col("l.para").alias("para"), F.col("l.sent").alias("sent"), F.struct(F.col("l.begin").alias("begin"), F.col("l.end").alias("end")).alias("span"))
    # one entry per target first, so that no map ever sees a key twice
    per_target = found.groupBy("qid", "target").agg(F.max_by(place, "i").alias("p"))
    maps = per_target.groupBy("qid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("target", "p")))).alias("link"))
    return last.join(maps, "qid", "left").select(F.col("pid").cast("long").alias("rec_id"), "qid", "pid", "title", F.col("p.text").alias("text"), "link")
