"""Queries of problems 3, 4, 6, 7, 8 and 9 and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernmill.llm import bpe, encoding, overlap, packing, residue, sentences
from kernmill.session import read_spread, stage


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return read_spread(spark, f"{sf}/{table}.parquet")


def _residue(spark, sf):
    return residue.find_residue(_read(spark, sf, "merged"))


def p3_found(spark, sf):
    return _residue(spark, sf).select("rec_id", "field")


def p3_clean(spark, sf):
    merged = _read(spark, sf, "merged")
    return residue.without_residue(merged, residue.find_residue(merged)).select("rec_id", "qid", "title", "desc")


def _garbled(spark, sf):
    items = _read(spark, sf, "items")
    return encoding.find_garbled(items, encoding.train(items))


def p4_found(spark, sf):
    return _garbled(spark, sf).select("row_id", "field")


def p4_restored(spark, sf):
    return _garbled(spark, sf)


def _overlaps(spark, sf):
    cols = ["ex_id", "desc", "contexts", "source"]
    dev, test, train = (_read(spark, sf, t).select(*cols).withColumn("split", F.lit(t)) for t in ("dev", "test", "train"))
    ev = dev.unionByName(test)
    return ev, overlap.split_overlaps(ev, train)


def p6_found(spark, sf):
    _, found = _overlaps(spark, sf)
    ids = overlap.expand_pairs(found)
    return ids.select(F.least("e_id", "t_id").alias("ex_id_a"), F.greatest("e_id", "t_id").alias("ex_id_b"))


def p6_report(spark, sf):
    ev, found = _overlaps(spark, sf)
    per = overlap.overlap_counts(found)
    return (
        per.join(ev.select(F.col("ex_id").alias("id"), "split", "source"), "id")
        .groupBy("split", "source")
        .agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_training").alias("n_pairs"))
    )


def p7_ids(spark, sf):
    return bpe.encode_texts(_read(spark, sf, "documents"))


def p7_decoded(spark, sf):
    return bpe.decode_ids(p7_ids(spark, sf))


def _sizes(spark, sf):
    return bpe.count_tokens(_read(spark, sf, "documents"))


def _packed(sizes):
    return packing.pack(sizes, largest_first=False)


def p8_containers(spark, sf):
    return _packed(_sizes(spark, sf)).select("doc_id", "part", "size", "container")


def p8_report(spark, sf):
    return packing.fill_report(_packed(_sizes(spark, sf)))


def p8_audit(spark, sf):
    """Whether every document is packed once, whole, and in containers that hold."""
    sizes = stage(_sizes(spark, sf), "sizes")
    return packing.audit(stage(_packed(sizes), "packed"), sizes)


def p8_tight(spark, sf):
    """Whether the containers are at most one in a hundred (and one) more than the least possible, and none overflows."""
    return p8_report(spark, sf).select(
        (F.col("n_containers") <= F.col("least_containers") * 1.01 + 1).alias("tight"), (F.col("max_fill") <= packing.CAPACITY).alias("fits")
    )


def p9_found(spark, sf):
    return sentences.find_sentences(_read(spark, sf, "documents"))


def p9_sentences(spark, sf):
    docs = _read(spark, sf, "documents")
    return sentences.split_documents(docs, sentences.train(docs), with_text=True).drop("char_end")


QUERIES = {
    "p3_found": p3_found,
    "p3_clean": p3_clean,
    "p4_found": p4_found,
    "p4_restored": p4_restored,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p7_ids": p7_ids,
    "p7_decoded": p7_decoded,
    "p8_containers": p8_containers,
    "p8_report": p8_report,
    "p8_audit": p8_audit,
    "p8_tight": p8_tight,
    "p9_found": p9_found,
    "p9_sentences": p9_sentences,
}

_P6 = """
WITH rec AS (
  SELECT ex_id, 'dev' AS split, source, "desc" AS d, contexts FROM dev
  UNION ALL SELECT ex_id, 'test', source, "desc", contexts FROM test
  UNION ALL SELECT ex_id, 'train', source, "desc", contexts FROM train
), words AS (
  SELECT ex_id, split, source, unnest(regexp_extract_all(lower(concat_ws(chr(10), d,
    array_to_string(list_transform(contexts, lambda c: c.sentence), chr(10)))), '[\\p{L}\\p{N}]+')) AS w FROM rec
), bag AS (SELECT ex_id, split, source, w, count(*) AS n FROM words GROUP BY ALL),
len AS (SELECT ex_id, sum(n) AS len FROM bag GROUP BY ex_id),
pair AS (
  SELECT e.ex_id AS e, t.ex_id AS t, e.split AS split, e.source AS source, sum(least(e.n, t.n)) AS common
  FROM bag e JOIN bag t ON e.w = t.w WHERE e.split <> 'train' AND t.split = 'train' GROUP BY ALL
), hit AS (
  SELECT p.* FROM pair p JOIN len a ON a.ex_id = p.e JOIN len b ON b.ex_id = p.t
  WHERE 5 * p.common >= 4 * greatest(a.len, b.len)
)
"""

ORACLE = {
    "p6_found": _P6 + "SELECT least(e, t) AS ex_id_a, greatest(e, t) AS ex_id_b FROM hit",
    "p6_report": _P6 + "SELECT split, source, count(DISTINCT e) AS n_records, count(*) AS n_pairs FROM hit GROUP BY split, source",
    "p8_audit": "SELECT doc_id, CAST(1 AS BIGINT) AS n_items, true AS whole, true AS fits FROM documents",
    "p8_tight": "SELECT true AS tight, true AS fits",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
