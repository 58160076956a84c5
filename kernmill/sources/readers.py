"""Readers of dumps and of the engine's own files.

Every line reader adds ``pos``, a struct that rises with file path, block in the file
and line in the block, so that "last wins" and row caps follow the files however Spark
packs their splits.  It serves as an order only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kernmill import schemas
from kernmill.operators.skew import number_rows


def order_key() -> Column:
    """Order of lines in files: path, block, then place among the rows of the task that reads the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
    )


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``pos, value``; gzip and bzip2 files are read as they are."""
    return spark.read.text(path).select(order_key().alias("pos"), "value")


def capped(lines: DataFrame, max_rows: int) -> DataFrame:
    """The first ``max_rows`` rows in file order, exactly; 0 keeps all.

    Rows are numbered by range partition and prefix sums, so a large cap is no
    single task either.
    """
    if not max_rows:
        return lines
    return number_rows(lines, [], ["pos"]).where(F.col("_rank") < max_rows).drop("_rank")


def read_ntriples(spark: SparkSession, path: str | list[str], max_rows: int = 0) -> DataFrame:
    """N-Triples lines for ``operators.entities.parse_ntriples``."""
    return capped(read_lines(spark, path), max_rows)


def read_jsonlines(spark: SparkSession, path: str | list[str], schema: T.StructType, max_rows: int = 0) -> DataFrame:
    """JSON lines under an explicit schema, with ``pos``; absent fields are null."""
    d = spark.read.schema(schema).json(path)
    return capped(d.select(*d.columns, order_key().alias("pos")), max_rows)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file holding one JSON object keyed by id, as rows ``key`` plus the fields of ``schema``."""
    whole = spark.read.text(path, wholetext=True)
    m = F.from_json("value", T.MapType(T.StringType(), schema))
    return whole.select(F.explode(m).alias("key", "v")).select("key", "v.*")


def last_by_id(rows: DataFrame, key: str = "qid") -> DataFrame:
    """One row per key, the last in ``pos`` order."""
    others = [c for c in rows.columns if c not in (key, "pos")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), "pos").alias("v")).select(key, "v.*")


def read_triples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``pos, subj, rel, obj`` of a tab-separated file; lines of other lengths are left out."""
    t = F.split("value", "\t")
    return read_lines(spark, path).where(F.size(t) == 3).select(
        "pos", *[F.get(t, F.lit(i)).alias(c) for i, c in enumerate(("subj", "rel", "obj"))]
    )


def read_title_map(spark: SparkSession, path: str) -> DataFrame:
    """``title, qid`` of a tab-separated file."""
    t = F.split("value", "\t")
    return spark.read.text(path).where(F.size(t) == 2).select(F.get(t, F.lit(0)).alias("title"), F.get(t, F.lit(1)).alias("qid"))


def read_subproperties(spark: SparkSession, path: str) -> DataFrame:
    """``child, parent`` of white-space separated rows whose two ends start with P."""
    t = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(t) == 3).select(F.get(t, F.lit(0)).alias("child"), F.get(t, F.lit(2)).alias("parent")).where(
        "child like 'P%' and parent like 'P%'"
    )


def read_pages(spark: SparkSession, path: str, redirects: bool = False) -> DataFrame:
    """``id, revid, title, ns, text`` of an XML dump's pages; redirect pages are left out unless asked for.

    The reader splits compressed bzip2 dumps; entities are decoded once, here.
    """
    schema = T._parse_datatype_string(
        "title string, ns int, id bigint, redirect string, revision struct<id:bigint,text:string>"
    )
    d = (
        spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").option("nullValue", "\u0000")
        .schema(schema).load(path)
    )
    if not redirects:
        d = d.where("redirect is null")
    return d.select("id", F.col("revision.id").alias("revid"), "title", "ns", F.col("revision.text").alias("text"))


def read_siteinfo(spark: SparkSession, path: str) -> dict:
    """Base address (up to its last slash) and namespaces of a dump: a single small record."""
    schema = T._parse_datatype_string("base string, namespaces struct<namespace:array<struct<_key:int,_VALUE:string>>>")
    rows = spark.read.format("xml").option("rowTag", "siteinfo").schema(schema).load(path).limit(1).collect()
    if not rows:
        return {"base": "", "namespaces": {}}
    r = rows[0]
    spaces = {n["_VALUE"] or "": n["_key"] for n in (r["namespaces"]["namespace"] if r["namespaces"] else [])}
    return {"base": (r["base"] or "").rpartition("/")[0], "namespaces": spaces}


def read_table(spark: SparkSession, url: str, table: str, columns: list[str], **options: str) -> DataFrame:
    """Columns of a database table through JDBC; filters and projections are pushed down."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(*columns)


def read_extracted(spark: SparkSession, folders: str | list[str], max_files: int = 0) -> DataFrame:
    """Extracted pages of folder trees (``*/wiki_*``); ``max_files`` keeps the first files by path, 0 all."""
    globs = [f"{f.rstrip('/')}/*/wiki_*" for f in ([folders] if isinstance(folders, str) else folders)]
    paths: list[str] = globs
    if max_files:
        jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), []
        for g in globs:
            p = jvm.org.apache.hadoop.fs.Path(g)
            found += [str(x.getPath()) for x in (p.getFileSystem(conf).globStatus(p) or [])]
        paths = sorted(found)[:max_files]
        if not paths:
            return spark.createDataFrame([], schemas.PAGE)
    return spark.read.schema(schemas.PAGE).json(paths)
