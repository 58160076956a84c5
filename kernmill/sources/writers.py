"""Writers; each replaces its target and leaves columns that are null out of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kernmill.operators.skew import running_total
from kernmill.sources.readers import read_json


def write_jsonlines(df: DataFrame, path: str, compression: str = "none", files: int = 0, max_records: int = 0) -> None:
    """JSON lines; ``max_records`` starts a new file after that many, ``files`` bounds the number of writers."""
    out = df.coalesce(files) if files else df
    out.write.option("maxRecordsPerFile", max_records).mode("overwrite").option("compression", compression).option("ignoreNullFields", "true").json(path)


def write_rotated(df: DataFrame, path: str, order: list[str], max_bytes: int = 1 << 20, compression: str = "none") -> None:
    """JSON lines in folders ``file=k``; a new one begins once ``max_bytes`` are reached (at least 200 KiB, as given by ``size_in_bytes``).

    The byte offset of every line in the whole output is an exact prefix sum in
    ``order``; a line belongs to the file its first byte falls into.
    """
    lines = df.select(*order, F.to_json(F.struct(*df.columns)).alias("value"))
    placed = running_total(lines.withColumn("_b", F.octet_length("value") + 1), [], order, "_b", "_at")
    out = placed.withColumn("file", F.floor(F.col("_at") / max_bytes)).select("file", *order, "value")
    out.repartition("file").sortWithinPartitions("file", *order).select("file", "value").write.partitionBy("file").mode("overwrite").option(
        "compression", compression
    ).text(path)


def write_keyed_json(df: DataFrame, path: str, key: str = "qid") -> None:
    """One JSON object ``{key: record}`` in one file, for readers that want a single document.

    Lines go through one task, as one file must, but as rows: no record is gathered
    in memory.  Ordered by key; an empty table gives an empty object.
    """
    pair = F.map_from_arrays(F.array(key), F.array(F.struct(*df.columns)))
    lines = df.select(F.lit(1).alias("_o"), F.col(key).cast("string").alias("_k"), F.to_json(pair).alias("_j")).select(
        "_o", "_k", F.expr("substring(_j, 2, length(_j) - 2)").alias("value")
    )
    numbered = running_total(lines, [], ["_k"], name="_rank").withColumn("value", F.when(F.col("_rank") > 0, F.concat(F.lit(","), "value")).otherwise(F.col("value")))
    ends = df.sparkSession.createDataFrame([(0, None, "{"), (2, None, "}")], "_o int, _k string, value string")
    whole = numbered.select("_o", "_k", "value").unionByName(ends)
    whole.repartition(1).sortWithinPartitions("_o", "_k").select("value").write.mode("overwrite").text(path)


def json_to_jsonlines(spark: SparkSession, source: str, path: str, schema: T.StructType) -> None:
    """Convert a document keyed by id to JSON lines of its records."""
    if not source.rstrip("/").endswith("json"):
        raise ValueError("the source must be a JSON document")
    write_jsonlines(read_json(spark, source, schema).drop("key"), path)


def write_tsv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Tab-separated text; tabs and line breaks inside values become blanks, null the empty string."""
    cols = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]", " ") for c in columns]
    df.select(F.concat_ws("\t", *cols).alias("value")).write.mode("overwrite").text(path)


def write_counts(df: DataFrame, path: str, key: str, count: str = "count") -> None:
    """Lines "key count", most frequent first."""
    df.orderBy(F.desc(count), key).select(F.concat_ws(" ", key, F.col(count).cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_once(df: DataFrame, path: str) -> bool:
    """Write Parquet unless the path is there already; whether it was written."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return False
    df.write.parquet(path)
    return True
