"""Incremental triple frequency: an extension for feeds of new triples.

The batch query counts whole files; this one keeps counts per event-time window
and drops rows later than the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLE_FEED = "pos bigint, subj string, rel string, obj string, seen_at timestamp"


def read_feed(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Triples that arrive as Parquet files in a folder."""
    return spark.readStream.schema(TRIPLE_FEED).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_frequency(feed: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """``start, qid, freq`` per window.

    Written in ``append`` or ``update`` mode, state is bounded by the watermark and rows
    later than ``late`` are dropped; ``complete`` mode keeps all windows and drops
    none.  Rows with a null part or a null time are left out.
    """
    ends = [F.struct(F.col(c).alias("qid"), F.col(c).startswith("Q").cast("long").alias("n")) for c in ("subj", "obj")]
    rel = F.struct(F.col("rel").alias("qid"), F.lit(1).cast("long").alias("n"))
    return (
        feed.where("subj is not null and rel is not null and obj is not null and seen_at is not null")
        .withWatermark("seen_at", late)
        .select("seen_at", F.explode(F.array(*ends, rel)).alias("e"))
        .groupBy(F.window("seen_at", window), F.col("e.qid").alias("qid"))
        .agg(F.sum("e.n").alias("freq"))
        .select(F.col("window.start").alias("start"), "qid", "freq")
    )
