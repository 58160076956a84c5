"""Joins and per-key processing that stay balanced when few keys hold most rows.

``hot_keys``/``salted_lookup`` serve joins on keys that are skewed on one side.
``number_rows``/``chunk_states``/``merge_states`` implement exact offset
chunking: rows get a range-partitioned position, keys are counted per input
partition, a prefix sum over the partitions gives every partition's offset
within a key, local row numbers plus offset give an exact global rank, and rank
divided by the chunk size cuts each key into equal chunks.  Chunks are reduced
independently; their ordered boundary states are then merged per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernmill.session import stage

#: Keys with more than this part of all rows are hot, so there are fewer of them than this.
HOT_PARTS = 4096


def hot_keys(df: DataFrame, key: str, floor: int = 50_000, rows: int | None = None) -> DataFrame | None:
    """``key, _n``: the keys of ``df`` that need salts, and how many.

    Hot are all keys with more than ``floor`` rows and more than one in ``HOT_PARTS``
    of all rows; so the table has fewer than ``HOT_PARTS`` rows whatever the data, and
    what is not hot is no larger than a fair partition.  Counting combines map-side;
    nothing is collected.  Null keys are left out.  Where ``rows``, a known bound on
    the rows of ``df``, is no more than ``floor``, there is none.
    """
    if rows is not None and rows <= floor:
        return None
    return hot_counts(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_c")), key, "_c", floor)


def hot_counts(counts: DataFrame, key: str, count: str, floor: int) -> DataFrame:
    """``hot_keys`` of a table that has the number of rows of each key."""
    c = F.col(count)
    # one row
    total = counts.agg(F.coalesce(F.sum(c), F.lit(0)).alias("_all"))
    least = F.greatest(F.lit(floor), F.floor(F.col("_all") / HOT_PARTS))
    return counts.join(F.broadcast(total)).where(c > least).select(key, F.least(F.lit(HOT_PARTS), F.ceil(c / least)).cast("int").alias("_n"))


def salted(df: DataFrame, key: str, hot: DataFrame | None, spread_by: Column | None = None) -> DataFrame:
    """``df`` with ``_salt``: one of the key's salts by ``spread_by``, or one row for each of them without it.

    Keys that are not in ``hot`` have salt 0 only.
    """
    if hot is None:
        return df.withColumn("_salt", F.lit(0).cast("int"))
    # fewer than HOT_PARTS rows
    known = df.join(F.broadcast(hot), key, "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    salt = F.explode(F.sequence(F.lit(0), F.col("_n") - 1)) if spread_by is None else F.pmod(F.xxhash64(spread_by), F.col("_n").cast("long")).cast("int")
    return known.withColumn("_salt", salt).drop("_n")


def salted_lookup(left: DataFrame, right: DataFrame, key: str, spread_by: Column, hot: DataFrame | None) -> DataFrame:
    """Inner join of ``left`` with ``right`` on ``key``, hot keys of ``left`` salted.

    Rows of a hot key are spread over as many salts as keep each near the row limit
    of ``hot_keys``; the matching right rows are repeated per salt.  Null keys match
    nothing.
    """
    lhs = salted(left.where(F.col(key).isNotNull()), key, hot, spread_by)
    return lhs.join(salted(right, key, hot), [key, "_salt"]).drop("_salt")


def _placed(df: DataFrame, order: list[str], partitions: int | None) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(
        df.repartitionByRange(n, *[F.col(c) for c in order]).withColumn("_seg", F.spark_partition_id()), "numbered"
    )


def running_total(
    df: DataFrame, key: list[str], order: list[str], value: str | None = None, name: str = "_rank",
    partitions: int | None = None,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the key before this one.

    Without ``value`` it is the exact zero-based place of the row.  With an empty key
    all rows are one sequence.  ``order`` must be unique within a key for a defined
    result; ties are broken arbitrarily but consistently.  Null keys form a key of
    their own.  No task ever holds more than one input partition's share of a key.
    """
    placed = _placed(df, order, partitions)
    v = F.col(value) if value else F.lit(1).cast("long")
    counts = placed.groupBy("_seg", *key).agg(F.sum(v).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = Window.partitionBy("_seg", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.withColumn("_local", F.coalesce(F.sum(v).over(local), F.lit(0)))
    cond = rows["_seg"] == offsets["_seg"]
    for k in key:
        cond = cond & rows[k].eqNullSafe(offsets[k])
    return rows.join(offsets, cond).select(*[rows[c] for c in df.columns], (F.col("_off") + F.col("_local")).alias(name))


def number_rows(df: DataFrame, key: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Add ``_rank``: the exact zero-based place of each row within its key (see ``running_total``)."""
    return running_total(df, key, order, None, "_rank", partitions)


def top_k_per_key(df: DataFrame, key: list[str], order: list, k: int, salts: int | None = None) -> DataFrame:
    """The first ``k`` rows of each key, in two steps so that a hot key is spread over ``salts`` tasks (as many as shuffle partitions)."""
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(salts)).cast("int")
    first = Window.partitionBy(*key, "_salt").orderBy(*order)
    last = Window.partitionBy(*key).orderBy(*order)
    part = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    return part.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= k).drop("_salt", "_r")


def chunk_states(numbered: DataFrame, key: list[str], unit: str, chunk_rows: int = 100_000) -> DataFrame:
    """Reduce each equal-sized chunk of a key to its boundary state.

    State: number of rows, distinct ``unit`` runs (``unit`` ascends with the
    rank), first and last unit, and the largest step between neighbouring units.
    """
    cut = numbered.withColumn("_chunk", F.floor(F.col("_rank") / chunk_rows))
    w = Window.partitionBy(*key, "_chunk").orderBy("_rank")
    prev = F.lag(unit).over(w)
    return (
        cut.withColumn("_new", F.when(prev.isNull() | (prev != F.col(unit)), 1).otherwise(0))
        .withColumn("_step", F.col(unit) - prev)
        .groupBy(*key, "_chunk")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("_new").alias("n_units"),
            F.min(unit).alias("first_unit"),
            F.max(unit).alias("last_unit"),
            F.max("_step").alias("max_step"),
        )
    )


def merge_states(states: DataFrame, key: list[str]) -> DataFrame:
    """Merge a key's chunk states in chunk order into one row per key.

    A unit that runs over a chunk border is counted once, and the step across
    the border takes part in ``max_step`` (null for a key with a single unit row).
    """
    w = Window.partitionBy(*key).orderBy("_chunk")
    prev = F.lag("last_unit").over(w)
    return (
        states.withColumn("_same", F.when(prev == F.col("first_unit"), 1).otherwise(0))
        .withColumn("_cross", F.col("first_unit") - prev)
        .groupBy(*key)
        .agg(
            F.sum("n_rows").alias("n_entries"),
            (F.sum("n_units") - F.sum("_same")).alias("n_records"),
            F.min("first_unit").alias("first_rec"),
            F.max("last_unit").alias("last_rec"),
            F.max(F.greatest("max_step", "_cross")).alias("max_gap"),
            F.count(F.lit(1)).alias("n_chunks"),
        )
    )
