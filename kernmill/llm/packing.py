"""Filling fixed-capacity containers (problem 8) by online sum-of-squares packing.

Each arriving item goes to the fill level that makes the sum of squared numbers of
open containers per level smallest; a level array holds those numbers.  Items are
dealt to shards of bounded size by the hash of their key and arrive in the order of
that hash; the items of containers that shards leave open at their ends
arrive a second time, so that the loss at shard ends does not stay.  The result
depends on the items alone, not on how they are stored or on the number of cores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernmill.session import stage

CAPACITY = 2048
SHARD_ITEMS = 40_000
#: Containers that a shard leaves with less than this are taken up again: their items arrive once more, from all shards together.
CLOSED_FILL = 0.97


class SumOfSquares:
    """Online packer with integer sizes 1..capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> int:
        """Container number for an item; the choice among equals is the fullest level."""
        n, c = self.level, self.capacity
        # change of the sum, halved, for level h -> h + size; closing a container frees its level
        gain = n[size:c] - n[: c - size] + 1.0
        gain[n[: c - size] == 0] = np.inf
        best, at = (np.inf, -1)
        if size < c:
            gain[0] = n[size] + 0.5  # a new container
            at = len(gain) - 1 - int(np.argmin(gain[::-1]))
            best = gain[at]
        elif size == c:
            best, at = 0.0, 0
        full = c - size
        if full > 0 and n[full] > 0 and 0.5 - n[full] <= best:
            at = full
        if at == 0:
            box = self.made
            self.made += 1
        else:
            box = self.open[at].pop()
            n[at] -= 1
        if at + size < c:
            n[at + size] += 1
            self.open[at + size].append(box)
        return box


def split_oversized(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """``id_col, part, size``: items over the capacity cut into full parts and a rest.

    Others stay whole as part 0.  Null and negative sizes count as 0.
    """
    n = F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("long")
    parts = F.greatest(F.ceil(n / capacity), F.lit(1)).cast("int")
    cut = sizes.select(F.col(id_col), n.alias("_n"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return cut.select(id_col, "part", F.least(F.lit(capacity), F.col("_n") - F.col("part") * F.lit(capacity).cast("long")).alias("size"))


def _items(sizes: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """``id_col, part, size, copy``, unique: equal items are numbered from their count, so none is gathered."""
    n = split_oversized(sizes, id_col, size_col, capacity).groupBy(id_col, "part", "size").agg(F.count(F.lit(1)).alias("_n"))
    return n.select(id_col, "part", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("copy"))


def pack(
    sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY,
    shard_items: int = SHARD_ITEMS, largest_first: bool = True,
) -> DataFrame:
    """``id_col, part, size, copy, container``: every item in a container of ``capacity``.

    Items arrive in hashed order, the online setting, which the registered queries
    use; with ``largest_first`` each shard is sorted by size before, which helps where
    a shard holds few items for the number of levels.

    No item is split unless it alone exceeds the capacity.  Repeated ids, also null
    ones, are items of their own; ``copy`` tells equal ones apart.  Items of size 0 go
    to the first container of their shard.  An empty table gives no rows.
    """
    items = stage(_items(sizes, id_col, size_col, capacity), "items")
    key = [id_col, "part", "size", "copy"]
    full = items.where(F.col("size") >= capacity).withColumn(
        "container", F.concat_ws("-", F.lit("full"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), "part", "copy")
    )
    first = stage(_arrive(items.where(F.col("size") < capacity), key, "a", capacity, shard_items, largest_first), "first")
    fill = first.groupBy("container").agg(F.sum("size").alias("_fill"))
    closed = fill.where(F.col("_fill") >= CLOSED_FILL * capacity).select("container")
    left = stage(first.join(closed, "container", "left_anti").select(*key), "left")
    out = first.join(closed, "container", "left_semi").select(*key, "container")
    return out.unionByName(_arrive(left, key, "b", capacity, shard_items, largest_first)).unionByName(full)


def _arrive(items: DataFrame, key: list[str], name: str, capacity: int, shard_items: int, largest_first: bool) -> DataFrame:
    """``items`` (staged) with ``container``: packed by shards of their hash, one after the other."""
    hashed = items.withColumn("_h", F.xxhash64(F.lit(name), *key))
    shards = max(1, -(-items.count() // shard_items))
    fields = ", ".join(f"`{c}` {t}" for c, t in items.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", *key], kind="stable")
        if largest_first:
            pdf = pdf.sort_values("size", ascending=False, kind="stable")
        packer = SumOfSquares(capacity)
        box = [packer.place(int(s)) if s else 0 for s in pdf["size"]]
        pdf["container"] = [f"{name}-{i}-{b}" for i, b in zip(pdf["_shard"], box)]
        return pdf[[*key, "container"]]

    placed = hashed.withColumn("_shard", F.pmod("_h", F.lit(shards)).cast("int")).groupBy("_shard")
    return placed.applyInPandas(run, f"{fields}, container string")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, containers, tokens, least possible containers, unused share."""
    per = packed.groupBy("container").agg(F.sum("size").alias("fill"), F.count(F.lit(1)).alias("items"))
    return per.agg(
        F.coalesce(F.sum("items"), F.lit(0)).alias("n_items"),
        F.count(F.lit(1)).alias("n_containers"),
        F.coalesce(F.sum("fill"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.ceil(F.sum("fill") / capacity), F.lit(0)).alias("least_containers"),
        F.coalesce(F.max("fill"), F.lit(0)).alias("max_fill"),
    )


def audit(packed: DataFrame, sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """Per id: ``n_items`` packed under it, ``whole`` (its parts add up to its sizes), ``fits`` (no container of it overflows)."""
    fill = packed.groupBy("container").agg((F.sum("size") <= capacity).alias("_fits"))
    got = packed.join(fill, "container").groupBy(id_col).agg(
        F.count_if(F.col("part") == 0).alias("n_items"), F.sum("size").alias("_got"), F.min("_fits").alias("fits")
    )
    due = sizes.groupBy(F.col(id_col).alias("_id")).agg(F.sum(F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0))).alias("_due"))
    return due.join(got, F.col("_id").eqNullSafe(F.col(id_col)), "left").select(
        F.col("_id").alias(id_col), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce(F.col("_got") == F.col("_due"), F.lit(False)).alias("whole"), F.coalesce("fits", F.lit(False)).alias("fits"),
    )
