"""Example selection, exact reproducible splits and category statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernmill.functions import text as X
from kernmill.operators.skew import running_total, top_k_per_key


def usable_contexts(contexts: Column) -> Column:
    """Contexts with a non-empty sentence and a span that is not turned round."""
    return F.filter(contexts, lambda c: (F.length(c["sentence"]) > 0) & (c["span"]["end"] >= c["span"]["begin"]))


def desc_examples(merged: DataFrame) -> DataFrame:
    """Records with a usable description and at least one usable context."""
    out = merged.where(X.usable_description(F.col("desc"))).withColumn("contexts", usable_contexts(F.col("contexts")))
    return out.where(F.size("contexts") > 0)


def shares(n: int, train_percent: float) -> tuple[int, int]:
    """Sizes of dev and test: half of what training leaves each, rounded down."""
    k = int(n * (100 - train_percent) / 2 * 0.01)
    return k, k


def exact_split(rows: DataFrame, ids: list[str], n_dev: int, n_test: int, seed: str = "42") -> DataFrame:
    """Add ``split``: the first ``n_dev`` rows of a reproducible random order dev, the next test, the rest train.

    Exact sizes without a single global sort task: rows are numbered by range
    partition and prefix sums.
    """
    keyed = rows.withColumn("_o", X.spread(seed, *[F.col(c) for c in ids]))
    ranked = running_total(keyed, [], ["_o", *ids])
    label = F.when(F.col("_rank") < n_dev, "dev").when(F.col("_rank") < n_dev + n_test, "test").otherwise("train")
    return ranked.withColumn("split", label).drop("_o", "_rank")


def category_uniform_split(rows: DataFrame, ids: list[str], category: str, n_dev: int, n_test: int, n_train: int, seed: str = "42") -> DataFrame:
    """Draw dev, test and train by choosing a category uniformly, then a row in it, without replacement.

    Exact in distribution: rows of a category arrive as a unit-rate Poisson process in
    random order, and the next arrival among non-empty categories is uniform over
    them.  Rows beyond the three sizes are left out, as the procedure stops there.
    """
    keyed = rows.withColumn("_o", X.spread(seed, *[F.col(c) for c in ids]))
    keyed = keyed.withColumn("_e", -F.log(X.uniform(F.col("_o"))))
    timed = running_total(keyed, [category], ["_o", *ids], "_e", "_before")
    timed = timed.withColumn("_t", F.col("_before") + F.col("_e")).drop("_e", "_before")
    ranked = running_total(timed, [], ["_t", *ids])
    r = F.col("_rank")
    label = F.when(r < n_dev, "dev").when(r < n_dev + n_test, "test").when(r < n_dev + n_test + n_train, "train")
    return ranked.withColumn("split", label).where("split is not null").drop("_o", "_t", "_rank")


def cap_contexts(rows: DataFrame, key: list[str], ids: list[str], n: int = 10, seed: str = "42") -> DataFrame:
    """At most ``n`` rows per key, a reproducible random choice; hot keys are reduced in salted parts first."""
    keyed = rows.withColumn("_o", X.spread(seed, *[F.col(c) for c in ids]))
    return top_k_per_key(keyed, key, [F.col("_o"), *[F.col(c) for c in ids]], n).drop("_o")


def category_counts(rows: DataFrame, category: str) -> DataFrame:
    return rows.groupBy(category).agg(F.count(F.lit(1)).alias("count"))


def top_categories(rows: DataFrame, category: str, n: int = 500, none: str = "-") -> DataFrame:
    """The ``n`` most frequent categories but ``none``; ties by name."""
    c = F.col(category)
    return category_counts(rows.where(c.isNotNull() & (c != none)), category).orderBy(F.desc("count"), category).limit(n)


def histogram(rows: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """``bin, lo, hi, count``: equal-width bins between least and greatest value, the last one closed.

    Empty bins are left out; with a single distinct value all rows are in bin 0.
    """
    ends = rows.agg(F.min(value).cast("double").alias("_a"), F.max(value).cast("double").alias("_b"))
    width = (F.col("_b") - F.col("_a")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_a")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    # one row of extremes
    return (
        rows.where(F.col(value).isNotNull())
        .join(F.broadcast(ends))
        .groupBy(at.alias("bin"), "_a", width.alias("_w"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select("bin", (F.col("_a") + F.col("bin") * F.col("_w")).alias("lo"), (F.col("_a") + (F.col("bin") + 1) * F.col("_w")).alias("hi"), "count")
    )


def split_statistics(examples: DataFrame, split: str) -> DataFrame:
    """Per split: records, non-blank descriptions, contexts, mean contexts."""
    n = F.greatest(F.coalesce(F.size("contexts"), F.lit(0)), F.lit(0))
    return examples.groupBy(split).agg(
        F.count(F.lit(1)).alias("entities"),
        F.coalesce(F.sum((F.trim("desc") != "").cast("int")), F.lit(0)).alias("with_desc"),
        F.sum(n).alias("contexts"),
        F.avg(n).alias("mean_contexts"),
    )


