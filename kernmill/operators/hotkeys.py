"""Per-entity results over link and context entries of merged records.

Problem 2: a few entities own most entries.  Entries of both fields are numbered
exactly within their entity and processed in equal chunks (``operators.skew``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernmill.operators.skew import chunk_states, merge_states, number_rows

CHUNK_ROWS = 20_000


def entity_entries(merged: DataFrame) -> DataFrame:
    """One row per link or contexts entry: ``field, qid, rec_id, ord``.

    A link entry belongs to its target, a contexts entry to the record's own
    qid.  Null or empty maps and arrays have no entries; null elements of
    contexts and faulty positions are entries all the same.  Only the columns
    named are read; clashing extra columns do no harm.
    """
    links = F.transform(
        F.coalesce(F.map_keys("link"), F.array().cast("array<string>")),
        lambda k, i: F.struct(F.lit("link").alias("field"), k.alias("qid"), i.alias("ord")),
    )
    # through one leaf of the element struct, so that the scan reads no sentences
    own = F.transform(
        F.coalesce(F.col("contexts.span.begin"), F.array().cast("array<int>")),
        lambda _, i: F.struct(F.lit("contexts").alias("field"), F.col("qid").alias("qid"), i.alias("ord")),
    )
    return (
        merged.select("rec_id", F.explode(F.concat(links, own)).alias("e"))
        .select("e.field", "e.qid", F.col("rec_id").cast("long").alias("rec_id"), F.col("e.ord").cast("int").alias("ord"))
    )


def entity_profile(merged: DataFrame, chunk_rows: int = CHUNK_ROWS, partitions: int | None = None) -> DataFrame:
    """Per field and entity: entries, records, first and last record, widest gap, share.

    ``share`` is the entity's part of all entries of the field (null qids count in
    the whole and form a row of their own).  Empty input gives no rows; repeated
    rows count each.
    """
    key = ["field", "qid"]
    numbered = number_rows(entity_entries(merged), key, ["rec_id", "field", "ord"], partitions)
    per_key = merge_states(chunk_states(numbered, key, "rec_id", chunk_rows), key)
    # one row per field, so the joined side is two rows at most
    totals = per_key.groupBy("field").agg(F.sum("n_entries").alias("_all"))
    return per_key.join(F.broadcast(totals), "field").select(
        "field", "qid", "n_entries", "n_records", "first_rec", "last_rec", "max_gap", "n_chunks",
        (F.col("n_entries") / F.col("_all")).alias("share"), F.col("_all").alias("field_entries"),
    )


def heavy_entities(profile: DataFrame, percent: int = 3) -> DataFrame:
    """Entities holding at least ``percent`` per cent of a field's entries."""
    return profile.where(
        F.col("qid").isNotNull() & (F.col("n_entries") * 100 >= F.col("field_entries") * percent)
    ).select("field", "qid")
