"""Entities of the knowledge graph from triples and literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernmill.functions import text as X
from kernmill.operators.skew import running_total


def parse_ntriples(lines: DataFrame, require_iri: bool = False) -> DataFrame:
    """``pos, subj, rel, obj`` tokens of N-Triples lines (``pos, value``) with ids ``s, r, o`` ('' if none).

    A line is cut at single blanks; the object is what stands between the relation
    and the closing dot.  Null and too short lines are left out.
    """
    t = F.split("value", " ")
    return (
        lines.where(F.size(t) >= 4)
        .select(
            "pos",
            F.get(t, F.lit(0)).alias("subj"),
            F.get(t, F.lit(1)).alias("rel"),
            F.array_join(F.slice(t, F.lit(3), F.greatest(F.size(t) - 3, F.lit(0))), " ").alias("obj"),
        )
        .withColumns({a: X.entity_id(F.col(b), require_iri) for a, b in (("s", "subj"), ("r", "rel"), ("o", "obj"))})
    )


def edges(parsed: DataFrame) -> DataFrame:
    """``pos, subj, rel, obj`` ids of lines whose three parts all carry an id."""
    return parsed.where("s <> '' and r <> '' and o <> ''").select(
        "pos", F.col("s").alias("subj"), F.col("r").alias("rel"), F.col("o").alias("obj")
    )


def literals(parsed: DataFrame, lang: str = "en", strict_lang: bool = False) -> DataFrame:
    """``pos, qid, field, value`` of name, description and alias lines that are no edges."""
    rel = F.col("rel")
    field = F.when(rel == X.NAME_REL, "name").when(rel == X.DESC_REL, "desc").when(rel == X.AKA_REL, "aka")
    # an escape stands for a character, so the raw text tells whether anything is left
    raw = X.squeeze(X.language_value(F.col("obj"), lang, strict_lang))
    return (
        parsed.where("s <> '' and not (r <> '' and o <> '')")
        .where(rel.isin(X.NAME_REL, X.DESC_REL, X.AKA_REL))
        .select("pos", F.col("s").alias("qid"), field.alias("field"), raw.alias("_raw"))
        .where(F.length("_raw") > 0)
        .select("pos", "qid", "field", X.decode_escapes(F.col("_raw")).alias("value"))
    )


def triple_frequency(triples: DataFrame) -> DataFrame:
    """``qid, freq``: how often an entity stands in a triple.

    A relation counts once; subject and object count only if they are items, but a
    property there becomes an entity all the same.  Rows with a null part are no
    triples.  Counting combines map-side, so hub entities cost nothing extra.
    """
    ends = [F.struct(F.col(c).alias("qid"), F.col(c).startswith("Q").cast("long").alias("n")) for c in ("subj", "obj")]
    rel = F.struct(F.col("rel").alias("qid"), F.lit(1).cast("long").alias("n"))
    return (
        triples.where("subj is not null and rel is not null and obj is not null")
        .select(F.explode(F.array(*ends, rel)).alias("e"))
        .groupBy(F.col("e.qid").alias("qid"))
        .agg(F.sum("e.n").alias("freq"))
    )


def last_values(rows: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """One row per key with the columns of its last row, nulls included."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.max_by(F.struct(F.col(c)), F.col(order))[c].alias(c) for c in cols]
    )


def last_present(rows: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """One row per key with the last non-null value of each column."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols]
    )


def assemble(lits: DataFrame, freq: DataFrame) -> DataFrame:
    """Entities ``qid, name, desc, aka, freq``: last name and description, all aliases in order.

    Entities of the triples without a literal have '' and an empty list.
    """
    v, at = F.col("value"), F.col("pos")
    pick = lambda f: F.coalesce(F.max_by(v, F.when(F.col("field") == f, at)), F.lit(""))
    aka = F.sort_array(F.collect_list(F.when(F.col("field") == "aka", F.struct("pos", "value"))))
    found = lits.groupBy("qid").agg(
        pick("name").alias("name"), pick("desc").alias("desc"), F.transform(aka, lambda x: x["value"]).alias("aka")
    )
    return found.join(freq, "qid", "full").select(
        "qid", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("desc", F.lit("")).alias("desc"),
        F.coalesce("aka", F.array().cast("array<string>")).alias("aka"), F.coalesce("freq", F.lit(0)).alias("freq"),
    )


def complete(required: list[str], types: dict[str, str]) -> Column:
    """Whether every required field is non-empty (null counts as empty)."""
    cond = F.lit(True)
    for f in required:
        full = F.size(f) > 0 if types[f].startswith("array") else F.length(f) > 0
        cond = cond & F.coalesce(full, F.lit(False))
    return cond


def is_property(col: str = "qid") -> Column:
    return F.col(col).startswith("P")


def ranked(entities: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent, ties by id; planned as a top-k."""
    return entities.orderBy(F.desc("freq"), "qid").limit(n)


def by_frequency(entities: DataFrame) -> DataFrame:
    """All entities with ``place``, zero-based, by falling frequency; ties by id.  Sorted by range partitions, not in one task."""
    keyed = entities.withColumn("_f", -F.col("freq"))
    return running_total(keyed, [], ["_f", "qid"], name="place").drop("_f")


def relations_by_pair(triples: DataFrame) -> DataFrame:
    """``subj, obj, rels``: all relations of a pair in file order, and the last one."""
    return (
        triples.where("subj is not null and rel is not null and obj is not null")
        .groupBy("subj", "obj")
        .agg(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", "rel"))), lambda x: x["rel"]).alias("rels"),
            F.max_by("rel", "pos").alias("last_rel"),
        )
    )


def degrees(triples: DataFrame) -> DataFrame:
    """``qid, n_out, n_in``: forward and backward neighbours of each node, repeats counted."""
    both = F.array(
        F.struct(F.col("subj").alias("qid"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("obj").alias("qid"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )
    return (
        triples.where("subj is not null and rel is not null and obj is not null")
        .select(F.inline(both))
        .groupBy("qid")
        .agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    )


def subgraph(entities_ranked: DataFrame, props_ranked: DataFrame, triples: DataFrame, n_items: int, n_props: int) -> dict[str, DataFrame]:
    """Triples among the most frequent items and properties, and those of both that they use."""
    items, props = ranked(entities_ranked, n_items), ranked(props_ranked, n_props)
    kept = (
        triples.join(items.select(F.col("qid").alias("subj")), "subj", "left_semi")
        .join(items.select(F.col("qid").alias("obj")), "obj", "left_semi")
        .join(props.select(F.col("qid").alias("rel")), "rel", "left_semi")
    )
    used_items = kept.select(F.explode(F.array("subj", "obj")).alias("qid")).distinct()
    used_props = kept.select(F.col("rel").alias("qid")).distinct()
    return {
        "triples": kept.select("pos", "subj", "rel", "obj"),
        "items": items.join(used_items, "qid", "left_semi"),
        "props": props.join(used_props, "qid", "left_semi"),
    }
