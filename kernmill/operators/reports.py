"""Analysis reports over links, triples and the property tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernmill.functions import text as X
from kernmill.operators.corpus import both_ways, contexts
from kernmill.operators.skew import hot_counts, hot_keys, running_total, salted_lookup
from kernmill.session import stage, unstage


def _valid(triples: DataFrame) -> DataFrame:
    return triples.where("subj is not null and rel is not null and obj is not null").select("pos", "subj", "rel", "obj")


def related_triples(articles: DataFrame, triples: DataFrame) -> DataFrame:
    """``qid, pos``: the triples in which an article is subject or object (a self-loop once)."""
    ends = both_ways(triples).where("as_subject or qid <> target").select("qid", "pos")
    # one object may hold a large part of all triples
    return salted_lookup(ends, articles.select("qid"), "qid", F.col("pos"), hot_keys(ends, "qid")).select("qid", "pos")


def mentioned_pairs(articles: DataFrame, triples: DataFrame) -> DataFrame:
    """``qid, subj, obj, related``: triple pairs an article mentions.

    Related: the article and one of its links, either way round.  Unrelated: two of
    its links in the order of the link map, looked up in that orientation only.  A pair
    of the triples meets the articles that link to the one of its ends with fewer such
    articles, and those that link to the other end too stay; so no pair of links is ever
    listed, and a hub is expanded only against a larger one.
    """
    pairs = stage(_valid(triples).select("subj", "obj").distinct(), "pairs")
    links = stage(articles.select("qid", F.posexplode(F.map_keys("link")).alias("i", "t")), "links")
    ends = links.select("qid", "t").select("qid", F.inline(F.array(
        F.struct(F.col("qid").alias("subj"), F.col("t").alias("obj")), F.struct(F.col("t").alias("subj"), F.col("qid").alias("obj")))))
    rel = ends.join(pairs, ["subj", "obj"], "left_semi").select("qid", "subj", "obj", F.lit(True).alias("related"))
    linked = stage(links.groupBy("t").agg(F.count(F.lit(1)).alias("n")), "linked")
    both = pairs
    for end, n in (("subj", "n_s"), ("obj", "n_o")):
        # an end nothing links to leaves no pair; one object may hold a large part of all triples
        both = salted_lookup(both, linked.select(F.col("t").alias(end), F.col("n").alias(n)), end, F.xxhash64("subj", "obj"), hot_keys(pairs, end))
    from_subj = F.col("n_s") <= F.col("n_o")
    near = both.select("subj", "obj", F.when(from_subj, F.col("subj")).otherwise(F.col("obj")).alias("t"),
                       F.when(from_subj, F.col("obj")).otherwise(F.col("subj")).alias("far"), from_subj.alias("_s"))
    meets = salted_lookup(links, near, "t", F.col("qid"), hot_counts(linked, "t", "n", 50_000)).select("qid", "i", "far", "_s", "subj", "obj")
    known = links.select("qid", F.col("t").alias("far"), F.col("i").alias("j"))
    in_order = F.when(F.col("_s"), F.col("i") < F.col("j")).otherwise(F.col("j") < F.col("i"))
    unrel = meets.join(known, ["qid", "far"]).where(in_order).select("qid", "subj", "obj", F.lit(False).alias("related"))
    return rel.unionByName(unrel)


def triple_coverage(articles: DataFrame, triples: DataFrame) -> DataFrame:
    """One row: pairs in all, mentions, related and unrelated ones, distinct pairs, per cent covered."""
    total = _valid(triples).select("subj", "obj").distinct().agg(F.count(F.lit(1)).alias("n_all"))
    m = mentioned_pairs(articles, triples)
    # two-step distinct keeps the count spread over the pairs
    d = m.select("subj", "obj").distinct().agg(F.count(F.lit(1)).alias("n_distinct"))
    per = m.agg(
        F.count(F.lit(1)).alias("n_mentions"),
        F.coalesce(F.sum(F.col("related").cast("int")), F.lit(0)).alias("n_related"),
        F.coalesce(F.sum((~F.col("related")).cast("int")), F.lit(0)).alias("n_unrelated"),
    )
    # single-row sides
    return total.join(F.broadcast(per)).join(F.broadcast(d)).withColumn(
        "percent", F.when(F.col("n_all") > 0, 100.0 * F.col("n_distinct") / F.col("n_all")).otherwise(0.0)
    )


def title_triples(articles: DataFrame, triples: DataFrame, properties: DataFrame) -> DataFrame:
    """``qid, rel_name, obj_surface, as_subject``: triples of an article whose other end it links to.

    The surface is the linked span in the sentence it stands in; relations get their
    names, those without one are left out.
    """
    spans = contexts(articles, include_self=True).select(
        "qid", "target", X.span_surface(F.col("sentence"), F.col("begin"), F.col("end")).alias("obj_surface")
    )
    both = spans.where("obj_surface is not null").join(both_ways(triples), ["qid", "target"])
    names = properties.select(F.col("qid").alias("rel"), F.col("name").alias("rel_name")).where("rel_name is not null")
    # few relations hold most triples
    return salted_lookup(both, names, "rel", F.xxhash64("qid", "target", "pos"), hot_keys(both, "rel")).select("qid", "rel", "rel_name", "obj_surface", "as_subject")


def root_ancestors(edges: DataFrame) -> DataFrame:
    """``prop, root``: all roots above each child of the property tree, any number of parents.

    Doubling: after round k the pairs ``far`` lead exactly 2^k levels up and ``found``
    holds all roots nearer than that, so the rounds are logarithmic in the number of
    properties even where loops never end.  Nodes on or below loops only get the roots
    they reach otherwise; self-loops are no parents.
    """
    up = edges.where("child is not null and parent is not null and child <> parent").select(
        F.col("child").alias("prop"), F.col("parent").alias("at")
    )
    far = stage(up.distinct(), "far")
    n = far.select(F.explode(F.array("prop", "at")).alias("p")).distinct().count()
    tops = far.select(F.col("at").alias("prop")).distinct().join(far.select("prop"), "prop", "left_anti")
    found = stage(tops.select("prop", F.col("prop").alias("root")), "roots")
    reach = 1
    while reach <= n and far.limit(1).count():
        hop = far.select("prop", "at")
        via = hop.join(found.select(F.col("prop").alias("at"), "root"), "at").select("prop", "root")
        nxt = hop.join(far.select(F.col("prop").alias("at"), F.col("at").alias("to")), "at").select("prop", F.col("to").alias("at"))
        new_found, new_far = stage(found.unionByName(via).distinct(), "roots"), stage(nxt.distinct(), "far")
        unstage(found)
        unstage(far)
        found, far, reach = new_found, new_far, reach * 2
    return found.where("prop <> root")


def hypernym_properties(props: DataFrame, edges: DataFrame, frequent: DataFrame) -> DataFrame:
    """``place, qid, name, freq``: frequent properties that have no parent, by frequency.

    Ties by id; places count from zero.  ``props``: qid, name, freq (one row per qid).
    """
    top = props.join(edges.select(F.col("child").alias("qid")), "qid", "left_anti").join(frequent.select("qid"), "qid", "left_semi")
    return running_total(top.withColumn("_f", -F.col("freq")), [], ["_f", "qid"]).select(
        F.col("_rank").alias("place"), "qid", "name", "freq"
    )


def hypernym_summary(props: DataFrame, edges: DataFrame, frequent: DataFrame) -> DataFrame:
    """One row: all properties, those left without hyponyms, hyponyms, frequent ones, frequent and left."""
    child = edges.select(F.col("child").alias("qid")).distinct()
    left = props.select("qid").distinct().join(child, "qid", "left_anti")
    one = lambda d, n: d.agg(F.count(F.lit(1)).alias(n))
    parts = [
        one(props.select("qid").distinct(), "n_all"), one(left, "n_left"), one(child, "n_hyponyms"),
        one(frequent.select("qid").distinct(), "n_frequent"), one(left.intersect(frequent.select("qid")), "n_both"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # single rows
    return out
