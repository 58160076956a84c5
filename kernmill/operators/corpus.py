"""Articles, links, contexts and merged entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernmill.functions import text as X
from kernmill.operators.entities import last_values
from kernmill.operators.skew import number_rows
from kernmill.session import stage


def title_map(page: DataFrame, usage: DataFrame) -> DataFrame:
    """``title, qid`` of main-namespace pages that are no redirects, through sitelink usage.

    ``page``: page_id, page_title, page_namespace, page_is_redirect;
    ``usage``: eu_page_id, eu_entity_id, eu_aspect.  Of a title with several ids the
    smallest page's largest id stays, so the result does not depend on row order.
    """
    p = page.where("page_namespace = 0 and page_is_redirect = 0")
    u = usage.where("eu_aspect = 'S'")
    return (
        p.join(u, p["page_id"] == u["eu_page_id"])
        .groupBy(F.col("page_title").alias("title"))
        .agg(F.min_by("eu_entity_id", F.struct("page_id", "eu_entity_id")).alias("qid"))
    )


def with_redirects(titles: DataFrame, page: DataFrame, redirect: DataFrame) -> DataFrame:
    """``titles`` plus titles of pages that redirect (one hop) to a known title; redirects win."""
    known = titles.select(F.col("title").alias("rd_title"), "qid")
    hop = (
        page.where("page_namespace = 0")
        .join(redirect.where("rd_namespace = 0"), F.col("page_id") == F.col("rd_from"))
        .join(known, "rd_title")
        .groupBy(F.col("page_title").alias("title"))
        .agg(F.min("qid").alias("qid"))
    )
    return hop.unionByName(titles.join(hop.select("title"), "title", "left_anti"))


def titles_by_id(titles: DataFrame, order: str) -> DataFrame:
    """Inverse map ``qid, title``; the last title in ``order`` wins."""
    return titles.where("qid is not null").groupBy("qid").agg(F.max_by("title", order).alias("title"))


#: Fixed value: the template that opens a disambiguation page.
DISAMBIGUATION = r"(?m)^\{\{disambig(uation)?(\|[^}]*)?\}\}"


def is_content_page(ns: Column, text: Column, skip_disambiguation: bool = True) -> Column:
    """Main namespace and, if asked, no line that starts with a disambiguation template."""
    ok = ns == "0"
    if skip_disambiguation:
        ok = ok & ~F.coalesce(text, F.lit("")).rlike(DISAMBIGUATION)
    return ok


def content_length(text: Column) -> Column:
    """Characters of all lines without the line breaks."""
    return F.length(F.replace(text, F.lit("\n"), F.lit("")))


def body_paragraphs(text: Column, first_n: int = 0) -> Column:
    """Non-empty lines but the title line; null where nothing but a title is left.

    Lines of ideographic spaces only count as empty.  ``first_n`` > 0 keeps that many.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, "^[　 ]+$", "") != "")
    body = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    if first_n:
        body = F.slice(body, 1, first_n)
    return F.when(F.size(lines) > 1, body)


LINK = r"\[\[([^\[\]|]+)(?:\|([^\[\]|]*))?\]\]"


def anchors(text: Column) -> Column:
    """Array of ``target, label`` of all wiki links in order; the label defaults to the target."""
    t = F.regexp_extract_all(text, F.lit(LINK), F.lit(1))
    a = F.regexp_extract_all(text, F.lit(LINK), F.lit(2))
    return F.zip_with(t, a, lambda x, y: F.struct(x.alias("target"), F.when(F.coalesce(y, F.lit("")) == "", x).otherwise(y).alias("label")))


def accepted_target(target: Column, prefixes: tuple[str, ...] = ("w", "wiktionary", "wikt")) -> Column:
    """Whether a link target is kept: no namespace prefix, or one of ``prefixes``."""
    has = F.instr(target, ":") > 1
    return ~target.startswith(":") & (~has | F.substring_index(target, ":", 1).isin(*prefixes))


def last_articles(merged: DataFrame, order: str = "rec_id") -> DataFrame:
    """One article per qid, the last extraction; rows without qid are left out."""
    return last_values(merged, "qid", order, [*([order] if order == "rec_id" else []), "title", "pid", "text", "link"])


def link_rows(articles: DataFrame) -> DataFrame:
    """``qid, target, para, sent, begin, end``: the link map as rows; null maps give none."""
    return articles.select("qid", F.explode("link").alias("target", "p")).select(
        "qid", "target", "p.para", "p.sent", F.col("p.span.begin").alias("begin"), F.col("p.span.end").alias("end")
    )


def contexts(articles: DataFrame, include_self: bool = False) -> DataFrame:
    """``target, qid, sentence, begin, end``: the sentence of each link, one per article and target.

    Links without a sentence at their place are left out; self-links only count if
    asked for.  One narrow pass: rows, not per-target lists, so hubs do not matter.
    """
    sentence = X.sentence_at(F.col("text"), F.col("p.para"), F.col("p.sent"))
    rows = articles.select("qid", "text", F.explode("link").alias("target", "p")).select(
        "target", "qid", sentence.alias("sentence"), F.col("p.span.begin").alias("begin"), F.col("p.span.end").alias("end")
    )
    rows = rows.where("sentence is not null")
    return rows if include_self else rows.where(~F.col("target").eqNullSafe(F.col("qid")))


def context_lists(rows: DataFrame, part_size: int = 1000) -> DataFrame:
    """``target, part, contexts``: lists in source order, a hub's list cut into parts.

    Entries are numbered exactly, so part k holds entries k·part_size and following;
    no task gathers more than a part.
    """
    numbered = number_rows(rows, ["target"], ["qid", "sentence", "begin", "end"])
    entry = F.struct("_rank", "sentence", F.struct("begin", "end").alias("span"))
    return (
        numbered.withColumn("part", F.floor(F.col("_rank") / part_size).cast("int"))
        .groupBy("target", "part")
        .agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: F.struct(x["sentence"].alias("sentence"), x["span"].alias("span"))).alias("contexts"))
    )


def link_triples(articles: DataFrame, triples: DataFrame) -> DataFrame:
    """``qid, subj, rel, obj, pos``: triples between an article and its link targets, either way round.

    One equi-join over the triples seen from both ends; a self-link finds a self-loop twice.
    """
    links = articles.select("qid", F.explode(F.map_keys("link")).alias("target"))
    return links.join(both_ways(triples), ["qid", "target"]).select("qid", "subj", "rel", "obj", "pos")


def both_ways(triples: DataFrame) -> DataFrame:
    """Each complete triple seen from its subject and from its object: ``qid, target, as_subject`` beside its parts.

    One scan serves lookups in both directions; a self-loop gives two rows.
    """
    ends = F.array(
        F.struct(F.col("subj").alias("qid"), F.col("obj").alias("target"), F.lit(True).alias("as_subject")),
        F.struct(F.col("obj").alias("qid"), F.col("subj").alias("target"), F.lit(False).alias("as_subject")),
    )
    t = triples.where("subj is not null and rel is not null and obj is not null")
    return t.select("pos", "subj", "rel", "obj", F.inline(ends))


def triple_lists(rows: DataFrame, part_size: int = 1000) -> DataFrame:
    """``qid, part, triples`` of ``link_triples`` rows in file order, long lists cut into parts."""
    numbered = number_rows(rows, ["qid"], ["pos", "subj", "rel", "obj"])
    entry = F.struct("_rank", F.struct("subj", "rel", "obj").alias("t"))
    return (
        numbered.withColumn("part", F.floor(F.col("_rank") / part_size).cast("int"))
        .groupBy("qid", "part")
        .agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["t"]).alias("triples"))
    )


def merge_entities(
    merged: DataFrame, items: DataFrame, triples: DataFrame | None = None, merge_desc: bool = True, merge_aka: bool = True,
    merge_contexts: bool = True, part_size: int = 1000,
) -> DataFrame:
    """Merged entities: articles with item name, aliases, description, contexts and, with ``triples``, triples.

    name and aka stay null without an item, desc becomes ''.  Columns ``rec_id, qid,
    part, title, pid, name[, desc][, aka], text, link[, contexts, n_contexts][,
    triples, n_triples]``.  An entity with at most ``part_size`` contexts and triples is
    one row (part 0).  The lists of larger ones go on in rows of their own with the same
    ids, title, name and desc but null text and link, so no row grows with a hub.
    Where the article or item carries its own list columns they are not read.  Items
    may be one row per qid or, with ``row_id``, several, of which the last counts.
    """
    art = stage(last_articles(merged), "articles")
    item = last_values(items, "qid", "row_id" if "row_id" in items.columns else "qid", ["name", "desc", "aka"])
    kept = ["name", *(["desc"] if merge_desc else []), *(["aka"] if merge_aka else [])]
    out = art.join(item.select("qid", *kept), "qid", "left")
    if merge_desc:
        out = out.withColumn("desc", F.coalesce("desc", F.lit("")))
    out = out.withColumn("part", F.lit(0))
    lists = []
    if merge_contexts:
        own = contexts(art)
        lists.append(("contexts", context_lists(own, part_size).withColumnRenamed("target", "qid"), "array<struct<sentence:string,span:struct<begin:int,end:int>>>"))
    if triples is not None:
        lists.append(("triples", triple_lists(link_triples(art, triples), part_size), "array<struct<subj:string,rel:string,obj:string>>"))
    if not lists:
        return out.select("rec_id", "qid", "part", "title", "pid", *kept, "text", "link")
    lists = [(n, stage(d.join(art.select("qid"), "qid", "left_semi"), n), t) for n, d, t in lists]
    # what is beyond the first part of any list has a row of its own
    more = reduce(DataFrame.unionByName, [d.where("part > 0").select("qid", "part") for _, d, _ in lists]).distinct()
    blank = [F.lit(None).cast(out.schema[c].dataType).alias(c) for c in ("text", "link")]
    rest = more.join(out.drop("part", "text", "link"), "qid").select(*[F.col(c) for c in out.columns if c not in ("text", "link")], *blank)
    out = out.unionByName(rest)
    for name, d, kind in lists:
        sizes = d.groupBy("qid").agg(F.sum(F.size(name)).alias(f"n_{name}"))
        out = out.join(d, ["qid", "part"], "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
        out = out.join(sizes, "qid", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0).cast("long")))
    return out.select("rec_id", "qid", "part", "title", "pid", *kept, "text", "link", *[c for n, _, _ in lists for c in (n, f"n_{n}")])


def merge_statistics(merged: DataFrame) -> DataFrame:
    """One row over merged entities (parts of a long one count once): entities, non-blank descriptions, sentences and contexts in all and on average."""
    sents = F.aggregate(
        F.coalesce("text", F.array().cast("array<array<string>>")), F.lit(0).cast("long"), lambda a, p: a + F.greatest(F.coalesce(F.size(p), F.lit(0)), F.lit(0))
    )
    return merged.where("part = 0").select("desc", sents.alias("_s"), "n_contexts").agg(
        F.count(F.lit(1)).alias("entities"), F.sum((F.trim("desc") != "").cast("int")).alias("with_desc"),
        F.sum("_s").alias("sentences"), F.avg("_s").alias("mean_sentences"),
        F.sum("n_contexts").alias("contexts"), F.avg("n_contexts").alias("mean_contexts"),
    )


def corpus_counts(articles: DataFrame) -> DataFrame:
    """One row: articles, paragraphs, sentences, links."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    sents = F.aggregate(F.coalesce("text", F.array().cast("array<array<string>>")), F.lit(0), lambda a, p: a + size(p))
    return articles.agg(
        F.count(F.lit(1)).alias("articles"), n(size(F.col("text"))).alias("paragraphs"), n(sents).alias("sentences"),
        n(size(F.col("link"))).alias("links"),
    )
