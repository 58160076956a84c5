"""The stages from dumps to datasets, one function per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernmill.functions.tokens import head_nouns, tokenized_description
from kernmill.operators import corpus, datasets, entities
from kernmill.operators.articles import build_articles
from kernmill.session import stage
from kernmill.sources import readers
from kernmill.wikitext import extract

__all__ = ["build_articles", "extract_entities", "extract_wiki", "make_category_dataset", "make_desc_dataset", "merge"]


def extract_entities(
    spark: SparkSession, path: str, lang: str = "en", required: tuple[str, ...] = ("name",), max_rows: int = 0,
    strict_lang: bool = False, require_iri: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, properties and triples of an N-Triples dump; entities without a required field are left out.

    One row per entity; triples keep ``pos``, their place in the files.
    """
    parsed = entities.parse_ntriples(readers.read_ntriples(spark, path, max_rows), require_iri)
    triples = entities.edges(parsed)
    all_ = entities.assemble(entities.literals(parsed, lang, strict_lang), entities.triple_frequency(triples))
    full = all_.where(entities.complete(list(required), dict(all_.dtypes))).withColumn("desc", tokenized_description(F.col("desc")))
    return full.where(~entities.is_property()), full.where(entities.is_property()), triples


def extract_wiki(spark: SparkSession, path: str, options: extract.Options | None = None) -> DataFrame:
    """Extracted pages of an XML dump, its own templates applied, under the dump's own namespace names."""
    pages = readers.read_pages(spark, path)
    info = readers.read_siteinfo(spark, path)
    return extract.extract_pages(pages, options, info["base"], extract.store_templates(pages), info["namespaces"])


def merge(articles: DataFrame, items: DataFrame, triples: DataFrame | None = None, **flags: bool) -> DataFrame:
    """Merged entities of articles and items, as ``build_articles`` and ``extract_entities`` give them or read from tables."""
    return corpus.merge_entities(articles, items, triples, **flags)


def _by_entity(examples: DataFrame, split) -> DataFrame:
    """``examples`` with the ``split`` of their entity: parts of a long entity go together."""
    if "part" not in examples.columns:
        return split(examples)
    heads = split(examples.select("rec_id", *[c for c in ("category",) if c in examples.columns]).distinct())
    return examples.join(heads.select("rec_id", "split"), "rec_id")


def make_desc_dataset(merged: DataFrame, train_percent: float = 90, seed: str = "42") -> DataFrame:
    """Description examples with ``split``; dev and test have half of the rest each, exactly.

    ``merged`` is the result of ``merge`` or a table of one row per ``rec_id``.
    """
    parts = [c for c in ("part",) if c in merged.columns]
    ex = datasets.desc_examples(merged).select("rec_id", *parts, "qid", "title", "name", "desc", "contexts")
    ex = stage(ex, "examples") if parts else ex
    n = ex.select("rec_id").distinct().count() if parts else ex.count()
    return _by_entity(ex, lambda d: datasets.exact_split(d, ["rec_id"], *datasets.shares(n, train_percent), seed))


def make_category_dataset(
    merged: DataFrame, n_dev: int = 3000, n_test: int = 3000, n_train: int = 0, n_categories: int = 500, max_contexts: int = 10,
    uniform: bool = True, seed: str = "42",
) -> DataFrame:
    """Examples labelled with the head noun of their description, top categories only, with ``split``.

    ``n_train`` 0 keeps the remainder.  Contexts are cut to ``max_contexts`` by a
    reproducible order over all of an entity's contexts, whatever parts they come in;
    the result has one row per entity.
    """
    parts = "part" in merged.columns
    ex = merged.where((F.length("desc") > 0) & (F.size("contexts") > 0)).withColumn("category", head_nouns(F.col("desc")))
    ex = stage(ex.select("rec_id", *(["part"] if parts else []), "qid", "desc", "contexts", "category"), "labelled")
    top = datasets.top_categories(ex.where("part = 0") if parts else ex, "category", n_categories)
    ex = ex.join(top.select("category"), "category", "left_semi")
    at = (lambda i: F.concat(F.col("part").cast("string"), F.lit("/"), i.cast("string"))) if parts else (lambda i: i.cast("string"))
    order = F.transform("contexts", lambda c, i: F.struct(F.md5(F.concat(F.lit(seed), F.col("rec_id").cast("string"), at(i))).alias("o"), c.alias("c")))
    ex = ex.withColumn("_best", F.slice(F.sort_array(order), 1, max_contexts))
    if parts:
        # a part keeps what may be among the entity's first; the rest is decided over the parts
        each = datasets.top_k_per_key(ex.select("rec_id", F.explode("_best").alias("b")).select("rec_id", "b.o", "b.c"), ["rec_id"], ["o"], max_contexts)
        best = each.groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("o", "c"))).alias("_best"))
        ex = ex.where("part = 0").drop("_best", "part").join(best, "rec_id")
    ex = ex.withColumn("contexts", F.transform("_best", lambda x: x["c"])).drop("_best")
    if uniform:
        return datasets.category_uniform_split(ex, ["rec_id"], "category", n_dev, n_test, n_train or 1 << 60, seed)
    return datasets.exact_split(ex, ["rec_id"], n_dev, n_test, seed)
