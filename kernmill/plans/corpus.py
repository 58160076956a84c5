"""Article, context, dataset and report queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernmill.functions import text as X
from kernmill.operators import corpus as C
from kernmill.operators import datasets as D
from kernmill.operators import hierarchy
from kernmill.operators import reports as R
from kernmill.operators.entities import last_values, triple_frequency


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _wiki_tables(spark, sf):
    """page, usage and redirect in the shape of the wiki's tables, from the merged records."""
    m = _read(spark, sf, "merged").select("rec_id", "qid", "title", "name", "source")
    page = m.select(
        F.col("rec_id").alias("page_id"), X.title_key(F.col("title")).alias("page_title"),
        F.when(F.col("source").isNull(), 4).otherwise(0).alias("page_namespace"),
        F.when(F.col("title") != F.col("name"), 1).otherwise(0).alias("page_is_redirect"),
    )
    usage = m.select(F.col("rec_id").alias("eu_page_id"), F.col("qid").alias("eu_entity_id"),
                     F.when(F.col("name").isNull(), "X").otherwise("S").alias("eu_aspect"))
    redirect = m.where("title <> name").select(
        F.col("rec_id").alias("rd_from"), X.title_key(F.col("name")).alias("rd_title"), F.lit(0).alias("rd_namespace")
    )
    return page, usage, redirect


def title2qid(spark, sf):
    page, usage, _ = _wiki_tables(spark, sf)
    return C.title_map(page, usage)


def title2qid_redirect(spark, sf):
    page, usage, redirect = _wiki_tables(spark, sf)
    return C.with_redirects(C.title_map(page, usage), page, redirect)


def qid2title(spark, sf):
    return C.titles_by_id(_read(spark, sf, "merged").select("title", "qid", "rec_id"), "rec_id")


def title_format(spark, sf):
    return _read(spark, sf, "merged").select("rec_id", X.title_key(F.col("title")).alias("title_key"))


def articles_with_qid(spark, sf):
    d = _read(spark, sf, "documents").select("doc_id", X.title_key(F.col("title")).alias("title"))
    return d.join(title2qid(spark, sf), "title").select("doc_id", "title", "qid")


def page_url(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", X.page_url("http://wiki.example.org/w", F.col("doc_id")).alias("url"))


def page_filter(spark, sf):
    d = _read(spark, sf, "documents")
    ns = F.when(F.col("source") == "article", "0").otherwise("4")
    return d.where(C.is_content_page(ns, F.col("text"))).select("doc_id", "title")


def min_text(spark, sf):
    d = _read(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", C.content_length(F.col("text")).alias("n")).where("n >= 200")


def articles_paragraphs(spark, sf):
    p = C.body_paragraphs(F.col("text"))
    return _read(spark, sf, "documents").select("doc_id", F.posexplode(p).alias("para", "line"))


def first_n(spark, sf):
    p = C.body_paragraphs(F.col("text"), 2)
    return _read(spark, sf, "documents").select("doc_id", F.array_join(p, "\n").alias("body"))


def _anchors(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.posexplode(C.anchors(F.col("text"))).alias("i", "a")).select("doc_id", "i", "a.target", "a.label")


def link_extract(spark, sf):
    return _anchors(spark, sf)


def link_namespace_filter(spark, sf):
    # titles with a namespace-like prefix, made from source and title
    d = _read(spark, sf, "documents").select("doc_id", F.concat_ws(":", F.when(F.col("source") != "article", F.col("source")), "title").alias("target"))
    return d.where(C.accepted_target(F.col("target"), ("gloss", "letter")))


def link_map_last_wins(spark, sf):
    a = _anchors(spark, sf)
    return a.groupBy("doc_id", X.title_key(F.col("target")).alias("target")).agg(F.max_by("label", "i").alias("label"))


def _articles(spark, sf):
    return C.last_articles(_read(spark, sf, "merged"))


def contexts_by_target(spark, sf):
    return C.contexts(_articles(spark, sf))


def contexts_incl_self(spark, sf):
    return C.contexts(_articles(spark, sf), include_self=True)


def context_lists(spark, sf):
    c = C.context_lists(C.contexts(_articles(spark, sf)), 1000)
    return c.select("target", "part", F.size("contexts").cast("long").alias("n"), F.array_join(F.transform("contexts", lambda x: x["sentence"]), "|").alias("sentences"))


def link_triples(spark, sf):
    return C.link_triples(_articles(spark, sf), _read(spark, sf, "triples"))


def _merged_entities(spark, sf):
    return C.merge_entities(_read(spark, sf, "merged"), _read(spark, sf, "items"), _read(spark, sf, "triples"))


def merged_entities(spark, sf):
    """Articles with names, descriptions, contexts and triples: the flagship.  Lists are shown as text."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    context = lambda c: F.concat(c["sentence"], F.lit("@"), part(c["span"]["begin"]), F.lit("-"), part(c["span"]["end"]))
    return _merged_entities(spark, sf).select(
        "qid", "part", "rec_id", "title", "pid", "name", "desc", F.array_join("aka", "|", "").alias("aka"), "n_contexts",
        F.array_join(F.transform("contexts", context), "|").alias("contexts"), "n_triples",
        F.array_join(F.transform("triples", lambda t: F.concat_ws(" ", t["subj"], t["rel"], t["obj"])), "|").alias("triples"),
        F.coalesce(F.array_size(F.map_keys("link")), F.lit(0)).alias("n_links"),
        F.array_join(F.transform("text", lambda p: F.array_join(p, " ", "")), "|", "").alias("text"),
    )


def corpus_stats(spark, sf):
    return C.corpus_counts(_articles(spark, sf))


def merge_stats(spark, sf):
    return C.merge_statistics(_merged_entities(spark, sf))


def _splits(spark, sf):
    cols = ["ex_id", "qid", "title", "name", "desc", "contexts"]
    one = lambda t: _read(spark, sf, t).select(*cols, F.lit(t).alias("split"))
    return one("train").unionByName(one("dev")).unionByName(one("test"))


def desc_stats(spark, sf):
    return D.split_statistics(_splits(spark, sf), "split")


def desc_filter(spark, sf):
    return _read(spark, sf, "items").where(X.usable_description(F.col("desc"))).select("row_id", "qid", "desc")


def desc_examples(spark, sf):
    d = D.desc_examples(_read(spark, sf, "merged"))
    return d.select("rec_id", "qid", "title", "name", "desc", F.size("contexts").cast("long").alias("n_contexts"),
                    F.array_join(F.transform("contexts", lambda c: c["sentence"]), "|").alias("sentences"))


def split_exact(spark, sf):
    d = _read(spark, sf, "merged").select("rec_id")
    return D.exact_split(d, ["rec_id"], *D.shares(d.count(), 90))


def split_random_n(spark, sf):
    return D.exact_split(_read(spark, sf, "documents").select("doc_id"), ["doc_id"], 300, 300)


def split_category_uniform(spark, sf):
    d = _read(spark, sf, "documents").where("lang is not null").select("doc_id", F.lower("lang").alias("lang"))
    return D.category_uniform_split(d, ["doc_id"], "lang", 120, 120, 400)


def _context_rows(spark, sf):
    return _read(spark, sf, "merged").select("rec_id", "qid", F.posexplode("contexts").alias("i", "c")).select("rec_id", "qid", "i", "c.sentence")


def context_cap(spark, sf):
    rows = _context_rows(spark, sf).where("qid is not null")
    return D.cap_contexts(rows, ["qid"], ["rec_id", "i"], 10).select("qid", "rec_id", "i")


def _categories(spark, sf):
    """A category for each record: the first word of its description, '-' if there is none."""
    word = F.regexp_extract(F.lower(F.trim("desc")), "^([a-z]+)", 1)
    return _read(spark, sf, "merged").select("rec_id", "qid", F.coalesce(F.when(word != "", word), F.lit("-")).alias("category"),
                                             F.greatest(F.coalesce(F.size("contexts"), F.lit(0)), F.lit(0)).alias("n_contexts"))


def top_categories(spark, sf):
    rows = _categories(spark, sf)
    top = D.top_categories(rows, "category", 40)
    return rows.join(top.select("category"), "category", "left_semi").select("rec_id", "category")


def category_freq(spark, sf):
    return D.category_counts(_categories(spark, sf), "category")


def category_stats(spark, sf):
    return _categories(spark, sf).agg(
        F.count(F.lit(1)).alias("articles"), F.sum("n_contexts").alias("contexts"), F.count_distinct("category").alias("categories")
    )


def context_hist(spark, sf):
    return D.histogram(_categories(spark, sf), "n_contexts", 50)


def triple_coverage(spark, sf):
    return R.triple_coverage(_articles(spark, sf), _read(spark, sf, "triples"))


def related_triples(spark, sf):
    return R.related_triples(_articles(spark, sf), _read(spark, sf, "triples"))


def pair_mentions(spark, sf):
    return R.mentioned_pairs(_articles(spark, sf), _read(spark, sf, "triples"))


def _title_triples(spark, sf):
    props = last_values(_read(spark, sf, "properties"), "qid", "row_id", ["name"])
    return R.title_triples(_articles(spark, sf), _read(spark, sf, "triples"), props)


def frequent_triples(spark, sf):
    t = _title_triples(spark, sf).where("as_subject")
    return t.groupBy("rel_name", "obj_surface").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rel_name", "obj_surface").limit(50)


def frequent_relations(spark, sf):
    t = _title_triples(spark, sf).where("as_subject")
    return t.groupBy("rel_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rel_name").limit(50)


def frequent_objects(spark, sf):
    t = _title_triples(spark, sf).where("as_subject")
    return t.groupBy("obj_surface").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "obj_surface").limit(50)


def triple_sides(spark, sf):
    return _title_triples(spark, sf).groupBy("as_subject").agg(F.count(F.lit(1)).alias("n"))


def _edges(spark, sf):
    return hierarchy.property_edges(_read(spark, sf, "subprops"))


def prop_roots(spark, sf):
    return R.root_ancestors(_edges(spark, sf))


def _props(spark, sf):
    p = last_values(_read(spark, sf, "properties").withColumn("freq_n", F.col("freq.triple")), "qid", "row_id", ["name", "freq_n"])
    return p.select("qid", "name", F.coalesce("freq_n", F.lit(0)).alias("freq"))


def _frequent(spark, sf):
    return triple_frequency(_read(spark, sf, "triples")).where(F.col("qid").startswith("P") & (F.col("freq") >= 3))


def hypernym_props(spark, sf):
    return R.hypernym_properties(_props(spark, sf), _edges(spark, sf), _frequent(spark, sf))


def hypernym_summary(spark, sf):
    return R.hypernym_summary(_props(spark, sf), _edges(spark, sf), _frequent(spark, sf))


def span_surface(spark, sf):
    d = _read(spark, sf, "train").select("ex_id", F.posexplode("contexts").alias("i", "c")).where("c.sentence is not null and c.span is not null")
    return d.select("ex_id", "i", X.span_surface(F.col("c.sentence"), F.col("c.span.begin"), F.col("c.span.end")).alias("surface"))


def highlight_span(spark, sf):
    d = _read(spark, sf, "train").select("ex_id", F.posexplode("contexts").alias("i", "c")).where("c.sentence is not null and c.span is not null")
    return d.select("ex_id", "i", X.highlight(F.col("c.sentence"), F.col("c.span.begin"), F.col("c.span.end"), ("<b>", "</b>")).alias("marked"))


def context_viewer(spark, sf):
    d = _read(spark, sf, "dev").select("ex_id", "title", F.posexplode("contexts").alias("i", "c")).where("c.sentence is not null and c.span is not null")
    return d.select("ex_id", "i", F.concat_ws("\t", "title", X.highlight(F.col("c.sentence"), F.col("c.span.begin"), F.col("c.span.end"), ("[", "]"))).alias("line"))


def first_contexts(spark, sf):
    d = _read(spark, sf, "test").select("ex_id", F.posexplode(F.slice("contexts", 1, 5)).alias("i", "c"))
    return d.select("ex_id", "i", "c.sentence")


def flatten_array(spark, sf):
    d = _read(spark, sf, "merged").select("rec_id", F.flatten(F.filter("text", lambda p: p.isNotNull())).alias("s"))
    return d.select("rec_id", F.array_join("s", "|").alias("sentences"))


QUERIES = {f.__name__: f for f in (
    title2qid, title2qid_redirect, qid2title, title_format, articles_with_qid, page_url, page_filter, min_text,
    articles_paragraphs, first_n, link_extract, link_namespace_filter, link_map_last_wins, contexts_by_target, contexts_incl_self,
    context_lists, link_triples, merged_entities, corpus_stats, merge_stats, desc_stats, desc_filter, desc_examples, split_exact,
    split_random_n, split_category_uniform, context_cap, top_categories, category_freq, category_stats, context_hist, triple_coverage,
    related_triples, pair_mentions, frequent_triples, frequent_relations, frequent_objects, triple_sides, prop_roots, hypernym_props,
    hypernym_summary, span_surface, highlight_span, context_viewer, first_contexts, flatten_array,
)}

_KEY = "upper(substr(replace({0}, ' ', '_'), 1, 1)) || substr(replace({0}, ' ', '_'), 2)"

_TITLES = f"""
WITH page AS (
  SELECT rec_id AS page_id, {_KEY.format('title')} AS page_title, CASE WHEN source IS NULL THEN 4 ELSE 0 END AS ns,
    CASE WHEN title <> name THEN 1 ELSE 0 END AS redir, qid, CASE WHEN name IS NULL THEN 'X' ELSE 'S' END AS aspect FROM merged
), t2q AS (
  SELECT page_title AS title, arg_min(qid, page_id) AS qid FROM page WHERE ns = 0 AND redir = 0 AND aspect = 'S' AND page_title IS NOT NULL AND qid IS NOT NULL GROUP BY page_title
)
"""

_ART = """
WITH art AS (
  SELECT qid, rec_id, title, pid, text, link FROM merged WHERE qid IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rec_id DESC) = 1
), lk AS (
  SELECT qid, title, text, e.key AS target, e.value AS p FROM (SELECT qid, title, text, unnest(map_entries(link)) AS e FROM art)
), ctx AS (
  SELECT target, qid, CASE WHEN p.para >= 0 AND p.sent >= 0 THEN text[p.para + 1][p.sent + 1] END AS sentence,
    p.span."begin" AS "begin", p.span."end" AS "end" FROM lk
), valid AS (SELECT pos, subj, rel, obj FROM triples WHERE subj IS NOT NULL AND rel IS NOT NULL AND obj IS NOT NULL)
"""

_LT = """
, lt AS (
  SELECT l.qid, v.subj, v.rel, v.obj, v.pos FROM lk l JOIN valid v ON l.qid = v.subj AND l.target = v.obj
  UNION ALL
  SELECT l.qid, v.subj, v.rel, v.obj, v.pos FROM lk l JOIN valid v ON l.qid = v.obj AND l.target = v.subj
)
"""

_MERGED = (
    _ART
    + _LT
    + """
, it AS (SELECT qid, name, "desc", aka FROM items WHERE qid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY row_id DESC) = 1),
cn AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY qid, sentence, "begin", "end") - 1 AS r FROM ctx WHERE sentence IS NOT NULL AND target <> qid),
cl AS (SELECT target AS qid, (r // 1000)::INT AS part, string_agg(sentence || '@' || coalesce("begin"::VARCHAR, '') || '-' || coalesce("end"::VARCHAR, ''), '|' ORDER BY r) AS contexts
  FROM cn GROUP BY ALL),
nc AS (SELECT target AS qid, count(*) AS n FROM cn GROUP BY ALL),
tn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos, subj, rel, obj) - 1 AS r FROM lt),
tl AS (SELECT qid, (r // 1000)::INT AS part, string_agg(subj || ' ' || rel || ' ' || obj, '|' ORDER BY r) AS triples FROM tn GROUP BY ALL),
nt AS (SELECT qid, count(*) AS n FROM lt GROUP BY qid),
pt AS (SELECT qid, 0 AS part FROM art UNION SELECT qid, part FROM cl UNION SELECT qid, part FROM tl),
me AS (
  SELECT a.qid, p.part, a.rec_id, a.title, a.pid, it.name, coalesce(it."desc", '') AS "desc",
    CASE WHEN it.aka IS NOT NULL THEN coalesce(array_to_string(list_transform(it.aka, lambda x: coalesce(x, '')), '|'), '') END AS aka,
    coalesce(nc.n, 0) AS n_contexts, coalesce(cl.contexts, '') AS contexts, coalesce(nt.n, 0) AS n_triples, coalesce(tl.triples, '') AS triples,
    CASE WHEN p.part = 0 THEN coalesce(cardinality(a.link), 0)::INT ELSE 0 END AS n_links,
    CASE WHEN p.part = 0 THEN array_to_string(list_transform(a.text, lambda q: coalesce(array_to_string(list_transform(q, lambda x: coalesce(x, '')), ' '), '')), '|') END AS text
  FROM pt p JOIN art a ON p.qid = a.qid LEFT JOIN it ON a.qid = it.qid LEFT JOIN nc ON a.qid = nc.qid LEFT JOIN nt ON a.qid = nt.qid
    LEFT JOIN cl ON a.qid = cl.qid AND p.part = cl.part LEFT JOIN tl ON a.qid = tl.qid AND p.part = tl.part
)
"""
)

_PAIRS = """
, pairs AS (SELECT DISTINCT subj, obj FROM valid),
ranked AS (SELECT qid, unnest(map_keys(link)) AS t, unnest(range(cardinality(link)::BIGINT)) AS i FROM art WHERE cardinality(link) > 0),
m AS (
  SELECT qid, s AS subj, o AS obj, related FROM (
    SELECT qid, qid AS s, t AS o, true AS related FROM ranked
    UNION ALL SELECT qid, t, qid, true FROM ranked
    UNION ALL SELECT a.qid, a.t, b.t, false FROM ranked a JOIN ranked b ON a.qid = b.qid AND a.i < b.i
  ) x WHERE EXISTS (SELECT 1 FROM pairs p WHERE p.subj = x.s AND p.obj = x.o)
)
"""

_SURF = """lower(array_to_string(CASE WHEN {e} >= {b} AND greatest({b}, 0) < len(string_split({s}, ' '))
  THEN list_slice(string_split({s}, ' '), greatest({b}, 0) + 1, greatest({b}, 0) + 1 + ({e} - {b})) ELSE [] END, ' '))"""

_TT = (
    _ART
    + """
, surf AS (SELECT qid, target, CASE WHEN sentence IS NOT NULL THEN """
    + _SURF.format(s="sentence", b='"begin"', e='"end"')
    + """ END AS obj_surface FROM ctx),
pn AS (SELECT qid AS rel, name AS rel_name FROM properties WHERE qid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY row_id DESC) = 1),
tt AS (
  SELECT s.obj_surface, v.rel, true AS as_subject FROM surf s JOIN valid v ON s.qid = v.subj AND s.target = v.obj
  UNION ALL SELECT s.obj_surface, v.rel, false FROM surf s JOIN valid v ON s.qid = v.obj AND s.target = v.subj
), tn AS (SELECT pn.rel_name, tt.obj_surface, tt.as_subject FROM tt JOIN pn ON tt.rel = pn.rel WHERE pn.rel_name IS NOT NULL AND tt.obj_surface IS NOT NULL)
"""
)

_HYP = """
WITH edge AS (SELECT s AS child, o AS parent FROM subprops WHERE starts_with(s, 'P') AND starts_with(o, 'P')),
pr AS (SELECT qid, name, coalesce(freq.triple, 0) AS freq FROM properties WHERE qid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY row_id DESC) = 1),
ids AS (
  SELECT rel AS qid, 1 AS n FROM triples WHERE subj IS NOT NULL AND rel IS NOT NULL AND obj IS NOT NULL
  UNION ALL SELECT subj, 0 FROM triples WHERE subj IS NOT NULL AND rel IS NOT NULL AND obj IS NOT NULL
), fr AS (SELECT qid FROM ids WHERE starts_with(qid, 'P') GROUP BY qid HAVING sum(n) >= 3)
"""

_CAT = """
WITH c AS (
  SELECT rec_id, qid, CASE WHEN coalesce(regexp_extract(lower(trim("desc")), '^([a-z]+)', 1), '') = '' THEN '-'
    ELSE regexp_extract(lower(trim("desc")), '^([a-z]+)', 1) END AS category, coalesce(len(contexts), 0) AS n_contexts FROM merged
)
"""

_SPLITS = """
WITH sp AS (SELECT 'train' AS split, "desc", contexts FROM train UNION ALL SELECT 'dev', "desc", contexts FROM dev
  UNION ALL SELECT 'test', "desc", contexts FROM test)
"""

_LINKRE = "\\[\\[([^\\[\\]|]+)(?:\\|([^\\[\\]|]*))?\\]\\]"
_ANCH = f"""
WITH a AS (
  SELECT doc_id, unnest(range(len(t))) AS i, unnest(t) AS target, unnest(l) AS lab FROM (
    SELECT doc_id, regexp_extract_all(text, '{_LINKRE}', 1) AS t, regexp_extract_all(text, '{_LINKRE}', 2) AS l FROM documents) WHERE len(t) > 0
), an AS (SELECT doc_id, i, target, CASE WHEN coalesce(lab, '') = '' THEN target ELSE lab END AS label FROM a)
"""

_LINES = """list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[　 ]+$', '') <> '')"""


def _ctx_rows(table: str, extra: str = "") -> str:
    return f"SELECT ex_id, {extra} unnest(range(len(contexts))) AS i, unnest(contexts) AS c FROM {table} WHERE len(contexts) > 0"


def _mark(on: str, off: str) -> str:
    return f"""array_to_string(list_transform(string_split(c.sentence, ' '), lambda t, j:
  CASE WHEN j - 1 >= c.span."begin" AND j - 1 <= c.span."end" THEN '{on}' || t || '{off}' ELSE t END), ' ')"""


ORACLE = {
    "title2qid": _TITLES + "SELECT title, qid FROM t2q",
    "title2qid_redirect": _TITLES
    + f"""
, hop AS (
  SELECT p.page_title AS title, min(t.qid) AS qid FROM page p JOIN merged r ON p.page_id = r.rec_id JOIN t2q t ON t.title = {_KEY.format('r.name')}
  WHERE p.ns = 0 AND r.title <> r.name GROUP BY p.page_title
)
SELECT title, qid FROM hop UNION ALL SELECT title, qid FROM t2q WHERE title NOT IN (SELECT title FROM hop)""",
    "qid2title": "SELECT qid, arg_max(title, rec_id) AS title FROM merged WHERE qid IS NOT NULL GROUP BY qid",
    "title_format": f"SELECT rec_id, {_KEY.format('title')} AS title_key FROM merged",
    "articles_with_qid": _TITLES + f"SELECT doc_id, t.title, t.qid FROM documents d JOIN t2q t ON t.title = {_KEY.format('d.title')}",
    "page_url": "SELECT doc_id, 'http://wiki.example.org/w?curid=' || doc_id AS url FROM documents",
    "page_filter": r"""SELECT doc_id, title FROM documents WHERE source = 'article'
  AND NOT regexp_matches(coalesce(text, ''), '(?m)^\{\{disambig(uation)?(\|[^}]*)?\}\}')""",
    "min_text": "SELECT doc_id, length(replace(text, chr(10), ''))::INT AS n FROM documents WHERE length(replace(text, chr(10), '')) >= 200",
    "articles_paragraphs": f"""SELECT doc_id, unnest(range(len(l) - 1))::INT AS para, unnest(l[2:]) AS line FROM (SELECT doc_id, {_LINES} AS l FROM documents) WHERE len(l) > 1""",
    "first_n": f"""SELECT doc_id, CASE WHEN len(l) > 1 THEN array_to_string(l[2:3], chr(10)) END AS body FROM (SELECT doc_id, {_LINES} AS l FROM documents)""",
    "link_extract": _ANCH + "SELECT doc_id, i::INT AS i, target, label FROM an",
    "link_namespace_filter": """SELECT doc_id, target FROM (SELECT doc_id, concat_ws(':', CASE WHEN source <> 'article' THEN source END, title) AS target FROM documents)
  WHERE NOT starts_with(target, ':') AND (NOT instr(target, ':') > 1 OR split_part(target, ':', 1) IN ('gloss', 'letter'))""",
    "link_map_last_wins": _ANCH + f"SELECT doc_id, {_KEY.format('target')} AS target, arg_max(label, i) AS label FROM an GROUP BY ALL",
    "contexts_by_target": _ART + 'SELECT target, qid, sentence, "begin", "end" FROM ctx WHERE sentence IS NOT NULL AND target <> qid',
    "contexts_incl_self": _ART + 'SELECT target, qid, sentence, "begin", "end" FROM ctx WHERE sentence IS NOT NULL',
    "context_lists": _ART
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY qid, sentence, "begin", "end") - 1 AS r FROM ctx WHERE sentence IS NOT NULL AND target <> qid)
SELECT target, (r // 1000)::INT AS part, count(*) AS n, string_agg(sentence, '|' ORDER BY r) AS sentences FROM n GROUP BY ALL""",
    "link_triples": _ART + _LT + "SELECT qid, subj, rel, obj, pos FROM lt",
    "merged_entities": _MERGED + "SELECT * FROM me",
    "corpus_stats": _ART
    + """SELECT count(*) AS articles, sum(coalesce(len(text), 0))::BIGINT AS paragraphs,
  sum(coalesce(list_sum(list_transform(text, lambda p: coalesce(len(p), 0))), 0))::BIGINT AS sentences, sum(coalesce(cardinality(link), 0))::BIGINT AS links FROM art""",
    "merge_stats": _MERGED
    + """, sn AS (SELECT qid, list_sum(list_transform(text, lambda p: coalesce(len(p), 0))) AS n FROM art)
SELECT count(*) AS entities, sum((trim("desc") <> '')::INT)::BIGINT AS with_desc, coalesce(sum(sn.n), 0)::BIGINT AS sentences,
  coalesce(sum(sn.n), 0) / count(*) AS mean_sentences, sum(n_contexts)::BIGINT AS contexts, avg(n_contexts) AS mean_contexts
FROM me LEFT JOIN sn ON me.qid = sn.qid WHERE part = 0""",
    "desc_stats": _SPLITS
    + """SELECT split, count(*) AS entities, coalesce(sum((trim("desc") <> '')::INT), 0)::BIGINT AS with_desc,
  sum(coalesce(len(contexts), 0))::BIGINT AS contexts, avg(coalesce(len(contexts), 0)) AS mean_contexts FROM sp GROUP BY split""",
    "desc_filter": """SELECT row_id, qid, "desc" FROM items WHERE "desc" <> '' AND NOT contains(lower("desc"), 'wikipedia') AND NOT contains(lower("desc"), 'wikimedia')""",
    "desc_examples": """SELECT rec_id, qid, title, name, "desc", len(c) AS n_contexts, array_to_string(list_transform(c, lambda x: x.sentence), '|') AS sentences FROM (
  SELECT *, list_filter(contexts, lambda x: x.sentence <> '' AND x.span."end" >= x.span."begin") AS c FROM merged
  WHERE "desc" <> '' AND NOT contains(lower("desc"), 'wikipedia') AND NOT contains(lower("desc"), 'wikimedia')) WHERE len(c) > 0""",
    "split_exact": """SELECT rec_id, CASE WHEN r <= k THEN 'dev' WHEN r <= 2 * k THEN 'test' ELSE 'train' END AS split FROM (
  SELECT rec_id, row_number() OVER (ORDER BY md5('42' || rec_id), rec_id) AS r, floor(count(*) OVER () * 10 / 2 * 0.01) AS k FROM merged)""",
    "split_random_n": """SELECT doc_id, CASE WHEN r <= 300 THEN 'dev' WHEN r <= 600 THEN 'test' ELSE 'train' END AS split FROM (
  SELECT doc_id, row_number() OVER (ORDER BY md5('42' || doc_id), doc_id) AS r FROM documents)""",
    "split_category_uniform": """WITH k AS (SELECT doc_id, lower(lang) AS lang, md5('42' || doc_id) AS o FROM documents WHERE lang IS NOT NULL),
e AS (SELECT *, -ln((('0x' || substr(o, 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE) AS e FROM k),
t AS (SELECT *, sum(e) OVER (PARTITION BY lang ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) AS t FROM e),
r AS (SELECT *, row_number() OVER (ORDER BY t, doc_id) AS r FROM t)
SELECT doc_id, lang, CASE WHEN r <= 120 THEN 'dev' WHEN r <= 240 THEN 'test' ELSE 'train' END AS split FROM r WHERE r <= 640""",
    "context_cap": """SELECT qid, rec_id, i::INT AS i FROM (SELECT rec_id, qid, unnest(range(len(contexts))) AS i FROM merged WHERE qid IS NOT NULL AND len(contexts) > 0)
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY md5('42' || rec_id || i), rec_id, i) <= 10""",
    "top_categories": _CAT
    + """SELECT rec_id, category FROM c WHERE category IN (SELECT category FROM c WHERE category <> '-' GROUP BY category ORDER BY count(*) DESC, category LIMIT 40)""",
    "category_freq": _CAT + "SELECT category, count(*) AS count FROM c GROUP BY category",
    "category_stats": _CAT + "SELECT count(*) AS articles, sum(n_contexts)::BIGINT AS contexts, count(DISTINCT category) AS categories FROM c",
    "context_hist": _CAT
    + """, x AS (SELECT min(n_contexts)::DOUBLE AS a, (max(n_contexts) - min(n_contexts)) / 50.0::DOUBLE AS w FROM c)
SELECT bin, a + bin * w AS lo, a + (bin + 1) * w AS hi, count(*) AS count FROM (
  SELECT CASE WHEN w > 0 THEN least(floor((n_contexts - a) / w), 49)::INT ELSE 0 END AS bin, a, w FROM c, x) GROUP BY bin, a, w""",
    "triple_coverage": _ART
    + _PAIRS
    + """SELECT *, CASE WHEN n_all > 0 THEN 100.0::DOUBLE * n_distinct / n_all ELSE 0 END AS percent FROM (
  SELECT (SELECT count(*) FROM pairs) AS n_all, count(*) AS n_mentions, count(*) FILTER (related) AS n_related, count(*) FILTER (NOT related) AS n_unrelated,
    count(DISTINCT (subj, obj)) AS n_distinct FROM m)""",
    "related_triples": _ART + "SELECT a.qid, v.pos FROM art a JOIN valid v ON a.qid = v.subj OR a.qid = v.obj",
    "pair_mentions": _ART + _PAIRS + "SELECT qid, subj, obj, related FROM m",
    "frequent_triples": _TT + "SELECT rel_name, obj_surface, count(*) AS n FROM tn WHERE as_subject GROUP BY ALL ORDER BY n DESC, rel_name, obj_surface LIMIT 50",
    "frequent_relations": _TT + "SELECT rel_name, count(*) AS n FROM tn WHERE as_subject GROUP BY ALL ORDER BY n DESC, rel_name LIMIT 50",
    "frequent_objects": _TT + "SELECT obj_surface, count(*) AS n FROM tn WHERE as_subject GROUP BY ALL ORDER BY n DESC, obj_surface LIMIT 50",
    "triple_sides": _TT + "SELECT as_subject, count(*) AS n FROM tn GROUP BY ALL",
    "prop_roots": """WITH RECURSIVE edge AS (SELECT DISTINCT s AS child, o AS parent FROM subprops WHERE starts_with(s, 'P') AND starts_with(o, 'P') AND s <> o),
up AS (SELECT child AS prop, parent AS hi FROM edge UNION SELECT u.prop, e.parent FROM up u JOIN edge e ON u.hi = e.child)
SELECT DISTINCT prop, hi AS root FROM up WHERE hi NOT IN (SELECT child FROM edge)""",
    "hypernym_props": _HYP
    + """SELECT row_number() OVER (ORDER BY freq DESC, qid) - 1 AS place, qid, name, freq FROM pr
WHERE qid NOT IN (SELECT child FROM edge) AND qid IN (SELECT qid FROM fr)""",
    "hypernym_summary": _HYP
    + """SELECT (SELECT count(*) FROM pr) AS n_all, (SELECT count(*) FROM pr WHERE qid NOT IN (SELECT child FROM edge)) AS n_left,
  (SELECT count(DISTINCT child) FROM edge) AS n_hyponyms, (SELECT count(*) FROM fr) AS n_frequent,
  (SELECT count(*) FROM pr WHERE qid NOT IN (SELECT child FROM edge) AND qid IN (SELECT qid FROM fr)) AS n_both""",
    "span_surface": f"""SELECT ex_id, i::INT AS i, {_SURF.format(s='c.sentence', b='c.span."begin"', e='c.span."end"')} AS surface
FROM ({_ctx_rows('train')}) WHERE c.sentence IS NOT NULL AND c.span IS NOT NULL""",
    "highlight_span": f"SELECT ex_id, i::INT AS i, {_mark('<b>', '</b>')} AS marked FROM ({_ctx_rows('train')}) WHERE c.sentence IS NOT NULL AND c.span IS NOT NULL",
    "context_viewer": f"""SELECT ex_id, i::INT AS i, concat_ws(chr(9), title, {_mark('[', ']')}) AS line
FROM ({_ctx_rows('dev', 'title,')}) WHERE c.sentence IS NOT NULL AND c.span IS NOT NULL""",
    "first_contexts": "SELECT ex_id, unnest(range(least(len(contexts), 5)))::INT AS i, unnest(list_transform(contexts[1:5], lambda c: c.sentence)) AS sentence FROM test WHERE len(contexts) > 0",
    "flatten_array": "SELECT rec_id, array_to_string(flatten(list_filter(text, lambda p: p IS NOT NULL)), '|') AS sentences FROM merged",
}
